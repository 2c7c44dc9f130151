import numpy as np
import pytest
from lodestrata.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int, u long, rank int, dim int"
ALL = "true"


def brute(rows, k, every=1):
    """Every pair, on the grid of the operator."""
    best = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            best[i] = min(best.get(i, v), v)
    out = {}
    unit = {i: np.array(v, np.float64) / (np.linalg.norm(v) or 1) for i, v in best.items()}
    for i, a in unit.items():
        if i % every:
            continue
        scored = [(-np.rint(float(a @ b) * K.GRID), j) for j, b in unit.items() if j != i and len(a) == len(b)]
        out[i] = [(j, -s / K.GRID) for s, j in sorted(scored)[:k]]
    return out


def compare(got, want):
    by: dict = {}
    for r in sorted(got, key=lambda r: (r["vec_id"], r["rank"])):
        by.setdefault(r["vec_id"], []).append((r["neighbor_id"], r["score"]))
    want = {i: v for i, v in want.items() if v}
    assert by.keys() == want.keys()
    for i in by:
        assert np.allclose([s for _, s in by[i]], [s for _, s in want[i]], atol=2e-6)
        assert [j for j, _ in by[i]] == [j for j, _ in want[i]]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def f32(v):
    return [float(np.float32(x)) for x in v]


@pytest.mark.parametrize("block, k", [(7, 5), (40, 3), (1000, 200)])
def test_against_brute_force(spark, block, k):
    r = np.random.default_rng(1)
    rows = [(int(i), f32(r.normal(size=8))) for i in r.permutation(120)]
    compare(K.search(frame(spark, rows), k, block, ALL).collect(), brute(rows, k))


def test_cases(spark):
    r = np.random.default_rng(2)
    rows = [(i, f32(r.normal(size=4))) for i in range(30)]
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)]  # ties beyond any bin
    rows += [(200, [0.0] * 4), (201, None), (202, []), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (205, [1.0, 2.0]), (206, [2.0, 1.0]), (207, [3.0] * 9), (208, [float("inf")] * 4)]
    rows += [(5, [9.0] * 4), (6, rows[6][1]), (300, f32([1e-30] * 4)), (301, f32([1e30, 1e30, 0, 0]))]
    compare(K.search(frame(spark, rows), 6, 16, ALL).collect(), brute(rows, 6))


def test_close_scores_need_every_round(spark):
    rows = [(i, f32([1.0, 1e-3 + i * 1e-6, 0.0])) for i in range(300)]
    compare(K.search(frame(spark, rows), 4, 64, ALL).collect(), brute(rows, 4))


def test_empty_and_bad(spark):
    df = frame(spark, [(1, [1.0])])
    assert K.search(df, queries=ALL).count() == 0 and K.search(df.limit(0), queries=ALL).count() == 0
    with pytest.raises(ValueError):
        K.search(df, 0)


def test_queries_against_all_rows(spark):
    r = np.random.default_rng(3)
    rows = [(int(i), f32(r.normal(size=6))) for i in range(-150, 700)]
    compare(K.search(frame(spark, rows), 7, 128).collect(), brute(rows, 7, 100))
