import hashlib
import math

import pytest
from lodestrata.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, supply int, src string, __pos int"


def brute(docs, knots, budget, epochs):
    """(doc_id, epoch, source_start, position), by bisection on the demand."""
    times = [t for t, _ in next(iter(knots.values()))]
    total = [sum(v[i][1] for v in knots.values()) for i in range(len(times))]

    def demand(s, t):
        area = 0.0
        for i in range(len(times) - 1):
            a, b = times[i], min(t, times[i + 1])
            if b > a:
                w0, w1 = knots[s][i][1] / total[i], knots[s][i + 1][1] / total[i + 1]
                slope = (w1 - w0) / (times[i + 1] - times[i])
                area += w0 * (b - a) + slope * (b - a) ** 2 / 2
        return area * budget

    out = []
    for s in knots:
        own = [(hashlib.md5(f"{'' if d is None else d}:{t}".encode()).hexdigest(), d, len(t.encode()) + 1) for d, t, x in docs if x == s and t]
        own.sort(key=lambda x: x[0])
        supply, at = sum(n for _, _, n in own), 0
        for e in range(epochs):
            for _, d, n in own:
                if at < demand(s, 1) and e * supply < demand(s, 1):
                    lo, hi = 0.0, 1.0
                    for _ in range(80):
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if demand(s, mid) < at else (lo, mid)
                    out.append((d, e, at, lo))
                at += n
    return sorted(out, key=str)


def test_positions(spark):
    docs = [(i, "word " * (i % 7 + 1), "abc"[i % 3]) for i in range(60)] + [(60, "x", None), (61, None, "a"), (62, "", "a"), (5, "word " * 6, "c"), (63, "y", "unused")]
    knots = {"a": [(0.0, 5.0), (0.4, 1.0), (1.0, 0.0)], "b": [(0.0, 1.0), (0.4, 1.0), (1.0, 6.0)], "c": [(0.0, 2.0), (0.4, 2.0), (1.0, 1.0)], None: [(0.0, 0.0), (0.4, 0.1), (1.0, 0.0)]}
    df = spark.createDataFrame([(*d, 1, "z", 2) for d in docs], SCHEMA)
    got = M.assign(df, M.schedule(spark, knots), budget=1500, max_epochs=3).collect()
    want = brute(docs, knots, 1500, 3)
    mine = sorted(((r["doc_id"], r["epoch"], r["source_start"], r["position"]) for r in got), key=str)
    assert [m[:3] for m in mine] == [w[:3] for w in want]
    assert all(math.isclose(m[3], w[3], abs_tol=1e-6) for m, w in zip(mine, want, strict=True))
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)
    assert {r["doc_id"] for r in got}.isdisjoint({61, 62, 63})


def test_weights_are_met(spark):
    docs = [(i, "t" * 99, "big" if i % 10 else "small") for i in range(4000)]
    df = spark.createDataFrame([(*d, 1, "z", 2) for d in docs], SCHEMA)
    got = M.assign(df, M.schedule(spark, {"big": [(0.0, 3.0), (1.0, 1.0)], "small": [(0.0, 1.0), (1.0, 1.0)]}), budget=100_000).collect()
    share = lambda lo, hi: sum(r["source"] == "small" for r in got if lo <= r["position"] < hi) / sum(lo <= r["position"] < hi for r in got)
    assert abs(share(0, 0.1) - 0.2625) < 0.02 and abs(share(0.9, 1) - 0.4875) < 0.02


def test_mix_keeps_columns(spark):
    rows = [(i, f"text {i}", "ab"[i % 2], i, "s", 9) for i in range(20)]
    df = spark.createDataFrame([*rows, (None, "no id", "a", 0, "s", 9)], SCHEMA)
    m = M.mix(df)
    assert m.schema == df.schema
    assert {tuple(r) for r in m.collect()} <= {tuple(r) for r in df.collect()}
    a = [r["doc_id"] for r in M.assign(df).collect()]
    assert [r["doc_id"] for r in M.mix(df).collect()] == a


def test_hot_source_has_many_tasks(spark):
    df = spark.createDataFrame([(i, f"t{i}", "hot", 1, "s", 2) for i in range(500)], SCHEMA)
    got = M.assign(df, digits=2).collect()
    assert sorted(r["source_start"] for r in got) == sorted({r["source_start"] for r in got}) and len(got) == 500


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.assign(df).count() == 0 and M.mix(df).count() == 0
    for bad in ({}, {"a": [(0.0, 1.0)]}, {"a": [(0.0, 0.0), (1.0, 1.0)]}, {"a": [(0.0, 1.0), (1.0, 1.0)], "b": [(0.0, 1.0), (0.9, 1.0)]}):
        with pytest.raises(ValueError):
            M.schedule(spark, bad)


def test_small_sources_meet_their_demand(spark):
    size = {"big": 3600, "a": 80, "b": 80, "c": 80, "d": 80, "e": 80, "tiny": 2}
    df = spark.createDataFrame([(k, "t" * 99, s, 1, "z", 2) for k, s in enumerate(s for s, n in size.items() for _ in range(n))], SCHEMA)
    got = M.assign(df).collect()
    total = sum(size.values())
    weight = lambda s, p: size[s] ** p / sum(n**p for n in size.values())
    for s in size:
        want = (weight(s, M.START) + weight(s, M.END)) / 2 * total
        assert abs(sum(r["source"] == s for r in got) - want) <= 1, s
    assert max(r["epoch"] for r in got) > 4 and max(r["position"] for r in got if r["source"] == "tiny") > 0.8
    lacks = {r["source"]: (r["demand"], r["supply"]) for r in M.shortfall(df, 4).collect()}
    assert set(lacks) == {"tiny"} and lacks["tiny"][0] > lacks["tiny"][1] == 800
    assert sum(r["source"] == "tiny" for r in M.assign(df, max_epochs=4).collect()) == 8
