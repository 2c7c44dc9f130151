import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.llm import packing as P

SCHEMA = "doc_id long, text string, source string, length string, rank int"


def best_fit(lengths, capacity):
    """Piece by piece, longest first: into the tightest bin; room left in each bin."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return sorted(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=60))
def test_plan_is_best_fit(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    p = P.plan(counts, 12)
    fill: dict = {}
    for length, rank, n, first, each, offset in zip(*p.values(), strict=True):
        for k in range(n):
            fill.setdefault(int(first + k // each), []).append((int(offset + k % each * length), int(length)))
    for spans in fill.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    assert sorted(fill) == list(range(len(fill)))
    assert sorted(12 - sum(n for _, n in s) for s in fill.values()) == best_fit(lengths, 12)


def test_plan_of_large_counts():
    p = P.plan({5000: 10**9, 3000: 10**9, 192: 10**9, 8192: 7}, 8192)
    assert len(p["length"]) < 20 and p["pieces"].sum() == 3 * 10**9 + 7


def check(rows, texts, capacity):
    """Every token of every text once, none over another; bins numbered without gaps."""
    want = sorted(len(t.encode()) + 1 for t in texts if t)
    assert sum(r["length"] for r in rows) == sum(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence"], []).append((r["position"], r["length"]))
    assert sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        spans.sort()
        assert spans[-1][0] + spans[-1][1] <= capacity
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))


def test_pack(spark):
    r = np.random.default_rng(0)
    texts = ["é" * int(n) for n in r.integers(0, 40, 300)] + [None, "", "x" * 1000, "same", "same"]
    ids = [*range(300), 300, 301, 302, 303, 303]
    df = spark.createDataFrame([(i, t, "s", "clash", 1) for i, t in zip(ids, texts, strict=True)] + [(None, "no id", None, None, None)], SCHEMA)
    rows = P.pack(df, 64).collect()
    check(rows, [*texts, "no id"], 64)
    pieces = sorted((x["piece"], x["start"], x["length"]) for x in rows if x["doc_id"] == 302)
    assert [p[1] for p in pieces] == [64 * i for i in range(16)] and pieces[-1][2] == 1001 - 15 * 64
    assert {x["doc_id"] for x in rows}.isdisjoint({300, 301}) and sum(x["doc_id"] == 303 for x in rows) == 2
    sizes = [64] * sum((len(t.encode()) + 1) // 64 for t in [*texts, "no id"] if t)
    sizes += [m for t in [*texts, "no id"] if t and (m := (len(t.encode()) + 1) % 64)]
    assert len({x["sequence"] for x in rows}) == len(best_fit(sizes, 64))
    again = P.pack(df.repartition(3), 64).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_empty_and_bad(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert P.pack(df).count() == 0
    with pytest.raises(ValueError):
        P.pack(df, 0)


def test_query(spark, sf):
    from lodestrata.llm.entries import QUERIES

    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op1_best_fit_packing"](spark, sf).collect(), texts, P.CAPACITY)
