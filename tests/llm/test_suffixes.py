import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.llm import suffixes as S

from .test_sentences import frame, passage

r = random.Random(6)


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=20), min_size=1, max_size=5), st.integers(1, 9))
def test_open_places_are_long_common_prefixes(parts, least):
    x = np.array([v for k, p in enumerate(parts) for v in [*p, -k - 1]])
    sa, joined = S.open_places(x, least)
    y = x.tolist()
    assert sorted(sa.tolist()) == list(range(len(x)))
    for i in range(1, len(x)):
        a, b = y[sa[i - 1] :][:least], y[sa[i] :][:least]
        assert a <= b and joined[i] == (common(a, b) >= least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=20), min_size=1, max_size=5), st.integers(1, 6))
def test_equal_runs(parts, least):
    own, start, cls = S.equal_runs([np.array(p) for p in parts], least)
    got, want = defaultdict(set), defaultdict(set)
    for o, s, c in zip(own.tolist(), start.tolist(), cls.tolist(), strict=True):
        got[c].add((o, s))
    for i, p in enumerate(parts):
        for a in range(len(p) - least + 1):
            want[tuple(p[a : a + least])].add((i, a))
    assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}


def words(t):
    return [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", t.encode())]


def brute(docs, least):
    first, spans, out = {}, [], defaultdict(set)
    for i, t in docs:
        w = words(t)
        for a in range(len(w) - least + 1):
            key = tuple(w[a : a + least])
            spans.append((key, i, a))
            first[key] = min(first.get(key, (i, a)), (i, a))
    for key, i, a in spans:
        if (i, a) != first[key]:
            out[i].update(range(a, a + least))
    return dict(out)


def covers(rows):
    out = defaultdict(set)
    for x in rows:
        out[x["doc_id"]].update(range(x["start"], x["end"]))
    return dict(out)


def corpus():
    shared = [passage(90) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [passage(r.randint(1, 60))]
        for _ in range(r.randint(0, 2)):
            s = r.choice(shared).split(" ")
            if r.random() < 0.4:
                s[r.randrange(len(s))] = "changed"
            parts += [" ".join(s[r.randint(0, 20) :]), passage(10)]
        docs.append((i, " ".join(parts)))
    return [*docs, (100, docs[0][1]), (101, ""), (102, "short"), (103, "ab " * 200), (104, "ab " * 300), (105, (passage(30) + " ") * 4), (106, (passage(7) + " ") * 9)]


def test_against_brute_force(spark):
    docs = corpus()
    for least, gram in ((50, 20), (30, 30), (12, 1)):
        assert covers(S.repeats(frame(spark, docs), least, gram).collect()) == brute(docs, least)


def test_planted(spark):
    p = [passage(r.randint(51, 90)) for _ in range(30)]
    docs = [(i, f"{passage(30)[:-1]} {x} {passage(30)}") for i, x in enumerate(p)] + [(100 + i, f"{passage(10)[:-1]} {x} {passage(10)}") for i, x in enumerate(p)]
    docs += [(200 + i, passage(200)) for i in range(50)]
    assert {x["doc_id"] for x in S.repeats(frame(spark, docs)).collect()} == set(range(100, 130))
    out = {x["doc_id"]: x["text"] for x in S.remove(frame(spark, docs)).collect()}
    assert all(out[i] == docs[i][1] and x not in out[100 + i] for i, x in enumerate(p))


def test_cases(spark):
    p, q = passage(80), passage(3000)
    docs = [(1, p), (2, None), (3, p), (3, p), (4, "x"), (None, p), (5, q + " " + q), (6, "!" * 1000), (7, ""), (8, p[: len(p) // 2]), (8, passage(70))]
    df = frame(spark, docs)
    out = S.remove(df)
    assert out.schema == df.schema and out.count() == df.count()
    rows = out.collect()
    assert [x["text"] for x in rows if x["doc_id"] is None] == [p] and all(x["text"] == "" for x in rows if x["doc_id"] == 3)
    assert len(words(next(x["text"] for x in rows if x["doc_id"] == 5))) == 3000
    assert S.repeats(df.limit(0)).count() == 0 and S.remove(df.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    from lodestrata.llm.entries import QUERIES

    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert covers(QUERIES["op8_suffix_array_dedup"](spark, sf).collect()) == brute(docs, S.MIN_WORDS)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "word word word", 1, "u", 5, 6), (2, "word word word", 2, "v", 5, 6)], "doc_id long, text string, __lode_h long, `meta.url` string, __lode_cut int, `a``b` int")
    out = S.remove(df)
    assert out.schema == df.schema and out.count() == 2
