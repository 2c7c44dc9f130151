import re

import numpy as np
from lodestrata.llm import neardup as N

SCHEMA = "doc_id long, text string, source string, keeper long, h1 string, sign string"


def words(r, n):
    return [f"w{x}" for x in r.integers(0, 5000, n)]


def shingles(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def frame(spark, texts):
    rows = [(i, t, "s", 1, "h", "x") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))]
    return spark.createDataFrame(rows, SCHEMA)


def test_signature_is_the_least_hash_of_each_permutation():
    import pyarrow as pa
    from lodestrata.llm._text import U, Words, utf8

    texts = ["a b c d e", "one", "", None, "x y z " * 50]
    m, none = N.minhash(pa.array(texts))
    assert none.tolist() == [False, False, True, True, False]
    d, o = utf8(pa.array([texts[0]]))
    g, whole = Words(d, o).grams(3)
    a, b = N.constants(N.PERMS)
    for p in (0, 77):
        assert m[0, p] == min(int((int(x) * int(a[p]) + int(b[p])) % 2**64 >> 32) for x in g[whole])
    assert U(1) == 1


def test_recall_against_brute_force(spark):
    r = np.random.default_rng(3)
    texts = []
    for _ in range(60):
        base = words(r, int(r.integers(40, 120)))
        texts.append(" ".join(base))
        for _ in range(int(r.integers(0, 4))):
            w = list(base)
            for k in r.integers(0, len(w), max(1, len(w) // 25)):
                w[k] = f"z{r.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += [" ".join(words(r, 60)) for _ in range(200)]
    order = r.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [shingles(t) for t in texts]
    near = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])}
    far = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if len(sets[i] & sets[j]) < 0.2 * len(sets[i] | sets[j])}
    group = {x["doc_id"]: x["keeper"] for x in N.groups(frame(spark, texts)).collect()}
    same = lambda i, j: group.get(i, i) == group.get(j, j)
    assert len(near) > 40 and sum(same(*p) for p in near) >= 0.9 * len(near)
    assert sum(same(*p) for p in far) == 0


def test_groups_of_thousands(spark):
    r = np.random.default_rng(5)
    base = words(r, 100)
    texts = [" ".join(base[: i % 97] + [f"q{i}"] + base[i % 97 + 1 :]) for i in range(1500)] + [" ".join(words(r, 50)) for _ in range(50)]
    got = N.near_duplicates(frame(spark, texts)).collect()
    assert sum(x["duplicate_of"] == 0 for x in got) >= 0.99 * 1499 and all(x["doc_id"] < 1500 for x in got)
    assert N.dedup(frame(spark, texts)).count() == 51 + 1500 - len(got)
    assert all(x["links"] == len(got) - 1 == x["group_size"] - 1 for x in got)


def test_deep_regions_lose_no_near_pairs(spark):
    """Regions far beyond the tile go deeper; every link is counted once, wherever a pair meets."""
    r = np.random.default_rng(8)
    common = [words(r, 25) for _ in range(12)]
    texts = []
    for i in range(1200):
        own = [f"o{i // 3 if i < 300 else i}x{k}" for k in range(50)]
        if i < 300:
            own[int(r.integers(0, 50))] = f"p{i}"
        texts.append(" ".join(common[i // 3 % 12] + own))
    sets = [shingles(t) for t in texts]
    got = {x["doc_id"]: x for x in N.near_duplicates(frame(spark, texts), tile=12).collect()}
    assert set(got) == set(range(300))
    for i, x in got.items():
        assert x["duplicate_of"] == i // 3 * 3 and x["group_size"] == 3
        assert x["links"] == sum(len(sets[i] & sets[j]) >= N.THRESHOLD * len(sets[i] | sets[j]) for j in range(i // 3 * 3, i // 3 * 3 + 3)) - 1


def test_copies_and_links(spark):
    r = np.random.default_rng(9)
    base = words(r, 80)
    near = base[:40] + ["z"] + base[41:]
    texts = [" ".join(base)] * 5 + [" ".join(near)] * 3 + [" ".join(words(r, 60))] * 2 + [" ".join(words(r, 60))]
    got = {(x["doc_id"], x["duplicate_of"], x["text_id"], x["links"], x["group_size"]) for x in N.near_duplicates(frame(spark, texts)).collect()}
    assert got == {(i, 0, 0 if i < 5 else 5, 1, 8) for i in range(8)} | {(i, 8, 8, 0, 2) for i in (8, 9)}


def test_one_doc_id_with_several_texts(spark):
    r = np.random.default_rng(10)
    x, y = " ".join(words(r, 60)), " ".join(words(r, 60))
    rows = [(1, x, "s", 1, "h", "x"), (1, y, "s", 1, "h", "x"), (2, x, "s", 1, "h", "x"), (3, y, "s", 1, "h", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(g["doc_id"], g["keeper"]) for g in N.groups(df).collect()} == {(2, 1), (3, 1)}
    assert [g["doc_id"] for g in N.dedup(df).collect()] == [1]


def test_cases(spark):
    long = "lorem ipsum dolor " * 30_000
    df = frame(spark, {1: None, 2: "", 3: "", 4: "!!!", 5: "!!!", 6: "same text here", 7: "Same  text, here", 8: long, 9: long + "x", 10: "a"})
    df = df.union(spark.createDataFrame([(None, "same text here", None, None, None, None), (10, "a", "s", 1, "h", "x")], SCHEMA))
    group = {(x["doc_id"], x["keeper"]) for x in N.groups(df).collect()}
    assert group == {(3, 2), (5, 4), (7, 6), (9, 8)}
    kept = N.dedup(df)
    assert kept.schema == df.schema
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(map(str, [1, 2, 4, 6, 8, 10, None]))


def test_empty(spark):
    df = frame(spark, ["x"]).limit(0)
    assert N.near_duplicates(df).count() == 0 and N.dedup(df).count() == 0


def test_query_against_brute_force(spark, sf):
    from lodestrata.llm.entries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(docs)
    near = [(i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if sets[i] and len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j])]
    group = {r["doc_id"]: r["duplicate_of"] for r in QUERIES["op5_minhash_near_dedup"](spark, sf).collect()}
    assert near and sum(group.get(i, i) == group.get(j, j) for i, j in near) >= 0.9 * len(near)
    for i, keeper in group.items():
        assert max(len(sets[i] & sets[j]) / max(len(sets[i] | sets[j]), 1) for j in ids if j != i and group.get(j, j) == keeper) > 0.3


def test_recall_among_thousands_that_share_a_template(spark):
    r = np.random.default_rng(11)
    template = words(r, 92)  # 90 shingles
    texts, pairs = [], []
    for i in range(3000):
        own = [f"o{i}x{k}" for k in range(62)]
        if i % 20 == 1:  # 22 words, of which 20 shingles, as the one before has them
            own[:22] = [f"o{i - 1}x{k}" for k in range(22)]
            pairs.append((i - 1, i))
        texts.append(" ".join(own[:62] + template))
    order = r.permutation(len(texts))
    sets = [shingles(t) for t in texts]
    jac = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(jac(*p) >= N.THRESHOLD for p in pairs) and jac(0, 5) < N.THRESHOLD
    place = {int(o): k for k, o in enumerate(order)}
    group = {x["doc_id"]: x["keeper"] for x in N.groups(frame(spark, [texts[i] for i in order])).collect()}
    got = sum(group.get(place[i], place[i]) == group.get(place[j], place[j]) for i, j in pairs)
    assert got >= 0.97 * len(pairs) and len(group) <= len(pairs)


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "same text", 1, "u", 5, 6), (2, "same text", 2, "v", 5, 6)], "doc_id long, text string, __lode_h long, `meta.url` string, __lode_cut int, `a``b` int")
    out = N.dedup(df)
    assert out.schema == df.schema and out.count() == 1
