import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.llm import fingerprints as P

SCHEMA = "doc_id long, text string, anchor long, leader string, n int"


def of(b: bytes) -> P.Prefixes:
    return P.Prefixes(np.frombuffer(b, np.uint8))


def test_value_of_a_span():
    raw = b"polynomial"
    want = 0
    for base, prime in zip(P.BASES, P.PRIMES, strict=True):
        want = want << 31 | sum((c + 1) * base**i for i, c in enumerate(raw[2:7])) % prime
    assert int(of(raw).spans(2, 7)) == want


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.data())
def test_equality_and_extension(a, data):
    b = data.draw(st.one_of(st.binary(max_size=40), st.just(a), st.builds(lambda k, x: a[:k] + x, st.integers(0, len(a)), st.binary(max_size=10))))
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    p, q = of(a), of(b)
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    assert p.extension(i, j, q) == n
    k = data.draw(st.integers(0, 12))
    assert p.equal(i, j, k, q) == (i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k])


def test_no_false_matches_in_all_spans():
    raw = bytes(random.Random(1).choices(b"ab", k=300))
    p = of(raw)
    a, b = np.triu_indices(301, 1)
    seen: dict = {}
    for h, i, j in zip(p.spans(a, b).tolist(), a.tolist(), b.tolist(), strict=True):
        assert seen.setdefault(h, raw[i:j]) == raw[i:j]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def shared(x: bytes, y: bytes) -> int:
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def compare(got, rows):
    """Every row is there; common_bytes is the longest shared opening, to the byte, and neighbor shares it."""
    assert sorted(map(repr, ((r["doc_id"], r["n_bytes"]) for r in got))) == sorted(repr((i, None if t is None else len(t.encode()))) for i, t in rows)
    known = sorted((t.encode(), i) for i, t in rows if i is not None and t is not None)
    texts: dict = {}
    want: dict = {}
    for k, (b, i) in enumerate(known):  # in the order of bytes the best is beside
        best = max([0, *(shared(b, known[j][0]) for j in (k - 1, k + 1) if 0 <= j < len(known))])
        want.setdefault((i, len(b)), set()).add(best)
        texts.setdefault(i, []).append(b)
    for r in got:
        i, n = r["doc_id"], r["n_bytes"]
        if i is None or n is None:
            assert r["neighbor"] is None and r["common_bytes"] is None
            continue
        assert r["common_bytes"] in want[i, n], r
        assert (r["neighbor"] is None) == (r["common_bytes"] == 0)
        if r["neighbor"] is not None:
            assert any(shared(x, y) == r["common_bytes"] for x in texts[i] for y in texts[r["neighbor"]])


def test_against_brute_force(spark):
    r = random.Random(2)
    base = ["".join(r.choices("abc é", k=r.randint(200, 2000))) for _ in range(10)]
    rows = []
    for i in range(100):
        t = r.choice(base)
        k = r.randint(0, len(t))
        rows.append((i, t[:k] + r.choice(["", "x", t[k:]]) + "y" * r.randint(0, 2)))
    rows += [(200, None), (None, base[0]), (201, ""), (202, ""), (203, "z" * 300_000), (204, "z" * 300_001), (205, "q"), (205, "q")]
    got = P.fingerprint(frame(spark, rows)).collect()
    compare(got, rows)
    prints: dict = {}
    for x in got:
        if x["fingerprint"] is not None:
            prints.setdefault((x["fingerprint"], x["n_bytes"]), set()).add(x["doc_id"])
    texts: dict = {}
    for i, t in rows:
        if t is not None:
            texts.setdefault(t, set()).add(i)
    assert sorted(map(str, map(sorted, [[str(x) for x in v] for v in prints.values()]))) == sorted(map(str, map(sorted, [[str(x) for x in v] for v in texts.values()])))


def test_every_length_of_common_opening(spark):
    r = random.Random(4)
    base = "".join(r.choices("abcdefgh", k=1400))
    rows = []
    for n in [*range(0, 300), *range(500, 530), *range(1020, 1030)]:  # each pair of its own first letter and opening
        mark = chr(0x4E00 + n)
        rows += [(2 * n, mark + base[:n]), (2 * n + 1, mark + base[:n] + "#" * (n % 3) + "!")]
    got = {x["doc_id"]: x for x in P.fingerprint(frame(spark, rows)).collect()}
    compare(list(got.values()), rows)
    for n in (0, 1, 12, 13, 14, 60, 61, 62, 200, 253, 299, 509, 510, 1021):
        assert got[2 * n]["common_bytes"] == len((chr(0x4E00 + n) + base[:n]).encode())


def test_one_opening_everywhere(spark):
    rows = [(i, "The same opening of all texts. " * 30 + str(i % 700)) for i in range(3000)]
    compare(P.fingerprint(frame(spark, rows).repartition(7)).collect(), rows)


def test_string_ids(spark):
    df = spark.createDataFrame([("u-1", "abcd"), ("u-2", "abxx"), (None, "ab")], "doc_id string, text string")
    assert {(r["doc_id"], r["neighbor"], r["common_bytes"]) for r in P.fingerprint(df).collect()} == {("u-1", "u-2", 2), ("u-2", "u-1", 2), (None, None, None)}


def test_empty(spark):
    assert P.fingerprint(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    from lodestrata.llm.entries import QUERIES

    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(QUERIES["op10_fingerprints"](spark, sf).collect(), rows)
