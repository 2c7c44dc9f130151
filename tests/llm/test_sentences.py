import random
import re

from lodestrata.llm import sentences as S

SCHEMA = "doc_id long, text string, n_chars long, hash string, place int, fd string"
r = random.Random(4)
VOCABULARY = ["".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(4000)]


def passage(n):
    out = []
    for k in range(n):
        out.append(r.choice(VOCABULARY) + (r.choice([". ", ".\n", ", ", "! "]) if r.random() < 0.12 else " "))
    return "".join(out).strip() + "."


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 7, "h", 1, "f") for i, t in texts], SCHEMA)


def cut_words(raw: bytes):
    return [m.span() for m in re.finditer(rb"[A-Za-z0-9\x80-\xff]+", raw)]


def brute(docs, n):
    """Covered bytes by document, word by word in plain Python but for the cutting rule's hash."""
    import numpy as np
    from lodestrata.llm._text import Words

    spans = []
    for i, t in docs:
        raw = t.encode()
        d = np.frombuffer(raw, np.uint8)
        at = cut_words(raw)
        h = Words(S.lowered(d), np.array([0, len(d)])).hash.tolist() if len(d) else []
        assert len(h) == len(at)
        ends = [k for k in range(len(at)) if k == 0 or re.search(rb"[.!?,;:\n\r]", raw[at[k - 1][1] : at[k][0]]) or h[k - 1] % S.PICKED == 0] + [len(at)]
        runs = set()
        for u in range(len(ends) - 1):
            v = u + 2
            while v < len(ends) and ends[v] - ends[u] < n:
                v += 1
            if v < len(ends):
                runs.add((u, v))
            v, w = u + 1, u - 1  # and back from the sentence's end
            while w >= 0 and ends[v] - ends[w] < n:
                w -= 1
            if w >= 0:
                runs.add((w, v))
        if len(ends) > 2 and len(at) < n:
            runs.add((0, len(ends) - 1))
        for u, v in runs:
            key = tuple(raw[a:b].lower() if raw[a:b].isascii() else S.lowered(np.frombuffer(raw[a:b], np.uint8)).tobytes() for a, b in at[ends[u] : ends[v]])
            spans.append((key, i, at[ends[u]][0], at[ends[v]][0] if ends[v] < len(at) else len(raw)))
    first: dict = {}
    for key, i, a, b in spans:
        p = (i, a << 32 | b)
        first[key] = min(first.get(key, p), p)
    covered: dict = {}
    for key, i, a, b in spans:
        if (i, a << 32 | b) != first[key]:
            covered.setdefault(i, set()).update(range(a, b))
    return covered


def covers(rows):
    out: dict = {}
    for x in rows:
        assert x["start"] < x["end"]
        out.setdefault(x["doc_id"], set()).update(range(x["start"], x["end"]))
    return out


def test_against_brute_force(spark):
    shared = [passage(60) for _ in range(6)]
    docs = []
    for i in range(40):
        parts = [passage(r.randint(1, 60))]
        if r.random() < 0.6:
            parts += [r.choice(shared), passage(20)]
        if r.random() < 0.3:
            parts += [r.choice(shared).upper(), "é " + passage(5)]
        docs.append((i, r.choice([" ", "\n", ". "]).join(parts)))
    docs += [(100, docs[0][1]), (101, ""), (102, "short")]
    got = covers(S.repeats(frame(spark, docs)).collect())
    assert got == brute(docs, S.WORDS)


def test_planted(spark):
    p = [passage(r.randint(51, 90)) for _ in range(30)]
    docs = [(i, f"{passage(30)[:-1]} {x} {passage(30)}") for i, x in enumerate(p)] + [(100 + i, f"{passage(10)[:-1]} {x} {passage(10)}") for i, x in enumerate(p)]
    docs += [(200 + i, passage(200)) for i in range(50)]
    got = {x["doc_id"] for x in S.repeats(frame(spark, docs)).collect()}
    assert got == set(range(100, 130))
    out = {x["doc_id"]: x for x in S.remove(frame(spark, docs)).collect()}
    for i, x in enumerate(p):
        assert out[i]["text"] == docs[i][1] and x[len(x) // 3 : 2 * len(x) // 3] not in out[100 + i]["text"]
        assert out[100 + i]["n_chars"] == len(out[100 + i]["text"]) and out[i]["n_chars"] == 7


def test_cases(spark):
    p, q = passage(80), passage(3000)
    docs = [(1, p), (2, None), (3, p), (3, p), (4, "x"), (None, p), (5, q * 3), (6, "!" * 1000), (7, "")]
    df = frame(spark, docs)
    out = S.remove(df)
    assert out.schema == df.schema and out.count() == df.count()
    rows = out.collect()
    assert [x["text"] for x in rows if x["doc_id"] is None] == [p] and [x["text"] for x in rows if x["doc_id"] == 1] == [p]
    assert len([x for x in rows if x["doc_id"] == 3]) == 2 and all(len(x["text"]) < 60 for x in rows if x["doc_id"] == 3)
    once = next(x["text"] for x in rows if x["doc_id"] == 5)
    assert len(q) <= len(once) < 1.1 * len(q)
    assert S.repeats(df.limit(0)).count() == 0 and S.remove(df.limit(0)).count() == 0


def test_one_doc_id_with_two_texts(spark):
    p, q = passage(60), passage(60)
    rows = S.remove(frame(spark, [(1, p), (2, passage(5) + " " + p), (2, q)])).collect()
    assert [x["text"] for x in rows if x["doc_id"] == 2 and x["text"] == q] == [q]


def test_query_against_brute_force(spark, sf):
    from lodestrata.llm.entries import QUERIES

    docs = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert covers(QUERIES["op6_sentence_dedup"](spark, sf).collect()) == brute(docs, S.WORDS)


def runs_brute(docs, n):
    """Covered bytes by document, from all runs of two sentences and n words, or of a whole shorter text."""
    import numpy as np
    from lodestrata.llm._text import Words

    found: dict = {}
    for i, t in docs:
        raw = t.encode()
        at = cut_words(raw)
        d = np.frombuffer(raw, np.uint8)
        h = Words(S.lowered(d), np.array([0, len(d)])).hash.tolist()
        ends = [k for k in range(len(at)) if k == 0 or re.search(rb"[.!?,;:\n\r]", raw[at[k - 1][1] : at[k][0]]) or h[k - 1] % S.PICKED == 0] + [len(at)]
        for x, u in enumerate(ends):
            for v in ends[x + 2 :]:
                if v - u >= n or (u == 0 and v == len(at)):
                    key = tuple(raw[a:b].lower() for a, b in at[u:v])
                    found.setdefault(key, []).append((i, at[u][0], at[v][0] if v < len(at) else len(raw)))
    covered: dict = {}
    for places in found.values():
        for i, a, b in sorted(places)[1:]:
            covered.setdefault(i, set()).update(range(a, b))
    return covered


def test_every_repeated_run_is_found(spark):
    def sentence(n):
        return " ".join(r.choices(VOCABULARY, k=n)) + ". "

    p = sentence(30) + sentence(1) + sentence(9) + sentence(9).strip()
    short = "Two words. And four more here."
    docs = [(1, p), (2, p), (3, short), (4, short), (5, "x " + sentence(25) + p + " " + sentence(30)), (6, "Alone"), (7, "Alone")]
    docs += [(10 + i, sentence(r.randint(1, 30)) + p[r.randint(0, 60) :] + " " + sentence(r.randint(1, 9))) for i in range(20)]
    got = covers(S.repeats(frame(spark, docs)).collect())
    assert got == runs_brute(docs, S.WORDS)
    assert got[2] == set(range(len(p))) and got[4] == set(range(len(short)))
    out = {x["doc_id"]: x["text"] for x in S.remove(frame(spark, docs)).collect()}
    assert (out[1], out[2], out[3], out[4], out[7]) == (p, "", short, "", "Alone")


def test_names_that_clash(spark):
    p = passage(80)
    df = spark.createDataFrame([(1, p, 1, "u", 5, 6), (2, p + " x", 2, "v", 5, 6)], "doc_id long, text string, __lode_id long, `meta.url` string, __lode_cut int, `a``b` int")
    out = S.remove(df)
    assert out.schema == df.schema and out.count() == 2
