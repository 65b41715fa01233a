import hashlib
import random
import re

from corpuslens.llm import substring
from llm_support import SF, hard_docs, hard_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=13):
    least = {}
    words = [WORD.findall(t or "") for _, t in rows]
    key = [float("inf") if i is None else i for i, _ in rows]
    for i, w in zip(key, words):
        for p in range(len(w) - k + 1):
            g = tuple(w[p : p + k])
            least[g] = min(i, least.get(g, float("inf")))
    out = []
    for (doc, _), i, w in zip(rows, key, words):
        gone = [False] * len(w)
        for p in range(len(w) - k + 1):
            if least[tuple(w[p : p + k])] < i:
                gone[p : p + k] = [True] * k
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rng.choice(vocabulary) for _ in range(n)] for n in (12, 13, 14, 19, 25, 60)]
    rows = []
    for i in range(300):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(w))
            w[at:at] = rng.choice(passages)
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(900 + i, " ".join(passages[5])) for i in range(100)]
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r[2] for r in want) > 1000
    assert got(substring.remove_repeats(df)) == want
    monkeypatch.setattr(substring, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(substring, "BUCKET_WORDS", 1500)
    assert got(substring.remove_repeats(df)) == want


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert got(substring.remove_repeats(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])


def test_hard_rows(spark):
    docs = hard_docs(spark)
    assert got(substring.remove_repeats(docs)) == brute([(r[0], r[1]) for r in hard_rows()])
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_spans_are_the_removed_words(spark):
    w = [f"a{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "x " + " ".join(w) + " y")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in substring.remove_repeats(df).collect()}
    assert [tuple(s) for s in r[2]["spans"]] == [(1, 21)] and r[2]["kept"] == "x y" and r[1]["spans"] == []
    assert hashlib.sha256(r[1]["kept"].encode()).hexdigest() == hashlib.sha256(" ".join(w).encode()).hexdigest()
