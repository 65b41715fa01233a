import random
from collections import Counter

import numpy as np
import pyarrow as pa

from corpuslens.llm import bagminhash as B
from llm_support import SF, hard_docs


def bag(text):
    w = (text or "").encode().split()
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < 5 else Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def overlap(x, y):
    total = sum((x | y).values())
    return sum((x & y).values()) / total if total else 0.0


def brute(rows, threshold=0.8):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= threshold:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {(doc, least[root(i)]) for i, (doc, _) in enumerate(rows)}


def variants(rng, words, n, most):
    vocabulary = [f"v{i}" for i in range(500)]
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        yield " ".join(w)


def test_signature_estimates_weighted_overlap():
    rng = random.Random(1)
    base = [rng.choice("abcdefgh") for _ in range(300)]
    pairs = [("a b c d e " * 400, "a b c d e " * 300), ("a b c", "a b c"), ("a b c", "a b d"), (" ".join(base), " ".join(base[:250]))]
    pairs += [(" ".join(base), t) for t in variants(rng, base, 6, 20)]
    left, right = (pa.array([p[i] for p in pairs]) for i in (0, 1))
    want = np.array([overlap(bag(a), bag(b)) for a, b in pairs])
    assert np.allclose(B.overlap(left, right), want)
    a, b = (B.signatures(len(pairs), *B.bags(x), 4096) for x in (left, right))
    assert np.abs((a == b).mean(1) - want).max() < 0.03


def test_classes_against_all_pairs(spark):
    rng = random.Random(4)
    rows, vocabulary = [], [f"u{i}" for i in range(2000)]
    for size, length, most in ((60, 80, 2), (40, 60, 6), (5, 200, 3), (2, 30, 1), (80, 50, 1)):
        words = [rng.choice(vocabulary) for _ in range(length)]
        rows += list(variants(rng, words, size, most))
    rows += [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(100)]
    rows += [rows[0]] * 50 + ["same short"] * 3 + ["buy now " * n for n in range(5, 60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows, 100))
    got = B.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    wrong = {(r["doc_id"], r["class_id"]) for r in got if r["digest"] != "d41d8cd98f00b204e9800998ecf8427e"} ^ {x for x in brute(rows) if dict(rows)[x[0]]}
    assert len(got) == len(rows) and not wrong, wrong
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert {(r["doc_id"], r["class_id"]) for r in B.classes(df).collect()} == brute(rows)
    kept = B.kept_documents(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in brute(rows)}


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = B.classes(docs).collect()
    assert len(got) == docs.count()
    assert {(r["doc_id"], r["class_id"]) for r in got} >= {(5, 5), (6, 5), (1, 1), (2, 2), (3, 3), (None, None)}
    kept = B.kept_documents(docs).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "4", "4", "5", "7", "8", "None", "None"]
    assert B.classes(docs.limit(0)).count() == 0


def test_long_words_of_one_pattern_differ(spark):
    # Thue-Morse words: every polynomial hash modulo 2**64 takes the two for equal
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["class_id"]) for r in B.classes(df).collect()) == [(1, 1), (2, 2), (3, 1)]


def test_templates_that_share_every_bucket(spark):
    # families of texts that share most of a template: each bucket holds members of several classes
    rng = random.Random(5)
    template = [f"t{i}" for i in range(120)]
    rows = []
    for family in range(12):
        base = [w if rng.random() > 0.16 else f"f{family}_{i}" for i, w in enumerate(template)]
        for k in range(14):
            text = [w if rng.random() > 0.02 else f"x{family}_{k}_{i}" for i, w in enumerate(base)]
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in B.classes(df).collect()} == brute(rows)
