from itertools import permutations

from compare import compare, duck
from corpuslens.llm import audit, queries
from llm_support import SF, hard_docs
from pyspark.sql import functions as F

WORDS = " ".join(f"w{i}" for i in range(60))


def brute(docs, labels):
    """Every document along every order."""
    fails, rows = [], {}
    text = [(d[1] or "") for d in docs]
    for i, d in enumerate(docs):
        words = [w for w in text[i].translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        f = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text[i]) > 5 * len(text[i]),
            "D": any(c in "#$%&*|" for c in text[i]), "E": d[0] is not None and any(text[j] == text[i] and docs[j][0] is not None and docs[j][0] < d[0] for j in range(len(docs))),
        }
        fails.append({k for k, v in f.items() if v})
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    for i, d in enumerate(docs):
        good, toxic = (any(lab[0] == d[0] is not None and lab[k] == 1 for lab in labels) for k in (1, 2))
        for order in permutations("ABCDE"):
            gone = False
            for s, f in enumerate(order, 1):
                r = rows.setdefault((d[2] or "", "".join(order), s), dict.fromkeys(names, 0))
                hit = f in fails[i]
                r["redundant"] += hit and gone
                r["removed"] += hit and not gone
                r["good_lost"] += hit and not gone and good
                r["toxic_lost"] += hit and not gone and toxic
                r["unique_fails"] += fails[i] == {f}
                gone |= hit
                r["kept"] += not gone
    for (part, order, s), r in rows.items():
        r["shapley"] = sum(q["removed"] for (p, o, t), q in rows.items() if p == part and o[t - 1] == order[s - 1])
    return {k: tuple(v.values()) for k, v in rows.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in [*audit.COUNTS, "shapley"]) for r in df.collect()}


def test_against_brute_force(spark):
    docs = [
        (1, WORDS, "a"), (2, WORDS, "a"), (2, WORDS, "b"), (None, WORDS, None), (None, WORDS, ""), (3, "short", "a"), (4, None, "a"), (5, "", "b"), (6, "x " * 80, "b"), (7, WORDS + " #", "a"),
        (8, WORDS.upper(), "b"), (8, "SHORT #", "b"), (9, "SHORT #", None), (10, WORDS.replace("w1 ", " w1\x0b"), "a"), (1, WORDS, "a"), (11, "É" * 60, "a"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (99, 1, 1), (None, 1, 1), (6, None, 1), (8, 2, 1), (9, 1, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert got(audit.audit(d, lab)) == brute(docs, labels)


def test_against_sql(spark):
    assert compare(spark, duck(SF), "op11_filter_audit", queries.op11_filter_audit, queries.ORACLES["op11_filter_audit"], SF) is None


def test_codes_against_sql(spark):
    assert compare(spark, duck(SF), "op12_vector_codes", queries.op12_vector_codes, queries.ORACLES["op12_vector_codes"], SF) is None


def test_hard_rows(spark):
    docs = hard_docs(spark).withColumns({n: F.lit("x") for n in ("part", "mask", "bits", "n", "good", "toxic", "first_id", "labelled", "own", "steps", "cells", "at", "counts")})
    labels = spark.createDataFrame([(1, 1, 0, "x")], "doc_id long, quality int, toxic int, n string")
    rows = got(audit.audit(docs, labels))
    assert len(rows) == 600 * 4 and {k[0] for k in rows} == {"", "a", "b", "c"}
    assert sum(r[0] + r[1] for k, r in rows.items() if k[1:] == ("EABCD", 1)) == docs.count()
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert len(got(audit.audit(docs, labels.limit(0)))) == 2400
