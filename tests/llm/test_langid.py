import zlib

from corpuslens.llm import langid
from llm_support import documents, hard_docs
from pyspark.sql import functions as F


def phrases(text, corpus):
    """Greedy longest-match phrases, by substring tests."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in corpus:
            j += 1
        n, i = n + 1, j
    return n


def test_entropy_is_that_of_a_plain_parse():
    corpora = {"a": "the cat sat on the mat and the dog sat on the log", "b": "der hund und die katze auf der matte"}
    model = langid.Model(corpora)
    texts = ["the dog", "katze und hund", "zzz the", "x", "ä", "the cat sat on the mat and then der hund " * 40]
    bits = model.entropy(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate(model.langs):
            n = sum(phrases(t[p : p + langid.PIECE], corpora[lang]) for p in range(0, len(t), langid.PIECE))
            assert abs(bits[i, k] - n * model.weight[k] / len(t)) < 1e-9, (t, lang)


def test_held_out_accuracy(spark):
    docs = documents(spark)
    model = langid.train(docs)
    got = langid.identify(docs, model).withColumn("held", langid.held_out(F.col("doc_id"))).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97


def test_only_the_text_decides(spark):
    docs = documents(spark)
    model = langid.train(docs)
    a = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    b = langid.identify(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'s' as source", "n_chars"), model).collect()
    assert all(a[r["text"]] == (r["lang_pred"], r["score"]) for r in b)


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = langid.identify(docs, langid.train(documents(spark))).collect()
    assert len(got) == docs.count()
    assert {r["lang_pred"] for r in got if not r["text"] or not any(map(str.isalpha, r["text"]))} == {"und"}
    assert langid.identify(docs.limit(0), langid.train(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
