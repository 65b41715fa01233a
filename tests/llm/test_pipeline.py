import corpus_pipeline
from corpuslens.llm import QUERIES
from llm_support import SF, documents, hard_docs
from test_bagminhash import brute as near_classes
from test_pii import brute as personal


def test_stages_one_by_one(spark):
    docs = documents(spark)
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "personal_data", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, docs, SF).cache()
    assert kept.columns == columns
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()}
    assert len(gone) <= 0.02 * docs.count()
    single = stages["near_duplicates"](spark, kept, SF).cache()
    classes = near_classes([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert single.columns == columns and {r["doc_id"] for r in single.collect()} == {c for _, c in classes}
    clean = stages["personal_data"](spark, single, SF).cache()
    assert clean.columns == columns and clean.count() == single.count() and not any(personal(r["text"]) for r in clean.collect())
    mixed = stages["mixing"](spark, clean, SF).cache()
    assert mixed.columns == columns
    size = {r["doc_id"]: len(r["text"].encode().split()) for r in clean.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert all(n <= 2 * size[d] for d, n in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 20
    packed = stages["packing"](spark, mixed, SF).collect()
    assert sum(r["size"] for r in packed) == sum(taken.values())


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "bin_id", "text"} <= set(rows.columns)


def test_stages_take_hard_and_empty_tables(spark):
    docs = hard_docs(spark)
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == docs.columns, name
            out.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()


def test_language_stage_keeps_what_it_cannot_judge(spark):
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)["language_id"]
    docs = documents(spark)
    short = spark.createDataFrame([(900_001, "A.", "en", "a", 2), (900_002, "12 !!", "en", "a", 5), (900_003, None, None, "a", 0), (900_004, "\U0001e922\U0001e923 \U0001e924", None, "a", 4)], docs.schema)
    kept = {r["doc_id"] for r in stage(spark, docs.unionByName(short), SF).collect()}
    assert {900_001, 900_004} <= kept and not {900_002, 900_003} & kept
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).unionByName(short.withColumn("lang", F.lit(None).cast("string")))
    kept = {r["doc_id"] for r in stage(spark, unlabelled, SF).collect()}
    assert kept == {r["doc_id"] for r in unlabelled.where(F.col("text").rlike(r"\p{L}")).collect()}


def test_other_columns_come_through_as_they_are(spark):
    from pyspark.sql import functions as F

    docs = hard_docs(spark)
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.count() > 0 and out.where(F.array(*[F.col(c) for c in extra]) != F.array_repeat(F.lit("x"), len(extra))).count() == 0, name


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
