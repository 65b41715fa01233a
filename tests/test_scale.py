"""Order-dependent helpers on a skewed key, and the same result for any partitioning."""

from corpuslens.functions.ordering import global_positions, top_k
from corpuslens.operators import inventory as I
from corpuslens.operators import selection as C
from corpuslens.sources.overlay import Tables
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_positions_with_a_hot_key(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"),
                                    F.format_string("%08d", F.hash("id") % 1000 + F.lit(1000) + F.col("id") * 7).alias("o"), (F.col("id") % 13).alias("w"))
    got = global_positions(df.repartition(16), ["k"], ["o"], ["w"]).toPandas().sort_values(["k", "o"])
    for _, g in got.groupby("k"):
        assert list(g.position) == list(range(1, len(g) + 1))
        assert list(g.w_before) == [0, *g.w.cumsum().tolist()[:-1]]


def test_large_tree_positions_and_summaries(spark):
    files = spark.range(100_000).select(F.lit("big").alias("repo"), F.format_string("d%02d/f%04d.ts", (F.col("id") / 1000).cast("int"), (F.col("id") % 1000).cast("int")).alias("path"), F.lit("x").alias("content"))
    s = C.directory_summaries(I.inventory(files))
    assert s.count() == 100 and s.where("selectable_files <> 1000").count() == 0


def test_top_k_is_trimmed_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_k(df, ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_plain_inventory_reads_no_text(spark):
    t = Tables(spark, SF)
    plan = C.directory_summaries(t.inv)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_partition_invariance(spark):
    t = Tables(spark, SF)
    for job in (lambda d: I.classify(d).select("repo", "path", "class", "content_hash"), lambda d: I.source_revision(I.inventory(d)), lambda d: C.directory_summaries(I.inventory(d))):
        one, many = job(t.files.coalesce(1)), job(t.files.repartition(8))
        assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
