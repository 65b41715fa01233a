"""Order-dependent values over groups of any size, and a test of keys that needs no shuffle.

A plain window puts a whole group into one task. Here the rows are range
partitioned on (keys, order), so a group that holds a third of all rows is
spread over many slices; each slice is ranked on its own and shifted by the
totals of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.session import durable


def global_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weights: Sequence[str] = ()
) -> DataFrame:
    """Columns keys + order + weights, ``position`` (from 1 per key) and ``<weight>_before``.

    (keys, order) must be unique. The slices are materialised once, because a
    range partitioning is chosen by sampling and must not differ between its two readers.
    """
    keys, order, weights = list(keys), list(order), list(weights)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = durable(
        df.select(*keys, *order, *weights)
        .repartitionByRange(n, *keys, *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    totals = slices.groupBy(*keys, "_slice").agg(
        F.count("*").alias("_n"), *[F.sum(w).alias(f"_t_{w}") for w in weights]
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"),
        *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_w0_{w}") for w in weights],
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return slices.join(offsets, [*keys, "_slice"]).select(
        *keys,
        *order,
        *weights,
        (F.row_number().over(inside) + F.col("_n0")).cast("long").alias("position"),
        *[
            (F.coalesce(F.sum(w).over(before), F.lit(0)) + F.col(f"_w0_{w}")).cast("long").alias(f"{w}_before")
            for w in weights
        ],
    )


def latest_before(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, payload: Sequence[str], width: int) -> DataFrame:
    """Each row of ``left`` with the ``payload`` of the latest row of ``right`` of its keys with ``since <= at``; nulls without one.

    Time (whole numbers) is cut into spans of ``width``. A span's rows are ordered among themselves; what stood when it
    began is the latest row of the spans before it, found on one row per span. So a key that holds a third of all rows
    is spread over its spans. Rows that share a ``since`` are told apart by the largest payload. Rows with a null key or
    time find nothing and are found by nothing.
    """
    keys, payload = list(keys), list(payload)
    span = lambda c: F.floor(F.col(c) / F.lit(width))
    events = right.select(*keys, F.col(since).alias("_t"), F.struct(F.col(since).alias("_since"), *payload).alias("_seen")).where(F.col("_t").isNotNull())
    events = events.select(*keys, span("_t").alias("_span"), "_t", "_seen")
    asked = left.select(*keys, F.col(at).alias("_t")).where(F.col("_t").isNotNull()).distinct().withColumn("_span", span("_t"))
    newest = events.groupBy(*keys, "_span").agg(F.max("_seen").alias("_newest"))
    spans = newest.unionByName(asked.select(*keys, "_span").distinct(), allowMissingColumns=True).groupBy(*keys, "_span").agg(F.max("_newest").alias("_newest"))
    earlier = Window.partitionBy(*keys).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_span", F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"))
    none = F.lit(None).cast(events.schema["_seen"].dataType)
    both = events.withColumn("_asks", F.lit(0)).unionByName(asked.select(*keys, "_span", "_t", none.alias("_seen"), F.lit(1).alias("_asks")))
    inside = Window.partitionBy(*keys, "_span").orderBy("_t", "_asks", "_seen").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = both.withColumn("_latest", F.last("_seen", ignorenulls=True).over(inside)).where("_asks = 1")
    found = latest.join(carried, [*keys, "_span"]).select(*keys, F.col("_t").alias(at), F.coalesce("_latest", "_carried").alias("_found"))
    return left.join(found, [*keys, at], "left").select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in payload])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark trims each input partition to k rows per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def likely_in(keys: DataFrame):
    """A test whether a row may have one of ``keys``, by its columns of the same names: it is never wrong about a key, and
    lets few other rows pass.

    One bit per hashed key, sixteen bits to a key, in a bitmap of at most 2 MB that travels with the tasks, so most
    other rows are gone before an exact join shuffles the rest. ``keys`` is read twice.
    """
    words = 1 << min(max((keys.count() // 4).bit_length(), 4), 18)
    at = F.pmod(F.xxhash64(*keys.columns), F.lit(words * 64))
    word, bit = F.floor(at / 64).cast("int"), (at % 64).cast("int")
    set_ = keys.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("m"))
    unset = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("m"))
    folded = set_.unionByName(unset).groupBy("w").agg(F.bit_or("m").alias("m"))
    bits = folded.agg(F.sort_array(F.collect_list(F.struct("w", "m"))).alias("b")).select(F.col("b.m")).scalar()
    return F.getbit(F.get(bits, word), bit) == 1


def digest_lanes(text) -> list:
    """Four 60-bit lanes of a SHA-256, to be summed: a digest of a set that needs no ordering."""
    h = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]


def set_digest(lanes: Sequence[str]) -> list:
    """Aggregates whose joined text identifies the set of rows, whatever their order or partitioning."""
    return [F.sum(c).cast("decimal(38,0)").cast("string") for c in lanes]
