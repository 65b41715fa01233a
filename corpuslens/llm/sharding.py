"""Sharding by a minimax contiguous partition of atomic groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.ordering import global_positions
from corpuslens.llm.common import table, with_copy

#: Capacities tried at once; each round divides the range by one more than this.
TRIES = 31


def _cuts(ends: DataFrame, capacities: list[int], shards: int) -> list[list[int]]:
    """For each capacity, where greedy filling ends each shard: the last group end within reach, ``shards`` times."""
    at = [[0] for _ in capacities]
    for _ in range(shards):
        row = ends.agg(
            *[F.max(F.when(F.col("end") <= F.lit(p[-1] + c), F.col("end"))).alias(f"c{i}") for i, (p, c) in enumerate(zip(at, capacities))]
        ).first()
        for p, end in zip(at, row):
            p.append(max(end or 0, p[-1]))
    return at


def minimax_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """Ends of the shards for the smallest capacity with which greedy filling needs at most ``shards`` shards.

    ``ends`` has one row per group: the running size up to its end. Only capacities and cut points come to the
    driver; the search over capacities tries TRIES of them in each pass.
    """
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    best = None
    while low <= high:
        step = max(1, (high - low + 1) // (TRIES + 1))
        tried = sorted({*range(low, high + 1, step)})[: TRIES + 1] if high - low >= TRIES else [*range(low, high + 1)]
        found = _cuts(ends, tried, shards)
        fits = [i for i, p in enumerate(found) if p[-1] >= total]
        if fits:
            i = fits[0]
            best, high = found[i], tried[i] - 1
            low = tried[i - 1] + 1 if i else tried[i]
        else:
            low = tried[-1] + 1
    return best[1:] if best else [total] * shards


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Rows with equal texts are one group that is never cut apart (null is a text of its own; a null and an empty
    text have size 1 and crc 0). Groups are ordered by their smallest doc_id, null first; contiguous runs of groups
    go to shards so that the largest shard is as small as such runs allow. Law ``bytes``: sizes come as near to
    equal as whole groups permit. Slots count from 0 in each shard, by group, doc_id. Repeated rows get a slot each.
    An empty table gives no rows. Extra columns of ``docs`` are not read. ``grown_shard`` is null under this law.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias("digest"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = table(with_copy(rows, ["doc_id", "digest", "size", "text_crc32"]))
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    placed = table(
        global_positions(
            rows.join(groups, "digest").withColumn("row", F.struct("doc_id", "_copy", "text_crc32")),
            [], ["first_id", "digest", "row"], ["size"],
        ).select("digest", "row", "size", "position", (F.col("size_before") + F.col("size")).alias("end"))
    )
    ends = table(placed.groupBy("digest").agg(F.max("end").alias("end"), F.sum("size").alias("bytes"), F.max("position").alias("last")))
    total, largest = ends.agg(F.max("end"), F.max("bytes")).first()
    out = {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    if total is None:
        empty = rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
        return empty.withColumns(out).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    cuts = minimax_cuts(ends, total, largest, shards)
    number = sum((F.when(F.col("end") > F.lit(c), 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    before = ends.agg(*[F.coalesce(F.max(F.when(F.col("end") <= F.lit(c), F.col("last"))), F.lit(0)) for c in [0, *cuts[:-1]]]).first()
    first = F.array(*[F.lit(int(x)) for x in before])
    return (
        placed.withColumn("shard", number.cast("int"))
        .withColumn("slot", (F.col("position") - 1 - first[F.col("shard")]).cast("long"))
        .withColumns(out)
        .select("row.doc_id", "size", "row.text_crc32", "law", "shard", "slot", "grown_shard")
    )
