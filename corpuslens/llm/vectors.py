"""Embedding near-duplicates by sorted projection passes, and search by rotated one-bit codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import components, renewed, shuffle_parts, table

#: Near-duplicates: the cosine that links, passes with hashes of their own, bits of a hash, neighbours on each side.
COSINE, PASSES, BITS, WINDOW = 0.95, 16, 63, 64
#: Vectors of a block when the links inside a wide component are counted.
BLOCK = 1024
SEED = 11


def sound(vectors: DataFrame, vector: str):
    """Condition: a vector with components, none of them null, NaN or infinite, not all zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix (all of one length)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # neither squares of large nor of small components leave the range
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def by_length(batch: pa.RecordBatch, vector: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts whose vectors have one length."""
    lengths = np.array(batch.column(batch.schema.get_field_index(vector)).value_lengths().to_numpy(zero_copy_only=False))
    for n in np.unique(lengths):
        yield batch.filter(pa.array(lengths == n)) if (lengths != n).any() else batch


def hashed(rows: DataFrame, passes: int, bits: int, seed: int) -> DataFrame:
    """(dim, turn, hash, node, v) for each pass: the hash's bits are signs of random projections, first bit highest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for whole in batches:
            for batch in by_length(whole, "v"):
                x = unit(matrix(batch.column(1)))
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng(seed + d).standard_normal((passes, d, bits))
                for turn in range(passes):
                    h = ((x @ planes[d][turn]) > 0) @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), d)), pa.array(np.full(len(x), turn)), pa.array(h), batch.column(0), batch.column(1)], ["dim", "turn", "hash", "node", "v"]
                    )

    return rows.select("node", "v").mapInArrow(run, "dim long, turn long, hash long, node long, v array<double>")


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links i-j join two trees; ``label`` (a tree's root for each row) is brought up to date."""
    used = np.zeros(len(i), bool)
    for k in np.flatnonzero(label[i] != label[j]):
        a, b = label[i[k]], label[j[k]]
        while label[a] != a:
            a = label[a]
        while label[b] != b:
            b = label[b]
        if a != b:
            label[max(a, b)] = min(a, b)
            used[k] = True
    while (label[label] != label).any():
        label[:] = label[label]
    return used


def window_links(sorted_rows: DataFrame, window: int, cosine: float) -> DataFrame:
    """Links a-b among rows at most ``window`` places apart in their partition's order whose cosine is high enough.

    Only links that connect rows not yet connected in the same stretch are returned. Rows stream by; a task holds one
    Arrow batch and the ``window`` rows before it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for whole in batches:
            for batch in by_length(whole, "v"):
                x, node = unit(matrix(batch.column(3))), batch.column(2).to_numpy()
                group = batch.column(0).to_numpy() * (1 << 20) + batch.column(1).to_numpy()
                if x.shape[1] in held:
                    x, node, group = (np.concatenate(p) for p in zip(held[x.shape[1]], (x, node, group)))
                label = np.arange(len(x))
                a, b = [], []
                for k in range(1, min(window, len(x) - 1) + 1):
                    near = np.flatnonzero((np.einsum("ij,ij->i", x[k:], x[:-k]) >= cosine) & (group[k:] == group[:-k]))
                    if len(near):
                        near = near[_forest(label, near, near + k)]
                        a.append(node[near]), b.append(node[near + k])
                held[x.shape[1]] = (x[-window:], node[-window:], group[-window:])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in (a, b)], ["a", "b"])

    return sorted_rows.select("dim", "turn", "node", "v").mapInArrow(run, "a long, b long")


def _counted(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(node, n): rows linked to each node, within its component, copies counted.

    Exact without comparing all pairs: nodes are measured by their angle to the component's first vector. Where no
    angle exceeds half the linking angle, all are linked with one another. The other components are cut into blocks
    along that angle; pairs of blocks are compared in full, except those that the angles already decide.
    """
    limit = math.acos(cosine)
    first = members.groupBy("comp").agg(F.min("node").alias("node"))
    centre = first.join(members.select("node", F.col("v").alias("c")), "node").select("comp", "c")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    scaled = lambda v: F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    with_angle = members.join(centre, "comp").withColumns({"s": scaled(F.col("v")), "t": scaled(F.col("c"))})
    cos = dot(F.col("s"), F.col("t")) / F.sqrt(dot(F.col("s"), F.col("s")) * dot(F.col("t"), F.col("t")))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos)))
    measured = table(with_angle.withColumn("angle", angle).select("node", "comp", "copies", "v", "angle"))
    total = measured.groupBy("comp").agg(F.sum("copies").alias("rows"), F.count("*").alias("nodes"), F.max("angle").alias("widest"))
    tight = total.where(F.col("widest") <= limit / 2 - 1e-6)
    wide = total.where(F.col("widest") > limit / 2 - 1e-6)
    inside = measured.join(tight.select("comp", "rows"), "comp").select("node", (F.col("rows") - 1).cast("long").alias("n"))
    blocks = F.ceil(F.col("nodes") / block).cast("long")
    spread = measured.join(wide.select("comp", blocks.alias("blocks")), "comp").withColumn(
        "block", F.least(F.col("blocks") - 1, F.floor(F.col("angle") / math.pi * F.col("blocks")).cast("long")) * 64 + F.pmod(F.xxhash64("node"), F.least(F.col("blocks"), F.lit(64)))
    )
    spread = table(spread)
    ranges = spread.groupBy("comp", "block").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.sum("copies").alias("rows"))
    other = ranges.select("comp", *[F.col(c).alias(f"o_{c}") for c in ("block", "least", "most", "rows")])
    duels = ranges.join(other, "comp").where((F.col("least") - F.col("o_most") <= limit + 1e-6) & (F.col("o_least") - F.col("most") <= limit + 1e-6))
    sure = F.col("most") + F.col("o_most") <= limit - 1e-6
    given = duels.where(sure).groupBy("comp", "block").agg(F.sum("o_rows").alias("n"))
    given = spread.join(given, ["comp", "block"]).select("node", F.col("n").cast("long").alias("n"))
    duels = duels.where(~sure).select("comp", "block", "o_block")
    left = spread.join(duels, ["comp", "block"]).select("comp", "block", "o_block", "node", "copies", "v")
    right = spread.withColumnRenamed("block", "o_block").join(duels, ["comp", "o_block"]).select("comp", "block", "o_block", "node", "copies", "v")

    def compare(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (unit(np.array(p["v"].tolist(), np.float64)) for p in (a, b))
        copies = b["copies"].to_numpy()
        n = [int(((x[i : i + 512] @ y.T >= cosine) * copies).sum(axis=1)[k]) for i in range(0, len(x), 512) for k in range(len(x[i : i + 512]))]
        return pd.DataFrame({"node": a["node"], "n": n})

    keys = ["comp", "block", "o_block"]
    compared = left.groupBy(*keys).cogroup(renewed(right).groupBy(*keys)).applyInPandas(compare, "node long, n long")
    both = given.unionByName(compared).groupBy("node").agg((F.sum("n") - 1).cast("long").alias("n"))  # a row does not link to itself
    return inside.unionByName(both)


def near_duplicates(vectors: DataFrame, vector: str = "embedding", cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors``.

    Each pass gives every distinct vector a string of random projection signs, orders all vectors by it and compares
    each with its ``window`` successors; pairs with ``cosine`` or more (double precision) are united over the passes.
    Links inside a component that no window showed are counted too, so n_links is complete within components. Equal
    vectors are one node with its number of copies and are linked with each other.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing (n_links 0,
    component_id = vec_id, kept); vectors of different lengths do not link. A null vec_id counts as the largest.
    Repeated rows link with each other; an empty table gives no rows; other columns (labels too) are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    rows = rows.withColumn("ok", sound(rows, "v"))
    good = rows.where("ok").withColumn("digest", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).cast("binary")))
    nodes = table(
        good.groupBy("digest").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("v").alias("v")).withColumn("node", F.monotonically_increasing_id())
    )
    laid = table(hashed(nodes, passes, BITS, SEED))
    ordered = laid.repartitionByRange(shuffle_parts(spark), "dim", "turn", "hash", "node").sortWithinPartitions("dim", "turn", "hash", "node")
    comps = table(components(window_links(ordered, window, cosine), "a", "b"))
    members = nodes.join(comps, "node").select("node", "comp", "copies", "v")
    counts = _counted(members, cosine, BLOCK)
    named = nodes.drop("v", "bands").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = table(named.join(least, "comp").join(counts, "node", "left").select("digest", "component_id", F.coalesce("n", F.col("copies") - 1).alias("n_links")))
    kept = F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    linked = good.select("vec_id", "digest").join(named, "digest").select("vec_id", "n_links", "component_id", kept)
    alone = rows.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)
