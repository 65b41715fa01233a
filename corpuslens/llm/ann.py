"""Nearest neighbours by randomly rotated one-bit codes with error bounds and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import renewed, table
from corpuslens.llm.vectors import by_length, matrix, sound, unit

#: Neighbours, rows of a block of the index and of a block of queries, and the width of the error bound in standard
#: deviations of the estimate (three: about one true neighbour in a thousand is missed).
NEAREST, INDEX_BLOCK, QUERY_BLOCK, WIDTH = 5, 8192, 4096, 3.0
SEED = 13


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed + d).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of the rotated unit vectors and the inner product of each with its code."""
    turned = unit(x) @ rotation(x.shape[1])
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def estimate(codes: np.ndarray, scale: np.ndarray, queries: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """(queries x rows) estimated cosines, and for each row how far an estimate may be off.

    A code c holds o's signs: <c, q> / <c, o> estimates <o, q> without bias; what c has beside o is a random
    direction for q, so the error falls with the square root of the dimension.
    """
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    guess = (unit(queries) @ rotation(d)).astype(np.float32) @ signs.T / np.float32(np.sqrt(d))
    return guess / scale.astype(np.float32), width * np.sqrt(np.maximum(0, 1 - scale**2)) / scale / np.sqrt(max(1, d - 1))


def index(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """row, vec_id, dim, code, scale, v of every row that takes part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & sound(vectors, vector))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_length(whole, "v"):
                x = matrix(batch.column(1))
                codes, scale = encode(x)
                dim = pa.array(np.full(len(x), x.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), dim, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), batch.column(1)], ["vec_id", "dim", "code", "scale", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    coded = rows.mapInArrow(run, f"vec_id long, dim long, code binary, scale double, v {kind}")
    return table(coded.withColumn("row", F.monotonically_increasing_id()))


def _best(query: pa.Table, block: pa.Table, nearest: int, width: float) -> pa.Table:
    """The nearest rows of one block for each query of another: estimates choose, exact cosines decide."""
    names = ["query", "query_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    if not query.num_rows or not block.num_rows:
        return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
    q, x = unit(matrix(query.column("v"))), unit(matrix(block.column("v")))
    codes = np.frombuffer(b"".join(block.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
    scale = block.column("scale").to_numpy()
    rows, ids = block.column("row").to_numpy(), block.column("vec_id").to_numpy()
    own, q_ids = query.column("row").to_numpy(), query.column("query_id").to_numpy()
    out = []
    for i in range(0, len(q), 256):
        part = q[i : i + 256]
        guess, error = estimate(codes, scale, part, width)
        itself = own[i : i + 256, None] == rows[None, :]
        guess[itself] = -np.inf
        k = min(nearest, len(x))
        first = np.argpartition(-guess, k - 1, axis=1)[:, :k]
        exact = (part[:, None, :] * x[first]).sum(axis=2)
        exact[np.take_along_axis(itself, first, 1)] = -np.inf
        bar = exact.min(axis=1)  # the block has at least k rows as near as this
        a, b = np.nonzero((guess + error.astype(np.float32) >= bar[:, None] - 1e-6) & ~itself)
        for s in range(0, len(a), 1 << 16):
            aa, bb = a[s : s + (1 << 16)], b[s : s + (1 << 16)]
            out.append((aa + i, bb, (part[aa] * x[bb]).sum(axis=1)))
    a, b, score = (np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    a, b, score = (y[place < nearest] for y in (a, b, score))
    return pa.Table.from_arrays([pa.array(y, t) for y, t in zip((own[a], q_ids[a], ids[b], score), kinds)], names)


def search(vectors: DataFrame, queries, vector: str = "embedding", nearest: int = NEAREST, width: float = WIDTH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``nearest`` rows by cosine of each row for which ``queries`` holds.

    ``queries`` is a condition on vec_id. Every row but the query's own is a candidate; fewer rows give fewer
    neighbours. Scores are cosines of the original vectors in double precision, ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows without a vec_id, take no part;
    vectors of other lengths are no candidates. Repeated rows are rows of their own; an empty table gives no rows.

    Index rows and queries are dealt to blocks of bounded size by hash; each pair of blocks is one small task that
    returns at most ``nearest`` rows for a query, so equal vectors, however many, stay within their blocks.
    """
    rows = index(vectors, vector)
    asked = rows.where(queries).select("row", F.col("vec_id").alias("query_id"), "dim", "v")
    counts = rows.agg(F.count("*"), F.count(F.when(queries, 1))).first()
    blocks, query_blocks = (max(1, -(-n // size)) for n, size in zip(counts, (INDEX_BLOCK, QUERY_BLOCK)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("qb", F.pmod(F.xxhash64("row"), F.lit(query_blocks)).cast("int")).withColumn("ib", each(blocks))
    right = rows.withColumn("ib", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")).withColumn("qb", each(query_blocks))
    keys = ["dim", "qb", "ib"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return _best(a, b, nearest, width)

    found = left.groupBy(*keys).cogroup(renewed(right).groupBy(*keys)).applyInArrow(run, "query long, query_id long, vec_id long, score double")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
