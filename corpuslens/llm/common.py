"""Shared pieces of the training-data operators: tables in the shared folder, words, keys, components."""

from __future__ import annotations

import hashlib
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.session import shared_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def table(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet into the folder all executors share, and read back: a cut that survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, for a join or cogroup of two tables derived from one."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def boxed(docs: DataFrame, needed: list[str]):
    """(``docs`` with the ``needed`` columns and all others in one struct, a function that brings a result to the old columns).

    An operator's own columns cannot clash with what a table happens to carry along.
    """
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    own = {c.lower() for c in needed}
    others = [c for c in docs.columns if c.lower() not in own]
    rest = F.struct(*map(name, others)) if others else F.lit(None).cast("string")
    packed = docs.select(*[name(c) for c in docs.columns if c.lower() in own], rest.alias("_rest"))
    return packed, lambda df: df.select(*[name(c) if c.lower() in own else F.col("_rest").getField(c).alias(c) for c in docs.columns])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(col):
    """Number of words of a text, nulls have none; counted by the places where one begins."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def with_copy(df: DataFrame, keys: list[str], name: str = "_copy") -> DataFrame:
    """Numbers rows that agree in ``keys`` from 1, so that repeated rows stay apart. The rows of a number are alike."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(keys[0])).cast("long"))


# ---------------------------------------------------------------- words of Arrow text as numbers

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, p, np.uint64)]), dtype=np.uint64) for p in (_P, _P_INV))
    return _POWERS[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each row the number of words before it (one more entry than rows)."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, at)


#: Words of more bytes are hashed one by one: polynomials modulo 2**64 have known collisions among long words.
LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of a polynomial: no loop over words but the few long ones."""
    power, inverse = _powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
        out = mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    for k in np.flatnonzero(end - start > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words (len - k + 1 of them), across rows; the caller leaves out runs that cross a border."""
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = out * _Q + words[j : j + n]
        return mix64(out)


def slices(column: pa.Array, most: int = 1 << 22):
    """Row ranges of at most ``most`` bytes of text each; a longer row makes a range of its own."""
    lengths = np.diff(utf8(column)[1])
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): comp is the smallest node reachable. Alternates large-star and small-star steps.

    Every step is two aggregations by ``min`` (folded before the shuffle) and two joins; a node with very many
    links is a skewed join key that adaptive execution splits. Nothing is gathered per node or on the driver. Each
    round is written to the shared folder.
    """
    def distinct(df):
        return table(df.where("u <> v").distinct())

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = distinct(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = distinct(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")))
        if (after := state(now)) == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
