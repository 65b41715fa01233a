"""Best-fit packing with conflicts between documents of one source or one cluster of duplicates."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import n_words, with_copy

#: Words a bin holds, pieces of one source that a bin takes, words that a packing group gets on average.
CAPACITY, PER_SOURCE, GROUP_WORDS = 2048, 4, 1 << 22


class Bins:
    """Open bins ordered by residual; a bin carries bitmaps of its sources (one for each level) and of its clusters."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.open: list[tuple[int, int]] = []  # (residual, bin), ascending
        self.sources: list[list[int]] = []
        self.clusters: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """(bin, offset): the tightest bin with room that takes the piece; the search goes on to the next larger residual."""
        i = bisect_left(self.open, (size, -1))
        while i < len(self.open):
            residual, b = self.open[i]
            if not self.sources[b][-1] & source and not self.clusters[b] & cluster:
                del self.open[i]
                break
            i += 1
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        for level, bits in enumerate(self.sources[b]):
            if not bits & source:
                self.sources[b][level] |= source
                break
        self.clusters[b] |= cluster
        if residual > size:
            insort(self.open, (residual - size, b))
        return b, self.capacity - residual


def pack_group(sizes, sources, clusters, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """Places pieces in the order given. Sources and clusters get a bit each; a cluster met once needs none."""
    bit_of, count = {}, {}
    for c in clusters:
        count[c] = count.get(c, 0) + 1
    several = {c: i for i, c in enumerate(c for c, n in count.items() if n > 1)}
    bins, out = Bins(capacity, per_source), []
    for size, source, cluster in zip(sizes, sources, clusters):
        s = bit_of.setdefault(source, 1 << len(bit_of))
        out.append(bins.add(size, s, 1 << several[cluster] if cluster in several else 0))
    return out


def pieces_of(docs: DataFrame, capacity: int) -> DataFrame:
    """Documents cut into pieces of at most ``capacity`` words: doc_id, digest, source, copy, piece, start, size."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), F.col("source").cast("string").alias("source"),
        n_words(F.col("text")).alias("words"),
    )
    rows = with_copy(rows, ["doc_id", "digest", "source"], "copy")
    last = F.greatest(((F.col("words") - 1) / capacity).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    start = F.col("piece") * capacity
    return rows.select("doc_id", "digest", "source", "copy", "piece", start.alias("start"), F.least(F.col("words") - start, F.lit(capacity)).cast("long").alias("size"))


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, group_words: int = GROUP_WORDS) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, digest, source, copy, piece, start, size, bin_id, offset.

    A text over ``capacity`` words is cut into full pieces and a rest. Pieces go to packing groups by a hash of their
    key, about ``group_words`` words each whatever the sources are, so no group grows with the table; each group is
    packed by itself, largest pieces first. A bin holds no two pieces of one cluster of equal texts and at most
    ``per_source`` pieces of one source; a null source is a source of its own. Null and empty texts are one piece of
    size 0 (offset where it was put). Repeated rows are packed each. An empty table gives no rows.
    """
    pieces = pieces_of(docs, capacity)
    total = docs.agg(F.sum(n_words(F.col("text"))), F.count("*")).first()
    groups = max(1, -(-max(total[0] or 0, 64 * total[1]) // group_words))
    keyed = pieces.withColumn("pack", F.pmod(F.xxhash64("doc_id", "digest", "copy", "piece"), F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "digest", "source", "copy", "piece"], ascending=[False, True, True, True, True, True], kind="stable")
        placed = pack_group(rows["size"].tolist(), rows["source"].tolist(), rows["digest"].tolist(), capacity, per_source)
        bins = [b for b, _ in placed]
        return rows.assign(bin_id=[f"{key[0]}-{b}" for b in bins], offset=[o for _, o in placed])[
            ["doc_id", "digest", "source", "copy", "piece", "start", "size", "bin_id", "offset"]
        ]

    return keyed.groupBy("pack").applyInPandas(
        run, "doc_id long, digest string, source string, copy long, piece long, start long, size long, bin_id string, offset long"
    )


def packed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, piece, start, size, bin_id and offset of each piece."""
    return pack(docs, **options).select("doc_id", "source", "piece", "start", "size", "bin_id", "offset")


def packed_texts(docs: DataFrame, **options) -> DataFrame:
    """``packed`` with the words of each piece as text (words joined by a blank; a text of one piece stays as it is)."""
    placed = pack(docs, **options)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_digest"), F.col("source").cast("string").alias("_source"), "text"
    )
    keyed = with_copy(keyed, ["_id", "_digest", "_source"], "_copy")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_digest") == F.col("digest")) & F.col("_source").eqNullSafe(F.col("source")) & (F.col("_copy") == F.col("copy"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    text = F.when((F.col("start") == 0) & (F.size("_words") == F.col("size")), F.col("text")).otherwise(
        F.array_join(F.slice("_words", (F.col("start") + 1).cast("int"), F.col("size").cast("int")), " ")
    )
    return keyed.join(placed, same).withColumn("_words", words).select("doc_id", "source", "piece", "start", "size", "bin_id", "offset", text.alias("text"))
