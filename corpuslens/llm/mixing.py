"""Mixing sources to target weights over fixed-length blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.ordering import global_positions
from corpuslens.llm.common import boxed, mix64, n_words, shuffle_parts, table, with_copy

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
BLOCK = 512
SHARDS = 64
SEED = 7


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Shares ``share`` x all sizes by weight; a target stops at ``most`` x its size, the excess is shared again."""
    total, capped = share * sum(sizes), [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, c in zip(sizes, capped) if c)
        weight = sum(w for w, c in zip(weights, capped) if not c)
        level = left / weight if weight else 0.0
        over = [not c and w * level > most * s for s, w, c in zip(sizes, weights, capped)]
        if not any(over):
            return [most * s if c else w * level for s, w, c in zip(sizes, weights, capped)]
        capped = [c or o for c, o in zip(capped, over)]


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom bijection of range(size) for each key: four Feistel rounds, walked until the value is in range."""
    index, key = index.astype(np.uint64), key.astype(np.uint64)
    half = np.array([max(1, (int(s - 1).bit_length() + 1) // 2) for s in np.unique(size)], np.uint64)
    half = half[np.searchsorted(np.unique(size), size)]
    low = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.copy(), np.arange(len(index))
    while len(left):
        x, h, m, k = out[left], half[left], low[left], key[left]
        a, b = x >> h, x & m
        with np.errstate(over="ignore"):
            for turn in range(4):
                a, b = b, (a ^ (mix64(b + k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) & m)) & m
        out[left] = (a << h) | b
        left = left[out[left] >= size[left].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass
class Plan:
    """What the mix draws: for each source (by index) its words, target, blocks and slots; shards x sources counts."""

    size: np.ndarray
    target: np.ndarray
    blocks: np.ndarray
    goal: np.ndarray
    slots: np.ndarray
    counts: np.ndarray
    block: int
    seed: int


def _key(seed: int, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(np.asarray(source, np.uint64) * np.uint64(1 << 20) + np.asarray(turn, np.uint64) + np.uint64(seed) * np.uint64(0xA24BAED4963EE407))


def _held(plan: "Plan", source: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block of each slot of a source, the words it holds, and the words of the source's earlier slots."""
    blocks = plan.blocks[source]
    turn, inside = slot // blocks, slot % blocks
    at = permute(inside, blocks, _key(plan.seed, source, turn))
    short = plan.block * blocks - plan.size[source]  # what the last block lacks
    words = np.where(at == blocks - 1, plan.block - short, plan.block)
    return at, words, turn


def _slots(plan: "Plan", s: int) -> int:
    """Smallest number of slots of source s whose words reach its goal."""
    if not plan.goal[s]:
        return 0
    blocks, size, goal = int(plan.blocks[s]), int(plan.size[s]), int(plan.goal[s])
    turns, rest = divmod(goal - 1, size)  # full passes before the last; rest + 1 words are still wanted
    lower = -(-(rest + 1) // plan.block)
    short = plan.block * blocks - size
    place = _last_place(plan, s, turns)
    got = lower * plan.block - (short if place < lower else 0)
    return turns * blocks + lower + (got < rest + 1)


def _last_place(plan: "Plan", s: int, turn: int) -> int:
    """Where a pass over source s comes to its last, shorter block: found by walking the permutation backwards."""
    blocks = int(plan.blocks[s])
    half = max(1, ((blocks - 1).bit_length() + 1) // 2)
    low, key = (1 << half) - 1, int(_key(plan.seed, np.array([s]), np.array([turn]))[0])
    x = blocks - 1
    while True:
        a, b = x >> half, x & low
        for k in (4, 3, 2, 1):
            mixed = int(mix64(np.array([(a + key * 0x9E3779B97F4A7C15 + k) & ((1 << 64) - 1)], np.uint64))[0])
            a, b = (b ^ (mixed & low)) & low, a
        x = (a << half) | b
        if x < blocks:
            return x


def plan_mix(sizes: list[int], block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> Plan:
    """Draws, for each output shard, how many slots each source gets: a multinomial over what the sources still owe.

    A shard's draw is by the shares of the slots that are left; what a draw takes beyond a source's rest is drawn
    again, and the last shard takes what remains, so the totals are exact and the shards are random.
    """
    size = np.array(sizes, np.int64)
    target = np.array(targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))]))
    plan = Plan(size, target, -(-size // block), np.floor(target + 0.5).astype(np.int64), np.zeros(len(size), np.int64), np.zeros((0, len(size)), np.int64), block, seed)
    plan.slots = np.array([_slots(plan, s) for s in range(len(size))], np.int64)
    rng, left, counts = np.random.default_rng(seed), plan.slots.copy(), []
    for j in range(shards):
        want, got = int(left.sum()) // (shards - j), np.zeros(len(size), np.int64)
        while want:
            open_ = left - got
            drawn = np.minimum(rng.multinomial(want, open_ / open_.sum()), open_)
            got += drawn
            want -= int(drawn.sum())
        left -= got
        counts.append(got)
    plan.counts = np.array(counts).reshape(shards, len(size))
    return plan


def picks(spark, plan: Plan) -> DataFrame:
    """One row per output slot: shard, source index, block, turn (pass over the source) and the words taken from the block's start."""
    ends = np.cumsum(plan.counts.ravel())
    before = np.cumsum(plan.counts, axis=0) - plan.counts  # slots of the source in earlier shards
    total = int(ends[-1]) if len(ends) else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sources = len(plan.size)
        for batch in batches:
            ids = batch["id"].to_numpy()
            cell = np.searchsorted(ends, ids, side="right")
            shard, source = cell // sources, cell % sources
            slot = ids - (ends[cell] - plan.counts.ravel()[cell]) + before[shard, source]
            at, words, turn = _held(plan, source, slot)
            last = slot == plan.slots[source] - 1
            if last.any():  # the last slot of a source gives only what its goal still lacks
                for i in np.flatnonzero(last):
                    s, k = int(source[i]), int(slot[i])
                    turns, inside = divmod(k, int(plan.blocks[s]))
                    short = plan.block * int(plan.blocks[s]) - int(plan.size[s])
                    done = turns * int(plan.size[s]) + inside * plan.block - (short if _last_place(plan, s, turns) < inside else 0)
                    words[i] = min(words[i], int(plan.goal[s]) - done)
            yield pd.DataFrame({"shard": shard, "source_ix": source, "block": at, "turn": turn, "words": words})

    parts = max(1, min(shuffle_parts(spark), -(-total // 4096)))
    return spark.range(0, total, 1, parts).mapInPandas(run, "shard long, source_ix long, block long, turn long, words long")


def mix(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED):
    """(plan, documents, pieces) of a mix of all ``docs``.

    documents: one row per row of ``docs`` with doc_id, digest (of the text), source, copy (apart rows that agree in
    these three), size in words, source_ix, ``first`` (words of its source before it) and the source's size and target.
    pieces: the runs of a document's words that the mix takes: the document's key, shard, turn, ``from`` and ``to``
    (words, end exclusive). Sources are ordered by code point, null last. Null and empty texts have no words and no
    pieces. Repeated rows are mixed each. An empty table gives empty results. One row per source comes to the driver,
    where the draws of all shards are made; documents are laid out by range, so a source of any size is spread.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "source", n_words(F.col("text")).alias("size")
    )
    rows = table(with_copy(rows, ["doc_id", "digest", "source"], "copy").withColumn("size", F.col("size")))
    found = rows.groupBy("source").agg(F.sum("size").alias("n")).collect()
    order = sorted(found, key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8")))  # UTF-8 sorts like code points
    plan = plan_mix([int(r[1]) for r in order], block, shards, seed)
    listed = spark.createDataFrame(
        [(r[0], i, int(r[1]), float(plan.target[i])) for i, r in enumerate(order)], "source string, source_ix long, source_size long, target double"
    )
    rows = rows.join(listed.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    laid = global_positions(
        rows.withColumn("key", F.struct("doc_id", "digest", "copy", "source", "source_size", "target")), ["source_ix"], ["key"], ["size"]
    )
    documents = table(laid.select("key.*", "source_ix", "size", F.col("size_before").alias("first")))
    spans = documents.where("size > 0").select(
        "doc_id", "digest", "source", "copy", "source_ix", "first", "size",
        F.explode(F.sequence((F.col("first") / block).cast("long"), ((F.col("first") + F.col("size") - 1) / block).cast("long"))).alias("block"),
    )
    start = F.greatest(F.col("first"), F.col("block") * block) - F.col("first")
    end = F.least(F.col("first") + F.col("size"), F.col("block") * block + F.col("words")) - F.col("first")
    pieces = spans.join(picks(spark, plan), ["source_ix", "block"]).select(
        "doc_id", "digest", "source", "copy", "shard", "turn", start.alias("from"), end.alias("to")
    ).where(F.col("to") > F.col("from"))
    return plan, documents, pieces


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words the mix takes of each document, repeats counted."""
    _, documents, pieces = mix(docs)
    keys = ["doc_id", "digest", "source", "copy"]
    zero = documents.select(*keys, "size", "source_size", "target", F.lit(0).cast("long").alias("n"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("source_size", "long"), ("target", "double"))]
    both = zero.unionByName(pieces.select(*keys, *none, (F.col("to") - F.col("from")).alias("n")))
    sums = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target")], F.sum("n").alias("taken"))
    return sums.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` after the mix: for each pass over its source one row with the words taken, in order, joined by a blank.

    A text that is taken whole stays as it is. Documents of which nothing is taken are left out; n_chars follows the
    text, all other columns stay.
    """
    _, documents, pieces = mix(docs)
    keys = ["doc_id", "digest", "source", "copy"]
    runs = pieces.groupBy(*keys, "turn").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))  # a turn has each block once
    names = docs.columns
    docs, unboxed = boxed(docs, ["doc_id", "text", "source", "n_chars"])
    keyed = with_copy(
        docs.withColumns({"_id": F.col("doc_id").cast("long"), "_digest": F.md5(F.coalesce("text", F.lit("")).cast("binary"))}), ["_id", "_digest", "source"], "_copy"
    )
    runs = runs.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("source").alias("r_source"), F.col("copy").alias("r_copy"), "turn", "runs")
    same = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_digest") == F.col("r_digest")) & F.col("source").eqNullSafe(F.col("r_source")) & (F.col("_copy") == F.col("r_copy"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("runs", lambda r: F.slice("_words", (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int")))), " ")
    covered = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["to"] - r["from"])
    out = keyed.join(runs, same).withColumn("_words", words).withColumn("text", F.when(covered == F.size("_words"), F.col("text")).otherwise(cut))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return unboxed(out)
