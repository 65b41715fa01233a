"""Near-duplicates by BagMinHash signatures of word shingles, bands and an exact check of multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import boxed, components, gram_hashes, mix64, renewed, slices, table, utf8, with_copy, word_bounds, word_hashes

#: Words of a shingle, the overlap that links, bands and rows: a pair at the threshold is met with probability 0.9999.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 32, 6
#: In buckets of more members than LARGE, those outside the largest component meet so many more leaders out of it.
LARGE, TURNS = 32, 2
#: Members of a bucket that are compared in one task, bytes of their texts at a time, shingles of a matrix.
BLOCK, PART, COLUMNS = 1024, 1 << 22, 4096

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def bags(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of a text column, ordered by row and hash.

    A text of fewer words than a shingle is one shingle of all its words; one without words has none.
    """
    data, at = utf8(column)
    start, end, first = word_bounds(data, at)
    words = word_hashes(data, start, end)
    n = np.diff(first)
    whole = gram_hashes(words, SHINGLE)
    grams = np.maximum(n - SHINGLE + 1, 0)
    row = np.repeat(np.arange(len(n)), grams)
    index = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first[:-1], grams)
    hashes = whole[index]
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(short):
        with np.errstate(over="ignore"):
            h = n[short].astype(np.uint64)
            for j in range(SHINGLE - 1):
                inside = j < n[short]
                h = np.where(inside, mix64(h * _C[0] + words[np.minimum(first[short] + j, len(words) - 1)]), h)
        row, hashes = np.concatenate([row, short]), np.concatenate([hashes, h])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    place = np.flatnonzero(new)
    return row[place], hashes[place], np.diff(np.append(place, len(row)))


def signatures(rows: int, row: np.ndarray, hashes: np.ndarray, count: np.ndarray, slots: int) -> np.ndarray:
    """(rows x slots) signature values; two rows agree in a slot with the probability of their weighted Jaccard overlap.

    Every shingle owns a Poisson process in time over the weight levels 1, 2, 3-4, 5-8, ... : dyadic ranges of levels
    with the range's width as rate. Each point has a slot and a level and counts for a row whose weight reaches that
    level; a slot takes the earliest point. Only points up to a time by which all slots are likely filled are made,
    about slots x log(slots) for a row instead of slots for each shingle; rows with an open slot go on to a later time.
    """
    least = np.full(rows * slots, np.inf)
    value = np.zeros(rows * slots, np.uint64)
    if not len(row):
        return value.reshape(rows, slots)
    top = np.zeros(len(count), np.int64)  # number of ranges above level 1
    while (grown := (np.int64(1) << top) < count).any():
        top[grown] += 1
    element = np.repeat(np.arange(len(row)), top + 1)
    scale = np.arange(len(element)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(scale > 0, np.int64(1) << np.maximum(scale - 1, 0), 0)
    width = np.where(scale > 0, low, 1)
    owner, weight = row[element], count[element]
    with np.errstate(over="ignore"):
        key = mix64(hashes[element] + scale.astype(np.uint64) * _C[1])
    total = np.bincount(row, weights=count, minlength=rows)
    until = slots * (np.log(slots) + 3.0) / np.maximum(total, 1)
    todo = np.zeros(rows, bool)
    todo[row] = True
    while todo.any():
        alive = np.flatnonzero(todo[owner])
        time, turn = np.zeros(len(alive)), 0
        cells, times, values = [], [], []
        while len(alive):
            turn += 1
            with np.errstate(over="ignore"):
                k = key[alive] + np.uint64(turn) * _C[0]
                a, b = mix64(k), mix64(k ^ _C[2])
                time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[alive]
                stays = time <= until[owner[alive]]
                alive, time, a, b = alive[stays], time[stays], a[stays], b[stays]
                level = low[alive] + 1 + ((b >> np.uint64(32)) % width[alive].astype(np.uint64)).astype(np.int64)
                counts = level <= weight[alive]
                cells.append((owner[alive] * slots + ((b & np.uint64(0xFFFFFFFF)) % np.uint64(slots)).astype(np.int64))[counts])
                times.append(time[counts])
                values.append(mix64(a ^ _C[3])[counts])
        cell, at, val = np.concatenate(cells), np.concatenate(times), np.concatenate(values)
        np.minimum.at(least, cell, at)
        first = at == least[cell]
        value[cell[first]] = val[first]
        todo &= np.isinf(least.reshape(rows, slots)).any(axis=1)
        until[todo] *= 2
    return value.reshape(rows, slots)


def band_keys(values: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """(rows x bands) keys: a band's number and its values."""
    with np.errstate(over="ignore"):
        out = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(values), bands)).copy()
        for j in range(per_band):
            out = mix64(out * _C[0] + values.reshape(len(values), bands, per_band)[:, :, j])
    return out.view(np.int64)


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard overlap of the shingle multisets of two text columns, row by row; 0 where either has none."""
    rows = len(a)
    sides = [bags(a), bags(b)]
    row, hashes, count = (np.concatenate([s[i] for s in sides]) for i in range(3))
    order = np.lexsort((hashes, row))
    row, hashes, count = row[order], hashes[order], count[order]
    both = np.flatnonzero((row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1]))
    common = np.bincount(row[both], weights=np.minimum(count[both], count[both + 1]), minlength=rows)
    total = np.bincount(row, weights=count, minlength=rows)
    return np.divide(common, total - common, out=np.zeros(rows), where=total > common)


def sign(docs: DataFrame, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """doc_id, digest of the text and its band keys (none where there are no words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, texts = batch.columns
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                row, hashes, count = bags(part)
                values = signatures(j - i, row, hashes, count, bands * per_band)
                keys = band_keys(values, bands, per_band)
                has = np.zeros(j - i, bool)
                has[row] = True
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, keys[has].ravel())
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), digests.slice(i, j - i), lists], ["doc_id", "digest", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, digest string, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose texts overlap by ``threshold`` or more. A hot node is a skewed join key only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text_a, text_b = batch.columns
            for i, j in slices(text_a):
                links = pa.array(overlap(text_a.slice(i, j - i), text_b.slice(i, j - i)) >= threshold)
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i).filter(links) for c in (a, b)], ["a", "b"])

    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """``comps`` after the links a-b of ``found`` have joined some of its components."""
    by = comps.select(F.col("node").alias("a"), F.col("comp").alias("comp_a")), comps.select(F.col("node").alias("b"), F.col("comp").alias("comp_b"))
    found = table(found.join(by[0], "a", "left").join(by[1], "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")))
    joined = table(components(found, "a", "b"))
    moved = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("into")), "comp", "left").select("node", F.coalesce("into", "comp").alias("comp"))
    return table(moved.unionByName(joined.join(comps.select("node"), "node", "left_anti").select("node", "comp")))


def _open(live: DataFrame) -> DataFrame:
    """Buckets with members of several components: the largest one, members outside it, all members."""
    sizes = live.groupBy("key", "comp").agg(F.count("*").alias("n"))
    return sizes.groupBy("key").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("n").alias("all"), F.count("*").alias("comps")
    ).where("comps > 1")


def elements(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, element, elements of each row): a row's shingles, one that occurs n times as n different elements.

    The overlap of two multisets is the overlap of their sets of elements.
    """
    row, hashes, count = bags(column)
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        element = mix64(np.repeat(hashes, count) + turn.astype(np.uint64) * _C[1])
    row = np.repeat(row, count)
    return row, element, np.bincount(row, minlength=len(column))


def shared_elements(a: tuple, b: tuple) -> np.ndarray:
    """(rows of a x rows of b) numbers of common elements, by products of 0/1 matrices over the elements both sides have."""
    common = np.intersect1d(a[1], b[1])
    both = np.zeros((len(a[2]), len(b[2])), np.float32)  # whole numbers, far below what a float holds exactly
    sides = []
    for row, element, _ in (a, b):
        at = np.minimum(np.searchsorted(common, element), max(len(common) - 1, 0))
        own = common[at] == element if len(common) else np.zeros(len(element), bool)
        order = np.argsort(at[own], kind="stable")
        sides.append((row[own][order], at[own][order]))
    for begin in range(0, len(common), COLUMNS):
        parts = []
        for (row, at), n in zip(sides, both.shape):
            i, j = np.searchsorted(at, (begin, begin + COLUMNS))
            part = np.zeros((n, COLUMNS), np.float32)
            part[row[i:j], at[i:j] - begin] = 1
            parts.append(part)
        both += parts[0] @ parts[1].T
    return both


def _links_inside(live: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links a-b between different components of a bucket: its members outside the largest component against all others.

    Both sides are cut into blocks of bounded size. A task counts the common shingles of all pairs of two blocks at
    once and returns only links that join components, so a block returns fewer links than it has members.
    """
    open_ = _open(live)
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    members = live.join(open_.select("key", "main", blocks("outside").alias("n_out"), blocks("all").alias("n_all")), "key").join(texts, "node")
    members = table(members.withColumn("outside", F.col("comp") != F.col("main")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    names = ["key", "i", "j", "node", "comp", "outside", "text"]
    left = members.where("outside").withColumn("i", own("n_out")).withColumn("j", every("n_all")).select(*names)
    right = members.withColumn("j", own("n_all")).withColumn("i", every("n_out")).select(*names)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 2]
        if a.num_rows and b.num_rows:
            node = [t.column("node").to_numpy() for t in (a, b)]
            names, label = np.unique(np.concatenate([t.column("comp").to_numpy() for t in (a, b)]), return_inverse=True)
            into = np.arange(len(names))  # components that links found here have joined
            comp = label[: a.num_rows], label[a.num_rows :]
            parts = [[(i, j, elements(t.column("text").combine_chunks().slice(i, j - i))) for i, j in slices(t.column("text").combine_chunks(), PART)] for t in (a, b)]
            for i, _, x in parts[0]:
                for j, _, y in parts[1]:
                    common = shared_elements(x, y).astype(np.float64)
                    total = x[2][:, None] + y[2][None, :] - common
                    p, q = np.nonzero((common > 0) & (np.divide(common, total, out=common, where=total > 0) >= threshold))
                    p, q = p + i, q + j
                    for k in np.flatnonzero(into[comp[0][p]] != into[comp[1][q]]):
                        u, v = into[comp[0][p[k]]], into[comp[1][q[k]]]
                        if u != v:
                            into[into == max(u, v)] = min(u, v)
                            found.append((node[0][p[k : k + 1]], node[1][q[k : k + 1]]))
        return pa.table({k: pa.array(np.concatenate([f[n] for f in found]), pa.int64()) for n, k in enumerate("ab")})

    keys = ["key", "i", "j"]
    return left.groupBy(*keys).cogroup(renewed(right).groupBy(*keys)).applyInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """doc_id, digest, class_id and kept of each row of ``docs``: one class for texts linked directly or through others.

    Texts link when the multisets of their five-word shingles overlap by ``threshold`` or more (sum of the smaller
    counts by sum of the larger); equal texts are one node. class_id is the smallest doc_id of the class. ``kept``
    marks the row with that id (of repeated rows with the id each one; see ``kept_documents``). Null texts and texts
    without words are classes of their own, class_id = doc_id, kept. A null doc_id counts as the largest. Extra
    columns are not read; an empty table gives no rows.

    Band buckets are never expanded into all pairs. First the members of a bucket are compared with one of them, picked
    by hash, and links are closed to components; in large buckets the members outside the largest component then meet
    TURNS further members of it. What is still open in a bucket has a member outside its largest component: those
    members are compared with all others, in blocks of bounded size: a task counts the common shingles of all pairs of
    two blocks exactly and returns only links that join components.
    """
    signed = table(sign(docs, bands, per_band))
    nodes = table(
        signed.where(F.size("bands") > 0).groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())  # written once, so ids stay
    )
    met = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = met.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    live = table(met.join(buckets.select("key"), "key"))
    wanted = live.select("node").distinct().join(nodes.select("node", "digest", "first_id"), "node")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    texts = table(
        source.join(wanted, (source["digest"] == wanted["digest"]) & source["doc_id"].eqNullSafe(wanted["first_id"]))
        .groupBy("node").agg(F.any_value("text").alias("text"))
    )
    lead = live.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("a"))
    pairs = live.join(lead, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    comps = table(components(verified(pairs, texts, threshold), "a", "b"))
    named_ = lambda df: table(df.join(comps, "node", "left").select("key", "band", "node", F.coalesce("comp", "node").alias("comp")))
    live = named_(live)
    for turn in range(TURNS):
        open_ = _open(live).where(F.col("all") > LARGE).select("key", "main")
        members = table(live.join(open_, "key"))
        if members.isEmpty():
            break
        lead = members.where("comp = main").groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("a"))
        pairs = members.where("comp <> main").join(lead, "key").select("a", F.col("node").alias("b")).distinct()
        comps = _merged(comps, verified(pairs, texts, threshold))
        live = named_(live.drop("comp"))
    comps = _merged(comps, _links_inside(live, texts, threshold))
    named = nodes.select("node", "digest", "first_id")
    named = named.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    order = F.struct(F.col("first_id").isNull().alias("last"), "first_id", "digest")
    best = named.groupBy("comp").agg(F.min(order).alias("best"))
    named = named.join(best, "comp").select("digest", F.col("best.first_id").alias("class_id"), F.col("best.digest").alias("best_digest"))
    with_words, without = signed.where(F.size("bands") > 0), signed.where(F.size("bands") == 0)
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("best_digest"))
    return with_words.join(named, "digest").select("doc_id", "digest", "class_id", kept.alias("kept")).unionByName(
        without.select("doc_id", "digest", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: its smallest doc_id, of repeated rows the first. Nulls and empty texts stay."""
    docs, unboxed = boxed(docs, ["doc_id", "text"])
    kept = classes(docs).where(F.col("kept") & F.col("digest").isNotNull()).select(F.col("doc_id").alias("_kid"), F.col("digest").alias("_kd")).distinct()
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_digest": F.md5(F.col("text").cast("binary"))})
    rows = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_digest") == F.col("_kd")), "left_semi")
    return unboxed(with_copy(rows, ["_id", "_digest"]).where("_copy = 1").select(*docs.columns).unionByName(docs.where(F.col("text").isNull())))
