"""Removal of repeated passages: fixed-block anchors, extended to maximal exact repeats."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import gram_hashes, slices, utf8, word_bounds, word_hashes

#: Words of a window that counts as a repeat. A block is as long as it may be so that every window holds a whole one.
WINDOW = 13
#: Bytes of text in a chunk of documents and words in a bucket of hashes, for inputs up to a terabyte; both grow with
#: the square root beyond, so that a chunk's share of a bucket does not shrink to single hashes.
CHUNK_BYTES, BUCKET_WORDS, STEADY_BYTES = 1 << 22, 1 << 21, 1 << 40
#: Stands for a null doc_id, which counts as the largest.
NO_ID = np.iinfo(np.int64).max


class Chunk:
    """Documents of a chunk ordered by doc_id: their words as hashes, and where each document's words begin."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows.take(pa.array(order)), ids[order]
        texts = self.rows.column("text").combine_chunks()
        words, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in slices(texts):
            data, at = utf8(texts.slice(i, j - i))
            start, end, first = word_bounds(data, at)
            words.append(word_hashes(data, start, end))
            counts.append(np.diff(first))
        self.words, self.count = np.concatenate(words), np.concatenate(counts)
        self.first = np.cumsum(self.count) - self.count

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, place of the first word) of each run of k words inside a document."""
        n = np.maximum(self.count - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first, n)
        return gram_hashes(self.words, k)[place], doc, place


def _fold(hashes: np.ndarray, *columns: tuple[np.ndarray, np.ufunc]) -> tuple[np.ndarray, ...]:
    """Distinct hashes and, for each (values, ufunc), the values of a hash folded into one."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[begin], *[f.reduceat(v[order], begin) if len(begin) else v for v, f in columns]


def _buckets(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def _rows(found: list[tuple[int, int, bytes]], names: tuple[str, str, str]) -> pa.Table:
    a, b, c = zip(*found) if found else ((), (), ())
    return pa.table({names[0]: pa.array(a, pa.int64()), names[1]: pa.array(b, pa.int64()), names[2]: pa.array(c, pa.binary())})


def _pack(*arrays: np.ndarray) -> bytes:
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(blob, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(blob, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _split(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash and the 32 bits that tell it from others there."""
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def anchors(chunk: Chunk, number: int, block: int, buckets: int) -> pa.Table:
    """What a chunk says about its runs of ``block`` words, bucket by bucket.

    Index: of the runs that are blocks of their document (each ``block`` words, not overlapping) the smallest
    document; probes: of all runs the largest document. A hash is named once or twice for a chunk, however often it
    occurs. Documents are told by runs over the chunk's ids, hashes by 32 bits beside the bucket.
    """
    hashes, doc, place = chunk.windows(block)
    aligned = (place - chunk.first[doc]) % block == 0
    hashes, low, high = _fold(hashes, (np.where(aligned, doc, len(chunk.ids)), np.minimum), (doc, np.maximum))
    reference = low < len(chunk.ids)
    probe = ~reference | (high > low)
    bucket, bits = _split(np.concatenate([hashes[reference], hashes[probe]]), buckets)
    owner = np.concatenate([low[reference], high[probe]])
    kind = np.repeat([0, 1], [reference.sum(), probe.sum()])
    out = []
    for b, at in _buckets(bucket, buckets):
        at = at[np.lexsort((owner[at], kind[at]))]
        docs, inverse = np.unique(owner[at], return_inverse=True)
        cuts = [np.bincount(inverse[kind[at] == k], minlength=len(docs)).astype(np.uint32) for k in (0, 1)]
        out.append((b, number, _pack(bits[at], *cuts, chunk.ids[docs])))
    return _rows(out, ("bucket", "chunk", "said"))


def met(bucket: pa.Table) -> pa.Table:
    """Tells each chunk which of its hashes are a block of some document and occur in a larger one."""
    hashes, ids, index, chunk = [], [], [], []
    numbers = bucket.column("chunk").to_numpy()
    for i, blob in enumerate(bucket.column("said").to_pylist()):
        bits, references, probes, known = _unpack(blob, np.uint32, np.uint32, np.uint32, np.int64)
        hashes.append(bits)
        ids.append(np.concatenate([np.repeat(known, references), np.repeat(known, probes)]))
        index.append(np.arange(len(bits)) < references.sum())
        chunk.append(np.full(len(bits), i, np.int32))
    hashes, ids, index, chunk = (np.concatenate(x) for x in (hashes, ids, index, chunk))
    kinds, least, most = _fold(hashes, (np.where(index, ids, NO_ID), np.minimum), (ids, np.maximum))
    live = np.isin(hashes, kinds[least < most])
    hashes, chunk = hashes[live], chunk[live]
    number = bucket.column("bucket")[0].as_py()
    return _rows([(int(numbers[i]), number, np.unique(hashes[at]).tobytes()) for i, at in _buckets(chunk, len(numbers))], ("chunk", "bucket", "heard"))


def repeats(chunk: Chunk, heard: pa.Table, number: int, block: int, window: int, buckets: int) -> pa.Table:
    """Windows that hold an anchor, by hash of all their words: smallest and largest document of the chunk."""
    known = [np.zeros(0, np.uint64)]
    for b, blob in zip(heard.column("bucket").to_pylist(), heard.column("heard").to_pylist()):
        known.append((np.uint64(b) << np.uint64(32)) | np.frombuffer(blob, np.uint32).astype(np.uint64))
    known = np.sort(np.concatenate(known))
    hashes, _, place = chunk.windows(block)
    bucket, bits = _split(hashes, buckets)
    anchor = np.zeros(len(chunk.words) + 1, np.int64)
    anchor[place + 1] = _within((bucket.astype(np.uint64) << np.uint64(32)) | bits, known)[0]
    anchor = np.cumsum(anchor)
    hashes, doc, place = chunk.windows(window)
    held = anchor[place + window - block + 1] > anchor[place]
    hashes, low, high = _fold(hashes[held], (doc[held], np.minimum), (doc[held], np.maximum))
    out = []
    for b, at in _buckets((hashes % np.uint64(buckets)).astype(np.int64), buckets):
        at = at[np.argsort(low[at], kind="stable")]
        out.append((b, number, _pack(hashes[at], chunk.ids[low[at]], chunk.ids[high[at]])))
    return _rows(out, ("bucket", "chunk", "said"))


def _within(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur in the sorted ``known``, and where."""
    at = np.minimum(np.searchsorted(known, values), max(len(known) - 1, 0))
    return (known[at] == values) if len(known) else np.zeros(len(values), bool), at


def first_seen(bucket: pa.Table) -> pa.Table:
    """Tells each chunk the smallest document of those windows of which it has a larger one."""
    hashes, low, high, chunk = [], [], [], []
    numbers = bucket.column("chunk").to_numpy()
    for i, blob in enumerate(bucket.column("said").to_pylist()):
        h, a, b = _unpack(blob, np.uint64, np.int64, np.int64)
        hashes.append(h), low.append(a), high.append(b), chunk.append(np.full(len(h), i, np.int32))
    hashes, low, high, chunk = (np.concatenate(x) for x in (hashes, low, high, chunk))
    kinds, least = _fold(hashes, (low, np.minimum))
    least = least[np.searchsorted(kinds, hashes)]
    late = least < high
    hashes, least, chunk = hashes[late], least[late], chunk[late]
    number = bucket.column("bucket")[0].as_py()
    return _rows([(int(numbers[i]), number, _pack(hashes[at], least[at])) for i, at in _buckets(chunk, len(numbers))], ("chunk", "bucket", "heard"))


def cut(chunk: Chunk, heard: pa.Table, window: int) -> pa.Table:
    """The chunk's documents without the words of windows that a smaller document has."""
    parts = [_unpack(blob, np.uint64, np.int64) for blob in heard.column("heard").to_pylist()]
    known, least = (np.concatenate([np.zeros(0, t), *[p[i] for p in parts]]) for i, t in ((0, np.uint64), (1, np.int64)))
    order = np.argsort(known)
    known, least = known[order], least[order]
    hashes, doc, place = chunk.windows(window)
    found, at = _within(hashes, known)
    repeat = np.flatnonzero(found)
    repeat = repeat[least[at[repeat]] < chunk.ids[doc[repeat]]]
    change = np.zeros(len(chunk.words) + 1, np.int64)
    np.add.at(change, place[repeat], 1)
    np.add.at(change, place[repeat] + window, -1)
    gone = np.cumsum(change)[:-1] > 0
    kept, spans, removed = [], [], []
    for i, text in enumerate(chunk.rows.column("text").to_pylist()):
        a, n = int(chunk.first[i]), int(chunk.count[i])
        mark = gone[a : a + n]
        words = (text or "").encode().split()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
        removed.append(int(mark.sum()))
        kept.append(b" ".join(compress(words, ~mark) if removed[-1] else words).decode())
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table(
        {"doc_id": chunk.rows.column("doc_id"), "n_words": pa.array(chunk.count), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, kind)}
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a blank) and spans (removed words, end exclusive).

    A word goes if it lies in a run of ``window`` words that also occurs in a document with a smaller doc_id; runs are
    judged on the input. Documents that share a doc_id do not affect each other; a null doc_id counts as the largest.
    Null and empty texts have no words. Repeated rows give repeated rows, an empty table none; other columns are not
    read. Texts are taken whole.

    Documents are dealt to chunks by hash. Every run of ``block`` words is a probe, every aligned one is also in the
    index; a window of 2 x block - 1 words or more holds a whole block of any document that has it. Windows that hold
    a hit are extended: the same question is asked about all their words, by a 64-bit hash within the bucket. Chunks
    fold their hashes first, so a passage that every document has is named once a chunk, and no pairs are made. The
    documents are shuffled once; the three steps over them read that same exchange.
    """
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    grown = max(1.0, math.sqrt(size / STEADY_BYTES))
    chunks = max(1, math.ceil(size / (CHUNK_BYTES * grown)))
    buckets = max(1, math.ceil(size / 6 / (BUCKET_WORDS * grown)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary"))), F.lit(chunks)))
    said, heard = "bucket long, chunk long, said binary", "chunk long, bucket long, heard binary"

    def ask(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return anchors(Chunk(rows), key[0].as_py(), block, buckets)

    def extend(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        return repeats(Chunk(rows), answers, key[0].as_py(), block, window, buckets)

    def finish(key: tuple[pa.Scalar, ...], rows: pa.Table, answers: pa.Table) -> pa.Table:
        return cut(Chunk(rows), answers, window)

    hits = dealt.groupBy("chunk").applyInArrow(ask, said).groupBy("bucket").applyInArrow(met, heard)
    asked = dealt.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend, said)
    answers = asked.groupBy("bucket").applyInArrow(first_seen, heard)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"
    )
