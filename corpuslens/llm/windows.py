"""Packing token sequences into windows: length combinations solved by non-negative least squares."""

from __future__ import annotations

import json
import os
import sys
import types
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.ordering import global_positions
from corpuslens.llm.common import slices, table, utf8

#: Tokens of a window, pieces a combination joins at most, sweeps of the solver, id that ends a document.
WINDOW, DEPTH, SWEEPS, END = 2048, 3, 6, 1
TOKENIZER = "word_bpe_49k.json"


# ---------------------------------------------------------------- the plan: from counts of lengths to windows


def combinations(lengths: list[int], window: int, depth: int) -> list[tuple[int, ...]]:
    """Every multiset of at most ``depth`` (1 to 3) lengths that fills the window exactly, shallow and long ones first."""
    present = set(lengths)
    descending = sorted(present, reverse=True)
    found = [(window,)] if window in present else []
    if depth > 1:
        found += [(a, window - a) for a in descending if 2 * a >= window and window - a in present]
    if depth > 2:
        for a in descending:
            rest = window - a
            if 3 * a >= window and rest > 1:
                found += [(a, b, rest - b) for b in descending if b <= a and 2 * b >= rest and rest - b in present]
    return found


def solve(counts: dict[int, int], found: list[tuple[int, ...]], least: float, sweeps: int = SWEEPS) -> dict[int, float]:
    """Repeats x >= 0 of combinations with least squares of (pieces used - pieces there), by coordinate descent.

    Starting from zero, each repeat in turn takes the value that is best with the others as they are, not below 0. A
    combination enters only with ``least`` repeats or more, so the solution has few of them however many fit.
    """
    left = [0.0] * (max(counts, default=0) + 1)
    for n, c in counts.items():
        left[n] = float(c)
    x: dict[int, float] = {}
    for _ in range(sweeps):
        change = 0.0
        for s, combo in enumerate(found):
            slope = 0.0
            for n in combo:
                slope += left[n]
            if slope < least and s not in x:
                continue
            step = max(-x.get(s, 0.0), slope / sum(combo.count(n) for n in combo))
            if s not in x and step < least:
                continue
            x[s] = x.get(s, 0.0) + step
            change = max(change, abs(step))
            for n in combo:
                left[n] -= step
        if change < least:
            break
    return x


class Plan:
    """Which window, and which place in it, each piece gets: one rule for each run of ranks among pieces of one length.

    A window rule (length, rank, count, window, offset): the pieces of ``length`` from ``rank`` on go to ``count``
    windows from ``window`` on, one each at ``offset``, then one each behind those, and so on. A line rule (count 0):
    the pieces follow one another on a line from place ``offset`` on, and the line is cut into windows from ``window``
    on. Rules are as many as the lengths and combinations ask for; the number of rows does not matter.
    """

    def __init__(self, counts: dict[int, int], window: int = WINDOW, depth: int = DEPTH, sweeps: int = SWEEPS):
        self.window, self.windows = window, 0
        self.rules: list[tuple[int, int, int, int, int]] = []
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self._combined(counts, depth, sweeps)
        self.solved = self.windows
        line = self._greedy()
        self.filled = self.windows
        self._laid(line)

    def _emit(self, members: list[tuple[int, int]], count: int) -> None:
        """``count`` windows that hold, of each (length, times), that many pieces one after the other."""
        offset = 0
        for length, times in members:
            self.rules.append((length, self.used[length], count, self.windows, offset))
            self.used[length] += times * count
            self.left[length] -= times * count
            offset += times * length
        self.windows += count

    def _combined(self, counts: dict[int, int], depth: int, sweeps: int) -> None:
        """The rounded solution, combinations with many repeats first, as far as there are pieces."""
        found = combinations(list(counts), self.window, depth)
        # some 4 * depth * window combinations enter at most, whatever the counts are
        repeats = solve(counts, found, max(0.5, sum(counts.values()) / (4 * depth * self.window)), sweeps)
        for s in sorted(repeats, key=lambda s: (-repeats[s], s)):
            members = [(n, found[s].count(n)) for n in dict.fromkeys(found[s])]
            count = min([int(repeats[s] + 0.5), *(self.left[n] // times for n, times in members)])
            if count:
                self._emit(members, count)

    def _greedy(self) -> list[int]:
        """Residuals, longest first: the longest that still fits goes in, all windows that come out equal at once.

        Returns the lengths whose pieces found no such window.
        """
        lengths, line = sorted(n for n, c in self.left.items() if c), []
        while lengths:
            gap, members, i = self.window, [], len(lengths)
            while gap and i:
                i = min(i, bisect_right(lengths, gap)) - 1
                if i >= 0:
                    times = min(gap // lengths[i], self.left[lengths[i]])
                    members.append((lengths[i], times))
                    gap -= times * lengths[i]
                i = max(i, 0)
            if gap:
                line.append(lengths.pop())
            else:
                self._emit(members, min(self.left[n] // times for n, times in members))
                lengths = [n for n in lengths if self.left[n]]
        return line

    def _laid(self, line: list[int]) -> None:
        """The rest on a line that is cut into full windows; the last tokens make windows of powers of two, unpadded."""
        at = 0
        for n in line:
            self.rules.append((n, self.used[n], 0, self.windows, at))
            at += n * self.left[n]
        full, rest = divmod(at, self.window)
        tail = [1 << bit for bit in reversed(range(self.window.bit_length())) if rest >> bit & 1]
        self.tail = [full * self.window + sum(tail[:i]) for i in range(len(tail) + 1)]
        self.windows += full + len(tail)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """What tasks need: keys of the rules (length and first rank, ascending), the rules, the line's tail, the window."""
        rules = np.array(sorted(self.rules), np.int64).reshape(-1, 5)
        return (rules[:, 0] << 48) + rules[:, 1], rules, np.array(self.tail, np.int64), self.window


def places(arrays: tuple, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, start, size, window, offset) of every part of the pieces given by length and rank (from 0)."""
    keys, rules, tail, window = arrays
    rule = rules[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
    turn, count = rank - rule[:, 1], rule[:, 2]
    own = np.flatnonzero(count)
    found = [(own, np.zeros(len(own), np.int64), length[own], rule[own, 3] + turn[own] % count[own], rule[own, 4] + turn[own] // count[own] * length[own])]
    laid = np.flatnonzero(count == 0)
    start, end = np.zeros(len(laid), np.int64), length[laid]
    while len(laid):  # the part up to the next cut of the line
        at = rule[laid, 4] + turn[laid] * length[laid] + start
        last = np.searchsorted(tail, at, "right") - 1  # -1: before the tail
        begin = np.where(last < 0, at // window * window, tail[last])
        until = np.where(last < 0, begin + window, tail[np.minimum(last + 1, len(tail) - 1)])
        size = np.minimum(end - start, until - at)
        found.append((laid, start, size, rule[laid, 3] + np.where(last < 0, at // window, tail[0] // window + last), at - begin))
        more = start + size < end
        laid, start, end = laid[more], (start + size)[more], end[more]
    return tuple(np.concatenate(c) for c in zip(*found))


# ---------------------------------------------------------------- tokens


def tokenised(docs: DataFrame, path: str, window: int, end: int) -> DataFrame:
    """doc_id, row, start, length, ids_crc32, doc_tokens, ids: each document's tokens and ``end``, window by window.

    Pieces of a document are full windows and a rest. Ids are packed as 32-bit integers.
    """
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Tokens.of_worker(path)
        for whole in batches:
            for begin, stop in slices(whole.column(2)):
                batch = whole.slice(begin, stop - begin)
                flat, ends = model.ids(batch.column(2), end)
                out: list[list] = [[], [], [], [], [], []]
                for k in range(batch.num_rows):
                    first, last = int(ends[k]), int(ends[k + 1])
                    for a in range(first, last, window):
                        data = flat[a : min(a + window, last)].tobytes()
                        for column, value in zip(out, (k, a - first, len(data) // 4, zlib.crc32(data), last - first, data)):
                            column.append(value)
                rows = pa.array(out[0], pa.int64())
                columns = [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(c, pa.int64()) for c in out[1:5]), pa.array(out[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    return one.mapInArrow(run, schema)


class Tokens:
    """A tokenizer file applied to columns of texts: each different unit of a stretch of texts is tokenised once.

    A tokenizer that drops white space and splits at WORDS never joins what lies on both sides of white space, of a
    digit, or of an ASCII letter next to an ASCII mark other than an apostrophe; units end there, and ASCII letters
    count as lower case where it lowers all. For other tokenizers, and for texts that hold one of its special strings,
    a unit is the whole text.
    """

    #: Fixed value: the split pattern of tokenizers whose units are known.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    HELD = 1 << 18  # units, about, whose ids are kept from batch to batch

    @staticmethod
    def of_worker(path: str) -> Tokens:
        """The tokenizer as this Python process has loaded it: a worker runs many tasks, and what it has met stays."""
        held = sys.modules.setdefault("_token_units", types.ModuleType("_token_units")).__dict__
        return held.get(path) or held.setdefault(path, Tokens(path))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made.get("added_tokens", [])]
        before = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [s["type"] for s in (made.get("normalizer") or {}).get("normalizers", [])]
        split = before[0].get("pattern") == {"Regex": self.WORDS} and before[0].get("behavior") == "Removed"
        self.words = steps == ["NFC", "Replace", "Lowercase"] and split and [s.get("type") for s in before[1:]] == ["ByteLevel"]
        self.known, self.sizes, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        code = np.arange(256)
        self.lower = np.where((code >= 65) & (code <= 90), code + 32, code).astype(np.uint8)
        letter, digit = ((code | 32) >= 97) & ((code | 32) <= 122), (code >= 48) & (code <= 57)
        space = (code == 32) | ((code >= 9) & (code <= 13))
        mark = (code > 32) & (code < 127) & ~letter & ~digit & (code != 39)
        self.kind = np.select([letter, digit, mark, space], [1, 2, 3, 4], 0).astype(np.uint8)
        cut = np.zeros((5, 5), bool)
        for a, b in ((1, 3), (3, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2)):
            cut[a, b] = True
        self.cut = cut.ravel()

    def encoded(self, units: list[str]) -> Iterator[list[int]]:
        """The ids of each unit. ASCII letters are a single word as they stand and go to the merges directly."""
        plain = [self.words and u.isascii() and u.isalpha() for u in units]
        other = iter(self.model.encode_batch_fast([u for u, p in zip(units, plain) if not p], add_special_tokens=False))
        merge = self.model.model.tokenize
        for unit, p in zip(units, plain):
            yield [t.id for t in merge(unit)] if p else next(other).ids

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all units, ends of the units in them with 0 before, number of units before each text and in all)."""
        data, at = utf8(column)
        whole = np.ones(len(at) - 1, bool)
        if self.words:
            whole[:] = False
            for content in self.special:
                whole |= pc.match_substring(column.cast(pa.large_string()).fill_null(""), content).to_numpy(zero_copy_only=False)
        kind = self.kind[data]
        inside, first = kind != 4, np.zeros(len(data) + 1, bool)
        first[1:-1] = self.cut[kind[:-1] * np.uint8(5) + kind[1:]] | ~inside[:-1] if len(data) else False
        lowered = self.lower[data]
        for k in np.flatnonzero(whole):
            a, b = at[k], at[k + 1]
            inside[a:b], first[a:b], lowered[a:b] = True, False, data[a:b]
        first[at] = True
        start = np.flatnonzero(first[:-1] & inside)
        kept = np.concatenate([[0], np.cumsum(inside)])
        return lowered[inside], np.concatenate([kept[start], kept[-1:]]), np.searchsorted(start, at)

    def ids(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as one array, ``end`` after each text, and where each text's ids begin (one more entry)."""
        letters, ends, first = self.units(column)
        units = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters)]).dictionary_encode()
        at = pc.index_in(units.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        missing = units.dictionary.take(pa.array(np.flatnonzero(at < 0)))
        more, more_sizes = array("I"), array("q")
        for ids in self.encoded(missing.to_pylist()):
            more.extend(ids)
            more_sizes.append(len(ids))
        at[at < 0] = len(self.sizes) + np.arange(len(missing))
        all_sizes = np.concatenate([self.sizes, np.frombuffer(more_sizes, np.int64), [1]])
        pool = np.concatenate([self.pool, np.frombuffer(more, np.uint32), np.array([end], np.uint32)])
        all_begins = np.cumsum(all_sizes) - all_sizes
        at = np.append(at, len(all_sizes) - 1)
        sizes, begins = all_sizes[at], all_begins[at]
        if len(self.known) < self.HELD:  # the units met first are the frequent ones
            self.known, self.sizes, self.pool = pa.concat_arrays([self.known, missing]), all_sizes[:-1], pool[:-1]
        used = np.insert(units.indices.to_numpy(), first[1:], len(at) - 1)  # the end mark after each text
        texts = np.arange(len(first)) + first  # in ``used``, where each text begins
        length = sizes[used]
        before = np.zeros(len(used) + 1, np.int64)
        np.cumsum(length, out=before[1:])
        places = np.repeat(begins[used] - before[:-1], length)
        places += np.arange(len(places))
        return pool[places].astype("<u4", copy=False), before[texts]


# ---------------------------------------------------------------- the operator


def placed(pieces: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, row, piece_start, start, length, ids_crc32 (null where the plan cut), doc_tokens, sequence_id, offset."""
    arrays = plan.arrays()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, doc, row, start, crc, tokens, position = (batch.column(i) for i in range(7))
            piece, inner, size, sequence, offset = places(arrays, length.to_numpy(), position.to_numpy() - 1)
            of = pa.array(piece)
            columns = [
                doc.take(of), row.take(of), start.take(of), pa.array(start.to_numpy()[piece] + inner), pa.array(size),
                pa.array(crc.to_numpy()[piece], mask=size != length.to_numpy()[piece]), tokens.take(of), pa.array(sequence), pa.array(offset),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "piece_start", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = ["doc_id", "row", "start", "ids_crc32", "doc_tokens"]
    ranked = global_positions(pieces.select("length", *order), ["length"], order)
    return ranked.select("length", *order, "position").mapInArrow(
        run, "doc_id long, row long, piece_start long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def _planned(docs: DataFrame, tokenizer: str, window: int, depth: int, end: int) -> tuple[DataFrame, DataFrame]:
    if window < 1 or window & (window - 1):
        raise ValueError("the window is a power of two")
    pieces = table(tokenised(docs, tokenizer, window, end))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return pieces, table(placed(pieces, Plan(counts, window, depth)))


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, depth: int = DEPTH, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of each row of ``docs``.

    A document is cut into full windows and a rest. The counts of the rests' lengths (at most ``window`` numbers) go
    to the driver, which solves how often each combination of up to ``depth`` lengths is used; the rounded solution
    and the greedy packing of the residuals are rules over ranks of equal lengths, which every task applies to its
    rows. Rests that no window takes whole are laid on a line, which is cut window by window. All windows are full but the last few, whose sizes are powers of two, so
    nothing is padded. Null and empty texts have the one token ``end``. Repeated rows are packed each; null ids are
    kept. An empty table gives no rows; extra columns are not read.
    """
    pieces, rows = _planned(docs, tokenizer, window, depth, end)
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = rows.where("ids_crc32 is not null")
    cut = table(rows.where("ids_crc32 is null"))  # a table of its own: where it is small, its size says so and no ids are shuffled
    source = pieces.select(F.col("row").alias("of_row"), F.col("start").alias("of_start"), "ids")
    joined = cut.join(source, (F.col("row") == F.col("of_row")) & (F.col("piece_start") == F.col("of_start")))
    own = F.col("ids").substr((F.col("start") - F.col("piece_start")).cast("int") * 4 + 1, F.col("length").cast("int") * 4)
    return whole.select(*out).unionByName(joined.withColumn("ids_crc32", F.crc32(own)).select(*out))


def sequences(docs: DataFrame, tokenizer: str, window: int = WINDOW, depth: int = DEPTH, end: int = END, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array<int>), pieces (doc_id, start, length, offset): the windows themselves.

    A window holds at most ``window`` tokens, so a group is bounded. Sizes that are no power of two would be filled
    up with ``pad``; ``packed`` says why there are none.
    """
    pieces, rows = _planned(docs, tokenizer, window, depth, end)
    source = pieces.select(F.col("row").alias("of_row"), F.col("start").alias("of_start"), "ids")
    joined = rows.join(source, (F.col("row") == F.col("of_row")) & (F.col("piece_start") == F.col("of_start")))
    own = F.col("ids").substr((F.col("start") - F.col("piece_start")).cast("int") * 4 + 1, F.col("length").cast("int") * 4)
    parts = joined.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", own.alias("ids")))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column(2).to_pylist():
                flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
                full = len(flat) if len(flat) & (len(flat) - 1) == 0 else window
                ids.append(np.concatenate([flat, np.full(full - len(flat), pad, np.int32)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), batch.column(1)], ["sequence_id", "ids", "pieces"])

    named = F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset")))
    shaped = parts.select("sequence_id", named.alias("pieces"), F.transform("parts", lambda p: p["ids"]).alias("ids"))
    return shaped.mapInArrow(run, "sequence_id long, ids array<int>, pieces array<struct<doc_id:long,start:long,length:long,offset:long>>")
