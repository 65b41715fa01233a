"""Vector code compression: product codes learned by member-resident Lloyd rounds in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import shuffle_parts, table

#: Parts of a vector, entries of a part's codebook (at most 256: two hex digits), rounds, factor before flooring.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components end here, so that floors are exact and differences stay in 64 bits.
LARGEST = 1 << 53
#: Rows a task compares at once, and the largest squared distance that is safe to sum in 64 bits.
STRETCH, SAFE = 8192, 1 << 62
#: Pieces into which the error total of a label is dealt.
LABEL_SALTS = 64


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts of a vector of ``width`` components begin, and the end: equal parts where ``parts`` divides it."""
    return [p * width // parts for p in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of ``book`` for each row of ``x`` (ties to the lower index), and the squared distance.

    Whole numbers throughout. Where a sum of squares may leave 64 bits the same is done in Python's own integers.
    """
    if x.shape[1] == 0 or len(x) == 0:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    reach = max(abs(int(x.max())), abs(int(x.min()))) + max(abs(int(book.max())), abs(int(book.min())))
    kind = np.int64 if reach * reach * x.shape[1] < SAFE else object
    x, book = x.astype(kind), book.astype(kind)
    index, error = np.empty(len(x), np.int64), np.empty(len(x), kind)
    for i in range(0, len(x), STRETCH):
        part = x[i : i + STRETCH]
        distance = np.zeros((len(part), len(book)), kind)
        for j in range(x.shape[1]):
            difference = part[:, j, None] - book[None, :, j]
            distance += difference * difference
        best = distance.argmin(axis=1)
        index[i : i + STRETCH], error[i : i + STRETCH] = best, distance[np.arange(len(part)), best]
    return index, error


def _rows(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def integer_vectors(vectors: DataFrame, vector: str, label: str | None, scale: int) -> DataFrame:
    """row, vec_id, label, v: floor(scale * component) of the vectors whose components are all there and finite."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    edge = F.lit(float(LARGEST))
    whole = F.transform(v, lambda x: F.floor(F.greatest(-edge, F.least(edge, x * scale))).cast("long"))
    return vectors.where(F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"), whole.alias("v"),
    )


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The codebook of each part: that part of the vectors with the ``entries`` smallest ids (ties by components)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return []
    width = len(first[0]["v"])
    at = bounds(width, parts)
    v = np.array([r["v"] for r in first if len(r["v"]) == width], np.int64).reshape(-1, width)
    return [v[:, a:b] for a, b in zip(at, at[1:])]


def residents(rows: DataFrame, books: list[np.ndarray], salts: int) -> DataFrame:
    """The parts of all vectors at their owners: one row per part, partitioned by (position, entry, salt).

    A part goes to the entry of its position that is nearest; ``salt`` deals the members of one entry to so many
    owners, so an entry that holds a third of all rows is not one task's. Parts travel as packed bytes.
    """
    width = sum(b.shape[1] for b in books)
    at = bounds(width, len(books))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STRETCH):
                piece = batch.slice(i, STRETCH)
                x = _rows(piece.column(1), width)
                for p, book in enumerate(books):
                    part = x[:, at[p] : at[p + 1]]
                    yield _packed(piece.column(0), p, nearest(part, book)[0], part)

    one = rows.where(F.size("v") == width).select("row", "v")
    return _dealt(one.mapInArrow(split, "row long, position int, entry int, part binary"), salts)


def _packed(row: pa.Array, position: int | np.ndarray, entry: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Parts as 16-, 32- or 64-bit integers, the narrowest that holds the batch (a byte before them tells which)."""
    most = max(abs(int(part.max(initial=0))), abs(int(part.min(initial=0))))
    kind = np.dtype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
    size = 1 + kind.itemsize * part.shape[1]
    data = np.full((len(part), size), kind.itemsize, np.uint8)
    data[:, 1:] = np.ascontiguousarray(part.astype(kind)).view(np.uint8).reshape(len(part), size - 1)
    packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, size * (len(part) + 1), size, dtype=np.int32)), pa.py_buffer(data.tobytes())])
    return pa.RecordBatch.from_arrays(
        [row, pa.array(np.broadcast_to(np.int32(position), len(part))), pa.array(entry.astype(np.int32)), packed], ["row", "position", "entry", "part"]
    )


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    """The integers of ``_packed``, whatever kinds are mixed in the column."""
    out = np.zeros((len(column), width), np.int64)
    if width == 0:
        return out
    size = column.cast(pa.large_binary())
    at = np.frombuffer(size.buffers()[1], np.int64)[size.offset : size.offset + len(size) + 1]
    data = np.frombuffer(size.buffers()[2], np.uint8)
    for kind in ("<i2", "<i4", "<i8"):
        bytes_ = np.dtype(kind).itemsize
        own = np.flatnonzero(data[at[:-1]] == bytes_)
        if len(own):
            places = at[own][:, None] + 1 + np.arange(bytes_ * width)
            out[own] = np.ascontiguousarray(data[places]).view(kind)
    return out


def _dealt(parts: DataFrame, salts: int) -> DataFrame:
    """``parts`` shuffled to their owners and written there."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    return table(salted.repartition(shuffle_parts(parts.sparkSession), "position", "entry", "salt").sortWithinPartitions("position", "entry"))


def owners_update(generations: list[DataFrame], history: list[list[np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """One pass of the owners over their resident members: (sums of those that stay, parts that change entry).

    ``generations[g]`` holds the parts that arrived for the codebooks ``history[g]``; a part lives in the last
    generation it came to, which its owner knows by following the codebooks since. With the newest codebooks a
    member that keeps its entry is added to the entry's sum where it lies; one that changes is handed on with its
    new entry. Only those rows leave their owner. Sums come as two halves, so they do not overflow.
    """
    latest = len(history) - 1
    widths = [b.shape[1] for b in history[0]]
    most = max(widths)

    def sums_of(position: np.ndarray, entry: np.ndarray, x: np.ndarray, total: dict) -> None:
        for cell in np.unique(position * 1024 + entry):
            own = x[position * 1024 + entry == cell]
            high, low = (own >> 26).sum(axis=0), (own & ((1 << 26) - 1)).sum(axis=0)
            held = total.setdefault(int(cell), [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
            held[0] += len(own)
            held[1] += high
            held[2] += low

    def run(g: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict = {}
            for batch in batches:
                position, entry = (batch.column(i).to_numpy() for i in (1, 2))
                for p in np.unique(position):
                    mine = np.flatnonzero(position == p)
                    x = _unpacked(batch.column(3).take(pa.array(mine)), widths[p])
                    here = entry[mine].astype(np.int64)
                    alive = np.ones(len(mine), bool)
                    for books in history[g + 1 : latest]:
                        alive &= nearest(x, books[p])[0] == here
                    new = nearest(x, history[latest][p])[0] if g < latest else here
                    stay = alive & (new == here)
                    wide = np.zeros((int(stay.sum()), most), np.int64)
                    wide[:, : widths[p]] = x[stay]
                    sums_of(np.full(len(wide), p, np.int64), here[stay], wide, totals)
                    go = np.flatnonzero(alive & (new != here))
                    if len(go):
                        moved = _packed(batch.column(0).take(pa.array(mine[go])), int(p), new[go], x[go])
                        yield _kind(moved, None, None, None)
            if totals:
                cells = np.array(sorted(totals))
                n, high, low = (pa.array([totals[c][i].tolist() if i else totals[c][0] for c in cells.tolist()]) for i in range(3))
                none = pa.nulls(len(cells), pa.int64()), pa.nulls(len(cells), pa.binary())
                named = pa.RecordBatch.from_arrays([none[0], pa.array((cells // 1024).astype(np.int32)), pa.array((cells % 1024).astype(np.int32)), none[1]], ["row", "position", "entry", "part"])
                yield _kind(named, n, high, low)

        return work

    schema = "row long, position int, entry int, part binary, n long, high array<long>, low array<long>"
    out = None
    for g, members in enumerate(generations):
        one = members.select("row", "position", "entry", "part").mapInArrow(run(g), schema)
        out = one if out is None else out.unionByName(one)
    out = table(out)
    return out.where("row is null").drop("row", "part"), out.where("row is not null").select("row", "position", "entry", "part")


def _kind(batch: pa.RecordBatch, n, high, low) -> pa.RecordBatch:
    empty = pa.nulls(batch.num_rows, pa.list_(pa.int64()))
    columns = [pa.nulls(batch.num_rows, pa.int64()) if n is None else n, empty if high is None else high, empty if low is None else low]
    return pa.RecordBatch.from_arrays([*batch.columns, *columns], ["row", "position", "entry", "part", "n", "high", "low"])


def _means(sums: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after an update: floor(sum / count) of each entry's members; an unused entry stays.

    What comes to the driver is one row per used entry: parts x entries x width numbers, whatever the rows are.
    """
    most = max(b.shape[1] for b in books)
    fold = [F.sum("n").alias("n")] + [F.sum(F.col(h)[j]).cast("decimal(38,0)").alias(f"{h}{j}") for h in ("high", "low") for j in range(most)]
    new = [b.copy() for b in books]
    for r in sums.groupBy("position", "entry").agg(*fold).collect():
        for j in range(books[r["position"]].shape[1]):
            new[r["position"]][r["entry"], j] = (int(r[f"high{j}"]) * (1 << 26) + int(r[f"low{j}"])) // r["n"]
    return new


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of ``rows`` (row, vec_id, v) after ``rounds`` Lloyd rounds; one array (entry, component) per part.

    Members live with their owners, partitioned by (position, entry, salt). In a round the owners sum what stays, the
    parts that change entry are shuffled to their new owners and summed there; nothing else moves.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("1 to 256 entries, at least one part")
    books = first_books(rows, parts, entries)
    if not books or not rounds:
        return books
    salts = 16 + shuffle_parts(rows.sparkSession) // 16
    generations, history = [residents(rows, books, salts)], [books]
    for turn in range(rounds):
        sums, moved = owners_update(generations, history)
        if turn:
            generations.append(_dealt(moved, salts))
            arrived, _ = owners_update([generations[-1]], [history[-1]])
            sums = sums.unionByName(arrived)
        history.append(_means(sums, history[-1]))
    return history[-1]


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """row, vec_id, label, code, error: the indexes of the nearest entries in part order, and their squared distances.

    Coding needs no shuffle. A vector of another width than the codebooks has no code and no error.
    """
    width = sum(b.shape[1] for b in books)
    at = bounds(width, len(books)) if books else [0]
    digits = np.array([f"{i:02x}" for i in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, STRETCH):
                batch = whole.slice(i, STRETCH)
                x = _rows(batch.column(1), width)
                code, error = np.full(len(x), ""), np.zeros(len(x), object)
                for p, book in enumerate(books):
                    index, distance = nearest(x[:, at[p] : at[p + 1]], book)
                    code, error = np.char.add(code, digits[index]), error + distance
                capped = [min(int(e), (1 << 63) - 1) for e in error]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.tolist(), pa.string()), pa.array(capped, pa.int64())], ["key", "code", "error"])

    fits = F.size("v") == width
    key = F.struct("row", "vec_id", "label")
    schema = rows.select(key.alias("key")).schema.add("code", "string").add("error", "long")
    coded = rows.where(fits).select(key.alias("key"), "v").mapInArrow(run, schema).select("key.*", "code", "error")
    none = rows.where(~fits).select("row", "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(none)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compressed(
    vectors: DataFrame, vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: one row per vector that can be coded.

    Rows whose vector is null or holds null or non-finite components go. A zero vector is coded like any other. The
    codebooks are those of the width of the vector with the smallest id; a row of another width (an empty vector
    among others) has null code and error. Where ``parts`` does not divide the width, parts differ by one component.
    With fewer than ``entries`` rows the codebooks are as short. Null ids are the largest; rows of one id are ordered
    by components; repeated rows are coded each and count each. ``label_error`` sums over equal labels, nulls
    together; it is null where all are. Components beyond 2**53 after scaling stay there; an error beyond 63 bits is
    the largest long. An empty table gives no rows. Extra columns are not read.
    """
    rows = table(integer_vectors(vectors, vector, label, scale))
    books = learn(rows, parts, entries, rounds)
    coded = table(encode(rows, books))
    salt = F.pmod(F.xxhash64("row"), F.lit(LABEL_SALTS)).cast("int")
    total, cap = F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.when(total > cap, cap).otherwise(total)
    totals = coded.groupBy("label").agg(total.alias("total"))
    dealt = totals.select(F.col("label").alias("of"), F.col("total").cast("long").alias("label_error"), F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))).alias("piece"))
    joined = coded.withColumn("salt", salt).join(dealt, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("piece")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _assign(name: str, book: str) -> str:
    return f"""{name} AS (SELECT rid, p, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (SELECT x.rid, x.p, c.e, CAST(sum((x.x - c.x) * (x.x - c.x)) AS BIGINT) AS d
  FROM parts x JOIN {book} c ON x.p = c.p AND x.j = c.j GROUP BY x.rid, x.p, c.e) GROUP BY rid, p)"""


def _update(name: str, assigned: str, book: str) -> str:
    return f"""{name} AS (SELECT o.p, o.e, o.j, CASE WHEN n IS NULL THEN o.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM {book} o LEFT JOIN (SELECT a.p, a.e, x.j,
  CAST(sum(x.x) AS BIGINT) AS s, count(*) AS n FROM {assigned} a JOIN parts x ON a.rid = x.rid AND a.p = x.p GROUP BY a.p, a.e, x.j) m ON o.p = m.p AND o.e = m.e AND o.j = m.j)"""


#: The whole of ``compressed`` in DuckDB's SQL, for vectors of one width that 16 divides.
CODES_SQL = f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)), false)),
parts AS (SELECT rid, i * {PARTS} // w AS p, i % (w // {PARTS}) AS j, CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT rid, len(embedding) AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM kept)),
c0 AS (SELECT p, rid - 1 AS e, j, x FROM parts WHERE rid <= {ENTRIES}),
{_assign("a0", "c0")},
{_update("c1", "a0", "c0")},
{_assign("a1", "c1")},
{_update("c2", "a1", "c1")},
{_assign("a2", "c2")},
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM c2)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM kept JOIN coded USING (rid), books
"""
