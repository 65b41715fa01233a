import hashlib
import random

import numpy as np
from corpuslens.llm import codes
from llm_support import SF
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Lloyd in Python's integers: (vec_id, code, error) of each row and the digest."""
    kept = sorted(([r[0], [int(np.floor(256 * float(x))) for x in r[1]], r[2]] for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    width = len(kept[0][1])
    at = [p * width // parts for p in range(parts + 1)]
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in zip(at, at[1:])]

    def assign():
        out = []
        for _, v, _ in kept:
            best = [min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), i) for i, e in enumerate(book)) for a, b, book in zip(at, at[1:], books)]
            out.append(best)
        return out

    for _ in range(rounds):
        found = assign()
        for p, (a, b) in enumerate(zip(at, at[1:])):
            for e in range(len(books[p])):
                members = [r[1][a:b] for r, f in zip(kept, found) if f[p][1] == e]
                if members:
                    books[p][e] = [sum(c) // len(members) for c in zip(*members)]
    coded = [(r[0], "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), r[2]) for r, f in zip(kept, assign())]
    total = {}
    for _, _, error, label in coded:
        total[label] = total.get(label, 0) + error
    text = ",".join(str(x) for book in books for e in book for x in e)
    return sorted(((i, lab, c, e, total[lab], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, lab in coded), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_plain_integers(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.standard_normal(32).astype(np.float32)], int(i % 3) if i % 7 else None) for i in rng.permutation(300)]
    rows += [(400 + i, rows[0][1], 1) for i in range(150)]  # a vector that a third of the rows share
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert got(codes.compressed(df)) == brute(rows)
    assert got(codes.compressed(df, entries=5, rounds=5)) == brute(rows, entries=5, rounds=5)
    assert got(codes.compressed(df, parts=5, rounds=0)) == brute(rows, parts=5, rounds=0)


def test_only_changed_parts_move(spark):
    rows = codes.table(codes.integer_vectors(spark.read.parquet(f"{SF}/embeddings.parquet"), "embedding", "label", 256))
    books = codes.first_books(rows, 16, 64)
    members = codes.residents(rows, books, 16)
    assert members.count() == 16 * rows.count()
    sums, none = codes.owners_update([members], [books])
    assert none.count() == 0 and sums.agg(F.sum("n")).first()[0] == members.count()
    after = codes._means(sums, books)
    stayed, moved = codes.owners_update([members], [books, after])
    assert 0 < moved.count() < members.count()
    assert stayed.agg(F.sum("n")).first()[0] + moved.count() == members.count()
    old = members.select("row", "position", F.col("entry").alias("was"))
    assert moved.join(old, ["row", "position"]).where("entry = was").count() == 0


def test_wide_numbers():
    rng = random.Random(1)
    x = np.array([[rng.randint(-codes.LARGEST, codes.LARGEST) for _ in range(3)] for _ in range(50)], np.int64)
    index, error = codes.nearest(x, x[:7])
    for row, i, e in zip(x.tolist(), index, error):
        distances = [sum((a - b) ** 2 for a, b in zip(row, c)) for c in x[:7].tolist()]
        assert distances[i] == e == min(distances) and distances.index(e) == i
    packed = codes._packed(codes.pa.array(range(50)), 0, index, x)
    assert (codes._unpacked(packed.column(3), 3) == x).all()


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (None, [0.5] * 16, 1), (3, None, 1), (4, [nan] + [0.0] * 15, 1), (5, [inf] + [0.0] * 15, None), (6, [None] + [0.0] * 15, 2), (7, [0.0] * 16, None), (8, [-0.001] * 16, None),
        (8, [-0.001] * 16, None), (8, [0.25] * 16, 2), (9, [1e30] * 16, 3), (10, [1.0] * 15, 4), (11, [], 4),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("x") for n in ("row", "v", "code", "error", "salt", "position", "entry", "part", "key", "n", "of", "piece", "total")})
    out = codes.compressed(df).collect()
    assert sorted(((r["vec_id"], r["label"]) for r in out), key=str) == sorted([(None, 1), (7, None), (8, None), (8, None), (8, 2), (9, 3), (10, 4), (11, 4)], key=str)
    by = {r["vec_id"]: r for r in out}
    assert by[10]["code"] is None and by[11]["error"] is None and by[10]["label_error"] is None
    assert len(by[7]["code"]) == 32 and len({r["codebooks_sha256"] for r in out}) == 1
    assert codes.compressed(df.limit(0)).count() == 0 and codes.compressed(df.where("vec_id = 3")).count() == 0
    small = [r for r in rows if r[0] in (7, 8)]
    assert got(codes.compressed(spark.createDataFrame(small, SCHEMA))) == brute(small)
    assert codes.compressed(df.drop("label"), label=None).count() == 8
