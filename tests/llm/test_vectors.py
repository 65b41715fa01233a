import numpy as np
import pytest

from corpuslens.llm import ann, vectors
from llm_support import SF
from pyspark.sql import functions as F


def brute_links(ids, v, cosine=0.95):
    ok = np.isfinite(v).all(1) & (np.abs(v).sum(1) > 0)
    u = np.where(ok[:, None], v, 1.0)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T >= cosine) & ok[:, None] & ok[None, :]
    np.fill_diagonal(s, False)
    comp = np.array(ids)
    while True:
        new = np.array([min([comp[i], *comp[s[i]]]) for i in range(len(ids))])
        if (new == comp).all():
            return s.sum(1), comp
        comp = new


def clusters(rng, n, d=32):
    v = [rng.standard_normal(d) for _ in range(n)]
    for size, noise in ((300, 0.02), (40, 0.05), (2, 0.03), (2, 0.1), (150, 0.16)):  # the last is wide: not all of it links
        c = rng.standard_normal(d)
        v += [c + noise * rng.standard_normal(d) for _ in range(size)]
    v += [v[0]] * 25 + [v[n] * 3] * 5
    return np.array(v)


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    v = clusters(np.random.default_rng(2), 400)
    v[5], v[6] = 0.0, np.nan
    ids = list(range(10, 10 + len(v)))
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in zip(ids, v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    links, comp = brute_links(ids, v)
    assert len(got) == len(ids)
    wrong = [i for i, n, c in zip(ids, links, comp) if (got[i]["n_links"], got[i]["component_id"]) != (n, c)]
    assert len(wrong) <= 3, wrong  # windows may miss a lone pair at the threshold
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert got[15]["n_links"] == got[16]["n_links"] == 0


def test_hard_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, float("inf")]), (8, [1.0]), (None, [1.0, 0.001]), (1, [1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("node", "v", "comp", "digest")})
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df).collect()))
    assert got == [(0, 3, 1, False), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True)]
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    found = ann.search(df, F.col("vec_id") <= 2, nearest=2).collect()
    assert len(found) == 6 and {r["vec_id"] for r in found if r["query_id"] == 2} == {1}
    assert ann.search(df.limit(0), F.col("vec_id") > 0).count() == 0


def brute_nearest(ids, v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for i, a in enumerate(ids):
        if a % 50 == 0:
            s = u @ u[i]
            s[i] = -np.inf
            out[a] = sorted(zip(-s, ids))[:k]
    return out


@pytest.mark.parametrize("blocks", [(8192, 4096), (100, 3)])
def test_search_recall(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "INDEX_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[1])
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    v = np.array([r["embedding"] for r in rows], np.float64)
    want = brute_nearest([r["vec_id"] for r in rows], v, 5)
    got = ann.search(df, F.col("vec_id") % 50 == 0).collect()
    assert len(got) == 5 * len(want)
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in got)
    assert hits / len(got) >= 0.97
    for r in got:
        assert abs(r["score"] - -want[r["query_id"]][r["rank"] - 1][0]) < 0.05
    assert {(r["query_id"], r["rank"]) for r in got} == {(q, k) for q in want for k in range(1, 6)}


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(100, 300)] + [(50, [1.0, 2.0, 2.9])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 50), key=lambda r: r["rank"])] == [100, 101, 102, 103, 104]
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((3000, 64)), rng.standard_normal((40, 64))
    guess, error = ann.estimate(*ann.encode(x), q, 3.0)
    true = vectors.unit(q) @ vectors.unit(x).T
    assert abs((guess - true).mean()) < 0.003
    assert (np.abs(guess - true) <= error).mean() > 0.995
