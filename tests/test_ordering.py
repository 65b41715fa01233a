import random

from corpuslens.functions import ordering


def test_latest_before_against_all_pairs(spark):
    rng = random.Random(9)
    keys = ["hot"] * 20 + ["a", "b", None]
    left = [(rng.choice(keys), rng.choice([None, *range(-50, 400)]), i) for i in range(800)]
    right = [(rng.choice(keys), rng.choice([None, *range(-50, 400, 7)]), i, f"x{i}") for i in range(150)]
    for width in (1, 10, 1000):
        df = ordering.latest_before(
            spark.createDataFrame(left, "k string, at long, id long"), spark.createDataFrame(right, "k string, since long, n long, name string"), ["k"], "at", "since", ["n", "name"], width)
        assert df.columns == ["k", "at", "id", "n", "name"]
        want = {}
        for k, at, i in left:
            seen = [(s, n, name) for kk, s, n, name in right if kk == k is not None and s is not None and at is not None and s <= at]
            want[i] = max(seen)[1:] if seen else (None, None)
        assert {r.id: (r.n, r.name) for r in df.collect()} == want
        assert df.count() == len(left)


def test_likely_in_keeps_every_key_and_few_others(spark):
    keys = spark.createDataFrame([("r", f"k{i}") for i in range(3000)] + [(None, "x"), ("r", None), ("r", "k1")], "repo string, path string")
    others = spark.createDataFrame([("r", f"o{i}") for i in range(8000)], "repo string, path string")
    may = ordering.likely_in(keys)
    assert keys.where(may).count() == 3003 and others.where(may).count() < 1500
    assert others.where(ordering.likely_in(keys.limit(0))).count() == 0
