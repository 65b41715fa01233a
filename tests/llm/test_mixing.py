import numpy as np

from corpuslens.llm import mixing
from llm_support import documents, hard_docs, hard_rows


def level(sizes, weights):
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * s, w * mid) for s, w in zip(sizes, weights)) < 1.5 * sum(sizes) else (lo, mid)
    return [min(2 * s, w * lo) for s, w in zip(sizes, weights)]


def test_targets():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 30):
        sizes, weights = rng.integers(0, 1000, n).tolist(), [(3, 1, 2)[i % 3] for i in range(n)]
        assert np.allclose(mixing.targets(sizes, weights), level(sizes, weights), atol=1e-6)
    assert mixing.targets([0, 0], [3, 1]) == [0, 0] and mixing.targets([], []) == []


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 7, 64, 1000):
        index = np.arange(n)
        for turn in (0, 1):
            key = np.full(n, mixing._key(7, np.array([3]), np.array([turn]))[0], np.uint64)
            assert sorted(mixing.permute(index, np.full(n, n), key)) == list(range(n))
    assert (mixing.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 5, np.uint64)) != np.arange(1000)).mean() > 0.9


def test_every_source_meets_its_goal_word_by_word(spark):
    plan = mixing.plan_mix([5000, 100, 0, 7777, 512, 1], block=64, shards=5)
    rows = mixing.picks(spark, plan).collect()
    for s, goal in enumerate(plan.goal):
        mine = [r for r in rows if r["source_ix"] == s]
        assert sum(r["words"] for r in mine) == goal and len(mine) == plan.slots[s]
        assert len({(r["turn"], r["block"]) for r in mine}) == len(mine)
    by_shard = [sum(r["shard"] == j for r in rows) for j in range(5)]
    assert max(by_shard) - min(by_shard) <= 1
    assert rows == mixing.picks(spark, mixing.plan_mix([5000, 100, 0, 7777, 512, 1], block=64, shards=5)).collect()


def test_whole_table(spark):
    docs = documents(spark)
    got = mixing.taken(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        x = by.setdefault(source[r["doc_id"]], [0, r["target"], 0, r["source_size"]])
        x[0] += r["taken"]
        x[2] += r["size"]
    assert all(abs(x[0] - x[1]) <= 1 and x[2] == x[3] for x in by.values())
    order = sorted(by)
    assert np.allclose([by[s][1] for s in order], level([by[s][2] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {}
    for r in mixed.collect():
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    assert words == {r["doc_id"]: r["taken"] for r in got if r["taken"]}
    assert sorted(map(tuple, mixing.taken(docs).collect())) == sorted(map(tuple, got))


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = mixing.taken(docs).collect()
    assert len(got) == len(hard_rows()) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() > 0
    assert mixing.taken(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
