import zlib

from corpuslens.llm.sharding import shard
from llm_support import documents, hard_docs, hard_rows


def smallest_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n, left = 1, mid
        for s in sizes:
            if s > left:
                n, left = n + 1, mid
            left -= s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def verify(rows, texts):
    groups, shards = {}, {}
    for r in rows:
        groups.setdefault(texts(r), []).append(r)
        shards.setdefault(r["shard"], []).append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 8
    for members in groups.values():
        assert len({r["shard"] for r in members}) == 1
    for members in shards.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    order = sorted(groups.values(), key=lambda g: min(r["doc_id"] for r in g))
    assert max(sum(r["size"] for r in s) for s in shards.values()) == smallest_capacity([sum(r["size"] for r in g) for g in order], 8)
    assert [g[0]["shard"] for g in order] == sorted(g[0]["shard"] for g in order)


def test_whole_table(spark):
    docs = documents(spark)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = shard(docs).collect()
    assert len(rows) == len(text)
    verify(rows, lambda r: text[r["doc_id"]])
    for r in rows:
        data = text[r["doc_id"]].encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data)


def test_hot_group_and_few_groups(spark):
    docs = spark.createDataFrame([(i, "x" * 50 if i % 3 == 0 else f"text {i}") for i in range(200)], "doc_id long, text string")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    verify(shard(docs).collect(), lambda r: text[r["doc_id"]])
    few = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    rows = shard(few).collect()
    assert sorted(r["size"] for r in rows) == [1, 2, 2] and len({r["shard"] for r in rows}) >= 2


def test_hard_rows(spark):
    docs = hard_docs(spark)
    rows = shard(docs).collect()
    assert len(rows) == len(hard_rows())
    assert {r["text_crc32"] for r in rows if r["size"] == 1} == {0}
    assert shard(docs.limit(0)).count() == 0
