import random

from corpuslens.llm import packing
from llm_support import documents, hard_docs, hard_rows


def brute(items, capacity, per_source):
    """Best fit by looking at all bins."""
    bins, out = [], []
    for size, source, cluster in items:
        fits = [b for b in bins if b["left"] >= size and b["left"] > 0 and b["sources"].count(source) < per_source and cluster not in b["clusters"]]
        b = min(fits, key=lambda b: (b["left"], b["n"])) if fits else None
        if b is None:
            b = {"n": len(bins), "left": capacity, "sources": [], "clusters": set()}
            bins.append(b)
        out.append((b["n"], capacity - b["left"]))
        b["left"] -= size
        b["sources"].append(source)
        b["clusters"].add(cluster)
    return out


def test_group_against_all_bins():
    rng = random.Random(8)
    for per_source in (1, 2, 4):
        items = [(rng.randint(0, 100), rng.choice(["a", "a", "b", "c", None]), rng.choice([*range(200), 0, 0, 0])) for _ in range(400)]
        items.sort(key=lambda x: -x[0])
        assert packing.pack_group(*map(list, zip(*items)), 100, per_source) == brute(items, 100, per_source)


def test_whole_table(spark):
    docs = documents(spark)
    rows = packing.pack(docs, group_words=20_000).collect()
    words = {r["doc_id"]: len(r["text"].encode().split()) for r in docs.collect()}
    bins, sums = {}, {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["size"]
    assert sums == words
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: (r["offset"], r["size"])):
            assert r["offset"] == at
            at += r["size"]
        assert at <= packing.CAPACITY
        assert len({r["digest"] for r in members}) == len(members)
        assert max([r["source"] for r in members].count(s["source"]) for s in members) <= packing.PER_SOURCE
    assert sum(words.values()) / (packing.CAPACITY * len(bins)) > 0.85
    texts = packing.packed_texts(docs).collect()
    assert all(len(r["text"].encode().split()) == r["size"] for r in texts) and len(texts) == len(rows)


def test_hard_rows(spark):
    docs = hard_docs(spark)
    got = packing.packed(docs)
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in hard_rows()}
    assert got.columns == ["doc_id", "source", "piece", "start", "size", "bin_id", "offset"]
    assert packing.packed_texts(docs).count() == got.count()
    assert packing.packed(docs.limit(0)).count() == 0
