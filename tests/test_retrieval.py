import math

from support import as_files

from corpuslens.operators import retrieve as H
from corpuslens.operators.inventory import inventory


def files(spark, tree):
    return inventory(as_files(spark, tree)).where("selectable").select("repo", "path", "size_bytes", "content")


def brute(query, tree, pins, diffs):
    import re

    terms = {t for t in (re.sub(r"^[\W_]+|[\W_]+$", "", w) for w in query.lower().split()) if len(t.encode()) >= 3}
    out = []
    for p, c in tree.items():
        s = (p in pins) * 1.0 + (p in diffs) * 0.8
        s += 0.5 * (sum(t in p.lower() for t in terms) / max(len(terms), 1)) + 0.4 * (sum(t in c.lower() for t in terms) / max(len(terms), 1))
        if s >= 0.15:
            out.append((-s, p))
    return [(p, math.floor(-s * 100 + 0.5) / 100) for s, p in sorted(out)[:20]]


def test_ranking_equals_brute_force(spark):
    words = ["token", "login", "verify", "math", "add", "sessions", "éa", "the", "authentic", "x1"]
    tree = {f"{words[i % 7]}/{words[(i * 3) % 10]}_{i}.rs": " ".join(words[(i * k) % 10] for k in range(1, 6)) for i in range(60)}
    pins, diffs = {list(tree)[3], list(tree)[40]}, set(list(tree)[10:35])
    qs = ["Fix the login token!", "éa auth", "math", "no hit whatsoever zz"]
    queries = spark.createDataFrame([(i, "r", q) for i, q in enumerate(qs)], "query_id int, repo string, query string")
    path_df = lambda ps: spark.createDataFrame([("r", p) for p in ps], "repo string, path string")
    got = H.rank_context(queries, files(spark, tree), path_df(pins), path_df(diffs), 20).orderBy("query_id", "rank").collect()
    for i, q in enumerate(qs):
        assert [(r.path, r.score) for r in got if r.query_id == i] == brute(q, tree, pins, diffs), q


def test_disabled_falls_back_to_pins(spark):
    f = files(spark, {"a.rs": "x", "b.rs": "y"})
    pins = spark.createDataFrame([("r", "b.rs")], "repo string, path string")
    assert [(r.path, r.score) for r in H.rank_disabled(f, pins).collect()] == [("b.rs", 1.0)]


def test_search(spark):
    f = files(spark, {"src/a.ts": "one\n  Needle here  \n", "lib/b.ts": "needle\n", "src/c.ts": "needle\n" * 50})
    got = H.search_lines(f, "NEEDLE", "src").orderBy("path", "line_no").collect()
    assert len(got) == 51 and got[0].snippet == "Needle here" and got[0].path == "src/a.ts" and [r.position for r in got] == list(range(1, 52))


def test_only_texts_that_can_reach_the_bar_are_matched(spark, monkeypatch):
    tree = {f"top_{i:02}.rs": f"needle near{i}" for i in range(20)} | {f"low_{i:02}.rs": f"needle far{i}" for i in range(30)}
    queries = spark.createDataFrame([(1, "r", "needle"), (2, "r", "low_07")], "query_id int, repo string, query string")
    tops = spark.createDataFrame([("r", p) for p in tree if p.startswith("top")], "repo string, path string")
    asked, plain = [], H.substring_matches

    def seen(terms, units):
        asked.append({r.unit for r in units.collect()})
        return plain(terms, units)

    monkeypatch.setattr(H, "substring_matches", seen)
    f = files(spark, tree)
    got = H.rank_context(queries, f, tops, tops, 20, index=H.content_index(f)).orderBy("query_id", "rank").collect()
    for i, q in ((1, "needle"), (2, "low_07")):
        assert [(r.path, r.score) for r in got if r.query_id == i] == brute(q, tree, set(tops.toPandas().path), set(tops.toPandas().path)), q
    assert {"needle", "near3"} <= asked[1] and not any(u.startswith("far") for u in asked[1])


def test_index_counts_tokens(spark):
    f = spark.createDataFrame([("r", "a", " B a\tb \n b c"), ("r", "e", " "), ("r", "n", None)], "repo string, path string, content string")
    assert [(r.path, [(p.unit, p.n) for p in r.postings]) for r in H.content_index(f).collect()] == [("a", [("a", 1), ("b", 3), ("c", 1)])]
    assert sorted((r.unit, r.n) for r in H.content_postings(f).collect()) == [("a", 1), ("b", 3), ("c", 1)]
