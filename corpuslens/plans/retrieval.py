"""Registered queries: retrieval and search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from corpuslens.operators import analyze as A
from corpuslens.operators import inventory as I
from corpuslens.operators import render as R
from corpuslens.operators import retrieve as H
from corpuslens.plans.bundles import BUNDLES, LINES_CTE, chosen
from corpuslens.plans.index import RENDER, section_rows
from corpuslens.plans.inventory import classified
from corpuslens.plans.registry import query, sql

# Each benchmark item is a request made inside one repository.
QS = {"queries": "SELECT item_id AS query_id, 'src'||(item_id % 20) AS repo, text AS query FROM benchmark"}
TERMS = {**QS, "terms": r"SELECT DISTINCT query_id, repo, term FROM (SELECT query_id, repo, regexp_replace(unnest(string_split_regex(lower(query), '\s+')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS term FROM queries) WHERE strlen(term) >= 3"}


def queries_of(t):
    return t.driver("benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("repo"), F.col("text").alias("query"))


def pins(t):
    lab = t.driver("labels").where("quality = 1 AND toxic = 1")
    return t.scan.select("doc_id", "repo", "path").join(lab, "doc_id").select("repo", "path")


def changed(t):
    return t.scan.where("lang IN ('de', 'fr') AND n_chars >= 200").select("repo", "path")


@query("query_terms", sql("", TERMS, "SELECT * FROM terms"))
def query_terms(t):
    return H.query_terms(queries_of(t))


_RANK = {**classified(), **TERMS,
    "tn": "SELECT query_id, repo, list(term) AS ts FROM terms GROUP BY query_id, repo",
    "pr": """SELECT q.query_id, f.repo, f.path, f.size_bytes, len(ts) AS n, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND quality = 1 AND toxic = 1) THEN 1 ELSE 0 END AS pin,
 CASE WHEN f.lang IN ('de','fr') AND f.n_chars >= 200 THEN 1 ELSE 0 END AS diff, len(list_filter(ts, lambda x: contains(lower(f.path), x))) AS pm, len(list_filter(ts, lambda x: contains(lower(f.content), x))) AS cm
 FROM tn q JOIN inv f ON f.repo = q.repo AND f.selectable""",
    "sc": "SELECT *, pin * 1.0::DOUBLE + diff * 0.8::DOUBLE + 0.5::DOUBLE * (pm / n::DOUBLE) + 0.4::DOUBLE * (cm / n::DOUBLE) AS s FROM pr",
    "rk": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, path) AS rank FROM sc WHERE s >= 0.15::DOUBLE QUALIFY rank <= 20"}


def text_index(t):
    """The inverted index of the selectable files, one row per file, stored once for an input."""
    return t.table("content_index", lambda: H.content_index(chosen(t)))


def index_units(t):
    """The distinct tokens of the index, stored once for an input."""
    return t.table("posting_units", lambda: H.flat_postings(text_index(t)).select("unit").distinct())


@query("rank_context", sql("corpus_files", _RANK, """SELECT query_id, repo, rank, path, round(s * 100.0::DOUBLE) / 100.0::DOUBLE AS score, array_to_string(list_filter([CASE WHEN pin = 1 THEN 'pinned by the user' END, CASE WHEN diff = 1 THEN 'changed since the base' END,
 CASE WHEN pm > 0 THEN 'terms in path: '||pm END, CASE WHEN cm > 0 THEN 'terms in text: '||cm END], lambda x: x IS NOT NULL), '; ') AS reasons, size_bytes, size_bytes // 4 AS est_tokens FROM rk"""))
def rank_context(t):
    return H.rank_context(queries_of(t), chosen(t), pins(t), changed(t), 20, index=text_index(t))


@query("rank_context_disabled", sql("corpus_files", classified(), "SELECT repo, path, 1.0::DOUBLE AS score, 'pinned by the user' AS reasons, size_bytes, size_bytes // 4 AS est_tokens FROM inv JOIN labels USING (doc_id) WHERE selectable AND quality = 1 AND toxic = 1"))
def rank_context_disabled(t):
    return H.rank_disabled(chosen(t), pins(t))


_BM = {**classified(), **QS,
    "qt": r"SELECT DISTINCT query_id, repo, term FROM (SELECT query_id, repo, unnest(string_split_regex(lower(query), '[^\p{L}\p{N}]+')) AS term FROM queries) WHERE term <> ''",
    "dw": r"SELECT repo, path, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM inv WHERE selectable",
    "st": "SELECT repo, count(*) AS n_docs, sum(len(w)) / count(*) AS avg_len FROM dw GROUP BY repo",
    "tf": "SELECT repo, path, len, term, count(*) AS tf FROM (SELECT repo, path, len(w) AS len, unnest(w) AS term FROM dw) GROUP BY ALL",
    "dfr": "SELECT repo, term, count(*) AS df FROM tf GROUP BY repo, term",
    "bs": "SELECT q.query_id, q.repo, tf.path, round(sum(ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score FROM qt q JOIN tf ON tf.repo = q.repo AND tf.term = q.term JOIN dfr ON dfr.repo = tf.repo AND dfr.term = tf.term JOIN st ON st.repo = tf.repo GROUP BY 1, 2, 3"}


@query("rank_context_bm25", sql("corpus_files", _BM, "SELECT query_id, repo, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM bs QUALIFY rank <= 20"))
def rank_context_bm25(t):
    lengths = t.table("word_lengths", lambda: H.word_lengths(chosen(t)))
    return H.rank_bm25(queries_of(t), chosen(t), 20, postings=H.flat_postings(text_index(t)), units=index_units(t), lengths=lengths)


@query("search_lines", sql("corpus_files", LINES_CTE, r"SELECT repo, path, line_no, row_number() OVER (PARTITION BY repo ORDER BY path, line_no) AS position, regexp_replace(line, '^\s+|\s+$', '', 'g') AS snippet FROM lines WHERE contains(lower(line), 'th')"))
def search_lines(t):
    return H.search_lines(t.files, "Th")


@query("memory_recall", sql("run_events runs", {"m": "SELECT run_id AS memory_id, repo, ended_ts AS created_ts, ended_ts + INTERVAL 10 DAY AS expires_ts FROM runs"},
       "SELECT memory_id, repo, row_number() OVER (PARTITION BY repo ORDER BY created_ts DESC, memory_id) AS rank FROM m WHERE expires_ts > TIMESTAMP '2024-01-20 00:00:00' QUALIFY rank <= 5"))
def memory_recall(t):
    m = t.view("runs").select(F.col("run_id").alias("memory_id"), "repo", F.col("ended_ts").alias("created_ts"), F.expr("ended_ts + INTERVAL 10 DAY").alias("expires_ts"))
    return H.memory_recall(m, "2024-01-20 00:00:00", 5).select("memory_id", "repo", "rank")


def relevant(t):
    lab = t.driver("labels").where("quality = 1")
    return t.scan.select("doc_id", "repo", "path").join(lab, "doc_id").select("repo", "path")


STRATEGY_SQL = sql("corpus_files", {**classified(),
    "rel": "SELECT repo, path FROM corpus_files JOIN labels USING (doc_id) WHERE quality = 1",
    "c": "SELECT coalesce(i.repo, r.repo) AS repo, count(*) FILTER (WHERE i.selectable) AS a, count(r.path) AS t, count(*) FILTER (WHERE i.selectable AND r.path IS NOT NULL) AS h FROM inv i FULL JOIN rel r ON r.repo = i.repo AND r.path = i.path GROUP BY 1"},
    """SELECT repo, 'raw_all' AS strategy, a AS files_included, CASE WHEN a > 0 THEN h / a END AS precision, CASE WHEN t > 0 THEN h / t END AS recall, t - h AS missed_files FROM c
 UNION ALL SELECT repo, s, h, CASE WHEN h > 0 THEN 1.0 END, CASE WHEN t > 0 THEN h / t END, t - h FROM c CROSS JOIN (SELECT unnest(['user_pinned','hybrid']) AS s) UNION ALL SELECT repo, 'deterministic_map', 0, NULL, NULL, 0 FROM c""")


@query("strategy_benchmark", STRATEGY_SQL)
def strategy_benchmark(t):
    return H.strategy_benchmark(t.inv, relevant(t))


def _renamed(ctes: dict[str, str], prefix: str) -> dict[str, str]:
    """The same CTEs under names of their own."""
    names = re.compile(r"\b(FROM|JOIN) (" + "|".join(ctes) + r")\b")
    return {prefix + k: names.sub(lambda m: f"{m[1]} {prefix}{m[2]}", v) for k, v in ctes.items()}


_PINNED = _renamed({**BUNDLES, "chosen": "SELECT i.* FROM inv i WHERE selectable AND EXISTS (SELECT 1 FROM corpus_files c JOIN labels USING (doc_id) WHERE quality = 1 AND c.repo = i.repo AND c.path = i.path)"}, "pin_")


@query("strategy_cost", sql("corpus_files", {**classified(), **BUNDLES, **_PINNED}, " UNION ALL ".join(
    f"SELECT repo, '{s}' AS strategy, sbytes + strlen(pre) AS bytes, CAST(toks + strlen(pre)//4 AS BIGINT) AS tokens FROM {v}" for s, v in (("raw_all", "bundles"), ("user_pinned", "pin_bundles")))))
def strategy_cost(t):
    return H.strategy_cost({"raw_all": R.bundle(chosen(t)), "user_pinned": R.bundle(pinned_files(t))})


def pinned_files(t):
    return chosen(t).join(relevant(t).distinct(), ["repo", "path"], "left_semi")


@query("strategy_cost_map", sql("corpus_files", {**classified(), **RENDER, **_PINNED,
    "size": "SELECT repo, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes FROM doc GROUP BY repo"}, """SELECT repo, 'deterministic_map' AS strategy, bytes, bytes // 4 AS tokens FROM size
 UNION ALL SELECT s.repo, 'hybrid', CAST(s.bytes + coalesce(p.sbytes + strlen(p.pre), 0) AS BIGINT), CAST(s.bytes // 4 + coalesce(p.toks + strlen(p.pre) // 4, 0) AS BIGINT) FROM size s LEFT JOIN pin_bundles p USING (repo)"""))
def strategy_cost_map(t):
    """The two strategies that send the context document."""
    document = A.context_render(A.complete_sections(section_rows(t), t.inv.select("repo").distinct()), I.source_revision(t.inv))
    return H.map_cost(document, R.bundle(pinned_files(t)))


@query("missing_ground_truth", sql("corpus_files snap_worktree", {}, "SELECT repo, path FROM corpus_files JOIN labels USING (doc_id) WHERE quality = 1 AND n_chars < 200 UNION SELECT source, 'docs/gone_'||doc_id||'.md' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1"))
def missing_ground_truth(t):
    gone = t.driver("labels").where("toxic = 1").join(t.driver("documents").select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("repo"), F.concat(F.lit("docs/gone_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return H.missing_ground_truth(relevant(t).unionByName(gone), t.view("snap_worktree"))


@query("tokens_avoided", sql("corpus_files run_events runs", {**classified(), "rt": "SELECT repo, CAST(sum(size_bytes) AS BIGINT) // 4 AS repository_tokens FROM inv WHERE selectable GROUP BY repo"},
       "SELECT run_id, r.repo, repository_tokens, billed_in AS sent_tokens, greatest(repository_tokens - billed_in, 0) AS tokens_avoided, CASE WHEN repository_tokens > 0 THEN greatest(repository_tokens - billed_in, 0) / repository_tokens ELSE 0.0 END AS ratio FROM runs r JOIN rt USING (repo)"))
def tokens_avoided(t):
    return H.tokens_avoided(t.view("runs").select("run_id", "repo", F.col("billed_in").alias("sent_tokens")), t.inv)
