"""Registered queries: ledger, streams' batch twins, plug-ins, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import plugins
from corpuslens.operators import ledger as L
from corpuslens.operators import retrieve as H
from corpuslens.plans.inventory import TESTP, GENERATED
from corpuslens.plans.registry import query, sql
from corpuslens.plans.retrieval import STRATEGY_SQL, relevant
from corpuslens.session import fresh_folder
from corpuslens.sources import store, tree


def _l(body: str, extra: dict[str, str] | None = None) -> str:
    return sql("run_events runs", extra or {}, body)


def events(t):
    return t.view("run_events")


def runs(t):
    return t.table("runs", lambda: t.view("runs"))


@query("project_list", sql("run_events runs", {}, "SELECT repo, last_opened FROM (SELECT DISTINCT source AS repo FROM documents) d LEFT JOIN (SELECT repo, max(ended_ts) AS last_opened FROM runs WHERE status = 'succeeded' GROUP BY repo) USING (repo)"))
def project_list(t):
    opened = runs(t).where("status = 'succeeded'").groupBy("repo").agg(F.max("ended_ts").alias("last_opened"))
    return L.project_list(t.driver("documents").select(F.col("source").alias("repo")).distinct().join(opened, "repo", "left"))


@query("bundle_history", _l("SELECT repo, run_id, ended_ts, status = 'succeeded' AS has_text, row_number() OVER (PARTITION BY repo ORDER BY ended_ts DESC, run_id) AS rank FROM runs QUALIFY rank <= 5"))
def bundle_history(t):
    return L.latest_per_project(runs(t), "ended_ts", "run_id", 5).select("repo", "run_id", "ended_ts", (F.col("status") == "succeeded").alias("has_text"), "rank")


@query("audit_log", _l("SELECT repo, run_id, status, started_ts, row_number() OVER (PARTITION BY repo ORDER BY started_ts DESC, run_id) AS rank FROM runs QUALIFY rank <= 100"))
def audit_log(t):
    return L.latest_per_project(runs(t), "started_ts", "run_id", 100).select("repo", "run_id", "status", "started_ts", "rank")


@query("latest_context", _l("SELECT repo, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY repo ORDER BY ended_ts DESC, run_id DESC) = 1"))
def latest_context(t):
    return L.latest_context(runs(t))


@query("run_event_order", _l("SELECT run_id, count(*) AS events, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(*) - count(DISTINCT sequence) AS duplicates, max(sequence) - min(sequence) + 1 - count(DISTINCT sequence) AS holes FROM run_events GROUP BY run_id"))
def run_event_order(t):
    return L.run_event_order(events(t))


@query("run_metrics", _l("""SELECT run_id, count(*) FILTER (WHERE event_type='route') AS llm_calls, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_type='read_file') AS retrievals, count(*) FILTER (WHERE event_type='search') AS searches,
 count(*) FILTER (WHERE event_type='invalid_reply') AS corrections, count(*) FILTER (WHERE event_type='edit') AS edits, CAST(coalesce(sum(tokens) FILTER (WHERE event_type='read_file'), 0) AS BIGINT) AS retrieved_tokens FROM run_events GROUP BY run_id"""))
def run_metrics(t):
    return L.run_metrics(events(t))


@query("forget_project", sql("corpus_files run_events runs", {}, """SELECT d.repo, files, coalesce(n_runs, 0) AS runs, coalesce(n_events, 0) AS events FROM (SELECT repo, count(*) AS files FROM corpus_files GROUP BY 1) d LEFT JOIN
 (SELECT r.repo, count(DISTINCT r.run_id) AS n_runs, count(*) AS n_events FROM runs r JOIN run_events e USING (run_id) GROUP BY r.repo) USING (repo)"""))
def forget_project(t):
    return L.forget_project(t.scan.select("repo", "path"), runs(t), events(t))


_GONE = "regexp_matches({x}, '[37]$')"


@query("forget_project_removed", sql("corpus_files run_events runs", {
    "p": "SELECT DISTINCT source AS repo FROM documents",
    "rows": f"""SELECT 'projects' AS table_name, {_GONE.format(x='repo')} AS gone FROM p UNION ALL SELECT 'files', {_GONE.format(x='repo')} FROM corpus_files
 UNION ALL SELECT 'runs', {_GONE.format(x='repo')} AND repo IN (SELECT repo FROM p) FROM runs
 UNION ALL SELECT 'events', run_id IN (SELECT run_id FROM runs WHERE {_GONE.format(x='repo')} AND repo IN (SELECT repo FROM p)) FROM run_events"""},
    "SELECT table_name, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE NOT gone) AS kept, CAST(0 AS BIGINT) AS dependents_left FROM rows GROUP BY table_name"))
def forget_project_removed(t):
    """Projects whose name ends in 3 or 7 are removed from a store of the whole ledger; what is left is read back."""
    root = f"{fresh_folder(t.spark, 'store')}/ledger"
    projects = t.driver("documents").select(F.col("source").alias("repo")).distinct()
    store.write_store({"projects": projects, "files": t.scan.select("repo", "path", "size_bytes", "class", "content_hash"), "runs": runs(t), "events": events(t)}, root, buckets=16)
    gone = projects.where(F.col("repo").rlike("[37]$"))
    runs_gone = runs(t).join(gone, "repo", "left_semi").select("run_id")
    report = store.forget(t.spark, root, gone)
    left = None
    for dep in store.LEDGER:
        keys = runs_gone if dep.key == "run_id" else gone
        n = store.read_table(t.spark, root, dep.name).join(keys, dep.key, "left_semi").agg(F.count("*").alias("dependents_left")).withColumn("table_name", F.lit(dep.name))
        left = n if left is None else left.unionByName(n)
    return report.select("table_name", "removed", "kept").join(left, "table_name")


_APP = {"app": """SELECT e.sequence AS approval_id, e.run_id, e.user_id, e.ts AS created_ts, e.ts + INTERVAL 30 MINUTE AS expires_ts, min(d.ts) AS decided_ts FROM run_events e
 LEFT JOIN run_events d ON d.user_id = e.user_id AND d.event_type = 'search' AND (d.ts > e.ts OR (d.ts = e.ts AND d.sequence > e.sequence)) AND d.ts < e.ts + INTERVAL 30 MINUTE WHERE e.event_type = 'edit' GROUP BY ALL"""}


@query("approvals", _l("SELECT * FROM app", _APP))
def approvals(t):
    return L.approvals(events(t))


@query("approval_state", _l("SELECT approval_id, run_id, CASE WHEN decided_ts <= TIMESTAMP '2024-01-25 12:00:00' THEN 'approved' WHEN created_ts > TIMESTAMP '2024-01-25 12:00:00' THEN 'not_created' WHEN expires_ts <= TIMESTAMP '2024-01-25 12:00:00' THEN 'expired' ELSE 'pending' END AS state FROM app", _APP))
def approval_state(t):
    return L.approval_state(L.approvals(events(t)), "2024-01-25 12:00:00")


@query("run_rollup", _l("SELECT repo, status, model_ordinal, count(*) AS runs, CAST(sum(billed_in) AS BIGINT) AS billed_in, CAST(sum(billed_out) AS BIGINT) AS billed_out, grouping(repo, status, model_ordinal) AS level FROM runs GROUP BY ROLLUP (repo, status, model_ordinal)"))
def run_rollup(t):
    return L.run_rollup(runs(t))


@query("ledger_upsert", _l("""SELECT run_id, min_by(event_type, sequence) AS first_type, min(ts) AS first_ts, max_by(event_type, sequence) AS status, max_by(tokens, sequence) FILTER (WHERE tokens > 100) AS last_large FROM run_events GROUP BY run_id"""))
def ledger_upsert(t):
    v = events(t).select("run_id", "sequence", F.col("event_type").alias("first_type"), F.col("ts").alias("first_ts"),
                         F.col("event_type").alias("status"), F.when(F.col("tokens") > 100, F.col("tokens")).alias("last_large"))
    return L.ledger_upsert(v, "run_id", "sequence", ["first_type", "first_ts"], ["status", "last_large"])


_RET = "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'full_text' WHEN 'assistant' THEN CASE WHEN length(text) > 300 THEN 'metadata' ELSE 'none' END ELSE 'none' END AS retention, text FROM conversations"


@query("retention_projection", sql("", {"r": _RET}, "SELECT conv_id, turn, retention, CASE WHEN retention = 'full_text' THEN text END AS text FROM r WHERE retention <> 'none'"))
def retention_projection(t):
    t._register(["conversations"])
    return L.retention_projection(t.spark.sql(_RET))


# --- batch twins of the streams ---------------------------------------------------

@query("stream_run_tumbling", _l("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS window_end, event_type, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM run_events GROUP BY ALL"))
def stream_run_tumbling(t):
    return L.tumbling(events(t))


@query("stream_run_sliding", _l("""SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
 SELECT *, unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s FROM run_events) GROUP BY ALL"""))
def stream_run_sliding(t):
    return L.tumbling(events(t), "1 hour", "15 minutes")


@query("stream_run_sessions", _l("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 120 MINUTE AS session_end, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
 SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, sequence) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts > lag(ts) OVER w + INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS n FROM run_events WINDOW w AS (PARTITION BY user_id ORDER BY ts, sequence))) GROUP BY user_id, s"""))
def stream_run_sessions(t):
    return L.sessions(events(t))


# --- plug-ins and report ------------------------------------------------------------

@query("predicate_registry", sql("corpus_files", {}, f"SELECT repo, path FROM corpus_files WHERE {TESTP} AND NOT {GENERATED}"))
def predicate_registry(t):
    return t.files.where(plugins.matching(all_of=("test",), none_of=("generated",))(F.col("path"))).select("repo", "path")


_PCT = "coalesce(CAST(floor({c} * 100 + 0.5) AS BIGINT)||'%', 'n/a')"


@query("report_markdown", f"""SELECT repo, strategy, '| '||repo||' | '||strategy||' | '||files_included||' | '||{_PCT.format(c='precision')}||' | '||{_PCT.format(c='recall')}||' |' AS line FROM ({STRATEGY_SQL})""")
def report_markdown(t):
    return tree.report_markdown(H.strategy_benchmark(t.inv, relevant(t)))
