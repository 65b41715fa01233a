"""Ledger analytics over runs, their events and approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import ordering


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever zone the session has."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def project_list(projects: DataFrame) -> DataFrame:
    """Newest opened first, never opened last, then by name."""
    return projects.orderBy(F.desc_nulls_last("last_opened"), F.asc("repo"))


def latest_per_project(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """Last ``n`` records per repo; used for bundle history and the audit log."""
    return ordering.top_k(df, ["repo"], [F.desc(time), F.asc(key)], n)


def latest_context(docs: DataFrame) -> DataFrame:
    """The newest document per repo: one aggregate, no sort."""
    newest = F.max_by(F.struct("run_id", "status"), F.struct("ended_ts", "run_id"))
    return docs.groupBy("repo").agg(newest.alias("d")).select("repo", "d.run_id", "d.status")


def run_event_order(events: DataFrame) -> DataFrame:
    """Per run: events, first and last sequence, duplicates and holes of (run_id, sequence)."""
    once = events.groupBy("run_id", "sequence").agg(F.count("*").alias("n"))
    return once.groupBy("run_id").agg(
        F.sum("n").alias("events"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"),
        F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)).alias("duplicates"),
        (F.max("sequence") - F.min("sequence") + 1 - F.count("*")).alias("holes"))


def run_metrics(events: DataFrame) -> DataFrame:
    """Per run: calls, tokens, retrievals, searches, corrections, edits. Folded map-side."""
    kind = F.col("event_type")
    return events.groupBy("run_id").agg(
        F.count_if(kind == "route").alias("llm_calls"), F.sum("tokens").alias("tokens"),
        F.count_if(kind == "read_file").alias("retrievals"), F.count_if(kind == "search").alias("searches"),
        F.count_if(kind == "invalid_reply").alias("corrections"), F.count_if(kind == "edit").alias("edits"),
        F.coalesce(F.sum(F.when(kind == "read_file", F.col("tokens"))), F.lit(0)).alias("retrieved_tokens"))


def forget_project(files: DataFrame, runs: DataFrame, events: DataFrame) -> DataFrame:
    """Dependents that removing each repo would delete."""
    per_run = events.groupBy("run_id").agg(F.count("*").alias("n"))
    r = runs.join(per_run, "run_id", "left").groupBy("repo").agg(F.count("*").alias("runs"), F.sum("n").alias("events"))
    f = files.groupBy("repo").agg(F.count("*").alias("files"))
    zero = F.lit(0).cast("long")
    return f.join(r, "repo", "left").select("repo", "files", F.coalesce("runs", zero).alias("runs"), F.coalesce("events", zero).alias("events"))


def approvals(events: DataFrame, ttl_minutes: int = 30) -> DataFrame:
    """Every edit asks for approval; the user's first search within the time to live decides it.

    Events are put into buckets of the time to live and each edit also looks into the following one, so a user with
    any number of events is spread over time. The stream ``approval_ttl`` follows the same rule.
    """
    ttl = ttl_minutes * 60
    bucket = F.floor(micros(F.col("ts")) / (ttl * 1_000_000))
    e = events.where(F.col("event_type").isin("edit", "search")).select("run_id", "user_id", "sequence", "ts", "event_type", bucket.alias("b"))
    spread = e.withColumn("own", F.explode(F.array(F.col("b"), F.col("b") - 1)))
    later = Window.partitionBy("user_id", "own").orderBy("ts", "sequence").rowsBetween(1, Window.unboundedFollowing)
    nxt = spread.withColumn("next_ts", F.min(F.when(F.col("event_type") == "search", F.col("ts"))).over(later))
    asked = nxt.where((F.col("event_type") == "edit") & (F.col("own") == F.col("b")))
    expires = F.col("ts") + F.make_dt_interval(mins=F.lit(ttl_minutes))
    return asked.select(
        F.col("sequence").alias("approval_id"), "run_id", "user_id", F.col("ts").alias("created_ts"), expires.alias("expires_ts"),
        F.when(F.col("next_ts") < expires, F.col("next_ts")).alias("decided_ts"))


def approval_state(asked: DataFrame, now: str) -> DataFrame:
    """approved, pending or expired at ``now``."""
    t = F.lit(now).cast("timestamp_ntz")
    state = (F.when(F.col("decided_ts") <= t, "approved").when(F.col("created_ts") > t, "not_created")
             .when(t >= F.col("expires_ts"), "expired").otherwise("pending"))
    return asked.select("approval_id", "run_id", state.alias("state"))


def run_rollup(runs: DataFrame) -> DataFrame:
    """Runs and tokens by repo, status and model with all subtotals."""
    return runs.rollup("repo", "status", "model_ordinal").agg(
        F.count("*").alias("runs"), F.sum("billed_in").alias("billed_in"), F.sum("billed_out").alias("billed_out"),
        F.grouping_id().alias("level"))


def ledger_upsert(versions: DataFrame, key: str, version: str, kept: list[str], replaced: list[str]) -> DataFrame:
    """Insert or update by key: ``kept`` columns stay as first written, ``replaced`` take the last non-null value.

    An aggregate instead of a ranking window: versions of a hot key are folded
    map-side before anything is shuffled.
    """
    first = F.min_by(F.struct(*kept), F.col(version))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in replaced]
    return versions.groupBy(key).agg(first.alias("_k"), *last).select(key, "_k.*", *replaced)


def retention_projection(records: DataFrame) -> DataFrame:
    """History keeps nothing, metadata or full text, by the ``retention`` of each record."""
    kept = records.where("retention <> 'none'")
    return kept.withColumn("text", F.when(F.col("retention") == "full_text", F.col("text")))


def tumbling(events: DataFrame, width: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events, tokens and errors per time window and type; batch or stream."""
    win = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(win.alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.sum("tokens").alias("tokens")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "events", "tokens")


def sessions(events: DataFrame, gap_minutes: int = 120) -> DataFrame:
    """Sessions per user: a pause longer than the gap starts a new one.

    Events of one minute always share a session, so they are folded to one
    row first; what is ordered per user is bounded by the minutes of the
    period, not by the number of events.
    """
    minute = F.floor(micros(F.col("ts")) / 60_000_000)
    folded = events.groupBy("user_id", minute.alias("m")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("z"), F.count("*").alias("n"), F.sum("tokens").alias("t"))
    w = Window.partitionBy("user_id").orderBy("m")
    new = F.coalesce(F.col("a") > F.lag("z").over(w) + F.make_dt_interval(mins=F.lit(gap_minutes)), F.lit(True))
    numbered = folded.withColumn("new", new.cast("int")).withColumn("s", F.sum("new").over(w))
    return numbered.groupBy("user_id", "s").agg(
        F.min("a").alias("session_start"), (F.max("z") + F.make_dt_interval(mins=F.lit(gap_minutes))).alias("session_end"),
        F.sum("n").alias("events"), F.sum("t").alias("tokens")).drop("s")
