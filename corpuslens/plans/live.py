"""Registered queries: the streams themselves, run over all that has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.plans.bundles import FOUND
from corpuslens.plans.inventory import classified
from corpuslens.plans.ledger import _APP
from corpuslens.plans.registry import query, sql
from corpuslens.plans.review import REFS, section_refs
from corpuslens.session import fresh_folder
from corpuslens.streaming import streams as S


def landed(t, files_per_trigger: int = 3):
    """The scan table as a stream of files, a few per micro-batch; a file lands one second after the one before it."""
    raw = t.spark.readStream.schema(t.scan.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(t.scan_path)
    return raw.select("repo", "path", "content", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("doc_id"))).alias("landed_ts"))


@query("stream_ingest", sql("corpus_files", classified(), "SELECT repo, path, class, content_hash FROM inv"))
def stream_ingest(t):
    return S.run_to_end(S.ingest(landed(t), "1 day"), "ingest").select("repo", "path", "class", "content_hash")


@query("stream_progress", sql("corpus_files", {}, "SELECT count(*) AS files_seen, CAST(sum(strlen(content)) AS BIGINT) AS bytes_seen FROM corpus_files"))
def stream_progress(t):
    return S.count_to_end(landed(t)).agg(F.sum("files_seen").alias("files_seen"), F.sum("bytes_seen").alias("bytes_seen"))


@query("stream_tumbling_closed", sql("run_events", {}, """SELECT window_start, event_type, count(*) AS events, CAST(sum(tokens) AS BIGINT) AS tokens FROM (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start FROM run_events)
 WHERE window_start + INTERVAL 40 MINUTE <= (SELECT max(ts) FROM events) GROUP BY ALL"""))
def stream_tumbling_closed(t):
    got = S.run_to_end(S.run_tumbling(S.read_events(t.spark, t.dir, "events.parquet")), "tumbling")
    return got.select(F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")).alias("window_start"), "event_type", "events", "tokens")


@query("stream_approval_ttl", sql("run_events", _APP, """SELECT user_id, approval_id, CASE WHEN decided_ts IS NULL THEN 'expired' ELSE 'approved' END AS state FROM app
 WHERE decided_ts IS NOT NULL OR time_bucket(INTERVAL 30 MINUTE, created_ts) + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM run_events WHERE event_type IN ('edit', 'search'))"""))
def stream_approval_ttl(t):
    return S.run_to_end(S.approval_ttl(S.read_events(t.spark, t.dir, "events.parquet")), "approvals")


_SLOT = "CAST(floor((date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))) / 5) AS BIGINT) + CASE WHEN sequence % 7 = 0 THEN 1 ELSE 0 END"


def late_events(t):
    """Run events as a stream in the order they land: five days in a slot, every seventh event one slot late.

    One file and one micro-batch per slot; the files' times give the order.
    """
    folder = f"{fresh_folder(t.spark, 'landing')}/in"
    days = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    slot = (F.floor(days / 5) + F.when(F.col("sequence") % 7 == 0, 1).otherwise(0)).cast("long")
    t.view("run_events").withColumn("slot", slot).repartition("slot").write.partitionBy("slot").parquet(folder)
    order_by_slot(t.spark, folder)
    schema = "run_id string, user_id long, sequence long, ts timestamp_ntz, event_type string, tokens long, slot long"
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def order_by_slot(spark, folder: str) -> None:
    """Give the files of each slot a time of their own, a second after the slot before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for of_slot in fs.listStatus(path):
        name = of_slot.getPath().getName()
        if name.startswith("slot="):
            for file in fs.listStatus(of_slot.getPath()):
                fs.setTimes(file.getPath(), (1_700_000_000 + int(name[5:])) * 1000, -1)


@query("stream_late_data", sql("run_events", {"landed": f"SELECT *, {_SLOT} AS slot, time_bucket(INTERVAL 10 MINUTE, ts) AS window_start FROM run_events",
    "marks": "SELECT slot, max(max(ts)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTE AS watermark FROM landed GROUP BY slot"},
    """SELECT window_start, event_type, count(*) FILTER (WHERE NOT late) AS on_time, count(*) FILTER (WHERE late) AS late, CAST(coalesce(sum(tokens) FILTER (WHERE late), 0) AS BIGINT) AS late_tokens
 FROM (SELECT l.*, coalesce(window_start + INTERVAL 10 MINUTE <= watermark, FALSE) AS late FROM landed l JOIN marks USING (slot)) GROUP BY ALL"""))
def stream_late_data(t):
    got = S.late_counts(S.split_to_end(late_events(t)))
    return got.withColumn("window_start", F.to_timestamp_ntz(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss")))


@query("stream_secret_alerts", sql("corpus_files", FOUND, "SELECT repo, path, line_no, rule FROM found WHERE confidence = 'high'"))
def stream_secret_alerts(t):
    folder = fresh_folder(t.spark, "alerts")
    q = S.secret_alerts(landed(t), f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.parquet(f"{folder}/out").select("repo", "path", "line_no", "rule")


@query("stream_staleness", sql("corpus_files snap_base snap_worktree", {**REFS, "old": "SELECT repo, path, key, sha256(content) AS content_hash FROM (SELECT r.repo, r.path, r.key, w.content FROM section_refs r JOIN snap_worktree w ON w.repo = r.repo AND w.path = r.path)"},
       "SELECT o.repo, o.key, o.path FROM old o JOIN corpus_files c ON c.repo = o.repo AND c.path = o.path WHERE o.content_hash <> sha256(c.content)"))
def stream_staleness(t):
    refs = section_refs(t).select("repo", "path", "key").join(t.view("snap_worktree").select("repo", "path", F.sha2("content", 256).alias("content_hash")), ["repo", "path"])
    return S.run_to_end(S.staleness(landed(t), refs), "staleness")
