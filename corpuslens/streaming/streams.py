"""The incremental jobs as Structured Streaming queries over landing folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators import inventory, ledger, secrets
from corpuslens.session import fresh_folder
from corpuslens.streaming.approvals import OpenApprovals

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
FILE_SCHEMA = "repo string, path string, content string, landed_ts timestamp"


def read_events(spark: SparkSession, folder: str, glob: str = "*.parquet", files_per_trigger: int = 1000) -> DataFrame:
    """Run events from a landing folder; ``ts`` becomes a UTC timestamp so that it can carry a watermark."""
    raw = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
           .option("pathGlobFilter", glob).parquet(folder))
    kind = F.col("event_type")
    return raw.select(
        F.concat("user_id", F.lit("-"), F.to_date("ts").cast("string")).alias("run_id"), "user_id", F.col("event_id").alias("sequence"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "signup", "route").when(kind == "view", "read_file").when(kind == "click", "search")
        .when(kind == "error", "invalid_reply").otherwise("edit").alias("event_type"),
        F.floor(F.col("value") * 100).alias("tokens"))


def read_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Continuous inventory; the same content that lands again at the same path within the delay is kept once."""
    inv = inventory.inventory(files.withWatermark("landed_ts", delay))
    return inv.dropDuplicatesWithinWatermark(["repo", "path", "content_hash"]).select(
        "repo", "path", "size_bytes", "class", "selectable", "content_hash", "landed_ts")


def run_tumbling(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    return ledger.tumbling(events.withWatermark("ts", delay), "10 minutes")


def run_sliding(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    return ledger.tumbling(events.withWatermark("ts", delay), "1 hour", "15 minutes")


def run_sessions(events: DataFrame, gap: str = "120 minutes", delay: str = "30 minutes") -> DataFrame:
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", delay).groupBy(s.alias("w"), "user_id").agg(
        F.count("*").alias("events"), F.sum("tokens").alias("tokens")
    ).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events", "tokens")


def approval_ttl(events: DataFrame, ttl_minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """Approvals asked by edits: approved by the user's first search within the time to live, else expired.

    One state per user, with event-time timers: the approvals that are still open, and the searches that a late edit
    may still need, as stretches without a pause of the time to live. An edit inside a stretch is decided by the
    search that follows it; before a stretch only its first search matters. So a state has one stretch per time to
    live of the delay, however many searches there are. An approval is reported when its search comes in, whichever
    of the two comes first, and expires when the watermark has passed all that could decide it. Timers need the
    RocksDB state store; the session is asked for it.
    """
    spark = events.sparkSession
    if "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) or ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = events.withWatermark("ts", delay).where(F.col("event_type").isin("edit", "search")).select(
        "user_id", "ts", F.unix_micros("ts").alias("at"), "sequence", "event_type")
    return kept.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=OpenApprovals(ttl_minutes * 60_000_000), outputStructType="user_id long, approval_id long, state string", outputMode="append", timeMode="eventTime"
    )


def secret_alerts(files: DataFrame, sink: str, checkpoint: str):
    """High findings of newly landed files, appended to a Parquet folder per micro-batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = secrets.secret_findings(batch).where("confidence = 'high'").withColumn("batch_id", F.lit(batch_id))
        # one folder per batch, overwritten, so a batch that is run again leaves no double rows
        found.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def staleness(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Sections made stale by incoming file versions: a stream joined to the recorded references.

    A reference without a hash cannot be checked and is not called stale, as in the batch operators.
    """
    now = F.sha2("content", 256)
    return files.select("repo", "path", now.alias("now")).join(refs, ["repo", "path"]).where(
        F.col("content_hash") != F.col("now")).select("repo", "key", "path")


def observed(files: DataFrame, name: str = "scan") -> DataFrame:
    """The same stream with files and bytes seen so far in its progress records."""
    size: Column = F.octet_length("content")
    return files.observe(name, F.count(F.lit(1)).alias("files_seen"), F.sum(size).alias("bytes_seen"))


def counted(files: DataFrame, folder: str, checkpoint: str):
    """Files and bytes of every micro-batch, kept as one small row per batch in ``folder``.

    Progress records are a ring of the last hundred; these rows stay however many batches there are, also over
    restarts. A batch that is run again replaces its row.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = batch.agg(F.count(F.lit(1)).alias("files_seen"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes_seen"))
        seen.coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def count_to_end(files: DataFrame, name: str = "progress") -> DataFrame:
    """(batch, files_seen, bytes_seen) of every micro-batch over all that has landed."""
    folder = fresh_folder(files.sparkSession, name)
    counted(files, f"{folder}/out", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return files.sparkSession.read.schema("files_seen long, bytes_seen long, batch long").parquet(f"{folder}/out")


def late_split(events: DataFrame, folder: str, checkpoint: str, width: str = "10 minutes", delay: str = "30 minutes"):
    """Every event with its window and whether it came behind the watermark, in ``folder``/rows.

    The watermark of a micro-batch is the latest event time of the batches before it less ``delay``; an event is
    late if its window had been closed by then. A windowed aggregate drops such rows and tells only a number of
    dropped partial groups; here they are a branch of their own and can be counted, looked at or merged. Each batch
    leaves its latest time in ``folder``/marks; a batch that is run again replaces its rows and its mark.
    """
    spark, marks = events.sparkSession, "high timestamp, batch long"
    # a first mark without a time, so that there is always something to read
    spark.createDataFrame([(None,)], "high timestamp").coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        high = spark.read.schema(marks).parquet(f"{folder}/marks").where(F.col("batch") < batch_id).agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("watermark"))
        watermark = high.first()["watermark"]
        closed = F.coalesce(F.col("w.end") <= F.lit(watermark).cast("timestamp"), F.lit(False))
        rows = batch.withColumn("w", F.window("ts", width))
        rows = rows.select("*", F.col("w.start").alias("window_start"), closed.alias("late")).drop("w")
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        done = spark.read.parquet(f"{folder}/rows/batch={batch_id}")
        done.agg(F.max("ts").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def late_counts(rows: DataFrame) -> DataFrame:
    """Per window and type: what came in time and what came late, with its tokens."""
    return rows.groupBy("window_start", "event_type").agg(
        F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"), F.coalesce(F.sum(F.when(F.col("late"), F.col("tokens"))), F.lit(0)).alias("late_tokens"))


def split_to_end(events: DataFrame, name: str = "late", **options) -> DataFrame:
    """``late_split`` over all that has landed: its rows."""
    folder = fresh_folder(events.sparkSession, name)
    late_split(events, folder, f"{folder}/checkpoint", **options).trigger(availableNow=True).start().awaitTermination()
    return events.sparkSession.read.parquet(f"{folder}/rows")


def dropped_by_watermark(progress: list) -> int:
    """Late rows a query dropped, summed over its progress records."""
    total = 0
    for p in progress:
        ops = p["stateOperators"] if isinstance(p, dict) else p.stateOperators
        total += sum((o["numRowsDroppedByWatermark"] if isinstance(o, dict) else o.numRowsDroppedByWatermark) for o in ops)
    return total


def run_to_end(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything that has landed and return what it appended, as a table."""
    return run_recorded(df, name)[0]


def run_recorded(df: DataFrame, name: str) -> tuple[DataFrame, list]:
    """``run_to_end`` with the progress records of the run, the last hundred of them (``counted`` keeps all)."""
    folder = fresh_folder(df.sparkSession, name)
    q = (df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out"), q.recentProgress


def progress_rows(spark: SparkSession, progress: list, name: str = "scan") -> DataFrame:
    """(batch_id, files_seen, bytes_seen) per micro-batch that a run recorded; a few numbers per batch."""
    rows = []
    for p in progress:
        seen = (p["observedMetrics"] if isinstance(p, dict) else p.observedMetrics).get(name)
        if seen is not None:
            get = seen.get if isinstance(seen, dict) else seen.asDict().get
            rows.append((int(p["batchId"] if isinstance(p, dict) else p.batchId), get("files_seen") or 0, get("bytes_seen") or 0))
    return spark.createDataFrame(rows, "batch_id long, files_seen long, bytes_seen long")
