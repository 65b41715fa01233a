"""Session helpers: local session for tests, durable lineage cuts for clusters."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "corpuslens") -> SparkSession:
    """A single-machine session for tests and bench; clusters bring their own session."""
    n = cores or os.cpu_count() or 8
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORPUSLENS_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, and only in local mode, a temporary folder of
    this machine takes its place.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslens-checkpoint-"))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, key: str, build) -> DataFrame:
    """``build()`` written once per session as Parquet in the shared folder, then read back.

    Readers prune columns and push filters down to the files, and a lost
    executor re-reads its files instead of recomputing what led to them.
    """
    return spark.read.parquet(stored_path(spark, key, build))


def stored_path(spark: SparkSession, key: str, build) -> str:
    app = spark.sparkContext.applicationId
    if (app, key) not in _STORED:
        name = hashlib.sha256(key.encode()).hexdigest()[:16]
        path = f"{shared_dir(spark)}/tables/{app}/{name}"
        build().write.mode("overwrite").parquet(path)
        _STORED[(app, key)] = path
    return _STORED[(app, key)]


def fingerprint(spark: SparkSession, folder: str, names: list[str]) -> str:
    """A short name of the files that the named tables of a folder consist of: paths, sizes, modification times."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    seen = []
    for name in names:
        top = path(folder, name)
        if not fs.exists(top):
            continue
        for f in [fs.getFileStatus(top)] if fs.getFileStatus(top).isFile() else fs.listStatus(top):
            seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, for the output and the checkpoint of one stream run."""
    return f"{shared_dir(spark)}/streams/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
