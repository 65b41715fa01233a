"""A project store of partitioned tables, and the removal of projects with everything that depends on them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "part"
_LAYOUT = "name string, buckets int, schema string"


@dataclass(frozen=True)
class Dependent:
    """A table of the store: the column that ties it to ``parent`` (a project's own tables have none) by ``parent_key``."""

    name: str
    key: str = "repo"
    parent: str | None = None
    parent_key: str = "repo"


#: Children stand before their parents, so a removal that breaks off can still find what is left by the parent.
LEDGER = (Dependent("events", "run_id", "runs", "repo"), Dependent("runs"), Dependent("files"), Dependent("projects"))


def _part(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_store(tables: dict[str, DataFrame], root: str, buckets: int = 64, dependents: tuple[Dependent, ...] = LEDGER, files: int = 8) -> None:
    """Each table below ``root``, in folders by a hash of its key; a folder's rows are spread over up to ``files`` files."""
    for dep in dependents:
        rows = tables[dep.name].withColumn(PART, _part(dep.key, buckets))
        spread = F.pmod(F.xxhash64(*tables[dep.name].columns), F.lit(files))
        rows.repartition(PART, spread).write.mode("overwrite").partitionBy(PART).parquet(f"{root}/{dep.name}")
    layout = [(dep.name, buckets, tables[dep.name].schema.json()) for dep in dependents]
    tables[dependents[0].name].sparkSession.createDataFrame(layout, _LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{root}/_layout")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with its partition column; the schema is the layout's, so a table may have lost its last row."""
    kept = spark.read.schema(_LAYOUT).parquet(f"{root}/_layout").where(F.col("name") == name).first()["schema"]
    return spark.read.schema(T.StructType.fromJson(json.loads(kept)).add(PART, T.IntegerType())).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return _read(spark, root, name).drop(PART)


def _files(spark: SparkSession, path: str):
    """The file system of a path and the path in its terms, whatever the scheme."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    if fs.exists(p) and not fs.delete(p, True):
        raise OSError(f"{path} could not be removed")


def _swap(spark: SparkSession, table: str, staged: str) -> None:
    """Put the staged partitions in place of the old ones and drop those that are left empty.

    The journal was written after the staged rows, so whatever happens here can be done again from the stage.
    """
    journal = spark.read.parquet(f"{staged}/journal").collect()  # one row per touched partition: at most ``buckets``
    if any(r["kept"] for r in journal):
        rows = spark.read.parquet(f"{staged}/rows")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(table)
    for r in journal:
        if not r["kept"]:
            _delete(spark, f"{table}/{PART}={r[PART]}")
    _delete(spark, staged)


def _remove(spark: SparkSession, root: str, dep: Dependent, keys: DataFrame, buckets: int) -> tuple[int, int]:
    """(rows removed, partitions rewritten): the rows of one table whose key is in ``keys``, partition by partition."""
    table, staged = f"{root}/{dep.name}", f"{root}/_staged/{dep.name}"
    keys = keys.select(F.col("key").alias(dep.key)).where(F.col(dep.key).isNotNull()).distinct()
    possible = [r[0] for r in keys.select(_part(dep.key, buckets).alias(PART)).distinct().collect()]
    rows = _read(spark, root, dep.name).where(F.col(PART).isin(possible))  # other partitions are not even opened
    touched = {r[PART]: r["count"] for r in rows.join(keys, dep.key, "left_semi").groupBy(PART).count().collect()}
    if not touched:
        return 0, 0
    _delete(spark, staged)
    before = rows.where(F.col(PART).isin(list(touched)))
    columns = before.columns
    before.join(keys, dep.key, "left_anti").select(*columns).write.partitionBy(PART).parquet(f"{staged}/rows")
    total = {r[PART]: r["count"] for r in before.groupBy(PART).count().collect()}
    kept = {}
    if any(total[p] > n for p, n in touched.items()):
        kept = {r[PART]: r["count"] for r in spark.read.parquet(f"{staged}/rows").groupBy(PART).count().collect()}
    for p, n in touched.items():
        if kept.get(p, 0) != total[p] - n:
            raise RuntimeError(f"{dep.name}, partition {p}: {kept.get(p, 0)} rows staged, {total[p] - n} expected; nothing was replaced")
    journal = spark.createDataFrame([(p, kept.get(p, 0)) for p in touched], f"{PART} int, kept long")
    journal.coalesce(1).write.parquet(f"{staged}/journal")
    _swap(spark, table, staged)
    return sum(touched.values()), len(touched)


def recover(spark: SparkSession, root: str, dependents: tuple[Dependent, ...] = LEDGER) -> list[str]:
    """Finish swaps that broke off after their journal was written, and drop stages without one. Names what it finished."""
    finished = []
    for dep in dependents:
        staged = f"{root}/_staged/{dep.name}"
        if _exists(spark, f"{staged}/journal/_SUCCESS"):
            _swap(spark, f"{root}/{dep.name}", staged)
            finished.append(dep.name)
        else:
            _delete(spark, staged)
    return finished


def forget(spark: SparkSession, root: str, repos: DataFrame, dependents: tuple[Dependent, ...] = LEDGER) -> DataFrame:
    """Remove the projects of ``repos`` (column repo) with all that depends on them.

    Returns one row per table: name, removed, kept, partitions (rewritten). Only partitions that hold such a row are
    rewritten: their other rows are staged by an anti join, counted against the old ones, and swapped in; files of
    all other partitions stay as they are. Children go before parents. Doing it again, also after a run that broke
    off anywhere, removes what is left and touches nothing else; null and unknown names remove nothing.
    """
    recover(spark, root, dependents)
    buckets = spark.read.schema(_LAYOUT).parquet(f"{root}/_layout").first()["buckets"]
    asked = repos.select(F.col("repo").alias("key")).where("key IS NOT NULL").distinct()
    out = []
    for dep in dependents:
        keys = asked
        if dep.parent is not None:
            parent = read_table(spark, root, dep.parent)
            keys = parent.join(asked, parent[dep.parent_key] == asked["key"], "left_semi").select(F.col(dep.key).alias("key"))
        removed, partitions = _remove(spark, root, dep, keys, buckets)
        out.append((dep.name, removed, read_table(spark, root, dep.name).count(), partitions))
    return spark.createDataFrame(out, "table_name string, removed long, kept long, partitions long")
