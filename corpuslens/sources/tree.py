"""Reading directory trees and writing results."""

from __future__ import annotations

import os
import stat
import sys
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens import policy as P
from corpuslens.functions import text
from corpuslens.session import durable

# Tasks list folders and read files with this module; it travels to them with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries a task lists below one folder before it hands the rest back to be dealt anew; bytes it gathers for a batch.
ENTRIES, BATCH_BYTES = 20_000, 32 << 20
#: A file that is larger than this does not fit a row.
LARGEST = (1 << 31) - (1 << 20)
_LISTED = "rel string, kind string, size long, modified double, is_symlink boolean, error string"


# ---------------------------------------------------------------- one folder, one file


class Place:
    """A root on any file system: the local one, or what pyarrow opens by URI (hdfs, s3, gs, abfs)."""

    def __init__(self, root: str):
        scheme = urlsplit(root).scheme if "://" in root or root.startswith("file:") else ""
        if scheme in ("", "file"):
            self.files = None
            self.base = os.path.abspath(unquote(urlsplit(root).path) if scheme else root)
        else:
            from pyarrow import fs

            self.files, self.base = fs.FileSystem.from_uri(arrow_uri(root))
            self.base = self.base.rstrip("/")

    def at(self, rel: str) -> str:
        return f"{self.base}/{rel}" if rel else self.base or "/"

    def entries(self, rel: str) -> Iterator[tuple[str, str, int, float, bool]]:
        """(rel, kind, size, modified, is_symlink) of what lies directly in a folder; kind is file, dir or other."""
        if self.files is None:
            with os.scandir(self.at(rel)) as found:
                for e in found:
                    info = e.stat(follow_symlinks=False)
                    link = stat.S_ISLNK(info.st_mode)
                    kind = "dir" if stat.S_ISDIR(info.st_mode) else "file" if link or stat.S_ISREG(info.st_mode) else "other"
                    yield _below(rel, e.name), kind, info.st_size, info.st_mtime, link
            return
        from pyarrow import fs

        for e in self.files.get_file_info(fs.FileSelector(self.at(rel), recursive=False)):
            kind = "dir" if e.type == fs.FileType.Directory else "file" if e.type == fs.FileType.File else "other"
            yield _below(rel, e.base_name), kind, e.size or 0, e.mtime.timestamp() if e.mtime else 0.0, False

    def read(self, rel: str) -> bytes:
        if self.files is None:
            with open(self.at(rel), "rb") as f:
                return f.read()
        with self.files.open_input_stream(self.at(rel)) as f:
            return f.read()


def arrow_uri(root: str) -> str:
    """The URI by which pyarrow knows the same place: s3a and s3n are s3."""
    scheme, rest = root.split("://", 1)
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}"


def _below(rel: str, name: str) -> str:
    return f"{rel}/{name}" if rel else name


def listed(place: Place, start: str, skipped: frozenset[str], free_depth: int, entries: int) -> Iterator[tuple]:
    """Rows of ``_LISTED`` below one folder. After ``entries`` rows, folders not yet entered are handed back as "open".

    Folders named in ``skipped`` are never entered, but for the first ``free_depth`` levels (repositories by name).
    A folder that cannot be listed is an error row, and the walk goes on. Links are not followed.
    """
    queue, seen = [start], 0
    while queue:
        folder = queue.pop()
        if seen >= entries and folder != start:
            yield folder, "open", 0, 0.0, False, None
            continue
        try:
            for rel, kind, size, modified, link in place.entries(folder):
                seen += 1
                if not rel.isascii() and (plain := rel.encode("utf8", "replace").decode("utf8")) != rel:
                    yield plain, "other", size, modified, link, "the name is not UTF-8"
                elif kind == "dir":
                    if rel.count("/") < free_depth or rel.rsplit("/", 1)[-1] not in skipped:
                        queue.append(rel)
                else:
                    yield rel, kind, size, modified, link, None if kind == "file" else "not a regular file"
        except OSError as e:
            yield folder, "dir", 0, 0.0, False, f"the folder could not be listed: {e.strerror or e}"


# ---------------------------------------------------------------- the scan as a job


def listing(spark: SparkSession, root: str, free_depth: int = 0, skipped: frozenset[str] = frozenset(P.SKIPPED_DIRS), entries: int = ENTRIES) -> DataFrame:
    """rel, kind, size, modified, is_symlink, error of everything below ``root``, hidden names too.

    Tasks walk the folders they are dealt; what is too much for one goes back and is dealt to all in the next round.
    Only the number of folders that are still open comes to the driver.
    """
    schema = pa.schema([("rel", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("modified", pa.float64()), ("is_symlink", pa.bool_()), ("error", pa.string())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Place(root)
        for batch in batches:
            for start in batch.column(0).to_pylist():
                rows = []
                for row in listed(place, start, skipped, free_depth, entries):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    found, todo = None, spark.createDataFrame([("",)], "rel string")
    while True:
        step = durable(todo.mapInArrow(walk, _LISTED))
        done, open_ = step.where("kind <> 'open'"), step.where("kind = 'open'").select("rel")
        found = done if found is None else found.unionByName(done)
        if open_.isEmpty():
            return found
        todo = open_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def scanned(spark: SparkSession, root: str, repo: str | None = None, entries: int = ENTRIES) -> DataFrame:
    """repo, path, content, size_bytes, modified_ts, is_symlink, error: one row per file and per failure below ``root``.

    A path that cannot be listed or read is a row with an error and no content; it never fails the scan and is never
    lost. Links have no content and are not followed. Each first-level folder is a repo unless ``repo`` names one.
    """
    free = 0 if repo is not None else 1
    rows = listing(spark, root, free, entries=entries).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rel")
    schema = pa.schema([("rel", pa.string()), ("content", pa.binary()), ("size", pa.int64()), ("modified", pa.float64()), ("is_symlink", pa.bool_()), ("error", pa.string())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Place(root)
        for batch in batches:
            out, held = [], 0
            for rel, _, size, modified, link, error in zip(*(c.to_pylist() for c in batch.columns)):
                content = None
                if error is None and not link:
                    if size > LARGEST:
                        error = f"the file has {size} bytes, more than a row holds"
                    else:
                        try:
                            content = place.read(rel)
                            size = len(content)
                        except OSError as e:
                            error = f"the file could not be read: {e.strerror or e}"
                out.append((rel, content, size, modified, link, error))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)

    read = rows.mapInArrow(load, "rel string, content binary, size long, modified double, is_symlink boolean, error string")
    if repo is None:
        named = [F.substring_index("rel", "/", 1).alias("repo"), F.regexp_replace("rel", "^[^/]*/", "").alias("path")]
    else:
        named = [F.lit(repo).alias("repo"), F.col("rel").alias("path")]
    return read.select(
        *named, "content", F.col("size").alias("size_bytes"), F.col("modified").cast("timestamp").alias("modified_ts"), "is_symlink", text.sanitize_message(F.col("error")).alias("error"))


def scan_tree(spark: SparkSession, root: str, repo: str | None = None) -> DataFrame:
    """One row per readable file below ``root``: repo, path, content (bytes), modified_ts. Depth, size and names do not matter.

    Folders that a scan never enters are not listed at all. What could not be read is in ``tree_issues``.
    """
    return scanned(spark, root, repo).where("error IS NULL AND NOT is_symlink").select("repo", "path", "content", "modified_ts")


def tree_issues(scan: DataFrame) -> DataFrame:
    """The failures of ``scanned`` rows: repo, path, message (without absolute paths)."""
    return scan.where("error IS NOT NULL").select("repo", "path", F.col("error").alias("message"))


def write_bundles(bundles: DataFrame, parts: DataFrame, folder: str) -> None:
    """Bundle text per repo as text files cut between sections, in order of their names, and the facts as JSON."""
    ordered = parts.repartitionByRange("repo", "position").sortWithinPartitions("repo", "position")
    ordered.select("repo", F.col("section").alias("value")).write.mode("overwrite").partitionBy("repo").option("lineSep", "\n").text(f"{folder}/text")
    bundles.write.mode("overwrite").json(f"{folder}/manifest")


def write_parts(parts: DataFrame, folder: str) -> None:
    """Bundles of any size: sections in order, range partitioned by (repo, position)."""
    parts.repartitionByRange("repo", "position").sortWithinPartitions("repo", "position").write.mode("overwrite").parquet(folder)


def report_markdown(results: DataFrame) -> DataFrame:
    """Benchmark results as one Markdown table line per (repo, strategy)."""
    pct = lambda c: F.when(F.col(c).isNull(), "n/a").otherwise(F.concat(F.floor(F.col(c) * 100 + 0.5).cast("string"), F.lit("%")))
    line = F.concat(F.lit("| "), "repo", F.lit(" | "), "strategy", F.lit(" | "), F.col("files_included").cast("string"), F.lit(" | "),
                    pct("precision"), F.lit(" | "), pct("recall"), F.lit(" |"))
    return results.select("repo", "strategy", line.alias("line"))


def write_report(results: DataFrame, folder: str) -> None:
    results.write.mode("overwrite").json(f"{folder}/json")
    report_markdown(results).repartitionByRange("repo", "strategy").sortWithinPartitions("repo", "strategy").select("line").write.mode("overwrite").text(f"{folder}/markdown")
