"""Selection algebra: what was picked, what is allowed, what is missing or refused.

``spec`` is a long table (scope…, repo, kind, path) with kind one of file,
directory, excluded, override. ``by`` names extra scope columns, so many
presets resolve in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import paths
from corpuslens.operators.inventory import class_label

NEVER_OVERRIDABLE = ["unreadable", "unsupported_encoding"]


def _kind(spec: DataFrame, kind: str, by: tuple[str, ...] = ()) -> DataFrame:
    return spec.where(F.col("kind") == kind).select(*by, "repo", "path").distinct()


def _directories(spec: DataFrame, by: tuple[str, ...]) -> DataFrame:
    d = _kind(spec, "directory", by)
    return d.select(*by, "repo", F.col("path").alias("asked"), F.rtrim("path", F.lit("/")).alias("dir"))


def _chain(directory: Column) -> Column:
    """The directory, those above it, and the root as ''."""
    own = F.when(directory != "", paths.ancestors(F.concat(directory, F.lit("/x")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("")), own)


def _reached(inv: DataFrame, spec: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Directories of selectable files (by…, repo, own) that lie in or below a picked one.

    The path join is made on distinct directories, so a file is never repeated for each of its ancestors.
    """
    own = inv.where("selectable").select("repo", paths.directory(F.col("path")).alias("own")).distinct()
    picks = _directories(spec, by).select(*by, "repo", "dir").distinct()
    return own.select("repo", "own", F.explode(_chain(F.col("own"))).alias("dir")).join(picks, ["repo", "dir"]).select(*by, "repo", "own").distinct()


def select_directories(inv: DataFrame, spec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Selectable files below a picked directory, minus hand-made removals. A flat directory with very many files is a
    skewed join key of one small row, which adaptive execution splits."""
    files = inv.where("selectable").select("repo", "path", "size_bytes", paths.directory(F.col("path")).alias("own"))
    below = files.join(_reached(inv, spec, by), ["repo", "own"])
    excluded = _kind(spec, "excluded", by)
    return below.select(*by, "repo", "path", "size_bytes").join(excluded, [*by, "repo", "path"], "left_anti")


def _picked(inv: DataFrame, spec: DataFrame, by: tuple[str, ...]) -> DataFrame:
    wanted = _kind(spec, "file", by).join(_kind(spec, "excluded", by), [*by, "repo", "path"], "left_anti")
    overrides = _kind(spec, "override", by).withColumn("has_override", F.lit(True))
    return (
        wanted.join(inv.select("repo", "path", "size_bytes", "class", "selectable", "exclusion"), ["repo", "path"])
        .join(overrides, [*by, "repo", "path"], "left")
        .withColumn("overridable", ~F.col("class").isin(NEVER_OVERRIDABLE))
        .withColumn("accepted", F.col("selectable") | (F.coalesce("has_override", F.lit(False)) & F.col("overridable")))
    )


def select_files(inv: DataFrame, spec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _picked(inv, spec, by).where("accepted").select(*by, "repo", "path", "size_bytes")


def rejected(inv: DataFrame, spec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    reason = F.coalesce("exclusion.reason", F.concat(F.lit("Excluded: "), class_label(F.col("class")), F.lit(".")))
    return _picked(inv, spec, by).where("NOT accepted").select(*by, "repo", "path", reason.alias("reason"), "overridable")


def missing(inv: DataFrame, spec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Picked files and directories that match nothing."""
    wanted = _kind(spec, "file", by).join(_kind(spec, "excluded", by), [*by, "repo", "path"], "left_anti")
    files = wanted.join(inv.select("repo", "path"), ["repo", "path"], "left_anti").select(*by, "repo", "path")
    own = inv.select("repo", paths.directory(F.col("path")).alias("own")).distinct()
    known = own.select("repo", F.explode(_chain(F.col("own"))).alias("dir")).distinct()
    dirs = _directories(spec, by).join(known, ["repo", "dir"], "left_anti").select(*by, "repo", F.col("asked").alias("path"))
    return files.unionByName(dirs).distinct()


def resolve(inv: DataFrame, spec: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The files that may leave: directory picks and file picks together, each once."""
    return select_directories(inv, spec, by).unionByName(select_files(inv, spec, by)).distinct()


def selection_totals(selected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return selected.groupBy(*by, "repo").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("total_bytes"))


def recipe(inv: DataFrame, name: str) -> DataFrame:
    """source_only, everything or tests_only: proposed and skipped selectable files per repo."""
    path = F.col("path")
    accepts = {
        "source_only": ~paths.is_test(path) & ~paths.is_docs(path),
        "everything": F.lit(True),
        "tests_only": paths.is_test(path),
    }[name]
    return (
        inv.where("selectable").withColumn("ok", accepts).groupBy("repo").agg(
            F.count_if("ok").alias("files"),
            F.coalesce(F.sum(F.when(F.col("ok"), F.col("size_bytes"))), F.lit(0)).alias("total_bytes"),
            F.count_if(~F.col("ok")).alias("skipped_by_recipe"),
        )
    )


def directory_summaries(inv: DataFrame) -> DataFrame:
    """Every directory with selectable files anywhere below it.

    Files are folded into their own directory first (map-side), so the path
    roll-up expands directories, not files.
    """
    direct = (
        inv.where("selectable AND instr(path, '/') > 0")
        .groupBy("repo", paths.directory(F.col("path")).alias("own"))
        .agg(F.count("*").alias("n"), F.sum("size_bytes").alias("b"))
    )
    return (
        direct.select("repo", "n", "b", F.explode(paths.ancestors(F.concat("own", F.lit("/x")))).alias("path"))
        .groupBy("repo", "path")
        .agg(F.sum("n").alias("selectable_files"), F.sum("b").alias("total_bytes"))
        .withColumn("depth", (F.size(F.split("path", "/")) - 1).cast("long"))
    )


def directory_state(inv: DataFrame, selected: DataFrame) -> DataFrame:
    """unchecked, partial or checked for every directory of selectable files."""
    marked = inv.where("selectable AND instr(path, '/') > 0").select("repo", "path").join(
        selected.select("repo", "path", F.lit(1).alias("hit")).distinct(), ["repo", "path"], "left"
    )
    direct = marked.groupBy("repo", paths.directory(F.col("path")).alias("own")).agg(
        F.count("*").alias("n"), F.count("hit").alias("h")
    )
    return (
        direct.select("repo", "n", "h", F.explode(paths.ancestors(F.concat("own", F.lit("/x")))).alias("path"))
        .groupBy("repo", "path")
        .agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
        .select(
            "repo", "path",
            F.when(F.col("h") == 0, "unchecked").when(F.col("h") == F.col("n"), "checked").otherwise("partial").alias("state"),
        )
    )


def selection_exclusions(inv: DataFrame, spec: DataFrame) -> DataFrame:
    """Hand-made removals that still matter: selectable files a directory pick would bring back."""
    files = inv.where("selectable").select("repo", "path", paths.directory(F.col("path")).alias("own"))
    below = files.join(_reached(inv, spec, ()), ["repo", "own"], "left_semi").select("repo", "path")
    return below.join(_kind(spec, "excluded"), ["repo", "path"], "left_semi")
