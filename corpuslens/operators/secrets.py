"""Secret findings per line, report per repo, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import secrets, text

LINE_MARKER = "[line redacted: possible credential]"


def secret_findings(files: DataFrame) -> DataFrame:
    """One row per line with a finding. Files without any match never reach the line split; nothing is shuffled."""
    suspects = files.where(secrets.may_hold_secret(F.col("content")))
    lines = text.explode_lines(suspects).withColumn("rule", secrets.rule_of(F.col("line"))).where("rule IS NOT NULL")
    return lines.select(
        "repo", "path", "line_no", "rule", secrets.confidence_of(F.col("rule")).alias("confidence"),
        secrets.excerpt(F.col("line")).alias("redacted_excerpt"),
    )


def secret_report(files: DataFrame) -> DataFrame:
    """Findings per repo and confidence, with the files that could not be read (no content) counted as skipped."""
    n = {c: F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")}
    found = secret_findings(files).groupBy("repo").agg(n["high"], n["medium"], n["low"])
    every = files.groupBy("repo").agg(F.count_if(F.col("content").isNull()).alias("skipped"))
    zero = F.lit(0).cast("long")
    counts = [F.coalesce(c, zero).alias(c) for c in ("high", "medium", "low")]
    return every.join(found, "repo", "left").select("repo", *counts, "skipped").withColumn(
        "requires_confirmation", F.col("high") + F.col("medium") > 0
    )


def redact_lines(files: DataFrame) -> DataFrame:
    """Each text with its high and medium lines replaced by a marker, and how many were.

    Works inside the row: nothing is shuffled and no text is rebuilt by an aggregate.
    """
    hit = secrets.may_hold_secret(F.col("content"))
    bad = lambda l: secrets.rule_of(l).isin([r for r, c, _ in secrets.RULES if c != "low"])
    flagged = F.transform(text.line_array(F.col("content")), lambda l: F.struct(l.alias("line"), F.coalesce(bad(l), F.lit(False)).alias("bad")))
    plain = F.transform(text.line_array(F.col("content")), lambda l: F.struct(l.alias("line"), F.lit(False).alias("bad")))
    # the generator keeps the flags computed once for the text and for the count
    once = files.select("repo", "path", F.inline(F.array(F.struct(F.when(hit, flagged).otherwise(plain).alias("lines")))))
    shown = F.transform("lines", lambda l: F.when(l["bad"], F.lit(LINE_MARKER)).otherwise(l["line"]))
    return once.select("repo", "path", F.array_join(shown, "\n").alias("text"), F.size(F.filter("lines", lambda l: l["bad"])).cast("long").alias("redacted_lines"))
