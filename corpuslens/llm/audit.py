"""Filter interaction audit: what each filter removes under every order in which the filters can be applied."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import n_words

#: The counts of a step; shapley is filled in from ``removed`` of all orders.
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
_ASCII_SPACE = "\t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def n_distinct_words(col: Column) -> Column:
    """Number of different words of a text; words are runs of anything but ASCII white space."""
    pieces = F.array_distinct(F.split(F.translate(col, _ASCII_SPACE, " " * len(_ASCII_SPACE)), " "))
    return F.size(pieces) - F.when(F.array_contains(pieces, ""), 1).otherwise(0)


def text_filters(text: Column) -> list[tuple[str, Column]]:
    """Conditions under which a text (not null) fails: too short, repetitive, shouting, markup characters."""
    return [
        ("A", n_words(text) < 50),
        ("B", 100 * n_distinct_words(text) < 65 * n_words(text)),
        ("C", 100 * (F.length(text) - F.length(F.translate(text, _CAPITALS, ""))) > 5 * F.length(text)),
        ("D", text.rlike("[#$%&*|]")),
    ]


def cells(docs: DataFrame, labels: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """part, mask, n, good, toxic: documents of a part that fail the same filters, and how many of them are labelled so.

    Bit i of the mask is ``filters[i]``; the bit above them says that a smaller doc_id has the same text. That is
    settled without a join on the text: rows are folded by (digest, doc_id), each digest keeps its smallest doc_id,
    and both meet on the pair, so a text that a third of the rows share is spread by doc_id.
    """
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(filters)), F.lit(0))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), bits.alias("bits"),
    )
    folded = rows.groupBy("digest", "doc_id", "part", "bits").agg(F.count("*").alias("n"))
    first = folded.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = first.select(F.col("digest").alias("first_digest"), F.col("doc_id").alias("first_id"))
    is_first = (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id"))
    known = folded.join(first, is_first, "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    repeated = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    mask = F.col("bits") + F.when(repeated, F.lit(1 << len(filters))).otherwise(F.lit(0))
    return known.groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic")
    )


def _steps(cell: Column, orders: Column) -> Column:
    """What one cell adds to every step of every order: the cell goes along each order until a filter takes it."""
    def step(state: Column, f: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1), f)
        fails = cell["mask"].bitwiseAND(bit) != 0
        gone = cell["mask"].bitwiseAND(state["seen"]) != 0
        here = fails & ~gone
        weigh = lambda c, n: F.when(c, n).otherwise(F.lit(0).cast("long"))
        counts = F.struct(
            weigh(~gone & ~fails, cell["n"]).alias("kept"), weigh(here, cell["n"]).alias("removed"), weigh(fails & gone, cell["n"]).alias("redundant"),
            weigh(cell["mask"] == bit, cell["n"]).alias("unique_fails"), weigh(here, cell["good"]).alias("good_lost"), weigh(here, cell["toxic"]).alias("toxic_lost"),
        )
        return F.struct(state["seen"].bitwiseOR(bit).alias("seen"), F.concat(state["steps"], F.array(counts)).alias("steps"))

    none = F.array().cast("array<struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">>")
    start = F.struct(F.lit(0).alias("seen"), none.alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda s: s["steps"])))


def interactions(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every order of ``names`` (bit i of a mask: names[i]).

    A part has at most 2 ** len(names) cells, whatever its number of documents; they are folded over the constant
    array of all orders and merged by elementwise sums.
    """
    k = len(names)
    every = [list(p) for p in permutations(range(k))]
    orders = F.array(*[F.array(*map(F.lit, p)) for p in every])
    zero = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), k * factorial(k))
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    merged = gathered.select("part", F.aggregate("cells", zero, lambda total, cell: F.zip_with(total, _steps(cell, orders), add)).alias("steps"))
    flat = merged.select("part", F.posexplode("steps").alias("at", "counts"))
    order = F.element_at(orders, (F.col("at") / k).cast("int") + 1)
    own = F.element_at(order, F.col("at") % k + 1)
    label = F.array(*map(F.lit, names))
    rows = flat.select(
        "part", F.array_join(F.transform(order, lambda f: F.element_at(label, f + 1)), "").alias("filter_order"), (F.col("at") % k + 1).cast("int").alias("step"), own.alias("own"), "counts.*"
    )
    share = rows.groupBy("part", "own").agg(F.sum("removed").alias("shapley"))
    return rows.join(share, ["part", "own"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter order and step: the five filters A to E over whole texts in all 120 orders.

    A part is a source value; null and empty sources are one part, named by the empty string. A null text counts as
    empty. E compares with all texts of the table: a row fails it if the same text stands under a smaller doc_id; a
    row without doc_id never fails it and never makes another fail. Repeated rows count each; rows that agree in
    doc_id and text do not fail E through each other. Labels are folded per doc_id: one label of 1 among several
    counts; other values, nulls and ids without a document are no loss. Extra columns are not read. An empty table
    has no parts, so no rows.
    """
    filters = text_filters(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = cells(docs, labels, [c for _, c in filters])
    return interactions(found, [name for name, _ in filters] + ["E"])


#: The audit in DuckDB's SQL.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
fails AS (SELECT w.part, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(w.t, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN w.doc_id > f.first_id THEN 'E' ELSE '' END AS failed, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic
  FROM w JOIN firsts f ON w.t = f.t LEFT JOIN marks m ON w.doc_id = m.doc_id),
cell AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM l a, l b, l c, l d, l e WHERE b.f <> a.f AND c.f NOT IN (a.f, b.f) AND d.f NOT IN (a.f, b.f, c.f) AND e.f NOT IN (a.f, b.f, c.f, d.f)),
steps AS (SELECT o, s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
seen AS (SELECT part, o, s, f, n, good, toxic, failed, contains(failed, f) AS hit, failed <> translate(failed, before, '') AS gone FROM cell, steps),
r AS (SELECT part, o, s, f, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM seen GROUP BY part, o, s, f)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
