"""Ranking and search: which files a request needs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import ordering, text
from corpuslens.session import durable


@dataclass(frozen=True)
class RetrievalConfig:
    enabled: bool = True
    min_score_threshold: float = 0.15
    weight_pinned: float = 1.0
    weight_git_diff: float = 0.8
    weight_lexical: float = 0.5
    weight_semantic: float = 0.4


DEFAULT = RetrievalConfig()


def term_array(query: Column) -> Column:
    """Distinct lower-cased words of at least three bytes, without punctuation at their ends."""
    words = F.transform(F.split(F.lower(query), r"\s+"), lambda w: text.strip_of(w, r"^\p{L}\p{N}"))
    return F.array_distinct(F.filter(words, lambda w: F.octet_length(w) >= 3))


def query_terms(queries: DataFrame) -> DataFrame:
    """Rows (query_id, repo, term)."""
    return queries.select("query_id", "repo", F.explode(term_array(F.col("query"))).alias("term"))


def _pieces(df: DataFrame, text_col: str, k: int) -> DataFrame:
    """Rows (text_col, gram) for every piece of ``k`` characters; repeated pieces stay."""
    at = df.where(F.length(text_col) >= k).select(text_col, F.explode(F.sequence(F.lit(1), F.length(text_col) - (k - 1))).alias("_at"))
    return at.select(text_col, F.substring(F.col(text_col), F.col("_at"), F.lit(k)).alias("gram"))


def substring_matches(terms: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (term, unit) where the unit contains the term; both sides hold each value once.

    Units are indexed by their three-character pieces and each term is looked
    up by its rarest one, so a term is compared only with units that share it.
    Terms of one or two characters use pieces of their own length.
    """
    out = None
    for k, of_size in ((3, F.length("term") >= 3), (2, F.length("term") == 2), (1, F.length("term") == 1)):
        wanted = _pieces(terms.where(of_size), "term", k).distinct()
        pieces = _pieces(units, "unit", k).join(wanted.select("gram").distinct(), "gram", "left_semi")
        frequency = pieces.groupBy("gram").agg(F.count("*").alias("n"))
        key = wanted.join(frequency, "gram").groupBy("term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
        hit = key.join(pieces, "gram").where(F.contains(F.col("unit"), F.col("term"))).select("term", "unit")
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def content_index(files: DataFrame) -> DataFrame:
    """The inverted index, one row per text: (repo, path, postings), an array of (unit, n) in the order of the units.

    Units are the blank-separated, lower-cased tokens; they are counted inside the row, as runs of the sorted array, so
    nothing is shuffled.
    """
    blank = F.lower("content")
    for c in "\t\n\x0b\f\r":
        blank = F.replace(blank, F.lit(c), F.lit(" "))
    # split at one plain character needs no pattern
    tokens = F.sort_array(F.array_remove(F.split(blank, " "), ""))
    # the generator keeps the sorted array computed once
    sorted_ = files.select("repo", "path", F.inline(F.array(F.struct(tokens.alias("t")))))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: (i == 0) | (F.get("t", i) != F.get("t", i - 1)))
    runs = sorted_.where(F.size("t") > 0).select("repo", "path", "t", F.inline(F.array(F.struct(begins.alias("b")))))
    counts = F.transform("b", lambda i, k: F.struct(F.get("t", i).alias("unit"), (F.coalesce(F.get("b", k + 1), F.size("t")) - i).cast("long").alias("n")))
    return runs.select("repo", "path", counts.alias("postings"))


def flat_postings(index: DataFrame) -> DataFrame:
    """The rows (repo, path, unit, n) of an index."""
    return index.select("repo", "path", F.inline("postings"))


def content_postings(files: DataFrame) -> DataFrame:
    """The inverted index (repo, path, unit, n): each blank-separated, lower-cased token of each text with its count."""
    return flat_postings(content_index(files))


def text_words(content: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(content), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_lengths(files: DataFrame) -> DataFrame:
    """(repo, path, len): words of each text."""
    return files.select("repo", "path", F.size(text_words(F.col("content"))).alias("len"))


def _found(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(repo, term, path) of the index rows (repo, unit, path) whose unit contains a term asked in their repo.

    Only the units of these rows are compared with the terms, each once. They are materialised, as terms of each length
    read them.
    """
    asked = terms.select("repo", "term").distinct()
    pairs = substring_matches(asked.select("term").distinct(), durable(index.select("unit").distinct()))
    return pairs.join(asked, "term").join(index.select("repo", "unit", "path"), ["repo", "unit"]).select("repo", "term", "path").distinct()


def rank_context(queries: DataFrame, files: DataFrame, pinned: DataFrame, changed: DataFrame, limit: int,
                 config: RetrievalConfig = DEFAULT, index: DataFrame | None = None) -> DataFrame:
    """The ``limit`` best files per query with score and reasons; ties go to the smaller path.

    ``queries``: query_id, repo, query. ``files``: selectable repo, path, size_bytes, content. ``index``
    may be a stored ``content_index`` of the same files.

    A score has parts of known size: pins and changes do not depend on the query, matches in the path and in the text
    add at most their weights. The ``limit`` best files of a repo by pins and changes alone set a bar for every query of
    the repo: with their matches they can only rise. So paths are matched first, and the postings of a text are matched
    only if its file can reach the bar with all terms in its text; tokens of other texts meet no term. The index is
    narrowed while a text is one row. A file without any match scores the same for every
    query, so only those ``limit`` files can be among the winners; no other pair is formed without a match.
    """
    index = content_index(files) if index is None else index
    terms = query_terms(queries)
    counts = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    asked = queries.select("query_id", "repo").join(counts, "query_id", "left").withColumn("n", F.greatest(F.coalesce("n_terms", F.lit(0)), F.lit(1)).cast("double")).drop("n_terms")
    pins = pinned.select("repo", "path", F.lit(1).alias("pin")).distinct()
    diffs = changed.select("repo", "path", F.lit(1).alias("diff")).distinct()
    base = files.select("repo", "path").join(pins, ["repo", "path"], "left").join(diffs, ["repo", "path"], "left").where(
        "pin IS NOT NULL OR diff IS NOT NULL").na.fill(0, ["pin", "diff"])
    base = durable(base.withColumn("sure", F.col("pin") * config.weight_pinned + F.col("diff") * config.weight_git_diff))
    head = ordering.top_k(base, ["repo"], [F.desc("sure"), F.asc("path")], limit, "_r").select("repo", "path", "sure")
    bar = head.groupBy("repo").agg(F.min("sure").alias("bar"), F.count("*").alias("held")).select(
        "repo", F.when(F.col("held") >= limit, F.greatest("bar", F.lit(config.min_score_threshold))).otherwise(config.min_score_threshold).alias("bar"))
    least = F.coalesce("bar", F.lit(config.min_score_threshold)) - 1e-9

    by_path = files.select("repo", "path", F.lower("path").alias("unit"))
    in_path = _found(terms, by_path)
    in_path = terms.join(in_path, ["repo", "term"]).groupBy("query_id", "repo", "path").agg(F.count("*").alias("pm"))
    in_path = durable(in_path.join(asked.select("query_id", "n"), "query_id").join(base.select("repo", "path", "sure"), ["repo", "path"], "left").na.fill(0.0, ["sure"]))
    # what a text can add: all its terms
    reach = F.col("sure") + F.lit(config.weight_lexical) * (F.col("pm") / F.col("n")) + config.weight_semantic
    by_match = in_path.select("repo", "path", reach.alias("reach"))
    by_base = base.select("repo", "path", (F.col("sure") + config.weight_semantic).alias("reach"))
    able = by_match.unionByName(by_base).join(bar, "repo", "left").where(F.col("reach") >= least).select("repo", "path")
    easy = files.select("repo", "path").join(bar, "repo", "left").where(F.lit(config.weight_semantic) >= least).select("repo", "path")
    able = able.unionByName(easy).distinct()
    able = durable(able)
    near = index.select("repo", "path", F.col("postings.unit").alias("units")).where(ordering.likely_in(able)).join(able, ["repo", "path"], "left_semi")
    in_text = _found(terms, near.select("repo", "path", F.explode("units").alias("unit")))
    in_text = terms.join(in_text, ["repo", "term"]).groupBy("query_id", "repo", "path").agg(F.count("*").alias("cm"))

    zero = F.lit(0).cast("long")
    without = queries.select("query_id", "repo").join(head.select("repo", "path"), "repo").select("query_id", "repo", "path", zero.alias("pm"), zero.alias("cm"))
    parts = in_path.select("query_id", "repo", "path", "pm", zero.alias("cm")).unionByName(in_text.select("query_id", "repo", "path", zero.alias("pm"), "cm")).unionByName(without)
    pairs = parts.groupBy("query_id", "repo", "path").agg(F.max("pm").alias("pm"), F.max("cm").alias("cm"))
    full = pairs.join(base.drop("sure"), ["repo", "path"], "left").na.fill(0, ["pin", "diff"]).join(asked.select("query_id", "n"), "query_id")
    score = (F.col("pin") * F.lit(config.weight_pinned) + F.col("diff") * F.lit(config.weight_git_diff)
             + F.lit(config.weight_lexical) * (F.col("pm") / F.col("n")) + F.lit(config.weight_semantic) * (F.col("cm") / F.col("n")))
    reasons = F.array_join(F.array_compact(F.array(
        F.when(F.col("pin") == 1, "pinned by the user"),
        F.when(F.col("diff") == 1, "changed since the base"),
        F.when(F.col("pm") > 0, F.concat(F.lit("terms in path: "), F.col("pm").cast("string"))),
        F.when(F.col("cm") > 0, F.concat(F.lit("terms in text: "), F.col("cm").cast("string"))))), "; ")
    kept = full.withColumn("score", score).where(F.col("score") >= config.min_score_threshold)
    best = ordering.top_k(kept, ["query_id"], [F.desc("score"), F.asc("path")], limit).withColumn("reasons", reasons)
    sizes = files.select("repo", "path", "size_bytes")
    return best.join(sizes, ["repo", "path"]).select(
        "query_id", "repo", "rank", "path", (F.round(F.col("score") * 100.0) / 100.0).alias("score"), "reasons", "size_bytes",
        F.floor(F.col("size_bytes") / 4).alias("est_tokens"))


def rank_disabled(files: DataFrame, pinned: DataFrame) -> DataFrame:
    """Deterministic fallback: the pinned selectable files."""
    return files.join(pinned.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select(
        "repo", "path", F.lit(1.0).alias("score"), F.lit("pinned by the user").alias("reasons"),
        "size_bytes", F.floor(F.col("size_bytes") / 4).alias("est_tokens"))


def rank_bm25(queries: DataFrame, files: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, postings: DataFrame | None = None,
              units: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """The ``k`` best files per query by BM25 over words within its repo.

    ``postings``, ``units`` (its distinct tokens) and ``lengths`` may be a stored index of the same files; then no text
    is read. A word lies within one token, so the asked words are looked up among the distinct tokens, and only the
    postings of those tokens are counted.
    """
    postings = content_postings(files) if postings is None else postings
    units = postings.select("unit").distinct() if units is None else units
    lengths = word_lengths(files) if lengths is None else lengths
    terms = queries.select("query_id", "repo", F.explode(F.array_distinct(text_words(F.col("query")))).alias("term"))
    asked = terms.select("repo", "term").distinct()
    stats = lengths.groupBy("repo").agg(F.count("*").alias("n_docs"), (F.sum("len") / F.count("*")).alias("avg_len"))
    parts = units.select("unit", F.explode(text_words(F.col("unit"))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    parts = parts.groupBy("unit", "term").agg(F.count("*").alias("times"))
    found = parts.join(asked, "term").join(postings, ["repo", "unit"])
    tf = found.groupBy("repo", "path", "term").agg(F.sum(F.col("n") * F.col("times")).alias("tf")).join(lengths, ["repo", "path"])
    df = tf.groupBy("repo", "term").agg(F.count("*").alias("df"))
    weighted = tf.join(df, ["repo", "term"]).join(stats, "repo")
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    gain = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = terms.join(weighted.select("repo", "term", "path", gain.alias("g")), ["repo", "term"]).groupBy("query_id", "repo", "path").agg(
        F.round(F.sum("g"), 6).alias("score"))
    return ordering.top_k(scored, ["query_id"], [F.desc("score"), F.asc("path")], k)


def search_lines(files: DataFrame, query: str, prefix: str = "") -> DataFrame:
    """Case-insensitive literal search: every matching line with its position in the repo's (path, line) order.

    A text is read once: its matching lines are cut out inside the row and kept; only their numbers per file are ordered.
    """
    needle = query.lower()
    src = files.where(F.col("path").startswith(prefix) & F.contains(F.lower("content"), F.lit(needle)))
    lines = F.transform(text.line_array(F.col("content")), lambda l, i: F.struct((i + 1).cast("long").alias("line_no"), l.alias("line")))
    hits = F.filter(lines, lambda l: F.contains(F.lower(l["line"]), F.lit(needle)))
    found = durable(src.select("repo", "path", F.inline(F.array(F.struct(hits.alias("hits"))))).where(F.size("hits") > 0))
    placed = ordering.global_positions(found.select("repo", "path", F.size("hits").cast("long").alias("n")), ["repo"], ["path"], ["n"])
    each = found.join(placed.select("repo", "path", "n_before"), ["repo", "path"]).select("repo", "path", "n_before", F.posexplode("hits").alias("i", "hit"))
    return each.select("repo", "path", "hit.line_no", (F.col("n_before") + F.col("i") + 1).alias("position"), text.strip(F.col("hit.line")).alias("snippet"))


def memory_recall(memory: DataFrame, now: str, limit: int) -> DataFrame:
    """Entries that have not expired at ``now``, newest first."""
    alive = memory.where(F.col("expires_ts") > F.lit(now).cast("timestamp_ntz"))
    return ordering.top_k(alive, ["repo"], [F.desc("created_ts"), F.asc("memory_id")], limit)


def missing_ground_truth(relevant: DataFrame, inv: DataFrame) -> DataFrame:
    return relevant.select("repo", "path").distinct().join(inv.select("repo", "path"), ["repo", "path"], "left_anti")


def strategy_benchmark(inv: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per repo and strategy: files sent, precision, recall, relevant files missed.

    One pass marks each file as selectable, relevant or both; the strategies
    are sums over those marks.
    """
    rel = relevant.select("repo", "path", F.lit(1).alias("rel")).distinct()
    both = inv.select("repo", "path", F.col("selectable").cast("int").alias("sel")).join(rel, ["repo", "path"], "full").na.fill(0, ["sel", "rel"])
    c = both.groupBy("repo").agg(F.sum("sel").alias("all"), F.sum("rel").alias("truth"), F.sum(F.col("sel") * F.col("rel")).alias("hit"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("double")
    ratio = lambda a, d: F.when(d > 0, a / d)
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), n.alias("files_included"), p.alias("precision"), r.alias("recall"), m.alias("missed_files"))
                     for s, n, p, r, m in [
        ("raw_all", F.col("all"), ratio(F.col("hit"), F.col("all")), ratio(F.col("hit"), F.col("truth")), F.col("truth") - F.col("hit")),
        ("user_pinned", F.col("hit"), ratio(F.col("hit"), F.col("hit")), ratio(F.col("hit"), F.col("truth")), F.col("truth") - F.col("hit")),
        ("deterministic_map", zero, none, none, zero),
        ("hybrid", F.col("hit"), ratio(F.col("hit"), F.col("hit")), ratio(F.col("hit"), F.col("truth")), F.col("truth") - F.col("hit")),
    ]])
    return c.select("repo", F.explode(rows).alias("s")).select("repo", "s.*")


def strategy_cost(bundles: dict[str, DataFrame]) -> DataFrame:
    """Bytes and tokens per repo of each strategy that sends a bundle."""
    rows = [b.select("repo", F.lit(name).alias("strategy"), F.col("byte_len").alias("bytes"), "tokens") for name, b in bundles.items()]
    return reduce(DataFrame.unionByName, rows)


def map_cost(document: DataFrame, pinned: DataFrame) -> DataFrame:
    """deterministic_map sends the context document (rows with ``line``), hybrid the pinned files behind it."""
    size = document.groupBy("repo").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    size = size.withColumn("tokens", F.floor(F.col("bytes") / 4))
    both = size.join(pinned.select("repo", F.col("byte_len").alias("b"), F.col("tokens").alias("t")), "repo", "left").na.fill(0, ["b", "t"])
    hybrid = both.select("repo", F.lit("hybrid").alias("strategy"), (F.col("bytes") + F.col("b")).alias("bytes"), (F.col("tokens") + F.col("t")).alias("tokens"))
    return size.select("repo", F.lit("deterministic_map").alias("strategy"), "bytes", "tokens").unionByName(hybrid)


def tokens_avoided(runs: DataFrame, inv: DataFrame) -> DataFrame:
    """Repository estimate minus what a run sent, never below zero, and its share."""
    repo = inv.where("selectable").groupBy("repo").agg(F.floor(F.sum("size_bytes") / 4).alias("repository_tokens"))
    avoided = F.greatest(F.col("repository_tokens") - F.col("sent_tokens"), F.lit(0))
    return runs.join(repo, "repo").select(
        "run_id", "repo", "repository_tokens", "sent_tokens", avoided.alias("tokens_avoided"),
        F.when(F.col("repository_tokens") > 0, avoided / F.col("repository_tokens")).otherwise(0.0).alias("ratio"))
