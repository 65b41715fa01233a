"""Scan and classification: one row per file with class, selectability and the reason for exclusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import ordering, paths, text
from corpuslens.policy import CLASS_LABELS, EXCLUSION_REASONS, IGNORE_SOURCES, INJECTION_PHRASES, OVERRIDE_CLASSES, Policy

DEFAULT = Policy()


def prune_skipped_dirs(files: DataFrame) -> DataFrame:
    return files.where(~paths.in_skipped_dir(F.col("path")))


def _symlink(files: DataFrame) -> Column:
    return F.col("is_symlink") if "is_symlink" in files.columns else F.lit(False)


def classify(files: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Adds size_bytes, size_class, class, selectable, exclusion and content_hash to (repo, path, content).

    The order of the cases is the contract: the first that holds decides. The
    columns are lazy, so a plan that only reads path and class never hashes.
    ``content`` may be text or binary.
    """
    raw = F.col("content").cast("binary")
    path = F.col("path")
    is_text = dict(files.dtypes)["content"] == "string"
    valid = F.lit(True) if is_text else F.is_valid_utf8(F.col("content").cast("string"))
    df = files.withColumn("size_bytes", F.octet_length("content").cast("long"))
    df = df.withColumn("size_class", paths.size_class(path, F.col("size_bytes"), policy))
    cls = (
        F.when(paths.is_sensitive(path), "credential_sensitive")
        .when(_symlink(files), "symlink")
        .when(paths.has_binary_extension(path), "binary")
        .when(text.looks_binary(raw), "binary")
    )
    if policy.hash_contents:
        cls = cls.when(~valid, "unsupported_encoding")
    cls = (
        cls.when(paths.is_lockfile(path), "lockfile")
        .when(paths.is_generated(path), "generated")
        .when(paths.is_hidden(path), "hidden_metadata")
        .otherwise("source_text")
    )
    df = df.withColumn("class", cls).withColumn("selectable", selectable(F.col("class"), policy))
    df = df.withColumn("exclusion", exclusion(policy))
    digest = F.sha2(raw, 256) if policy.hash_contents else F.lit(None).cast("string")
    return df.withColumn("content_hash", digest)


def selectable(cls: Column, policy: Policy) -> Column:
    allowed = ["source_text"]
    for name, on in (
        ("generated", not policy.exclude_generated),
        ("lockfile", not policy.exclude_lockfiles),
        ("hidden_metadata", policy.include_hidden),
        ("symlink", policy.follow_symlinks),
    ):
        if on:
            allowed.append(name)
    return cls.isin(allowed)


def exclusion(policy: Policy) -> Column:
    """Struct (source, reason, rule) for each file that is not plain selectable text."""
    path, cls = F.col("path"), F.col("class")
    binary = F.when(paths.has_binary_extension(path), "binary_extension").otherwise("binary_content")
    reason = paths._lookup(F.when(cls == "binary", binary).otherwise(cls), EXCLUSION_REASONS, "unreadable")
    rule = F.when(cls == "credential_sensitive", path).when(
        (cls == "binary") & paths.has_binary_extension(path), F.concat(F.lit("*."), F.substring_index(path, ".", -1))
    )
    return F.when(
        cls != "source_text", F.struct(F.lit("policy").alias("source"), reason.alias("reason"), rule.alias("rule"))
    )


def inventory(files: DataFrame, policy: Policy = DEFAULT, rules: DataFrame | None = None) -> DataFrame:
    """Pruned and classified files; with ``rules`` (see ``compile_rules``) also those that ignore rules exclude."""
    inv = classify(prune_skipped_dirs(files), policy)
    return inv if rules is None else with_ignores(inv, rules)


def class_label(cls: Column) -> Column:
    return paths._lookup(cls, {k: v for k, v in CLASS_LABELS.items()}, "unreadable")


def override_required(cls: Column) -> Column:
    return cls.isin(OVERRIDE_CLASSES)


def scan_issues(files: DataFrame) -> DataFrame:
    """Recoverable problems per path: content that is missing or not UTF-8, paths that leave the root."""
    raw_text = F.col("content").cast("string")
    message = (
        F.when(paths.escapes_root(F.col("path")), "left out: the path leaves the root")
        .when(F.col("content").isNull(), "no content could be read")
        .when(~F.is_valid_utf8(raw_text), "not UTF-8")
    )
    return files.select("repo", "path", text.sanitize_message(message).alias("message")).where("message IS NOT NULL")


def scan_stats(files: DataFrame) -> DataFrame:
    """files, directories and bytes per repo.

    Files are first folded into their direct directory (map-side), so only
    directory rows are expanded to ancestors.
    """
    per_dir = files.groupBy("repo", paths.directory(F.col("path")).alias("dir")).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("b")
    )
    dirs = (
        per_dir.where("dir <> ''")
        .select("repo", F.explode(paths.ancestors(F.concat("dir", F.lit("/x")))).alias("dir"))
        .distinct()
        .groupBy("repo")
        .agg(F.count("*").alias("directories_seen"))
    )
    totals = per_dir.groupBy("repo").agg(F.sum("n").alias("files_seen"), F.sum("b").alias("bytes_seen"))
    return totals.join(dirs, "repo", "left").select(
        "repo", "files_seen", F.coalesce("directories_seen", F.lit(0)).alias("directories_seen"), "bytes_seen"
    )


def language_mix(inv: DataFrame) -> DataFrame:
    """Selectable files per language with their rank in the repo; every language is listed."""
    counts = (
        inv.where("selectable")
        .groupBy("repo", paths.language_of(F.col("path")).alias("language"))
        .agg(F.count("*").alias("files"))
        .where("language <> 'unknown'")
    )
    w = Window.partitionBy("repo").orderBy(F.desc("files"), F.asc("language"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long"))


_TOKEN = r"\\.|\[!?\]?[^\]]*\]|\*\*/|/\*\*\z|\*\*|\*|\?|[^\\\[*?/]+|/|."


def rule_regex(pattern: Column) -> Column:
    """An ignore rule (without its '!') as a regular expression on the path below the rule's base.

    ``*``, ``?`` and classes stay inside one segment, ``**`` crosses, a backslash takes the next character as it is, and
    a slash inside anchors the rule.
    """
    body = F.regexp_replace(pattern, r"/\z", "")
    anchored = body.contains("/")
    quoted = lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))
    inside = lambda t: F.regexp_replace(F.substring(t, 2, 1_000_000), "^!", "^")
    piece = lambda t: (
        F.when(t == "**/", "(?:.*/)?").when(t == "/**", "/.*").when(t == "**", ".*").when(t == "*", "[^/]*").when(t == "?", "[^/]").when(t == "/", "/")
        .when(t.startswith("\\"), quoted(F.substring(t, 2, 1))).when(t.startswith("[") & t.endswith("]"), F.concat(F.lit("(?!/)["), inside(t))).otherwise(quoted(t))
    )
    tokens = F.regexp_extract_all(F.regexp_replace(body, "^/", ""), F.lit(_TOKEN), F.lit(0))
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), F.array_join(F.transform(tokens, piece), ""), F.lit("$"))


def compile_rules(rules: DataFrame) -> DataFrame:
    """(repo, ordinal, source_rank, pattern[, base]) with what each rule means: negated, dir_only, regex, kind, valid.

    ``base`` is the directory whose ignore file holds the rule, '' for the root. Kinds ``extension`` and ``name`` are
    looked up by equality; only ``pattern`` rules are matched by their expression.
    """
    base = F.col("base") if "base" in rules.columns else F.lit("")
    bare = F.regexp_replace("pattern", "^!", "")
    plain = r"[^*?\[\]\\/]+"
    kind = F.when(bare.rlike(r"^\*\.[^*?\[\]\\/.]+/?$"), "extension").when(bare.rlike(rf"^{plain}/?$"), "name").otherwise("pattern")
    unclosed = F.regexp_replace(F.regexp_replace(bare, r"\\.", ""), r"\[!?\]?[^\]]*\]", "").contains("[")
    dangling = F.regexp_replace(bare, r"\\\\", "").endswith("\\")
    return rules.select(
        "repo", base.alias("base"), "ordinal", "source_rank", "pattern", F.col("pattern").startswith("!").alias("negated"),
        bare.endswith("/").alias("dir_only"), rule_regex(bare).alias("regex"), kind.alias("kind"),
        F.regexp_replace(F.regexp_replace(bare, "/$", ""), r"^\*\.", "").alias("word"), (~(unclosed | dangling) & (bare != "")).alias("valid"))


def invalid_rules(rules: DataFrame) -> DataFrame:
    """Rules that mean nothing: an open class, a backslash at the end, or nothing at all. They are not applied."""
    return compile_rules(rules).where("NOT valid").select("repo", "base", "ordinal", "pattern")


#: Pieces that the paths of one repository are dealt to where each meets all pattern rules of the repository.
SALTS = 32


def _verdicts(units: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, is_dir, rule, source_rank, ignored): the strongest matching rule of each unit that has one.

    Stronger is the higher source, then the deeper base, then the later line.
    """
    compiled = compile_rules(rules).where("valid").withColumn("depth", F.when(F.col("base") == "", 0).otherwise(F.size(F.split("base", "/"))))
    name = F.substring_index("path", "/", -1)
    u = units.select("repo", "path", "is_dir", name.alias("name"), F.when(name.contains("."), F.substring_index(name, ".", -1)).alias("ext"))
    below = (F.col("base") == "") | F.startswith("path", F.concat("base", F.lit("/")))
    fits = below & (F.col("is_dir") | ~F.col("dir_only"))
    relative = F.when(F.col("base") == "", F.col("path")).otherwise(F.expr("substring(path, length(base) + 2)"))
    of = lambda k: compiled.where(F.col("kind") == k)
    hits = [
        u.join(of("extension").withColumnRenamed("word", "ext"), ["repo", "ext"]).where(fits),
        u.join(of("name").withColumnRenamed("word", "name"), ["repo", "name"]).where(fits),
        u.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS))).join(
            of("pattern").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["repo", "salt"]
        ).where(fits & F.rlike(relative, F.col("regex"))),
    ]
    rank = F.struct("source_rank", "depth", "ordinal")
    every = reduce(DataFrame.unionByName, [h.select("repo", "path", "is_dir", rank.alias("rank"), "pattern", "negated") for h in hits])
    best = every.groupBy("repo", "path", "is_dir").agg(F.max_by(F.struct("pattern", "negated", "rank"), "rank").alias("b"))
    return best.select("repo", "path", "is_dir", F.col("b.pattern").alias("rule"), F.col("b.rank.source_rank").alias("source_rank"), (~F.col("b.negated")).alias("ignored"))


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` with rule, source_rank and ignored; rule is null where none matches.

    A file below an ignored directory is ignored, whatever is said about it further down. Directories are judged once
    each, and files meet the verdict on their own directory by equality.
    """
    own = files.select("repo", paths.directory(F.col("path")).alias("own")).where("own <> ''").distinct()
    chain = own.select("repo", "own", F.explode(paths.ancestors(F.concat("own", F.lit("/x")))).alias("path"))
    units = chain.select("repo", "path").distinct().withColumn("is_dir", F.lit(True)).unionByName(files.select("repo", "path").distinct().withColumn("is_dir", F.lit(False)))
    verdicts = _verdicts(units, rules)
    shut = verdicts.where("is_dir AND ignored").select("repo", "path", "rule", "source_rank")
    shut = chain.join(shut, ["repo", "path"]).groupBy("repo", "own").agg(F.min_by(F.struct("rule", "source_rank"), F.length("path")).alias("d"))
    said = verdicts.where("NOT is_dir").select("repo", "path", F.struct("rule", "source_rank").alias("f"), F.col("ignored").alias("f_ignored"))
    return (
        files.withColumn("own", paths.directory(F.col("path"))).join(shut, ["repo", "own"], "left").join(said, ["repo", "path"], "left")
        .withColumn("_v", F.coalesce("d", "f")).withColumn("rule", F.col("_v.rule")).withColumn("source_rank", F.col("_v.source_rank"))
        .withColumn("ignored", F.col("d").isNotNull() | F.coalesce("f_ignored", F.lit(False))).drop("own", "d", "f", "f_ignored", "_v")
    )


def with_ignores(inv: DataFrame, rules: DataFrame) -> DataFrame:
    """The inventory after ignore rules: an ignored file is not selectable, its exclusion names the source and the rule.

    The policy still wins: a file that it excludes keeps that reason.
    """
    judged = inv.join(apply_ignore_rules(inv.select("repo", "path"), rules), ["repo", "path"], "left")
    drop = F.col("ignored") & F.col("selectable")
    source = F.array(*[F.lit(s) for s in IGNORE_SOURCES])[F.col("source_rank")]
    reason = F.struct(source.alias("source"), F.lit("An ignore rule matches.").alias("reason"), F.col("rule").alias("rule"))
    return judged.withColumn("exclusion", F.when(drop, reason).otherwise(F.col("exclusion"))).withColumn(
        "selectable", F.col("selectable") & ~F.col("ignored")).drop("rule", "source_rank", "ignored")


def ignore_preview(inv: DataFrame, rules: DataFrame, effect: DataFrame | None = None) -> DataFrame:
    """Effect of candidate rules per repo: selectable files before and after, rules that hit none of them, invalid rules."""
    effect = ignored_paths(inv, rules, all_paths=True) if effect is None else effect
    counts = effect.groupBy("repo").agg(F.count("*").alias("selectable_before"), F.count_if("ignored").alias("newly_excluded"))
    used = effect.where("ignored").select("repo", F.col("rule").alias("pattern")).distinct()
    listed = lambda df, name: df.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set("pattern")), ",").alias(name))
    unmatched = listed(compile_rules(rules).where("NOT negated AND valid").join(used, ["repo", "pattern"], "left_anti"), "unmatched_rules")
    return counts.join(unmatched, "repo", "left").join(listed(invalid_rules(rules), "invalid_rules"), "repo", "left").select(
        "repo", "selectable_before", "newly_excluded",
        (F.col("selectable_before") - F.col("newly_excluded")).alias("selectable_after"),
        F.coalesce("unmatched_rules", F.lit("")).alias("unmatched_rules"), F.coalesce("invalid_rules", F.lit("")).alias("invalid_rules"),
    )


def ignored_paths(inv: DataFrame, rules: DataFrame, all_paths: bool = False) -> DataFrame:
    """Selectable files that candidate rules would exclude, with the rule (``all_paths``: the others too)."""
    judged = apply_ignore_rules(inv.where("selectable").select("repo", "path"), rules).select("repo", "path", "rule", "ignored")
    return judged if all_paths else judged.where("ignored").drop("ignored")


def path_search(files: DataFrame, term: str) -> DataFrame:
    return files.where(F.lower("path").contains(term.strip().lower())).select("repo", "path")


def special_files(inv: DataFrame) -> DataFrame:
    """Interface, configuration, automation and decision files as rows (repo, kind, path)."""
    path = F.col("path")
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    kinds = F.array_compact(F.array(
        F.when(
            F.col("selectable") & (paths.ends_with_any(low, [".proto", ".graphql", ".gql"]) | low.rlike("openapi|swagger")),
            "interface"),
        F.when(
            paths.ends_with_any(name, [".config.js", ".config.ts", ".config.mjs", ".env.example"])
            | name.rlike("^(?:tsconfig|docker-compose)")
            | name.isin("dockerfile", ".editorconfig", "tauri.conf.json"),
            "configuration"),
        F.when(
            path.rlike(r"^(?:\.github/workflows/|\.circleci/)")
            | paths.ends_with_any(path, [".gitlab-ci.yml", "azure-pipelines.yml"])
            | path.isin("Makefile", "justfile", "Taskfile.yml"),
            "automation"),
        F.when(
            F.col("selectable") & low.rlike("/adr/|decision|/rfc") & ~low.contains("template"),
            "decision"),
    ))
    return inv.select("repo", "path", F.explode(kinds).alias("kind"))


def injection_scan(files: DataFrame) -> DataFrame:
    """One row per (file, phrase) for text that reads like instructions to a model. No join: the phrases are inlined."""
    low = F.lower("content")
    hits = F.array_compact(F.array(*[F.when(low.contains(p), F.lit(p)) for p in INJECTION_PHRASES]))
    return files.select("repo", "path", F.explode(hits).alias("phrase"))


def class_counts(inv: DataFrame) -> DataFrame:
    return inv.groupBy("repo", class_label(F.col("class")).alias("label")).agg(F.count("*").alias("files"))


def selectable_bytes(inv: DataFrame) -> DataFrame:
    return inv.where("selectable").groupBy("repo").agg(
        F.count("*").alias("selectable_files"), F.sum("size_bytes").alias("selectable_bytes")
    )


def source_revision(inv: DataFrame) -> DataFrame:
    """Content revision per repo.

    Paths are unique, so the ordered list of files is determined by their set:
    per-file digests are summed in four lanes, which partial aggregation folds
    before the shuffle, instead of hashing one repo-long string in one task.
    """
    row = F.concat_ws("\u0000", "path", F.col("size_bytes").cast("string"), F.coalesce("content_hash", F.lit("")))
    lanes = ordering.digest_lanes(row)
    df = inv.select("repo", *[l.alias(f"_d{i}") for i, l in enumerate(lanes)])
    sums = ordering.set_digest([f"_d{i}" for i in range(4)])
    joined = F.concat_ws(":", F.count("*").cast("string"), *sums)
    return df.groupBy("repo").agg(joined.alias("_d")).select(
        "repo", F.concat(F.lit("scan:"), F.left(F.sha2(F.col("_d").cast("binary"), 256), F.lit(40))).alias("source_revision")
    )


def project_fingerprint(repo: Column) -> Column:
    return F.concat(F.lit("proj_"), F.left(F.sha2(F.concat(F.lit("path:"), repo).cast("binary"), 256), F.lit(24)))
