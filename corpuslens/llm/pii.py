"""Personal data: four kinds found by rule, and terms that disclose them found by corpus co-occurrence.

Everything here is DataFrame and SQL functions. A term is judged by its pointwise mutual information with a protected
value (an address, number, ...) relative to what the value itself tells: log(P(e|t) / P(e)) / log(1 / P(e)), which is 1
for a term that occurs only where the value does and about 0 for one that is independent of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import boxed, components, table

#: Code points on each side of a protected value in which terms count as occurring with it.
CONTEXT = 64
#: Different contexts that a term must share with a value, and the disclosures from which it is generalised or removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.8, 0.95
#: Texts round a value are copies of one another if the sets of their terms, WIDE code points to each side, overlap by
#: ALIKE or more; bands and rows of the signatures by which candidates meet (a pair at ALIKE: probability 0.9999).
WIDE, ALIKE, BANDS, ROWS = 512, 0.8, 16, 3
#: Slots of the filter by which documents without a term in question are passed over. It is of fixed size; where many
#: terms are in question it lets more words through to the join that decides.
SLOTS = 1 << 16

TERM = r"\p{L}[\p{L}\p{N}]{2,}"
KINDS = ("email", "ip", "card", "phone")
# The patterns below match what the published rules match, without backtracking: the place where a run of characters
# begins is stated by look-behind, or by the end of the match before it. Counts of digits are part of a pattern where
# a run can hold one match only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*[0-9]){7,14}+(?![ ().-]*[0-9])",
}
BYTE_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _luhn(digits: Column) -> Column:
    padded = F.lpad(digits, 20, "0")
    digit = lambda i: padded.substr(i, F.lit(1)).cast("int")
    worth = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")
    if kind == "card":
        return _luhn(F.regexp_replace(found, "[^0-9]", ""))
    return F.lit(True)


def _found(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


_NONE = "array<struct<start:long,end:long,value:string,before:string,after:string>>"


def _positioned(items: Column) -> Column:
    """Items (gap before, found text, contexts) as spans. Sums run inside stretches of 256 and over the stretches, so
    a text with very many matches does not copy its list for each of them."""
    count = F.ceil(F.size(items) / 256).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.slice(items, c * 256 + 1, F.lit(256)))
    lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + F.length(x["value"])))
    starts = F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def stretch(p, i):
        zero = F.struct(starts[i].alias("at"), F.array().cast(_NONE).alias("out"))
        return F.aggregate(p, zero, step, lambda acc: acc["out"])

    return F.flatten(F.transform(parts, stretch))


def _spans(df: DataFrame, text: str, name: str, pattern: Column, kind: str = "") -> DataFrame:
    """``df`` with ``name``: the matches of ``pattern`` as spans in code points. Matches are what lies between the
    pieces that ``split`` leaves, so their places follow from the lengths."""
    none = F.array().cast(_NONE)
    df = df.withColumn("_m", _found(F.col(text), pattern))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)))
    before = lambda g: F.when(F.length(g) > CONTEXT, F.regexp_replace(F.substring(g, -CONTEXT, CONTEXT), r"^[\p{L}\p{N}]+", "")).otherwise(g)
    after = lambda g: F.when(F.length(g) > CONTEXT, F.regexp_replace(F.substring(g, 1, CONTEXT), r"[\p{L}\p{N}]+$", "")).otherwise(g)
    item = lambda m, i: F.struct(
        F.length(F.col("_g")[i]).cast("long").alias("gap"), m.alias("value"), before(F.col("_g")[i]).alias("before"), after(F.col("_g")[i + 1]).alias("after")
    )
    df = df.withColumn("_i", F.when(F.size("_m") > 0, F.transform("_m", item)))
    df = df.withColumn(name, F.when(F.size("_m") > 0, F.filter(_positioned(F.col("_i")), lambda s: _valid(kind, s["value"]))).otherwise(none))
    return df.drop("_m", "_g", "_i")


def base_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and _text (null is empty) with one array of spans for each kind."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    for kind in KINDS:
        df = _spans(df, "_text", f"_{kind}", F.lit(PATTERNS[kind]), kind)
    return df


@dataclass
class Flags:
    """Terms that disclose: ``terms`` has term and action (general, removed); ``slots`` is their filter."""

    terms: DataFrame | None
    slots: bytearray | None


def _slots(terms: DataFrame) -> bytearray | None:
    used = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(SLOTS)).alias("s")).distinct().collect()]  # at most SLOTS small numbers
    if not used:
        return None
    out = bytearray(SLOTS)
    for s in used:
        out[s] = 1
    return out


def _passes(term: Column, slots: bytearray) -> Column:
    return F.substring(F.lit(bytes(slots)), F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def _entities(kind: str) -> Column:
    """The kind's spans as protected values with their contexts and the hashed terms of the text round them."""
    def around(s):
        at = F.greatest(s["start"] - WIDE, F.lit(0))
        text = F.replace(F.col("_text").substr((at + 1).cast("int"), (s["end"] - at + WIDE).cast("int")), s["value"], F.lit(" "))
        return F.array_sort(F.array_distinct(F.transform(_found(F.lower(text), F.lit(TERM)), lambda w: F.hash(w))))

    return F.transform(
        f"_{kind}", lambda s: F.struct(F.concat(F.lit(f"{kind}:"), F.lower(s["value"])).alias("e"), F.concat_ws(" | ", s["before"], s["after"]).alias("c"), around(s).alias("w"))
    )


def _near_copies(nodes: DataFrame) -> DataFrame:
    """(node, class) of ``nodes`` (node, e, w): texts round one value whose term sets overlap by ALIKE, directly or
    through others. In each band the texts of a bucket are compared with one of them, in full; no pairs are expanded."""
    least = lambda i: F.array_min(F.transform("w", lambda x: F.hash(x, F.lit(i))))
    keys = F.array(*[F.xxhash64("e", F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])
    met = table(nodes.select("node", F.explode(keys).alias("key")))
    lead = met.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = met.join(lead, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    one, two = (nodes.select(F.col("node").alias(c), F.col("e").alias(f"e_{c}"), F.col("w").alias(f"w_{c}")) for c in "ab")
    alike = F.size(F.array_intersect("w_a", "w_b")) >= F.lit(ALIKE) * F.size(F.array_union("w_a", "w_b"))
    links = pairs.join(two, "b").join(one, "a").where((F.col("e_a") == F.col("e_b")) & alike).select("a", "b")
    comps = table(components(table(links), "a", "b"))
    return nodes.select("node").join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("class"))


def disclosing_terms(docs: DataFrame) -> Flags:
    """Learns from all of ``docs`` which terms disclose a protected value.

    P(t) and P(e) are shares of documents, P(t, e) is the share of documents in which t stands within CONTEXT of e.
    Occurrences of e in copies and near copies of one text are one class, and a class counts as its first document in
    P(e), P(t, e) and, as far as t stands near e, in P(t); every value keeps its terms. A term must share SUPPORT
    classes with the value. Counts cover all rows; all are folded before they are shuffled.
    """
    found = base_spans(docs, []).withColumn("row", F.monotonically_increasing_id())
    every = F.concat(*map(_entities, KINDS))
    seen = found.where(F.size(F.concat(*[f"_{k}" for k in KINDS])) > 0).select("row", F.explode(every).alias("s"))
    seen = table(seen.select("row", F.sha2("s.e", 256).alias("e"), F.lower("s.c").alias("c"), "s.w", F.xxhash64("s.w").alias("h")))
    several = seen.groupBy("e").agg(F.countDistinct("h").alias("n")).where(F.col("n") >= SUPPORT).select("e")
    nodes = table(seen.join(several, "e").groupBy("e", "h").agg(F.any_value("w").alias("w")).withColumn("node", F.monotonically_increasing_id()))
    named = nodes.select("e", "h", "node").join(_near_copies(nodes), "node").select("e", "h", "class")
    seen = table(seen.select("row", "e", "c", "h").join(named, ["e", "h"]).drop("h"))
    seen = seen.join(seen.groupBy("class").agg(F.min("row").alias("first")), "class")
    n_e = seen.groupBy("e").agg(F.countDistinct("row").alias("all_e"), F.countDistinct("first").alias("n_e"), F.countDistinct("class").alias("classes"))
    n_e = table(n_e.where(F.col("classes") >= SUPPORT).drop("classes"))
    terms = F.explode(F.array_distinct(_found(F.col("c"), F.lit(TERM))))
    pairs = seen.join(n_e.select("e"), "e").select("row", "e", "class", "first", terms.alias("term")).groupBy("e", "term").agg(
        F.countDistinct("row").alias("all_te"), F.countDistinct("first").alias("n_te"), F.countDistinct("class").alias("support")
    )
    pairs = table(pairs.where(F.col("support") >= SUPPORT).join(n_e, "e"))
    slots = _slots(pairs)
    if slots is None:
        return Flags(None, None)
    words = F.array_distinct(_found(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM)))
    n_t = docs.select(F.explode(F.filter(words, lambda w: _passes(w, slots))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    n = F.lit(float(docs.count())) - F.col("all_e") + F.col("n_e")
    known = F.log2(n / F.col("n_e"))
    score = F.when(known > 0, F.log2(F.col("n_te") * n / ((F.col("n_t") - F.col("all_te") + F.col("n_te")) * F.col("n_e"))) / known).otherwise(0.0)
    scored = pairs.join(n_t, "term").groupBy("term").agg(F.max(score).alias("score"))
    flagged = scored.where(F.col("score") >= GENERALISE).select("term", F.when(F.col("score") >= REMOVE, "removed").otherwise("general").alias("action"))
    flagged = table(flagged)
    return Flags(flagged, _slots(flagged))


def _with_terms(docs: DataFrame, flags: Flags) -> DataFrame:
    """``docs`` with _general and _removed: patterns of the flagged words of each text, null where there are none.

    Texts none of whose words pass the filter are not shuffled. The others are joined by digest with the verdicts on
    their words; a text with many copies is one row of verdicts.
    """
    nothing = {c: F.lit(None).cast("string") for c in ("_general", "_removed")}
    if flags.slots is None:
        return docs.withColumns(nothing)
    docs = docs.withColumn("_hits", F.array_distinct(F.filter(_found(F.coalesce("text", F.lit("")), F.lit(TERM)), lambda w: _passes(F.lower(w), flags.slots))))
    clear = docs.where(F.size("_hits") == 0).drop("_hits").withColumns(nothing)
    hit = docs.where(F.size("_hits") > 0).withColumn("_digest", F.sha2(F.col("text").cast("binary"), 256))
    words = hit.select("_digest", F.explode("_hits").alias("word")).withColumn("term", F.lower("word")).distinct()
    judged = words.join(flags.terms, "term").groupBy("_digest").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("action") == a, F.col("word")))).alias(f"_{a}") for a in ("general", "removed")]
    )
    pattern = lambda c: F.when(F.size(c) > 0, F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(c, "|"), F.lit(r")(?![\p{L}\p{N}])")))
    judged = judged.select("_digest", pattern("_general").alias("_general"), pattern("_removed").alias("_removed"))
    return clear.unionByName(hit.join(judged, "_digest", "left").drop("_hits", "_digest"))


def _label(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def find(docs: DataFrame, flags: Flags | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_general, n_removed of each row of ``docs``.

    A null text is empty. Base spans are leftmost and do not overlap within a kind; matches with a part over 255, a
    wrong check digit or count of digits are dropped. Disclosing terms follow as kinds ``general`` and ``removed``,
    words only. Offsets are code points, ends exclusive; spans are ordered by kind, then start. A null doc_id is
    passed on; repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    flags = disclosing_terms(docs) if flags is None else flags
    df = base_spans(_with_terms(docs.select("doc_id", "text"), flags), ["doc_id", "_general", "_removed"])
    never = r"\z(?<!\z)"
    for action in ("general", "removed"):
        if flags.slots is None:
            df = df.withColumn(f"_t_{action}", F.array().cast(_NONE))
        else:
            df = _spans(df, "_text", f"_t_{action}", F.coalesce(f"_{action}", F.lit(never)))
    base = F.concat(*[_label(k, F.col(f"_{k}")) for k in KINDS])
    df = df.withColumn("_base", F.array_join(base, ","))
    more = F.concat(*[_label(a, F.col(f"_t_{a}")) for a in ("general", "removed")])
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.col("_base").cast("binary"), 256).alias("base_sha256"),
        F.when(F.size(more) == 0, F.col("_base")).when(F.col("_base") == "", F.array_join(more, ",")).otherwise(F.concat_ws(",", "_base", F.array_join(more, ","))).alias("spans"),
        *[F.size(f"_t_{a}").cast("long").alias(f"n_{a}") for a in ("general", "removed")],
    )


def _masked(kind: str) -> Column:
    return F.transform("_m", lambda m: F.when(_valid(kind, m), f"[{kind.upper()}]").otherwise(m))


def sanitised(docs: DataFrame, flags: Flags | None = None) -> DataFrame:
    """``docs`` with protected values replaced by their kind, disclosing terms generalised to ``[TERM]`` or taken out.

    Kinds are masked one after the other. Null texts stay null, n_chars follows the text, other columns stay.
    """
    flags = disclosing_terms(docs) if flags is None else flags
    names = docs.columns
    docs, unboxed = boxed(docs, ["text", "n_chars"])
    df = _with_terms(docs, flags)
    for kind in KINDS:
        df = df.withColumn("_m", _found(F.col("text"), F.lit(PATTERNS[kind])))
        df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split(F.col("text"), F.lit(PATTERNS[kind]), -1)))
        masked = _masked(kind)
        df = df.withColumn("_r", F.when(F.size("_m") > 0, masked))
        joined = F.array_join(F.flatten(F.transform("_g", lambda g, i: F.array(g, F.coalesce(F.get("_r", i), F.lit(""))))), "")
        df = df.withColumn("text", F.when(F.size("_m") > 0, joined).otherwise(F.col("text"))).drop("_m", "_g", "_r")
    if flags.slots is not None:
        for action, put in (("general", "[TERM]"), ("removed", "")):
            df = df.withColumn("text", F.when(F.col(f"_{action}").isNotNull(), F.regexp_replace(F.col("text"), F.col(f"_{action}"), F.lit(put))).otherwise(F.col("text")))
    if "n_chars" in names:
        df = df.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return unboxed(df)
