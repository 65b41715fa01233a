"""Text helpers: byte sizes, newlines, lines, truncation, binary probe, token estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUNCATION_MARKER = "\n… [truncated]\n"


def byte_len(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind (``trim`` alone only drops blanks).

    Looks at both ends only; a pattern for the trailing run would start anew at every inner blank.
    """
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def strip_of(text: Column, chars: str) -> Column:
    """Without leading and trailing characters of a class. A trailing run is tried where it starts, not at each of its characters."""
    return F.regexp_replace(text, rf"^[{chars}]++|(?<![{chars}])[{chars}]++\z", "")


def human_bytes(size: Column) -> Column:
    """1024-based label with one decimal; ties go to the even digit."""
    size = size.cast("long")
    label = F.concat(size.cast("string"), F.lit(" B"))
    out = F.when(size < 1024, label)
    for power, unit in enumerate(("KB", "MB", "GB"), start=1):
        value = F.format_string("%.1f", F.bround(size / F.lit(float(1024**power)), 1))
        out = out.when(size < 1024 ** (power + 1), F.concat(value, F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(size / F.lit(float(1024**4)), 1)), F.lit(" TB")))


def normalize_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _split_lines(text: Column) -> Column:
    """Pieces between line ends of a text that is not empty; a final line end adds no piece.

    CRLF counts as one line end, a bare CR stays. Everything is done on the
    whole text, so nothing has to be looked at again per line.
    """
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.split(F.regexp_replace(unix, r"\n\z", ""), "\n", -1)


def line_array(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(_split_lines(text))


def explode_lines(df: DataFrame, text: str = "content", keep: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """One row per line: ``keep`` columns, ``line_no`` from 1, ``line``. No shuffle, and no row carries the text along."""
    return (
        df.where(F.col(text) != "")
        .select(*keep, F.posexplode(_split_lines(F.col(text))).alias("_i", "line"))
        .select(*keep, (F.col("_i") + 1).cast("long").alias("line_no"), "line")
    )


def number_lines(text: Column) -> Column:
    """Each line behind its right-aligned number. The line array is bound as a variable: a lambda would split the text anew for every line."""
    def numbered(lines: Column) -> Column:
        width = F.length(F.size(lines).cast("string"))
        return F.array_join(
            F.transform(
                lines,
                lambda l, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit(" | "), l, F.lit("\n")),
            ),
            "",
        )

    return F.get(F.transform(F.array(line_array(text)), numbered), F.lit(0))


def truncate_utf8(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters with at most ``limit`` bytes."""
    raw = F.encode(text, "UTF-8")
    cut = F.coalesce(*[F.try_validate_utf8(F.substring(raw, 1, max(limit - k, 0)).cast("string")) for k in range(4)])
    return F.when(F.octet_length(text) <= limit, text).otherwise(cut)


def looks_binary(content: Column) -> Column:
    """Probe of a whole binary value: byte-order marks, NUL, share of control bytes above 10 %."""
    n = F.octet_length(content)
    start = F.hex(F.substring(content, 1, 3))
    latin = F.decode(content, "ISO-8859-1")
    control = n - F.length(F.regexp_replace(latin, r"[\x00-\x08\x0E-\x1F\x7F]", ""))
    return (
        F.when(n == 0, False)
        .when(start == "EFBBBF", False)
        .when(start.startswith("FFFE") | start.startswith("FEFF"), True)
        .when(latin.contains("\x00"), True)
        .otherwise(F.floor(control * 100 / n) > 10)
    )


def tokens_bytes4(text: Column) -> Column:
    """Token estimate, kind ``bytes_div_4``."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def tokens_words(text: Column) -> Column:
    """Token estimate, kind ``words``."""
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


# Fixed value: the published split pattern of the cl100k family.
PRETOKEN_PATTERN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    r"| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
)


def tokens_pretokens(text: Column) -> Column:
    """Token estimate, kind ``pretokens``: pieces before any merge table is applied."""
    return F.regexp_count(text, F.lit(PRETOKEN_PATTERN)).cast("long")


ESTIMATE_LABELS = {
    "bytes_div_4": "local estimate (bytes / 4)",
    "words": "whitespace words",
    "pretokens": "pre-token count, no merges applied",
}


def estimate_label(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, label in ESTIMATE_LABELS.items():
        out = out.when(kind == k, label)
    return out.otherwise("unavailable")


def sanitize_message(message: Column) -> Column:
    """Absolute paths in error text become ``<path>``."""
    words = F.filter(F.split(message, r"\s+"), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.when(w.startswith("/") | w.contains(":\\"), "<path>").otherwise(w)), " "
    )


def revision_label(revision: Column) -> Column:
    """Short form of a revision: seven characters of a git id, else twenty characters."""
    rest = F.substring_index(F.regexp_replace(revision, "^git:", ""), "+dirty", 1)
    git = F.concat(
        F.lit("`"), F.left(rest, F.lit(7)), F.lit("`"),
        F.when(revision.endswith("+dirty"), " + uncommitted changes").otherwise(""),
    )
    return F.when(revision.startswith("git:"), git).otherwise(
        F.concat(F.lit("`"), F.left(revision, F.lit(20)), F.lit("`"))
    )


def capped_list(items: Column, cap: int, total: Column | None = None) -> Column:
    """`` `a`, `b` (+N more)``."""
    total = F.size(items) if total is None else total
    shown = F.array_join(F.transform(F.slice(items, 1, cap), lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    more = F.when(total > cap, F.concat(F.lit(" (+"), (total - cap).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(shown, more)


def slug(text: Column, default: str = "model") -> Column:
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.left(F.regexp_replace(s, "^-+|-+$", ""), F.lit(32)), "-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))
