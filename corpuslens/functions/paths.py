"""Path predicates and helpers: string column in, column out; no UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens import policy as P


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def normalize_path(path: Column) -> Column:
    """Forward slashes, ordinary segments only."""
    kept = F.filter(F.split(slashes(path), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.array_join(kept, "/")


def escapes_root(path: Column) -> Column:
    """True for absolute paths and for paths with a parent segment."""
    p = slashes(path)
    return p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..")


def file_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def directory(path: Column) -> Column:
    """Parent directory, '' at the top."""
    above = F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    return F.when(F.contains(path, F.lit("/")), above).when(path.isNotNull(), "")


def extension(path: Column) -> Column:
    """Lower-cased extension; '' when the name has none (a leading dot alone is no extension)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def ancestors(path: Column) -> Column:
    """Every ancestor directory of a file path, outermost first."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
        ),
    ).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: str) -> str:
    """A ``**/name`` style glob as an anchored regular expression; ``*`` also crosses '/'."""
    out, rest = "", pattern
    if rest.startswith("**/"):
        out, rest = "(?:.*/)?", rest[3:]
    tail = ""
    if rest.endswith("/**"):
        rest, tail = rest[:-3], "/.*"
    return out + ".*".join(re.escape(part) for part in rest.split("*")) + tail


def any_of(patterns: list[str]) -> str:
    return "^(?:" + "|".join(patterns) + ")$"


def contains_any(text: Column, markers: list[str]) -> Column:
    return text.rlike("|".join(re.escape(m) for m in markers))


def ends_with_any(text: Column, suffixes: list[str]) -> Column:
    return text.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + r")\z")


def is_sensitive(path: Column) -> Column:
    p = slashes(path)
    deny = p.rlike(any_of([glob_regex(g) for g in P.SENSITIVE_GLOBS]))
    allow = p.rlike(any_of([glob_regex(g) for g in P.SENSITIVE_ALLOW_GLOBS]))
    return deny & ~allow


def is_lockfile(path: Column) -> Column:
    return file_name(path).isin(P.LOCKFILE_NAMES)


def is_generated(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), slashes(path))
    return contains_any(rooted, P.GENERATED_DIR_MARKERS) | ends_with_any(rooted, P.GENERATED_SUFFIXES)


def is_test(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), slashes(path))
    name = file_name(path)
    return (
        contains_any(rooted, P.TEST_DIR_MARKERS)
        | contains_any(name, P.TEST_NAME_MARKERS)
        | name.startswith("test_")
        | name.startswith("Test")
    )


def is_test_for_index(path: Column) -> Column:
    """The index's own test rule: lower-cased, fewer directories, language-specific name endings."""
    low = F.lower(path)
    name = F.substring_index(low, "/", -1)
    parts = F.split(low, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return (
        F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in ("test", "tests", "__tests__", "spec", "fixtures")]))
        | name.contains(".test.")
        | name.contains(".spec.")
        | name.startswith("test_")
        | ends_with_any(name, ["_test.go", "_test.py", "_test.rs"])
    )


def is_docs(path: Column) -> Column:
    return contains_any(F.concat(F.lit("/"), slashes(path)), P.DOCS_DIR_MARKERS)


def is_data_file(path: Column) -> Column:
    return extension(path).isin(P.DATA_EXTENSIONS)


def large_from(path: Column, policy: P.Policy) -> Column:
    """Bytes above which a file of this name is called large."""
    return F.when(is_data_file(path), F.lit(policy.large_data_file_bytes)).otherwise(F.lit(policy.large_file_bytes)).cast("long")


def size_class(path: Column, size: Column, policy: P.Policy) -> Column:
    """``large_data``, ``large`` or ``normal``: for information, nothing is left out because of it."""
    large = size > large_from(path, policy)
    return F.when(large & is_data_file(path), "large_data").when(large, "large").otherwise("normal")


def has_binary_extension(path: Column) -> Column:
    return extension(path).isin(P.BINARY_EXTENSIONS)


def is_hidden(path: Column) -> Column:
    dotted = F.exists(F.split(slashes(path), "/"), lambda s: s.startswith(".") & ~s.isin(".", ".."))
    return dotted | file_name(path).isin("Thumbs.db", "desktop.ini")


def in_skipped_dir(path: Column) -> Column:
    """A directory segment (never the file name) that a scan does not enter."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(d) for d in P.SKIPPED_DIRS]))


def consequential_kind(path: Column) -> Column:
    """Why a change to this path matters beyond the file itself; null when it does not."""
    norm = slashes(F.regexp_replace(F.trim(path), r"^(?:\./)++", ""))
    low = F.lower(norm)
    name = F.substring_index(low, "/", -1)
    parts = F.split(low, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def in_dir(names: list[str]) -> Column:
        return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names]))

    build = (
        name.isin(P.MANIFEST_NAMES)
        | name.rlike(r"^requirements.*\.txt\z")
        | name.endswith(".csproj")
        | name.rlike(r"^(?:dockerfile|docker-compose|vite\.config\.|webpack\.config\.)")
        | in_dir([".cargo"])
    )
    return (
        F.when(is_lockfile(norm), "dependency lockfile")
        .when(build, "build or dependency configuration")
        .when(name.isin(P.CI_NAMES) | in_dir(P.CI_DIRS), "CI configuration")
        .when(in_dir(P.INFRA_DIRS) | name.endswith(".tf") | name.endswith(".tfvars"), "deployment configuration")
        .when(in_dir(["migrations", "migration"]), "database migration")
        .when(name.isin(P.PERMISSION_NAMES) | in_dir(["capabilities"]), "ignore rules or app permissions")
    )


LANGUAGES = {
    "rs": "rust", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "c": "c", "h": "c",
    "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "md": "markdown", "markdown": "markdown",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "sql": "sql",
    "sh": "shell", "bash": "shell", "zsh": "shell",
}

FENCE_HINTS = {
    "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript",
    "cjs": "javascript", "jsx": "jsx", "py": "python", "go": "go", "java": "java", "kt": "kotlin",
    "kts": "kotlin", "swift": "swift", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp",
    "hpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash",
    "zsh": "bash", "ps1": "powershell", "sql": "sql", "html": "html", "css": "css", "scss": "scss",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "md": "markdown",
    "markdown": "markdown", "dockerfile": "dockerfile",
}


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    by_value: dict[str, list[str]] = {}
    for k, v in table.items():
        by_value.setdefault(v, []).append(k)
    out = None
    for value, keys in by_value.items():
        cond = key.isin(keys)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default)


def language_of(path: Column) -> Column:
    """Language label from the text after the last dot, case kept; 'unknown' otherwise."""
    return _lookup(F.regexp_extract(path, r"\.([^.]*)$", 1), LANGUAGES, "unknown")


def fence_hint(path: Column) -> Column:
    return _lookup(F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1)), FENCE_HINTS, "")
