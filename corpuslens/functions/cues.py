"""Prompt cues: fixed weighted word lists and how they are matched.

Fixed values throughout: the weights and words decide intents and scores.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.text import strip_of

INTENTS = ["CODE_EDIT", "BUG_FIX", "REFACTOR", "EXPLANATION", "CREATIVE_WRITING", "GENERAL_QA", "RESEARCH",
           "SUMMARIZATION", "ARCHITECTURE", "OTHER"]
MODIFYING = ["CODE_EDIT", "BUG_FIX", "REFACTOR"]

BASE_REPOSITORY = {"CODE_EDIT": 5.0, "BUG_FIX": 5.0, "REFACTOR": 5.0, "ARCHITECTURE": 2.0, "EXPLANATION": 0.5,
                   "SUMMARIZATION": 0.5, "RESEARCH": 0.5, "GENERAL_QA": 0.5, "OTHER": 0.5, "CREATIVE_WRITING": 0.0}
BASE_REASONING = {"ARCHITECTURE": 6.0, "BUG_FIX": 4.5, "REFACTOR": 4.5, "RESEARCH": 4.5, "CREATIVE_WRITING": 3.0,
                  "CODE_EDIT": 2.0, "EXPLANATION": 2.0, "SUMMARIZATION": 2.0, "GENERAL_QA": 2.0, "OTHER": 2.5}

# (intent, weight, phrases)
INTENT_CUES = [
    ("CREATIVE_WRITING", 3.0, ["story", "poem", "poetry", "fiction", "novel", "narrative", "screenplay", "lyrics", "limerick", "sonnet",
                               "fairy tale", "short story", "sci-fi", "fantasy", "plot", "protagonist", "creative", "haiku about"]),
    ("EXPLANATION", 2.0, ["explain", "what is", "what are", "what does", "how does", "how do", "why does", "why is", "meaning of",
                          "difference between", "understand", "describe", "teach me", "walk me through", "eli5"]),
    ("SUMMARIZATION", 3.0, ["summarize", "summarise", "summary", "tl;dr", "tldr", "recap", "condense"]),
    ("RESEARCH", 2.0, ["research", "compare", "comparison", "investigate", "survey", "pros and cons", "alternatives", "evaluate",
                       "which is better", "state of the art"]),
    ("ARCHITECTURE", 2.5, ["architecture", "architect", "system design", "design a", "design the", "scalable", "microservice",
                           "data model", "trade-off", "tradeoff", "how should we structure", "high-level design"]),
    ("BUG_FIX", 3.0, ["fix", "bug", "broken", "crash", "error", "exception", "failing", "fails", "not working", "doesn't work",
                      "does not work", "regression", "panic", "debug", "stack trace", "incorrect", "wrong result"]),
    ("REFACTOR", 3.0, ["refactor", "restructure", "migrate", "migration", "rewrite", "reorganize", "reorganise", "modularize",
                       "decouple", "clean up", "cleanup", "extract into", "split into", "consolidate", "port to"]),
    ("CODE_EDIT", 2.0, ["change", "add", "update", "modify", "implement", "create", "remove", "delete", "replace", "rename",
                        "make the", "set the", "increase", "decrease", "move the", "hide", "show the", "enable", "disable", "support for"]),
    ("CODE_EDIT", 1.0, ["button", "label", "component", "function", "method", "endpoint", "field", "column", "page", "screen", "modal",
                        "css", "style", "color", "colour", "text", "placeholder", "tooltip", "header", "footer", "navbar"]),
]

QUESTION_WORDS = ["what", "why", "how", "who", "when", "where", "which", "is", "are", "can", "does", "do"]
ASKING_WORDS = ["explain", "describe", "summarize", "summarise"]

CODE_NOUNS = ["button", "component", "function", "method", "class", "module", "file", "endpoint", "api", "route", "page", "screen",
              "modal", "form", "handler", "service", "controller", "model", "schema", "table", "query", "test", "tests", "config",
              "settings", "hook", "store", "state", "backend", "frontend", "server", "client", "database", "db", "ui", "codebase",
              "repo", "repository", "project", "app", "application", "bug", "login", "signup", "auth", "authentication", "session",
              "navbar", "sidebar", "header", "footer", "migration", "build", "pipeline", "command", "cli"]
DEICTIC = ["the", "our", "my", "this", "that", "these", "its", "existing"]

LAYERS = [
    ("frontend", ["frontend", "ui", "button", "page", "component", "css", "react", "view", "screen", "front-end"]),
    ("backend", ["backend", "server", "api", "apis", "endpoint", "endpoints", "handler", "back-end"]),
    ("data", ["database", "db", "schema", "migration", "migrate", "table", "sql", "users", "records"]),
    ("auth", ["auth", "authentication", "oauth", "login", "session", "jwt", "token", "sso", "password"]),
    ("tests", ["test", "tests", "testing", "spec", "coverage"]),
    ("build", ["build", "ci", "pipeline", "deploy", "deployment", "docker", "release"]),
]

DOMAIN_TERMS = [
    (2.0, ["oauth", "jwt", "crypto", "encryption", "cryptography", "security", "authentication", "saml", "sso"]),
    (2.0, ["concurrency", "concurrent", "thread", "threads", "race", "deadlock", "async", "lock", "mutex"]),
    (2.0, ["distributed", "consensus", "replication", "kubernetes", "sharding"]),
    (1.5, ["migration", "migrate", "schema", "transaction", "sql", "index", "database"]),
    (2.0, ["compiler", "parser", "interpreter", "type system", "borrow checker"]),
    (1.5, ["payment", "billing", "invoice", "stripe"]),
    (1.5, ["performance", "optimize", "optimise", "latency", "memory leak", "profiling"]),
]
RISK_TERMS = [
    (3.0, ["migrate existing", "existing users", "production", "prod data", "drop table", "wipe", "delete all", "remove all"]),
    (2.0, ["auth", "authentication", "oauth", "password", "credential", "secret", "token", "permission", "encryption", "session"]),
    (1.5, ["migration", "migrate", "payment", "billing", "delete", "security"]),
]
HARD_REASONING = ["why", "optimize", "optimise", "performance", "race", "deadlock", "intermittent", "algorithm", "prove", "tradeoff",
                  "trade-off", "migrate", "migration", "root cause", "memory leak", "architecture", "security", "concurrency", "oauth"]
SCOPE_QUANTIFIERS = ["all ", "every ", "entire", "whole ", "across", "everywhere", "codebase-wide", "project-wide", "throughout"]
ACTION_VERBS = ["add", "change", "update", "fix", "refactor", "migrate", "remove", "delete", "create", "implement", "rename", "replace",
                "move", "write", "explain", "rewrite", "extract", "split", "convert", "port", "test", "document", "summarize", "compare",
                "design", "make", "set", "build", "deploy", "configure", "introduce", "support", "handle"]
GENERIC_WORDS = ["src", "lib", "main", "index", "mod", "app", "test", "tests", "the", "and", "for", "with", "utils", "util", "types",
                 "readme", "components", "pages", "docs", "public", "assets", "styles", "package", "config", "build", "dist", "bin"]
CODE_EXTENSIONS = [".rs", ".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".kt", ".rb", ".php", ".cs", ".css", ".scss", ".html",
                   ".json", ".toml", ".yaml", ".yml", ".sql", ".md", ".swift", ".c", ".cpp", ".h"]
CLAUSE_BREAKS = [", and then ", " and then ", ", and ", " and also ", " then ", " and ", ";", ". "]

LONGEST_CUE = 16


def lit_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def stems(lower: Column) -> Column:
    """Every word of the prompt and its prefixes of four characters and more, once.

    A one-word cue is hit by the same word, or by a longer word when the cue
    has at least four characters; with the stems at hand, counting the cues of
    a list that are hit is one set intersection.
    """
    words = F.array_distinct(F.filter(F.split(lower, r"[^\p{L}\p{N}']+"), lambda w: w != ""))
    cut = F.transform(words, lambda w: F.when(
        F.length(w) > 4,
        F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(LONGEST_CUE))), lambda i: F.substring(w, F.lit(1), i)),
    ).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(words, F.flatten(cut)))


def is_plain(phrase: str) -> bool:
    return not any(c in phrase for c in " -;")


def found_cues(stem_col: Column, lower: Column, phrases: list[str]) -> Column:
    """Those of ``phrases`` that occur, once each: phrases with a blank, '-' or ';' as substrings, words by stem."""
    plain = [p for p in phrases if is_plain(p)]
    other = [p for p in phrases if not is_plain(p)]
    return F.concat(F.array_intersect(stem_col, lit_array(plain)), F.filter(lit_array(other), lambda p: F.contains(lower, p)))


def hits(cues: Column, phrases: list[str]) -> Column:
    """How many of ``phrases`` are among the found ones."""
    return F.size(F.array_intersect(cues, lit_array(phrases)))


def every_phrase() -> list[str]:
    """All phrases that any score asks for."""
    lists = [p for _, _, p in INTENT_CUES] + [p for _, p in DOMAIN_TERMS + RISK_TERMS] + [HARD_REASONING, ["architecture"]]
    return list(dict.fromkeys(p for phrases in lists for p in phrases))


def split_identifier(identifier: Column) -> Column:
    """``LoginButton``, ``login_button`` and ``login-button`` as lower-cased words."""
    broken = F.regexp_replace(identifier, r"([\p{Ll}0-9])(\p{Lu})", "$1_$2")
    return F.filter(F.split(F.lower(broken), "[_ -]+"), lambda w: w != "")


def code_artifacts(prompt: Column) -> Column:
    """Sorted distinct tokens that look like paths, files, calls or identifiers."""
    raw = F.filter(F.split(prompt, r"\s+"), lambda w: w != "")
    pair = F.transform(raw, lambda r: F.struct(r.alias("raw"), strip_of(r, r",;:\"'()?!.").alias("t")))
    ext = "(?i)(?:" + "|".join(e.replace(".", r"\.") for e in CODE_EXTENSIONS) + r")\z"

    def looks_like_code(x: Column) -> Column:
        t, r = x["t"], x["raw"]
        name = t.rlike(r"^[\p{L}\p{N}_]+\z")
        return (t != "") & (
            (t.contains("/") & (F.octet_length(t) > 2) & ~t.startswith("http"))
            | t.rlike(ext) | r.startswith("`") | r.endswith("`") | t.endswith("()")
            | (t.rlike(r"^.+\p{Lu}") & t.rlike(r"\p{Ll}") & name)
            | (t.contains("_") & name))

    found = F.transform(F.filter(pair, looks_like_code), lambda x: strip_of(x["t"], "`"))
    return F.array_sort(F.array_distinct(found))


def clause_marks(lower: Column) -> Column:
    """For each clause, whether it carries an action verb."""
    text = lower
    for b in CLAUSE_BREAKS:
        text = F.replace(text, F.lit(b), F.lit(","))
    verbs = lit_array(ACTION_VERBS)
    trimmed = lambda c: F.transform(F.split(c, r"\s+"), lambda w: strip_of(w, r"^\p{L}\p{N}"))
    return F.transform(F.split(text, ","), lambda c: F.arrays_overlap(trimmed(c), verbs))


def operation_count(marks: Column) -> Column:
    """Clauses that carry an action verb, at least one."""
    return F.greatest(F.size(F.filter(marks, lambda m: m)), F.lit(1))


def _det(w: Column) -> Column:
    return F.array_contains(lit_array(DEICTIC), w)


def _noun(w: Column) -> Column:
    return F.array_contains(lit_array(CODE_NOUNS), w)


def deictic_refs(words: Column) -> Column:
    """A determiner followed by a code noun one or two words on; the two- and three-word windows both count."""
    n = F.size(words)
    at = lambda i: F.element_at(words, i)
    three = F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(1), n - 2), lambda i: _det(at(i)) & (_noun(at(i + 1)) | _noun(at(i + 2)))))).otherwise(0)
    two = F.when(n >= 2, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: _det(at(i)) & _noun(at(i + 1))))).otherwise(0)
    return three + two


def deictic_across(tail: Column, head: Column) -> Column:
    """What ``deictic_refs`` counts of windows that begin in the last words of one text and end in the first of the next.

    ``tail`` and ``head`` hold up to two words each.
    """
    both, t = F.concat(tail, head), F.size(tail)
    at = lambda i: F.get(both, i)
    three = F.size(F.filter(F.sequence(F.lit(0), F.lit(1)), lambda p: (p < t) & (p + 2 < F.size(both)) & _det(at(p)) & (_noun(at(p + 1)) | _noun(at(p + 2)))))
    two = F.when((t > 0) & (F.size(head) > 0) & _det(at(t - 1)) & _noun(at(t)), 1).otherwise(0)
    return three + two
