"""Secret rules: fixed patterns, strongest first; the first that matches a line names the finding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import text

# Fixed values: (rule, confidence, pattern). Every pattern is linear: runs in front of a fixed part start only where
# the run starts, and runs that nothing follows are not given back.
RULES = [
    ("aws_access_key", "high", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", "high", r"\bgh[pousr]_[A-Za-z0-9]{36,}"),
    ("private_key", "high", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("url_password", "high", r"(?<![a-z0-9+.-])([0-9+.-]*+)[a-z][a-z0-9+.-]*+://[^/\s:@]++:[^/\s:@]++@"),
    ("stripe_live_key", "high", r"\b[rs]k_live_[A-Za-z0-9]{16,}"),
    ("generic_secret", "medium", r"(?i)(?:api[_-]?key|secret|token)[\"']?\s*+[:=]\s*+[\"'][^\"'\s]{20,}+[\"']"),
    ("password_assignment", "low", r"(?i)\bpassw(?:or)?d[\"']?\s*+[:=]\s*+[\"'][^\"'\s]{4,}+[\"']"),
]

# Literals of which every match of the rule holds one, found without a pattern; in lower case for the
# rules that ignore case.
ANCHORS = {
    "aws_access_key": ["AKIA"],
    "github_token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "private_key": ["PRIVATE KEY-----"],
    "url_password": ["://"],
    "stripe_live_key": ["k_live_"],
    "generic_secret": ["key", "secret", "token"],
    "password_assignment": ["passw"],
}
_ANY_CASE = {"generic_secret", "password_assignment"}


def anchored(content: Column, rule: str) -> Column:
    """Whether a literal of the rule stands in the text at all."""
    where = F.lower(content) if rule in _ANY_CASE else content
    out = F.lit(False)
    for literal in ANCHORS[rule]:
        out = out | F.contains(where, F.lit(literal))
    return out


def matches(content: Column, rule: str, pattern: str) -> Column:
    """The rule's pattern, tried only where one of its literals stands."""
    return anchored(content, rule) & content.rlike(pattern)


def may_hold_secret(content: Column) -> Column:
    """One look at a whole text before it is cut into lines: literals first, patterns only where they occur."""
    out = F.lit(False)
    for rule, _, pattern in RULES:
        out = out | matches(content, rule, pattern)
    return out


def rule_of(line: Column) -> Column:
    """The first rule that matches the line, null without one."""
    out = None
    for rule, _, pattern in RULES:
        hit = matches(line, rule, pattern)
        out = F.when(hit, rule) if out is None else out.when(hit, rule)
    return out


def confidence_of(rule: Column) -> Column:
    high = [r for r, c, _ in RULES if c == "high"]
    medium = [r for r, c, _ in RULES if c == "medium"]
    return F.when(rule.isin(high), "high").when(rule.isin(medium), "medium").when(rule.isNotNull(), "low")


def redact(line: Column) -> Column:
    """The line with the match of every rule blanked, so no secret of another rule slips through."""
    for rule, _, pattern in RULES:
        kept = "$1[redacted]" if rule == "url_password" else "[redacted]"
        line = F.regexp_replace(line, pattern, kept)
    return line


def excerpt(line: Column) -> Column:
    return text.strip(redact(line))
