"""Fixed line patterns of the index."""

from __future__ import annotations

_W = r"[\p{L}\p{M}\p{N}_]"
_W_DOT = r"[\p{L}\p{M}\p{N}_.]"
_W_COLON = r"[\p{L}\p{M}\p{N}_:]"
_W_DOLLAR = r"[\p{L}\p{M}\p{N}_$]"

_PUB = r"^\s*(pub(?:\([^)]*\))?\s+)?"
_EXP = r"^\s*(export\s+)?"
_JPUB = r"^\s*(public\s+)?"

# Fixed values: (kind, pattern). Group 1 is the export marker and group 2 the
# name where the language marks exports; otherwise group 1 is the name.
RUST = [
    ("function", _PUB + r"(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("struct", _PUB + r"struct\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("enum", _PUB + r"enum\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("trait", _PUB + r"trait\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("type", _PUB + r"type\s+([A-Za-z_][A-Za-z0-9_]*)"),
    ("constant", _PUB + r"(?:const|static)\s+([A-Z_][A-Z0-9_]*)"),
    ("module", _PUB + r"mod\s+([a-z_][a-z0-9_]*)"),
]
SCRIPT = [
    ("function", _EXP + rf"(?:default\s+)?(?:async\s+)?function\s+([A-Za-z_$]{_W_DOLLAR}*)"),
    ("function", _EXP + rf"const\s+([A-Za-z_$]{_W_DOLLAR}*)\s*(?::[^=]+)?=\s*(?:async\s*)?\("),
    ("class", _EXP + rf"(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$]{_W_DOLLAR}*)"),
    ("interface", _EXP + rf"interface\s+([A-Za-z_$]{_W_DOLLAR}*)"),
    ("type", _EXP + rf"type\s+([A-Za-z_$]{_W_DOLLAR}*)"),
    ("enum", _EXP + rf"enum\s+([A-Za-z_$]{_W_DOLLAR}*)"),
    ("constant", _EXP + r"const\s+([A-Z][A-Z0-9_]*)\s*[:=]"),
]
PYTHON = [
    ("function", rf"^(?:async\s+)?def\s+([A-Za-z_]{_W}*)"),
    ("class", rf"^class\s+([A-Za-z_]{_W}*)"),
    ("constant", r"^([A-Z][A-Z0-9_]*)\s*[:=]"),
]
GO = [
    ("function", rf"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]{_W}*)"),
    ("struct", rf"^type\s+([A-Za-z_]{_W}*)\s+struct"),
    ("interface", rf"^type\s+([A-Za-z_]{_W}*)\s+interface"),
]
JVM = [
    ("class", _JPUB + r"(?:final\s+|abstract\s+|static\s+){0,8}" + rf"class\s+([A-Za-z_]{_W}*)"),
    ("interface", _JPUB + rf"interface\s+([A-Za-z_]{_W}*)"),
    ("enum", _JPUB + rf"enum\s+([A-Za-z_]{_W}*)"),
]

# languages, patterns, name group, exported-when ('marker', 'capital', 'no_underscore')
EXTRACTORS = [
    (["rust"], RUST, 2, "marker"),
    (["typescript", "javascript"], SCRIPT, 2, "marker"),
    (["python"], PYTHON, 1, "no_underscore"),
    (["go"], GO, 1, "capital"),
    (["java", "kotlin", "csharp"], JVM, 2, "marker"),
]
EXTRACTED_LANGUAGES = [lang for langs, *_ in EXTRACTORS for lang in langs]

IMPORTS = [
    r"^\s*import\s+(?:\S.*\sfrom\s+)?['\"]([^'\"]+)['\"]",
    r"^\s*(?:const|let|var)\s+\S.*=\s*require\(['\"]([^'\"]+)['\"]\)",
    rf"^\s*from\s+({_W_DOT}+)\s+import\s",
    rf"^\s*import\s+({_W_DOT}+)",
    rf"^\s*use\s+([A-Za-z_]{_W_COLON}*)",
]

ROUTES = [
    r"(?i)\.(get|post|put|patch|delete|head|options)\s*\(\s*['\"`]([^'\"`]+)['\"`]",
    rf"(?i)@{_W}+\.(get|post|put|patch|delete|route)\s*\(\s*['\"]([^'\"]+)['\"]",
    r"\.route\s*\(\s*\"([^\"]+)\"\s*,\s*(get|post|put|patch|delete)",
]

TODO = r"(?:^|\s)(?://+|#+|/\*+|\*|<!--|--|;+)\s*(TODO|FIXME|HACK|XXX|BUG)\b[:\s-]*(.*)"

ENV_ACCESS = [
    r"process\.env\.([A-Z_][A-Z0-9_]*)",
    r"process\.env\[['\"]([A-Z_][A-Z0-9_]*)['\"]\]",
    r"os\.environ(?:\.get)?[\[(]\s*['\"]([A-Z_][A-Z0-9_]*)['\"]",
    r"std::env::var\(\s*\"([A-Z_][A-Z0-9_]*)\"",
    r"getenv\(\s*\"([A-Z_][A-Z0-9_]*)\"",
]

ENTRY_POINTS = [
    "src/main.rs", "src/lib.rs", "main.py", "src/index.ts", "src/index.tsx", "src/main.ts",
    "src/main.tsx", "src/App.tsx", "index.js", "app.py", "manage.py", "cmd/main.go", "main.go",
]

SECTIONS = [
    ("overview", "Overview"), ("structure", "Structure"), ("key_modules", "Key Modules"),
    ("api_contracts", "API Routes"), ("dependencies", "Dependencies"), ("workflows", "How to Run"),
    ("configuration", "Configuration"), ("known_issues", "Open TODOs"),
    ("notes_and_decisions", "Decisions"),
]
STRUCTURAL_SECTIONS = ["overview", "structure"]
