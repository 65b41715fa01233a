"""Registered queries: sources, predicates, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens import policy as P
from corpuslens.functions import paths, text
from corpuslens.operators import inventory as I
from corpuslens.plans.registry import any_contains, any_suffix, in_list, query, sql
from corpuslens.policy import Policy

# --- check SQL building blocks -------------------------------------------------

SENSITIVE = (
    r"(regexp_matches(path, '^(.*/)?(\.env|\.env\..*|\.npmrc|\.pypirc|\.netrc|_netrc|\.git-credentials|\.aws/credentials"
    r"|\.aws/config|\.ssh/.*|\.gnupg/.*|id_rsa|id_dsa|id_ecdsa|id_ed25519|.*\.pem|.*\.key|.*\.p12|.*\.pfx|.*\.keystore|.*\.jks"
    r"|secrets\.json|secrets\.yaml|secrets\.yml|credentials\.json|service-account.*\.json|\.terraform/.*|.*\.tfstate"
    r"|.*\.tfstate\.backup|\.kube/config|\.docker/config\.json)$')"
    r" AND NOT regexp_matches(path, '^(.*/)?(\.env\.example|\.env\..*\.example)$'))"
)
FNAME = "string_split(path,'/')[-1]"
EXT = r"lower(regexp_extract(string_split(path,'/')[-1], '^.+\.([^.]*)$', 1))"
GENERATED = f"({any_contains(chr(39)+'/'+chr(39)+'||path', P.GENERATED_DIR_MARKERS)} OR {any_suffix(chr(39)+'/'+chr(39)+'||path', P.GENERATED_SUFFIXES)})"
TESTP = (
    f"({any_contains(chr(39)+'/'+chr(39)+'||path', P.TEST_DIR_MARKERS)} OR {any_contains(FNAME, P.TEST_NAME_MARKERS)}"
    f" OR starts_with({FNAME},'test_') OR starts_with({FNAME},'Test'))"
)
DOCSP = any_contains("'/'||path", P.DOCS_DIR_MARKERS)
HIDDEN = f"(len(list_filter(string_split(path,'/'), lambda s: starts_with(s,'.') AND s NOT IN ('.','..'))) > 0 OR {FNAME} IN ('Thumbs.db','desktop.ini'))"
SKIPPED = f"list_has_any(string_split(path,'/')[:-2], [{in_list(P.SKIPPED_DIRS)}])"


_LIMIT = f"CASE WHEN {EXT} IN ({in_list(P.DATA_EXTENSIONS)}) THEN 65536 ELSE 1048576 END"


# A blob cast to text writes every byte that is not plain ASCII (and the backslash) as \xNN.
PROBE_CTE = {
    "probed": r"""SELECT doc_id, strlen(content) AS n,
 len(regexp_extract_all(esc, '\\x(0[0-8EF]|1[0-9A-F]|7F)')) AS ctl, len(regexp_extract_all(esc, '\\x00')) AS nul,
 starts_with(esc, '\xEF\xBB\xBF') AS bom8, starts_with(esc, '\xFF\xFE') OR starts_with(esc, '\xFE\xFF') AS bom16
 FROM (SELECT doc_id, content, encode(content)::VARCHAR AS esc FROM corpus_files)""",
}
IS_BINARY = "(CASE WHEN n = 0 THEN FALSE WHEN bom8 THEN FALSE WHEN bom16 THEN TRUE WHEN nul > 0 THEN TRUE ELSE (ctl * 100) // n > 10 END)"


def classified() -> dict[str, str]:
    """CTE ``inv``: the inventory as the check engine sees it (doc_id, repo, path, content, size_bytes, class, selectable, content_hash)."""
    return {
        **PROBE_CTE,
        "inv0": f"""SELECT f.doc_id, f.repo, f.path, f.lang, f.n_chars, f.content, strlen(f.content) AS size_bytes,
 CASE WHEN {SENSITIVE} THEN 'credential_sensitive'
  WHEN {EXT} IN ({in_list(P.BINARY_EXTENSIONS)}) THEN 'binary'
  WHEN {IS_BINARY} THEN 'binary'
  WHEN {FNAME} IN ({in_list(P.LOCKFILE_NAMES)}) THEN 'lockfile'
  WHEN {GENERATED} THEN 'generated'
  WHEN {HIDDEN} THEN 'hidden_metadata' ELSE 'source_text' END AS class
 FROM corpus_files f JOIN probed USING (doc_id) WHERE NOT {SKIPPED}""",
        "inv": "SELECT *, class = 'source_text' AS selectable, sha256(content) AS content_hash FROM inv0",
    }


def inv(t, policy: Policy = I.DEFAULT):
    return I.inventory(t.files, policy)


def _cf(body: str, ctes: dict[str, str] | None = None) -> str:
    return sql("corpus_files", ctes or {}, body)


def _inv_sql(body: str, extra: dict[str, str] | None = None) -> str:
    return sql("corpus_files", {**classified(), **(extra or {})}, body)


# --- A: sources ---------------------------------------------------------------

@query("scan_table", _cf("SELECT repo, path, strlen(content) AS size_bytes, sha256(content) AS content_hash FROM corpus_files"))
def scan_table(t):
    return t.files.select("repo", "path", text.byte_len(F.col("content")).alias("size_bytes"), F.sha2("content", 256).alias("content_hash"))


@query("scan_pages", r"""SELECT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS repo, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '[?#].*$', '')||'#'||page_id AS path,
 strlen(html) AS size_bytes, sha256(html) AS content_hash FROM pages""")
def scan_pages(t):
    p = t.driver("pages")
    return p.select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1).alias("repo"),
        F.concat(F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1), "[?#].*$", ""),
                 F.lit("#"), F.col("page_id").cast("string")).alias("path"),
        text.byte_len(F.col("html")).alias("size_bytes"), F.sha2("html", 256).alias("content_hash"))


@query("prune_skipped_dirs", _cf(f"SELECT repo, path FROM corpus_files WHERE NOT {SKIPPED}"))
def prune(t):
    return I.prune_skipped_dirs(t.files).select("repo", "path")


_PAGE_PATH = "CASE WHEN contains(url, '?') THEN replace(url, '?', '/../') ELSE regexp_extract(url, '^[a-z]+:/(.*)$', 1) END"


@query("scan_issues", f"""SELECT 'pages' AS repo, {_PAGE_PATH}||'#'||page_id AS path, 'left out: the path leaves the root' AS message FROM pages WHERE contains(url, '?') OR starts_with({_PAGE_PATH}, '/')""")
def scan_issues(t):
    p = F.when(F.col("url").contains("?"), F.replace("url", F.lit("?"), F.lit("/../"))).otherwise(
        F.regexp_extract("url", "^[a-z]+:/(.*)$", 1))
    pages = t.driver("pages").select(F.lit("pages").alias("repo"), F.concat(p, F.lit("#"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("content"))
    return I.scan_issues(pages)


@query("scan_stats", _cf("""SELECT a.repo, files_seen, directories_seen, bytes_seen FROM
 (SELECT repo, count(*) AS files_seen, CAST(sum(strlen(content)) AS BIGINT) AS bytes_seen FROM corpus_files GROUP BY repo) a JOIN
 (SELECT repo, count(DISTINCT d) AS directories_seen FROM (SELECT repo, unnest(list_transform(range(1, len(string_split(path,'/'))), lambda i: array_to_string(string_split(path,'/')[1:i], '/'))) AS d FROM corpus_files) GROUP BY repo) b USING (repo)"""))
def scan_stats(t):
    return I.scan_stats(t.files)


@query("content_hash", _inv_sql("SELECT repo, path, content_hash FROM inv"))
def content_hash(t):
    return inv(t).select("repo", "path", "content_hash")


# --- B: predicates ------------------------------------------------------------

def _pred(name: str, where_sql: str, cond):
    @query(name, _cf(f"SELECT repo, path FROM corpus_files WHERE {where_sql}"))
    def run(t, cond=cond):
        return t.files.where(cond(F.col("path"))).select("repo", "path")


@query("normalize_path", r"""SELECT page_id, array_to_string(list_filter(string_split(replace(regexp_extract(url, '^[a-z]+:(.*)$', 1), chr(92), '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS path FROM pages""")
def normalize_path(t):
    return t.driver("pages").select("page_id", paths.normalize_path(F.regexp_extract("url", "^[a-z]+:(.*)$", 1)).alias("path"))


@query("path_containment", r"""SELECT page_id, starts_with(p, '/') OR regexp_matches(p, '^[A-Za-z]:') OR list_contains(string_split(p, '/'), '..') AS escapes FROM (
 SELECT page_id, CASE WHEN contains(url, '?') THEN replace(url, '?', '/../') ELSE regexp_extract(url, '^[a-z]+:/(.*)$', 1) END AS p FROM pages)""")
def path_containment(t):
    p = F.when(F.col("url").contains("?"), F.replace("url", F.lit("?"), F.lit("/../"))).otherwise(
        F.regexp_extract("url", "^[a-z]+:/(.*)$", 1))
    return t.driver("pages").select("page_id", paths.escapes_root(p).alias("escapes"))


_pred("sensitive_path", SENSITIVE, paths.is_sensitive)
_pred("lockfile", f"{FNAME} IN ({in_list(P.LOCKFILE_NAMES)})", paths.is_lockfile)
_pred("generated_path", GENERATED, paths.is_generated)
_pred("test_path", TESTP, paths.is_test)
_pred("docs_path", DOCSP, paths.is_docs)
_pred("binary_extension", f"{EXT} IN ({in_list(P.BINARY_EXTENSIONS)})", paths.has_binary_extension)
_pred("hidden_path", HIDDEN, paths.is_hidden)


@query("size_ceiling", _cf(f"""SELECT repo, path, CAST({_LIMIT} AS BIGINT) AS large_from,
 CASE WHEN strlen(content) <= {_LIMIT} THEN 'normal' WHEN {EXT} IN ({in_list(P.DATA_EXTENSIONS)}) THEN 'large_data' ELSE 'large' END AS size_class FROM corpus_files"""))
def size_ceiling(t):
    p = F.col("path")
    size = text.byte_len(F.col("content"))
    return t.files.select("repo", "path", paths.large_from(p, I.DEFAULT).alias("large_from"), paths.size_class(p, size, I.DEFAULT).alias("size_class"))


@query("binary_probe", sql("corpus_files", PROBE_CTE, f"SELECT repo, path, {IS_BINARY} AS is_binary FROM corpus_files JOIN probed USING (doc_id)"))
def binary_probe(t):
    return t.files.select("repo", "path", text.looks_binary(F.col("content").cast("binary")).alias("is_binary"))


# Damage by row: a lone lead byte at the end, a lone trail byte in front, an overlong form, or none.
_DAMAGE = {0: ("", "C3"), 1: ("80", ""), 2: ("", "C0AF"), 3: ("", "C3A9")}


@query("utf8_validity", _cf("SELECT repo, path, doc_id % 5 NOT IN (0, 1, 2) AS is_valid FROM corpus_files"))
def utf8_validity(t):
    raw = F.col("content").cast("binary")
    for k, (front, end) in _DAMAGE.items():
        damaged = F.concat(F.unhex(F.lit(front)), F.col("content").cast("binary"), F.unhex(F.lit(end)))
        raw = F.when(F.col("doc_id") % 5 == k, damaged).otherwise(raw)
    return t.files.select("repo", "path", F.is_valid_utf8(raw.cast("string")).alias("is_valid"))


@query("classify_files", _inv_sql("SELECT repo, path, size_bytes, class, selectable FROM inv"))
def classify_files(t):
    return inv(t).select("repo", "path", "size_bytes", "class", "selectable")


@query("selectable_files", _inv_sql("SELECT repo, path, class IN ('source_text','lockfile','hidden_metadata') AS selectable FROM inv"))
def selectable_files(t):
    p = Policy(include_hidden=True, exclude_lockfiles=False)
    return inv(t, p).select("repo", "path", "selectable")


_REASON = "CASE " + " ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in P.EXCLUSION_REASONS.items()) + " END"


@query("exclusion_reasons", _inv_sql(f"""SELECT repo, path, 'policy' AS source, {_REASON} AS reason,
 CASE kind WHEN 'credential_sensitive' THEN path WHEN 'binary_extension' THEN '*.'||string_split(path,'.')[-1] END AS rule
 FROM (SELECT *, CASE WHEN class <> 'binary' THEN class WHEN {EXT} IN ({in_list(P.BINARY_EXTENSIONS)}) THEN 'binary_extension' ELSE 'binary_content' END AS kind FROM inv)
 WHERE class <> 'source_text'"""))
def exclusion_reasons(t):
    return inv(t).where("exclusion IS NOT NULL").select("repo", "path", "exclusion.source", "exclusion.reason", "exclusion.rule")


@query("override_required", _inv_sql(f"SELECT repo, path, class FROM inv WHERE class IN ({in_list(P.OVERRIDE_CLASSES)})"))
def override_required(t):
    return inv(t).where(I.override_required(F.col("class"))).select("repo", "path", "class")


_LANG_CASE = "CASE regexp_extract(path, '\\.([^.]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.LANGUAGES.items()) + " ELSE 'unknown' END"


@query("language_mix", _inv_sql(f"""SELECT repo, language, files, rank FROM (SELECT repo, language, files, row_number() OVER (PARTITION BY repo ORDER BY files DESC, language) AS rank FROM (
 SELECT repo, {_LANG_CASE} AS language, count(*) AS files FROM inv WHERE selectable GROUP BY 1, 2) WHERE language <> 'unknown')"""))
def language_mix(t):
    return I.language_mix(inv(t)).select("repo", "language", "files", "rank")


# (rule number, regular expression on the whole path); the strength orders them: source, depth of the base, line.
_RULES = [
    ("*.md", 20001, r"(^|/)[^/]*\.md$"), ("!note_*5.md", 20002, r"(^|/)note_[^/]*5\.md$"), ("!.env.*", 30004, r"(^|/)\.env\.[^/]*$"), ("*.nomatch", 30005, r"\.nomatch$"),
    ("/config/*.json", 30006, r"^config/[^/]*\.json$"), ("*.sql", 20101, r"^src/(.*/)?[^/]*\.sql$"), ("!schema_[!0-4]*.sql", 20201, r"^src/util/(.*/)?schema_[^0-4/][^/]*\.sql$"),
    ("mod_*.[rp][sy]", 30101, r"^deploy/(.*/)?mod_[^/]*\.[rp][sy]$"),
]
_IGNORED = {
    "rl": "SELECT unnest([" + ", ".join(f"{{'rule': '{r}', 'rank': {k}, 're': '{e}'}}" for r, k, e in _RULES) + "], recursive := true)",
    "hits": "SELECT f.repo, f.path, rule, rank FROM corpus_files f JOIN rl ON regexp_matches(f.path, rl.re)",
    "last": "SELECT repo, path, max_by(rule, rank) AS rule, max(rank) // 10000 AS source_rank FROM hits GROUP BY repo, path",
    "judged": """SELECT f.repo, f.path, CASE WHEN d THEN 'examples/' ELSE rule END AS rule, CASE WHEN d THEN 3 ELSE source_rank END AS source_rank, d OR coalesce(NOT starts_with(rule, '!'), FALSE) AS ignored
 FROM (SELECT repo, path, regexp_matches(path, '(^|/)examples/') AS d FROM corpus_files) f LEFT JOIN last USING (repo, path)""",
}


@query("ignore_rules", sql("corpus_files", _IGNORED, "SELECT repo, path, rule, ignored FROM judged"))
def ignore_rules(t):
    return I.apply_ignore_rules(t.files.select("repo", "path"), t.view("ignore_rules")).select("repo", "path", "rule", "ignored")


@query("ignore_preview", sql("corpus_files ignore_rules", {**classified(), **_IGNORED,
    "eff": "SELECT i.repo, i.path, j.rule, j.ignored FROM inv i JOIN judged j ON j.repo = i.repo AND j.path = i.path WHERE selectable",
    "unm": "SELECT repo, string_agg(pattern, ',' ORDER BY pattern) AS unmatched_rules FROM (SELECT DISTINCT repo, pattern FROM ignore_rules) r WHERE NOT starts_with(pattern,'!') AND pattern <> '[abc' AND NOT EXISTS (SELECT 1 FROM eff u WHERE u.ignored AND u.repo = r.repo AND u.rule = r.pattern) GROUP BY repo"},
    """SELECT repo, selectable_before, newly_excluded, selectable_before - newly_excluded AS selectable_after, coalesce(unmatched_rules,'') AS unmatched_rules, '[abc' AS invalid_rules
 FROM (SELECT repo, count(*) AS selectable_before, count(*) FILTER (WHERE ignored) AS newly_excluded FROM eff GROUP BY repo) LEFT JOIN unm USING (repo)"""))
def ignore_preview(t):
    return I.ignore_preview(inv(t).select("repo", "path", "selectable"), t.view("ignore_rules"))


@query("ignored_paths", sql("corpus_files", {**classified(), **_IGNORED}, "SELECT i.repo, i.path, j.rule FROM inv i JOIN judged j ON j.repo = i.repo AND j.path = i.path WHERE selectable AND ignored"))
def ignored_paths(t):
    return I.ignored_paths(inv(t).select("repo", "path", "selectable"), t.view("ignore_rules"))


@query("inventory_with_ignores", sql("corpus_files", {**classified(), **_IGNORED}, f"""SELECT i.repo, i.path, selectable AND NOT ignored AS selectable,
 CASE WHEN class <> 'source_text' THEN 'policy' WHEN ignored THEN [{in_list(P.IGNORE_SOURCES)}][1 + source_rank] END AS source, CASE WHEN class = 'source_text' AND ignored THEN j.rule END AS rule
 FROM inv i JOIN judged j ON j.repo = i.repo AND j.path = i.path"""))
def inventory_with_ignores(t):
    got = I.inventory(t.files, rules=t.view("ignore_rules"))
    ruled = F.when(F.col("class") == "source_text", F.col("exclusion.rule"))
    return got.select("repo", "path", "selectable", F.col("exclusion.source").alias("source"), ruled.alias("rule"))


def _has_dir(col: str, names) -> str:
    return f"list_has_any(string_split(lower(path),'/')[:-2], [{in_list(names)}])"


_LNAME = "string_split(lower(path),'/')[-1]"


@query("consequential_path", _cf(f"""SELECT * FROM (SELECT repo, path, CASE WHEN {FNAME} IN ({in_list(P.LOCKFILE_NAMES)}) THEN 'dependency lockfile'
 WHEN {_LNAME} IN ({in_list(P.MANIFEST_NAMES)}) OR (starts_with({_LNAME},'requirements') AND ends_with({_LNAME},'.txt')) OR ends_with({_LNAME},'.csproj')
  OR starts_with({_LNAME},'dockerfile') OR starts_with({_LNAME},'docker-compose') OR starts_with({_LNAME},'vite.config.') OR starts_with({_LNAME},'webpack.config.') OR {_has_dir('path', ['.cargo'])} THEN 'build or dependency configuration'
 WHEN {_LNAME} IN ({in_list(P.CI_NAMES)}) OR {_has_dir('path', P.CI_DIRS)} THEN 'CI configuration'
 WHEN {_has_dir('path', P.INFRA_DIRS)} OR ends_with({_LNAME},'.tf') OR ends_with({_LNAME},'.tfvars') THEN 'deployment configuration'
 WHEN {_has_dir('path', ['migrations','migration'])} THEN 'database migration'
 WHEN {_LNAME} IN ({in_list(P.PERMISSION_NAMES)}) OR {_has_dir('path', ['capabilities'])} THEN 'ignore rules or app permissions' END AS kind FROM corpus_files) WHERE kind IS NOT NULL"""))
def consequential(t):
    return t.files.select("repo", "path", paths.consequential_kind(F.col("path")).alias("kind")).where("kind IS NOT NULL")


@query("path_search", _cf("SELECT repo, path FROM corpus_files WHERE lower(path) LIKE '%mod%'"))
def path_search(t):
    return I.path_search(t.files, " MOD ")


SPECIAL_SQL = """SELECT repo, path, 'configuration' AS kind FROM inv WHERE ends_with(lower(path),'.env.example')
 UNION ALL SELECT repo, path, 'automation' FROM inv WHERE starts_with(path,'.github/workflows/')
 UNION ALL SELECT repo, path, 'decision' FROM inv WHERE selectable AND (contains(lower(path),'/adr/') OR contains(lower(path),'decision') OR contains(lower(path),'/rfc')) AND NOT contains(lower(path),'template')"""


@query("schema_and_config_files", _inv_sql(SPECIAL_SQL))
def special_files(t):
    return I.special_files(inv(t))


@query("injection_scan", _cf(f"SELECT repo, path, p.phrase FROM corpus_files CROSS JOIN (SELECT unnest([{in_list(P.INJECTION_PHRASES)}]) AS phrase) p WHERE contains(lower(content), p.phrase)"))
def injection_scan(t):
    return I.injection_scan(t.files)


CLASS_SQL = "SELECT repo, CASE class WHEN 'source_text' THEN 'text' WHEN 'credential_sensitive' THEN 'credential-sensitive' WHEN 'hidden_metadata' THEN 'hidden/metadata' ELSE class END AS label, count(*) AS files FROM inv GROUP BY 1, 2"


@query("class_counts", _inv_sql(CLASS_SQL))
def class_counts(t):
    return I.class_counts(inv(t))


@query("selectable_bytes", _inv_sql("SELECT repo, count(*) AS selectable_files, CAST(sum(size_bytes) AS BIGINT) AS selectable_bytes FROM inv WHERE selectable GROUP BY repo"))
def selectable_bytes(t):
    return I.selectable_bytes(inv(t))


_LANE = "CAST(sum(CAST('0x'||substr(h, {a}, 15) AS BIGINT)) AS VARCHAR)"
LANES = " ||':'|| ".join(_LANE.format(a=1 + 15 * i) for i in range(4))


REVISION_SQL = (
    f"SELECT repo, 'scan:'||left(sha256(count(*)||':'||{LANES}), 40) AS source_revision FROM "
    "(SELECT repo, sha256(path||chr(0)||size_bytes||chr(0)||coalesce(content_hash,'')) AS h FROM inv) GROUP BY repo")


@query("source_revision", _inv_sql(REVISION_SQL))
def source_revision(t):
    return I.source_revision(inv(t))


@query("project_fingerprint", "SELECT DISTINCT source AS repo, 'proj_'||left(sha256('path:'||source), 24) AS project_fingerprint FROM documents")
def project_fingerprint(t):
    return t.driver("documents").select(F.col("source").alias("repo")).distinct().withColumn("project_fingerprint", I.project_fingerprint(F.col("repo")))
