"""Registered queries: change impact, budgeted reads, diffs and review of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import patterns as P
from corpuslens.operators import impact as G
from corpuslens.operators import inventory as I
from corpuslens.operators import review as J
from corpuslens.plans.bundles import _RULES_SQL, LINES
from corpuslens.plans.inventory import SENSITIVE, classified
from corpuslens.plans.registry import in_list, query, sql
from corpuslens.policy import EXCLUSION_REASONS

KEYS = [k for k, _ in P.SECTIONS]

# The working tree as the current inventory, and references recorded against the base snapshot.
_WT = {k: v.replace("FROM corpus_files", "FROM snap_worktree") for k, v in classified().items()}
_WT["inv0"] = _WT["inv0"].replace("f.lang, f.n_chars, ", "").replace("snap_worktree f", "snap_worktree f")
REFS = {
    "section_refs": "SELECT repo, path, doc_id, ['" + "','".join(KEYS) + "'][1 + abs(doc_id) % 9] AS key, CASE WHEN length(content) BETWEEN 1000 AND 1100 THEN NULL ELSE sha256(content) END AS content_hash FROM snap_base",
}


def _g(body: str, extra: dict[str, str] | None = None) -> str:
    return sql("snap_base snap_index snap_worktree", {**_WT, **REFS, **(extra or {})}, body)


def wt_inv(t):
    return t.table("worktree_inventory", lambda: I.inventory(t.view("snap_worktree").select("repo", "path", "doc_id", "content")))


def section_refs(t):
    keys = F.array(*[F.lit(k) for k in KEYS])
    return t.view("snap_base").select(
        "repo", "path", "doc_id", F.element_at(keys, (F.abs("doc_id") % 9 + 1).cast("int")).alias("key"),
        F.when(~F.length("content").between(1000, 1100), F.sha2("content", 256)).alias("content_hash"))


IMPACT = {"imp": """SELECT coalesce(r.repo, i.repo) AS repo, coalesce(r.path, i.path) AS path, CASE WHEN i.path IS NULL THEN 'deleted' WHEN r.path IS NULL THEN CASE WHEN i.selectable THEN 'added' END
 WHEN r.content_hash <> i.content_hash THEN 'changed' END AS change FROM section_refs r FULL JOIN inv i ON r.repo = i.repo AND r.path = i.path""",
    "fresh": """SELECT repo, key, CASE WHEN bool_or(touched) OR (key IN ('overview','structure') AND repo IN (SELECT repo FROM imp WHERE change = 'added')) THEN 'stale' WHEN bool_or(unver) THEN 'unknown' ELSE 'fresh' END AS freshness FROM (
 SELECT r.repo, r.key, i.path IS NULL OR coalesce(r.content_hash <> i.content_hash, FALSE) AS touched, r.content_hash IS NULL OR i.content_hash IS NULL AS unver FROM section_refs r LEFT JOIN inv i ON r.repo = i.repo AND r.path = i.path) GROUP BY repo, key"""}


@query("change_impact", _g("SELECT * FROM imp WHERE change IS NOT NULL", IMPACT))
def change_impact(t):
    return G.change_impact(section_refs(t), wt_inv(t))


@query("section_freshness", _g("SELECT * FROM fresh", IMPACT))
def section_freshness(t):
    return G.section_freshness(section_refs(t), wt_inv(t))


@query("document_freshness", _g("SELECT repo, CASE WHEN bool_or(freshness='stale') THEN 'stale' WHEN bool_or(freshness='unknown') THEN 'unknown' ELSE 'fresh' END AS freshness FROM fresh GROUP BY repo", IMPACT))
def document_freshness(t):
    return G.document_freshness(G.section_freshness(section_refs(t), wt_inv(t)))


_SUB = "SELECT repo, key, CASE WHEN key = 'workflows' THEN '  ' ELSE 'text' END AS body, CASE WHEN key = 'overview' THEN 'deterministic' ELSE 'model' END AS generator FROM (SELECT DISTINCT source AS repo FROM documents) CROSS JOIN (SELECT unnest(['" + "','".join([*KEYS, "extra"]) + "']) AS key)"


@query("citation_audit", _g("""SELECT repo, key, 'a deterministic section needs no model check' AS problem FROM sub WHERE generator = 'deterministic'
 UNION ALL SELECT repo, key, 'a section written by a model cites no file' FROM sub s WHERE NOT EXISTS (SELECT 1 FROM section_refs r WHERE r.repo = s.repo AND r.key = s.key)
 UNION ALL SELECT repo, key, 'section body is empty' FROM sub WHERE trim(body) = ''
 UNION ALL SELECT r.repo, r.key, 'cited file `'||r.path||'` is unknown here' FROM section_refs r LEFT JOIN inv i ON r.repo = i.repo AND r.path = i.path WHERE i.path IS NULL
 UNION ALL SELECT r.repo, r.key, 'cited file `'||r.path||'` may not be cited' FROM section_refs r JOIN inv i ON r.repo = i.repo AND r.path = i.path WHERE i.class <> 'source_text'
 UNION ALL SELECT r.repo, r.key, 'cited file `'||r.path||'` has other content now' FROM section_refs r JOIN inv i ON r.repo = i.repo AND r.path = i.path WHERE r.content_hash <> i.content_hash
 UNION ALL SELECT r.repo, r.key, 'citation for `'||r.path||'` names no content' FROM section_refs r JOIN inv i ON r.repo = i.repo AND r.path = i.path WHERE r.content_hash IS NULL""", {"sub": _SUB}))
def citation_audit(t):
    repos = t.driver("documents").select(F.col("source").alias("repo")).distinct()
    sub = repos.select("repo", F.explode(F.array(*[F.lit(k) for k in [*KEYS, "extra"]])).alias("key")).withColumn(
        "body", F.when(F.col("key") == "workflows", "  ").otherwise("text")).withColumn(
        "generator", F.when(F.col("key") == "overview", "deterministic").otherwise("model"))
    return G.citation_audit(sub, section_refs(t), wt_inv(t))


@query("citation_coverage", _g("""SELECT DISTINCT w.repo, w.path FROM snap_worktree w JOIN snap_base b ON b.repo = w.repo AND b.path = w.path WHERE w.content <> b.content
 AND NOT EXISTS (SELECT 1 FROM section_refs r WHERE r.repo = w.repo AND r.path = w.path AND r.content_hash IS NOT NULL)"""))
def citation_coverage(t):
    affected = J.changed_against(t.view("snap_base"), t.view("snap_worktree")).where("status <> 'deleted'").withColumn("is_new", F.col("status") == "added")
    return G.citation_coverage(affected, section_refs(t).where("content_hash IS NOT NULL"))


@query("context_citations", sql("snap_worktree selection_spec", {"wanted": "SELECT DISTINCT repo, path FROM selection_spec WHERE kind = 'file'"}, """SELECT w.repo, w.path, sha256(content) AS content_hash, CASE WHEN content IS NOT NULL THEN CAST(1 AS BIGINT) END AS line_start,
 greatest(length(content) - length(replace(content, chr(10), '')), 1) AS line_end0, strlen(content) // 4 AS est_tokens, CASE WHEN content IS NULL THEN w.path||': not found' END AS omitted
 FROM wanted w LEFT JOIN snap_worktree f ON f.repo = w.repo AND f.path = w.path""").replace("greatest(length(content) - length(replace(content, chr(10), '')), 1) AS line_end0", "CASE WHEN content IS NOT NULL THEN greatest(length(content) - length(replace(content, chr(10), '')), 1) END AS line_end"))
def context_citations(t):
    wanted = t.view("selection_spec").where("kind = 'file'").select("repo", "path")
    return G.context_citations(wanted, t.view("snap_worktree"))


_REQ = "SELECT f.doc_id AS request_id, f.repo, f.path{gone} AS path, {a} AS a, {b} AS b FROM corpus_files f JOIN labels l USING (doc_id)"


def _requests(t):
    lab = t.driver("labels")
    return t.scan.select("doc_id", "repo", "path", "n_chars").join(lab, "doc_id")


@query("fetch_source", sql("snap_worktree", {"rq": _REQ.format(gone="", a="1 + quality * 2", b="CASE WHEN toxic = 1 THEN NULL ELSE 6 END"),
    "x": f"SELECT request_id, r.repo, r.path, a, b, f.content, {LINES.format(x='f.content')} AS ls, c.content AS old FROM rq r LEFT JOIN snap_worktree f ON f.repo = r.repo AND f.path = r.path JOIN corpus_files c ON c.repo = r.repo AND c.path = r.path",
    "y": f"SELECT *, least(coalesce(b, len(ls)), len(ls)) AS stop, CASE WHEN {SENSITIVE} THEN 'refused: credential path' WHEN content IS NULL THEN 'not found' END AS error FROM x"},
    """SELECT request_id, repo, path, CASE WHEN error IS NOT NULL THEN NULL WHEN a > len(ls) OR a > stop THEN '' ELSE array_to_string(list_transform(ls[a:stop], lambda l: CASE WHEN ends_with(l, chr(13)) THEN left(l, length(l)-1) ELSE l END), chr(10)) END AS content,
 CASE WHEN error IS NULL THEN CAST(a AS BIGINT) END AS from_line, CASE WHEN error IS NULL THEN stop END AS to_line, CASE WHEN error IS NULL THEN len(ls) END AS total_lines, CASE WHEN error IS NULL THEN sha256(content) END AS content_hash,
 error IS NULL AND coalesce(sha256(content) <> sha256(old), FALSE) AS changed_since_scan, error FROM y"""))
def fetch_source(t):
    rq = _requests(t).select(F.col("doc_id").alias("request_id"), "repo", "path", (1 + F.col("quality") * 2).alias("from_line"),
                             F.when(F.col("toxic") != 1, F.lit(6)).alias("to_line"))
    recorded = t.scan.select("repo", "path", "class", F.sha2("content", 256).alias("content_hash"))
    return G.fetch_source(rq, t.view("snap_worktree"), recorded)


_BUD = {"ln": "SELECT repo, key, path AS pos, '- `'||path||'` '||coalesce(content_hash,'') AS line FROM section_refs",
    "items": "SELECT repo, key, list_position(['" + "','".join(KEYS) + "'], key) AS sec, 1 AS kind, pos, line, strlen(line) // 4 + 1 AS cost FROM ln UNION ALL SELECT DISTINCT repo, key, list_position(['" + "','".join(KEYS) + "'], key), 0, '', '## '||['" + "','".join(t for _, t in P.SECTIONS) + "'][list_position(['" + "','".join(KEYS) + "'], key)]||chr(10)||chr(10), 0 FROM ln",
    "it2": "SELECT repo, key, sec, kind, pos, line, CASE WHEN kind = 0 THEN strlen(line) // 4 ELSE cost END AS cost FROM items",
    "it3": "SELECT *, row_number() OVER w AS item, sum(cost) OVER w AS used FROM it2 WINDOW w AS (PARTITION BY repo ORDER BY sec, kind, pos)",
    "first": "SELECT repo, min(item) AS stop FROM it3 WHERE (kind = 0 AND used >= 300) OR (kind = 1 AND used > 300) GROUP BY repo"}


@query("budgeted_sections", _g("""SELECT i.repo, i.key, i.item, CASE WHEN i.item = f.stop THEN '… (the budget ends here)' ELSE rtrim(i.line, chr(10)) END AS line
 FROM it3 i LEFT JOIN first f USING (repo) WHERE f.stop IS NULL OR i.item < f.stop OR (i.item = f.stop AND i.kind = 1)""", _BUD))
def budgeted_sections(t):
    lines = section_refs(t).select("repo", "key", F.col("path").alias("pos"), F.concat(F.lit("- `"), "path", F.lit("` "), F.coalesce("content_hash", F.lit(""))).alias("line"))
    return G.budgeted_sections(lines, 300)


_SENSL = " OR ".join(f"regexp_matches(line, '{p}')" for _, c, p in _RULES_SQL if c != "low")
# The fixture holds no binary content behind a plain name.
_WHY = "".join(f"WHEN i.class = '{k.removesuffix('_extension')}' THEN '{v}' " for k, v in EXCLUSION_REASONS.items())
_BR = {**classified(), "rq": "SELECT f.doc_id AS request_id, f.repo, CASE WHEN toxic = 1 THEN f.path||'.gone' ELSE f.path END AS path, 1 + quality * 2 AS a, CASE WHEN n_chars > 2000 THEN 40 END AS b FROM corpus_files f JOIN labels l USING (doc_id)",
    "rf": """SELECT r.*, i.class, i.selectable, i.content, CASE WHEN i.class IS NULL THEN 'no such file in the index'
 WHEN i.selectable THEN NULL """ + _WHY + """ END AS refused FROM rq r LEFT JOIN inv i ON i.repo = r.repo AND i.path = r.path""",
    "rl": f"SELECT *, CASE WHEN refused IS NULL THEN {LINES.format(x='content')} ELSE [] END AS ls FROM rf",
    "rr": "SELECT request_id, repo, path, refused, ls, len(ls) AS n, least(a, greatest(len(ls), 1)) AS s FROM rl",
    "rs": "SELECT rr.*, least(greatest(coalesce(rq.b, n), s), greatest(n, s)) AS e FROM rr JOIN rq USING (request_id)",
    "lx": "SELECT request_id, s, ln, CASE WHEN ends_with(l, chr(13)) THEN left(l, length(l)-1) ELSE l END AS line FROM (SELECT request_id, s, unnest(ls[s:e]) AS l, unnest(range(s, e+1)) AS ln FROM rs WHERE refused IS NULL AND n > 0)",
    "ly": f"SELECT request_id, s, ln, ({_SENSL}) AS bad, CASE WHEN {_SENSL} THEN '[line redacted: possible credential]' ELSE line END AS shown FROM lx",
    "lz": "SELECT *, sum(strlen(shown)//4 + 1) OVER (PARTITION BY request_id ORDER BY ln) AS used FROM ly QUALIFY used <= 200 OR ln = s",
    "got": "SELECT request_id, max(ln) AS last, CAST(sum(strlen(shown)+1) AS BIGINT) AS body_bytes, count(*) FILTER (WHERE bad) AS redacted_lines, sha256(string_agg(shown||chr(10), '' ORDER BY ln)) AS body_hash FROM lz GROUP BY request_id"}


@query("budgeted_read", sql("corpus_files", _BR, """SELECT request_id, repo, path, CASE WHEN refused IS NULL THEN s ELSE 0 END AS from_line, CASE WHEN refused IS NULL THEN coalesce(last, s - 1) ELSE 0 END AS to_line, coalesce(body_bytes, 0) AS body_bytes,
 coalesce(redacted_lines, 0) AS redacted_lines, body_hash, refused, CASE WHEN refused IS NULL AND coalesce(last, s-1) < e THEN '(stopped at line '||last||' of '||n||'; go on from line '||(last+1)||')' ELSE '' END AS note FROM rs LEFT JOIN got USING (request_id)"""))
def budgeted_read(t):
    rq = _requests(t).select(
        F.col("doc_id").alias("request_id"), "repo", F.when(F.col("toxic") == 1, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"),
        (1 + F.col("quality") * 2).alias("start_line"), F.when(F.col("n_chars") > 2000, F.lit(40)).alias("end_line"))
    return G.budgeted_read(rq, t.inv, 600, 200)


# --- J: snapshots and review -------------------------------------------------------

@query("changed_files", sql("snap_base snap_index snap_worktree", {}, """SELECT * FROM (SELECT repo, path,
 CASE WHEN (b IS NULL) <> (i IS NULL) OR b <> i THEN 'staged' WHEN i IS NULL AND w IS NOT NULL THEN 'untracked' WHEN i IS NOT NULL AND (w IS NULL OR i <> w) THEN 'unstaged' END AS scope,
 array_to_string(list_filter([CASE WHEN (b IS NULL AND i IS NOT NULL) OR (i IS NULL AND w IS NOT NULL) THEN 'added' END, CASE WHEN b <> i OR i <> w THEN 'modified' END, CASE WHEN (b IS NOT NULL AND i IS NULL) OR (i IS NOT NULL AND w IS NULL) THEN 'deleted' END], lambda x: x IS NOT NULL), '+') AS status
 FROM (SELECT coalesce(b.repo, i.repo, w.repo) AS repo, coalesce(b.path, i.path, w.path) AS path, b.content AS b, i.content AS i, w.content AS w FROM snap_base b FULL JOIN snap_index i ON i.repo = b.repo AND i.path = b.path FULL JOIN snap_worktree w ON w.repo = coalesce(b.repo, i.repo) AND w.path = coalesce(b.path, i.path))) WHERE scope IS NOT NULL"""))
def changed_files(t):
    return J.changed_files(t.view("snap_base"), t.view("snap_index"), t.view("snap_worktree"))


@query("changed_files_against_ref", sql("snap_base snap_worktree", {}, """SELECT coalesce(b.repo, w.repo) AS repo, coalesce(b.path, w.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
 FROM snap_base b FULL JOIN snap_worktree w ON w.repo = b.repo AND w.path = b.path WHERE b.content IS DISTINCT FROM w.content"""))
def changed_against(t):
    return J.changed_against(t.view("snap_base"), t.view("snap_worktree"))


# The edits of the snapshots are known, so SQL can write each diff down directly.
_CL = "list_transform({ls}, lambda l: CASE WHEN ends_with(l, chr(13)) THEN left(l, length(l)-1) ELSE l END)"
_BLK = "coalesce(array_to_string(list_transform({ls}, lambda l: '{m}'||l||chr(10)), ''), '')"
PATCH = {
    "pj": f"""SELECT coalesce(b.repo, w.repo) AS repo, coalesce(b.path, w.path) AS path, coalesce(b.doc_id, w.doc_id) AS doc_id, b.content AS old, w.content AS new,
 {_CL.format(ls=LINES.format(x='b.content'))} AS ol, {_CL.format(ls=LINES.format(x='w.content'))} AS nl FROM snap_base b FULL JOIN snap_worktree w ON w.repo = b.repo AND w.path = b.path WHERE b.content IS DISTINCT FROM w.content""",
    "pd": f"""SELECT repo, repo||'#'||CAST(floor(doc_id/400) AS BIGINT) AS proposal_id, path, old IS NULL AS is_new, new IS NULL AS is_deleted, CASE
 WHEN old IS NULL THEN '--- /dev/null'||chr(10)||'+++ b/'||path||chr(10)||'@@ -0,0 +1,'||len(nl)||' @@'||chr(10)||{_BLK.format(ls='nl', m='+')}
 WHEN new IS NULL THEN '--- a/'||path||chr(10)||'+++ /dev/null'||chr(10)||'@@ -1,'||len(ol)||' +0,0 @@'||chr(10)||{_BLK.format(ls='ol', m='-')}
 WHEN starts_with(new, '// edited'||chr(10)) AND NOT starts_with(old, '// edited') THEN '--- a/'||path||chr(10)||'+++ b/'||path||chr(10)||'@@ -1,'||least(3,len(ol))||' +1,'||(least(3,len(ol))+1)||' @@'||chr(10)||'+// edited'||chr(10)||{_BLK.format(ls='ol[1:3]', m=' ')}
 WHEN ends_with(old, chr(10)) THEN '--- a/'||path||chr(10)||'+++ b/'||path||chr(10)||'@@ -'||(greatest(len(ol)-3,0)+1)||','||least(len(ol),3)||' +'||(greatest(len(ol)-3,0)+1)||','||(least(len(ol),3)+1)||' @@'||chr(10)||{_BLK.format(ls='ol[greatest(len(ol)-2,1):]', m=' ')}||'+// staged'||chr(10)
 ELSE '--- a/'||path||chr(10)||'+++ b/'||path||chr(10)||'@@ -'||(greatest(len(ol)-4,0)+1)||','||least(len(ol),4)||' +'||(greatest(len(ol)-4,0)+1)||','||least(len(ol),4)||' @@'||chr(10)||{_BLK.format(ls='CASE WHEN len(ol) = 1 THEN [] ELSE ol[greatest(len(ol)-3,1):len(ol)-1] END', m=' ')}||'-'||ol[-1]||chr(10)||'+'||nl[-1]||chr(10) END AS unified_diff FROM pj""",
    "pa": "SELECT *, len(list_filter(string_split(unified_diff, chr(10)), lambda l: starts_with(l,'+') AND NOT starts_with(l,'+++'))) AS lines_added, len(list_filter(string_split(unified_diff, chr(10)), lambda l: starts_with(l,'-') AND NOT starts_with(l,'---'))) AS lines_deleted FROM pd",
    "ph": "SELECT proposal_id, sha256(string_agg(sha256(path||chr(0)||unified_diff||CAST(is_new AS INT)||CAST(is_deleted AS INT)), '' ORDER BY path)) AS proposal_hash FROM pa GROUP BY proposal_id",
}


def _p(body: str, extra: dict[str, str] | None = None) -> str:
    return sql("snap_base snap_worktree", {**PATCH, **(extra or {})}, body)


def patches(t):
    """Proposals are batches of 400 consecutive documents per repo, so each is small by construction."""
    batch = F.floor(F.col("doc_id") / 400).alias("batch")
    side = lambda v: t.view(v).select("repo", "path", batch, "content")
    return t.table("patches", lambda: J.patches(side("snap_base"), side("snap_worktree")))


@query("unified_diff", _p("SELECT repo, path, sha256(unified_diff) AS diff_hash, is_new, is_deleted FROM pa"))
def unified_diff(t):
    return patches(t).select("repo", "path", F.sha2("unified_diff", 256).alias("diff_hash"), "is_new", "is_deleted")


@query("diff_line_counts", _p("SELECT repo, path, lines_added, lines_deleted FROM pa"))
def diff_line_counts(t):
    return patches(t).select("repo", "path", "lines_added", "lines_deleted")


@query("proposal_hash", _p("SELECT * FROM ph"))
def proposal_hash(t):
    return J.proposal_hash(patches(t))


_FIND = "array_to_string(list_transform(string_split(replace(content, chr(13), ''), chr(10))[1:2], lambda l: l), chr(10))"


@query("edit_uniqueness", sql("snap_worktree", {"e": f"SELECT repo, path, doc_id AS edit_id, content, {_FIND} AS find FROM snap_worktree",
    "m": "SELECT *, (strlen(content) - strlen(replace(content, find, ''))) // strlen(find) AS p, (strlen(content) - strlen(replace(content, replace(find, chr(10), chr(13)||chr(10)), ''))) // strlen(replace(find, chr(10), chr(13)||chr(10))) AS c FROM e WHERE find <> ''",
    "z": "SELECT edit_id, repo, path, CASE WHEN p = 0 AND contains(content, chr(13)||chr(10)) AND c = 1 THEN 1 ELSE p END AS matches FROM m"}, "SELECT edit_id, repo, path, matches, matches = 1 AS applies FROM z"))
def edit_uniqueness(t):
    w = t.view("snap_worktree")
    find = F.array_join(F.slice(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n", -1), 1, 2), "\n")
    edits = w.select("repo", "path", F.col("doc_id").alias("edit_id"), find.alias("find")).where("find <> ''")
    return J.edit_uniqueness(edits, w)


_HI = " OR ".join(f"regexp_matches(l, '{p}')" for _, c, p in _RULES_SQL if c == "high")
_VAL = {"chk": f"""SELECT proposal_id, bool_and(NOT (starts_with(path,'/') OR list_contains(string_split(path,'/'),'..'))) AS inside,
 bool_and(is_new OR EXISTS (SELECT 1 FROM snap_base b WHERE b.repo = pa.repo AND b.path = pa.path AND NOT (length(b.content) BETWEEN 1000 AND 1100))) AS covered,
 bool_and(len(list_filter(string_split(unified_diff, chr(10)), lambda l: {_HI})) = 0) AS clean, bool_and(unified_diff <> '') AS formed FROM pa GROUP BY proposal_id"""}


@query("proposal_validation", _p("""SELECT proposal_id, inside AND clean AND formed AS is_valid, n AS check_name, CASE n WHEN 'project_boundary_containment' THEN inside WHEN 'context_citation_coverage' THEN covered WHEN 'secret_leak_prevention' THEN clean ELSE formed END AS passed
 FROM chk CROSS JOIN (SELECT unnest(['project_boundary_containment','context_citation_coverage','secret_leak_prevention','patch_syntax_well_formed']) AS n)""", _VAL))
def proposal_validation(t):
    return J.proposal_validation(patches(t), section_refs(t).where("content_hash IS NOT NULL"))


@query("reply_action_audit", sql("replies", {
    "s": r"SELECT conv_id, turn, regexp_replace(regexp_replace(reply, '(?s)<think>.*?(</think>|$)', '', 'g'), '^\s+|\s+$', '', 'g') AS r FROM replies",
    "j": "SELECT conv_id, turn, CASE WHEN json_valid(r) AND starts_with(r, '{') THEN r::JSON END AS j FROM s"},
    """SELECT conv_id, turn, j->>'$.action' AS action, CASE WHEN j IS NULL THEN 'no action in the reply'
 WHEN j->>'$.action' = 'read_files' AND json_array_length(j, '$.files') = 0 THEN 'read_files names no file' WHEN j->>'$.action' = 'search' AND length(j->>'$.query') < 2 THEN 'the search is too short'
 WHEN j->>'$.action' = 'edit' AND json_extract_string(j, '$.edits[0].find') IS NULL THEN 'an edit lacks its find or replace text' END AS error FROM j"""))
def reply_action_audit(t):
    return J.reply_action_audit(t.view("replies"))


@query("strip_reasoning", sql("replies", {}, r"SELECT conv_id, turn, regexp_replace(regexp_replace(reply, '(?s)<think>.*?(</think>|$)', '', 'g'), '^\s+|\s+$', '', 'g') AS reply FROM replies"))
def strip_reasoning(t):
    return t.view("replies").select("conv_id", "turn", J.strip_reasoning(F.col("reply")).alias("reply"))


# Commands are cut from the conversations: some are test runs, some carry a chain, a pipe or prose.
_LINE = "replace(text, chr(10), ' ')"
_CMD = f"""SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'cargo test '||{_LINE} WHEN 1 THEN 'cargo test --package p'||conv_id||' '||{_LINE} WHEN 2 THEN 'cargo test; rm -rf / '||{_LINE} WHEN 3 THEN 'npm test | grep ok '||{_LINE}
 WHEN 4 THEN 'sudo cargo test '||{_LINE} WHEN 5 THEN 'pytest "tests/a b.py" -k t'||turn||' '||{_LINE} ELSE text END AS command FROM conversations"""
ALLOW = ["cargo test", "npm test", "pytest"]


def _commands(t):
    t._register(["conversations"])
    return t.spark.sql(_CMD)


_FORB = " ".join(f"WHEN contains(c, {ch}) THEN 'shell character '||{rep}" for ch, rep in [
    ("';'", "''';'''"), ("'&'", "'''&'''"), ("'|'", "'''|'''"), ("'>'", "'''>'''"), ("'<'", "'''<'''"), ("'$'", "'''$'''"), ("'`'", "'''`'''"),
    ("chr(92)", "chr(39)||chr(92)||chr(92)||chr(39)"), ("'('", "'''('''"), ("')'", "''')'''"), ("chr(10)", "chr(39)||chr(92)||'n'||chr(39)"), ("chr(13)", "chr(39)||chr(92)||'r'||chr(39)")])
_DEST = " ".join(f"WHEN contains(lower(c), '{d}') THEN 'destructive: {d}'" for d in J.DESTRUCTIVE)


@query("command_audit", sql("", {"cm": _CMD, "cs": r"SELECT *, regexp_replace(command, '^\s+|\s+$', '', 'g') AS c FROM cm"}, f"""SELECT conv_id, turn, command, CASE WHEN c = '' THEN 'command cannot be empty' {_FORB} {_DEST}
 WHEN length(regexp_replace(regexp_replace(c, '''[^'']*''|"[^"]*"', '', 'g'), '[^''"]', '', 'g')) > 0 THEN 'a quote is left open'
 WHEN NOT (regexp_matches(c, '^cargo\\s+test(\\s|$)') OR regexp_matches(c, '^npm\\s+test(\\s|$)') OR regexp_matches(c, '^pytest(\\s|$)')) THEN 'not on the list of allowed commands' END AS error FROM cs"""))
def command_audit(t):
    return J.command_audit(_commands(t), ALLOW)


_TASK = """SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 9 = 0 THEN '  ' ELSE text END AS objective, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE 1000 END AS max_tokens, 0.5 AS max_cost_usd,
 CASE WHEN turn = 2 THEN 'src/../../etc' WHEN turn = 1 THEN '/abs' ELSE 'src/a.ts' END AS p FROM conversations"""


@query("task_preflight", sql("", {"t": _TASK}, r"""SELECT conv_id, turn, CASE WHEN regexp_replace(objective, '\s+', '', 'g') = '' THEN 'the task has no objective' WHEN max_tokens = 0 THEN 'the task has no budget'
 WHEN starts_with(p, '/') OR contains(p, '..') THEN 'a context file lies outside' END AS error FROM t"""))
def task_preflight(t):
    t._register(["conversations"])
    return J.task_preflight(t.spark.sql(_TASK).withColumn("paths", F.array("p"))).select("conv_id", "turn", "error")


@query("approval_binding", _p("""SELECT h.proposal_id, NOT starts_with(h.proposal_id, 'src3#') AS hash_ok, NOT EXISTS (SELECT 1 FROM pa WHERE pa.proposal_id = h.proposal_id AND pa.is_new AND pa.repo = 'src5') AS paths_ok,
 CASE WHEN NOT starts_with(h.proposal_id, 'src3#') AND NOT EXISTS (SELECT 1 FROM pa WHERE pa.proposal_id = h.proposal_id AND pa.is_new AND pa.repo = 'src5') THEN 'ok' ELSE 'approval_mismatch' END AS status FROM ph h"""))
def approval_binding(t):
    p = patches(t)
    h = J.proposal_hash(p)
    approvals = h.select("proposal_id", F.when(F.col("proposal_id").startswith("src3#"), F.sha2("proposal_hash", 256)).otherwise(F.col("proposal_hash")).alias("patch_hash"))
    paths_ok = p.where("NOT (is_new AND repo = 'src5')").select("proposal_id", "path")
    return J.approval_binding(p, h, approvals, paths_ok)
