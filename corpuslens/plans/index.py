"""Registered queries: the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslens.functions import ordering
from corpuslens.functions import patterns as P
from corpuslens.operators import analyze as A
from corpuslens.operators import inventory as I
from corpuslens.plans.bundles import FOUND, LINES, SEL, chosen
from corpuslens.plans.inventory import CLASS_SQL, LANES, REVISION_SQL, SPECIAL_SQL, _LANG_CASE, classified
from corpuslens.plans.registry import in_list, query, sql


def q(p: str) -> str:
    return p.replace("'", "''")


STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
LN = {"lines": f"""SELECT repo, path, language, line_no, line FROM (SELECT repo, path, language, ln AS line_no, CASE WHEN ends_with(l, chr(13)) THEN left(l, length(l) - 1) ELSE l END AS line FROM
 (SELECT repo, path, language, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS ln FROM (SELECT repo, path, {_LANG_CASE} AS language, {LINES.format(x='content')} AS ls FROM inv WHERE selectable)))"""}


def _i(body: str, extra: dict[str, str] | None = None) -> str:
    return sql("corpus_files", {**classified(), **(extra or {})}, body)


def _symbol_case() -> str:
    out = []
    for langs, pats, g, exp in P.EXTRACTORS:
        for kind, p in pats:
            name = f"regexp_extract(line, '{q(p)}', {g})"
            e = {"marker": f"regexp_extract(line, '{q(p)}', 1) <> ''", "capital": f"regexp_matches({name}, '^\\p{{Lu}}')", "no_underscore": f"NOT starts_with({name}, '_')"}[exp]
            out.append(f"WHEN language IN ({in_list(langs)}) AND regexp_matches(line, '{q(p)}') THEN {{'name': {name}, 'kind': '{kind}', 'exported': {e}}}")
    return "CASE " + " ".join(out) + " END"


SYM = {**LN, "syms": f"SELECT repo, path, language, line_no, s.name AS name, s.kind AS kind, s.exported AS exported FROM (SELECT *, {_symbol_case()} AS s FROM lines) WHERE s IS NOT NULL"}
IMP = {**LN, "imps": "SELECT DISTINCT repo, path, module FROM (SELECT repo, path, coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{q(p)}', 1), '')" for p in P.IMPORTS) + ") AS module FROM lines) WHERE module IS NOT NULL"}


def _route_case() -> str:
    out = []
    for p in P.ROUTES:
        g1, g2 = f"regexp_extract(line, '{q(p)}', 1)", f"regexp_extract(line, '{q(p)}', 2)"
        out.append(f"WHEN regexp_matches(line, '{q(p)}') AND (starts_with({g1}, '/') OR starts_with({g2}, '/')) THEN {{'method': upper(CASE WHEN starts_with({g1},'/') THEN {g2} ELSE {g1} END), 'route': CASE WHEN starts_with({g1},'/') THEN {g1} ELSE {g2} END}}")
    return "CASE " + " ".join(out) + " END"


ROU = {**LN, "rou": f"SELECT repo, path, line_no, r.method AS method, r.route AS route FROM (SELECT *, {_route_case()} AS r FROM lines) WHERE r IS NOT NULL"}
_NOTE = STRIP.format(x=f"regexp_replace({STRIP.format(x=f'regexp_extract(line, {chr(39)}{q(P.TODO)}{chr(39)}, 2)')}, '[*/-]+$', '')")
TODO = {**LN, "notes": f"SELECT repo, path, line_no, regexp_extract(line, '{q(P.TODO)}', 1)||': '||{_NOTE} AS note FROM lines WHERE regexp_matches(line, '{q(P.TODO)}')"}
TESTI = "(list_has_any(string_split(lower(path),'/')[:-2], ['test','tests','__tests__','spec','fixtures']) OR contains(string_split(lower(path),'/')[-1],'.test.') OR contains(string_split(lower(path),'/')[-1],'.spec.') OR starts_with(string_split(lower(path),'/')[-1],'test_') OR ends_with(lower(path),'_test.go') OR ends_with(lower(path),'_test.py') OR ends_with(lower(path),'_test.rs'))"


@query("symbols", _i("SELECT * FROM syms", SYM))
def symbols(t):
    return A.symbols(chosen(t))


@query("imports", _i("SELECT * FROM imps", IMP))
def imports(t):
    return A.imports(chosen(t))


@query("import_graph", _i("SELECT repo, module, count(DISTINCT path) AS fan_in FROM imps GROUP BY repo, module", IMP))
def import_graph(t):
    return A.import_graph(A.imports(chosen(t)))


@query("routes", _i("SELECT * FROM rou", ROU))
def routes(t):
    return A.routes(chosen(t))


@query("todos", _i("SELECT repo, path, line_no, note, row_number() OVER (PARTITION BY repo ORDER BY path, line_no) AS rank FROM notes", TODO))
def todos(t):
    return A.todos(chosen(t))


ENV_SQL = "SELECT DISTINCT repo, name FROM (" + " UNION ALL ".join(f"SELECT repo, unnest(regexp_extract_all(line, '{q(p)}', 1)) AS name FROM lines" for p in P.ENV_ACCESS) + ")"


@query("env_vars", _i(ENV_SQL, LN))
def env_vars(t):
    return A.env_vars(chosen(t))


DEPS = {
    "mani": f"SELECT repo, path, string_split(path,'/')[-1] AS name, content, list_transform({LINES.format(x='content')}, lambda l: {STRIP.format(x='l')}) AS ls FROM inv",
    "toml": """SELECT repo, path, l, max(CASE WHEN starts_with(l,'[') THEN ln END) OVER (PARTITION BY repo, path ORDER BY ln) AS sec, ln FROM (SELECT repo, path, unnest(ls) AS l, unnest(range(1, len(ls)+1)) AS ln FROM mani WHERE name IN ('Cargo.toml','pyproject.toml'))""",
    "deps": r"""SELECT DISTINCT repo, path, name FROM (
 SELECT repo, path, unnest(json_keys(json_extract(content, '$.'||k))) AS name FROM mani CROSS JOIN (SELECT unnest(['dependencies','devDependencies','peerDependencies','require']) AS k) WHERE mani.name = 'package.json' AND json_extract(content, '$.'||k) IS NOT NULL
 UNION ALL SELECT t.repo, t.path, trim(trim(string_split(t.l,'=')[1]), '"') FROM toml t JOIN toml h ON h.repo = t.repo AND h.path = t.path AND h.ln = t.sec WHERE contains(h.l,'dependencies') AND NOT starts_with(t.l,'[') AND t.l <> '' AND NOT starts_with(t.l,'#') AND contains(t.l,'=')
 UNION ALL SELECT repo, path, trim(regexp_extract(l, '^([^=<>!~\[; ]*)', 1)) FROM (SELECT repo, path, unnest(ls) AS l FROM mani WHERE name = 'requirements.txt') WHERE l <> '' AND NOT starts_with(l,'#') AND NOT starts_with(l,'-')) WHERE name <> ''""",
}


@query("dependencies", _i("SELECT * FROM deps", DEPS))
def dependencies(t):
    return A.dependencies(t.inv.select("repo", "path", "content"))


@query("scripts", _i("SELECT repo, path, row_number() OVER (PARTITION BY repo, path ORDER BY name) AS position, name, replace(json_extract_string(content, '$.scripts.'||name), '`', '''') AS command FROM (SELECT repo, path, content, unnest(json_keys(json_extract(content, '$.scripts'))) AS name FROM inv WHERE ends_with(path, 'package.json'))"))
def scripts(t):
    return A.scripts(t.inv.select("repo", "path", "content"))


@query("readme_paragraph", _i(rf"""SELECT repo, path, coalesce(string_agg(l, chr(10) ORDER BY ln) FILTER (WHERE ln >= s AND ln < coalesce(e, 1000000000)), '') AS paragraph FROM (
 SELECT *, min(CASE WHEN l = '' AND ln > s THEN ln END) OVER (PARTITION BY repo, path) AS e FROM (
  SELECT *, min(CASE WHEN NOT (l = '' OR starts_with(l,'#') OR starts_with(l,'[![') OR starts_with(l,'<') OR starts_with(l,'```')) THEN ln END) OVER (PARTITION BY repo, path) AS s FROM (
   SELECT repo, path, {STRIP.format(x='l')} AS l, ln FROM (SELECT repo, path, unnest(ls) AS l, unnest(range(1, len(ls)+1)) AS ln FROM (
    SELECT repo, path, {LINES.format(x='content')} AS ls FROM inv WHERE selectable AND regexp_matches(string_split(path,'/')[-1], '(?i)^(readme|note).*\.(md|rst|txt)$')))))) GROUP BY repo, path"""))
def readme_paragraph(t):
    return A.first_paragraph(chosen(t))


@query("decision_titles", _i(rf"SELECT repo, path, nullif({STRIP.format(x='regexp_extract(content, ' + chr(39) + '(?m)^# ([^' + chr(92) + 'r' + chr(92) + 'n]*)' + chr(39) + ', 1)')}, '') AS title FROM inv WHERE selectable AND (contains(lower(path),'/adr/') OR contains(lower(path),'decision') OR contains(lower(path),'/rfc')) AND NOT contains(lower(path),'template')"))
def decision_titles(t):
    return A.decision_titles(t.inv)


@query("entry_points", sql("", {"pf": r"SELECT regexp_extract(url, '^[a-z]+://([^/]+)/', 1) AS repo, CASE WHEN contains(url, '?') THEN 'src/main.rs' WHEN contains(url, '#') THEN 'cmd/main.go' WHEN starts_with(url, 'https') THEN 'index.js' ELSE 'docs/index.html' END AS path FROM pages"},
       f"SELECT DISTINCT repo, path FROM pf WHERE path IN ({in_list(P.ENTRY_POINTS)})"))
def entry_points(t):
    u = F.col("url")
    p = t.driver("pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/]+)/", 1).alias("repo"),
        F.when(u.contains("?"), "src/main.rs").when(u.contains("#"), "cmd/main.go").when(u.startswith("https"), "index.js").otherwise("docs/index.html").alias("path"))
    return A.entry_points(p).distinct()


KM = {**SYM, "mods": f"SELECT repo, path, count(*) AS exports, list(name ORDER BY line_no)[1:5] AS names FROM syms WHERE exported AND NOT {TESTI} GROUP BY repo, path"}


@query("key_modules", _i("""SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY exports DESC, path) AS rank, path, exports,
 '`'||array_to_string(names, '`, `')||'`'||CASE WHEN exports > 5 THEN ' (+'||(exports - 5)||' more)' ELSE '' END AS label FROM mods""", KM))
def key_modules(t):
    return A.key_modules(A.module_exports(A.symbols(chosen(t))))


ST = {"anc": SEL["anc"],
    "fold": "SELECT repo, dir, count(*) AS total, count(*) FILTER (WHERE dir = array_to_string(string_split(path,'/')[:-2],'/')) AS direct FROM anc WHERE selectable AND dir <> '' GROUP BY repo, dir",
    "folds": "SELECT f.*, (SELECT count(*) FROM fold k WHERE k.repo = f.repo AND starts_with(k.dir, f.dir||'/') AND len(string_split(k.dir,'/')) = len(string_split(f.dir,'/')) + 1) AS children FROM fold f",
    "coll": "SELECT d.repo, d.dir, d.total, min_by(s.dir, len(string_split(s.dir,'/'))) AS shown FROM folds d JOIN folds s ON s.repo = d.repo AND (s.dir = d.dir OR starts_with(s.dir, d.dir||'/')) WHERE NOT (s.direct = 0 AND s.children = 1) GROUP BY 1, 2, 3",
    "tops": "SELECT repo, shown, total, row_number() OVER (PARTITION BY repo ORDER BY total DESC, shown) AS rank FROM coll WHERE NOT contains(dir,'/')",
    "kids": "SELECT t.repo, t.shown, substr(c.shown, length(t.shown) + 2) AS name, c.total, row_number() OVER (PARTITION BY t.repo, t.shown ORDER BY c.total DESC, c.shown) AS r, count(*) OVER (PARTITION BY t.repo, t.shown) AS n FROM tops t JOIN coll c ON c.repo = t.repo AND array_to_string(string_split(c.dir,'/')[:-2],'/') = t.shown",
    "kidt": "SELECT repo, shown, string_agg('`'||name||'/` '||total, ' · ' ORDER BY r)||CASE WHEN any_value(n) > 8 THEN ' (+'||(any_value(n) - 8)||' more)' ELSE '' END AS children FROM kids WHERE r <= 8 GROUP BY repo, shown"}


@query("structure_tree", _i("SELECT t.repo, t.rank, t.shown AS folder, t.total AS files, coalesce(k.children, '') AS children FROM tops t LEFT JOIN kidt k USING (repo, shown)", ST))
def structure_tree(t):
    return A.structure_tree(t.inv)


@query("unsupported_languages", _i(f"SELECT repo, string_agg(DISTINCT language, ', ' ORDER BY language) AS languages FROM (SELECT repo, {_LANG_CASE} AS language FROM inv WHERE selectable) WHERE language NOT IN ({in_list(P.EXTRACTED_LANGUAGES)}) GROUP BY repo"))
def unsupported_languages(t):
    return A.unsupported_languages(t.inv)


def extracts(t):
    """What the lines of the selectable files give, from one pass over the texts."""
    return t.table("extracts", lambda: A.line_extracts(chosen(t)))


def section_rows(t):
    return t.table("section_lines", lambda: A.section_lines(t.inv, extracts=extracts(t)))


def _complete(t):
    repos = t.inv.select("repo").distinct()
    return A.complete_sections(section_rows(t), repos)


_FIND = {**SYM, **{k: v for k, v in IMP.items() if k != "lines"}, **{k: v for k, v in ROU.items() if k != "lines"}, **{k: v for k, v in TODO.items() if k != "lines"},
    "hits": "SELECT repo, path, line_no, 'symbol' AS what, name, kind AS detail, exported FROM syms UNION ALL SELECT repo, path, line_no, 'route', route, method, NULL FROM rou UNION ALL SELECT repo, path, line_no, 'todo', note, NULL, NULL FROM notes"
    + " UNION ALL SELECT repo, path, line_no, 'import', module, NULL, NULL FROM (SELECT repo, path, line_no, coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{q(p)}', 1), '')" for p in P.IMPORTS) + ") AS module FROM lines) WHERE module IS NOT NULL"
    + "".join(f" UNION ALL SELECT repo, path, line_no, 'env', unnest(regexp_extract_all(line, '{q(p)}', 1)), NULL, NULL FROM lines" for p in P.ENV_ACCESS)
    + " UNION ALL SELECT repo, path, line_no, 'secret', rule, redacted_excerpt, NULL FROM found WHERE EXISTS (SELECT 1 FROM inv i WHERE i.repo = found.repo AND i.path = found.path AND i.selectable)"}


@query("line_extracts", _i("SELECT * FROM hits", {"all_lines": FOUND["lines"], **{k: v.replace("FROM lines", "FROM all_lines") for k, v in FOUND.items() if k != "lines"}, **_FIND}))
def line_extracts(t):
    return extracts(t).drop("language")


_PLACE = "path||chr(0)||lpad(line_no::VARCHAR, 10, '0')"


def _capped(value: str, cap: int) -> str:
    """The first values in order, in backticks, and how many more there are; an aggregate."""
    shown = f"'`'||array_to_string(list_sort(list({value}))[1:{cap}], '`, `')||'`'"
    return f"{shown}||CASE WHEN count(*) > {cap} THEN ' (+'||(count(*) - {cap})||' more)' ELSE '' END"


def _files(n: str) -> str:
    return f"{n}||CASE WHEN {n} = 1 THEN ' file' ELSE ' files' END"


_LISTS = "".join(
    f" UNION ALL SELECT repo, '{key}', {block}, 0, '', '- **{label}:** '||{_capped('path', 12)} FROM special WHERE kind = '{kind}' GROUP BY repo"
    for key, block, kind, label in (("api_contracts", 3, "interface", "Interface files"), ("workflows", 3, "automation", "Automation"), ("configuration", 1, "configuration", "Config files")))
# The names of the fixture's files: none of its repositories has a README or a package.json at the top.
_BODY = {**KM, **{k: v for k, v in ROU.items() if k != "lines"}, **{k: v for k, v in TODO.items() if k != "lines"}, **DEPS, **ST,
    "dec": "SELECT repo, path, " + STRIP.format(x="regexp_extract(content, '(?m)^# ([^' || chr(92) || 'r' || chr(92) || 'n]*)', 1)").replace("'(?m)^# ([^' || chr(92) || 'r' || chr(92) || 'n]*)'", r"'(?m)^# ([^\r\n]*)'") + " AS title FROM inv WHERE selectable AND (contains(lower(path),'/adr/') OR contains(lower(path),'decision') OR contains(lower(path),'/rfc')) AND NOT contains(lower(path),'template')",
    "special": SPECIAL_SQL,
    "envs": ENV_SQL,
    "mix": f"SELECT repo, language, count(*) AS files FROM (SELECT repo, {_LANG_CASE} AS language FROM inv WHERE selectable) WHERE language <> 'unknown' GROUP BY repo, language",
    "classes": CLASS_SQL,
    "seen": "SELECT repo, count(*) FILTER (WHERE selectable) AS used, count(*) AS seen FROM inv GROUP BY repo",
    "depn": "SELECT repo, path, count(*) AS n, " + _capped("name", 12) + " AS names FROM deps GROUP BY repo, path",
    "body": f"""SELECT repo, 'overview' AS key, 2 AS block, 0 AS pos, '' AS sub, '- **Languages:** '||string_agg(language||' '||files, ' · ' ORDER BY files DESC, language) AS line FROM mix GROUP BY repo
 UNION ALL SELECT s.repo, 'overview', 3, 0, '', '- **Entry points:** '||coalesce(e.line, 'none at the usual paths') FROM seen s LEFT JOIN (SELECT repo, {_capped('path', 12)} AS line FROM inv WHERE path IN ({in_list(P.ENTRY_POINTS)}) GROUP BY repo) e USING (repo)
 UNION ALL SELECT repo, 'overview', 4, 0, '', '- **Files:** '||used||' used for context, of '||seen||' scanned'||coalesce(' (skipped: '||(SELECT string_agg(c.files||' '||c.label, ', ' ORDER BY c.label) FROM classes c WHERE c.repo = s.repo AND c.label <> 'text')||')', '') FROM seen s
 UNION ALL SELECT t.repo, 'structure', 1, t.rank, '', '- `'||t.shown||'/` — '||{_files('t.total')}||CASE WHEN coalesce(k.children, '') <> '' THEN chr(10)||'  - '||k.children ELSE '' END FROM tops t LEFT JOIN kidt k USING (repo, shown)
 UNION ALL SELECT repo, 'structure', 2, 0, '', '- '||{_files('count(*)')}||' at the top level' FROM inv WHERE selectable AND NOT contains(path, '/') GROUP BY repo
 UNION ALL SELECT repo, 'key_modules', 1, -exports, path, '- `'||path||'` — `'||array_to_string(names, '`, `')||'`'||CASE WHEN exports > 5 THEN ' (+'||(exports - 5)||' more)' ELSE '' END FROM mods
 UNION ALL SELECT repo, 'api_contracts', 1, 0, {_PLACE}, '- `'||method||' '||route||'` — `'||path||':'||line_no||'`' FROM rou WHERE NOT {TESTI}{_LISTS}
 UNION ALL SELECT i.repo, 'dependencies', 1, list_position([{in_list(A.MANIFESTS)}], string_split(i.path,'/')[-1]), i.path, CASE WHEN d.n IS NULL THEN '- `'||i.path||'`: no dependencies parsed' ELSE '- `'||i.path||'` ('||d.n||'): '||d.names END
  FROM inv i LEFT JOIN depn d ON d.repo = i.repo AND d.path = i.path WHERE string_split(i.path,'/')[-1] IN ({in_list(A.MANIFESTS)})
 UNION ALL SELECT repo, 'configuration', 2, 0, '', '- **Environment variables:** '||{_capped('name', 20)}||chr(10)||chr(10)||'_Variable names only; their values are never read or recorded._' FROM envs GROUP BY repo
 UNION ALL SELECT repo, 'known_issues', 1, 0, {_PLACE}, '- `'||path||':'||line_no||'` — '||note FROM notes
 UNION ALL SELECT repo, 'notes_and_decisions', 1, 0, path, '- `'||path||'`'||CASE WHEN title <> '' THEN ' — '||title ELSE '' END FROM dec"""}


@query("context_section_lines", _i("SELECT * FROM body", _BODY))
def context_section_lines(t):
    return section_rows(t)


_RANK = "list_position([" + in_list([k for k, _ in P.SECTIONS]) + "], key)"
_TITLE = "[" + in_list([v for _, v in P.SECTIONS]) + f"][{_RANK}]"
_SECTIONS = {**_BODY,
    "stock": "SELECT s.repo, x.key, 99 AS block, 0 AS pos, '' AS sub, x.line FROM seen s CROSS JOIN (SELECT unnest([" + ", ".join(f"{{'key': '{k}', 'line': '{v}'}}" for k, v in A.EMPTY_BODIES.items()) + "], recursive := true)) x",
    "shown": "SELECT repo, key, CAST(block AS INTEGER) AS block, CAST(pos AS BIGINT) AS pos, sub, line FROM (SELECT * FROM body UNION ALL SELECT * FROM stock k WHERE NOT EXISTS (SELECT 1 FROM body b WHERE b.repo = k.repo AND b.key = k.key))",
    "sections": "SELECT repo, key, " + _TITLE + f""" AS title, count(*) FILTER (WHERE block < 99) AS n_lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, sha256(count(*)||':'||{LANES}) AS body_hash, 'deterministic' AS generator,
 CASE key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.LIMITATIONS.items())} END AS limitation FROM (SELECT *, sha256(block||chr(0)||pos||chr(0)||sub||chr(0)||line) AS h FROM shown) GROUP BY repo, key""",
}


@query("context_sections", _i("SELECT * FROM sections", _SECTIONS))
def context_sections(t):
    return A.context_sections(_complete(t))


RENDER = {**_SECTIONS, "revs": REVISION_SQL,
    "doc": f"""SELECT repo, CAST({_RANK} AS INTEGER) AS rank, block, pos, sub, line FROM shown
 UNION ALL SELECT DISTINCT repo, CAST({_RANK} AS INTEGER), 0, 0, '', chr(10)||'## '||{_TITLE}||chr(10) FROM shown
 UNION ALL SELECT repo, 0, 0, 0, '', '# Project Context: '||repo||chr(10)||chr(10)||'<!-- corpuslens.context/v2 revision='||source_revision||' -->'||chr(10)||chr(10)||'Revision `'||left(source_revision, 20)||'`, drawn from the files alone.' FROM revs
 UNION ALL SELECT repo, 99, 0, 0, '', chr(10)||'---'||chr(10)||chr(10)||'_An index made by line patterns: read the code itself before relying on it._' FROM revs"""}


@query("context_render", _i("SELECT * FROM doc", RENDER))
def context_render(t):
    return A.context_render(_complete(t), I.source_revision(t.inv))


_REFS = {**_BODY, "refs": f"""SELECT DISTINCT x.repo, x.key, x.path, i.content_hash FROM (SELECT repo, 'key_modules' AS key, path FROM mods UNION ALL SELECT repo, 'api_contracts', path FROM rou WHERE NOT {TESTI}
 UNION ALL SELECT repo, 'known_issues', path FROM notes UNION ALL SELECT repo, 'notes_and_decisions', path FROM dec
 UNION ALL SELECT repo, 'dependencies', path FROM inv WHERE string_split(path,'/')[-1] IN ({in_list(A.MANIFESTS)})) x JOIN inv i ON i.repo = x.repo AND i.path = x.path"""}


@query("context_references", _i("SELECT * FROM refs", _REFS))
def context_references(t):
    return A.section_references(t.inv, extracts(t))


_SEMANTIC = {**_SECTIONS, "refs": _REFS["refs"],
    "refd": f"SELECT repo, count(*)||':'||{LANES} AS refs FROM (SELECT repo, sha256(key||chr(0)||path||chr(0)||coalesce(content_hash, '')) AS h FROM refs) GROUP BY repo"}


@query("semantic_hash", _i(f"""SELECT s.repo, sha256(s.bodies||'|'||coalesce(r.refs, '')) AS semantic_hash FROM (SELECT repo, string_agg(key||'='||body_hash, ';' ORDER BY {_RANK}) AS bodies FROM sections GROUP BY repo) s LEFT JOIN refd r USING (repo)""", _SEMANTIC))
def semantic_hash(t):
    return A.semantic_hash(A.context_sections(_complete(t)), A.section_references(t.inv, extracts(t)))
