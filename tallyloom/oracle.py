"""The base tables of views.py in DuckDB's SQL, as common table expressions."""

from __future__ import annotations

from .operators import classify as C
from .views import EXTENSIONS


def q(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


EXT = f"{q(EXTENSIONS)}[doc_id % 8 + 1]"
PATH = f"CASE WHEN doc_id % 97 = 0 THEN 'services/' || source || '/' || lang || '/doc_' || doc_id || '/go.mod' WHEN doc_id % 50 = 0 THEN 'doc_' || doc_id || {EXT} ELSE 'services/' || source || '/' || lang || '/doc_' || doc_id || {EXT} END"
SEGMENTS = "string_split(lower(path), '/')"
BASE = "list_last(string_split(lower(path), '/'))"
SUFFIX = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"
HEAD = "lower(left(data, 4096))"


def role_case(values: dict[str, str], data: bool = True) -> str:
    """Tests per role in order, on a table with path and data."""
    seg = lambda names: f"list_has_any({SEGMENTS}, {q(names)})"
    has = lambda col, names: f"list_contains({q(names)}, {col})"
    header = f" OR (contains({HEAD}, 'code generated') AND contains({HEAD}, 'do not edit')) OR contains({HEAD}, '@generated') OR contains({HEAD}, 'autogenerated file')" if data else ""
    shebang = " OR (starts_with(data, '#!') AND regexp_matches(lower(string_split(data, chr(10))[1]), 'python|node|deno|ruby|perl|php|bash|sh|zsh'))" if data else ""
    tests = {
        "generated_code": seg(C.GENERATED_FOLDERS) + header,
        "lock_file": f"{SUFFIX} = '.lock' OR {has(BASE, C.LOCK_NAMES)}",
        "fixture": f"{seg(C.FIXTURE_FOLDERS)} OR contains({BASE}, '.min.') OR ends_with({BASE}, '.map')",
        "test": f"{seg(C.TEST_FOLDERS)} OR ends_with({BASE}, '_test.go') OR (starts_with({BASE}, 'test_') AND ends_with({BASE}, '.py')) OR contains({BASE}, '.test.') OR contains({BASE}, '.spec.')",
        "contract": f"{has(SUFFIX, C.CONTRACT_EXTENSIONS)} OR contains({BASE}, 'openapi') OR contains({BASE}, 'swagger') OR contains({BASE}, 'schema.json') OR {seg(C.CONTRACT_FOLDERS)}",
        "database": f"{SUFFIX} = '.sql' OR {seg(C.DATABASE_FOLDERS)}",
        "dependency_manifest": f"{has(BASE, C.MANIFEST_NAMES)} OR (starts_with({BASE}, 'requirements') AND ends_with({BASE}, '.txt'))",
        "runtime_configuration": f"starts_with(lower(path), '.github/workflows/') OR {seg(C.RUNTIME_FOLDERS)} OR {has(SUFFIX, C.RUNTIME_EXTENSIONS)} OR {BASE} IN ('dockerfile', 'makefile') OR starts_with({BASE}, 'dockerfile.') OR starts_with({BASE}, 'docker-compose')",
        "production_source": f"{has(SUFFIX, C.SOURCE_EXTENSIONS)} OR ({SUFFIX} = '' AND {seg(C.SOURCE_FOLDERS)}){shebang}",
        "prose": has(SUFFIX, C.PROSE_EXTENSIONS),
    }
    return "CASE " + " ".join(f"WHEN {tests[r]} THEN '{values[r]}'" for r in tests) + f" ELSE '{values['unknown_source']}' END"


ROLE = role_case({r: r for r in C.ROLES})
REASON = role_case(C.ROLES)
EARLY_ROLE = role_case({r: r for r in C.ROLES}, data=False)
QUIET = "('test', 'lock_file', 'prose', 'fixture', 'generated_code')"
TRACKED = f"""tracked AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'fresh/' ELSE '' END || ({PATH}) AS path, CASE WHEN doc_id % 101 = 0 THEN '160000' WHEN doc_id % 103 = 0 THEN '100600' WHEN doc_id % 3 = 0 THEN '100755' ELSE '100644' END AS mode,
  text AS data, strlen(text)::BIGINT AS size FROM documents)"""


def owned(name: str, source: str) -> str:
    """`name` from the table `source` (with path and role): component_key and root_component."""
    return f"""{name}_m AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dir FROM {source} WHERE role = 'dependency_manifest' AND contains(path, '/')),
{name}_n AS (SELECT s.path, max_by(m.dir, length(m.dir)) AS dir FROM {source} s JOIN {name}_m m ON starts_with(s.path, m.dir || '/') GROUP BY s.path),
{name} AS (SELECT s.*, coalesce(n.dir, CASE WHEN NOT contains(s.path, '/') THEN '@root' WHEN len(string_split(s.path, '/')) > 2 AND string_split(s.path, '/')[1] IN ('apps', 'cmd', 'internal', 'packages', 'pkg', 'services', 'src')
    THEN string_split(s.path, '/')[1] || '/' || string_split(s.path, '/')[2] ELSE string_split(s.path, '/')[1] END) AS component_key,
  n.dir IS NULL AND NOT contains(s.path, '/') AS root_component FROM {source} s LEFT JOIN {name}_n n USING (path))"""


CUR = f"""{TRACKED},
cur_r AS (SELECT doc_id, path, data, size, 'sha256:' || sha256(data) AS source_hash, {ROLE} AS role FROM tracked),
cur_t AS (SELECT *, role NOT IN {QUIET} AS triggers FROM cur_r),
{owned("cur", "cur_t")}"""

OLD = f"""old_p AS (SELECT doc_id, {PATH} AS path, text AS data, strlen(text)::BIGINT AS size FROM documents),
old_r AS (SELECT *, {ROLE} AS role FROM old_p),
old_t AS (SELECT *, role NOT IN {QUIET} AS triggers FROM old_r),
{owned("old_o", "old_t")},
old AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'retired/' || path WHEN doc_id % 19 = 0 THEN 'legacy/' || path ELSE path END AS path, 'sha256:' || sha256(CASE WHEN doc_id % 7 = 0 THEN data || 'x' ELSE data END) AS source_hash, size, role, triggers,
  CASE WHEN doc_id % 17 = 0 THEN 'services/src0' ELSE component_key END AS component_key, root_component AND doc_id % 17 <> 0 AS root_component FROM old_o)"""

DIFFERS = "(o.source_hash IS DISTINCT FROM c.source_hash OR o.role IS DISTINCT FROM c.role OR o.triggers IS DISTINCT FROM c.triggers OR o.component_key IS DISTINCT FROM c.component_key OR o.root_component IS DISTINCT FROM c.root_component)"
CHANGES = f"""changes AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS status,
  CASE WHEN c.path IS NULL THEN o.path END AS old_path, c.path AS new_path FROM old o FULL JOIN cur c ON o.path = c.path WHERE o.path IS NULL OR c.path IS NULL OR {DIFFERS})"""
NORM = """norm AS (SELECT ch.status, coalesce(ch.old_path, '') AS old_path, coalesce(ch.new_path, '') AS new_path, coalesce(o.role, '') AS old_role, coalesce(c.role, '') AS new_role, coalesce(o.component_key, '') AS old_key, coalesce(c.component_key, '') AS new_key,
  coalesce(o.root_component, false) AS old_root, coalesce(c.root_component, false) AS new_root, coalesce(o.triggers, false) AS old_triggers, coalesce(c.triggers, false) AS new_triggers
  FROM changes ch LEFT JOIN old o ON ch.old_path = o.path LEFT JOIN cur c ON ch.new_path = c.path)"""
OWNERSHIP = """ownership AS (SELECT unnest([{'k': o.component_key, 'r': o.root_component}, {'k': c.component_key, 'r': c.root_component}]) AS x, o.path FROM old o JOIN cur c ON o.path = c.path
  WHERE o.component_key IS DISTINCT FROM c.component_key OR o.root_component IS DISTINCT FROM c.root_component)"""
POLICY = f"""policy AS (SELECT DISTINCT x.k AS component_key, x.r AS root_component FROM (
  SELECT unnest([{{'k': o.component_key, 'r': o.root_component, 'ok': o.path IS NOT NULL AND o.triggers}}, {{'k': c.component_key, 'r': c.root_component, 'ok': c.path IS NOT NULL AND c.triggers}}]) AS x
  FROM old o FULL JOIN cur c ON o.path = c.path WHERE o.path IS NULL OR c.path IS NULL OR {DIFFERS}) WHERE x.ok)"""
PICKED = """picked AS (
  SELECT new_key AS component_key, new_root AS root_component, 'source_' || status AS reason FROM norm WHERE new_triggers AND status <> 'deleted'
  UNION SELECT old_key, old_root, 'source_' || status FROM norm WHERE old_triggers AND status <> 'added'
  UNION SELECT x.k, x.r, 'ownership_changed' FROM ownership UNION SELECT component_key, root_component, 'source_policy_changed' FROM policy)"""
KNOWN = "known AS (SELECT component_key, root_component FROM old UNION SELECT component_key, root_component FROM cur WHERE triggers)"
REASONS = "affected AS (SELECT component_key, root_component, list_sort(list(DISTINCT reason)) AS reasons FROM picked SEMI JOIN known USING (component_key, root_component) GROUP BY ALL)"

FRAME = lambda x: f"unhex(lpad(hex(strlen({x})), 16, '0')) || encode({x})"


def framed(*fields: str) -> str:
    return "'sha256:' || sha256(" + " || ".join(f"unhex(lpad(printf('%X', strlen({f})), 16, '0')) || encode({f})" for f in fields) + ")"


def section(name: str, rows: str, key: str, order: str) -> str:
    """A digest of the rows (key, `order`, digest) by key: their number and, bucket by bucket, their digests in order."""
    by = f"{key}, " if key else ""
    return f"""{name}_b AS (SELECT {by}substr(digest, 8, 2) AS bucket, count(*) AS n, sha256(string_agg(digest, '' ORDER BY {order})) AS h FROM ({rows}) GROUP BY ALL),
{name} AS (SELECT {by}{framed("n::VARCHAR", "joined")} AS section FROM (SELECT {by}sum(n)::BIGINT AS n, string_agg(bucket || h, '' ORDER BY bucket) AS joined FROM {name}_b GROUP BY ALL))"""


def input_hash(name: str, source: str, data: str, versions: list[str], shown: str | None = None, norm: str | None = None) -> str:
    """shown: a table of component_key, root_component, kind, path; norm: one of changes with both sides."""
    keys = "component_key, root_component"
    one, head = framed("path", "role", "source_hash", data), [f"'{v}'" for v in versions]
    files = f"SELECT {keys}, false AS late, path, {one} AS digest FROM {source} WHERE triggers"
    out = [section(f"{name}_k", f"SELECT component_key AS k, {framed('component_key')} AS digest FROM (SELECT DISTINCT {keys} FROM {source} WHERE triggers)", "", "k")]
    joins, none = f"JOIN {name}_s s USING ({keys})", framed("'0'", "''")
    got = ["(SELECT section FROM " + f"{name}_k)", "s.section", none, none]
    if shown:
        seen = lambda kind: f"SELECT c.component_key, c.root_component, true AS late, path, {one} AS digest FROM {shown} c JOIN (SELECT path, role, source_hash, {data if data.startswith(chr(39)) else 'data'} AS data FROM {source}) USING (path) WHERE kind = '{kind}'"
        files += " UNION ALL " + seen("supporting")
        out.append(section(f"{name}_m", seen("manifest"), keys, "path"))
        joins += f" LEFT JOIN {name}_m m USING ({keys})"
        got[2] = f"coalesce(m.section, {none})"
    out.append(section(f"{name}_s", files, keys, "late, path"))
    if norm:
        told = framed("status", "old_path", "new_path", "old_role", "new_role", "old_key", "new_key", *[f"{s}_{c}::VARCHAR" for c in ("root", "triggers") for s in ("old", "new")])
        sides = " UNION ".join(f"SELECT {s}_key AS component_key, {s}_root AS root_component, old_path, new_path, {told} AS digest FROM {norm} WHERE {s}_key <> ''" for s in ("old", "new"))
        out.append(section(f"{name}_c", sides, keys, "old_path, new_path"))
        joins += f" LEFT JOIN {name}_c x USING ({keys})"
        got[3] = f"coalesce(x.section, {none})"
    hashed = framed(*head, "component_key", "root_component::VARCHAR", *got)
    return ",\n".join([*out, f"{name} AS (SELECT component_key, root_component, {hashed} AS input_hash FROM (SELECT DISTINCT {keys} FROM {source} WHERE triggers) {joins})"])


ITEMS = f"items AS (SELECT doc_id, source AS component_key, lang AS section, 'T' || doc_id % 40 AS title, 'D' || doc_id % 60 AS description, {PATH} AS path FROM documents)"
MERGED = """merged AS (SELECT component_key, section, title, description, list_sort(list(DISTINCT path)) AS allp, '{"title":"' || title || '","description":"' || description || '"}' AS canonical FROM items GROUP BY ALL),
mi AS (SELECT component_key, section, title, description, allp[1:200] AS paths, len(allp)::BIGINT AS support, greatest(len(allp) - 200, 0)::BIGINT AS paths_omitted, canonical, sha256(canonical) AS digest FROM merged)"""
