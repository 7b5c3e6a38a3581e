"""Queries over dossiers: their contract, and the documents made of them. Expected texts and issues are written out."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from . import views as V
from .operators import classify, documents, dossiers
from .queries import POLICY, _SCAN, query
from .sources.tables import stored

# One dossier for each source, its name in place of @; every third has no items.
_DIAGRAMS = [
    {"type": "flowchart", "title": "Flow", "source_paths": ["x/@.go"], "nodes": [{"key": "a", "label": "@ \"1\""}, {"key": "b", "label": "B"}], "edges": [{"from": "a", "to": "b", "label": "uses"}, {"from": "b", "to": "a", "label": " "}]},
    {"type": "sequence", "title": "Talk", "source_paths": ["x/@.go"], "participants": [{"key": "u", "label": "User"}, {"key": "s", "label": "@"}], "messages": [{"from": "u", "to": "s", "label": "ask", "response": False}, {"from": "s", "to": "u", "label": "tell", "response": True}]},
    {"type": "class", "title": "Types", "source_paths": ["x/@.go"], "classes": [{"key": "k", "label": "@", "members": ["id"]}, {"key": "l", "label": "L", "members": []}], "relationships": [{"from": "k", "to": "l", "kind": "composition", "label": "has"}, {"from": "l", "to": "k", "kind": "dependency", "label": ""}]},
]
FULL = {
    "title": "The @", "purpose": "Does *@*.", "source_paths": ["x/@.go", "y z.go"],
    "architecture": [{"title": "Core", "description": "Keeps @.", "source_paths": ["x/@.go"]}, {"title": "Edge", "description": "Calls it.", "source_paths": ["y z.go"]}],
    "interfaces": [{"name": "get|@", "kind": "rpc", "direction": "inbound", "description": "Reads.", "source_paths": ["x/@.go", "y z.go"]}],
    "data_models": [{"name": "Row", "kind": "entity", "description": "A row.", "fields": [{"name": "id", "type": "long", "description": "Key."}], "relationships": [{"target": "@", "kind": "references", "description": "Owner."}], "source_paths": ["x/@.go"]}],
    "workflows": [{"name": "Load", "description": "Loads.", "steps": [{"actor": "User", "action": "asks", "target": "@"}, {"actor": "@", "action": "answers", "target": ""}], "source_paths": ["x/@.go"]}],
    "dependencies": [{"name": "db", "kind": "tool", "purpose": "Stores.", "component_key": "", "source_paths": ["x/@.go"]}, {"name": "lib", "kind": "internal_component", "purpose": "Helps.", "component_key": "@", "source_paths": ["x/@.go"]}],
    "review_gaps": [{"kind": "uncertainty", "description": "Unclear.", "recommendation": "Ask.", "source_paths": ["x/@.go"]}],
    "diagrams": _DIAGRAMS,
}
EMPTY = {"title": "The @", "purpose": "Nothing.", "source_paths": []} | {k: [] for k in dossiers.KINDS}
BARE = "substr(source, 4)::INTEGER % 3 = 0"


def table(spark, d):
    """component_key, root_component, document and a dossier's columns."""
    names = V.table(spark, d, "documents").select("source").distinct()
    body = F.when(F.substring("source", 4, 9).cast("int") % 3 == 0, json.dumps(EMPTY, ensure_ascii=False)).otherwise(json.dumps(FULL, ensure_ascii=False))
    rows = names.select("source", F.from_json(F.replace(body, F.lit("@"), F.col("source")), dossiers.DOSSIER).alias("d"))
    return rows.select(F.col("source").alias("component_key"), F.lit(False).alias("root_component"), F.concat(F.lit("docs/components/"), "source", F.lit("/index.md")).alias("document"), "d.*")


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# what the full dossier has to read like, links going up by {up}
_ARCH = "### Core\n\nKeeps @.\n\nSource: [`x/@.go`]({up}x/@.go)\n\n### Edge\n\nCalls it.\n\nSource: [`y z.go`]({up}y%20z.go)\n"
_FACE = "| Name | Kind | Direction | Description | Sources |\n| --- | --- | --- | --- | --- |\n| get\\|@ | rpc | inbound | Reads. | [`x/@.go`]({up}x/@.go)<br>[`y z.go`]({up}y%20z.go) |\n"
_CLASS = '**Types**\n\n```mermaid\nclassDiagram\n    class c0["@"]\n    c0 : id\n    class c1["L"]\n    c0 *-- c1 : has\n    c1 ..> c0\n```\n'
_DATA = "### Row (entity)\n\nA row.\n\n| Field | Type | Description |\n| --- | --- | --- |\n| id | long | Key. |\n\n| Relationship | Kind | Description |\n| --- | --- | --- |\n| @ | references | Owner. |\n\nSource: [`x/@.go`]({up}x/@.go)\n\n" + _CLASS
_FLOW = '**Flow**\n\n```mermaid\nflowchart TD\n    n0["@ #quot;1#quot;"]\n    n1["B"]\n    n0 -->|"uses"| n1\n    n1 --> n0\n```\n'
_TALK = "**Talk**\n\n```mermaid\nsequenceDiagram\n    participant p0 as User\n    participant p1 as @\n    p0->>p1: ask\n    p1-->>p0: tell\n```\n"
_WORK = "### Load\n\nLoads.\n\n1. **User** — asks → @\n2. **@** — answers\n\nSource: [`x/@.go`]({up}x/@.go)\n\n" + _FLOW + "\n" + _TALK
_DEPS = "| Name | Kind | Purpose | Component | Sources |\n| --- | --- | --- | --- | --- |\n| db | tool | Stores. |  | [`x/@.go`]({up}x/@.go) |\n| lib | internal\\_component | Helps. | `@` | [`x/@.go`]({up}x/@.go) |\n"
_BODIES = {"architecture": (_ARCH, "_No architecture documented for this component._\n"), "interfaces": (_FACE, "_No interfaces documented for this component._\n"), "data_models": (_DATA, "_No data models documented for this component._\n"), "workflows": (_WORK, "_No workflows documented for this component._\n"), "dependencies": (_DEPS, "_No dependencies documented for this component._\n")}
_SOURCES = "sources AS (SELECT DISTINCT source FROM documents)"


def _either(full: str, empty: str) -> str:
    return f"replace(CASE WHEN {BARE} THEN {_sql(empty)} ELSE {_sql(full)} END, '@', source)"


def _section(topic: str) -> str:
    full, empty = _BODIES[topic]
    return _either("## `@`\n\n" + full.replace("{up}", "../"), "## `@`\n\n" + empty)


@query("section_bodies", f"WITH {_SOURCES} " + " UNION ALL ".join(f"SELECT source AS component_key, '{t}' AS topic, {_section(t)} AS content FROM sources" for t in _BODIES))
def _(spark, d):
    out = None
    for topic in _BODIES:
        one = documents.sections(table(spark, d), "docs", topic).select("component_key", F.lit(topic).alias("topic"), "content")
        out = one if out is None else out.unionByName(one)
    return out


def _owned(topic: str, content: str) -> str:
    return f"""'<!-- tallyloom:begin topic="{topic}" key="' || source || '" -->' || chr(10) || rtrim({content}, chr(10)) || chr(10) || '<!-- tallyloom:end topic="{topic}" key="' || source || '" -->' || chr(10)"""


def _document(path: str, head: str, topic: str, content: str, first: str = "''") -> str:
    return f"SELECT '{path}' AS path, {_sql(head)} || chr(10) || chr(10) || {first} || string_agg({_owned(topic, content)}, chr(10) ORDER BY source) AS content FROM sources"


@query("topic_documents", f"WITH {_SOURCES} " + " UNION ALL ".join(_document(f"docs/{f}", f"# {t}\n\n{t} owned by each component. Sections are managed by tallyloom.", k, _section(k)) for k, f, t in documents.TOPICS))
def _(spark, d):
    return documents.topic_documents(table(spark, d), "docs")


_OVERVIEW = _either("## [`@`](components/@/index.md)\n\n**The @**\n\nDoes \\*@\\*.\n\n**Responsibilities:**\n\n- Core\n- Edge\n", "## [`@`](components/@/index.md)\n\n**The @**\n\nNothing.\n\n**Responsibilities:**\n\n_None documented._\n")


@query("components_overview", f"WITH {_SOURCES} " + _document("docs/components.md", "# Components\n\nEvery discovered component, its purpose, and its primary responsibilities.", "components", _OVERVIEW))
def _(spark, d):
    return documents.components_overview(table(spark, d), "docs")


_GAPS = _either("## `@`\n\n- **uncertainty** — Unclear.\n  - Recommendation: Ask.\n  - Source: [`x/@.go`](../x/@.go)\n", "## `@`\n\n_No review gaps reported._\n")
_NOTES = "'<!-- tallyloom:begin topic=\"scanner\" key=\"scanner\" -->' || chr(10) || '## Scanner Notes' || chr(10) || chr(10) || '- 2 component(s) were omitted from the codebase hierarchy diagram because of the node limit.' || chr(10) || (SELECT string_agg('- Excluded `' || path || '` (' || reason || ').', chr(10) ORDER BY path) FROM scan WHERE NOT included AND reason IN ('file_size_limit', 'binary_content')) || chr(10) || '<!-- tallyloom:end topic=\"scanner\" key=\"scanner\" -->' || chr(10) || chr(10)"


@query("review_notes", f"{_SCAN}, {_SOURCES} " + _document("docs/review_notes.md", "# Review Notes\n\nDeterministic scanner notes followed by model-reported review gaps per component.", "review_gaps", _GAPS, _NOTES))
def _(spark, d):
    return documents.review_notes(table(spark, d), classify.scan(V.tracked(spark, d), POLICY), "docs", 2)


_UP = "../../../"
_PAGE = "# The @\n\nComponent `@`.\n\n## Purpose\n\nDoes \\*@\\*.\n\n## Source Paths\n\n" + f"- [`x/@.go`]({_UP}x/@.go)\n- [`y z.go`]({_UP}y%20z.go)\n\n" + "\n".join(f"## {t}\n\n{_BODIES[k][0].replace('{up}', _UP)}" for k, _, t in documents.TOPICS) + "\n## Review Gaps\n\n- **uncertainty** — Unclear.\n  - Recommendation: Ask.\n"
_BARE_PAGE = "# The @\n\nComponent `@`.\n\n## Purpose\n\nNothing.\n\n" + "\n".join(f"## {t}\n\n{_BODIES[k][1]}" for k, _, t in documents.TOPICS) + "\n## Review Gaps\n\n_No review gaps reported._\n"


@query("component_pages", f"WITH {_SOURCES} SELECT 'docs/components/' || source || '/index.md' AS path, {_either(_PAGE, _BARE_PAGE)} AS content FROM sources")
def _(spark, d):
    return documents.component_pages(table(spark, d))


@query("diagram_texts", f"WITH {_SOURCES}, t AS (SELECT * FROM (VALUES ('flowchart', {_sql(_FLOW)}), ('sequence', {_sql(_TALK)}), ('class', {_sql(_CLASS)})) v(type, block)) SELECT source AS component_key, type, replace(rtrim(regexp_replace(block, '^[^\\n]*\\n\\n', ''), chr(10)), '@', source) AS content FROM sources, t WHERE NOT ({BARE})")
def _(spark, d):
    return table(spark, d).select("component_key", F.explode("diagrams").alias("x")).select("component_key", "x.type", documents.diagram_block(F.col("x")).alias("content"))


# --- the contract

_ITEM = {"title": "T", "description": "D.", "source_paths": ["src0"]}
_FRAGMENT = lambda *items, **more: json.dumps({"complete": True, "items": list(items), **more})
# architecture fragments, and what is wrong with each: (code, path) in order
CASES = [
    (_FRAGMENT(_ITEM), []),
    (_FRAGMENT(), []),
    (_FRAGMENT(_ITEM, _ITEM, _ITEM), [("too_many_items", "/items")]),
    (_FRAGMENT(_ITEM | {"description": "# no", "source_paths": ["src0", "src0", "gone"]}), [("unsafe_prose", "/items/0/description"), ("too_many_items", "/items/0/source_paths"), ("duplicate_key", "/items/0/source_paths/1"), ("unknown_evidence_path", "/items/0/source_paths/2")]),
    (_FRAGMENT(_ITEM | {"title": "", "source_paths": []}), [("empty_value", "/items/0/title"), ("empty_value", "/items/0/source_paths")]),
    (_FRAGMENT(_ITEM | {"title": "t" * 101}, omitted_count=2), [("invalid_value", "/omitted_count"), ("string_too_long", "/items/0/title")]),
    (_FRAGMENT({"title": "T", "source_paths": None}, None), [("missing_field", "/items/0/description"), ("invalid_type", "/items/0/source_paths"), ("invalid_type", "/items/1")]),
    ('{"items":[]}', [("missing_field", "/complete")]),
    (_FRAGMENT(_ITEM, extra=1), [("unknown_field", "")]),
    (_FRAGMENT(_ITEM | {"title": 1}), [("invalid_type", "")]),
    (_FRAGMENT(_ITEM) + " {}", [("trailing_data", "")]),
    ("{", [("invalid_json", "")]),
    (_FRAGMENT(_ITEM | {"description": "x" * 9000}), [("response_too_large", "")]),
]


def _bodies(spark, d, cases):
    n = F.col("doc_id") % len(cases)
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.element_at(F.array(*[F.lit(b) for b, _ in cases]), (n + 1).cast("int")).alias("body"))


def _wanted(cases) -> str:
    rows = ", ".join(f"({i}, {k}, '{code}', '{path}')" for i, (_, found) in enumerate(cases) for k, (code, path) in enumerate(found))
    return f"SELECT doc_id AS key, v.place::INTEGER AS place, v.code, v.path FROM documents JOIN (VALUES {rows}) v(i, place, code, path) ON doc_id % {len(cases)} = v.i"


def _checked(spark, d, kind, cases):
    bodies = _bodies(spark, d, cases)
    evidence = bodies.select("key", F.lit("src0").alias("path"))
    catalog = V.table(spark, d, "documents").select(F.col("source").alias("component_key"))
    return dossiers.validated(bodies, "key", kind, evidence, catalog, keep=stored)


@query("fragment_issues", _wanted(CASES))
def _(spark, d):
    return _checked(spark, d, "architecture", CASES)[0]


@query("fragment_issue_codes", f"SELECT key, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ({_wanted(CASES)}) GROUP BY 1")
def _(spark, d):
    return dossiers.issue_codes(_checked(spark, d, "architecture", CASES)[0], "key").withColumn("codes", F.array_join("codes", ","))


@query("fragment_evidence_used", f"SELECT doc_id AS key, 'src0' AS path FROM documents WHERE doc_id % {len(CASES)} IN (0, 2, 3, 5)")
def _(spark, d):
    return _checked(spark, d, "architecture", CASES)[1]


_DEP = {"name": "n", "kind": "internal_component", "purpose": "p", "component_key": "src1", "source_paths": ["src0"]}
_MODEL = FULL["data_models"][0] | {"source_paths": ["src0"]}
_FLOWCHART = _DIAGRAMS[0] | {"source_paths": ["src0"]}
DOSSIERS = [
    (json.dumps(EMPTY), []),
    (json.dumps(EMPTY | {"dependencies": [_DEP, _DEP | {"component_key": ""}, _DEP | {"component_key": "nowhere"}, _DEP | {"kind": "odd"}]}), [("missing_component_key", "/dependencies/1/component_key"), ("unknown_component_key", "/dependencies/2/component_key"), ("invalid_enum", "/dependencies/3/kind")]),
    (json.dumps(EMPTY | {"data_models": [_MODEL | {"fields": [{"name": "", "type": "t", "description": "see http://x"}]}]}), [("empty_value", "/data_models/0/fields/0/name"), ("unsafe_prose", "/data_models/0/fields/0/description")]),
    (json.dumps(EMPTY | {"diagrams": [_FLOWCHART | {"edges": [{"from": "a", "to": "z", "label": ""}]}, {"type": "pie", "title": "t", "source_paths": ["src0"]}]}), [("invalid_diagram_reference", "/diagrams/0/edges/0/to"), ("invalid_diagram_type", "/diagrams/1/type")]),
    (json.dumps(EMPTY | {"diagrams": [_FLOWCHART | {"classes": []}]}), [("diagram_field_not_allowed", "/diagrams/0/classes")]),
    (json.dumps({k: v for k, v in EMPTY.items() if k != "title"} | {"workflows": None}), [("missing_field", "/title"), ("invalid_type", "/workflows")]),
    (json.dumps(EMPTY | {"source_paths": ["gone"], "purpose": ""}), [("empty_value", "/purpose"), ("unknown_evidence_path", "/source_paths/0")]),
]


@query("dossier_issues", _wanted(DOSSIERS))
def _(spark, d):
    return _checked(spark, d, "dossier", DOSSIERS)[0]


_OVERVIEWS = [(json.dumps({"title": "T", "purpose": "P"}), []), (json.dumps({"title": "T"}), [("missing_field", "/purpose")]), (json.dumps({"title": "a](b", "purpose": "p" * 401}), [("unsafe_prose", "/title"), ("string_too_long", "/purpose")]), (json.dumps({"title": "T", "purpose": "P", "source_paths": []}), [("unknown_field", "")])]


@query("overview_issues", _wanted(_OVERVIEWS))
def _(spark, d):
    return _checked(spark, d, "overview", _OVERVIEWS)[0]


@query("sealed_fragments", f"SELECT doc_id AS key, CASE WHEN doc_id % 2 = 1 THEN 'seal_mismatch' END AS code FROM documents WHERE doc_id % {len(CASES)} < 2")
def _(spark, d):
    bodies = _bodies(spark, d, CASES)
    evidence, catalog = bodies.select("key", F.lit("src0").alias("path")), spark.createDataFrame([("src0",)], "component_key string")
    kept = stored(dossiers.sealed(bodies, dossiers.validated(bodies, "key", "architecture", evidence, catalog, keep=stored)[0], "key"))
    changed = kept.withColumn("body", F.when(F.col("key") % 2 == 1, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return dossiers.trusted(changed, "key", "architecture", evidence, catalog, stored).select("key", "code")


@query("bound_scopes", "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'unknown_scope' WHEN 2 THEN 'invalid_value' END AS code FROM documents")
def _(spark, d):
    docs, n = V.table(spark, d, "documents"), F.col("doc_id") % 3
    scope = [F.col("doc_id").cast("string").alias("component_key"), F.lit(False).alias("root_component"), F.lit("architecture").alias("kind"), *[F.lit(1).alias(c) for c in ("batch", "batch_count", "chunk", "chunk_count")]]
    planned = docs.select(*scope, F.lit("b1").alias("split_path"), F.array(F.lit("b"), F.lit("a"), F.lit("a")).alias("evidence"))
    results = docs.select("doc_id", *scope, F.when(n == 1, "b2").otherwise("b1").alias("split_path"), F.when(n == 2, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("evidence"))
    return dossiers.bound(results, planned).select("doc_id", "code")


@query("first_names", "WITH r AS (SELECT source, lang || doc_id AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, count(*) AS count, string_agg(name, ',' ORDER BY n) FILTER (WHERE n <= 8) AS names FROM r GROUP BY 1")
def _(spark, d):
    items = V.table(spark, d, "documents").select("source", F.concat("lang", F.col("doc_id").cast("string")).alias("name"), "doc_id")
    return dossiers.first_names(items, ["source"], "name", "doc_id").withColumn("names", F.array_join("names", ","))


@query("diagram_normalised", "SELECT component_key, type, nodes, messages FROM (SELECT DISTINCT source AS component_key FROM documents), (VALUES ('flowchart', 2, NULL), ('sequence', NULL, 2), ('class', NULL, NULL)) v(type, nodes, messages) WHERE substr(component_key, 4)::INTEGER % 3 <> 0")
def _(spark, d):
    each = table(spark, d).select("component_key", F.explode("diagrams").alias("x")).select("component_key", dossiers.normalised_diagram(F.col("x")).alias("x"))
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return each.select("component_key", "x.type", size("x.nodes").alias("nodes"), size("x.messages").alias("messages"))
