"""The contract of a model's answer: a whole dossier, or a fragment of one, decoded strictly and checked rule by rule.

The contract is data (SPEC); one generator turns it into column expressions. A body goes through three stages, each for
those that the one before let through: strict decoding (one issue), shape (missing fields, no arrays), and content. For
content every value becomes a row, a leaf, so that the allowed evidence and the catalogue of components are joined by
equality and no list of them is held in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_problem, prose_problem
from .validation import MOST_FRAGMENT_BYTES, MOST_ISSUES

# The members that enumerated fields may have.
ENUMS = {
    "interface_kind": ["http_api", "rpc", "function", "method", "interface", "event", "command", "schema", "configuration", "other"],
    "interface_direction": ["inbound", "outbound", "internal"],
    "data_model_kind": ["entity", "value_object", "request", "response", "event", "schema", "table", "configuration", "other"],
    "data_relationship_kind": ["contains", "references", "inherits", "implements", "reads", "writes", "other"],
    "dependency_kind": ["internal_component", "external_service", "library", "tool", "protocol", "other"],
    "review_gap_kind": ["uncertainty", "missing_context", "inconsistency", "unsupported_construct", "excluded_input", "other"],
    "class_relation_kind": ["association", "aggregation", "composition", "inheritance", "realization", "dependency"],
}
# The bounds of a whole dossier and of a fragment.
DOSSIER_LIMITS = {
    "items": 100, "diagrams": 10, "source_paths": 200, "fields": 200, "relationships": 100, "steps": 200,
    "title": 200, "name": 200, "type": 200, "short_text": 2000, "long_text": 4000, "path": 512,
    "diagram_key": 64, "diagram_label": 200, "nodes": 60, "edges": 120, "participants": 40, "messages": 120,
    "classes": 40, "members": 60, "class_relationships": 120,
}
FRAGMENT_LIMITS = {
    "source_paths": 2, "fields": 3, "relationships": 2, "steps": 5,
    "title": 100, "name": 100, "type": 100, "short_text": 200, "long_text": 400, "path": 512,
    "diagram_key": 32, "diagram_label": 80, "nodes": 6, "edges": 8, "participants": 5, "messages": 8,
    "classes": 4, "members": 3, "class_relationships": 5,
}
FRAGMENT_ITEMS = {"architecture": 2, "interfaces": 2, "data_models": 1, "workflows": 1, "dependencies": 2, "review_gaps": 2, "diagrams": 1}
MOST_OMITTED = 10_000

# A field: name, rule, the limit's or the enumeration's name (a list's fields), and whether it must be there.
SPEC = {
    "architecture": [("title", "prose", "title", True), ("description", "prose", "long_text", True), ("source_paths", "evidence", None, True)],
    "interfaces": [("name", "prose", "name", True), ("kind", "enum", "interface_kind", True), ("direction", "enum", "interface_direction", True), ("description", "prose", "long_text", True), ("source_paths", "evidence", None, True)],
    "data_models": [
        ("name", "prose", "name", True), ("kind", "enum", "data_model_kind", True), ("description", "prose", "long_text", True),
        ("fields", "list", [("name", "prose", "name", True), ("type", "prose", "type", True), ("description", "prose", "short_text", True)], True),
        ("relationships", "list", [("target", "prose", "name", True), ("kind", "enum", "data_relationship_kind", True), ("description", "prose", "short_text", True)], True),
        ("source_paths", "evidence", None, True),
    ],
    "workflows": [("name", "prose", "name", True), ("description", "prose", "long_text", True), ("steps", "list", [("actor", "prose", "name", True), ("action", "prose", "short_text", True), ("target", "prose", "name", False)], True), ("source_paths", "evidence", None, True)],
    "dependencies": [("name", "prose", "name", True), ("kind", "enum", "dependency_kind", True), ("purpose", "prose", "short_text", True), ("component_key", "dependency", None, False), ("source_paths", "evidence", None, True)],
    "review_gaps": [("kind", "enum", "review_gap_kind", True), ("description", "prose", "long_text", True), ("recommendation", "prose", "short_text", True), ("source_paths", "evidence", None, False)],
}
OVERVIEW = [("title", "prose", "title", True), ("purpose", "prose", "long_text", True)]
CANDIDATE = [*OVERVIEW, ("source_paths", "evidence", None, True)]
# A diagram's lists by its type: the nodes, then what refers to them.
DIAGRAMS = {
    "flowchart": [("nodes", [("key", "key", None, True), ("label", "label", None, True)]), ("edges", [("from", "ref", "nodes", True), ("to", "ref", "nodes", True), ("label", "label", None, False)])],
    "sequence": [("participants", [("key", "key", None, True), ("label", "label", None, True)]), ("messages", [("from", "ref", "participants", True), ("to", "ref", "participants", True), ("label", "label", None, True), ("response", "flag", None, True)])],
    "class": [("classes", [("key", "key", None, True), ("label", "label", None, True), ("members", "labels", None, True)]), ("relationships", [("from", "ref", "classes", True), ("to", "ref", "classes", True), ("kind", "enum", "class_relation_kind", True), ("label", "label", None, False)])],
}
KINDS = [*SPEC, "diagrams"]

_ISSUES = "array<struct<code:string,path:string>>"
_LEAVES = "array<struct<path:string,rule:string,value:string,most:int,required:boolean,flag:string>>"


def _ddl(fields: list) -> str:
    kind = {"evidence": "array<string>", "labels": "array<string>", "flag": "boolean"}
    return ", ".join(f"`{n}`: " + (f"array<struct<{_ddl(of)}>>" if rule == "list" else kind.get(rule, "string")) for n, rule, of, _ in fields)


def _diagram_ddl() -> str:
    lists = ", ".join(f"`{n}`: array<struct<{_ddl(f)}>>" for t in DIAGRAMS.values() for n, f in t)
    return f"`type`: string, `title`: string, `source_paths`: array<string>, {lists}"


def item_type(kind: str) -> str:
    return f"struct<{_diagram_ddl() if kind == 'diagrams' else _ddl(SPEC[kind])}>"


DOSSIER = f"title string, purpose string, source_paths array<string>, {', '.join(f'{k} array<{item_type(k)}>' for k in KINDS)}"


def body_type(kind: str) -> str:
    """The columns of a decoded body."""
    if kind == "dossier":
        return DOSSIER
    if kind in ("overview", "overview_candidate"):
        return "title string, purpose string" + (", source_paths array<string>" if kind == "overview_candidate" else "")
    return f"complete boolean, omitted_count bigint, items array<{item_type(kind)}>"


# --- strict decoding


def _keys(v: Column) -> Column:
    return F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))


def _get(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _is(v: Column, kind: str) -> Column:
    """Whether a JSON value is of the type, absent or null."""
    return F.coalesce(F.schema_of_variant(v).rlike(rf"\A(?:VOID|{kind})\z"), F.lit(True))


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _wrong(v: Column, fields: list) -> tuple[Column, Column]:
    """Whether an object has an unknown field, and whether it has a value of the wrong type, at any depth. Names match
    whatever their case, as a lenient decoder reads them."""
    names = F.array(*[F.lit(f[0]) for f in fields])
    unknown = [F.size(F.array_except(F.transform(_keys(v), F.lower), names)) > 0]
    wrong = [~_is(v, "OBJECT.*")]
    for name, rule, of, _ in fields:
        x = _get(v, name)
        if rule in ("evidence", "labels"):
            wrong += [~_is(x, "ARRAY.*"), F.exists(_get(v, name, "array<variant>"), lambda e: ~_is(e, "STRING"))]
        elif rule == "list":
            wrong.append(~_is(x, "ARRAY.*"))
            each = _get(v, name, "array<variant>")
            unknown.append(F.exists(each, _test(of, 0)))
            wrong.append(F.exists(each, _test(of, 1)))
        else:
            wrong.append(~_is(x, {"flag": "BOOLEAN", "count": "BIGINT"}.get(rule, "STRING")))
    return _any(unknown), _any(wrong)


def _test(fields: list, which: int):
    return lambda e: _wrong(e, fields)[which]


def _all_fields(kind: str) -> list:
    """Every field that a body of the kind may have."""
    diagram = [("type", "text", None, True), ("title", "text", None, True), ("source_paths", "evidence", None, True)]
    lists: dict[str, dict] = {}
    for t in DIAGRAMS.values():
        for name, fields in t:
            lists.setdefault(name, {}).update({f[0]: f for f in fields})
    diagram += [(n, "list", list(f.values()), False) for n, f in lists.items()]
    item = lambda k: diagram if k == "diagrams" else SPEC[k]
    if kind == "dossier":
        return [*CANDIDATE, *[(k, "list", item(k), True) for k in KINDS]]
    if kind in ("overview", "overview_candidate"):
        return OVERVIEW if kind == "overview" else CANDIDATE
    return [("complete", "flag", None, True), ("omitted_count", "count", None, False), ("items", "list", item(kind), True)]


def decode_issue(body: Column, kind: str, parsed: Column | None = None) -> Column:
    """The code of the one issue of strict decoding, or null: invalid_json, trailing_data, unknown_field, invalid_type.
    parsed: the body as a variant, where there is one already."""
    value = F.try_parse_json(body) if parsed is None else parsed
    listed = F.concat(F.lit("["), body, F.lit("]"))
    alone = F.coalesce(F.json_array_length(F.when(F.try_parse_json(listed).isNotNull(), listed)) == 1, F.lit(False))
    unknown, wrong = _wrong(value, _all_fields(kind))
    return F.when(body.isNull() | value.isNull(), "invalid_json").when(~alone, "trailing_data").when(unknown, "unknown_field").when(wrong, "invalid_type")


# --- shape


def _issue(when: Column, code: str, path: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), path.alias("path")))


def _some(parts: list[Column]) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull()).cast(_ISSUES)


def _array_issue(v: Column, name: str, base: Column) -> Column:
    return _issue(F.array_contains(_keys(v), name) & (F.schema_of_variant(_get(v, name)) == "VOID"), "invalid_type", F.concat(base, F.lit(f"/{name}")))


def _nested(v: Column, name: str, base: Column, make) -> Column:
    """The issues of each element of an array, in order; an element that is null is no object."""
    def one(x: Column, i: Column) -> Column:
        at = F.concat(base, F.lit(f"/{name}/"), i.cast("string"))
        return F.when(F.schema_of_variant(x) == "VOID", _some([_issue(F.lit(True), "invalid_type", at)])).otherwise(make(x, at))

    each = F.coalesce(_get(v, name, "array<variant>"), F.array().cast("array<variant>"))
    return F.flatten(F.transform(each, one))


def _shape(v: Column, fields: list, base: Column, required: list[str] | None = None) -> Column:
    """Missing fields, then, list by list, what isn't an array and what its elements lack."""
    names = [f[0] for f in fields] if required is None else required
    parts = [_some([_issue(~F.array_contains(_keys(v), n), "missing_field", F.concat(base, F.lit(f"/{n}"))) for n in names])]
    for name, rule, of, _ in fields:
        if rule in ("evidence", "labels", "list"):
            parts.append(_some([_array_issue(v, name, base)]))
        if rule == "list":
            parts.append(_nested(v, name, base, lambda x, at, of=of: _shape(x, of, at)))
    return F.concat(*parts)


def _diagram_shape(v: Column, base: Column) -> Column:
    head = _shape(v, [("type", "text", None, True), ("title", "text", None, True), ("source_paths", "evidence", None, True)], base)
    every = [n for t in DIAGRAMS.values() for n, _ in t]
    by_type = F.array().cast(_ISSUES)
    for kind, lists in DIAGRAMS.items():
        own = [n for n, _ in lists]
        parts = [_some([_issue(~F.array_contains(_keys(v), n), "missing_field", F.concat(base, F.lit(f"/{n}"))) for n in own])]
        parts.append(_some([_issue(F.array_contains(_keys(v), n), "diagram_field_not_allowed", F.concat(base, F.lit(f"/{n}"))) for n in dict.fromkeys(every) if n not in own]))
        for name, fields in lists:
            parts += [_some([_array_issue(v, name, base)]), _nested(v, name, base, lambda x, at, f=fields: _shape(x, f, at))]
        by_type = F.when(_get(v, "type", "string") == kind, F.concat(*parts)).otherwise(by_type)
    return F.concat(head, by_type)


def shape_issues(body: Column, kind: str, parsed: Column | None = None) -> Column:
    """An array of (code, path): what a decoded body lacks. parsed: see decode_issue()."""
    v, top = F.try_parse_json(body) if parsed is None else parsed, F.lit("")
    item = lambda k: (lambda x, at: _diagram_shape(x, at)) if k == "diagrams" else (lambda x, at: _shape(x, SPEC[k], at))
    no_object = F.schema_of_variant(v) == "VOID"
    if kind in ("overview", "overview_candidate"):
        out = _shape(v, _all_fields(kind), top)
    elif kind == "dossier":
        parts = [_some([_issue(~F.array_contains(_keys(v), f[0]), "missing_field", F.lit(f"/{f[0]}")) for f in _all_fields(kind)]), _some([_array_issue(v, "source_paths", top)])]
        for k in KINDS:
            parts += [_some([_array_issue(v, k, top)]), _nested(v, k, top, item(k))]
        out = F.concat(*parts)
    else:
        null = lambda n: _issue(F.array_contains(_keys(v), n) & (F.schema_of_variant(_get(v, n)) == "VOID"), "invalid_type", F.lit(f"/{n}"))
        missing = [_issue(~F.array_contains(_keys(v), n), "missing_field", F.lit(f"/{n}")) for n in ("complete", "items")]
        out = F.concat(_some([*missing, null("complete"), null("omitted_count"), null("items")]), _nested(v, "items", top, item(kind)))
    return F.when(no_object, _some([_issue(F.lit(True), "invalid_type", top)])).otherwise(out)


# --- content


def _leaf(path: Column, rule: str, value: Column, most: int = 0, required: bool = False, flag: Column | None = None) -> Column:
    flag = F.lit(None).cast("string") if flag is None else flag
    return F.struct(path.alias("path"), F.lit(rule).alias("rule"), value.cast("string").alias("value"), F.lit(most).alias("most"), F.lit(required).alias("required"), flag.cast("string").alias("flag"))


def _count(path: Column, items: Column, most: int) -> Column:
    return _leaf(path, "count", F.lit(""), flag=F.when(F.size(items) > most, "too_many_items"))


def _one(leaf: Column) -> Column:
    return F.array(leaf).cast(_LEAVES)


def _evidence(path: Column, paths: Column, limits: dict, required: bool) -> list[Column]:
    none = F.lit(required) & (F.size(paths) == 0)
    count = _leaf(path, "count", F.lit(""), flag=F.when(none, "empty_value").when(F.size(paths) > limits["source_paths"], "too_many_items"))
    each = F.transform(paths, lambda p, i: _leaf(F.concat(path, F.lit("/"), i.cast("string")), "evidence", p, limits["path"], flag=F.when(F.array_position(paths, p) != i + 1, "duplicate_key")))
    return [_one(count), each.cast(_LEAVES)]


def _leaves(item: Column, fields: list, base: Column, limits: dict, known: dict[str, Column] | None = None) -> list[Column]:
    out: list[Column] = []
    for name, rule, of, required in fields:
        at, value = F.concat(base, F.lit(f"/{name}")), item[name]
        if rule == "prose":
            out.append(_one(_leaf(at, "prose", value, limits[of], required)))
        elif rule == "label":
            out.append(_one(_leaf(at, "label", value, limits["diagram_label"], required)))
        elif rule == "enum":
            out.append(_one(_leaf(at, "count", value, flag=F.when(F.coalesce(value, F.lit("")) == "", "empty_value").when(~value.isin(ENUMS[of]), "invalid_enum"))))
        elif rule == "evidence":
            out += _evidence(at, value, limits, required)
        elif rule == "dependency":
            out.append(_one(_leaf(at, "dependency", value, limits["path"], flag=F.when(item["kind"] == "internal_component", "internal"))))
        elif rule == "list":
            out += [_one(_count(at, value, limits[name])), _each(value, at, of, limits)]
        elif rule == "labels":
            out += [_one(_count(at, value, limits["members"])), _labels(value, at, limits)]
        elif rule == "ref":
            out.append(_one(_leaf(at, "count", value, flag=F.when(F.trim(F.coalesce(value, F.lit(""))) == "", "empty_value").when(~F.array_contains(known[of], value), "invalid_diagram_reference"))))
    return out


def _labels(values: Column, base: Column, limits: dict) -> Column:
    return F.transform(values, lambda x, i: _leaf(F.concat(base, F.lit("/"), i.cast("string")), "label", x, limits["diagram_label"], True)).cast(_LEAVES)


def _each(items: Column, base: Column, fields: list, limits: dict) -> Column:
    return F.flatten(F.transform(items, lambda x, i: F.flatten(F.array(*_leaves(x, fields, F.concat(base, F.lit("/"), i.cast("string")), limits)))))


def _diagram_part(name: str, fields: list, base: Column, nodes: Column, keys: Column, limits: dict):
    """The leaves of one element of a diagram's list. A key that stood before is a duplicate; references name `keys`."""

    def of(x: Column, i: Column) -> Column:
        at, out = F.concat(base, F.lit(f"/{name}/"), i.cast("string")), []
        if fields[0][1] == "key":
            every = F.transform(nodes, lambda n: n["key"])
            out.append(_one(_leaf(F.concat(at, F.lit("/key")), "key", x["key"], limits["diagram_key"], True, F.when(F.array_position(every, x["key"]) != i + 1, "duplicate_key"))))
        return F.flatten(F.array(*out, *_leaves(x, fields, at, limits, {f[2]: keys for f in fields if f[1] == "ref"})))

    return of


def _diagram_leaves(d: Column, base: Column, limits: dict) -> Column:
    head = [_one(_leaf(F.concat(base, F.lit("/title")), "prose", d["title"], limits["title"], True)), *_evidence(F.concat(base, F.lit("/source_paths")), d["source_paths"], limits, True)]
    by_type = _one(_leaf(F.concat(base, F.lit("/type")), "count", F.lit(""), flag=F.lit("invalid_diagram_type")))
    for kind, lists in DIAGRAMS.items():
        nodes = F.coalesce(d[lists[0][0]], F.array())
        keys = F.filter(F.transform(nodes, lambda n: n["key"]), lambda k: F.trim(k) != "")
        parts = [_one(_count(F.concat(base, F.lit(f"/{name}")), d[name], limits["class_relationships" if name == "relationships" else name])) for name, _ in lists]
        parts += [F.flatten(F.transform(F.coalesce(d[name], F.array()), _diagram_part(name, fields, base, nodes, keys, limits))) for name, fields in lists]
        by_type = F.when(d["type"] == kind, F.flatten(F.array(*parts))).otherwise(by_type)
    return F.concat(F.flatten(F.array(*head)), by_type)


def leaves(body: Column, kind: str) -> Column:
    """Every value of a body that a rule of content is about, in the rules' order."""
    b = F.from_json(body, body_type(kind))
    top, none = F.lit(""), F.array().cast(_LEAVES)
    items = lambda of, at, k, limits: F.coalesce(F.flatten(F.transform(of, lambda x, i: (_diagram_leaves(x, F.concat(F.lit(at + "/"), i.cast("string")), limits) if k == "diagrams" else F.flatten(F.array(*_leaves(x, SPEC[k], F.concat(F.lit(at + "/"), i.cast("string")), limits)))))), none)
    if kind in ("overview", "overview_candidate"):
        return F.flatten(F.array(*_leaves(b, _all_fields(kind), top, FRAGMENT_LIMITS)))
    if kind == "dossier":
        head = [*_leaves(b, OVERVIEW, top, DOSSIER_LIMITS), *_evidence(F.lit("/source_paths"), b["source_paths"], DOSSIER_LIMITS, False)]
        for k in KINDS:
            head += [_one(_count(F.lit(f"/{k}"), b[k], DOSSIER_LIMITS["diagrams" if k == "diagrams" else "items"])), items(b[k], f"/{k}", k, DOSSIER_LIMITS)]
        return F.flatten(F.array(*head))
    omitted = b["omitted_count"]
    flags = [F.when((omitted < 0) | (omitted > MOST_OMITTED), "invalid_value"), F.when(b["complete"] & (omitted > 0), "invalid_value")]
    head = [_one(_leaf(F.lit("/omitted_count"), "count", F.lit(""), flag=f)) for f in flags]
    return F.flatten(F.array(*head, _one(_count(F.lit("/items"), b["items"], FRAGMENT_ITEMS[kind])), items(b["items"], "/items", kind, FRAGMENT_LIMITS)))


def _codes(known_path: Column, known_key: Column) -> Column:
    """The codes of a leaf, in order."""
    value, rule, flag = F.coalesce("value", F.lit("")), F.col("rule"), F.col("flag")
    bare = F.trim(value, F.lit(" \t\r\n\x0b\x0c"))
    empty, long_ = bare == "", F.octet_length(value) > F.col("most")
    text = lambda problem: [F.when(empty & F.col("required"), "empty_value"), F.when(~empty & long_, "string_too_long"), F.when(~empty & problem.isNotNull(), "unsafe_prose")]
    named = ~empty & (value == bare)
    by_rule = {
        "count": [flag],
        "prose": text(prose_problem(value)),
        "label": text(label_problem(value)),
        "evidence": [F.when(empty, "empty_value"), F.when(~empty & long_, "string_too_long"), F.when(~empty, flag), F.when(~empty & ~known_path, "unknown_evidence_path")],
        "key": [F.when(empty, "empty_value"), F.when(~empty & long_, "string_too_long"), F.when(~empty, flag)],
        "dependency": [F.when(empty & (flag == "internal"), "missing_component_key"), F.when(~empty & (value != bare), "invalid_value"), F.when(named & long_, "string_too_long"), F.when(named & ~known_key, "unknown_component_key")],
    }
    out = F.array().cast("array<string>")
    for name, codes in by_rule.items():
        out = F.when(rule == name, F.array(*codes)).otherwise(out)
    return F.filter(out, lambda c: c.isNotNull())


def content_rows(bodies: DataFrame, key: str, kind: str, evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """key, n, path, rule, value, codes: every leaf of bodies that are decoded and shaped, with what is wrong with it.
    evidence: key, path (what a body may cite); catalog: component_key."""
    rows = bodies.select(key, F.posexplode(leaves(F.col("body"), kind)).alias("n", "x")).select(key, "n", "x.*")
    may = evidence.select(key, F.col("path").alias("value"), F.lit("evidence").alias("rule"), F.lit(True).alias("may_cite")).distinct()
    named = catalog.select(F.col("component_key").alias("value"), F.lit("dependency").alias("rule"), F.lit(True).alias("is_known")).distinct()
    rows = rows.join(may, [key, "value", "rule"], "left").join(named, ["value", "rule"], "left")
    return rows.select(key, "n", "path", "rule", "value", _codes(F.coalesce("may_cite", F.lit(False)), F.coalesce("is_known", F.lit(False))).alias("codes"))


def validated(bodies: DataFrame, key: str, kind: str, evidence: DataFrame, catalog: DataFrame, most_issues: int = MOST_ISSUES, keep=lambda df: df) -> tuple[DataFrame, DataFrame]:
    """Issues (key, place, code, path) of bodies (key, body), the first `most_issues` of each, and the evidence that each
    cites rightly (key, path). Fragments above their bytes are response_too_large and not read. `keep` may write the
    checked values once for both."""
    small = F.octet_length("body") <= MOST_FRAGMENT_BYTES if kind != "dossier" else F.lit(True)
    code = F.when(~F.coalesce(small, F.lit(True)), "response_too_large").otherwise(decode_issue(F.col("body"), kind, F.col("v_")))
    early = bodies.select(key, "body", F.try_parse_json("body").alias("v_")).select(key, "body", "v_", code.alias("code"))  # parsed once
    shaped = keep(early.select(key, "body", "code", F.when(F.col("code").isNull(), shape_issues(F.col("body"), kind, F.col("v_"))).alias("i")))
    early, shaped = shaped.where("code is not null").select(key, "code"), shaped.where("code is null").select(key, "body", "i")
    rows = keep(content_rows(shaped.where("size(i) = 0"), key, kind, evidence, catalog))
    issue = lambda df: df.select(key, "place", "code", "path")
    out = issue(early.withColumns({"place": F.lit(0), "path": F.lit("")}))
    out = out.unionByName(issue(shaped.select(key, F.posexplode("i").alias("place", "i")).select(key, "place", "i.*")))
    content = rows.select(key, "n", "path", F.posexplode("codes").alias("m", "code"))
    content = content.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("n", "m")) - 1)
    out = out.unionByName(issue(content)).where(F.col("place") < most_issues)
    used = rows.where("rule = 'evidence' and trim(value) <> '' and not array_contains(codes, 'unknown_evidence_path')").select(key, F.col("value").alias("path")).distinct()
    return out, used


def issue_codes(issues: DataFrame, key: str) -> DataFrame:
    """key, codes: the distinct codes of a body in order."""
    return issues.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def sealed(bodies: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """key, body, seal: the bodies without an issue, with a hash of the body as it was checked."""
    return bodies.join(issues.select(key).distinct(), key, "left_anti").select(key, "body", F.sha2("body", 256).alias("seal"))


def trusted(sealed_rows: DataFrame, key: str, kind: str, evidence: DataFrame, catalog: DataFrame, keep=lambda df: df) -> DataFrame:
    """key, body, code: sealed bodies checked again when they are used: seal_mismatch for one that is another by now or
    has an issue, else null."""
    issues, _ = validated(sealed_rows, key, kind, evidence, catalog, keep=keep)
    bad = issues.select(key, F.lit(True).alias("bad")).distinct()
    code = F.when(F.col("bad") | (F.sha2("body", 256) != F.col("seal")), "seal_mismatch")
    return sealed_rows.join(bad, key, "left").select(key, "body", code.alias("code"))


SCOPE = ["component_key", "root_component", "kind", "batch", "batch_count", "chunk", "chunk_count", "split_path"]


def bound(results: DataFrame, scopes: DataFrame) -> DataFrame:
    """All columns of `results` with code: a result counts for the scope that asked for it alone, with the evidence
    (an array) that was planned; unknown_scope or invalid_value where it doesn't, else null."""
    planned = scopes.select(*SCOPE, F.array_sort(F.array_distinct("evidence")).alias("planned_"))
    same = F.col("planned_") == F.array_sort(F.array_distinct("evidence"))
    return results.join(planned, SCOPE, "left").withColumn("code", F.when(F.col("planned_").isNull(), "unknown_scope").when(~same, "invalid_value")).drop("planned_")


def allowed_evidence(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path: the distinct paths that a request may cite: triggering, supporting and manifest files alike."""
    return files.select(*keys, "path").distinct()


def first_names(items: DataFrame, key: list[str], name: str, order: str = "n", most: int = 8) -> DataFrame:
    """key, count, names: how many items there are, and the names of the first `most` in order."""
    ranked = items.withColumn("nth_", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    picked = F.array_sort(F.collect_list(F.when(F.col("nth_") <= most, F.struct("nth_", F.col(name).alias("name")))))
    return ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("count"), F.transform(picked, lambda x: x["name"]).alias("names"))


def normalised_diagram(d: Column) -> Column:
    """A diagram whose own lists are there, empty if need be, and whose other lists are null."""
    own = {n: k for k, lists in DIAGRAMS.items() for n, _ in lists}
    parts = [d["type"].alias("type"), d["title"].alias("title"), d["source_paths"].alias("source_paths")]
    parts += [F.when(d["type"] == k, F.coalesce(d[n], F.array())).alias(n) for n, k in own.items()]
    return F.struct(*parts)
