"""The generated documents: what dossiers and the scan say, as Markdown. A component's text is one expression over its
dossier; documents over all components are its owned sections in display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_cell, escape_diagram, escape_inline, source_link, tidy
from .rendering import owned_section, sources_line

# The topics that components own a section of, with document and title, in order.
TOPICS = [("architecture", "architecture.md", "Architecture"), ("interfaces", "interfaces.md", "Interfaces"), ("data_models", "data_models.md", "Data Models"), ("workflows", "workflows.md", "Workflows"), ("dependencies", "dependencies.md", "Dependencies")]
# How a class diagram draws each kind of relation.
CONNECTORS = {"association": "-->", "aggregation": "o--", "composition": "*--", "inheritance": "--|>", "realization": "..|>", "dependency": "..>"}


def _lines(*parts: Column | str) -> Column:
    """Parts as lines, null ones left out."""
    return F.array_join(F.filter(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), lambda x: x.isNotNull()), "\n")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _joined(items: Column, make, separator: str = "\n") -> Column:
    return F.array_join(F.transform(items, make), separator)


def _row(*cells: Column) -> Column:
    return _text("| ", F.concat_ws(" | ", *cells), " |")


def _cell_sources(paths: Column, document: Column) -> Column:
    return F.array_join(F.transform(paths, lambda p: source_link(p, document)), "<br>")


# --- diagrams


def _position(keys: Column, prefix: str, key: Column) -> Column:
    return _text(prefix, (F.array_position(keys, key) - 1).cast("string"))


def _blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def diagram_body(d: Column) -> Column:
    """A checked diagram (dossiers.item_type("diagrams")) as diagram text; nodes are named by their places."""
    nodes, parties, classes = (F.transform(F.coalesce(d[n], F.array()), lambda x: x["key"]) for n in ("nodes", "participants", "classes"))

    def flow_edge(e: Column) -> Column:
        a, b = _position(nodes, "n", e["from"]), _position(nodes, "n", e["to"])
        return F.when(_blank(e["label"]), _text("    ", a, " --> ", b)).otherwise(_text("    ", a, ' -->|"', escape_diagram(e["label"]), '"| ', b))

    def message(m: Column) -> Column:
        return _text("    ", _position(parties, "p", m["from"]), F.when(m["response"], "-->>").otherwise("->>"), _position(parties, "p", m["to"]), ": ", escape_diagram(m["label"]))

    def class_lines(c: Column, i: Column) -> Column:
        name = _text("c", i.cast("string"))
        head = _text("    class ", name, '["', escape_diagram(c["label"]), '"]')
        return F.array_join(F.concat(F.array(head), F.transform(c["members"], lambda m: _text("    ", name, " : ", escape_diagram(m)))), "\n")

    def relation(r: Column) -> Column:
        line = F.lit(None).cast("string")
        for kind, connector in CONNECTORS.items():
            line = F.when(r["kind"] == kind, connector).otherwise(line)
        both = _text("    ", _position(classes, "c", r["from"]), " ", line, " ", _position(classes, "c", r["to"]))
        return F.when(_blank(r["label"]), both).otherwise(_text(both, " : ", escape_diagram(r["label"])))

    each = lambda name, make: F.transform(F.coalesce(d[name], F.array()), make)
    flow = F.concat(F.array(F.lit("flowchart TD")), each("nodes", lambda n, i: _text("    n", i.cast("string"), '["', escape_diagram(n["label"]), '"]')), each("edges", flow_edge))
    sequence = F.concat(F.array(F.lit("sequenceDiagram")), each("participants", lambda p, i: _text("    participant p", i.cast("string"), " as ", escape_diagram(p["label"]))), each("messages", message))
    class_ = F.concat(F.array(F.lit("classDiagram")), each("classes", class_lines), each("relationships", relation))
    lines = F.when(d["type"] == "flowchart", flow).when(d["type"] == "sequence", sequence).when(d["type"] == "class", class_)
    return F.array_join(lines, "\n")


def diagram_block(d: Column) -> Column:
    return _text("```mermaid\n", diagram_body(d), "\n```")


def _diagrams(dossier: dict, types: list[str]) -> Column:
    chosen = F.filter(dossier["diagrams"], lambda d: d["type"].isin(types))
    return _joined(chosen, lambda d: _text("\n**", escape_inline(d["title"]), "**\n\n", diagram_block(d), "\n"))


# --- the bodies of a component's sections


def _sourced(item: Column, document: Column) -> Column:
    return _text("Source: ", sources_line(item["source_paths"], document), "\n")


def _or_none(items: Column, none: str, text: Column) -> Column:
    return F.when(F.size(items) == 0, none).otherwise(text)


def architecture(d: dict, document: Column) -> Column:
    each = lambda x: _lines(_text("### ", escape_inline(x["title"])), "", escape_inline(x["description"]), "", _sourced(x, document))
    return tidy(_or_none(d["architecture"], "_No architecture documented for this component._", _joined(d["architecture"], each)))


def interfaces(d: dict, document: Column) -> Column:
    each = lambda x: _row(*[escape_cell(x[n]) for n in ("name", "kind", "direction", "description")], _cell_sources(x["source_paths"], document))
    table = _lines("| Name | Kind | Direction | Description | Sources |", "| --- | --- | --- | --- | --- |", _joined(d["interfaces"], each))
    return tidy(_or_none(d["interfaces"], "_No interfaces documented for this component._", table))


def data_models(d: dict, document: Column) -> Column:
    def each(x: Column) -> Column:
        fields = _lines("| Field | Type | Description |", "| --- | --- | --- |", _joined(x["fields"], lambda f: _row(escape_cell(f["name"]), escape_cell(f["type"]), escape_cell(f["description"]))), "")
        relations = _lines("| Relationship | Kind | Description |", "| --- | --- | --- |", _joined(x["relationships"], lambda r: _row(escape_cell(r["target"]), escape_cell(r["kind"]), escape_cell(r["description"]))), "")
        head = _text("### ", escape_inline(x["name"]), " (", escape_inline(x["kind"]), ")")
        return _lines(head, "", escape_inline(x["description"]), "", F.when(F.size(x["fields"]) > 0, fields), F.when(F.size(x["relationships"]) > 0, relations), _sourced(x, document))

    body = _or_none(d["data_models"], "_No data models documented for this component._", _joined(d["data_models"], each))
    return tidy(_lines(body, _diagrams(d, ["class"])))


def workflows(d: dict, document: Column) -> Column:
    def step(s: Column, i: Column) -> Column:
        return _text((i + 1).cast("string"), ". **", escape_inline(s["actor"]), "** — ", escape_inline(s["action"]), F.when(_blank(s["target"]), "").otherwise(_text(" → ", escape_inline(s["target"]))))

    def each(x: Column) -> Column:
        return _lines(_text("### ", escape_inline(x["name"])), "", escape_inline(x["description"]), "", _joined(x["steps"], step), "", _sourced(x, document))

    body = _or_none(d["workflows"], "_No workflows documented for this component._", _joined(d["workflows"], each))
    return tidy(_lines(body, _diagrams(d, ["flowchart", "sequence"])))


def dependencies(d: dict, document: Column) -> Column:
    component = lambda x: F.when(F.coalesce(x["component_key"], F.lit("")) == "", "").otherwise(_text("`", escape_cell(x["component_key"]), "`"))
    each = lambda x: _row(*[escape_cell(x[n]) for n in ("name", "kind", "purpose")], component(x), _cell_sources(x["source_paths"], document))
    table = _lines("| Name | Kind | Purpose | Component | Sources |", "| --- | --- | --- | --- | --- |", _joined(d["dependencies"], each))
    return tidy(_or_none(d["dependencies"], "_No dependencies documented for this component._", table))


def review_gaps(d: dict, document: Column | None) -> Column:
    """The gaps as a list; sources are told where there is a document to link from."""
    def each(x: Column) -> Column:
        sources = F.lit(None).cast("string") if document is None else F.when(F.size(x["source_paths"]) > 0, _text("  - Source: ", sources_line(x["source_paths"], document)))
        return _lines(_text("- **", escape_inline(x["kind"]), "** — ", escape_inline(x["description"])), F.when(~_blank(x["recommendation"]), _text("  - Recommendation: ", escape_inline(x["recommendation"]))), sources)

    return tidy(_or_none(d["review_gaps"], "_No review gaps reported._", _joined(d["review_gaps"], each)))


BODIES = {"architecture": architecture, "interfaces": interfaces, "data_models": data_models, "workflows": workflows, "dependencies": dependencies}


def _columns(dossiers: DataFrame) -> dict:
    return {c: F.col(c) for c in dossiers.columns}


# --- documents


def component_pages(dossiers: DataFrame) -> DataFrame:
    """path, content: the page of each dossier (component_key, document, and the dossier's columns)."""
    d, at = _columns(dossiers), F.col("document")
    sources = F.when(F.size("source_paths") > 0, _lines("## Source Paths", "", _joined(d["source_paths"], lambda p: _text("- ", source_link(p, at))), ""))
    parts = [_text("# ", escape_inline(d["title"])), "", _text("Component `", d["component_key"], "`."), "", "## Purpose", "", escape_inline(d["purpose"]), "", sources]
    for topic, _, title in TOPICS:
        parts += [f"## {title}", "", BODIES[topic](d, at)]
    parts += ["## Review Gaps", "", review_gaps(d, None)]
    return dossiers.select(at.alias("path"), tidy(_lines(*parts)).alias("content"))


def sections(dossiers: DataFrame, docs_dir: str, topic: str) -> DataFrame:
    """component_key, root_component, content: each component's section of a topic; `components` is the overview."""
    d, key = _columns(dossiers), F.col("component_key")
    if topic == "components":
        link = F.regexp_replace("document", F.lit(f"^{docs_dir}/"), F.lit(""))
        work = _or_none(d["architecture"], "_None documented._", _joined(d["architecture"], lambda x: _text("- ", escape_inline(x["title"]))))
        body = _lines(_text("## [`", key, "`](", link, ")"), "", _text("**", escape_inline(d["title"]), "**"), "", escape_inline(d["purpose"]), "", "**Responsibilities:**", "", work)
    elif topic == "review_gaps":
        body = _lines(_text("## `", key, "`"), "", review_gaps(d, F.lit(f"{docs_dir}/review_notes.md")))
    else:
        file = next(f for t, f, _ in TOPICS if t == topic)
        body = _lines(_text("## `", key, "`"), "", BODIES[topic](d, F.lit(f"{docs_dir}/{file}")))
    return dossiers.select("component_key", "root_component", tidy(body).alias("content"))


def owned_document(parts: DataFrame, path: str, head: list[str], topic: str, first: DataFrame | None = None) -> DataFrame:
    """path, content: the head, then each component's owned section, the root first, then by key. `first` (key, content)
    comes before the components. The sections meet in one text, which is what the document is."""
    rows = parts.select(F.when(F.col("root_component"), 1).otherwise(2).alias("n"), F.col("component_key").alias("key"), owned_section(F.lit(topic), F.col("component_key"), F.col("content")).alias("line"))
    if first is not None:
        rows = first.select(F.lit(0).alias("n"), "key", owned_section(F.lit("scanner"), F.col("key"), F.col("content")).alias("line")).unionByName(rows)
    body = rows.agg(F.expr("listagg(line, '\\n') within group (order by n, key)").alias("body"))
    return body.select(F.lit(path).alias("path"), tidy(_lines(*head, "", F.col("body"))).alias("content"))


def _parts(dossiers: DataFrame, docs_dir: str, topic: str, reused: DataFrame | None) -> DataFrame:
    """The sections of a topic: fresh ones, and those that are installed (topic, component_key, root_component, content)."""
    fresh = sections(dossiers, docs_dir, topic)
    if reused is None:
        return fresh
    return fresh.unionByName(reused.where(F.col("topic") == topic).select("component_key", "root_component", "content"))


def components_overview(dossiers: DataFrame, docs_dir: str, reused: DataFrame | None = None) -> DataFrame:
    head = ["# Components", "", "Every discovered component, its purpose, and its primary responsibilities."]
    return owned_document(_parts(dossiers, docs_dir, "components", reused), f"{docs_dir}/components.md", head, "components")


def topic_documents(dossiers: DataFrame, docs_dir: str, reused: DataFrame | None = None) -> DataFrame:
    out = None
    for topic, file, title in TOPICS:
        head = [f"# {title}", "", f"{title} owned by each component. Sections are managed by tallyloom."]
        one = owned_document(_parts(dossiers, docs_dir, topic, reused), f"{docs_dir}/{file}", head, topic)
        out = one if out is None else out.unionByName(one)
    return out


def scanner_notes(decisions: DataFrame, omitted: int) -> DataFrame:
    """key, content: what the scan left out that a reader should know of, in path order."""
    skipped = decisions.where(~F.col("included") & F.col("reason").isin("file_size_limit", "binary_content"))
    lines = skipped.agg(F.expr("listagg(concat('- Excluded `', path, '` (', reason, ').'), '\\n') within group (order by path)").alias("l"))
    more = F.lit(f"- {omitted} component(s) were omitted from the codebase hierarchy diagram because of the node limit." if omitted else None).cast("string")
    none = F.when(F.col("l").isNull() & more.isNull(), "_No scanner review notes._")
    return lines.select(F.lit("scanner").alias("key"), tidy(_lines("## Scanner Notes", "", none, more, F.col("l"))).alias("content"))


def review_notes(dossiers: DataFrame, decisions: DataFrame, docs_dir: str, omitted: int = 0, reused: DataFrame | None = None) -> DataFrame:
    head = ["# Review Notes", "", "Deterministic scanner notes followed by model-reported review gaps per component."]
    return owned_document(_parts(dossiers, docs_dir, "review_gaps", reused), f"{docs_dir}/review_notes.md", head, "review_gaps", scanner_notes(decisions, omitted))


# What the index says of each document.
INDEX = [
    ("Codebase Info", "codebase_info.md", "Scanner metadata, detected languages, manifests, and the component hierarchy."),
    ("Components", "components.md", "Catalog of components with purpose and responsibilities."),
    ("Architecture", "architecture.md", "Architectural responsibilities and boundaries per component."),
    ("Interfaces", "interfaces.md", "APIs, events, commands, and integration points per component."),
    ("Data Models", "data_models.md", "Entities, schemas, fields, relationships, and class diagrams."),
    ("Workflows", "workflows.md", "Runtime and development flows with flow and sequence diagrams."),
    ("Dependencies", "dependencies.md", "External and internal dependencies per component."),
    ("Review Notes", "review_notes.md", "Deterministic scanner notes and model-reported review gaps."),
]
INDEX_HEAD = ["# Repository Documentation", "", "This knowledge base is generated by tallyloom. It is the primary entry point for", "maintainers, onboarding engineers, API consumers, and AI coding assistants.", "", "## Documents", ""]
INDEX_FOOT = ["", "## Navigation", "", "Start with the topic documents for a cross-component view, or open a component page", "for its complete dossier. Each component owns clearly marked sections in the topic", "documents; generated content is managed by tallyloom and should not be edited by hand."]


def index(components: DataFrame, docs_dir: str) -> DataFrame:
    """path, content of the index: the documents, then each component (component_key, root_component, document), the root
    first. It needs no dossier."""
    link = F.regexp_replace("document", F.lit(f"^{docs_dir}/"), F.lit(""))
    rows = components.select(F.when(F.col("root_component"), 0).otherwise(1).alias("n"), "component_key", _text("- [`", F.col("component_key"), "`](", link, ")").alias("line"))
    listed = rows.agg(F.expr("listagg(line, '\\n') within group (order by n, component_key)").alias("l"))
    catalogue = [f"- [{title}]({file}) — {text}" for title, file, text in INDEX]
    body = _lines(*INDEX_HEAD, *catalogue, "", "## Components", "", F.coalesce("l", F.lit("_No documentable components were discovered._")), *INDEX_FOOT)
    return listed.select(F.lit(f"{docs_dir}/index.md").alias("path"), tidy(body).alias("content"))


def codebase_info(decisions: DataFrame, languages: DataFrame, manifests: DataFrame, components: DataFrame, hierarchy: DataFrame, docs_dir: str, omitted: int = 0) -> DataFrame:
    """path, content of the codebase's document: counts, languages (language, files), manifests (path) and the hierarchy
    (content, one row). Each part is one row; they meet by position, not by a join of their rows."""
    at = f"{docs_dir}/codebase_info.md"
    counts = decisions.agg(F.count(F.lit(1)).alias("a"), F.count_if("included").alias("b"), F.count_if("triggers").alias("c"), F.count_if(~F.col("included")).alias("d"))
    names = ["Tracked files", "Included as context", "Triggering regeneration", "Excluded"]
    table = counts.select(F.lit(0).alias("n"), _lines("# Codebase Info", "", "Deterministic metadata collected by the scanner. This document contains no model output.", "", "## Summary", "", "| Metric | Value |", "| --- | --- |", *[_text(f"| {name} | ", F.col(c).cast("string"), " |") for name, c in zip(names, "abcd", strict=True)]).alias("part"))
    number = components.agg(F.lit(1).alias("n"), _text("| Components | ", F.count(F.lit(1)).cast("string"), " |\n").alias("part"))
    rows = languages.select("files", "language", _text("| ", escape_cell(F.col("language")), " | ", F.col("files").cast("string"), " |").alias("line"))
    spoken = rows.agg(F.expr("listagg(line, '\\n') within group (order by files desc, language)").alias("l"))
    spoken = spoken.select(F.lit(2).alias("n"), _lines("## Languages", "", F.when(F.col("l").isNull(), "_No source languages detected._").otherwise(_lines("| Language | Files |", "| --- | --- |", F.col("l"))), "").alias("part"))
    listed = manifests.select("path", _text("- ", source_link(F.col("path"), F.lit(at))).alias("line")).agg(F.expr("listagg(line, '\\n') within group (order by path)").alias("l"))
    listed = listed.select(F.lit(3).alias("n"), _lines("## Dependency Manifests", "", F.coalesce("l", F.lit("_No dependency manifests detected._")), "").alias("part"))
    more = f"_{omitted} additional component(s) omitted from the diagram; see review notes._" if omitted else None
    tree = hierarchy.select(F.lit(4).alias("n"), _lines("## Component Hierarchy", "", _text("```mermaid\n", F.col("content"), "\n```"), "", F.lit(more).cast("string")).alias("part"))
    parts = table.unionByName(number).unionByName(spoken).unionByName(listed).unionByName(tree)
    return parts.agg(F.expr("listagg(part, '\\n') within group (order by n)").alias("c")).select(F.lit(at).alias("path"), tidy(F.col("c")).alias("content"))


def document_set(dossiers: DataFrame, decisions: DataFrame, first: DataFrame, docs_dir: str, omitted: int = 0, reused: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """path, content of every document: `first`, the index and the codebase's (path, content), which need no dossier, the
    components overview, the topics, the review notes, and a page for each component. Components without a dossier keep
    their installed sections (`reused`) and pages (`pages`: path, content)."""
    out = first.select("path", "content").unionByName(components_overview(dossiers, docs_dir, reused)).unionByName(topic_documents(dossiers, docs_dir, reused))
    out = out.unionByName(review_notes(dossiers, decisions, docs_dir, omitted, reused)).unionByName(component_pages(dossiers))
    return out if pages is None else out.unionByName(pages.select("path", "content"))


def expected_sections(components: DataFrame, docs_dir: str) -> DataFrame:
    """doc, n, topic, key: the sections that every document of a set over these components has to have, in order."""
    files = [("components.md", "components"), *[(f, t) for t, f, _ in TOPICS], ("review_notes.md", "review_gaps")]
    place = F.row_number().over(Window.orderBy(F.desc("root_component"), "component_key"))  # a row a component
    rows = components.withColumn("n", place).select("component_key", "n", F.explode(F.array(*[F.struct(F.lit(f"{docs_dir}/{f}").alias("doc"), F.lit(t).alias("topic")) for f, t in files])).alias("x"))
    rows = rows.select("x.doc", F.when(F.col("x.topic") == "review_gaps", F.col("n") + 1).otherwise(F.col("n")).alias("n"), "x.topic", F.col("component_key").alias("key"))
    scanner = components.sparkSession.createDataFrame([(f"{docs_dir}/review_notes.md", 1, "scanner", "scanner")], "doc string, n int, topic string, key string")
    return rows.unionByName(scanner)
