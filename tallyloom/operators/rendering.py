"""Markdown from tables: lines are rows, and a document is its lines in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_cell, escape_diagram, escape_inline, source_link, tidy

BEGIN, END = "<!-- tallyloom:begin ", "<!-- tallyloom:end "
MARKER = r"\A<!-- tallyloom:(begin|end) topic=\"([^\"]*)\" key=\"([^\"]*)\" -->\z"
MOST_NODES = 60
# The documents that every run makes.
DOCUMENTS = ["index.md", "codebase_info.md", "components.md", "architecture.md", "interfaces.md", "data_models.md", "workflows.md", "dependencies.md", "review_notes.md"]


def joined(lines: DataFrame, document: list[str], order: list[str], line: str = "line") -> DataFrame:
    """document, content: the lines in order, without double blank lines and with one line break at the end."""
    out = lines.groupBy(*document).agg(F.expr(f"listagg({line}, '\\n') within group (order by {', '.join(order)})").alias("content"))
    return out.select(*document, tidy(F.col("content")).alias("content"))


def marker(kind: str, topic: Column, key: Column) -> Column:
    return F.concat(F.lit(BEGIN if kind == "begin" else END), F.lit('topic="'), topic, F.lit('" key="'), key, F.lit('" -->'))


def owned_section(topic: Column, key: Column, content: Column) -> Column:
    """Content between a begin and an end marker, each on its line."""
    bare = F.regexp_replace(F.regexp_replace(content, r"\A\n+", ""), r"\n+\z", "")
    return F.concat(marker("begin", topic, key), F.lit("\n"), F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n"))), marker("end", topic, key), F.lit("\n"))


def sections(documents: DataFrame, key: str = "doc", body: str = "body") -> tuple[DataFrame, DataFrame]:
    """The marked sections of each document (doc, topic, key, content, begin_line, end_line), and for each malformed
    document the first reason (doc, line, reason).

    Each line knows the marker before it, so a section is the lines after the same begin marker. Lines are numbered
    from 0; content loses line breaks at both ends.
    """
    lines = documents.select(F.col(key).alias("doc"), F.posexplode(F.split(F.col(body), "\n")).alias("n", "line"))
    lines = lines.withColumns({"kind": F.nullif(F.regexp_extract("line", MARKER, 1), F.lit("")), "topic": F.regexp_extract("line", MARKER, 2), "section": F.regexp_extract("line", MARKER, 3)})
    by = Window.partitionBy("doc").orderBy("n")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    marks = F.when(F.col("kind").isNotNull(), F.struct("n", "kind", "topic", "section"))
    lines = lines.withColumn("prev", F.last(marks, ignorenulls=True).over(before))
    lines = lines.withColumn("after", F.first(marks, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    seen = F.row_number().over(Window.partitionBy("doc", "kind", "topic", "section").orderBy("n"))
    lines = lines.withColumn("nth", seen)
    open_ = F.coalesce(F.col("prev.kind") == "begin", F.lit(False))
    reason = (
        F.when((F.col("kind") == "end") & ~open_, "unexpected end")
        .when((F.col("kind") == "begin") & open_, "nested begin")
        .when((F.col("kind") == "begin") & (F.col("nth") > 1), "duplicate section")
        .when((F.col("kind") == "end") & ((F.col("prev.topic") != F.col("topic")) | (F.col("prev.section") != F.col("section"))), "mismatched end")
        .when((F.col("kind") == "begin") & F.col("after").isNull(), "unterminated section")
    )
    bad = lines.where(reason.isNotNull()).groupBy("doc").agg(F.min(F.struct(F.col("n").alias("line"), reason.alias("reason"))).alias("x")).select("doc", "x.line", "x.reason")
    good = lines.join(bad.select("doc"), "doc", "left_anti")
    inner = good.where(open_ & F.col("kind").isNull()).groupBy("doc", F.col("prev.n").alias("begin_line")).agg(F.expr("listagg(line, '\\n') within group (order by n)").alias("content"))
    ends = good.where((F.col("kind") == "end")).select("doc", "topic", F.col("section").alias("key"), F.col("prev.n").alias("begin_line"), F.col("n").alias("end_line"))
    out = ends.join(inner, ["doc", "begin_line"], "left")
    content = F.regexp_replace(F.regexp_replace(F.coalesce("content", F.lit("")), r"\A\n+", ""), r"\n+\z", "")
    return out.select("doc", "topic", "key", content.alias("content"), "begin_line", "end_line"), bad


def sequence_issues(found: DataFrame, expected: DataFrame) -> DataFrame:
    """doc, n: places at which the sections of a document aren't the expected ones. Both: doc, topic, key; expected: n."""
    have = found.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("begin_line"))).select("doc", "n", F.col("topic").alias("t"), F.col("key").alias("k"))
    both = expected.select("doc", "n", "topic", "key").join(have, ["doc", "n"], "full_outer")
    return both.where(~(F.col("t").eqNullSafe(F.col("topic")) & F.col("k").eqNullSafe(F.col("key")))).select("doc", "n")


def table_rows(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[escape_cell(c) for c in cells]), F.lit(" |"))


def sources_line(paths: Column, document: Column) -> Column:
    return F.array_join(F.transform(paths, lambda p: source_link(p, document)), ", ")


def topic_lines(items: DataFrame) -> DataFrame:
    """doc, key, n, line for merged items (component_key, section, title, description, paths, position)."""
    doc = F.concat(F.lit("docs/"), "section", F.lit(".md"))
    text = F.concat(F.lit("- **"), escape_inline(F.col("title")), F.lit("**: "), escape_inline(F.col("description")), F.lit(" ("), sources_line(F.col("paths"), doc), F.lit(")"))
    return items.select(doc.alias("doc"), F.col("component_key").alias("key"), F.col("position").alias("n"), text.alias("line"))


def topic_document(lines: DataFrame, title: Column) -> DataFrame:
    """doc, content: a heading, then one owned section for each component in order."""
    bodies = lines.groupBy("doc", "key").agg(F.expr("listagg(line, '\\n') within group (order by n)").alias("body"))
    section = owned_section(title, F.col("key"), F.concat(F.lit("## "), escape_inline(F.col("key")), F.lit("\n\n"), "body"))
    parts = bodies.select("doc", "key", section.alias("s"))
    out = parts.groupBy("doc").agg(F.expr("listagg(s, '\\n') within group (order by key)").alias("body"))
    return out.select("doc", tidy(F.concat(F.lit("# "), title, F.lit("\n\n"), "body")).alias("content"))


def numbered(rows: DataFrame, prefix: str, order: list[str], group: list[str]) -> DataFrame:
    """Rows with a positional id: prefix and number from 0."""
    return rows.withColumn("id", F.concat(F.lit(prefix), (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("string")))


def hierarchy(parents: DataFrame, most: int = MOST_NODES) -> tuple[DataFrame, DataFrame]:
    """Nodes (component_key, parent, id) of the tree of components, the root first, and how many were left out."""
    rest = parents.where("component_key <> '@root'")
    top = rest.orderBy("component_key").limit(most - 1)
    rows = top.select("component_key", "parent", F.concat(F.lit("n"), F.row_number().over(Window.orderBy("component_key")).cast("string")).alias("id"))
    return rows, rest.agg(F.greatest(F.count(F.lit(1)) - (most - 1), F.lit(0)).alias("omitted"))


def flowchart(diagram: DataFrame) -> DataFrame:
    """key, content: nodes (n0, n1, ...) and edges of each diagram of validation.DIAGRAM; edges name nodes by place."""
    at = lambda k: F.concat(F.lit("n"), (F.array_position(F.transform("nodes", lambda n: n["key"]), k) - 1).cast("string"))
    nodes = F.transform("nodes", lambda n, i: F.concat(F.lit("  n"), i.cast("string"), F.lit('["'), escape_diagram(n["label"]), F.lit('"]')))
    edges = F.transform("edges", lambda e: F.concat(F.lit("  "), at(e["from"]), F.when(F.coalesce(e["label"], F.lit("")) == "", " --> ").otherwise(F.concat(F.lit(' -->|"'), escape_diagram(e["label"]), F.lit('"| '))), at(e["to"])))
    return diagram.select("key", F.array_join(F.concat(F.array(F.lit("flowchart TD")), nodes, edges), "\n").alias("content"))


def reused(fresh: DataFrame, installed: DataFrame, key: str = "path") -> DataFrame:
    """Fresh content where there is some, else what is installed."""
    f = fresh.select(key, F.col("content").alias("fresh"))
    return f.join(installed.select(key, F.col("content").alias("old")), key, "full_outer").select(key, F.coalesce("fresh", "old").alias("content"))


def hierarchy_text(parents: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """content: the tree of components as a flowchart; a parent that was left out is the root's place."""
    rows, _ = hierarchy(parents, most)
    ids = rows.select(F.col("component_key").alias("parent"), F.col("id").alias("pid"))
    both = rows.join(ids, "parent", "left").select("component_key", "id", F.coalesce("pid", F.lit("n0")).alias("pid"))
    n = F.substring("id", 2, 10).cast("int")
    lines = both.select(F.explode(F.array(F.struct(F.lit(1).alias("part"), n.alias("n"), F.concat(F.lit("  "), "id", F.lit('["'), escape_diagram(F.col("component_key")), F.lit('"]')).alias("line")), F.struct(F.lit(2).alias("part"), n.alias("n"), F.concat(F.lit("  "), "pid", F.lit(" --> "), "id").alias("line")))).alias("x")).select("x.*")
    head = parents.sparkSession.createDataFrame([(0, 0, "flowchart TD"), (1, 0, '  n0["@root"]')], "part int, n int, line string")
    return head.unionByName(lines).agg(F.expr("listagg(line, '\\n') within group (order by part, n)").alias("content"))


def request_text(title: Column, documents: Column, added: Column, changed: Column, deleted: Column) -> Column:
    """What a request to review generated documents says."""
    return F.format_string("# %s\n\n%d documents: %d added, %d changed, %d deleted.\n", title, documents, added, changed, deleted)
