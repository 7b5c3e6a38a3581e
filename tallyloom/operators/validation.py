"""Constraint queries: a body or table in, a row for each violation out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import prose_problem

MOST_ISSUES, MOST_FRAGMENT_BYTES = 50, 8192


def prose_issues(rows: DataFrame, key: str, text: str, most_bytes: int, required: bool = True) -> DataFrame:
    """key, seq, code, detail: an empty text, one of too many bytes, one that is no plain prose."""
    value = F.coalesce(F.col(text), F.lit(""))
    empty = F.trim(value, F.lit(" \t\r\n\x0b\x0c")) == ""
    why = prose_problem(value)
    found = F.array(
        F.when(empty & F.lit(required), F.struct(F.lit(0).alias("seq"), F.lit("empty_value").alias("code"), F.lit("").alias("detail"))),
        F.when(~empty & (F.octet_length(value) > most_bytes), F.struct(F.lit(1).alias("seq"), F.lit("string_too_long").alias("code"), F.lit(str(most_bytes)).alias("detail"))),
        F.when(~empty & why.isNotNull(), F.struct(F.lit(2).alias("seq"), F.lit("unsafe_prose").alias("code"), why.alias("detail"))),
    )
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(key, "i.seq", "i.code", "i.detail")


def first_issues(issues: DataFrame, key: list[str], order: list[str], limit: int = MOST_ISSUES) -> DataFrame:
    return issues.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank_") <= limit).drop("rank_")


def json_issue(body: Column, fields: dict[str, str], most_bytes: int | None = None) -> Column:
    """The first thing wrong with a JSON object, or null: too long, no JSON, something after the JSON
    (which the parser passes over, so the text is also read as the one element of a list), no object, an unknown field, a missing one,
    one of the wrong type. `fields` gives each field's type as schema_of_variant writes it (a regular expression)."""
    value = F.try_parse_json(body)
    alone = F.json_array_length(F.when(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull(), F.concat(F.lit("["), body, F.lit("]"))))
    keys = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    known = F.array(*[F.lit(f) for f in sorted(fields)]).cast("array<string>")
    out = F.when(F.octet_length(body) > most_bytes, "string_too_long") if most_bytes is not None else F.when(F.lit(False), "")
    out = out.when(body.isNull() | value.isNull(), "invalid_json").when(~F.coalesce(alone == 1, F.lit(False)), "trailing_data").when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "invalid_type")
    out = out.when(F.size(F.array_except(keys, known)) > 0, "unknown_field").when(F.size(F.array_except(known, keys)) > 0, "empty_value")
    for name, kind in sorted(fields.items()):
        out = out.when(~F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")).rlike(rf"\A(?:{kind})\z"), F.lit(False)), "invalid_type")
    return out


def unknown_evidence(items: DataFrame, allowed: DataFrame, path: str = "path") -> DataFrame:
    """Cited paths that aren't allowed."""
    return items.join(allowed.select(F.col("path").alias(path)).distinct(), path, "left_anti")


def evidence_issues(items: DataFrame, key: list[str], allowed: DataFrame, limit: int, most_bytes: int = 512) -> DataFrame:
    """key, place, code for items with an array `paths`: none, too many, and for each path blank, too long, duplicate, unknown."""
    rows = items.select(*key, "paths")
    whole = rows.select(*key, F.lit(-1).alias("place"), F.when(F.size("paths") == 0, "empty_value").when(F.size("paths") > limit, "too_many_items").alias("code")).where("code is not null")
    each = rows.select(*key, F.posexplode("paths").alias("place", "path"))
    seen = F.row_number().over(Window.partitionBy(*key, "path").orderBy("place"))
    each = each.withColumn("nth", seen).join(allowed.select("path", F.lit(True).alias("ok")).distinct(), "path", "left")
    codes = F.array(
        F.when(F.trim("path") == "", F.lit("empty_value")),
        F.when((F.trim("path") != "") & (F.octet_length("path") > most_bytes), F.lit("string_too_long")),
        F.when((F.trim("path") != "") & (F.col("nth") > 1), F.lit("duplicate_key")),
        F.when((F.trim("path") != "") & F.col("ok").isNull(), F.lit("unknown_evidence_path")),
    )
    each = each.select(*key, "place", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    return whole.unionByName(each)


def dependency_issue(kind: Column, key: Column, catalog: list[str] | None = None, known: Column | None = None, most_bytes: int = 512) -> Column:
    """What is wrong with a dependency's component, or null."""
    bare = F.trim(F.coalesce(key, F.lit("")))
    found = known if known is not None else key.isin(catalog or [])
    return F.when((kind == "internal_component") & (bare == ""), "missing_component_key").when(bare == "", F.lit(None).cast("string")).when(key != bare, "invalid_value").when(F.octet_length(key) > most_bytes, "string_too_long").when(~found, "unknown_component_key")


def enum_issue(value: Column, members: list[str]) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "empty_value").when(~value.isin(members), "invalid_enum")


def saturation(complete: Column, count: Column, limit: int, omitted: Column) -> tuple[Column, Column]:
    """Whether a list reached its bound, and the error of a complete one that omits something."""
    return ~complete | (count == limit), F.when(complete & (omitted > 0), "invalid_value")


DIAGRAM = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("label", T.StringType())]))),
    T.StructField("edges", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("label", T.StringType())]))),
])


def diagram_issues(diagrams: DataFrame, most_nodes: int = 60, most_edges: int = 120) -> DataFrame:
    """key, code, at: node keys that repeat, edges whose ends are no node, too many of either, fields of another type."""
    known = F.transform("nodes", lambda n: n["key"])
    issue = lambda code, at: F.struct(F.lit(code).alias("code"), at.cast("string").alias("at"))
    dup = F.filter(F.array_distinct(known), lambda k: F.size(F.filter(known, lambda x: x == k)) > 1)
    bad = F.filter(F.flatten(F.transform("edges", lambda e: F.array(e["from"], e["to"]))), lambda k: ~F.array_contains(known, k))
    all_ = F.concat(
        F.filter(F.array(F.when(~F.col("type").isin("flowchart", "sequence", "class"), issue("invalid_diagram_type", F.col("type"))), F.when((F.col("type") != "flowchart") & (F.coalesce(F.size("nodes"), F.lit(0)) > 0), issue("diagram_field_not_allowed", F.lit("nodes"))), F.when(F.size("nodes") > most_nodes, issue("too_many_items", F.lit("nodes"))), F.when(F.size("edges") > most_edges, issue("too_many_items", F.lit("edges")))), lambda x: x.isNotNull()),
        F.coalesce(F.transform(dup, lambda k: issue("duplicate_key", k)), F.array().cast("array<struct<code:string,at:string>>")),
        F.coalesce(F.transform(F.array_distinct(bad), lambda k: issue("invalid_diagram_reference", k)), F.array().cast("array<struct<code:string,at:string>>")),
    )
    return diagrams.select("key", F.explode(all_).alias("i")).select("key", "i.code", "i.at")
