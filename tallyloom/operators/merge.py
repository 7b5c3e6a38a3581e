"""Merging findings: equal ones become one with all their evidence, contradicting ones are told, the best supported stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ITEMS, MOST_PATHS, NOTICES = 100, 200, 6

# The notices that an assembled document may carry.
NOTICE_TEXTS = [
    ("inconsistency", "Assembly retained conflicting claims for %d structural identities.", "Review the cited sources and resolve the conflicting claims."),
    ("missing_context", "Fragment coverage reached a bounded item limit for %d source scopes.", "Review the component for facts omitted by bounded fragment generation."),
    ("missing_context", "Assembly omitted %d items because assembled section limits were reached.", "Review the generation report and source to assess the omitted items."),
    ("missing_context", "Assembly omitted %d item citations and %d top-level source paths because evidence limits were reached.", "Review the generation report for bounded evidence omission counts."),
    ("uncertainty", "Assembly used a deterministic component overview after %d bounded fallback event.", "Review the generated title and purpose against the component source."),
    ("missing_context", "Assembly omitted diagrams after %d bounded fallback event.", "Review architecture, data models, and workflows without relying on diagrams."),
]


def merged(items: DataFrame, content: list[str], group: list[str], path: str = "path", most_paths: int = MOST_PATHS) -> DataFrame:
    """A row for each distinct content of a group: group, content, paths (sorted, the first most_paths), support (the
    number of all), paths_omitted, canonical and digest.

    Evidence comes as one path a row. Distinct pairs of content and path are found first, with map-side combining, and
    numbered; only the first `most_paths` of a content are gathered.
    """
    pairs = items.select(*group, *content, F.col(path).alias("p")).distinct()
    nth = F.row_number().over(Window.partitionBy(*group, *content).orderBy("p"))
    some = F.when(F.col("nth") <= most_paths, F.col("p"))
    rows = pairs.withColumn("nth", nth).groupBy(*group, *content).agg(F.array_sort(F.collect_list(some)).alias("paths"), F.count("p").alias("support"))
    rows = rows.withColumn("paths_omitted", F.greatest(F.col("support") - most_paths, F.lit(0)).cast("long"))
    canonical = F.to_json(F.struct(*content), {"ignoreNullFields": "false"})
    return rows.withColumn("canonical", canonical).withColumn("digest", F.sha2(canonical, 256))


def conflicts(items: DataFrame, content: list[str], group: list[str], identity: Column, path: str = "path") -> DataFrame:
    """group, identity, contents, path: identities with several contents, a row for each path of theirs, uncut. Empty
    identities can't conflict. Nothing is gathered, however many paths there are."""
    rows = items.select(*group, *content, identity.alias("identity"), F.col(path).alias("path")).where("identity is not null and identity <> ''")
    some = rows.select(*group, *content, "identity").distinct().groupBy(*group, "identity").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")
    return rows.select(*group, "identity", "path").distinct().join(some, [*group, "identity"]).select(*group, "identity", "contents", "path")


def order_of(name: str, kind: Column | None = None) -> list[Column]:
    """The five keys that break ties: first path, name, kind, digest, canonical text."""
    return [F.get("paths", F.lit(0)).asc_nulls_first(), F.col(name).asc(), (kind if kind is not None else F.lit("")).asc(), F.col("digest").asc(), F.col("canonical").asc()]


def best_supported(merged_rows: DataFrame, group: list[str], name: str, limit: int | None = MOST_ITEMS) -> DataFrame:
    """The `limit` rows of each group with the most support (all without one), with their final place in tie-break order as
    position."""
    by = order_of(name)
    top = merged_rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("support"), *by)))
    top = top if limit is None else top.where(F.col("rank") <= limit)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).drop("rank")


def omitted(merged_rows: DataFrame, group: list[str], limit: int = MOST_ITEMS) -> DataFrame:
    return merged_rows.groupBy(*group).agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("items_omitted"), F.sum("paths_omitted").alias("paths_omitted"))


def top_evidence(items: DataFrame, group: list[str], item: list[str], path: str = "path", limit: int = MOST_PATHS) -> DataFrame:
    """group, path, citations, position: the paths that most items cite, each item once; order stays (count, path)."""
    counts = items.select(*group, *item, F.col(path).alias("path")).distinct().groupBy(*group, "path").agg(F.count(F.lit(1)).alias("citations"))
    ranked = counts.withColumn("position", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("citations"), "path")))
    return ranked.where(F.col("position") <= limit)


def overview(candidates: DataFrame, group: list[str], title: str, purpose: str, fallback: DataFrame | None = None) -> DataFrame:
    """group, title, purpose: the first candidate by path, title, purpose, digest and text, else the fallback."""
    canonical = F.to_json(F.struct(title, purpose), {"ignoreNullFields": "false"})
    pick = candidates.groupBy(*group).agg(F.min(F.struct(F.col("path").alias("p"), F.col(title).alias("title"), F.col(purpose).alias("purpose"), F.sha2(canonical, 256).alias("d"), canonical.alias("c"))).alias("o"))
    pick = pick.select(*group, "o.title", "o.purpose")
    if fallback is None:
        return pick
    f = fallback.select(*group, F.col("title").alias("ft"), F.col("purpose").alias("fp"))
    return f.join(pick, group, "left").select(*group, F.coalesce("title", "ft").alias("title"), F.coalesce("purpose", "fp").alias("purpose"))


def notices(counts: DataFrame, group: list[str]) -> DataFrame:
    """group, slot, kind, description, recommendation for each count above 0; `counts` has c0 to c5 and c3b."""
    rows = []
    for i, (kind, text, advice) in enumerate(NOTICE_TEXTS):
        args = [F.col(f"c{i}")] + ([F.col("c3b")] if i == 3 else [])
        on = F.col(f"c{i}") > 0 if i != 3 else (F.col("c3") > 0) | (F.col("c3b") > 0)
        rows.append(F.struct(F.lit(i).alias("slot"), F.lit(kind).alias("kind"), F.format_string(text, *args).alias("description"), F.lit(advice).alias("recommendation"), on.alias("on")))
    return counts.select(*group, F.explode(F.array(*rows)).alias("n")).where("n.on").select(*group, "n.slot", "n.kind", "n.description", "n.recommendation")
