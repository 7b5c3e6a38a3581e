"""Which scopes have all they need, and whether a scope's parts stand for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaps(scopes: DataFrame, scope: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """scope, kind: the required kinds that a scope has no result of. The scopes meet a few literal kinds, not a table."""
    required = scopes.select(*scope).distinct().select(*scope, F.explode(F.array(*map(F.lit, kinds))).alias(kind))
    return required.join(scopes.select(*scope, kind).distinct(), [*scope, kind], "left_anti")


def contiguity(scopes: DataFrame, group: list[str], index: str, first: int = 1) -> DataFrame:
    """group, n, contiguous: whether the indexes are first, first + 1, ... each once or more, without a gap."""
    out = scopes.groupBy(*group).agg(F.min(index).alias("lo"), F.max(index).alias("hi"), F.count_distinct(index).alias("n"))
    return out.select(*group, "n", ((F.col("lo") == first) & (F.col("hi") == F.col("n") + (first - 1))).alias("contiguous"))


def plan_issues(plan: DataFrame, kinds: list[str]) -> DataFrame:
    """component_key, code: batches or chunks that aren't 1 to their count, counts that differ, scopes without some kind,
    and kinds of a scope with different evidence. `plan`: component_key, batch, batch_count, chunk, chunk_count, kind, evidence."""
    batches = plan.groupBy("component_key").agg(F.count_distinct("batch").alias("n"), F.max("batch").alias("hi"), F.min("batch").alias("lo"), F.min("batch_count").alias("c0"), F.max("batch_count").alias("c1"))
    chunks = plan.groupBy("component_key", "batch").agg(F.count_distinct("chunk").alias("n"), F.max("chunk").alias("hi"), F.min("chunk").alias("lo"), F.min("chunk_count").alias("c0"), F.max("chunk_count").alias("c1"))
    wrong = "not (lo = 1 and hi = n and c0 = c1 and c0 = n)"
    scopes = plan.groupBy("component_key", "batch", "chunk").agg(F.collect_set("kind").alias("k"), F.count_distinct(F.array_sort("evidence")).alias("e"))
    need = F.array(*map(F.lit, kinds))
    out = batches.where(wrong).select("component_key", F.lit("batches").alias("code"))
    out = out.union(chunks.where(wrong).select("component_key", F.lit("chunks")))
    out = out.union(scopes.where(F.size(F.array_except(need, "k")) > 0).select("component_key", F.lit("kinds")))
    return out.union(scopes.where("e > 1").select("component_key", F.lit("evidence"))).distinct()


def replacement_issues(parents: DataFrame, children: DataFrame) -> DataFrame:
    """split_path, code for scopes that parts replace: fewer than two parts, another kind, another lineage, evidence
    beyond the scope's, or evidence of it that no part has. Both: split_path, kind, evidence; children: parent."""
    c = children.groupBy(F.col("parent").alias("split_path")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("kind").alias("kinds"), F.array_sort(F.collect_list("split_path")).alias("parts"), F.array_distinct(F.flatten(F.collect_list("evidence"))).alias("have"))
    both = parents.join(c, "split_path")
    line = F.forall("parts", lambda p: F.regexp_replace(p, r"/[0-9]+\z", "") == F.col("split_path"))
    code = F.when(F.col("n") < 2, "too_few").when((F.size("kinds") > 1) | (F.get("kinds", F.lit(0)) != F.col("kind")), "kind").when(~line, "lineage").when(F.size(F.array_except("have", "evidence")) > 0, "foreign_evidence").when(F.size(F.array_except("evidence", "have")) > 0, "lost_evidence")
    return both.select("split_path", code.alias("code")).where("code is not null")


def settled(coverage: DataFrame) -> DataFrame:
    """split_path, done: a scope is done if it is complete or saturated, or replaced and no scope below it is pending.
    Paths name all scopes above, so this is one equality join with them and no recursion."""
    leaves = coverage.where("state <> 'replaced'").select("split_path", (F.col("state") == "pending").alias("open"))
    parts = F.split("split_path", "/")
    above = leaves.select("open", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("split_path"))
    state = above.groupBy("split_path").agg((~F.bool_or("open")).alias("done"))
    return coverage.select("split_path").join(state, "split_path", "left").select("split_path", F.coalesce("done", F.lit(False)).alias("done"))
