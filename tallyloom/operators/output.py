"""Installed output against what a run made and against what the state says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rendering import sequence_issues

# Why installed output isn't as the state left it, the first reason first.
REASONS = [
    "the generated directory contains a file not owned by prior state",
    "an owned generated document is missing",
    "prior state has no content hash for an owned document",
    "an installed generated document was modified since it was generated",
]


def integrity(owned: DataFrame, installed: DataFrame) -> DataFrame:
    """path, priority, reason of each path that isn't as it should be. owned: path, hash; installed: path, hash."""
    o, i = owned.alias("o"), installed.alias("i")
    both = o.join(i, F.col("o.path") == F.col("i.path"), "full_outer")
    n = F.when(F.col("o.path").isNull(), 0).when(F.col("i.path").isNull(), 1).when(F.coalesce("o.hash", F.lit("")) == "", 2).when(~F.col("o.hash").eqNullSafe(F.col("i.hash")), 3)
    return both.select(F.coalesce("o.path", "i.path").alias("path"), n.alias("priority")).where("priority is not null").withColumn("reason", F.element_at(F.array(*map(F.lit, REASONS)), F.col("priority") + 1))


def first_reason(problems: DataFrame) -> DataFrame:
    """reason: files that nobody owns come first; else the first owned path in order tells, whatever is wrong with it."""
    return problems.agg(F.min_by("reason", F.struct((F.col("priority") > 0).alias("owned"), "path")).alias("reason"))


def output_diff(rendered: DataFrame, prior: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """path, status: added, changed, unchanged by hash, and deleted for what was owned and isn't made any more."""
    owned = prior if owned is None else owned
    both = rendered.select("path", F.col("hash").alias("now")).join(prior.select("path", F.col("hash").alias("was"), F.lit(True).alias("there")), "path", "left")
    status = F.when(F.col("there").isNull(), "added").when(~F.col("now").eqNullSafe(F.col("was")), "changed").otherwise("unchanged")
    gone = owned.select("path").join(rendered, "path", "left_anti").select("path", F.lit("deleted").alias("status"))
    return both.select("path", status.alias("status")).unionByName(gone)


def write_set(diff: DataFrame, full: bool) -> DataFrame:
    """What is written: all that the run made, or only what is new or other."""
    return diff.where("status <> 'deleted'") if full else diff.where("status in ('added', 'changed')")


def unowned(existing: DataFrame, owned: DataFrame, recovery: bool = False) -> DataFrame:
    """path, verdict of files that no state owns: refused, or taken over in a full recovery."""
    return existing.select("path").join(owned, "path", "left_anti").select("path", F.lit("take_over" if recovery else "refuse").alias("verdict"))


def broken_preconditions(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Paths whose live hash isn't the expected one; a null hash expects that there is no file."""
    both = expected.select("path", F.col("hash").alias("want")).join(live.select("path", F.col("hash").alias("have")), "path", "left")
    return both.where(~F.col("want").eqNullSafe(F.col("have"))).select("path")


def broken_links(links: DataFrame, documents: DataFrame, key: str, target: str = "target") -> DataFrame:
    """Links within the site that lead to no document; other links and empty ones don't count."""
    inside = links.where(F.col(target).startswith("/")).select(key, target, F.regexp_extract(target, r"\A([^?#]*)", 1).alias("path")).distinct()
    return inside.join(documents.select("path").distinct(), "path", "left_anti").select(key, target)


def candidate_issues(documents: DataFrame, required: list[str], root: str, most: int) -> DataFrame:
    """priority, path, code: the checks that a set of documents must pass before it is installed (path, content, hash)."""
    spark = documents.sparkSession
    need = spark.createDataFrame([(f"{root}/{r}",) for r in required], "path string")
    row = lambda df, n, code: df.select(F.lit(n).alias("priority"), "path", F.lit(code).alias("code"))
    out = row(need.join(documents, "path", "left_anti"), 0, "required_missing")
    out = out.union(row(documents.where(~F.col("path").startswith(root + "/")), 1, "outside_root"))
    out = out.union(row(documents.groupBy("path").count().where("count > 1"), 2, "duplicate_path"))
    out = out.union(row(documents.where(F.col("hash") != F.concat(F.lit("sha256:"), F.sha2("content", 256))), 3, "hash_mismatch"))
    return out.union(row(documents.agg(F.count(F.lit(1)).alias("n"), F.max("path").alias("path")).where(F.col("n") > most), 4, "too_many"))


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def usage_totals(calls: DataFrame, group: list[str]) -> DataFrame:
    """group, calls, with_usage, prompt, completion, total: sums over the calls that report them."""
    return calls.groupBy(*group).agg(F.count(F.lit(1)).alias("calls"), F.count("total").alias("with_usage"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"), F.sum("total").alias("total"))


def candidate_checks(documents: DataFrame, sections: tuple[DataFrame, DataFrame], expected: DataFrame, state: DataFrame, required: list[str], root: str, secret) -> DataFrame:
    """step, path, code: all that keeps a set of documents (path, content) from being installed, in the order of the checks.

    sections: what rendering.sections() found (doc, topic, key, begin_line) and its malformed documents; expected: doc, n,
    topic, key of the sections that a document must have, none for one without; state: path, hash; secret: a column
    function of content. Links that leave the folder, are absolute or have a scheme aren't looked at."""
    spark = documents.sparkSession
    row = lambda df, step, code: df.select(F.lit(step).alias("step"), "path", F.lit(code).alias("code"))
    paths = documents.select("path").distinct()
    out = row(documents.groupBy("path").count().where("count > 1"), 0, "duplicate_path")
    need = spark.createDataFrame([(f"{root}/{r}",) for r in required], "path string")
    out = out.union(row(need.join(paths, "path", "left_anti"), 1, "required_missing"))
    out = out.union(row(paths.where(~F.col("path").startswith(root + "/")), 2, "outside_root"))
    found, malformed = sections
    wrong = sequence_issues(found, expected).select(F.col("doc").alias("path")).union(malformed.select(F.col("doc").alias("path"))).distinct()
    out = out.union(row(wrong, 3, "sections"))
    out = out.union(row(documents.where(secret(F.col("content"))).select("path").distinct(), 4, "secret"))
    links = documents.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\]\(([^)]+)\)"), F.lit(1))).alias("target"))
    local = links.where(~F.col("target").startswith("../") & ~F.contains("target", F.lit("://")) & ~F.col("target").startswith("/"))
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    resolved = clean_path(F.concat_ws("/", folder, "target"))
    broken = local.select("path", resolved.alias("to")).distinct().join(paths.withColumnRenamed("path", "to"), "to", "left_anti")
    out = out.union(row(broken.select("path").distinct(), 5, "broken_link"))
    both = documents.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("now")).join(state.select("path", F.col("hash").alias("was")), "path", "full_outer")
    code = F.when(F.col("now").isNull(), "not_rendered").when(F.col("was").isNull(), "hash_missing").when(F.col("now") != F.col("was"), "hash_mismatch")
    step = F.when(code == "not_rendered", 8).when(code == "hash_missing", 6).otherwise(7)
    return out.union(both.where(code.isNotNull()).select(step.alias("step"), "path", code.alias("code")))


def clean_path(path: Column) -> Column:
    """A relative path without its dot parts, each double dot taking the part before it away."""
    start = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    return F.array_join(F.aggregate(F.split(path, "/"), start, step), "/")
