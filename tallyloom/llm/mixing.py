"""Mixing sources to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_prefix, read, stored

#: How a source's rate at the start and at the end of training compares with its mean, by weight class in turn.
SCHEDULE = ((0.5, 1.5), (1.5, 0.5), (1.0, 1.0))
#: Documents of one source that one window task orders, about.
BUCKET_ROWS = 4_000


def dealt(doc_id: Column, text: Column) -> Column:
    """A document's place in its source: 60 bits of a digest that any SQL engine has."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, schedule: tuple[tuple[float, float], ...] = SCHEDULE) -> DataFrame:
    """Adds weight, target, rate0 and rate1 to (source, source_size), one row a source.

    Sources by code point, null last, take the weights in turn. They share `share` of all sizes by weight; a
    target stops at `most` times its source's size and the excess is shared again by weight until none is above:
    with sources in order of the level at which each stops, the level of the rest follows from two running sums.
    The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("nth", F.row_number().over(order) - 1)
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = s.withColumns({"weight": pick(weights)} | {f"rate{k}": pick([schedule[i % len(schedule)][k] for i in range(len(weights))]) for k in (0, 1)})
    s = s.withColumn("stop", most * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("stop", "nth").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", (share * F.sum("source_size").over(every) - full) / rest)
    # the first source whose level is below its stop fixes the level of all after it
    s = s.withColumn("level", F.min(F.when(F.col("level") < F.col("stop"), F.struct("stop", "nth", "level"))).over(every)["level"])
    target = F.when(F.col("stop") > F.col("level"), F.col("level") * F.col("weight")).otherwise(most * F.col("source_size"))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"), "rate0", "rate1")


def time_of(share: Column, rate0: Column, rate1: Column) -> Column:
    """When (0 to 1) a source has served this share of its demand: the inverse of its integrated linear schedule."""
    mean, slope = (rate0 + rate1) / 2, (rate1 - rate0) / 2
    # slope t^2 + rate0 t = share * mean, solved in the form that also holds for slope 0
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share * mean / (rate0 + F.sqrt(F.greatest(rate0 * rate0 + 4 * slope * share * mean, F.lit(0.0)))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each document: doc_id, source, h, size, source_size, target, taken, positions (array of double).

    A source's documents are ordered by a hash of identifier and text, and laid end to end `most` times; the
    mix takes what lies below the source's target, whole documents by their middle, so that a source misses its
    target by half a document at most. A copy's training position is the time at which its source's demand
    reaches its middle. Sums before a document are those of the hash buckets before and of the rows before in
    its bucket, so that a source with a third of all rows is ordered by many tasks.

    Null and blank texts have size 0 and are never taken. Null sources are one source, the last. Repeated rows
    are rows of their own; equal rows are interchangeable. An empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), dealt(F.col(id_col), F.col(text_col)).alias("h"))
    rows = stored(rows)
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = stored(targets(by_source, weights, share, float(most)).join(by_source.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    # bucket 0 .. buckets-1 by the hash's place in its range; a source has about a bucket for each BUCKET_ROWS rows
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.floor(F.col("h") / F.lit(float(1 << 60)) * buckets))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("below"))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("middle", F.col("below") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2)
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.col("middle") + k * F.col("source_size"))
    at = F.filter(at, lambda m: (m < F.col("target")) & (F.col("size") > 0))
    rows = rows.withColumn("at", at)
    return rows.select("doc_id", "source", "h", "size", "source_size", "target", (F.size("at") * F.col("size")).cast("long").alias("taken"), F.transform("at", lambda m: time_of(m / F.col("target"), F.col("rate0"), F.col("rate1"))).alias("positions"))


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The documents in training order: a row for each copy that the mix takes, with all columns of `docs`,
    range-partitioned and sorted by position, then by identifier and text. Rows equal in identifier, text and source
    are one document here, taken as often as all of them together, with the columns of the row that has the least
    hash of all its columns. Null texts and sources are documents and a source like others; an empty table gives none."""
    p = free_prefix(docs, "mix_")
    plan = mix(docs, id_col, text_col, source_col, **options)
    named = lambda i, s, h: {f"{p}id": F.coalesce(i.cast("string"), F.lit("")), f"{p}no": F.coalesce(i.isNull().cast("int") + 2 * s.isNull().cast("int"), F.lit(0)), f"{p}of": F.coalesce(s.cast("string"), F.lit("")), f"{p}h": h}
    keys = [f"{p}{k}" for k in ("id", "no", "of", "h")]
    copies = plan.select(*[c.alias(k) for k, c in named(F.col("doc_id"), F.col("source"), F.col("h")).items()], F.explode("positions").alias(f"{p}at"))
    one = docs.withColumns(named(F.col(id_col), F.col(source_col), dealt(F.col(id_col), F.col(text_col))))
    first = Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
    one = one.withColumn(f"{p}nth", F.row_number().over(first)).where(F.col(f"{p}nth") == 1)
    order = [f"{p}at", f"{p}id", f"{p}h", f"{p}of"]
    return one.join(copies, keys).repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: size, source_size, target and taken of every document, and the training positions of the copies that the
    mix takes (position the first, again the second), range-sorted by the first; what isn't taken comes last."""
    plan = mix(read(spark, sf_dir, "documents"))
    at = [F.round(F.try_element_at("positions", F.lit(k)), 6).alias(n) for k, n in ((1, "position"), (2, "again"))]
    return plan.select("doc_id", "size", "source_size", "target", "taken", *at).orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: The same in DuckDB's SQL. The middle of a copy must lie below the target; its time is the schedule's inverse.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
s1 AS (SELECT *, [3.0, 1.0, 2.0][nth % 3 + 1]::DOUBLE AS w, [0.5, 1.5, 1.0][nth % 3 + 1]::DOUBLE AS r0, [1.5, 0.5, 1.0][nth % 3 + 1]::DOUBLE AS r1 FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size / w AS stop FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY stop, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY stop, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
lv AS (SELECT level FROM s3 WHERE level < stop ORDER BY stop, nth LIMIT 1),
s4 AS (SELECT source, source_size, r0, r1, CASE WHEN stop > (SELECT level FROM lv) THEN (SELECT level FROM lv) * w ELSE 2.0::DOUBLE * source_size END AS target FROM s3),
m AS (
  SELECT d.doc_id, d.size, s4.source_size, s4.target, r0, r1,
         (coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE)::DOUBLE AS middle
  FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target,
       size * ((size > 0 AND middle < target)::BIGINT + (size > 0 AND middle + source_size < target)::BIGINT) AS taken,
       CASE WHEN size > 0 AND middle < target THEN
         round(2 * (middle / target) * ((r0 + r1) / 2) / (r0 + sqrt(greatest(r0 * r0 + 4 * ((r1 - r0) / 2) * (middle / target) * ((r0 + r1) / 2), 0.0))), 6) END AS position,
       CASE WHEN size > 0 AND middle + source_size < target THEN
         round(2 * ((middle + source_size) / target) * ((r0 + r1) / 2) / (r0 + sqrt(greatest(r0 * r0 + 4 * ((r1 - r0) / 2) * ((middle + source_size) / target) * ((r0 + r1) / 2), 0.0))), 6) END AS again
FROM m
"""
