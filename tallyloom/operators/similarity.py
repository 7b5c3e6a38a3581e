"""Renames of files that are similar but not equal.

A file is the bag of its pieces: lines, and of longer lines pieces of 64 bytes. Similarity is the bytes that two bags share,
of 100 parts of the larger file. Pieces are ordered by how rare they are; two files that share half of their bytes share a
piece among the rarest that make up the other half of each, so only those meet in a join. Of all pairs the best are taken
one by one: in each round all pairs that are the best of both their files, until none is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import basename

PIECE_BYTES = 64
#: Files are a rename from this similarity on.
LEAST = 50


def pieces(data: Column) -> Column:
    """The pieces of a text, as strings of a character a byte."""
    raw = F.decode(F.encode(data, "utf-8"), "iso-8859-1")
    return F.regexp_extract_all(raw, F.lit(rf"([^\n]{{0,{PIECE_BYTES - 1}}}\n|[^\n]{{{PIECE_BYTES}}}|[^\n]+)"), F.lit(1))


def bags(files: DataFrame) -> DataFrame:
    """path, size, piece (64 bits of it), weight (its bytes in the file)."""
    rows = files.select("path", F.octet_length("data").alias("size"), F.explode(pieces(F.col("data"))).alias("x"))
    return rows.groupBy("path", "size", F.xxhash64("x").alias("piece")).agg(F.sum(F.length("x")).alias("weight"))


def similar_pairs(gone: DataFrame, new: DataFrame, keep: Callable[[DataFrame], DataFrame], least: int = LEAST) -> DataFrame:
    """old_path, new_path, similarity of all pairs of a file that is gone and one that is new (path, data) with at least
    that similarity. Empty files have none."""
    both = keep(bags(gone).withColumn("side", F.lit(0)).unionByName(bags(new).withColumn("side", F.lit(1))))
    common = both.groupBy("piece").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("n"))
    # a piece of one side only makes no pair, but it counts among a file's bytes
    ranked = both.join(common, "piece").withColumn("df", F.col("g") + F.col("n"))
    before = F.coalesce(F.sum("weight").over(Window.partitionBy("side", "path").orderBy("df", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rare = ranked.withColumn("before", before).where((F.col("g") > 0) & (F.col("n") > 0) & (100 * (F.col("size") - F.col("before")) >= least * F.col("size")))
    rare = keep(rare.select("side", "path", "size", "piece"))
    side = lambda df, s, name: df.where(F.col("side") == s).select(F.col("path").alias(f"{name}_path"), F.col("size").alias(f"{name}_size"), "piece", *(["weight"] if "weight" in df.columns else []))
    fits = 100 * F.least("old_size", "new_size") >= least * F.greatest("old_size", "new_size")
    met = side(rare, 0, "old").join(side(rare, 1, "new"), "piece").where(fits).select("old_path", "new_path").distinct()
    shared = met.join(side(both, 0, "old"), "old_path").join(side(both, 1, "new").withColumnRenamed("weight", "other"), ["new_path", "piece"])
    score = F.floor(100 * F.sum(F.least("weight", "other")) / F.greatest(F.first("old_size"), F.first("new_size"))).cast("int")
    return shared.groupBy("old_path", "new_path").agg(score.alias("similarity")).where(F.col("similarity") >= least)


def matched(pairs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs that remain if the best is taken, its files are struck out, and so on: by similarity, then equal base
    names, then paths. Each round takes all pairs that are first for both of their files at once, which is the same."""
    order = [F.col("similarity").desc(), F.col("other_name"), F.col("old_path"), F.col("new_path")]
    left = keep(pairs.withColumn("other_name", (basename(F.col("old_path")) != basename(F.col("new_path"))).cast("int")))
    out = None
    while not left.isEmpty():
        first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(*order))
        taken = keep(left.withColumns({"a": first("old_path"), "b": first("new_path")}).where("a = 1 and b = 1").select("old_path", "new_path", "similarity"))
        out = taken if out is None else out.unionByName(taken)
        left = keep(left.join(taken.select("old_path"), "old_path", "left_anti").join(taken.select("new_path"), "new_path", "left_anti"))
    return pairs.limit(0) if out is None else out


def equal_renames(gone: DataFrame, new: DataFrame) -> DataFrame:
    """old_path, new_path, similarity 100 of files (path, source_hash) of equal content, first those of one base name, then
    the rest in path order; a numbering within each content, so that copies make no pairs of each with each."""
    def numbered(df: DataFrame, c: str, by: list[str]) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(c)))

    old = gone.select("source_hash", F.col("path").alias("old_path"), basename(F.col("path")).alias("name"))
    cur = new.select("source_hash", F.col("path").alias("new_path"), basename(F.col("path")).alias("name"))
    by = ["source_hash", "name"]
    named = numbered(old, "old_path", by).join(numbered(cur, "new_path", by), [*by, "nth"]).select("old_path", "new_path")
    rest_old, rest_new = old.join(named, "old_path", "left_anti"), cur.join(named, "new_path", "left_anti")
    others = numbered(rest_old, "old_path", ["source_hash"]).join(numbered(rest_new, "new_path", ["source_hash"]), ["source_hash", "nth"]).select("old_path", "new_path")
    return named.unionByName(others).withColumn("similarity", F.lit(100))


def renames(old: DataFrame, cur: DataFrame, keep: Callable[[DataFrame], DataFrame], least: int = LEAST) -> DataFrame:
    """old_path, new_path, similarity of files (path, source_hash, data) that are gone and new under another path: equal
    ones first, then those with at least `least` of 100 parts in common, each file once."""
    gone, new = keep(old.join(cur, "path", "left_anti").select("path", "source_hash", "data")), keep(cur.join(old, "path", "left_anti").select("path", "source_hash", "data"))
    exact = keep(equal_renames(gone, new))
    rest_old = gone.join(exact.select(F.col("old_path").alias("path")), "path", "left_anti")
    rest_new = new.join(exact.select(F.col("new_path").alias("path")), "path", "left_anti")
    return exact.unionByName(matched(similar_pairs(rest_old, rest_new, keep, least), keep))
