"""Repository tables derived from the driver's tables, the same in both engines (SQL twins in oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import content_hash
from .operators.classify import with_role
from .operators.components import component_key

EXTENSIONS = [".go", ".py", "_test.go", ".md", ".sql", ".proto", ".lock", ".yaml"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _paths(docs: DataFrame) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    folder = F.concat(F.lit("services/"), F.col("source"), F.lit("/"), F.col("lang"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    path = F.when(F.col("doc_id") % 97 == 0, F.concat(folder, F.lit("/"), name, F.lit("/go.mod"))).when(F.col("doc_id") % 50 == 0, F.concat(name, ext)).otherwise(F.concat(folder, F.lit("/"), name, ext))
    return docs.withColumn("path", path)


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries with their content: doc_id, path, mode, data, size. All documents are there; one in 13 lies in another
    folder than before, so that its old path is gone."""
    docs = _paths(table(spark, sf_dir, "documents"))
    docs = docs.withColumn("path", F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("fresh/"), "path")).otherwise(F.col("path")))
    mode = F.when(F.col("doc_id") % 101 == 0, "160000").when(F.col("doc_id") % 103 == 0, "100600").when(F.col("doc_id") % 3 == 0, "100755").otherwise("100644")
    return docs.select("doc_id", "path", mode.alias("mode"), F.col("text").alias("data"), F.octet_length("text").cast("long").alias("size"), "source", "lang")


def _owned(files: DataFrame) -> DataFrame:
    files = with_role(files).withColumn("triggers", ~F.col("role").isin("test", "lock_file", "prose", "fixture", "generated_code"))
    return component_key(files)


def files_cur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current files: doc_id, path, data, size, source_hash, role, triggers, component_key, root_component."""
    return _owned(tracked(spark, sf_dir)).withColumn("source_hash", content_hash(F.col("data"))).select("doc_id", "path", "data", "size", "source_hash", "role", "triggers", "component_key", "root_component")


def files_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the state before, all documents too: some had another content, owner or folder."""
    docs = _paths(table(spark, sf_dir, "documents"))
    files = _owned(docs.select("doc_id", "path", F.col("text").alias("data"), F.octet_length("text").cast("long").alias("size")))
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("data", F.lit("x"))).otherwise(F.col("data"))
    moved = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("retired/"), "path")).when(F.col("doc_id") % 19 == 0, F.concat(F.lit("legacy/"), "path")).otherwise(F.col("path"))
    key = F.when(F.col("doc_id") % 17 == 0, "services/src0").otherwise(F.col("component_key"))
    root = F.col("root_component") & (F.col("doc_id") % 17 != 0)
    return files.select("doc_id", moved.alias("path"), content_hash(text).alias("source_hash"), "size", "role", "triggers", key.alias("component_key"), root.alias("root_component"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: component_key, section, title, description, path (evidence, one a row)."""
    docs = _paths(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.col("source").alias("component_key"), F.col("lang").alias("section"), F.concat(F.lit("T"), (F.col("doc_id") % 40).cast("string")).alias("title"), F.concat(F.lit("D"), (F.col("doc_id") % 60).cast("string")).alias("description"), "path")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("kind"))
