"""What goes wrong only where tables are large or plans are adapted while they run."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom import planning_queries
from tallyloom.operators import components, fragments, packing
from tallyloom.queries import ORACLES, QUERIES
from tallyloom.sources.tables import stored

KEY = ["component_key", "root_component"]


@pytest.fixture
def adapted(spark):
    """Joins that are planned by sorting and become broadcasts while they run, their other side read by mapper, in several tasks."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield spark
    for k in names:
        spark.conf.unset(k)


def test_a_component_is_walked_by_one_task(adapted, tmp_path):
    rows = adapted.range(0, 400, 1, 8).select(F.concat(F.lit("c"), F.col("id") % 1).alias("component_key"), F.lit(False).alias("root_component"), F.format_string("p%03d", "id").alias("path"), F.lit(1).cast("long").alias("size"), (F.col("id") % 100 == 0).alias("triggers"))
    rows.write.parquet(str(tmp_path / "files"))
    own = components.supporting(adapted.read.parquet(str(tmp_path / "files")).repartition(8))
    assert packing.first_fit(own, 10).select("selected", "bytes", "omitted").collect() == [(10, 10, 386)]
    assert packing.greedy_batches(own, 50).agg(F.max("batch")).first()[0] == 8


def test_an_input_hash_has_the_context_of_one_walk(adapted, tmp_path):
    """The context that counts is what fits a component's bytes once, not once in each task that has some of its files."""
    text = F.concat(F.repeat(F.lit("word "), 400), F.col("id").cast("string"))
    docs = adapted.range(0, 400, 1, 8).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length(text).cast("long").alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    names = [*KEY, "input_hash"]
    got = {tuple(r) for r in QUERIES["input_hash"](adapted, str(tmp_path)).select(*names).collect()}
    assert got == set(con.sql(f"select {', '.join(names)} from ({ORACLES['input_hash']})").fetchall())


@pytest.mark.parametrize("name", ["input_hash", "component_actions"])
def test_a_component_of_texts_that_are_null_has_no_hash(spark, tmp_path, name):
    """Alone in its component (every 97th document) a null text leaves no digest; beside others (services/src0) it is only counted."""
    text = F.when(~F.col("id").isin(3, 97, 1067), F.concat(F.lit("word "), F.col("id").cast("string")))
    spark.range(1070).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length(text).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(ORACLES[name])
    got = {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*sql.columns).collect()}
    assert got == set(sql.fetchall())


def test_more_scopes_than_a_section_holds(spark, tmp_path, monkeypatch):
    """Each scope's item counts, beyond the 100 of a dossier's section, and b10 comes before b2."""
    text = F.concat(F.repeat(F.lit("word "), 100), F.lit("\n"))
    spark.range(220).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("src0").alias("source"), F.length(text).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(planning_queries, "_LIMIT", 600)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in QUERIES["fragment_bodies"](spark, str(tmp_path)).collect()}
    assert got == set(con.sql(ORACLES["fragment_bodies"].replace("200000", "600")).fetchall()) and max(r[2] for r in got) > 100


def test_parts_come_in_small_batches(spark, monkeypatch):
    """What a task gathers is bounded by bytes, not by the rows of a batch."""
    monkeypatch.setattr(packing, "HELD_BYTES", 1000)
    sizes = []
    make = pa.RecordBatch.from_arrays
    monkeypatch.setattr(packing, "pa", type("Spy", (), {k: getattr(pa, k) for k in ("DataType", "int32", "binary", "array")} | {"RecordBatch": type("B", (), {"from_arrays": staticmethod(lambda a, names: sizes.append(len(a[0])) or make(a, names=names))})}))
    runs = []
    rows = spark.createDataFrame([("a", "x\n" * 300)], "path string, data string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: runs.append(run))
    packing.newline_chunks(rows, 100)
    list(runs[0](iter([pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(50)], "data": ["x\n" * 300] * 50})])))
    assert len(sizes) > 20 and sum(sizes) == 300 and max(sizes) <= 12


def test_a_scope_is_kept_once_for_all_its_calls(spark, monkeypatch):
    """Its content is not written for each kind, nor again for repairs."""

    def checked(answers, kinds, evidence, catalog, keep):  # the rules take long and are tested elsewhere
        wrong = answers.where("body = '{'").select("request_id", F.lit(0).alias("place"), F.lit("invalid_json").alias("code"), F.lit("").alias("path"))
        return wrong, evidence.limit(0)

    monkeypatch.setattr(fragments, "_checked", checked)
    text, kept = "word " * 40_000, []
    scope = "component_key string, root_component boolean, batch int, batch_count int, chunk int, chunk_count int, split_path string, path string, data string"
    rows = spark.createDataFrame([("a", False, 1, 1, 1, 1, "b1/c1", "x.go", text)], scope)

    def keep(df):
        got = stored(df)
        kept.append(got.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0)
        return got

    got = fragments.mapped(rows, rows.select("component_key"), planning_queries._rough_call, keep, 80, 0)
    assert got.calls.agg(F.sum("calls"), F.sum("repaired")).first()[:] == (9, 2)
    assert len(text) < sum(kept) < 2 * len(text)
