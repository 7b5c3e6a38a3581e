"""Configuration, prompts, reports, scopes and generation."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import dossiers, fragments, planning
from tallyloom.sources import config, printer, prompts
from tallyloom.sources.tables import stored

KEY = ["component_key", "root_component"]
SOURCES = "component_key string, root_component boolean, path string, data string"


def test_layers():
    text = json.dumps({"docs_dir": "from/file", "source": {"tests": {"include": False}}, "llm": {"model": "file", "retries": 0}})
    got = config.load(text, {"TALLYLOOM_LLM_MODEL": " env ", "TALLYLOOM_LLM_API_KEY": "x", "TALLYLOOM_BASE_REVISION": "a"}, {"runtime.base_revision": "b", "docs_dir": ""})
    assert (got["docs_dir"], got["llm"]["model"], got["runtime"]["base_revision"], got["runtime"]["credential_present"], got["source"]["tests"]["include_as_context"]) == ("from/file", "env", "b", True, False)
    assert config.load(None, {})["components"]["max_batch_bytes"] == 80_000 and config.load("", {}) == config.load(None, {})
    assert config.policies(got)["generation"]["transport_retries"] == 0
    for bad in ('{"odd":1}', '{"llm":{"odd":1}}', "[1]", '{"docs_dir":1}', '{"llm":3}', "{"):
        with pytest.raises(config.ConfigError):
            config.load(bad, {})


@pytest.mark.parametrize(
    ("path", "value", "start"),
    [("version", 2, "version"), ("docs_dir", " ", "docs_dir"), ("source.include", [], "source.include"), ("source.max_file_bytes", 0, "source.max_file_bytes"), ("source.role_overrides", [{"role": "poem"}], "source.role_overrides"), ("components.strategy", "odd", "components.strategy"), ("components.strategy", "explicit", "components.roots"), ("components.max_diff_bytes", 0, "components.max_diff_bytes"), ("components.max_batch_bytes", 130_000, "components.max_batch_bytes"), ("components.roots", ["a", " a"], "components.roots[1]: duplicate"), ("components.roots", [""], "components.roots[0]"), ("documentation.profile", "x", "documentation.profile"), ("documentation.audience", "x", "documentation.audience"), ("documentation.generation_strategy", "x", "documentation.generation_strategy"), ("llm.provider", "x", "llm.provider"), ("llm.api_mode", "x", "llm.api_mode"), ("llm.temperature", 3, "llm.temperature"), ("llm.max_output_tokens", 0, "llm.max_output_tokens"), ("llm.max_response_bytes", 0, "llm.max_response_bytes"), ("llm.structured_output_mode", "x", "llm.structured"), ("llm.timeout", "0s", "llm.timeout"), ("llm.timeout", "soon", "llm.timeout"), ("llm.retries", -1, "llm.retries"), ("llm.concurrency", 0, "llm.concurrency"), ("llm.fragment_call_limit_per_component", 0, "llm.fragment_call"), ("llm.fragment_split_depth", 99, "llm.fragment_split_depth"), ("publishing.provider", "x", "publishing.provider")],
)
def test_rules_of_the_configuration(path, value, start):
    with pytest.raises(config.ConfigError, match=f"^{start.replace('[', chr(92) + '[')}"):
        config.load(None, {}, {path: value} if value not in ("", 0) else None) if value not in ("", 0) else config.load(json.dumps(_nested(path, value)), {})


def _nested(path, value):
    for part in reversed(path.split(".")):
        value = {part: value}
    return value


def test_options():
    assert config.options("plan", " json ") == {"command": "plan", "output": "json", "base": "", "head": "", "full": False} and config.options("sync", "")["output"] == "human"
    for bad in ({"output": "xml"}, {"head": "a"}, {"base": "a", "full": True}):
        with pytest.raises(config.ConfigError):
            config.options("plan", **bad)


def test_prompts(spark):
    assert prompts.framed_digest(["ab", "c"]) != prompts.framed_digest(["a", "bc"])
    assert len({prompts.prompt_hash(s) for s in ("auto", "dossier", "fragments")}) == 3 and prompts.prompt_hash("auto") == prompts.content_hash()
    one = prompts.schema("interfaces")["properties"]["items"]
    assert one["maxItems"] == 2 and one["items"]["properties"]["direction"]["enum"] == ["inbound", "outbound", "internal"] and prompts.table(spark).count() == len(prompts.resources())


def test_reports(spark, tmp_path):
    at = tmp_path / "deep/report.json"
    printer.write_report(str(at), {"b": 1, "a": "é"})
    printer.write_report(str(at), {"b": 2})
    assert json.loads(at.read_text()) == {"b": 2} and [p.name for p in at.parent.iterdir()] == ["report.json"]
    with pytest.raises(TypeError):
        printer.write_report(str(at), {"b": object()})
    assert json.loads(at.read_text()) == {"b": 2} and len(list(at.parent.iterdir())) == 1


def test_scopes_are_refined_until_requests_fit(spark):
    files = spark.createDataFrame([("c", False, f"p{i}", "line\n" * 40) for i in range(6)] + [("d", False, "q", "l\n" * 500)], SOURCES).withColumn("size", F.octet_length("data").cast("long"))
    found = planning.refined_scopes(planning.source_scopes(files, 450), lambda n, b: b + n * 10, 300, stored)
    rows = planning.numbered_scopes(stored(found)).groupBy("component_key", "batch", "batch_count", "chunk", "chunk_count", "split_path").agg(F.sum(F.length("data")).alias("n")).collect()
    assert {(r["component_key"], r["split_path"], r["batch_count"], r["chunk_count"]) for r in rows} == {("c", f"b{i}/c1", 6, 1) for i in range(1, 7)} | {("d", f"b1/c{i}", 1, 5) for i in range(1, 6)}
    assert max(r["n"] for r in rows) <= 290 and sum(r["n"] for r in rows) == 2200
    one = spark.createDataFrame([("e", False, "x", "no break")], SOURCES).withColumn("size", F.lit(8).cast("long"))
    with pytest.raises(Exception, match="can't be split"):
        planning.refined_scopes(planning.source_scopes(one, 450), lambda n, b: b, 4, stored)
    with pytest.raises(Exception, match="no line break"):
        planning.source_scopes(one, 4).collect()


def test_fragments_end_to_end(spark):
    rows = spark.createDataFrame([("a", False, 1, 1, 1, 1, "b1/c1", "x.go", "text"), ("b", False, 1, 1, 1, 1, "b1/c1", "y.go", "text"), ("c", False, 1, 1, 1, 1, "b1/c1", "z.go", "text")], "component_key string, root_component boolean, batch int, batch_count int, chunk int, chunk_count int, split_path string, path string, data string").withColumn("data", F.encode("data", "utf-8"))

    def call(request):
        asked = json.loads(request)
        asked = json.loads(asked["repair_of"]) if "repair_of" in asked else asked
        body, end = fragments.typed_stub(request)
        if asked["component_key"] == "b" and asked["kind"] == "workflows":
            return body, "length"  # a required kind that is cut off
        if asked["component_key"] == "c" and asked["kind"] in ("overview", "diagrams"):
            return "[]", end  # reducers that fail fall back
        return body, end

    catalog = rows.select("component_key")
    got = fragments.by_fragments(rows, catalog, call, stored)
    assert [tuple(r) for r in got.failures.collect()] == [("b", False, "truncated")]
    made = {r["component_key"]: r for r in got.dossiers.collect()}
    assert set(made) == {"a", "c"} and made["a"]["source_paths"] == ["x.go"] and [d["type"] for d in made["a"]["diagrams"]] == ["flowchart"] and made["c"]["diagrams"] == []
    assert made["a"]["architecture"][0]["title"] == "Part b1/c1" and made["a"]["interfaces"][0]["source_paths"] == ["x.go"]
    stats = {r["component_key"]: (r["calls"], r["repairs"], r["overview_fallback"], r["diagram_fallback"]) for r in got.stats.collect()}
    assert stats["a"] == (9, 0, False, False) and stats["c"] == (11, 2, True, True)
    assert fragments.dossier_issues(got.dossiers, rows, catalog).count() == 0
    few = fragments.by_fragments(rows.where("component_key = 'a'"), catalog, call, stored, limit=3)
    assert [r["category"] for r in few.failures.collect()] == ["call_limit"] and few.dossiers.count() == 0


def test_scopes_are_halved(spark):
    text = "one\ntwo\nthree\nfour\n"
    rows = spark.createDataFrame([("a", False, 1, 1, 1, 1, "b1/c1", p, t) for p, t in (("x.go", text), ("y.go", "short"))] + [("b", False, 1, 1, 1, 1, "b1/c1", p, "flat") for p in ("v.go", "w.go")], "component_key string, root_component boolean, batch int, batch_count int, chunk int, chunk_count int, split_path string, path string, data string").withColumn("data", F.encode("data", "utf-8"))

    def call(request):
        asked = json.loads(request)
        body, end = fragments.typed_stub(request)
        if asked["kind"] in ("data_models", "workflows"):
            none = json.dumps({"complete": True, "omitted_count": 0, "items": []})
            long = len(asked["files"]) > 1 or len(asked["files"][0]["data"]) > 15
            if asked["kind"] == "workflows":
                return none, "length" if asked["component_key"] == "a" and long else "stop"
            return (body if asked["component_key"] == "b" else none), end  # a single data model saturates its list
        return body, end

    catalog = rows.select("component_key")
    got = fragments.by_fragments(rows, catalog, call, stored)
    states = {(r["component_key"], r["kind"], r["split_path"]): r["state"] for r in got.coverage.collect()}
    lines = {k[2]: v for k, v in states.items() if k[:2] == ("a", "workflows")}
    assert lines == {"b1/c1": "replaced", "b1/c1/0": "replaced", "b1/c1/1": "complete", "b1/c1/0/0": "complete", "b1/c1/0/1": "complete"}
    assert {k[2]: v for k, v in states.items() if k[:2] == ("b", "data_models")} == {"b1/c1": "replaced", "b1/c1/0": "saturated", "b1/c1/1": "saturated"}
    assert got.failures.count() == 0
    made = {r["component_key"]: r for r in got.dossiers.collect()}
    assert len(made["b"]["data_models"]) == 1 and made["b"]["data_models"][0]["source_paths"] == ["v.go", "w.go"]
    calls = {r["component_key"]: r["calls"] for r in got.stats.collect()}
    assert calls == {"a": 9 + 4, "b": 9 + 2}
    # no level left, no call left
    flat = fragments.mapped(rows, catalog, call, stored, 80, 0)
    assert [tuple(r) for r in flat.failures.collect()] == [("a", False, "truncated")]
    few = fragments.mapped(rows, catalog, call, stored, 8, 3)
    assert sorted(tuple(r) for r in few.failures.collect()) == [("a", False, "call_limit"), ("b", False, "call_limit")]


def test_profiles():
    assert fragments.profile({"architecture": 2048, "diagrams": 99}) == {"canonical_bytes": 3912, "repair_bytes": 2048 + 6 * 8192 + 50 * (6 * 576 + 64), "output_tokens": 8192, "response_bytes": 8192}
    assert [fragments.canonical_bytes(fragments.largest_fragment(k)) for k in ("overview_candidate", "diagrams")] == [1572, 3815]
    assert dossiers.FRAGMENT_ITEMS == {"architecture": 2, "interfaces": 2, "data_models": 1, "workflows": 1, "dependencies": 2, "review_gaps": 2, "diagrams": 1}
    needed = fragments.profile({"interfaces": 3000})
    assert fragments.profile_problems(needed, 8192, 65_536, 500_000) == [] and len(fragments.profile_problems(needed, 10, 10, 10)) == 3
    for kind in [*dossiers.FRAGMENT_ITEMS, "overview_candidate"]:
        assert fragments.canonical_bytes(fragments.largest_fragment(kind)) <= dossiers.MOST_FRAGMENT_BYTES


def test_the_largest_fragments_are_valid(spark):
    paths = fragments.largest_fragment("overview_candidate")["source_paths"]
    for kind in ("interfaces", "data_models", "workflows", "review_gaps"):
        bodies = spark.createDataFrame([("k", json.dumps(fragments.largest_fragment(kind)))], "key string, body string")
        issues, used = dossiers.validated(bodies, "key", kind, spark.createDataFrame([("k", p) for p in paths], "key string, path string"), spark.createDataFrame([("c",)], "component_key string"))
        assert issues.collect() == [] and used.count() == len(paths)
