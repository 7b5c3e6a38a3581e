"""Runs after runs from what the one before wrote, reasons for a full run, the context in hashes and requests, and limits."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import components, fragments, planning
from tallyloom.plans import lifecycle
from tallyloom.plans.lifecycle import Prior, Settings
from tallyloom.sources.journal import FileTree
from tallyloom.sources.sinks import VersionedStore
from tallyloom.sources.tables import stored

TREE = [("main.go", "package main"), ("services/api/a.go", "package api"), ("services/api/a_test.go", "package api // test"), ("go.mod", "module x"), ("README.md", "hi")]


def tree(spark, rows):
    return spark.createDataFrame([(p, "100644", t, len(t)) for p, t in rows], "path string, mode string, data string, size long")


def names(df):
    return {r["component_key"]: r["action"] for r in df.collect()}


@pytest.mark.parametrize("kind", [VersionedStore, FileTree])
def test_runs_follow_each_other(spark, tmp_path, kind):
    store = kind(spark, str(tmp_path / "store"))
    assert lifecycle.prior(store).status == "missing"
    p, diff = lifecycle.sync(tree(spark, TREE), store, state=lifecycle.prior(store))
    assert p.reason == "state_missing" and names(p.actions) == {"@root": "create", "services/api": "create"} and diff.count() == 11
    first = lifecycle.prior(store)
    assert first.status == "valid" and first.compatible() and first.files.count() == 5 and {r["document"] for r in first.components.collect()} == {"docs/components/@root/index.md", "docs/components/services/api/index.md"}
    again, none = lifecycle.sync(tree(spark, TREE), store, state=lifecycle.prior(store))
    assert again.reason is None and none is None and again.actions.count() == 0
    owned = stored(store.read().select("path", "hash"))
    lifecycle.check(tree(spark, TREE), store, owned, state=lifecycle.prior(store))
    edited = [(p, t + " // more" if p == "services/api/a.go" else t) for p, t in TREE]
    with pytest.raises(lifecycle.StaleError, match="sources changed"):
        lifecycle.check(tree(spark, edited), store, owned, state=lifecycle.prior(store))
    p, diff = lifecycle.sync(tree(spark, edited), store, state=lifecycle.prior(store))
    assert names(p.actions) == {"services/api": "regenerate"}
    then = lifecycle.prior(store)
    hashes = lambda s: {r["component_key"]: r["input_hash"] for r in s.components.collect()}
    assert hashes(then)["@root"] == hashes(first)["@root"] and hashes(then)["services/api"] != hashes(first)["services/api"]
    assert lifecycle.sync(tree(spark, edited), store, state=then)[1] is None


def test_a_file_without_content_is_empty(spark):
    """Its component has a hash like any other: without one it would count as gone."""
    rows = spark.createDataFrame([("services/api/a.go", "100644", None, 0), ("main.go", "100644", "package main", 12)], "path string, mode string, data string, size long")
    assert names(lifecycle.plan(rows, None, None).actions) == {"@root": "create", "services/api": "create"}


def test_reasons_and_selection(spark):
    s = Settings()
    frames = [spark.createDataFrame([], schema) for schema in (lifecycle.STATE_FILES, lifecycle.STATE_COMPONENTS)]
    kept = lambda **other: Prior(**({"status": "valid", "files": frames[0], "components": frames[1], "versions": lifecycle.VERSIONS, "hashes": s.hashes()} | other))
    reason = lambda state, full=False, base=True, settings=s: lifecycle.full_run_reason(state, settings, full, base)
    assert reason(kept(), full=True) == "explicit_full" and reason(kept(), base=False) == "base_revision_unavailable" and reason(Prior()) == "state_missing" and reason(Prior("invalid")) == "state_invalid"
    assert reason(kept(versions=lifecycle.VERSIONS | {"prompt_version": "0"})) == "state_incompatible" and reason(kept(), settings=Settings(docs_dir="other")) == "output_paths_changed" and reason(kept()) is None
    assert kept().impact(Settings(call_limit=99)) == {"generation"} and kept(hashes={"aggregate": "x"}).impact(s) == {"unknown"} and kept(hashes={}).impact(s) == {"unknown"}
    first = lifecycle.plan(tree(spark, TREE), None, None)
    state = kept(files=first.files.drop("data", "size"), components=stored(first.hashes))
    for settings, why in ((Settings(call_limit=99), "generation_configuration_changed"), (Settings(batch_bytes=9), "context_configuration_changed")):
        p = lifecycle.plan(tree(spark, TREE), None, None, settings, state=state)
        assert {r["component_key"]: r["reasons"] for r in p.selected.collect()} == {"@root": [why], "services/api": [why]} and set(names(p.actions).values()) == {"regenerate"}
    # a feed of version control is taken as it is
    feed = spark.createDataFrame([("modified", None, "main.go")], "status string, old_path string, new_path string")
    assert names(lifecycle.plan(tree(spark, TREE), None, None, state=state, feed=feed).actions) == {"@root": "regenerate"}
    # a supporting file that is gone selects its owner only where the source settings differ
    fewer = [r for r in TREE if not r[0].endswith("_test.go")]
    from tallyloom.operators.classify import SourcePolicy

    assert lifecycle.plan(tree(spark, fewer), None, None, state=state).actions.count() == 0
    other = Settings(policy=SourcePolicy(docs_dir="docs", exclude=("nothing/**",)))
    assert "source_policy_changed" in {r["component_key"]: r["reasons"] for r in lifecycle.plan(tree(spark, fewer), None, None, other, state=state).selected.collect()}["services/api"]


def test_what_the_hash_depends_on(spark):
    row = lambda path, key, role="production_source", triggers=True, data="x": (path, role, "sha256:" + "0" * 64, triggers, key, key == "@root", data, len(data))
    schema = "path string, role string, source_hash string, triggers boolean, component_key string, root_component boolean, data string, size long"
    base = [row("a/x.go", "a"), row("a/x_test.go", "a", "test", False), row("a/y_test.go", "a", "test", False, "y" * 90), row("b/z.go", "b"), row("go.mod", "@root", "dependency_manifest"), row("main.go", "@root")]
    norm = spark.createDataFrame([], "status string, old_path string, new_path string, old_role string, new_role string, old_key string, new_key string, old_root boolean, new_root boolean, old_triggers boolean, new_triggers boolean")

    def hashes(rows, changed=norm, budget=50):
        files = spark.createDataFrame(rows, schema)
        return {r["component_key"]: r["input_hash"] for r in components.input_hash(files, ("1",), "c", components.context(files, budget, 50), changed).collect()}

    now = hashes(base)
    assert set(now) == {"a", "b", "@root"} and now == hashes(base[::-1])
    differ = lambda other: {k for k in now if other.get(k) != now[k]}
    assert differ(hashes([*base, row("c/n.go", "c")])) == {"a", "b", "@root"}  # the catalogue
    assert differ(hashes([row("a/x.go", "a", data="other"), *base[1:]])) == {"a"}
    assert differ(hashes([base[0], row("a/x_test.go", "a", "test", False, "t"), *base[2:]])) == {"a"}  # supporting, within its bytes
    assert differ(hashes([*base[:2], row("a/y_test.go", "a", "test", False, "z" * 90), *base[3:]])) == set()  # beyond them
    assert differ(hashes(base, budget=500)) == {"a"}
    assert differ(hashes([*base[:4], row("go.mod", "@root", "dependency_manifest", data="m"), base[5]])) == {"a", "b", "@root"}  # a manifest at the top
    one = spark.createDataFrame([("modified", "", "b/z.go", "", "test", "", "b", False, False, False, True)], norm.schema)
    assert differ(hashes(base, one)) == {"b"}


def test_context_reaches_requests(spark, tmp_path):
    seen = []
    log = str(tmp_path / "seen")

    def call(request):
        with open(log, "a") as f:
            f.write(request.replace("\n", " ") + "\n")
        return fragments.typed_stub(request)

    state = None
    lifecycle.sync(tree(spark, TREE), VersionedStore(spark, str(tmp_path / "store")), call=call, state=state)
    with open(log) as f:
        seen = [json.loads(line) for line in f]
    api = next(r for r in seen if r["component_key"] == "services/api")
    assert [(c["kind"], c["path"], c["data"]) for c in api["context"]] == [("manifest", "go.mod", "module x"), ("supporting", "services/api/a_test.go", "package api // test")]
    assert [f["path"] for f in api["files"]] == ["services/api/a.go"]


def test_ceiling_and_profile(spark):
    settings = Settings(strategy="fragments", call_limit=17)
    p = lifecycle.plan(tree(spark, TREE), None, None, settings)
    none = lambda request: pytest.fail("called")
    with pytest.raises(planning.CallCeilingError, match="may take 18 calls, more than the limit of 17"):
        lifecycle.generated(p, settings, stored, none)
    auto = Settings(strategy="auto", call_limit=19)
    with pytest.raises(planning.CallCeilingError, match="may take 20 calls"):
        lifecycle.generated(lifecycle.plan(tree(spark, TREE), None, None, auto), auto, stored, none)
    weak = Settings(strategy="auto", output_tokens=10)
    with pytest.raises(lifecycle.GenerationError, match="output tokens"):
        lifecycle.generated(lifecycle.plan(tree(spark, TREE), None, None, weak), weak, stored, none)


SCOPES = "component_key string, root_component boolean, batch int, batch_count int, chunk int, chunk_count int, split_path string, path string, data binary"


def calls_of(got):
    return {r["component_key"]: (r["calls"], r["repairs"]) for r in got.stats.collect()}


def test_one_budget_for_everything(spark):
    rows = spark.createDataFrame([("a", False, 1, 1, 1, 1, "b1/c1", "x.go", bytearray(b"t"))], SCOPES)

    def call(request):  # every kind and both reducers need a repair
        body, end = fragments.typed_stub(request)
        return (body if "repair_of" in json.loads(request) else "[]"), end

    limit = lambda n: fragments.by_fragments(rows, rows, call, stored, limit=n, depth=0)
    whole = limit(18)
    assert calls_of(whole) == {"a": (18, 9)} and whole.failures.count() == 0
    for n in (17, 8):
        got = limit(n)
        assert [r["category"] for r in got.failures.collect()] == ["call_limit"] and got.dossiers.count() == 0 and calls_of(got)["a"][0] == n, n


def test_auto_shares_the_budget(spark):
    rows = spark.createDataFrame([("cut", False, 1, 1, 1, 1, "b1/c1", "x.go", bytearray(b"t")), ("fine", False, 1, 1, 1, 1, "b1/c1", "y.go", bytearray(b"t")), ("wide", False, 1, 1, 1, 1, "b1/c1", "z.go", bytearray(b"t"))], SCOPES)
    batches = rows.select("component_key", "root_component", F.lit(1).alias("batch"), "path", "data").where("component_key <> 'wide'")

    def call(request):
        asked = json.loads(request)
        body, end = fragments.typed_stub(request)
        return body, "length" if asked["kind"] == "dossier" and asked["component_key"] == "cut" else end

    got = fragments.automatic(batches, rows, rows, call, stored, limit=10, depth=0)
    assert calls_of(got) == {"cut": (10, 0), "fine": (1, 0), "wide": (9, 0)} and got.failures.count() == 0 and got.dossiers.count() == 3
    few = fragments.automatic(batches, rows, rows, call, stored, limit=9, depth=0)
    assert [tuple(r) for r in few.failures.collect()] == [("cut", False, "call_limit")] and calls_of(few)["cut"][0] == 9


