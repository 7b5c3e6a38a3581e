import pytest
from pyspark.sql import functions as F

from tallyloom.operators import changes, components, coverage, fragments, merge, output, packing, rendering, validation
from tallyloom.plans import lifecycle
from tallyloom.sources import generator, records
from tallyloom.sources.sinks import PreconditionError, VersionedStore
from tallyloom.streaming import events

FILES = "path string, role string, triggers boolean, size long"


def keys(spark, paths, roots=(), explicit=False):
    df = spark.createDataFrame([(p, "dependency_manifest" if p.endswith("go.mod") else "production_source") for p in paths], "path string, role string")
    return {r["path"]: (r["component_key"], r["root_component"]) for r in components.component_key(df, roots, explicit).collect()}


def test_component_keys(spark):
    got = keys(spark, ["main.go", "go.mod", "services/api/x/a.go", "services/a.go", "lib/a/b.go", "lib/sub/go.mod", "lib/sub/deep/x.go", "@root/x.go"])
    assert got == {"main.go": ("@root", True), "go.mod": ("@root", True), "services/api/x/a.go": ("services/api", False), "services/a.go": ("services", False), "lib/a/b.go": ("lib", False), "lib/sub/go.mod": ("lib/sub", False), "lib/sub/deep/x.go": ("lib/sub", False), "@root/x.go": ("@root", False)}
    got = keys(spark, ["a/b/c/x.go", "a/x.go", "z/x.go", "a/b/go.mod"], ("a", "a/b/c"), True)
    assert got == {"a/b/c/x.go": ("a/b/c", False), "a/x.go": ("a", False), "z/x.go": ("@root", True), "a/b/go.mod": ("a", False)}


def test_packing(spark):
    rows = [("c", False, f"p{i}", s) for i, s in enumerate([5, 9, 3, 4, 1])]
    df = spark.createDataFrame(rows, "component_key string, root_component boolean, path string, size long").repartition(3)
    assert [r["path"] for r in packing.fitted(df, 10).where("selected").orderBy("path").collect()] == ["p0", "p2", "p4"]
    r = packing.first_fit(df, 10).first()
    assert (r["selected"], r["bytes"], r["omitted"]) == (3, 9, 2)
    # many files of one component, in more than one batch of rows
    many = spark.range(30_000).select(F.lit("c").alias("component_key"), F.lit(False).alias("root_component"), F.format_string("p%06d", "id").alias("path"), (F.col("id") % 7 + 1).alias("size"))
    got = packing.greedy_batches(many, 10).groupBy("batch").agg(F.sum("size").alias("n"))
    assert got.where("n > 10").count() == 0 and got.count() == packing.greedy_batches(many, 10).agg(F.max("batch")).first()[0]
    got = {x["path"]: x["batch"] for x in packing.greedy_batches(df, 8, "alone").collect()}
    assert got == {"p0": 1, "p1": 2, "p2": 3, "p3": 3, "p4": 3}
    with pytest.raises(Exception, match="above the batch limit: p1"):
        packing.greedy_batches(df, 8).collect()


def test_cutting():
    assert packing.cut_at_newlines(b"ab\ncd\nef", 6) == [b"ab\ncd\n", b"ef"]
    assert packing.cut_at_newlines(b"abcdefg\n", 4) is None
    assert packing.cut_at_newlines(b"", 4) == [b""]
    assert packing.halves(b"a\nb\nc\nd") == (b"a\n", b"b\nc\nd")
    assert packing.halves(b"abcdef\nx") == (b"abcdef\n", b"x")
    assert packing.halves(b"abc") is None
    assert packing.halves_with_overlap(b"aa\nbb\ncc\ndd\n") == (b"aa\nbb\n", b"bb\ncc\ndd\n")


def test_merge_does_not_depend_on_order(spark):
    rows = [("c", "s", f"T{i % 7}", f"D{i % 5}", f"p{i % 11}") for i in range(200)]
    make = lambda r, n: merge.merged(spark.createDataFrame(r, "component_key string, section string, title string, description string, path string").repartition(n), ["title", "description"], ["component_key", "section"])
    pick = lambda m: [tuple(r) for r in merge.best_supported(m, ["component_key", "section"], "title", 4).orderBy("position").collect()]
    assert pick(make(rows, 1)) == pick(make(rows[::-1], 5))
    m = make([("c", "s", "T", "D", f"p{i:03}") for i in range(201)], 2).first()
    assert (m["support"], m["paths_omitted"], len(m["paths"])) == (201, 1, 200)


def test_conflicts_have_all_paths(spark):
    rows = [("c", "s", "T", f"D{i % 2}", f"p{i:03}") for i in range(500)]
    items = spark.createDataFrame(rows, "component_key string, section string, title string, description string, path string")
    found = merge.conflicts(items, ["title", "description"], ["component_key", "section"], F.lower("title")).orderBy("path").collect()
    assert [(r["identity"], r["contents"], r["path"]) for r in found] == [("t", 2, f"p{i:03}") for i in range(500)]


def test_changes(spark):
    schema = "path string, source_hash string, role string, triggers boolean, component_key string, root_component boolean"
    f = lambda p, h="h", k="c", t=True: (p, h, "production_source", t, k, False)
    old = spark.createDataFrame([f("same"), f("gone", k="dead"), f("edit", "1"), f("moved", "m"), f("own", k="a")], schema)
    cur = spark.createDataFrame([f("same"), f("edit", "2"), f("moved2", "m"), f("own", k="b"), f("new", "n", "fresh")], schema)
    ch = changes.snapshot_changes(old, cur)
    assert sorted((r["status"], r["old_path"] or "", r["new_path"] or "") for r in ch.collect()) == [("added", "", "moved2"), ("added", "", "new"), ("deleted", "gone", ""), ("deleted", "moved", ""), ("modified", "", "edit"), ("modified", "", "own")]
    both = changes.with_renames(ch, changes.renames(old, cur))
    assert ("renamed", "moved", "moved2") in [tuple(r) for r in both.collect()] and both.count() == 5
    got = {r["component_key"]: r["reasons"] for r in changes.affected(old, cur).collect()}
    assert got["dead"] == ["source_deleted", "source_policy_changed"] and got["fresh"] == ["source_added", "source_policy_changed"] and got["a"] == ["ownership_changed", "source_policy_changed"]


def test_plan_issues(spark):
    schema = "component_key string, batch int, batch_count int, chunk int, chunk_count int, kind string, evidence array<string>"
    good = [("ok", b, 2, 1, 1, k, ["e"]) for b in (1, 2) for k in ("x", "y")]
    bad = [("gap", b, 3, 1, 1, k, ["e"]) for b in (1, 3) for k in ("x", "y")] + [("kind", 1, 1, 1, 1, "x", ["e"])] + [("ev", 1, 1, 1, 1, k, [k]) for k in ("x", "y")] + [("chunk", 1, 1, 2, 2, k, ["e"]) for k in ("x", "y")]
    got = sorted(tuple(r) for r in coverage.plan_issues(spark.createDataFrame(good + bad, schema), ["x", "y"]).collect())
    assert got == [("chunk", "chunks"), ("ev", "evidence"), ("gap", "batches"), ("kind", "kinds")]


@pytest.mark.parametrize(
    ("body", "code"),
    [('{"a":1,"b":"x"}', None), ('{"a":1}', "empty_value"), ('{"a":1,"b":"x","c":0}', "unknown_field"), ('{"a":"1","b":"x"}', "invalid_type"), ("[1]", "invalid_type"), ("{", "invalid_json"), ('{"a":1,"b":"x"} {}', "trailing_data"), ('{"a":null,"b":"x"}', "invalid_type"), (None, "invalid_json"), ('{"a":1,"b":"' + "x" * 99 + '"}', "string_too_long")],
)
def test_strict_json(spark, body, code):
    df = spark.createDataFrame([(body,)], "b string")
    assert df.select(validation.json_issue(F.col("b"), {"a": "BIGINT", "b": "STRING"}, 60)).first()[0] == code


def test_sections(spark):
    mark = lambda k, t="t", key="k": f'<!-- tallyloom:{k} topic="{t}" key="{key}" -->'
    docs = {
        "ok": f"a\n{mark('begin')}\n\nx\ny\n\n{mark('end')}\n{mark('begin', key='j')}\n{mark('end', key='j')}\n",
        "nested": f"{mark('begin')}\n{mark('begin', key='j')}\n",
        "open": f"{mark('begin')}\nx",
        "other": f"{mark('begin')}\n{mark('end', key='j')}",
        "twice": f"{mark('begin')}\n{mark('end')}\n{mark('begin')}\n{mark('end')}",
        "end": mark("end"),
    }
    good, bad = rendering.sections(spark.createDataFrame(list(docs.items()), "doc string, body string"))
    assert sorted((r["doc"], r["key"], r["content"]) for r in good.collect()) == [("ok", "j", ""), ("ok", "k", "x\ny")]
    assert {r["doc"]: r["reason"] for r in bad.collect()} == {"nested": "nested begin", "open": "unterminated section", "other": "mismatched end", "twice": "duplicate section", "end": "unexpected end"}


def test_records(spark):
    h = "a" * 40
    raw = f"100644 {h} 0\tb\0" + f"100755 {h} 0\ta b\0" + f"100644 {h} 2\tc\0" + "junk\0" + f"100644 {h} 0\t../x\0" + f"100644 {h} 0\td\0" + f"100644 {h} 0\td\0"
    ok, bad = records.index_records(spark.createDataFrame([(raw,)], "raw string"))
    assert sorted(r["path"] for r in ok.collect()) == ["a b", "b"]
    assert sorted(r["reason"] for r in bad.collect()) == ["duplicate_path", "duplicate_path", "malformed", "unclean_path", "unmerged"]
    tree = records.tree_records(spark.createDataFrame([(f"100644 blob {h}     12\tx\x00160000 commit {h}       -\ty\0",)], "raw string"))
    assert [tuple(r) for r in tree.orderBy("path").collect()] == [("x", "100644", "blob", h, 12), ("y", "160000", "commit", h, None)]
    with pytest.raises(Exception, match="unknown change C100"):
        records.change_records(spark.createDataFrame([("C100\0a\0",)], "raw string")).collect()


def test_files_and_state(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "tree/a.txt").write_text("abc")
    (tmp_path / "tree/sub/b.txt").write_text("x" * 50)
    got = {r["path"]: r for r in records.worktree(spark, str(tmp_path / "tree"), 10).collect()}
    assert bytes(got["a.txt"]["data"]) == b"abc" and got["sub/b.txt"]["truncated"] and got["sub/b.txt"]["data"] is None
    assert records.load_state(spark, str(tmp_path / "none.json"))[0] == "missing"
    good = '{"version":1,"files":[{"path":"a","source_hash":"sha256:' + "0" * 64 + '","role":"prose","triggers":false,"component_key":"@root","root_component":true}],"components":[],"generated":{},"config_hash":"x"}'
    for text, status in ((good, "valid"), (good.replace('"version"', '"more":1,"version"'), "invalid"), (good.replace("prose", "poem"), "invalid"), ("{", "invalid")):
        (tmp_path / "s.json").write_text(text)
        assert records.load_state(spark, str(tmp_path / "s.json"))[0] == status


def test_store_and_lifecycle(spark, tmp_path):
    n = [0]

    def keep(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / f"kept/{n[0]}"))
        return spark.read.schema(df.schema).parquet(str(tmp_path / f"kept/{n[0]}"))

    tree = lambda rows: spark.createDataFrame([(p, "100644", t, len(t)) for p, t in rows], "path string, mode string, data string, size long")
    store = VersionedStore(spark, str(tmp_path / "store"))
    tracked = tree([("main.go", "package main"), ("services/api/a.go", "package api"), ("README.md", "hi")])
    p, diff = lifecycle.sync(tracked, store, None, None, keep)
    assert p.reason == "state_missing" and {r["status"] for r in diff.collect()} == {"added"}
    first = {r["path"]: r["content"] for r in store.read().collect()}
    assert set(first) == {"docs/components/@root/index.md", "docs/components/services/api/index.md", *(f"docs/{x}" for x in rendering.DOCUMENTS)}
    assert "### Part all" in first["docs/architecture.md"] and "[`main.go`](../main.go)" in first["docs/architecture.md"] and "- [`services/api`](components/services/api/index.md)" in first["docs/index.md"]
    files, parts = keep(p.files.select("path", "source_hash", "role", "triggers", "component_key", "root_component")), keep(p.hashes)
    owned = keep(store.read().select("path", "hash"))
    assert lifecycle.sync(tracked, store, files, parts, keep)[1] is None
    lifecycle.check(tracked, store, owned, files, parts)
    edited = tree([("main.go", "package main"), ("services/api/a.go", "package api // more"), ("README.md", "hi")])
    with pytest.raises(lifecycle.StaleError, match="sources changed"):
        lifecycle.check(edited, store, owned, files, parts)
    cut = lambda request: (fragments.typed_stub(request)[0], "length")
    with pytest.raises(lifecycle.GenerationError, match="services/api: truncated"):
        lifecycle.sync(edited, store, files, parts, keep, call=cut)
    other = lambda request: (fragments.typed_stub(request)[0].replace("Holds code.", "Holds more."), "stop")
    p, diff = lifecycle.sync(edited, store, files, parts, keep, call=other)
    status = {r["path"]: r["status"] for r in diff.collect()}
    second = {r["path"]: r["content"] for r in store.read().collect()}
    assert status["docs/components/@root/index.md"] == "unchanged" and status["docs/components/services/api/index.md"] == status["docs/architecture.md"] == "changed" and status["docs/index.md"] == "unchanged"
    assert second["docs/architecture.md"].count("Holds code.") == 1 and second["docs/architecture.md"].count("Holds more.") == 1
    assert lifecycle.run_report(p).first()["regenerate"] == 1
    with pytest.raises(lifecycle.StaleError, match="modified"):
        lifecycle.check(edited, store, owned, files, parts)
    with pytest.raises(PreconditionError):
        store.commit(store.read(), owned)
    assert len(store.prune()) >= 1 and store.read().count() == 11


def test_repair_is_asked_for_once(spark):
    requests = spark.createDataFrame([("1", "good"), ("2", "bad")], "request_id string, request string")
    call = lambda text: ("ok" if text == "good" or "Invalid answer" in text else "no", "stop")
    got = generator.repaired(requests, lambda b: b == "ok", call)
    assert sorted((r["request_id"], r["ok"]) for r in got.collect()) == [("1", True), ("2", True)]


def test_output(spark):
    h = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    diff = output.output_diff(h([("a", "1"), ("b", "2"), ("c", "3")]), h([("a", "1"), ("b", "x"), ("d", "4")]))
    assert {r["path"]: r["status"] for r in diff.collect()} == {"a": "unchanged", "b": "changed", "c": "added", "d": "deleted"}
    assert sorted(r["path"] for r in output.write_set(diff, False).collect()) == ["b", "c"]
    assert [r["path"] for r in output.broken_preconditions(h([("a", "1"), ("z", None), ("b", "9")]), h([("a", "1"), ("b", "2")])).collect()] == ["b"]


def test_stream(spark, tmp_path):
    from conftest import SF

    src = spark.read.parquet(f"{SF}/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = events.incremental(events.windowed_counts(stream), lambda df, n: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    batch = events.windowed_counts(src)
    assert 0 < sum(seen) <= batch.count() and batch.agg(F.sum("n")).first()[0] == src.count()
    assert events.sessions(src).agg(F.sum("n")).first()[0] == src.count()


def test_cut_off_scopes_are_halved(spark, tmp_path):
    from tallyloom.operators import requests

    n = [0]

    def keep(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.schema(df.schema).parquet(str(tmp_path / str(n[0])))

    scopes = spark.createDataFrame([("b1/c1", "a\nb\nc\nd\n"), ("b2/c1", "x"), ("b3/c1", "one long line")], "split_path string, data string")
    retry = lambda df: df.withColumn("state", F.when(F.length("data") > 6, "truncated").otherwise("complete"))
    got = {r["split_path"]: r["state"] for r in requests.split_scopes(scopes, retry, keep, 2).collect()}
    assert got["b1/c1"] == "replaced" and got["b2/c1"] == "complete" and got["b3/c1"] == "pending" and got["b1/c1/0"] == "complete"
    done = {r["split_path"]: r["done"] for r in coverage.settled(spark.createDataFrame(list(got.items()), "split_path string, state string")).collect()}
    assert done["b1/c1"] and not done["b3/c1"]
