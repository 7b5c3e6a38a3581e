"""Renames of similar files against a search of all pairs, and streams with state and a ledger."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyloom.functions.text import content_hash
from tallyloom.operators import similarity
from tallyloom.sources import records
from tallyloom.sources.sinks import PreconditionError, VersionedStore
from tallyloom.sources.tables import stored
from tallyloom.streaming import events, state


def bag(text):
    return Counter({x: n * len(x) for x, n in Counter(re.findall(rb"[^\n]{0,63}\n|[^\n]{64}|[^\n]+", text.encode())).items()})


def by_hand(old, new, least=50):
    gone, fresh = {p: t for p, t in old.items() if p not in new}, {p: t for p, t in new.items() if p not in old}
    pairs = {}
    for o, a in gone.items():
        for n, b in fresh.items():
            size = max(len(a.encode()), len(b.encode()))
            score = 100 * sum((bag(a) & bag(b)).values()) // size if size else 0
            if score >= least:
                pairs[o, n] = score
    return pairs


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, data string").withColumn("source_hash", content_hash(F.col("data")))


def test_similar_pairs_and_matches(spark):
    rng = random.Random(11)
    line = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randrange(0, 150)))
    shared = [line() for _ in range(30)]
    old = {f"old/{i}.txt": "\n".join(rng.sample(shared, 12) + [line() for _ in range(rng.randrange(0, 8))]) for i in range(25)}
    new = {f"new/{i}.txt": "\n".join(rng.sample(shared, 12) + [line() for _ in range(rng.randrange(0, 8))]) for i in range(20)}
    new |= {f"new/copy{i}.txt": old[f"old/{i}.txt"] + "more\n" for i in range(5)} | {"new/empty": "", "kept": "k"}
    old |= {"old/empty": "", "kept": "k"}
    want = by_hand(old, new)
    got = similarity.similar_pairs(*(frame(spark, {p: t for p, t in a.items() if p not in b}) for a, b in ((old, new), (new, old))), stored)
    assert {(r["old_path"], r["new_path"]): r["similarity"] for r in got.collect()} == want and len(want) > 10
    name = lambda p: p.rsplit("/", 1)[-1]
    taken, left = {}, sorted(want, key=lambda k: (-want[k], name(k[0]) != name(k[1]), *k))
    for o, n in left:
        if o not in {x for x, _ in taken} and n not in {x for _, x in taken}:
            taken[o, n] = want[o, n]
    assert {(r["old_path"], r["new_path"]): r["similarity"] for r in similarity.matched(got, stored).collect()} == taken


def test_renames(spark):
    text = "".join(f"line {i}\n" for i in range(40))
    old = {"a/x.go": text, "a/y.go": text, "a/z.go": "other\n" * 9, "same.go": "s", "gone.go": "nothing like it"}
    new = {"b/y.go": text, "b/w.go": text, "c/z.go": "other\n" * 8 + "edit\n", "same.go": "t", "fresh.go": "unlike all else"}
    got = {(r["old_path"], r["new_path"]): r["similarity"] for r in similarity.renames(frame(spark, old), frame(spark, new), stored).collect()}
    assert got == {("a/y.go", "b/y.go"): 100, ("a/x.go", "b/w.go"): 100, ("a/z.go", "c/z.go"): 100 * 48 // 54}
    assert similarity.renames(frame(spark, old), frame(spark, old), stored).count() == 0


def runs(spark):
    rows = []
    for run in range(7):
        for c in range(6):
            if (c == 3 and run in (1, 2, 3, 4)) or (c == 4 and run > 1) or (c == 5 and run != 3):
                continue
            rows.append((f"c{c}", c == 0, dt.datetime(2024, 1, 1, run), f"h{run // 2 if c % 2 else 0}", run))
    return spark.createDataFrame(rows, "component_key string, root_component boolean, at timestamp, input_hash string, run int")


@pytest.mark.parametrize("stops", [(7,), (2, 5, 7)])
def test_state_outlives_runs(spark, tmp_path, stops):
    src, done = runs(spark), 0
    state.use_state(spark)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(src.drop("run").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for to in stops:
        for run in range(done, to):
            src.where(F.col("run") == run).drop("run").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = to
        asked = state.component_actions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        asked.trigger(availableNow=True).start().awaitTermination(240)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, state.component_actions_at_once(src).collect()))
    assert {a for *_, a in got} == {"create", "regenerate", "skip_unchanged", "delete"}
    assert [a for c, _, _, _, a in got if c == "c3"] == ["create", "delete", "create", "regenerate"]


def test_a_batch_counts_once(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    docs = lambda text: spark.createDataFrame([("a", text)], "path string, content string")
    first = store.commit(docs("1"), batch=("s", 0))
    assert store.commit(docs("2"), batch=("s", 0)) == first and store.read().first()["content"] == "1" and store.last_batch("s") == 0 and store.last_batch("t") == -1
    store.commit(docs("3"))
    assert store.last_batch("s") == 0
    # two commits on one version: the pointer's number is taken
    with pytest.raises(PreconditionError, match="number 2"):
        store._point(2, {"version": "v-x", "batches": {}})
    assert store.read().first()["content"] == "3" and len(store.prune()) == 2 and store.read().first()["content"] == "3"


def test_exactly_once(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, "x"), (i, "y")], "n int, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store, failed = VersionedStore(spark, str(tmp_path / "store")), []

    def count(batch, live):
        both = batch.select(F.col("k").alias("path"), F.lit(1).alias("n")).unionByName(live.select("path", F.col("content").cast("int").alias("n")))
        if not failed and store.last_batch("s") == 0:
            failed.append(1)
            raise RuntimeError("cut off")
        return both.groupBy("path").agg(F.sum("n").cast("string").alias("content"))

    with pytest.raises(Exception, match="cut off"):
        events.exactly_once(stream, store, "s", count, str(tmp_path / "ck")).awaitTermination()
    for checkpoint in ("ck", "ck", "another"):
        events.exactly_once(stream, store, "s", count, str(tmp_path / checkpoint)).awaitTermination()
        assert {r["path"]: r["content"] for r in store.read().collect()} == {"x": "3", "y": "3"}


def test_unknown_names_in_a_state(spark):
    rows = [('{"version":1,"files":[{"path":"a","odd":1}],"components":[{"component_key":"c","more":null}],"extra":2}',), ('{"version":1,"files":[],"components":[]}',), ("[]",), ("{",)]
    got = [r[0] for r in spark.createDataFrame(rows, "value string").coalesce(1).select(records.unknown_names("value")).collect()]
    assert got == [["components.more", "extra", "files.odd"], [], [], []]
