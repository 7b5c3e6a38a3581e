"""Queries over transactions, streams, renames and repository objects, each with its twin in DuckDB's SQL."""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import oracle as O
from . import views as V
from .functions.text import content_hash
from .operators import recovery, similarity
from .queries import query
from .sources.journal import FileTree
from .sources.objects import Repository
from .sources.sinks import VersionedStore
from .sources.tables import scratch, stored
from .streaming import events, state

# --- transactions that were cut off: 40 of them over all documents, at five points, some with files of somebody else


def _transactions(spark, d):
    """journal, live, backup and states of 40 transactions (tx) over all documents."""
    rows = V.tracked(spark, d).select("doc_id", "path", content_hash(F.col("data")).alias("before"), content_hash(F.concat("data", F.lit("x"))).alias("after"))
    n, tx = F.col("doc_id"), (F.col("doc_id") % 40).cast("int")
    kind = F.when(n % 7 == 0, "delete").otherwise("write")
    there = F.when(n % 7 == 0, n % 49 != 0).otherwise(n % 3 != 0)
    rows = rows.select("doc_id", tx.alias("tx"), "path", kind.alias("kind"), F.when(there, F.col("before")).alias("old_hash"), F.when(kind == "write", F.col("after")).alias("new_hash"), (tx % 5).alias("at"))
    moved = (F.col("at") >= 3) | ((F.col("at") == 2) & (F.floor(n / 40) % 2 == 0))
    live = F.when((F.col("tx") >= 30) & (n % 11 == 0), content_hash(F.lit("foreign"))).when(moved, F.col("new_hash")).otherwise(F.col("old_hash"))
    backup = F.when((F.col("at") >= 1) & ~((F.col("tx") >= 35) & (n % 13 == 0)), F.col("old_hash"))
    rows = rows.select("*", live.alias("live"), backup.alias("kept"))
    side = lambda c: rows.where(F.col(c).isNotNull()).select("tx", "path", F.col(c).alias("hash"))
    state = F.element_at(F.array(*map(F.lit, ["staged", "verified", "moving", "moving", "committed"])), F.col("at") + 1)
    return rows.select("tx", "path", "kind", "old_hash", "new_hash"), side("live"), side("kept"), rows.select("tx", state.alias("state")).distinct()


_TX = f"""WITH {O.TRACKED}, r0 AS (SELECT doc_id AS n, (doc_id % 40)::INTEGER AS tx, path, doc_id % 7 <> 0 AS w, 'sha256:' || sha256(data) AS b, 'sha256:' || sha256(data || 'x') AS a, CASE WHEN doc_id % 7 = 0 THEN doc_id % 49 <> 0 ELSE doc_id % 3 <> 0 END AS must FROM tracked),
r1 AS (SELECT *, tx % 5 AS pt, CASE WHEN must THEN b END AS o, CASE WHEN w THEN a END AS nw FROM r0),
r2 AS (SELECT *, CASE WHEN tx >= 30 AND n % 11 = 0 THEN 'sha256:' || sha256('foreign') WHEN pt >= 3 OR (pt = 2 AND (n // 40) % 2 = 0) THEN nw ELSE o END AS live, pt >= 1 AND must AND NOT (tx >= 35 AND n % 13 = 0) AS kept FROM r1),
j AS (SELECT *, CASE WHEN must AND live IS NOT DISTINCT FROM o THEN 'original' WHEN (w AND live IS NOT DISTINCT FROM nw) OR (NOT w AND live IS NULL) THEN 'installed' WHEN live IS NULL THEN 'absent' ELSE 'foreign' END AS state,
  (w AND live IS NOT DISTINCT FROM nw) OR (NOT w AND live IS NULL) AS done FROM r2),
v AS (SELECT *, CASE WHEN NOT w AND NOT must THEN 'unexpected_delete' WHEN state = 'foreign' THEN 'foreign_content' WHEN must AND live IS NULL AND NOT kept THEN 'lost_original' WHEN must AND state = 'installed' AND NOT kept THEN 'no_backup' END AS conflict FROM j),
o AS (SELECT tx, CASE WHEN tx % 5 = 4 OR bool_and(done) THEN 'forward' WHEN count(conflict) > 0 THEN 'conflict' ELSE 'back' END AS outcome, count(conflict) AS bad FROM v GROUP BY tx)"""


@query("recovery_verdicts", f"{_TX} SELECT tx, path, CASE WHEN w THEN 'write' ELSE 'delete' END AS kind, state, done, conflict FROM v")
def _(spark, d):
    journal, live, backup, _ = _transactions(spark, d)
    return recovery.verdicts(journal, live, backup).select("tx", "path", "kind", "state", "done", "conflict")


@query("recovery_outcomes", f"{_TX} SELECT tx, outcome, CASE WHEN outcome = 'conflict' THEN bad ELSE 0 END AS conflicts FROM o")
def _(spark, d):
    journal, live, backup, states = _transactions(spark, d)
    return recovery.outcomes(stored(recovery.verdicts(journal, live, backup)), states)


@query("recovery_repairs", f"{_TX} SELECT tx, path, CASE WHEN outcome <> 'back' OR state = 'original' THEN 'keep' WHEN kept THEN 'restore' WHEN w AND state = 'installed' THEN 'remove' ELSE 'keep' END AS action FROM v JOIN o USING (tx)")
def _(spark, d):
    journal, live, backup, states = _transactions(spark, d)
    judged = stored(recovery.verdicts(journal, live, backup))
    return recovery.repairs(judged, recovery.outcomes(judged, states))


@query("journal_issues", f"""WITH {O.TRACKED}, j AS (SELECT source || '/' || lang AS tx, CASE WHEN doc_id % 17 = 0 THEN replace(path, '/doc_', '//doc_') ELSE path END AS path, CASE WHEN doc_id % 19 = 0 THEN 'move' WHEN doc_id % 2 = 0 THEN 'delete' ELSE 'write' END AS kind, doc_id % 6 <> 0 AS old,
  doc_id % 2 = 1 OR doc_id % 23 = 0 AS new FROM (SELECT t.*, source, lang FROM tracked t JOIN documents USING (doc_id)))
SELECT tx, path, unnest(list_filter([CASE WHEN contains(path, '//') THEN 'unclean_path' END, CASE WHEN NOT starts_with(path, 'services/') THEN 'foreign_path' END, CASE WHEN kind = 'move' THEN 'unknown_kind' END,
  CASE WHEN (kind = 'write') <> new THEN 'bad_hash' END, CASE WHEN kind = 'delete' AND NOT old THEN 'unexpected_delete' END], lambda c: c IS NOT NULL)) AS code FROM j""")
def _(spark, d):
    """Journals with rows by which no recovery may act."""
    n, h = F.col("doc_id"), content_hash(F.col("data"))
    path = F.when(n % 17 == 0, F.replace("path", F.lit("/doc_"), F.lit("//doc_"))).otherwise(F.col("path"))
    kind = F.when(n % 19 == 0, "move").when(n % 2 == 0, "delete").otherwise("write")
    rows = V.tracked(spark, d).select(F.concat_ws("/", "source", "lang").alias("tx"), path.alias("path"), kind.alias("kind"), F.when(n % 6 != 0, h).alias("old_hash"), F.when((n % 2 == 1) | (n % 23 == 0), h).alias("new_hash"))
    return recovery.journal_issues(rows, "services")


class _CutOff(Exception):
    pass


_RECOVERED = f"""WITH {O.TRACKED}, c AS (SELECT unnest(['staged', 'verified', 'moving', 'committed']) AS crash)
SELECT crash, CASE crash WHEN 'committed' THEN 'forward' ELSE 'back' END AS outcome, path, 'sha256:' || sha256(CASE WHEN crash = 'committed' THEN data || 'x' ELSE data END) AS hash FROM c, tracked WHERE crash <> 'committed' OR doc_id % 7 <> 0"""


@query("journal_recovery", _RECOVERED)
def _(spark, d):
    """All documents as files, changed in a transaction that is cut off at each state (while moving: with every other file
    moved), and recovered: what recovery did, and the files that are there then. What goes back leaves its files to the next
    transaction; the one that goes forward is the last."""
    docs = V.tracked(spark, d)
    paths = stored(docs.select("path"))
    out: list[DataFrame] = []
    tree = FileTree(spark, scratch(spark, "tree"))
    tree.install(docs.select("path", F.col("data").alias("content")))
    for crash in recovery.STATES:

        def cut_off(state: str, at: str = "verified" if crash == "moving" else crash) -> None:
            if state == at:
                raise _CutOff

        changed = docs.where("doc_id % 7 <> 0").select("path", F.concat("data", F.lit("x")).alias("content"))
        try:
            tree.install(changed, docs.where("doc_id % 7 = 0"), on_state=cut_off)
        except _CutOff:
            pass
        if crash == "moving":
            some = docs.where("doc_id % 2 = 0").select("path", F.when(F.col("doc_id") % 7 != 0, F.encode(F.concat("data", F.lit("x")), "utf-8")).alias("content"), F.array(content_hash(F.col("data"))).alias("accepted"))
            tree._mark("moving")
            tree.change(some).write.format("noop").mode("overwrite").save()
        outcome = tree.recover()
        out.append(stored(tree.hashes(paths).select(F.lit(crash).alias("crash"), F.lit(outcome).alias("outcome"), "path", "hash")))
    tree.clear(paths)
    return reduce(DataFrame.unionByName, out)


# --- streams that keep state or commit what they make

_RUNS = """WITH c AS (SELECT source || '/' || lang AS component_key, count(*) AS n, sum(length(text))::BIGINT AS chars, min(doc_id) % 4 AS kind FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1),
r AS (SELECT component_key, false AS root_component, run, TIMESTAMP '2024-01-01 00:00:00' + run * INTERVAL 1 HOUR AS seen, sha256(component_key || ':' || n || ':' || chars || ':' || CASE WHEN kind = 1 THEN run // 2 ELSE 0 END) AS input_hash
  FROM c, (SELECT unnest(range(6)) AS run) WHERE NOT (kind = 2 AND run BETWEEN 1 AND 3) AND NOT (kind = 3 AND run > 1)),
w AS (SELECT *, lag(seen) OVER o AS before, lag(input_hash) OVER o AS was, coalesce(lead(seen) OVER o, TIMESTAMP '2024-01-01 05:00:00') AS after FROM r WINDOW o AS (PARTITION BY component_key ORDER BY run))"""


def _runs(spark, d):
    """Six runs over the components of all documents, by the hour: some change, some are away for a while, some for good."""
    docs = V.table(spark, d, "documents")
    parts = docs.where("source is not null and lang is not null").groupBy(F.concat_ws("/", "source", "lang").alias("component_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), (F.min("doc_id") % 4).alias("kind"))
    rows = parts.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(5)))).where("not (kind = 2 and run between 1 and 3) and not (kind = 3 and run > 1)")
    changed = F.when(F.col("kind") == 1, F.floor(F.col("run") / 2)).otherwise(0)
    hashed = F.sha2(F.concat_ws(":", "component_key", "n", "chars", changed), 256)
    return rows.select("run", "component_key", F.lit(False).alias("root_component"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("run"))).alias("at"), hashed.alias("input_hash"))


def _as_stream(spark, df, part: str):
    """A stream over the parts of a table, a batch each, a folder for what belongs to it, and what adds a part."""
    root, kept = scratch(spark, "stream"), stored(df)

    kept.drop(part).limit(0).write.parquet(f"{root}/in")  # a stream can't begin without its folder

    def add(x) -> None:
        kept.where(F.col(part) == x).drop(part).coalesce(1).write.mode("append").parquet(f"{root}/in")

    return spark.readStream.schema(kept.drop(part).schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root, add


@query("component_stream", f"""{_RUNS} SELECT component_key, root_component, seen, input_hash, CASE WHEN before IS NULL OR seen > before + INTERVAL 2 HOUR THEN 'create' WHEN was = input_hash THEN 'skip_unchanged' ELSE 'regenerate' END AS action FROM w
UNION ALL SELECT component_key, root_component, seen + INTERVAL 2 HOUR, input_hash, 'delete' FROM w WHERE after > seen + INTERVAL 2 HOUR""")
def _(spark, d):
    """The actions of six runs, told by a stream that stops after the third and goes on from its state."""
    state.use_state(spark)
    runs, root, add = _as_stream(spark, _runs(spark, d), "run")
    for some in (range(3), range(3, 6)):
        for run in some:
            add(run)
        asked = state.component_actions(runs).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        asked.trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(state.ACTIONS).parquet(f"{root}/out")
    return found.select("component_key", "root_component", F.col("at").cast("timestamp_ntz").alias("seen"), "input_hash", "action")


@query("stream_commits", "SELECT event_type AS path, count(*)::VARCHAR AS content FROM events GROUP BY 1")
def _(spark, d):
    """Events counted batch by batch into a versioned store; every batch is handed over twice and counts once."""
    rows = V.table(spark, d, "events").withColumn("part", F.col("event_id") % 3)
    stream, root, add = _as_stream(spark, rows, "part")
    for part in range(3):
        add(part)
    store = VersionedStore(spark, f"{root}/store")

    def counted(batch: DataFrame, live: DataFrame) -> DataFrame:
        both = batch.groupBy(F.col("event_type").alias("path")).agg(F.count(F.lit(1)).alias("n")).unionByName(live.select("path", F.col("content").cast("long").alias("n")))
        return both.groupBy("path").agg(F.sum("n").cast("string").alias("content"))

    for checkpoint in ("once", "again"):  # without the first one's checkpoint the second hands over the same batches anew
        events.exactly_once(stream, store, "events", counted, f"{root}/{checkpoint}").awaitTermination()
    return store.read().select("path", "content")


# --- renames of similar files: documents that lay elsewhere before, some with a line more or less


def _moved(spark, d):
    """Files before and now, path, source_hash, data: one in 11 is renamed, of these some have other content."""
    docs = V.table(spark, d, "documents").where("text is not null")
    n = F.col("doc_id")
    name = F.concat(F.lit("doc_"), n.cast("string"), F.lit(".md"))
    now = F.when(n % 11 == 0, F.concat(F.lit("moved/"), F.when(n % 2 == 0, "a_").otherwise(""), name)).otherwise(F.concat(F.lit("docs/"), name))
    text = F.when(n % 22 == 0, F.concat("text", F.lit("\none line more\n"))).when(n % 33 == 0, F.substring("text", 1, 300)).otherwise(F.col("text"))
    side = lambda path, data: docs.select(path.alias("path"), data.alias("data")).withColumn("source_hash", content_hash(F.col("data")))
    return side(F.concat(F.lit("docs/"), name), F.col("text")), side(now, text)


_HEX = "(?:[1-9A-F][0-9A-F]|0[0-9B-F])"
_MOVED = f"""WITH RECURSIVE f AS (SELECT doc_id, text, 'docs/doc_' || doc_id || '.md' AS o, CASE WHEN doc_id % 11 = 0 THEN 'moved/' || CASE WHEN doc_id % 2 = 0 THEN 'a_' ELSE '' END || 'doc_' || doc_id || '.md' END AS n,
  CASE WHEN doc_id % 22 = 0 THEN text || chr(10) || 'one line more' || chr(10) WHEN doc_id % 33 = 0 THEN left(text, 300) ELSE text END AS t FROM documents WHERE text IS NOT NULL),
gone AS (SELECT o AS path, text AS data, list_last(string_split(o, '/')) AS name FROM f WHERE n IS NOT NULL), fresh AS (SELECT n AS path, t AS data, list_last(string_split(n, '/')) AS name FROM f WHERE n IS NOT NULL),
g1 AS (SELECT *, row_number() OVER (PARTITION BY data, name ORDER BY path) AS nth FROM gone), n1 AS (SELECT *, row_number() OVER (PARTITION BY data, name ORDER BY path) AS nth FROM fresh),
e1 AS (SELECT g1.path AS old_path, n1.path AS new_path FROM g1 JOIN n1 USING (data, name, nth)),
g2 AS (SELECT *, row_number() OVER (PARTITION BY data ORDER BY path) AS nth FROM gone WHERE path NOT IN (SELECT old_path FROM e1)), n2 AS (SELECT *, row_number() OVER (PARTITION BY data ORDER BY path) AS nth FROM fresh WHERE path NOT IN (SELECT new_path FROM e1)),
e AS (SELECT * FROM e1 UNION ALL SELECT g2.path, n2.path FROM g2 JOIN n2 USING (data, nth)),
b AS (SELECT side, path, strlen(data) AS size, x, sum(length(x) // 2) AS w FROM (SELECT side, path, data, unnest(regexp_extract_all(hex(encode(data)), '(?:{_HEX}{{0,63}}0A|{_HEX}{{64}}|{_HEX}+)')) AS x FROM
  (SELECT 0 AS side, path, data FROM gone WHERE path NOT IN (SELECT old_path FROM e) UNION ALL SELECT 1, path, data FROM fresh WHERE path NOT IN (SELECT new_path FROM e))) GROUP BY ALL),
pairs AS (SELECT g.path AS old_path, n.path AS new_path, (100 * sum(least(g.w, n.w)) // greatest(g.size, n.size))::INTEGER AS similarity FROM b g JOIN b n ON g.side = 0 AND n.side = 1 AND g.x = n.x GROUP BY g.path, n.path, g.size, n.size HAVING 100 * sum(least(g.w, n.w)) // greatest(g.size, n.size) >= 50)"""


@query("similar_pairs", f"{_MOVED} SELECT * FROM pairs")
def _(spark, d):
    old, cur = _moved(spark, d)
    gone, new = stored(old.join(cur, "path", "left_anti")), stored(cur.join(old, "path", "left_anti"))
    exact = stored(similarity.equal_renames(gone, new))
    return similarity.similar_pairs(gone.join(exact.select(F.col("old_path").alias("path")), "path", "left_anti"), new.join(exact.select(F.col("new_path").alias("path")), "path", "left_anti"), stored)


@query("similar_renames", f"""{_MOVED},
ranked AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, list_last(string_split(old_path, '/')) <> list_last(string_split(new_path, '/')), old_path, new_path) AS nr FROM pairs),
taken AS (SELECT 0::BIGINT AS nr, []::VARCHAR[] AS olds, []::VARCHAR[] AS news UNION ALL
  SELECT r.nr, CASE WHEN free THEN list_append(olds, r.old_path) ELSE olds END, CASE WHEN free THEN list_append(news, r.new_path) ELSE news END FROM (SELECT k.*, p.old_path, p.new_path, p.nr AS nr_1, NOT list_contains(k.olds, p.old_path) AND NOT list_contains(k.news, p.new_path) AS free FROM taken k JOIN ranked p ON p.nr = k.nr + 1) x JOIN ranked r ON r.nr = x.nr_1),
last AS (SELECT olds, news FROM taken ORDER BY nr DESC LIMIT 1),
m AS (SELECT unnest(olds) AS old_path, unnest(news) AS new_path FROM last)
SELECT old_path, new_path, 100 AS similarity FROM e UNION ALL SELECT m.old_path, m.new_path, p.similarity FROM m JOIN pairs p ON p.old_path = m.old_path AND p.new_path = m.new_path""")
def _(spark, d):
    return similarity.renames(*_moved(spark, d), stored)


# --- repository objects: all documents as a commit's files, written as loose objects and read back


def _commit(spark, d) -> tuple[str, str]:
    """A folder with the objects of a commit that holds all documents as files, and the commit's id."""
    root = scratch(spark, "objects")
    named = lambda kind, body: F.concat(F.encode(F.concat(F.lit(f"{kind} "), F.length(body).cast("string"), F.lit("\0")), "utf-8"), body)
    mode = F.when(F.col("doc_id") % 3 == 0, "100755").otherwise("100644")
    blobs = V.tracked(spark, d).where("data is not null").select("path", mode.alias("mode"), named("blob", F.encode("data", "utf-8")).alias("object"))
    blobs = stored(blobs.withColumn("oid", F.sha1("object")))
    entries, objects_ = blobs.select("path", "mode", "oid"), blobs.select("oid", "object")
    deepest = blobs.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    for depth in range(deepest, 0, -1):  # a level of folders at a time, from below
        here = entries.where(F.size(F.split("path", "/")) == depth)
        name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
        line = F.concat(F.hex(F.encode(F.concat("mode", F.lit(" "), name, F.lit("\0")), "utf-8")), F.col("oid"))
        order = F.concat(name, F.when(F.col("mode") == "40000", "/").otherwise(""))
        trees = here.groupBy(folder.alias("path")).agg(F.array_sort(F.collect_list(F.struct(order.alias("k"), line.alias("line")))).alias("l"))
        body = F.unhex(F.array_join(F.transform("l", lambda x: x["line"]), ""))
        trees = stored(trees.select("path", F.lit("40000").alias("mode"), named("tree", body).alias("object")).withColumn("oid", F.sha1("object")))
        objects_ = objects_.unionByName(trees.select("oid", "object"))
        entries = entries.where(F.size(F.split("path", "/")) < depth).unionByName(trees.where("path <> ''").select("path", "mode", "oid"))
        top = trees
    text = f"tree {top.where(F.col('path') == '').first()['oid']}\nauthor a <a> 0 +0000\ncommitter a <a> 0 +0000\n\nall documents\n".encode()
    raw = b"commit " + str(len(text)).encode() + b"\0" + text
    commit = hashlib.sha1(raw).hexdigest()
    objects_ = objects_.unionByName(spark.createDataFrame([(commit, raw)], "oid string, object binary")).dropDuplicates(["oid"])

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    files = objects_.select(F.concat(F.lit("objects/"), F.left("oid", F.lit(2)), F.lit("/"), F.substring("oid", 3, 100)).alias("path"), "object").mapInArrow(packed, "path string, content binary")
    FileTree(spark, root).change(files.withColumn("accepted", F.array(F.lit("")))).write.format("noop").mode("overwrite").save()
    return root, commit


@query("repository_files", f"""WITH {O.TRACKED} SELECT path, CASE WHEN doc_id % 3 = 0 THEN '100755' ELSE '100644' END AS mode, sha1(encode('blob ' || size) || '\\x00'::BLOB || encode(data)) AS object_id, size, size > 2000 AS truncated, CASE WHEN size <= 2000 THEN sha256(data) END AS content FROM tracked""")
def _(spark, d):
    """The files of a commit, with the content of those within 2,000 bytes."""
    root, commit = _commit(spark, d)
    repository = Repository(spark, root)
    files = repository.tree(commit)
    blobs = repository.blobs(files, 2000).select("oid", "truncated", F.sha2("data", 256).alias("content"))
    return files.join(blobs, "oid").select("path", "mode", F.col("oid").alias("object_id"), "size", "truncated", "content")
