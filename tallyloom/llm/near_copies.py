"""Near copies by shingle similarity: SimHash fingerprints and MinHash bands find the candidates, whole shingle sets decide.

Texts with equal sets of 5-word shingles are one node. Nodes whose SimHash fingerprints of these shingles differ in 2 of 64 bits
at most are met first, as simhash.links() finds them: by two segments and their one-wildcard variants. Equal fingerprints meet
one of theirs. What is further apart is left to the bands, so that no edited copy is lost: a node has BANDS band values of DEPTH minima each; two nodes of
similarity s share one with probability 1 - (1 - s**DEPTH)**BANDS, so a pair at 0.8 is missed with probability 5e-8 and
a closer one less often. Fingerprints alone can't do: at 0.8 they differ in 10 bits on average, and segments short enough for
that hold a large share of all texts.

No bucket is compared pair by pair. Each node meets its bucket's hub, the node with the most copies, and the components
of those links are known. Where a bucket still has several components, its nodes go on to a prefix filter: sets that are
similar enough share one of their rarest shingles, so that copies with many edits of their own meet nobody. There, too,
each node first meets a hub, the one with the fewest rarer shingles, and only nodes that still are apart from their hub's
component meet the others, as far as the places of the shared shingle leave room for the similarity. Pairs within a
component can't change it, so the components are those of all candidate pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import components, free_prefix, slices, stored

WIDTH = 5
BANDS, DEPTH = 32, 4
#: Pairs of one node that a task verifies, about.
PAIRS_A_TASK = 1_000

_RNG = np.random.default_rng(20)
_FLIP = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, (BANDS * DEPTH, 1), dtype=np.uint64) | np.uint64(1)


def shingles(raw: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct 64-bit hashes, in order, of the lower-cased text's runs of `width` words; of all words together if
    they are fewer, and none without words."""
    words = (raw or b"").lower().split()  # bytes: ASCII only, as in op4
    if not words:
        return np.zeros(0, np.uint64)
    n = max(len(words) - width + 1, 1)
    runs = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True)) if len(words) > width else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, runs), dtype=np.uint64, count=n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A value for each band; the bands of no shingles are equal."""
    low = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, ((hashes[at : at + 2048] ^ _FLIP) * _TIMES).min(axis=1))
    low = low.reshape(BANDS, DEPTH)
    return np.array([xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) for i, row in enumerate(low)], np.uint64)


def sketches(rows: DataFrame) -> DataFrame:
    """(doc_id, key, node, n, fp, bands) of each row of (doc_id, key, text); fp is the SimHash fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 2):
            texts = text.to_pylist()
            sets = [shingles(x) for x in texts]
            fps = np.array([simhash.simhash(x, WIDTH) for x in texts], np.uint64).view(np.int64)
            nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            values = np.concatenate([bands(s) for s in sets]).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), listed], names=["doc_id", "key", "node", "n", "fp", "bands"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "key", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, key long, node long, n long, fp long, bands array<long>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, s) of each row of (node, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1):
            sets = [shingles(x) for x in text.to_pylist()]
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "s"])

    return texts.select("node", F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, s array<long>")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have 4/5 of their union in common: 9 * common >= 4 * (sizes), in whole numbers.
    One node may be the `a` of any number of pairs: its set is dealt out once for each PAIRS_A_TASK of them."""
    often = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS_A_TASK).alias("parts"))
    dealt = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    left = sets.join(often, sets["node"] == often["a"]).select("a", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = dealt.join(sets.select(F.col("node").alias("b"), F.col("s").alias("t")), "b").join(left, ["a", "part"])
    return both.where("9L * size(array_intersect(s, t)) >= 4L * (size(s) + size(t))").select("a", "b")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, node, n, at): the rarest shingles of each set of (node, s), with their places from 1.

    Shingles are in one order for all sets, the rarest among these sets first. Sets that have 4/5 of their union in
    common have a shingle in common among the first n - ceil(4 n / 5) + 1 of each."""
    each = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("token"))
    ranked = each.join(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "token")
    order = Window.partitionBy("node").orderBy("df", "token")
    return ranked.withColumn("at", F.row_number().over(order)).where("at <= n - ceil(4 * n / 5) + 1").select("token", "node", "n", "at")


def _placed(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """With a column `of`: the component of the row's node."""
    return rows.join(components(linked).select("node", F.col("root").alias("of")), "node", "left").withColumn("of", F.coalesce("of", "node"))


def _mixed(placed: DataFrame, key: str) -> DataFrame:
    """The keys that nodes of more than one component have."""
    return placed.groupBy(key).agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x != y").select(key)


def met(nodes: DataFrame) -> DataFrame:
    """(a, b): the nodes of (node, fp) whose fingerprints link, each but the first of a fingerprint with the first."""
    firsts = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(firsts, "fp").where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    one, two = firsts.toDF("a", "one"), firsts.toDF("b", "two")
    return same.union(simhash.links(firsts).join(one, "a").join(two, "b").select("one", "two"))


def roots(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(node, root) of each node that is linked; `rows` has key and text, `found` their sketches."""
    nodes = stored(found.groupBy("node").agg(F.min("n").alias("n"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies"), F.min("fp").alias("fp"), F.min("bands").alias("bands")))
    indexed = nodes.select("node", "n", "copies", F.explode("bands").alias("sig"))
    groups = indexed.groupBy("sig").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct((-F.col("copies")).alias("less"), "node", "n")).alias("hub"))
    groups = stored(groups.where("c > 1").select("sig", "hub"))
    members = stored(indexed.join(groups, "sig").select("sig", "node", "n", F.col("hub.node").alias("a"), F.col("hub.n").alias("a_n")))
    # sets whose sizes differ more can't be that similar
    star = stored(members.where("node != a and 5 * least(n, a_n) >= 4 * greatest(n, a_n)").select("a", F.col("node").alias("b")).union(met(nodes.select("node", "fp"))).distinct())
    needed = members.select("node").union(star.select("a")).union(star.select("b")).distinct().join(nodes.select("node", "key"), "node")
    sets = stored(shingle_sets(rows.join(needed, "key").select("node", "text")).dropDuplicates(["node"]))
    linked = stored(_similar(star, sets))
    placed = stored(_placed(members.select("sig", "node"), linked))
    open_ = placed.join(_mixed(placed, "sig"), "sig", "left_semi").select("node").distinct()
    first = stored(prefixes(sets.join(open_, "node", "left_semi")))
    # the node with the fewest rarer shingles meets all that share one; then those still apart meet
    hubs = first.groupBy("token").agg(F.min(F.struct("at", "node", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = stored(first.join(hubs.select("token", "hub"), "token").select("token", "node", "n", "at", F.col("hub.node").alias("a"), F.col("hub.n").alias("a_n"), F.col("hub.at").alias("a_at")))
    near = "node != a and 9L * (1 + least(n - at, a_n - a_at)) >= 4L * (n + a_n)"
    more = first.where(near).select("a", F.col("node").alias("b")).distinct()
    linked = stored(linked.union(_similar(stored(more.join(star, ["a", "b"], "left_anti")), sets)))
    placed = stored(_placed(first, linked))
    placed = stored(placed.join(_mixed(placed, "token"), "token", "left_semi"))
    ofs = placed.where("node = a").select("token", F.col("of").alias("hub_of"))
    apart = placed.join(ofs, "token").where("of != hub_of").select("token", F.col("node").alias("b"), F.col("n").alias("b_n"), F.col("at").alias("b_at"), F.col("of").alias("b_of"))
    across = placed.select("token", "node", "n", "at", "of").join(apart, "token").where("of != b_of and 9L * (1 + least(n - at, b_n - b_at)) >= 4L * (n + b_n)")
    across = across.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    return components(linked.union(_similar(stored(across), sets)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, less all but one of each component of near copies: the one with the
    smallest identifier stays, null identifiers come last, and of several texts under it the one with the least hash.
    Of rows equal in identifier and text one stays, the one with the least hash of all its columns. Null and blank
    texts are copies of each other. An empty table gives none; helper columns keep clear of the table's own."""
    p = free_prefix(docs, "stay_")
    key = F.xxhash64(F.col(text_col).isNull(), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    found = stored(sketches(rows))
    # the least row of each node, then of each component: both with map-side combining
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    stay = found.groupBy("node").agg(F.min(least).alias("f")).join(roots(rows, found), "node", "left")
    stay = stay.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("f").alias("f"))
    keys = [f"{p}no", f"{p}id", f"{p}key"]
    stay = stored(stay.select(F.col("f.no_id").alias(keys[0]), F.coalesce("f.doc_id", F.lit(0)).alias(keys[1]), F.col("f.key").alias(keys[2])))
    id_ = F.col(id_col).cast("long")
    marked = docs.withColumns({keys[0]: id_.isNull(), keys[1]: F.coalesce(id_, F.lit(0)), keys[2]: key})
    one = Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))
    return marked.join(stay, keys, "left_semi").withColumn(f"{p}nth", F.row_number().over(one)).where(F.col(f"{p}nth") == 1).select(*docs.columns)
