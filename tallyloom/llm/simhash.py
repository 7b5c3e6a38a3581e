"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most 2 bits differ in
at most 1 bit in one of the segments, so they agree on one of that segment's 32 one-wildcard variants. Distinct
fingerprints are indexed under their 64 variants and met by equality of the variant; each meeting is verified.

How a variant's fingerprints are compared depends on how many they are, and no link is lost:
2          the pair is the group's minimum and maximum, an aggregation with map-side combining
3 to K     all pairs of the at most K
over K     each goes on to its two-wildcard variants (any two of 64 bits masked): fingerprints equal there differ
           in 2 bits at most, at most four share a variant, and any two within distance share one
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read, slices, stored

BITS = 64
#: Fingerprints of one variant that are compared pair by pair; larger groups take the two-wildcard way.
MOST_PAIRED = 48
#: Crowded variants (three numbers each) that are broadcast to find their fingerprints; more are joined by shuffling.
MOST_BROADCAST = 1_000_000


def simhash(raw: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Bit i is set if it is in more than half of the hashes of the lower-cased text's shingles."""
    words = (raw or b"").lower().split()  # bytes: ASCII only, for letters and white space alike
    if not words:
        return 0
    n = len(words) - width + 1
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True)) if n > 1 else [b" ".join(words)]
    n = max(n, 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=n)
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42, more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the long columns `more`: fp is the fingerprint's bits as a signed long. Null and blank texts
    give 0; fewer words than `width` make one shingle. Every row gives one, repeated and null identifiers too; other
    columns are ignored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1):
            fps = np.array([simhash(x, width, seed) for x in text.to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *more])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return rows.mapInArrow(run, ", ".join(f"`{c}` long" for c in ("doc_id", "fp", *more)))


def links(fps: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of the distinct fingerprints in column fp that differ in 1 or 2 bits, except that
    of a crowded variant's fingerprints only a star under each two-wildcard variant is given: their components
    are the same as with all pairs."""
    positions = "transform(sequence(0, 63), x -> named_struct('p', cast(x as byte), 'sig', (fp & if(x < 32, {low}L, {high}L)) & ~shiftleft(1L, x)))".format(low=0xFFFFFFFF, high=-(1 << 32))
    # a fingerprint makes 64 rows: they are dealt out by number first, as few small partitions would have to spill
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    indexed = fps.select("fp").repartition(parts).select("fp", F.explode(F.expr(positions)).alias("v")).select("v.p", "v.sig", "fp")
    close = "bit_count(a ^ b) <= 2"
    groups = indexed.groupBy("p", "sig").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    groups = stored(groups)
    pairs = groups.where("n = 2").where(close).select("a", "b")
    crowded = groups.where("n > 2").select("p", "sig", "n")
    some = crowded.count()
    if not some:
        return pairs.distinct()
    members = stored(indexed.join(F.broadcast(crowded) if some <= MOST_BROADCAST else crowded.hint("merge"), ["p", "sig"]))
    few = members.where(F.col("n") <= MOST_PAIRED).groupBy("p", "sig").agg(F.array_sort(F.collect_list("fp")).alias("f"))
    few = few.select(F.explode(F.expr("flatten(transform(f, (a, i) -> transform(filter(slice(f, i + 2, size(f)), b -> bit_count(a ^ b) <= 2), b -> named_struct('a', a, 'b', b))))")).alias("x")).select("x.a", "x.b")
    many = members.where(F.col("n") > MOST_PAIRED).select("fp").distinct()
    masks = "flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> shiftleft(1L, i) | shiftleft(1L, j))))"
    two = many.select("fp", F.explode(F.expr(masks)).alias("mask")).withColumn("rest", F.expr("fp & ~mask"))
    star = two.groupBy("mask", "rest").agg(F.array_sort(F.collect_set("fp")).alias("f")).where("size(f) > 1")
    star = star.select(F.col("f")[0].alias("a"), F.explode(F.expr("slice(f, 2, 3)")).alias("b"))
    return pairs.union(few).union(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id): fingerprints within 2 bits link, and component_id is the smallest identifier
    reachable, itself included.

    Texts that are null or blank have fingerprint 0 and link like any other. Null identifiers never become a
    component_id unless a component has no other. An empty table gives none. Repeated rows stay.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width, seed))
    return rows.join(_component_of(rows), "fp").select("doc_id", "fp", "component_id")


def _component_of(rows: DataFrame) -> DataFrame:
    """(fp, component_id) of each distinct fingerprint of (doc_id, fp)."""
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    placed = stored(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(ids, "root").select("fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's fingerprint as 16 lowercase hex digits, and its component."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
