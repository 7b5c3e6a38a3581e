"""Repeated byte strings by bucket-pointer refinement over sampled suffixes.

A string of `length` bytes that starts anywhere is a window. Each window has one anchor: the leftmost of its q-grams
with the least hash. Equal windows have equal anchors at equal offsets, so only suffixes at anchors need initial
buckets, one for each anchor q-gram in the whole corpus; the windows of one anchor are neighbours and make a span.

1. Buckets are counted. A bucket of one suffix holds no repeat. In a bucket whose spans are all equal, every window
   repeats. Both are settled without their text.
2. What is left is each bucket's distinct spans. Their windows are refined as in bucket-pointer refinement: all
   positions get the identifier of the bucket of their first 8 bytes, and a position's bucket for twice the length
   is found by sorting on its own identifier and the one of the position that much later. New identifiers are
   reused in the next round, and positions whose bucket has one member are out. After 200 bytes the buckets with
   two or more members are the repeats. Identifiers are ranks of exact pairs, so nothing rests on hashing here.
   A bucket with too many distinct spans for one task is refined over several first: its windows are halved by their
   distance from the anchor, and each half's windows have bytes in common, by which they fall into new buckets. That
   is done again with the halves that still are crowded; in the end a bucket's windows are single and equal.
3. The windows found are joined into runs by document, and taken out of the bytes.
"""

from __future__ import annotations

import atexit
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, scratch, slices, stored

LENGTH = 200
QGRAM = 32
#: Bytes of distinct spans of one bucket that a task refines; a bucket of more is refined over several tasks first.
BUCKET_BYTES = 1 << 20
#: Tasks that the copies of one span go to.
SALTS = 16
#: Bytes of spans that are refined at once.
REFINE_BYTES = 2 << 20
#: Bytes of a document that are searched for anchors at once.
CHUNK = 4 << 20


def qgram_hashes(buf: np.ndarray, q: int = QGRAM) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position that has them; q is a power of two of 8 or more."""
    n = len(buf) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.append(buf, np.zeros(8, np.uint8))
    h = np.empty(len(buf), np.uint64)
    for k in range(8):  # 8 bytes from each position, little endian
        part = padded[k : k + (len(padded) - k) // 8 * 8].view("<u8")
        at = h[k::8]
        at[:] = part[: len(at)]
    mul, size = np.uint64(0x9FB21C651E98DF25), 8
    h *= mul
    h ^= h >> np.uint64(32)
    while size < q:
        h = h[: len(h) - size] * mul + h[size:]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD6E8FEB86659FD93)
        size *= 2
    return h[:n]


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` hashes the place of its least one, the leftmost of equals (by their upper 40 bits)."""
    key = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    return (key & np.uint64(0xFFFFFF)).astype(np.int64)


def anchors(raw: bytes, length: int = LENGTH, q: int = QGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket hash, anchor place, first and last window start of each span of a text. A text longer than CHUNK is
    searched in overlapping parts; a span that a border cuts is two spans, whose windows are all there."""
    out = []
    for at in range(0, max(1, len(raw) - length + 1), CHUNK):
        buf = np.frombuffer(raw, dtype=np.uint8, count=min(len(raw) - at, CHUNK + length - 1), offset=at)
        if len(buf) < length:
            continue
        h = qgram_hashes(buf, q)
        place = least_places(h, length - q + 1)
        new = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(new[1:], len(place)) - 1
        out.append((h[place[new]], place[new] + at, new + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def span_table(docs: DataFrame, length: int, q: int) -> DataFrame:
    """(row, bucket, first, last, lead, span): the spans of each text; span hashes its bytes and its anchor's place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1):
            rows = batch.column(0).to_pylist()
            for at, raw in zip(rows, text.to_pylist(), strict=True):
                if raw is None or len(raw) < length:
                    continue
                bucket, place, first, last = anchors(raw, length, q)
                lead = place - first
                view = memoryview(raw)
                span = np.fromiter((xxhash.xxh3_64_intdigest(view[a : b + length], d) for a, b, d in zip(first.tolist(), last.tolist(), lead.tolist(), strict=True)), dtype=np.uint64, count=len(first))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), at)), pa.array(bucket.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(lead.astype(np.int16)), pa.array(span.view(np.int64))], names=["row", "bucket", "first", "last", "lead", "span"])

    return docs.select("row", "text").mapInArrow(run, "row long, bucket long, first int, last int, lead short, span long")


def refine(group: np.ndarray, lead: np.ndarray, spans: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each span whether each of its windows is also a window of another span of its group at the same distance
    from the anchor. `group` is a number for each span.

    Buckets start as (group, distance from the anchor, first 8 bytes) and are refined by the identifiers of later
    offsets, the length doubling each round.
    """
    sizes = np.array([len(s) for s in spans])
    ends = np.cumsum(sizes)
    buf = np.frombuffer(b"".join(spans) + bytes(8), dtype=np.uint8)
    total = int(ends[-1])
    owner = np.repeat(np.arange(len(spans)), sizes)
    inside = np.arange(total) - np.repeat(ends - sizes, sizes)
    words = np.empty(total, np.uint64)
    for k in range(8):
        part = buf[k : k + (len(buf) - k) // 8 * 8].view("<u8")
        at = words[k::8]
        at[:] = part[: len(at)]
    place = inside - lead[owner]
    key = np.stack([group[owner].astype(np.uint64), place.astype(np.int64).view(np.uint64)])
    # initial buckets: the 8 bytes of a position, with its group and its place beside the anchor
    first = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    where = np.unique(key[0] << np.uint64(20) | (key[1] + np.uint64(1 << 19)), return_inverse=True)[1].astype(np.uint64)
    pointer = np.unique(where << np.uint64(32) | first, return_inverse=True)[1].astype(np.int64)
    room = np.repeat(sizes, sizes) - inside  # bytes up to the span's end
    have = 8
    while have < length:
        step = min(have, length - have)
        live = np.flatnonzero(room >= have + step)
        pair = pointer[live].astype(np.uint64) << np.uint64(32) | pointer[live + step].astype(np.uint64)
        ids, counts = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        have += step
        room = room.copy()
        new = np.full(total, -1, dtype=np.int64)
        # a bucket of one member can't be refined: its position gets an identifier that meets no other
        new[live] = ids
        pointer = new
        pointer[pointer < 0] = total + np.flatnonzero(pointer < 0)
        final = (live, counts[ids] > 1)
    flags = np.zeros(total, dtype=bool)
    live, more = final
    flags[live] = more
    return [flags[e - s : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def halved(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece's windows as two pieces, by their distance from the anchor: lo to before hi becomes lo to before the
    middle and the rest. All windows of a half have the bytes from the half's last start to its first window's end in
    common, and these make its new bucket; bytes that no window of the half has are cut off."""
    half = """named_struct('lo', {l}, 'hi', {h}, 'i', greatest(0, {l} + lead), 'j', least(length(bytes) - {n} + 1, {h} + lead), 'bucket', xxhash64(bucket, {l}, substring(bytes, lead + {h}, {l} + {n} - {h} + 1)))"""
    middle = "cast(floor((lo + hi) / 2) as int)"
    both = ", ".join(half.format(l=a, h=b, n=length) for a, b in (("lo", middle), (middle, "hi")))
    each = pieces.select("row", "copies", "first", "lead", "bytes", F.explode(F.expr(f"array({both})")).alias("x")).where("x.i < x.j")
    return each.select("x.bucket", "row", "copies", F.expr("first + x.i").alias("first"), F.expr("cast(lead - x.i as int)").alias("lead"), F.expr(f"substring(bytes, x.i + 1, x.j - x.i + {length} - 1)").alias("bytes"), "x.lo", "x.hi")


def runs(flags: np.ndarray, first: int, length: int) -> list[tuple[int, int]]:
    """The byte ranges that flagged windows cover, where flag 0 is of the window at `first`."""
    at = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(first + a, first + b - 1 + length) for a, b in zip(at[::2].tolist(), at[1::2].tolist(), strict=True)]


def repeated_ranges(docs: DataFrame, length: int = LENGTH, q: int = QGRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(row, ranges): for each row with any, the byte ranges [a, b) that windows found elsewhere too cover, not merged.

    `docs` has a unique `row` and `text`.
    """
    spans = stored(span_table(docs, length, q))
    buckets = spans.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi")).where("n > 1")
    buckets = stored(buckets.select("bucket", (F.col("lo") == F.col("hi")).alias("alike")))
    kept = stored(spans.join(buckets, "bucket"))
    settled = kept.where("alike").select("row", "first", F.col("last").alias("last"))
    mixed = kept.where(~F.col("alike"))
    # of equal spans one goes on for the others to be held against; each is a repeat itself
    same = stored(mixed.groupBy("bucket", "span").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "first", "last", "lead")).alias("one")))
    # a span may have any number of copies: they are dealt out over SALTS tasks
    twice = same.where("copies > 1").select("bucket", "span", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = mixed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(twice, ["bucket", "span", "salt"]).select("row", "first", "last")
    wanted = same.select("bucket", "copies", "one.*")
    want = wanted.groupBy("row").agg(F.collect_list(F.struct("bucket", "copies", "first", "last", "lead")).alias("want"))
    cut = docs.join(want.hint("shuffle_hash"), "row").select("row", F.col("text").cast("binary").alias("text"), "want")
    cut = cut.select("row", "text", F.explode("want").alias("w")).select("row", "w.*", F.expr(f"substring(text, w.first + 1, w.last - w.first + {length})").alias("bytes"))
    cut = stored(cut)
    pieces = cut.select("bucket", "row", "copies", "first", "lead", "bytes", F.lit(q - length).alias("lo"), F.lit(1).alias("hi"))
    found, ready = [], []
    while True:
        # single windows of one bucket have all their bytes in common: what is left is to count them
        crowded = pieces.where("hi - lo > 1").groupBy("bucket").agg(F.sum(F.length("bytes")).alias("size")).where(F.col("size") > bucket_bytes).select("bucket")
        crowded = stored(crowded)
        if crowded.isEmpty():
            ready.append(pieces)
            break
        ready.append(pieces.join(crowded, "bucket", "left_anti"))
        pieces = stored(halved(pieces.join(crowded, "bucket", "left_semi"), length))
    small = ready[0]
    for x in ready[1:]:
        small = small.unionByName(x)
    if len(ready) > 1:
        single = small.where("hi - lo = 1")
        twice = single.groupBy("bucket", "bytes").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        found.append(single.where("copies = 1").join(twice, ["bucket", "bytes"], "left_semi").select("row", F.col("first").cast("long").alias("a"), (F.col("first") + length).cast("long").alias("b")))
        small = small.where("hi - lo > 1")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for batch in batches:
            for r in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if size >= REFINE_BYTES and r[0] != held[-1][0]:  # whole buckets only
                    yield refined(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
        if held:
            yield refined(held)

    def refined(held: list) -> pa.RecordBatch:
        group = np.unique([r[0] for r in held], return_inverse=True)[1]
        flags = refine(group, np.array([r[4] for r in held]), [r[5] for r in held], length)
        out = [(r[1], a, b) for r, f in zip(held, flags, strict=True) if r[2] == 1 for a, b in runs(f, r[3], length)]
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "a", "b"])

    by_bucket = small.select("bucket", "row", "copies", "first", "lead", "bytes").repartition("bucket").sortWithinPartitions("bucket")
    found.append(by_bucket.mapInArrow(run, "row long, a long, b long"))
    for one in (settled, again):
        found.append(one.select("row", F.col("first").cast("long").alias("a"), (F.col("last") + length).cast("long").alias("b")))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def without(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the ranges, and the ranges where they touch or overlap as one."""
    merged: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    out, at = [], 0
    for a, b in merged:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), merged


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def by_row(rows: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by `row`: what is found for a row meets its text without the
    texts being shuffled again."""
    spark = rows.sparkSession
    n, at = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch(spark, "rows")
    name = "tallyloom_" + at.rpartition("-")[2]
    rows.repartition(n, "row").write.bucketBy(n, "row").option("compression", "zstd").option("path", at).saveAsTable(name)
    atexit.register(_drop, spark, name)  # the files go when the driver ends, so the catalogue's entry has to go too
    return spark.table(name)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = QGRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every row's bytes without those that a repeated window covers.

    A window repeats if its bytes also start anywhere else, in another row or at another place of the same row,
    overlapping or not. Windows lie within one row's UTF-8 bytes, and all are judged on the input. Null texts count
    as empty; texts shorter than a window lose nothing. Repeated rows are rows of their own, so that both lose
    their text. Null identifiers are kept; other columns are ignored; an empty table gives none.
    """
    rows = by_row(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("string").alias("text")))
    ranges = repeated_ranges(rows, length, q, bucket_bytes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1):
            out = []
            for raw, found in zip(text.to_pylist(), batch.column(2).to_pylist(), strict=True):
                kept, merged = without(raw, [(r["a"], r["b"]) for r in found or []])
                out.append((len(raw), len(raw) - len(kept), len(merged), kept))
            n, removed, spans, kept = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.join(ranges.hint("shuffle_hash"), "row", "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: what repeats take from every document, and the digest of the rest."""
    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The same by a dictionary of all windows, for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t or b"") - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        t = t or b""
        kept, merged = without(t, [(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        out.append((len(t), len(t) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
    return out
