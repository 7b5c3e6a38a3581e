"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, stored

WIDTH = 5
SIMILAR = 0.8
#: Bits that a window's fingerprint may differ in from its item's. At similarity 0.8 the cosine of two windows' shingle
#: counts is 0.89 and their angle 27 degrees, so each of 64 bits differs with a chance of 0.15: 9.7 bits on average, and
#: 15 or fewer in 97 % of the pairs; at 0.85 in 99.8 %, and nearly always above. The least recall that this stands for is 0.9.
RADIUS = 15
#: Blocks of 16 bits; two fingerprints within the radius differ in RADIUS // BLOCKS bits at most in some block.
BLOCKS = 4
#: Items, and bytes of them, that one pass over the documents looks for; a larger benchmark takes several passes.
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 16 << 20
#: Windows that are looked up at once.
LOOKED_UP = 1 << 10
#: Signs that don't count, and lower case for A to Z.
DROPPED = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def normal_words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(LOWER, DROPPED).split()


def shingle_hashes(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A 64-bit hash for each run of `width` words; of all words together if they are fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    runs = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True)) if n > 1 else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh3_64_intdigest, runs), dtype=np.uint64, count=max(n, 1))


def bit_votes(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each hash and bit."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def fingerprint(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=-1, bitorder="little").view(np.uint64).reshape(votes.shape[:-1])


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of shingles weighted by how often each occurs."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return both / (len(a) + len(b) - both) if both else 0.0


def masks(most: int) -> np.ndarray:
    """All 16-bit numbers of at most `most` set bits."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= most]


class ItemIndex:
    """Items by number of words, each size with an inverted index for each block of the fingerprint.

    Two fingerprints within the radius differ in r = RADIUS // BLOCKS bits at most in some block. So an item is listed
    under all values of its block at most r // 2 bits away, in order of the value, and a window looks up all values at
    most r - r // 2 bits away: whatever is within the radius meets, and one block value in some 94 does by chance.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], radius: int = RADIUS, similar: float = SIMILAR):
        self.radius, self.similar = radius, similar
        self.ids, self.hashes, self.sizes = [], [], []
        for item_id, raw in items:
            words = normal_words(raw)
            if words:
                self.ids.append(item_id)
                self.hashes.append(shingle_hashes(words))
                self.sizes.append(len(words))
        self.vocabulary = {w for _, raw in items for w in normal_words(raw)}
        self.with_shingle: dict[int, set[int]] = {}
        for i, hashes in enumerate(self.hashes):
            for h in hashes.tolist():
                self.with_shingle.setdefault(h, set()).add(self.sizes[i])
        self.known = np.sort(np.fromiter(self.with_shingle, dtype=np.uint64, count=len(self.with_shingle)))
        self.shortest = min(self.sizes, default=0)
        self.short = sorted({n for n in self.sizes if n < WIDTH})
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        r = radius // BLOCKS
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        self.asked, listed = masks(r - r // 2), masks(r // 2)
        for n in set(self.sizes):
            at = np.array([i for i, k in enumerate(self.sizes) if k == n])
            fps = fingerprint(np.stack([bit_votes(self.hashes[i]).sum(axis=0, dtype=np.int32) for i in at]))
            tables = []
            for block in fps.view(np.uint16).reshape(-1, BLOCKS).T:
                values = (block[:, None] ^ listed).ravel()
                order = np.argsort(values, kind="stable")
                tables.append((values[order], (order // len(listed)).astype(np.int32)))
            self.by_size[n] = at, fps, tables

    def lookup(self, size: int, fps: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) for all windows and items of this size whose fingerprints are within radius."""
        at, items, tables = self.by_size[size]
        found = []
        for lo in range(0, len(fps), LOOKED_UP):
            some, pairs = fps[lo : lo + LOOKED_UP], []
            for (values, owner), block in zip(tables, some.view(np.uint16).reshape(-1, BLOCKS).T, strict=True):
                asked = (block[:, None] ^ self.asked).ravel()
                first = np.searchsorted(values, asked, side="left")
                count = np.searchsorted(values, asked, side="right") - first
                hit = np.flatnonzero(count)
                first, count = first[hit], count[hit]
                place = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                pairs.append(np.repeat(hit // len(self.asked), count).astype(np.int64) * len(items) + owner[place])
            w, i = np.divmod(np.unique(np.concatenate(pairs)), len(items))
            close = np.bitwise_count(some[w] ^ items[i]) <= self.radius
            found += zip((w[close] + lo).tolist(), at[i[close]].tolist(), strict=True)
        return found

    def hits(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of `width` words that are an item's shingle, and those shingles. Most words are in no
        item, and only runs of words that all are get hashed."""
        known = np.fromiter(map(self.vocabulary.__contains__, words), dtype=bool, count=len(words))
        run = known[: len(words) - width + 1].copy()
        for i in range(1, width):
            run &= known[i : len(words) - width + 1 + i]
        starts = np.flatnonzero(run)
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[s : s + width])) for s in starts.tolist()), dtype=np.uint64, count=len(starts))
        at = np.searchsorted(self.known, hashes)
        found = self.known[np.minimum(at, len(self.known) - 1)] == hashes
        return starts[found], hashes[found]

    def find(self, raw: bytes | None) -> list[tuple[int, float, int]]:
        """(item, best similarity, first word of its window) of each item that the text holds.

        Windows that share no shingle with any item have similarity 0 and are passed over; all other windows of
        the sizes of the items that share one are fingerprinted.
        """
        words = normal_words(raw)
        if not words or not self.ids:
            return []
        best: dict[int, tuple[float, int]] = {}
        for width in [*self.short, WIDTH]:
            if len(words) >= width:
                starts, shingles = self.hits(words, width)
                if len(starts):
                    self.windows(words, width, starts, shingles, best)
        return [(i, *best[i]) for i in sorted(best)]

    def windows(self, words: list[bytes], width: int, starts: np.ndarray, shingles: np.ndarray, best: dict) -> None:
        wanted: dict[int, list[int]] = {}
        for s, h in zip(starts.tolist(), shingles.tolist(), strict=True):
            for size in self.with_shingle[h]:
                if min(size, WIDTH) == width:
                    wanted.setdefault(size, []).append(s)
        for size, at in wanted.items():
            n = min(size, len(words))  # a shorter text is one window
            near = np.asarray(at)
            # runs of windows that hold a hit, each handled alone so that memory follows the hits
            first, last = np.maximum(near - (n - width), 0), np.minimum(near, len(words) - n)
            ends = np.maximum.accumulate(last)
            new = np.append(True, first[1:] > ends[:-1] + 1)
            groups = np.flatnonzero(new)
            for g, (a, b) in enumerate(zip(first[groups].tolist(), np.append(ends[groups[1:] - 1], ends[-1]).tolist(), strict=True)):
                for lo in range(a, b + 1, 1 << 14):
                    self.compare(words, size, n, width, lo, min(b, lo + (1 << 14) - 1), best)

    def compare(self, words: list[bytes], size: int, n: int, width: int, lo: int, hi: int, best: dict) -> None:
        """Windows of n words that start from lo to hi."""
        hashes = shingle_hashes(words[lo : hi + n], width)
        per = n - width + 1
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bit_votes(hashes), axis=0, dtype=np.int32)])
        count = hi - lo + 1
        fps = np.ascontiguousarray(fingerprint(sums[per : per + count] - sums[:count]))
        for w, item in self.lookup(size, fps):
            similar = weighted_similarity(hashes[w : w + per], self.hashes[item])
            if similar >= self.similar and similar > best.get(item, (0.0, 0))[0]:
                best[item] = similar, lo + w


def indexes(benchmark: DataFrame, id_col: str, text_col: str, items_a_pass: int = ITEMS_A_PASS) -> Iterator[ItemIndex]:
    """The benchmark, a stated set of queries, in blocks of a bounded number of items and bytes. Null and blank items are left out."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").orderBy("i", "t")
    block, size = [], 0
    for r in rows.toLocalIterator():
        block.append((r["i"], r["t"].encode()))
        size += len(block[-1][1])
        if len(block) == items_a_pass or size >= BYTES_A_PASS:
            yield ItemIndex(block)
            block, size = [], 0
    if block:
        yield ItemIndex(block)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, similarity, at_word): a row for each item that a document's text holds a near copy of.

    Words are what white space leaves after ASCII signs are dropped and A to Z lower-cased. A document holds an item
    if one of its windows of as many words (the whole text, if it has fewer) is within RADIUS bits of it by fingerprint
    and has a weighted similarity of SIMILAR or more on shingles of five words; an item of fewer than five words is
    one shingle. Null and empty texts hold none. Repeated rows of either table give repeated results; null identifiers
    are kept. Texts of any length are searched whole; other columns are ignored. Each block of items has a pass of its
    own, whose result is written before the next block is sent to the executors.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, at_word int"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark, item_id_col, item_text_col, items_a_pass):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, text in slices(batches, 1):
                ids, found = batch.column(0).to_pylist(), []
                for doc_id, raw in zip(ids, text.to_pylist(), strict=True):
                    found += [(doc_id, shared.value.ids[i], similar, at) for i, similar, at in shared.value.find(raw)]
                cols = list(zip(*found, strict=True)) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "at_word"])

        out = out.unionByName(stored(rows.mapInArrow(run, schema)))
        shared.unpersist()
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The rows of `docs`, with all columns, whose text holds no item: as leaks(), row by row, without a join. Each block
    of items has a pass of its own, whose rows are written before the next block is sent. No items: all rows."""
    at, schema = docs.columns.index(text_col), docs.schema
    for index in indexes(benchmark, item_id_col, item_text_col, items_a_pass):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, text in slices(batches, at):
                yield batch.filter(pa.array([not shared.value.find(x) for x in text.to_pylist()], pa.bool_()))

        docs = stored(docs.mapInArrow(run, schema))
        shared.unpersist()
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the benchmark items that documents hold."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "at_word")
