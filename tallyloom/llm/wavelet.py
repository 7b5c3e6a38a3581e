"""Ranked lexical search on dual-sorted wavelet trees, one for each shard of documents.

A shard's postings are one sequence of document numbers, term after term, each term's by descending impact. A wavelet
tree over that sequence (in the layout of a wavelet matrix: a level is one bitmap, zeros go before ones) splits it by
document number and keeps the order within each node. So a term's postings in a node are one range, whose first has the
greatest impact that the term reaches below the node, and the same tree is walked by document number.

A search holds nodes with the ranges of its item's terms. A node's bound is the sum over its ranges of weight times first
impact; the best nodes are opened first, for all items of a chunk in one step, and what can't be among the best any more
is dropped. At a leaf the bound is the document's score. A task carries each item's best so far from shard to shard.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

#: The maximal runs that are terms, for Java's, DuckDB's and Python's regular expressions.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes outside terms become blanks, A-Z become a-z; bytes of other letters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Postings of a shard, about; a document with more is a shard of its own.
SHARD_POSTINGS = 1 << 20
#: Postings that a chunk of items may reach in a shard (one item may reach more).
CHUNK_POSTINGS = 1 << 20
#: Items and bytes of their texts that one pass searches for.
PASS_ITEMS, PASS_BYTES = 4096, 8 << 20
#: Nodes of an item that the first step opens; each step opens twice as many as the one before.
FIRST_NODES = 16
NO_ID = np.iinfo(np.int64).max
IMPACT_BITS = 20

INDEX = "docs int, ids binary, no_id int, terms binary, starts binary, impacts binary, levels int, bits binary"


def terms_of(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(FOLD).split()


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms all of them have."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(TERM)), F.lit(0)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, n: int, documents: int, all_terms: int) -> np.ndarray:
    m = 25 + (75 * n * documents) // all_terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class ShardBuilder:
    """Gathers documents until a shard is full, and gives it as a row of the index."""

    def __init__(self, documents: int, all_terms: int):
        self.documents, self.all_terms = documents, all_terms
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids, self.null, self.of, self.impacts, self.sizes, self.size = [], [], [], [], [], 0

    def add(self, doc_id: int | None, counts: Counter) -> None:
        numbers = self.numbers
        self.ids.append(NO_ID if doc_id is None else doc_id)
        self.null.append(doc_id is None)
        self.of.append(np.array([numbers.setdefault(t, len(numbers)) for t in counts], np.int64))
        tf = np.fromiter(counts.values(), np.int64, len(counts))
        self.impacts.append(impact(tf, int(tf.sum()), self.documents, self.all_terms))
        self.sizes.append(len(counts))
        self.size += len(counts)

    def row(self) -> dict:
        ids, null = np.array(self.ids, np.int64), np.array(self.null)
        order = np.lexsort((ids, null))
        number = np.empty(len(ids), np.int64)
        number[order] = np.arange(len(ids))  # documents are numbered in the order of their identifiers, nulls last
        levels = max(1, int(len(ids) - 1).bit_length())
        # by term, then impact downward, then document, in one sort of 64-bit keys
        of, found = np.concatenate(self.of), np.concatenate(self.impacts)
        key = (of << (IMPACT_BITS + levels)) | (((1 << IMPACT_BITS) - 1 - found) << levels) | np.repeat(number, self.sizes)
        key.sort()
        starts = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(self.numbers)))]).astype(np.int64)
        impacts = ((1 << IMPACT_BITS) - 1 - ((key >> levels) & ((1 << IMPACT_BITS) - 1))).astype(np.int32)
        docs, bits = (key & ((1 << levels) - 1)).astype(np.int32), []
        for level in range(levels):
            one = (docs >> (levels - 1 - level)) & 1 == 1
            bits.append(np.packbits(one, bitorder="little").tobytes())
            docs = np.concatenate([docs[~one], docs[one]])
        out = {"docs": len(ids), "ids": ids[order].tobytes(), "no_id": int(null.sum()), "terms": b" ".join(self.numbers), "starts": starts.tobytes(), "impacts": impacts.tobytes(), "levels": levels, "bits": b"".join(bits)}
        self.clear()
        return out


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> tuple[DataFrame, int]:
    """The index, a row for each shard, and the number of documents that have a term (with which terms are weighed).

    Shards are built where the documents are read, without a shuffle. Null texts and texts without a term are in none;
    null identifiers and repeated rows are documents like others."""
    documents, all_terms = totals(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = ShardBuilder(documents, all_terms)
        schema = pa.schema([("docs", pa.int32()), ("ids", pa.binary()), ("no_id", pa.int32()), ("terms", pa.binary()), ("starts", pa.binary()), ("impacts", pa.binary()), ("levels", pa.int32()), ("bits", pa.binary())])
        give = lambda: pa.RecordBatch.from_pylist([shard.row()], schema)
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                counts = Counter(terms_of(text[i].as_py()))
                if not counts:
                    continue
                if shard.size and shard.size + len(counts) > shard_postings:
                    yield give()
                shard.add(doc_id, counts)
        if shard.size:
            yield give()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(rows.mapInArrow(run, INDEX)), documents


def frequencies(index: DataFrame, terms: list[bytes]) -> dict[bytes, int]:
    """In how many documents each term is; only the shards' vocabularies are read. The terms are those of one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, found = {t: i for i, t in enumerate(terms)}, Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                n = np.diff(np.frombuffer(batch.column(1)[i].as_py(), np.int64))
                for k, t in enumerate(batch.column(0)[i].as_py().split(b" ")):
                    if t in wanted:
                        found[wanted[t]] += int(n[k])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    rows = index.select("terms", "starts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df"))
    return {terms[i]: n for i, n in rows.collect()}


class Shard:
    """A shard at hand: of each level the running count of ones and the impacts in the level's order."""

    def __init__(self, docs: int, ids: bytes, no_id: int, terms: bytes, starts: bytes, impacts: bytes, levels: int, bits: bytes, wanted: dict[bytes, int]):
        self.ids, self.named, self.levels = np.frombuffer(ids, np.int64), docs - no_id, levels
        self.starts = np.frombuffer(starts, np.int64)
        self.terms = {wanted[t]: i for i, t in enumerate(terms.split(b" ")) if t in wanted}
        at = np.frombuffer(impacts, np.int32)
        n, packed = len(at), np.frombuffer(bits, np.uint8).reshape(levels, -1)
        self.ones, self.impacts = np.zeros((levels, n + 1), np.int32), np.empty((levels + 1, n), np.int32)
        for level in range(levels):
            one = np.unpackbits(packed[level], count=n, bitorder="little").astype(bool)
            np.cumsum(one, out=self.ones[level, 1:])
            self.impacts[level] = at
            at = np.concatenate([at[~one], at[one]])
        self.impacts[levels] = at
        self.zeros = n - self.ones[:, n]


class Nodes:
    """Nodes of the tree that items have reached: `item`, `level`, `prefix` (of the document's number) and `bound`, and
    from `first` on, `size` ranges [lo, hi) with the item's weight for the term."""

    def __init__(self, item, level, prefix, bound, size, lo, hi, weight):
        self.item, self.level, self.prefix, self.bound, self.size = item, level, prefix, bound, size
        self.lo, self.hi, self.weight = lo, hi, weight

    def take(self, keep: np.ndarray) -> Nodes:
        """The nodes of those numbers, in that order."""
        first = np.cumsum(self.size) - self.size
        size = self.size[keep]
        at = np.arange(int(size.sum())) + np.repeat(first[keep] - (np.cumsum(size) - size), size)
        return Nodes(self.item[keep], self.level[keep], self.prefix[keep], self.bound[keep], size, self.lo[at], self.hi[at], self.weight[at])

    @staticmethod
    def join(parts: list[Nodes]) -> Nodes:
        return Nodes(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("item", "level", "prefix", "bound", "size", "lo", "hi", "weight")))

    def children(self, shard: Shard, right: int) -> Nodes:
        """The children on one side, without ranges that are empty and nodes that have none."""
        node = np.repeat(np.arange(len(self.item)), self.size)
        level = self.level[node]
        lo, hi = shard.ones[level, self.lo], shard.ones[level, self.hi]
        lo, hi = (shard.zeros[level] + lo, shard.zeros[level] + hi) if right else (self.lo - lo, self.hi - hi)
        keep = np.flatnonzero(hi > lo)
        node, lo, hi, weight = node[keep], lo[keep], hi[keep], self.weight[keep]
        size = np.bincount(node, minlength=len(self.item))
        kept = np.flatnonzero(size)
        size = size[kept]
        worth = weight * shard.impacts[self.level[node] + 1, lo]
        bound = np.add.reduceat(worth, np.cumsum(size) - size) if len(kept) else np.zeros(0, np.int64)
        return Nodes(self.item[kept], self.level[kept] + 1, 2 * self.prefix[kept] + right, bound, size, lo, hi, weight)


class Best:
    """The best documents of each item so far, and what a document has to beat."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.item, self.score, self.doc, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.least, self.last = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        item, score, doc, null = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order, full = order[place < self.k], order[place == self.k - 1]
        self.least[item[place == self.k - 1]], self.last[item[place == self.k - 1]] = score[full], doc[full]
        self.item, self.score, self.doc, self.null = item[place < self.k], score[order], doc[order], null[order]

    def open(self, item: np.ndarray, bound: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether a node with that bound and least document may hold one of the best."""
        least = self.least[item]
        return (bound > least) | ((bound == least) & (doc < self.last[item]))


def search_shard(shard: Shard, items: list[list[tuple[int, int]]], best: Best) -> None:
    """Meets all items, lists of (term, weight), with one shard; chunks of them go through the tree together."""
    chunk: list[tuple[int, list[tuple[int, int]]]] = []
    reached = 0
    for i, wanted in enumerate(items):
        own = [(shard.terms[t], w) for t, w in wanted if t in shard.terms and w > 0]
        if own:
            size = sum(int(shard.starts[t + 1] - shard.starts[t]) for t, _ in own)
            if chunk and reached + size > CHUNK_POSTINGS:
                _descend(shard, chunk, best)
                chunk, reached = [], 0
            chunk.append((i, own))
            reached += size
    if chunk:
        _descend(shard, chunk, best)


def _descend(shard: Shard, chunk: list[tuple[int, list[tuple[int, int]]]], best: Best) -> None:
    flat = [(t, w) for _, own in chunk for t, w in own]
    term, weights = np.array([t for t, _ in flat]), np.array([w for _, w in flat], np.int64)
    size = np.array([len(own) for _, own in chunk])
    lo, hi = shard.starts[term], shard.starts[term + 1]
    bound = np.add.reduceat(weights * shard.impacts[0, lo], np.cumsum(size) - size)
    zero = np.zeros(len(chunk), np.int64)
    open_, width = Nodes(np.array([i for i, _ in chunk]), zero, zero, bound, size, lo, hi, weights), FIRST_NODES
    while len(open_.item):
        doc = shard.ids[open_.prefix << (shard.levels - open_.level)]
        may = best.open(open_.item, open_.bound, doc)
        order = np.lexsort((doc, -open_.bound, open_.item))
        order = order[may[order]]
        item = open_.item[order]
        place = np.arange(len(order)) - np.searchsorted(item, item)
        now, later = open_.take(order[place < width]), open_.take(order[place >= width])
        parts = [later] + [now.children(shard, side) for side in (0, 1)]
        for i in (1, 2):
            leaf = parts[i].level == shard.levels
            if leaf.any():
                at = parts[i].prefix[leaf]
                best.add(parts[i].item[leaf], parts[i].bound[leaf], shard.ids[at], at >= shard.named)
                parts[i] = parts[i].take(np.flatnonzero(~leaf))
        open_, width = Nodes.join(parts), 2 * width


def passes(items: DataFrame, id_col: str, text_col: str, most: int = PASS_ITEMS, most_bytes: int = PASS_BYTES) -> Iterator[list[tuple[int | None, Counter]]]:
    """Items with a term, as many at a time as one pass takes, streamed through the driver."""
    kept, size = [], 0
    for item_id, text in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).distinct().toLocalIterator():
        counts = Counter(terms_of(text))
        if counts:
            if kept and (len(kept) == most or size + len(text) > most_bytes):
                yield kept
                kept, size = [], 0
            kept.append((item_id, counts))
            size += len(text)
    if kept:
        yield kept


def search(index: DataFrame, documents: int, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", most: int = PASS_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0, ties to the smaller identifier,
    nulls last.

    Equal items (identifier and text) count once; an identifier with several texts is several items. Items without a term
    have no row, nor have any where the index is empty. Repeated documents are ranked each."""
    spark, found = index.sparkSession, None
    for wanted in passes(items, id_col, text_col, most):
        one = _search_pass(index, documents, wanted, k)
        found = one if found is None else stored(found).union(stored(one))
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def _search_pass(index: DataFrame, documents: int, wanted: list[tuple[int | None, Counter]], k: int) -> DataFrame:
    spark = index.sparkSession
    terms = sorted({t for _, counts in wanted for t in counts})
    df = frequencies(index, terms)
    number = {t: i for i, t in enumerate(terms) if t in df}
    items = [[(number[t], n * weight(documents, df[t])) for t, n in counts.items() if t in number] for _, counts in wanted]
    sent = spark.sparkContext.broadcast((number, items))  # bounded as `passes` says

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, items = sent.value
        best = Best(len(items), k)
        for batch in batches:
            for i in range(batch.num_rows):
                search_shard(Shard(*(batch.column(c)[i].as_py() for c in range(batch.num_columns)), number), items, best)
        yield pa.RecordBatch.from_arrays([pa.array(best.item, pa.int32()), pa.array(best.doc, pa.int64(), mask=best.null), pa.array(best.score, pa.int64())], names=["no", "doc_id", "score"])

    found = index.mapInArrow(run, "no int, doc_id long, score long")
    order = Window.partitionBy("no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ids = F.lit([i for i, _ in wanted]).cast("array<long>")
    return found.select(F.element_at(ids, F.col("no") + 1).alias("item_id"), "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the 10 best documents of every item of `benchmark`, of all `documents`."""
    index, documents = build(read(spark, sf_dir, "documents"))
    return search(index, documents, read(spark, sf_dir, "benchmark"))


#: The same in DuckDB's SQL.
ORACLE = r"""
WITH fold AS (SELECT doc_id, row_number() OVER () AS row_no, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT doc_id, row_no, ts, len(ts)::BIGINT AS n FROM fold WHERE len(ts) > 0),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM d),
p AS (SELECT doc_id, row_no, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, row_no, n, unnest(ts) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, count(*)::BIGINT AS qtf FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t), tot),
s AS (
  SELECT item_id, doc_id, row_no, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // l))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t), tot GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""
