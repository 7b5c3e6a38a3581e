"""Exact top-k by inner product on a bit-sliced index.

A block of rows is kept as slices: for each component, a bitmap of the rows whose quantised value has bit b set. A query
adds the slices, each as often as its own component says, with full adders on whole bitmaps, which gives the slices of
all rows' scores. From the most significant of these downward, a slice splits the rows that are still open into those
that are surely among the best and those that are not; rows equal in all slices are settled by their identifier.

Blocks and batches of queries are rows of tables in the shared folder. Each pair of them is a key of its own, so that
no task has more than one block and one batch at hand, and a lost executor costs pairs and not the search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

#: Rows of a block: a bitmap has 16 KB then, so that an adder's five bitmaps stay in a core's cache.
BLOCK_ROWS = 131_072
#: Queries of a batch, at most; fewer where else there were fewer pairs than twice the cores.
BATCH_QUERIES = 8192
#: Tasks that pairs of a block and a batch are dealt to, at most; a task takes its pairs one by one.
MOST_TASKS = 100_000
#: Values a component is multiplied by before it is rounded down.
SCALE = 256.0
#: Quantised components stop here, so that they are exact in doubles.
MOST = float(1 << 52)
WORD_BITS = 64

BLOCK = "block int, n int, ids binary, low array<long>, bits array<int>, slices binary"
BATCH = "batch int, ids array<long>, vectors array<array<long>>"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, q): the quantised vectors. Vectors that are null or hold a null or a component that isn't finite take
    no part; an empty vector does, and its scores are 0."""
    x = F.col(vec_col).cast("array<double>")
    whole = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    q = F.transform(x, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c * F.lit(SCALE))))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(q, lambda c: F.floor(c).cast("long")).alias("q"))


def slice_block(q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and number of bits of each column, and the slices of all columns, least bit first: a row of 64-bit
    words each, in which bit r of the bitmap (in little-endian order) is row r."""
    n, d = q.shape
    low = q.min(axis=0) if n else np.zeros(d, np.int64)
    up = (q - low).astype(np.uint64)
    bits = np.array([int(m).bit_length() for m in up.max(axis=0)] if n else [0] * d, dtype=np.int32)
    words = -(-n // WORD_BITS)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for i in range(d):
        for b in range(int(bits[i])):
            packed = np.packbits(((up[:, i] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return low, bits, out.view(np.uint64)


def build(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The index: a row for each block of about `block_rows` rows, with its identifiers in ascending order (nulls last)
    and its slices. Shorter vectors count as if zeros followed. `vectors` has (vec_id, q) as `usable` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        ids, q = table.column(0).to_numpy(zero_copy_only=False), _matrix(table.column(1).combine_chunks())
        null = table.column(0).is_null().to_numpy(zero_copy_only=False)
        values = np.where(null, 0, ids).astype(np.int64)
        order = np.lexsort((values, null))
        low, bits, slices = slice_block(q[order])
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kept = pa.array([np.concatenate([values[order], null[order].astype(np.int64)]).tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(q)], pa.int32()), kept, pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([bits.tolist()], pa.list_(pa.int32())), pa.array([slices.tobytes()], pa.binary())], names=["block", "n", "ids", "low", "bits", "slices"])

    blocks = max(1, math.ceil(vectors.count() / block_rows))
    return stored(vectors.repartition(blocks).mapInArrow(run, BLOCK))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter lists filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, width = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def signed_digits(c: int) -> list[tuple[int, int]]:
    """(place, 1 or -1) of the digits of c in base 2 with signs, of which no two neighbours differ from 0: a third of
    the places on average."""
    out, place, sign, c = [], 0, (1 if c >= 0 else -1), abs(c)
    while c:
        if c & 1:
            digit = 2 - (c & 3)
            out.append((place, sign * digit))
            c -= digit
        c >>= 1
        place += 1
    return out


def add_slices(columns: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """The slices of the sum, least first, of bitmaps by their weight's place: three bitmaps of a place become one there
    and one in the next, until each place has one at most."""
    out, place = [], 0
    left = {k: list(v) for k, v in columns.items()}
    while left:
        here = left.pop(place, [])
        up = left.setdefault(place + 1, [])
        while len(here) > 2:
            third = len(here) // 3
            a, b, c = (np.concatenate(x) if len(x) > 1 else x[0] for x in (here[:third], here[third : 2 * third], here[2 * third : 3 * third]))
            half = a ^ b
            total, carry = half ^ c, (a & b) | (half & c)
            words = len(total) // third
            here = here[3 * third :] + [total[i * words : (i + 1) * words] for i in range(third)]
            up += [carry[i * words : (i + 1) * words] for i in range(third)]
        if len(here) == 2:
            up.append(here[0] & here[1])
            here = [here[0] ^ here[1]]
        out.append(here[0] if here else None)
        if not up:
            left.pop(place + 1)
        place += 1
    return out


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def best_rows(slices: list[np.ndarray | None], open_: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows of `open_` with the highest sums (all, if fewer); among equal ones those that come first."""
    sure = np.zeros_like(open_)
    for s in reversed(slices):
        if s is None:
            continue
        high = open_ & s
        tried = sure | high
        n = count(tried)
        if n > k:
            open_ = high
        else:
            sure, open_ = tried, open_ & ~s
            if n == k:
                return _rows(sure)
    rest = k - count(sure)
    return np.concatenate([_rows(sure), _rows(open_)[:rest]])


def _rows(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little") if len(words) else np.zeros((0, 64), np.uint8)
    row, bit = np.nonzero(bits)
    return words[row] * WORD_BITS + bit


class Block:
    """A block at hand: slices, their complements and the identifiers."""

    def __init__(self, n: int, ids: bytes, low: list[int], bits: list[int], slices: bytes):
        both = np.frombuffer(ids, np.int64)
        self.n, self.ids, self.null, self.low, self.bits = n, both[:n], both[n:] != 0, low, bits
        words = -(-n // WORD_BITS)
        self.slices = np.frombuffer(slices, np.uint64).reshape(-1, words)
        self.starts = np.concatenate([[0], np.cumsum(bits)]).astype(int)
        self.all = np.full(words, ~np.uint64(0))
        if n % WORD_BITS:
            self.all[-1] = np.uint64((1 << (n % WORD_BITS)) - 1)
        self.complement = ~self.slices & self.all

    def top(self, own: int, vector: list[int], k: int) -> list[tuple[int | None, int]]:
        """The k best (identifier, score) of a query; rows with its identifier take no part."""
        columns: dict[int, list[np.ndarray]] = {}
        base = 0
        for i, c in enumerate(vector[: len(self.bits)]):
            base += c * self.low[i]
            for place, sign in signed_digits(c):
                kept = self.slices if sign > 0 else self.complement
                if sign < 0:  # -s is the complement less a full slice
                    base -= ((1 << self.bits[i]) - 1) << place
                for b in range(self.bits[i]):
                    columns.setdefault(place + b, []).append(kept[self.starts[i] + b])
        sums = add_slices(columns)
        open_ = self.all.copy()
        for r in np.flatnonzero((self.ids == own) & ~self.null):
            open_[r // WORD_BITS] &= ~np.uint64(1 << int(r % WORD_BITS))
        out = []
        for r in best_rows(sums, open_, k):
            word, bit = int(r) // WORD_BITS, int(r) % WORD_BITS
            score = base + sum(1 << p for p, s in enumerate(sums) if s is not None and (int(s[word]) >> bit) & 1)
            out.append((None if self.null[r] else int(self.ids[r]), score))
        return out


def batches_of(queries: DataFrame, blocks: int, most: int = BATCH_QUERIES) -> DataFrame:
    """The queries, (vec_id, q), as rows of batches, dealt by their identifier."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n = queries.count()
    dealt = max(1, math.ceil(n / most), min(n, math.ceil(2 * cores / max(1, blocks))))
    batch = F.pmod(F.xxhash64("vec_id"), F.lit(dealt)).cast("int").alias("batch")
    return stored(queries.select(batch, F.struct("vec_id", "q").alias("x")).groupBy("batch").agg(F.sort_array(F.collect_list("x")).alias("x")).select("batch", F.col("x.vec_id").alias("ids"), F.col("x.q").alias("vectors")))


def search(index: DataFrame, queries: DataFrame, k: int = 5, batch_queries: int = BATCH_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of the index, ties to the smaller identifier, nulls last.

    `queries` has (vec_id, q); equal rows count once, and of several vectors with one identifier the least is the query.
    Rows with the query's identifier are its own and no candidates; other repeated rows are candidates, each of its own.
    A score beyond 64 bits is given as the nearest that has them. Without queries or rows there is no result."""
    queries = queries.where(F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = [r[0] for r in index.select("block").collect()]  # numbers: one for each 131,072 rows
    batches = batches_of(queries, len(blocks), batch_queries)
    dealt = [r[0] for r in batches.select("batch").collect()]
    each = lambda numbers: F.explode(F.lit(numbers).cast("array<int>"))
    # dealt out before the join, which may leave a block's copies in the task that read it
    copies = index.withColumn("batch", each(dealt)).repartition(max(1, min(MOST_TASKS, 3 * len(blocks) * len(dealt))), "block", "batch")
    pairs = copies.join(batches.withColumnRenamed("ids", "query_ids").withColumn("block", each(blocks)), ["block", "batch"])
    pairs = pairs.select("n", "ids", "low", "bits", "slices", "query_ids", "vectors")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for i in range(batch.num_rows):
                n, ids, low, bits, slices, query_ids, vectors = (batch.column(c)[i].as_py() for c in range(7))
                block, out = Block(n, ids, low, bits, slices), []
                for own, vector in zip(query_ids, vectors, strict=True):
                    out += [(own, v, max(-(1 << 63), min((1 << 63) - 1, s))) for v, s in block.top(own, vector, k)]
                cols = list(zip(*out, strict=True)) if out else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the 5 best rows of every row whose identifier is divisible by 50, against all rows of `embeddings`."""
    rows = usable(read(spark, sf_dir, "embeddings"))
    return search(build(rows), rows.where(F.col("vec_id") % 50 == 0))


#: The same in DuckDB's SQL.
ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
