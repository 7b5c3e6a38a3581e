"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices
from .rules import held_out
from .text_stats import BASE, MORE, document_stats, ratios

#: Labelled rows that training sees at most, the first by a hash of the identifier; scoring has no bound.
MOST_LABELLED = 6_000
WORD_BITS = 14
LENGTHS = 24
DENSE = len(ratios({c: 0.0 for c in [*BASE, *MORE]}))


def features(raw: bytes | None, bits: int = WORD_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse indexes and values, and the dense statistics, of a whole text.

    Indexes below 2**bits are hashed lower-case words, valued by the square root of their share; the LENGTHS after
    them mark the binary order of magnitude of the length.
    """
    raw = raw or b""
    words = raw.lower().split()
    stats = document_stats(raw)
    at, n = np.unique(np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words)) & ((1 << bits) - 1), return_counts=True)
    length = (1 << bits) + min(LENGTHS - 1, int(stats[len(BASE)]).bit_length())
    index = np.append(at, length).astype(np.int32)
    value = np.append(np.sqrt(n / max(1, len(words))), 1.0).astype(np.float32)
    dense = np.fromiter(ratios(dict(zip([*BASE, *MORE], stats, strict=True))).values(), dtype=np.float64)
    return index, value, np.log1p(dense)


@dataclass
class FactorisationMachine:
    """w0, w and v, where the last DENSE features are the standardised statistics."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = len(self.w) - len(self.mean)
        tail = np.arange(first, len(self.w), dtype=np.int32)
        index = np.concatenate([np.append(i, tail) for i, _, _ in docs])
        value = np.concatenate([np.append(x, np.clip((d - self.mean) / self.scale, -4, 4)) for _, x, d in docs])
        starts = np.concatenate([[0], np.cumsum([len(i) + len(tail) for i, _, _ in docs])[:-1]])
        return index, value, starts

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic function, and each row's sums over the factors: linear in the entries,
        as the pairwise part is half of (sum v x)^2 - sum (v x)^2."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * (sums**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + pairs, sums

    def score(self, docs: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.rows(docs))[0], -30, 30))) if docs else np.zeros(0)


def train(docs: list, labels: np.ndarray, bits: int = WORD_BITS, factors: int = 8, epochs: int = 8, rate: float = 0.08, decay: float = 1e-5, batch: int = 64, seed: int = 3) -> FactorisationMachine:
    """AdaGrad on the logistic loss. No rows give a model that scores 0.5 for every text."""
    rng = np.random.default_rng(seed)
    n = (1 << bits) + LENGTHS + DENSE
    dense = np.array([d for _, _, d in docs]) if docs else np.zeros((1, DENSE))
    model = FactorisationMachine(0.0, np.zeros(n), rng.normal(0, 0.02, (n, factors)), dense.mean(axis=0), np.maximum(dense.std(axis=0), 1e-3))
    if not docs:
        model.v[:] = 0
        return model
    seen_w, seen_v, seen_0 = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            index, value, starts = model.rows([docs[i] for i in rows])
            margin, sums = model.margin(index, value, starts)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            row = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(index))))
            gx = g[row] * value
            touched, place = np.unique(index, return_inverse=True)
            gw = np.bincount(place, gx, len(touched)) + decay * model.w[touched]
            per = gx[:, None] * (sums[row] - model.v[index] * value[:, None])
            gv = np.stack([np.bincount(place, per[:, f], len(touched)) for f in range(factors)], axis=1) + decay * model.v[touched]
            seen_w[touched] += gw**2
            seen_v[touched] += gv**2
            seen_0 += g.sum() ** 2
            model.w[touched] -= rate * gw / np.sqrt(seen_w[touched])
            model.v[touched] -= rate * gv / np.sqrt(seen_v[touched])
            model.w0 -= rate * g.sum() / np.sqrt(seen_0)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> tuple[list, np.ndarray]:
    """Features and labels of at most `most` labelled documents that aren't held out, sent to the driver.

    Rows without identifier or label are left out; of several labels of a document the lowest counts, and of
    several texts under an identifier the one with the least hash is learned from.
    """
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = [(r["doc_id"], int(r["quality"])) for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    if not few:
        return [], np.zeros(0)
    small = docs.sparkSession.createDataFrame(few, "doc_id long, quality int")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1):
            found = [features(x) for x in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), *(pa.array([f[k].tobytes() for f in found], pa.binary()) for k in range(3))], names=["doc_id", "quality", "i", "x", "d"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(small), "doc_id")
    # one text of each identifier, chosen with map-side combining: at most `most` rows
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("quality").alias("quality"))
    rows = rows.mapInArrow(run, "doc_id long, quality int, i binary, x binary, d binary")
    got = sorted((r["doc_id"], bytes(r["i"]), bytes(r["x"]), bytes(r["d"]), r["quality"]) for r in rows.toLocalIterator())
    return [(np.frombuffer(i, np.int32), np.frombuffer(x, np.float32), np.frombuffer(d)) for _, i, x, d, _ in got], np.array([float(q > 0) for *_, q in got])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: score is the chance of label 1 from the text alone.

    Null texts count as empty; every text has a score. Without usable labels all scores are 0.5. Null identifiers
    hash as the empty text. Repeated rows get equal scores. Other columns are ignored. The model that is sent to
    the executors has a fixed size, whatever the input.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(*training_rows(docs, labels, id_col, text_col, most_labelled)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1, 1 << 20):
            score = model.value.score([features(x) for x in text.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the score of every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
