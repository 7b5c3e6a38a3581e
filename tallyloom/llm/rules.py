"""Quality rules: fixed base rules, and a decision list learned by sequential covering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, read, slices, stored
from .text_stats import BASE, MORE, document_stats, ratios

#: Labelled rows that the learner sees at most, the first by a hash of the identifier; no other step has a bound.
MOST_LABELLED = 20_000
#: Share of the rows that a rule is grown on; the rest prunes it.
GROW = 2 / 3


def document_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of text_stats over whole texts; null texts count as empty."""
    names = [*BASE, *MORE]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, 1):
            cols = zip(*map(document_stats, text.to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict):
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    hits: int
    precision: float

    def holds(self, x: dict):
        out = self.conditions[0].holds(x)
        for c in self.conditions[1:]:
            out = out & c.holds(x)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _covered(conditions: list[Condition], x: dict, n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for c in conditions:
        out &= c.holds(x)
    return out


def _grow(x: dict, bad: np.ndarray, most: int | None = None) -> list[Condition]:
    """Adds the threshold with the best information gain until no good row is covered or nothing gains, or until there are
    `most` conditions. Every border between two values of every statistic is tried; of equal gains the first counts."""
    conditions: list[Condition] = []
    live = np.ones(len(bad), dtype=bool)
    while (most is None or len(conditions) < most) and (live & ~bad).any():
        p0 = (live & bad).sum()
        now, best, gain = np.log2(p0 / live.sum()), None, 1e-9
        for name, values in x.items():
            v, b = values[live], bad[live]
            order = np.argsort(v, kind="stable")
            v, b = v[order], np.cumsum(b[order])
            at = np.flatnonzero(v[1:] != v[:-1]) + 1  # rows at or below each border
            for above, p, n in ((False, b[at - 1], at), (True, b[-1] - b[at - 1], len(v) - at)):
                g = p * (np.log2(np.maximum(p, 1) / n) - now)
                if len(g) and g.max() > gain:
                    i = int(g.argmax())
                    # halfway to the next value, so that the border itself isn't fitted
                    best, gain = Condition(name, above, float((v[at[i] - 1] + v[at[i]]) / 2)), g[i]
        if best is None:
            break
        conditions.append(best)
        live &= best.holds(x)
    return conditions


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int | None = None, most_conditions: int | None = None, precision: float = 0.99, least_hits: int = 5, seed: int = 5) -> list[Rule]:
    """An ordered list of rules for the rows where `bad` holds.

    Each rule is grown on two thirds of the rows that no rule covers yet and pruned on the rest: its last
    conditions go while (hits - misses) / all on those rows doesn't fall. A pruned rule that isn't `precision` right
    on all rows left is tried unpruned; if that isn't either, the list ends. No rows, or rows of one class, give an empty list.
    """
    rng, rules, n = np.random.default_rng(seed), [], len(bad)
    left = np.ones(n, dtype=bool)
    grow = rng.random(n) < GROW
    while (most_rules is None or len(rules) < most_rules) and (left & bad & grow).sum() >= least_hits:
        at = left & grow
        conditions = _grow({k: v[at] for k, v in x.items()}, bad[at], most_conditions)
        if not conditions:
            break
        held = left & ~grow
        xs, b = {k: v[held] for k, v in x.items()}, bad[held]

        def worth(cs, xs=xs, b=b):
            c = _covered(cs, xs, len(b))
            return (2 * (c & b).sum() - c.sum()) / max(c.sum(), 1)

        pruned = conditions
        while len(pruned) > 1 and worth(pruned[:-1]) >= worth(pruned):
            pruned = pruned[:-1]
        for rule in (pruned, conditions):
            c = _covered(rule, x, n) & left
            right = (c & bad).sum()
            if right >= least_hits and right >= precision * c.sum():
                break
        else:
            break
        rules.append(Rule(tuple(rule), int(right), float(right / c.sum())))
        left &= ~c
    return rules


def verdict(rules: list[Rule], columns: dict[str, Column]) -> Column:
    """The first rule that holds, as text, or null: one conditional expression."""
    if not rules:
        return F.lit(None).cast("string")
    out = F.when(rules[0].holds(columns), F.lit(str(rules[0])))
    for r in rules[1:]:
        out = out.when(r.holds(columns), F.lit(str(r)))
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def labelled_sample(stats: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Ratios and the low-quality mark of at most `most` labelled rows that aren't held out. Rows without identifier
    or label are left out; of several labels of a document the lowest counts, and of several documents under one
    identifier the one with the least statistics, in their order."""
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a bounded sample, sent to the driver
    ids = few.collect()
    if not ids:
        return {}, np.zeros(0, dtype=bool)
    spark = stats.sparkSession
    small = spark.createDataFrame([(r["doc_id"], int(r["quality"])) for r in ids], "doc_id long, quality int")
    one = stats.join(F.broadcast(small.select("doc_id")), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*BASE, *MORE)).alias("s")).select("doc_id", "s.*")
    rows = one.join(F.broadcast(small), "doc_id").orderBy("doc_id").select("quality", *BASE, *MORE).collect()
    s = {c: np.array([r[c] for r in rows], dtype=float) for c in [*BASE, *MORE]}
    return ratios(s), np.array([r["quality"] == 0 for r in rows], dtype=bool)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base_failed, rule and kept of every row of `docs`, and the rules that were learned.

    A null or blank text has no words and fails the base rules. Repeated rows are judged alike. Null identifiers
    are judged, but never learned from. Without labels only the base rules decide. Other columns are ignored.
    """
    stats = stored(document_columns(docs, id_col, text_col))
    x, bad = labelled_sample(stats, labels.select("doc_id", "quality"), most_labelled)
    rules = learn(x, bad) if len(bad) else []
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stats.withColumn("base_failed", failed).withColumn("rule", verdict(rules, ratios({c: F.col(c) for c in [*BASE, *MORE]})))
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules


def kept_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = MOST_LABELLED) -> DataFrame:
    """The rows of `docs`, with all columns, that judge() keeps, judged row by row without a join."""
    marks = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    few = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).collect()], "doc_id long")
    seen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(few), "doc_id", "left_semi")
    x, bad = labelled_sample(stored(document_columns(seen)), labels.select("doc_id", "quality"), most_labelled)
    rules = learn(x, bad) if len(bad) else []
    prefix = free_prefix(docs, "stat_")
    names, at = [*BASE, *MORE], docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, text in slices(batches, at):
            cols = zip(*map(document_stats, text.to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in cols)], names=[*batch.schema.names, *(prefix + n for n in names)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, T.LongType()) for n in names)])
    s = {n: F.col(prefix + n) for n in names}
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    return docs.mapInArrow(run, schema).where(~failed & verdict(rules, ratios(s)).isNull()).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the base statistics and the verdict on every document."""
    rows, _ = judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return rows.select("doc_id", *BASE, "base_failed", "kept", "rule")
