"""Packing files into byte budgets, and cutting texts at line breaks.

Packing depends on what was skipped before, so it is no window; a task walks over a component's (path, size) rows in
path order and holds numbers only. Neither contents nor files are gathered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import MOST

KEYS = ["component_key", "root_component"]
OVERLAP = 1024
#: Bytes of text whose parts a task gathers before it hands them on.
HELD_BYTES = 4 << 20


def _walk(files: DataFrame, keys: list[str], make, column: str, kind: T.DataType) -> DataFrame:
    """keys, path, size and a column that `make()` finds for each file in turn, in path order within the keys.

    What a file gets depends on all before it, so a component is walked by one task, which streams its sorted (path, size)
    rows and holds a few numbers; components are dealt out by their keys."""
    rows = files.select(*keys, "path", F.col("size").cast("long").alias("size"))
    schema, n = T.StructType([*rows.schema.fields, T.StructField(column, kind)]), len(keys)
    arrow = pa.bool_() if isinstance(kind, T.BooleanType) else pa.int32()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step = None, None
        for batch in batches:
            out, sizes = [], batch.column(n + 1).to_pylist()
            for key, size in zip(zip(*(batch.column(k).to_pylist() for k in range(n)), strict=True), sizes, strict=True):
                if step is None or key != at:
                    at, step = key, make()
                out.append(step(size))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, column])

    # dealt by a hash of the keys: a join by the keys themselves would count as dealt already, and such a join's tasks are cut
    # or read by mapper where the plan is adapted, so that several tasks would each begin a component anew
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, "path").mapInArrow(run, schema)


def fitted(files: DataFrame, limit: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, path, size, selected: in path order each file that still fits is taken and others are passed over."""

    def make():
        used = 0

        def step(size: int | None) -> bool:
            nonlocal used
            fits = size is not None and size >= 0 and used + size <= limit
            used += size if fits else 0
            return fits

        return step

    return _walk(files, keys, make, "selected", T.BooleanType())


def first_fit(files: DataFrame, limit: int, keys: list[str] = KEYS) -> DataFrame:
    """keys, selected, bytes, omitted: what fitted() takes and leaves, counted."""
    taken = fitted(files, limit, keys).groupBy(*keys)
    return taken.agg(F.count_if("selected").alias("selected"), F.coalesce(F.sum(F.when(F.col("selected"), F.col("size"))), F.lit(0)).alias("bytes"), F.count_if(~F.col("selected")).alias("omitted"))


def greedy_batches(files: DataFrame, limit: int, oversize: str = "error", keys: list[str] = KEYS) -> DataFrame:
    """keys, path, size, batch (from 1): a batch ends before the file that would overflow it.

    A file above the limit raises where `oversize` is "error"; where it is "alone" it ends the open batch and is one
    of its own, for its text to be cut into chunks.
    """
    if oversize == "error":
        files = files.withColumn("size", F.when(F.col("size") > limit, F.raise_error(F.concat(F.lit("file above the batch limit: "), "path")).cast("long")).otherwise(F.col("size")))

    def make():
        used, batch = 0, 0

        def step(size: int | None) -> int:
            nonlocal used, batch
            size = size or 0
            if batch == 0 or size > limit or used + size > limit:
                used, batch = 0, batch + 1
            used += limit + 1 if size > limit else size
            return batch

        return step

    return _walk(files, keys, make, "batch", T.IntegerType())


def batch_bytes(batches: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, batch, batch_count, files, bytes, with the lineage name of each batch."""
    per = batches.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    count = batches.groupBy(*keys).agg(F.max("batch").alias("batch_count"))
    return per.join(count, keys).withColumn("split_path", F.concat(F.lit("b"), F.col("batch").cast("string")))


def cut_at_newlines(data: bytes, limit: int) -> list[bytes] | None:
    """Chunks of at most `limit` bytes, each but the last ending after the last line break that it has room for; none
    if a chunk would have no line break."""
    if limit <= 0:
        raise ValueError("the limit must be positive")
    chunks, at = [], 0
    while len(data) - at > limit:
        end = data.rfind(b"\n", at, at + limit) + 1
        if end <= at:
            return None
        chunks.append(data[at:end])
        at = end
    return [*chunks, data[at:]] if at < len(data) or not chunks else chunks


def halves(data: bytes) -> tuple[bytes, bytes] | None:
    """Two parts, cut after the last line break before the middle, or else after the first one behind it."""
    middle = len(data) // 2
    at = data.rfind(b"\n", 0, middle) + 1 or data.find(b"\n", middle) + 1
    return (data[:at], data[at:]) if 0 < at < len(data) else None


def halves_with_overlap(data: bytes, most: int = OVERLAP) -> tuple[bytes, bytes] | None:
    """As halves, the second part starting with the first one's last line if that is short, else with its line break."""
    two = halves(data)
    if two is None:
        return None
    at = len(two[0])
    line = data.rfind(b"\n", 0, at - 1) + 1
    start = line if line > 0 and at - line <= most else at - 1
    return (two[0], data[start:]) if 0 < start < at else None


def _per_row(rows: DataFrame, id_col: str, data_col: str, make) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for key, data in ((x.as_py() for x in row) for row in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True)):
                parts = make(data or b"")
                out += [(key, -1, 0, None)] if parts is None else [(key, i, len(parts), p) for i, p in enumerate(parts)]
                held += len(data or b"")
                if held >= HELD_BYTES:
                    yield made(out, batch.schema.field(0).type)
                    out, held = [], 0
            yield made(out, batch.schema.field(0).type)

    def made(out: list, key: pa.DataType) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (key, pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["id", "chunk", "chunk_count", "data"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col), F.col(data_col).cast("string")).mapInArrow(run, f"id {kind}, chunk int, chunk_count int, data binary")


def newline_chunks(rows: DataFrame, limit: int, id_col: str = "path", data_col: str = "data") -> DataFrame:
    """id, chunk (from 0), chunk_count, data; one row with chunk -1 for a text that can't be cut within the limit."""
    return _per_row(rows, id_col, data_col, lambda d: cut_at_newlines(d, limit))


def bisected(rows: DataFrame, overlap: bool = False, id_col: str = "path", data_col: str = "data") -> DataFrame:
    """As newline_chunks, for two halves."""
    return _per_row(rows, id_col, data_col, halves_with_overlap if overlap else halves)


# What each scope is asked for, in order, and what is reduced from all scopes' answers.
MAPPED = ["overview_candidate", "architecture", "interfaces", "data_models", "workflows", "dependencies", "review_gaps"]
REDUCED = ["overview", "diagrams"]
KINDS = [*MAPPED, *REDUCED]


def call_bounds(scopes: Column, limit: int) -> tuple[Column, Column, Column]:
    """The calls that a component of so many scopes takes at first, at most (each may be repaired once), and whether
    that is above the limit."""
    first = scopes.cast("long") * len(MAPPED) + len(REDUCED)
    return first, first * 2, first * 2 > limit


def call_estimates(batches: DataFrame, modes: int = 2, retries: int = 2, keys: list[str] = KEYS) -> DataFrame:
    """keys, kind, ordinal, calls, bytes, tokens_most, tokens_usual, attempts: each kind is asked for once a batch, or
    once where it is reduced from the others."""
    per = batches.groupBy(*keys).agg(F.max("batch").cast("long").alias("n"), F.sum("size").alias("bytes"))
    kinds = F.posexplode(F.array(*map(F.lit, KINDS)))
    rows = per.select(*keys, "n", "bytes", kinds.alias("ordinal", "kind"))
    reduced = F.col("kind").isin(REDUCED)
    rows = rows.select(*keys, "kind", "ordinal", F.when(reduced, F.lit(1).cast("long")).otherwise(F.col("n")).alias("calls"), F.when(reduced, F.lit(0).cast("long")).otherwise(F.col("bytes")).alias("bytes"))
    return rows.select("*", F.col("bytes").alias("tokens_most"), F.expr("(bytes + 3) div 4").alias("tokens_usual"), (F.col("calls") * modes * (retries + 1)).alias("attempts"))


def total(column: str | Column) -> Column:
    """A sum of longs that stops at the greatest long."""
    wide = F.sum(F.col(column).cast("decimal(38,0)") if isinstance(column, str) else column.cast("decimal(38,0)"))
    return F.when(wide > MOST, F.lit(MOST)).otherwise(wide.cast("decimal(19,0)")).cast("long")


def estimate_rollup(estimates: DataFrame) -> DataFrame:
    """Calls, bytes and the largest bytes by component and kind, by component, and over all; sums stop at the greatest long."""
    return estimates.rollup("component_key", "kind").agg(total("calls").alias("calls"), total("bytes").alias("bytes"), F.max("bytes").alias("largest"), F.grouping_id().cast("int").alias("level"))
