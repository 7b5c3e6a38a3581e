"""Planning a run: whether the state still counts, what the configuration changed, which components that selects, and the
scopes that a component's sources are cut into."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash
from . import changes, packing

KEY = ["component_key", "root_component"]
# The versions that a state must agree in, and the groups of settings that are hashed.
VERSION_FIELDS = ["schema_version", "generator_version", "planner_version", "prompt_version", "render_version", "output_schema_version"]
CONFIG_GROUPS = ["paths", "source", "components", "context", "generation"]


def state_compatibility(status: Column, versions: Column, current: dict[str, str]) -> Column:
    """missing, invalid, incompatible where any of the six versions is another, or compatible."""
    same = F.lit(True)
    for name in VERSION_FIELDS:
        same = same & versions[name].eqNullSafe(F.lit(current[name]))
    return F.when(status == "missing", "missing").when(status == "invalid", "invalid").when(~same, "incompatible").otherwise("compatible")


def group_hash(*fields: Column) -> Column:
    """A group of settings as JSON, nulls included, hashed."""
    return content_hash(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def config_hashes(rows: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """All columns with one hash for each group of settings and `aggregate`, the hash of them all."""
    out = rows.withColumns({f"{g}_hash": group_hash(*columns) for g, columns in groups.items()})
    return out.withColumn("aggregate", group_hash(*[F.col(f"{g}_hash").alias(g) for g in groups]))


def config_changes(aggregate: Column, was_aggregate: Column, now: dict[str, Column], was: dict[str, Column]) -> Column:
    """Which groups of settings differ, as an array in order: none where the aggregate is the same, unknown where a group
    has no hash from before."""
    lost = F.lit(False)
    for g in CONFIG_GROUPS:
        lost = lost | (F.coalesce(was[g], F.lit("")) == "")
    each = F.filter(F.array(*[F.when(now[g] != was[g], F.lit(g)) for g in CONFIG_GROUPS]), lambda x: x.isNotNull())
    return F.when(aggregate.eqNullSafe(was_aggregate), F.array().cast("array<string>")).when(lost, F.array(F.lit("unknown"))).otherwise(each)


def change_source(base: str, compatible: bool, old: DataFrame, cur: DataFrame, feed: DataFrame) -> DataFrame:
    """The changes of a run: with no base revision and a state that counts, its files against the current ones; else what
    version control tells."""
    return changes.snapshot_changes(old, cur) if not base and compatible else feed


def selected(old: DataFrame, cur: DataFrame, norm: DataFrame, impact: set[str], full_reason: str | None) -> DataFrame:
    """(component_key, root_component, reasons): the known components that a run has to do with.

    With a reason for a full run: all there are and were. Else what changes and owners pick, and by what the
    configuration changed: owners of files that differ, supporting ones too (source), all current components (context, generation, unknown).
    """
    now, was = cur.where("triggers").select(*KEY).distinct(), old.select(*KEY).distinct()
    known = now.union(was).distinct()
    if full_reason is not None:
        return changes.reasons(known.withColumn("reason", F.lit(full_reason)), known)
    picked = changes.changed_components(norm).unionByName(changes.ownership_changes(old, cur).select(*KEY, F.lit("ownership_changed").alias("reason")))
    if "source" in impact:
        picked = picked.unionByName(changes.policy_differences(old, cur, supporting=True).withColumn("reason", F.lit("source_policy_changed")))
    for group, reason in (("context", "context_configuration_changed"), ("generation", "generation_configuration_changed"), ("unknown", "configuration_changed")):
        if group in impact:
            picked = picked.unionByName(now.withColumn("reason", F.lit(reason)))
    return changes.reasons(picked, known)


def decided(decisions: DataFrame, owners: DataFrame) -> DataFrame:
    """Decisions with their files' owners, empty where a path has none."""
    both = decisions.join(owners.select("path", *KEY), "path", "left")
    return both.withColumns({"component_key": F.coalesce("component_key", F.lit("")), "root_component": F.coalesce("root_component", F.lit(False))})


def planned_strategy(components: DataFrame, plan: DataFrame, default: str) -> DataFrame:
    """Components with the strategy that the plan gave them, or the default."""
    return components.join(plan.select(*KEY, F.col("strategy").alias("planned_")), KEY, "left").withColumn("strategy", F.coalesce("planned_", F.lit(default))).drop("planned_")


# --- the scopes of a component's sources


def source_scopes(files: DataFrame, limit: int) -> DataFrame:
    """(component_key, root_component, part, path, data): each component's sources in parts, in order of `part`, an array
    of numbers: files in path order in batches of `limit` bytes, and a file above it cut at line breaks into chunks. A
    file that can't be cut raises."""
    batches = packing.greedy_batches(files, limit, "alone").select(*KEY, "path", "batch")
    rows = files.select(*KEY, "path", F.col("data").cast("string").alias("data")).join(batches, [*KEY, "path"])
    chunks = packing.newline_chunks(rows.where(F.octet_length("data") > limit).select("path", "data"), limit).select(F.col("id").alias("path"), "chunk", F.col("data").alias("cut"))
    chunks = chunks.withColumn("chunk", F.when(F.col("chunk") < 0, F.raise_error(F.concat(F.lit("no line break within the limit: "), "path")).cast("int")).otherwise(F.col("chunk")))
    both = rows.join(chunks, "path", "left")
    return both.select(*KEY, F.array("batch", F.coalesce("chunk", F.lit(0)) + 1).alias("part"), "path", F.coalesce(F.col("cut"), F.encode("data", "utf-8")).alias("data"))


def _halved(parts: DataFrame) -> DataFrame:
    """Each part (with all its files, sorted) as two: the first and second half of several files, or of one file's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, root, part, files in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if len(files) > 1:
                    two = [files[: len(files) // 2], files[len(files) // 2 :]]
                else:
                    cut = packing.halves(files[0]["data"])
                    if cut is None:
                        raise ValueError(f"{files[0]['path']} exceeds the request limit and can't be split at a line break")
                    two = [[{"path": files[0]["path"], "data": x}] for x in cut]
                out += [(key, root, [*part, i], f["path"], f["data"]) for i, half in enumerate(two) for f in half]
            kinds = [pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[*KEY, "part", "path", "data"])

    grouped = parts.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.struct("path", "data"))).alias("files"))
    return grouped.mapInArrow(run, "component_key string, root_component boolean, part array<int>, path string, data binary")


def refined_scopes(scopes: DataFrame, request_bytes: Callable[[Column, Column], Column], limit: int, keep: Callable[[DataFrame], DataFrame], most_rounds: int = 40, ceiling: Callable[[Column], Column] | None = None, call_limit: int = 0) -> DataFrame:
    """The scopes, those whose request is above the limit halved until all requests fit. `request_bytes` makes a request's
    size of the number of files and their bytes; a part that can't be halved raises. A part holds a batch's bytes at most.
    With a ceiling, the most calls that so many scopes take, a component whose scopes may take more than `call_limit` is
    refused, before anything is halved and after each round: halving only adds scopes."""
    size = request_bytes(F.count(F.lit(1)), F.sum(F.length("data")))
    for _ in range(most_rounds):
        scopes = keep(scopes)
        if ceiling is not None:
            refuse_over(scopes, ceiling, call_limit)
        big = scopes.groupBy(*KEY, "part").agg(size.alias("bytes")).where(F.col("bytes") > limit).select(*KEY, "part")
        if big.isEmpty():
            return scopes
        scopes = scopes.join(big, [*KEY, "part"], "left_anti").unionByName(_halved(scopes.join(big, [*KEY, "part"], "left_semi")))
    raise ValueError("requests still exceed the limit")


def refuse_over(scopes: DataFrame, ceiling: Callable[[Column], Column], call_limit: int) -> None:
    """Raises CallCeilingError where a component's scopes may take more calls than the limit."""
    counts = scopes.select(*KEY, "part").distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).withColumn("calls", ceiling(F.col("n")))
    over = counts.where(F.col("calls") > call_limit).orderBy(*KEY).limit(1).collect()
    if over:
        raise CallCeilingError(f"component {over[0]['component_key']} may take {over[0]['calls']} calls, more than the limit of {call_limit}")


class CallCeilingError(ValueError):
    """A component may take more calls than its limit; nothing was called."""

    exit_code = 5


def numbered_scopes(scopes: DataFrame) -> DataFrame:
    """(component_key, root_component, batch, batch_count, chunk, chunk_count, split_path, path, data): scopes by their
    final numbers, batches and chunks from 1. Halves of several files are batches; chunks are the parts of one file."""
    from pyspark.sql import Window

    parts = scopes.groupBy(*KEY, "part").agg(F.min("path").alias("first"), F.count_distinct("path").alias("files"))
    chunked = parts.withColumn("alone", F.col("files") == 1)
    # chunks of one file are one batch: neighbours that have the same single path
    order = Window.partitionBy(*KEY).orderBy("part")
    new = ~(F.col("alone") & F.coalesce(F.lag("alone").over(order), F.lit(False)) & F.col("first").eqNullSafe(F.lag("first").over(order)))
    rows = chunked.withColumn("new", new.cast("int")).withColumn("batch", F.sum("new").over(order).cast("int"))
    inside = Window.partitionBy(*KEY, "batch")
    rows = rows.withColumns({"chunk": F.row_number().over(inside.orderBy("part")), "chunk_count": F.count(F.lit(1)).over(inside).cast("int")})
    counts = rows.groupBy(*KEY).agg(F.max("batch").alias("batch_count"))
    rows = rows.join(counts, KEY).select(*KEY, "part", "batch", "batch_count", "chunk", "chunk_count", F.format_string("b%d/c%d", "batch", "chunk").alias("split_path"))
    return scopes.join(rows, [*KEY, "part"]).drop("part")
