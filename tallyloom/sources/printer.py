"""What a run prints and reports: one line for each thing, or all of it as one JSON object."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairs(**columns: Column) -> Column:
    """name=value of each column, by blanks, in the order given; nulls are empty and booleans lower case."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{n}="), F.coalesce(c.cast("string"), F.lit(""))) for n, c in columns.items()])


def plan_lines(counts: DataFrame, components: DataFrame, affected: DataFrame, changes: DataFrame) -> DataFrame:
    """n, key, line of a plan: the counts, then each component, each affected one and each change, in order of their keys.
    counts: one row; components: component_key, root_component, triggering, supporting; affected: component_key,
    root_component, action, reasons (array); changes: status, old_path, new_path."""
    own = lambda df: {"component": df["component_key"], "root": df["root_component"]}
    row = lambda df, n, key, line: df.select(F.lit(n).alias("n"), key.cast("string").alias("key"), line.alias("line"))
    out = row(counts, 0, F.lit(""), pairs(**{c: F.col(c) for c in counts.columns}))
    out = out.unionByName(row(components, 1, F.col("component_key"), pairs(**own(components), triggering=F.col("triggering"), supporting=F.col("supporting"))))
    out = out.unionByName(row(affected, 2, F.col("component_key"), pairs(**own(affected), action=F.col("action"), reasons=F.array_join("reasons", ","))))
    path = F.coalesce(F.nullif(F.col("new_path"), F.lit("")), F.col("old_path"))
    return out.unionByName(row(changes, 3, path, pairs(change=F.col("status"), old_path=F.col("old_path"), new_path=F.col("new_path"))))


def as_json(rows: DataFrame) -> DataFrame:
    """line: each row as one JSON object, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def normalised_diff(diff: DataFrame, key: list[str]) -> DataFrame:
    """key, added, changed, deleted: sorted distinct paths by status, empty where there are none. `diff`: path, status."""
    of = lambda status: F.coalesce(F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("path")))), F.array().cast("array<string>")).alias(status)
    return diff.groupBy(*key).agg(*[of(s) for s in ("added", "changed", "deleted")])


def failure_report(failures: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The failures with their validation codes sorted and distinct, and the affected components with `fell_back`:
    whether a fall-back is noted for them (failures: component_key, category, codes, fell_back)."""
    rows = failures.withColumn("codes", F.array_sort(F.array_distinct(F.coalesce("codes", F.array().cast("array<string>")))))
    marked = failures.where("fell_back").select("component_key", F.lit(True).alias("fell_back")).distinct()
    return rows, affected.join(marked, "component_key", "left").withColumn("fell_back", F.coalesce("fell_back", F.lit(False)))


def write_report(path: str, report: dict) -> None:
    """One JSON file on the driver, written beside its place and renamed, so that nobody reads half of it."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as out:
            json.dump(report, out, ensure_ascii=False, sort_keys=True, indent=2)
            out.write("\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(part, path)
    except BaseException:
        os.unlink(part)
        raise
