"""Sizing and choosing requests before any is made, and splitting those that came back cut off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import add_saturating, multiply_saturating
from .packing import halves_with_overlap

HEADROOM = 1024
# Request kinds and the most items that a list of each kind may have.
ITEM_LIMITS = {"architecture": 2, "interfaces": 2, "data_models": 1, "workflows": 1, "dependencies": 2, "review_gaps": 2, "diagrams": 1}


def request_bytes(*parts: Column) -> Column:
    """Bytes of the request as JSON, with room for what the transport adds."""
    return F.octet_length(F.to_json(F.struct(*parts))).cast("long") + HEADROOM


def synthesis_bytes(envelope: Column, batches: Column, response_bytes: int) -> Column:
    """The most that a synthesis over so many batches may take: escaping triples a response at worst."""
    return add_saturating(envelope, multiply_saturating(F.lit(3 * response_bytes).cast("long"), batches))


def fits_once(source_bytes: Column, request: Column, context: int, request_limit: int) -> Column:
    """Whether one request can hold a component: its sources are within the context, the request within its limit."""
    return (source_bytes <= context) & (request <= request_limit)


def strategy(wanted: Column, once: Column) -> Column:
    """How a component is described: as asked, where `auto` is a dossier if one request fits and fragments if not."""
    return F.when(wanted == "auto", F.when(once, "dossier").otherwise("fragments")).otherwise(wanted)


def request_mode(chosen: Column, once: Column, largest_file: Column, batches: Column, batch: int) -> Column:
    """What a chosen strategy asks for: fragments, one normal request, batches with a synthesis, or an error where a
    dossier has a file above a batch or no second batch to split into."""
    return F.when(chosen == "fragments", "fragments").when(once, "normal").when((largest_file > batch) | (batches < 2), "error").otherwise("batches")


def config_impact(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, impact: which groups of settings (columns) differ, "unknown" where there are no old ones."""
    names = [c for c in new.columns if c != key]
    both = new.join(old.select(key, F.lit(True).alias("known_"), *[F.col(c).alias(f"was_{c}") for c in names]), key, "left")
    changed = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"was_{c}")), F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return both.select(key, F.when(F.col("known_").isNull(), F.array(F.lit("unknown"))).otherwise(changed).alias("impact"))


def change_kind(full: Column, changes: Column) -> Column:
    return F.when(full | (changes == 0), "full").otherwise("incremental")


# What a failed completion may be, as it is reported.
COMPLETION_FAILURES = ["truncated", "incomplete", "empty", "invalid_envelope", "invalid_utf8", "response_too_large"]


def failure_category(error: Column, completion: Column) -> Column:
    """A typed error's category, the first that fits: a completion's own, else transport, schema_validation, call_limit,
    output_validation, cancelled, and generation for all others."""
    out = F.when((error == "completion") & completion.isin(COMPLETION_FAILURES), completion).when(error == "transport", "transport").when(error == "dossier_validation", "schema_validation")
    return out.when(error == "call_limit", "call_limit").when(error == "output_validation", "output_validation").when(error.isin("canceled", "deadline_exceeded"), "cancelled").otherwise("generation")


def split_scopes(scopes: DataFrame, retry: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], levels: int = 3) -> DataFrame:
    """Coverage (split_path, state) after scopes that came back cut off were halved, `levels` times at most.

    scopes: split_path, data. `retry` gives each scope its state: complete, saturated or truncated. A scope with no
    line break inside, or at the last level, keeps a saturated answer and is pending after a truncated one.
    """
    open_ = keep(scopes.select("split_path", "data"))
    done = None
    for level in range(levels + 1):
        asked = keep(retry(open_).select("split_path", "data", "state"))
        settled = asked.where("state = 'complete'").select("split_path", "state")
        bad = asked.where("state <> 'complete'")
        last = level == levels

        def run(batches):
            for part in batches:
                out = []
                for path, data, state in zip(part["split_path"], part["data"], part["state"], strict=True):
                    two = None if last else halves_with_overlap(data.encode())  # noqa: B023
                    if two is None:
                        out.append((path, "saturated" if state == "saturated" else "pending", None, None))
                    else:
                        out += [(path, "replaced", f"{path}/{i}", x.decode("utf-8", "replace")) for i, x in enumerate(two)]
                yield type(part)(out, columns=["parent", "state", "split_path", "data"])

        split = keep(bad.mapInPandas(run, "parent string, state string, split_path string, data string"))
        settled = settled.unionByName(split.select(F.col("parent").alias("split_path"), "state").distinct())
        done = settled if done is None else done.unionByName(settled)
        open_ = split.where("split_path is not null").select("split_path", "data")
        if open_.isEmpty():
            break
    return done


#: The order of scopes within one component.
SCOPE_ORDER = ["batch", "batch_count", "chunk", "chunk_count", "split_path", "kind"]


def scope_order(scopes: DataFrame) -> DataFrame:
    """Scopes with their place (from 1) in the fixed order: component identity, batch, number of batches, chunk, number of
    chunks, split path, kind. Each component is numbered alone; what comes before it is a sum over a row a component."""
    inside = Window.partitionBy("identity").orderBy(*SCOPE_ORDER)
    counts = scopes.groupBy("identity").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("identity", F.coalesce(F.sum("n").over(Window.orderBy("identity").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    return scopes.withColumn("place", F.row_number().over(inside)).join(before, "identity").withColumn("place", F.col("place") + F.col("before_")).drop("before_")
