"""What changed between two snapshots, and which components that affects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The attributes of a file that make it another one.
ATTRIBUTES = ["source_hash", "role", "triggers", "component_key", "root_component"]


def _differs(a: str, b: str, columns: list[str] = ATTRIBUTES) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | ~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def snapshot_changes(old: DataFrame, cur: DataFrame) -> DataFrame:
    """(status, old_path, new_path): one pass over both sides joined by path. A modified file has its path as new_path
    alone."""
    o, c = old.alias("o"), cur.alias("c")
    both = o.join(c, F.col("o.path") == F.col("c.path"), "full_outer")
    status = F.when(F.col("o.path").isNull(), "added").when(F.col("c.path").isNull(), "deleted").when(_differs("o", "c"), "modified")
    rows = both.select(status.alias("status"), F.col("o.path").alias("op"), F.col("c.path").alias("np")).where("status is not null")
    return rows.select("status", F.when(F.col("status") == "deleted", F.col("op")).alias("old_path"), F.when(F.col("status") != "deleted", F.col("np")).alias("new_path"))


def renames(old: DataFrame, cur: DataFrame) -> DataFrame:
    """(old_path, new_path, similarity): deleted and added files of equal content, paired in path order within equal
    hashes. Pairs of merely similar content aren't sought."""
    gone = old.join(cur, "path", "left_anti").select("source_hash", F.col("path").alias("old_path"))
    new = cur.join(old, "path", "left_anti").select("source_hash", F.col("path").alias("new_path"))
    nth = lambda df, c: df.withColumn("n", F.expr(f"row_number() over (partition by source_hash order by {c})"))
    return nth(gone, "old_path").join(nth(new, "new_path"), ["source_hash", "n"]).select("old_path", "new_path", F.lit(100).alias("similarity"))


def with_renames(changes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes in which each pair of added and deleted files is one renamed file."""
    drop = lambda df, status, c: df.where(F.col("status") != status).unionByName(df.where(F.col("status") == status).join(pairs.select(c), c, "left_anti").select("status", "old_path", "new_path"))
    rest = drop(drop(changes, "added", "new_path"), "deleted", "old_path")
    return rest.unionByName(pairs.select(F.lit("renamed").alias("status"), "old_path", "new_path"))


def normalized(changes: DataFrame, old: DataFrame, cur: DataFrame) -> DataFrame:
    """Changes with the role, owner and trigger of their old and new side, missing ones empty or false."""
    side = lambda df, s: df.select(F.col("path").alias(f"{s}_path"), F.col("role").alias(f"{s}_role"), F.col("component_key").alias(f"{s}_key"), F.col("root_component").alias(f"{s}_root"), F.col("triggers").alias(f"{s}_triggers"))
    out = changes.join(side(old, "old"), "old_path", "left").join(side(cur, "new"), "new_path", "left")
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("old_path", "new_path", "old_role", "new_role", "old_key", "new_key")]
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("old_root", "new_root", "old_triggers", "new_triggers")]
    return out.select("status", *text, *flags)


def changed_components(norm: DataFrame) -> DataFrame:
    """(component_key, root_component, reason) for each side of a change that triggers."""
    sides = norm.select("status", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_key").alias("component_key"), F.col(f"{s}_root").alias("root_component"), F.col(f"{s}_triggers").alias("on")) for s in ("old", "new")])).alias("x"))
    wrong = ((F.col("status") == "added") & (F.col("x.side") == "old")) | ((F.col("status") == "deleted") & (F.col("x.side") == "new"))
    return sides.where(F.col("x.on") & ~wrong).select("x.component_key", "x.root_component", F.concat(F.lit("source_"), "status").alias("reason"))


def ownership_changes(old: DataFrame, cur: DataFrame) -> DataFrame:
    """(component_key, root_component, path): both owners of a path whose owner changed."""
    both = old.alias("o").join(cur.alias("c"), F.col("o.path") == F.col("c.path")).where(_differs("o", "c", ["component_key", "root_component"]))
    return both.select(F.col("o.path").alias("path"), F.explode(F.array(*[F.struct(F.col(f"{s}.component_key").alias("component_key"), F.col(f"{s}.root_component").alias("root_component")) for s in "oc"])).alias("x")).select("x.*", "path")


def policy_differences(old: DataFrame, cur: DataFrame, supporting: bool = False) -> DataFrame:
    """(component_key, root_component): owners of files that differ, are gone or are new; triggering files only,
    unless `supporting`."""
    both = old.alias("o").join(cur.alias("c"), F.col("o.path") == F.col("c.path"), "full_outer")
    both = both.where(F.col("o.path").isNull() | F.col("c.path").isNull() | _differs("o", "c"))
    side = lambda s: F.struct(F.col(f"{s}.component_key").alias("component_key"), F.col(f"{s}.root_component").alias("root_component"), (F.col(f"{s}.path").isNotNull() & (F.col(f"{s}.triggers") | F.lit(supporting))).alias("on"))
    return both.select(F.explode(F.array(side("o"), side("c"))).alias("x")).where("x.on").select("x.component_key", "x.root_component").distinct()


def reasons(selections: DataFrame, known: DataFrame) -> DataFrame:
    """(component_key, root_component, reasons) of known components, each reason once, in order."""
    return selections.join(known, ["component_key", "root_component"], "left_semi").groupBy("component_key", "root_component").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def affected(old: DataFrame, cur: DataFrame) -> DataFrame:
    """Reasons per component from changes, owners and policy together."""
    norm = normalized(snapshot_changes(old, cur), old, cur)
    picked = changed_components(norm)
    picked = picked.unionByName(ownership_changes(old, cur).select("component_key", "root_component", F.lit("ownership_changed").alias("reason")))
    picked = picked.unionByName(policy_differences(old, cur).withColumn("reason", F.lit("source_policy_changed")))
    known = old.select("component_key", "root_component").union(cur.where("triggers").select("component_key", "root_component")).distinct()
    return reasons(picked, known)


def actions(picked: DataFrame, cur_hash: DataFrame, old_hash: DataFrame, full: bool = False) -> DataFrame:
    """(component_key, root_component, action) of the picked components, or of all where `full`.

    Gone now: delete; not there before: create; equal input hash and not `full`: skip_unchanged; else regenerate.
    """
    key = ["component_key", "root_component"]
    both = cur_hash.select(*key, F.col("input_hash").alias("now")).join(old_hash.select(*key, F.col("input_hash").alias("was")), key, "full_outer")
    if not full:
        both = both.join(picked.select(*key).distinct(), key, "left_semi")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull(), "create").when((F.col("now") == F.col("was")) & F.lit(not full), "skip_unchanged").otherwise("regenerate")
    return both.select(*key, action.alias("action"))


def component_changes(norm: DataFrame) -> DataFrame:
    """(component_key, root_component, status, path): each change under every component that one of its sides has.
    Two equality selections, not one with an OR."""
    side = lambda s: norm.where(F.col(f"{s}_key") != "").select(F.col(f"{s}_key").alias("component_key"), F.col(f"{s}_root").alias("root_component"), "status", F.when(F.col("new_path") != "", F.col("new_path")).otherwise(F.col("old_path")).alias("path"))
    return side("old").union(side("new")).distinct()


def full_run_reason(explicit: Column, base_found: Column, state: Column, compatible: Column, same_paths: Column) -> Column:
    """The first reason for which everything is done anew, or null."""
    return F.when(explicit, "explicit_full").when(~base_found, "base_revision_unavailable").when(state == "missing", "state_missing").when(state == "invalid", "state_invalid").when(~compatible, "state_incompatible").when(~same_paths, "output_paths_changed")
