"""What to do about a transaction that was cut off: its journal held against what is live and what was backed up.

A journal row is one target: tx, path, kind (write or delete), old_hash (null: there must have been no file) and new_hash
(null for a delete). `live` and `backup` are tx, path, hash. All transactions are judged at once, by equality joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_clean, within
from ..functions.text import is_hash

# The states of a transaction, in order.
STATES = ["staged", "verified", "moving", "committed"]


def journal_issues(journal: DataFrame, docs_dir: str | None = None, state_path: str | None = None) -> DataFrame:
    """tx, path, code of rows by which no recovery may act: an unclean path, one outside the documents' folder that is not
    the state, a path twice, a kind that isn't known, a hash that is none, a delete without an old hash."""
    path = F.col("path")
    mine = within(path, docs_dir) | path.eqNullSafe(F.lit(state_path)) if docs_dir else F.lit(True)
    bad_hash = F.when(F.col("kind") == "write", ~F.coalesce(is_hash(F.col("new_hash")), F.lit(False))).otherwise(F.col("new_hash").isNotNull()) | (F.col("old_hash").isNotNull() & ~is_hash(F.col("old_hash")))
    codes = F.array(
        F.when(~F.coalesce(is_clean(path), F.lit(False)), "unclean_path"), F.when(~F.coalesce(mine, F.lit(False)), "foreign_path"), F.when(~F.coalesce(F.col("kind").isin("write", "delete"), F.lit(False)), "unknown_kind"),
        F.when(bad_hash, "bad_hash"), F.when((F.col("kind") == "delete") & F.col("old_hash").isNull(), "unexpected_delete"),
    )
    each = journal.select("tx", "path", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    twice = journal.groupBy("tx", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tx", "path", F.lit("duplicate_path").alias("code"))
    return each.unionByName(twice)


def verdicts(journal: DataFrame, live: DataFrame, backup: DataFrame) -> DataFrame:
    """tx, path, kind, state, done, conflict, backed_up, must_exist of every target, and of backups that no target explains.

    state: original (as before the transaction), installed (as it wants it; a delete that is done too), absent (a write
    whose file is gone or not there yet), foreign. done: as it wants it, also where that is as before. conflict is null, or why nothing may be touched: lost_original (gone,
    and no backup), no_backup (replaced, and no backup), foreign_content (somebody else's), unexpected_delete,
    unplanned_backup, changed_backup."""
    rows = journal.select("tx", "path", "kind", "old_hash", "new_hash", F.lit(True).alias("planned"))
    rows = rows.join(live.select("tx", "path", F.col("hash").alias("live")), ["tx", "path"], "left").join(backup.select("tx", "path", F.col("hash").alias("kept"), F.lit(True).alias("backed_up")), ["tx", "path"], "full_outer")
    must, backed = F.col("old_hash").isNotNull(), F.coalesce("backed_up", F.lit(False))
    planned, gone = F.coalesce("planned", F.lit(False)), F.col("live").isNull()
    write = F.col("kind") == "write"
    original, done = must & F.col("live").eqNullSafe(F.col("old_hash")), F.when(write, F.col("live").eqNullSafe(F.col("new_hash"))).otherwise(gone)
    state = F.when(~planned, "foreign").when(original, "original").when(done, "installed").when(gone, "absent").otherwise("foreign")
    conflict = (
        F.when(~planned | (backed & ~must), "unplanned_backup").when(backed & ~F.col("kept").eqNullSafe(F.col("old_hash")), "changed_backup").when(~write & ~must, "unexpected_delete")
        .when(state == "foreign", "foreign_content").when(must & gone & ~backed, "lost_original").when(must & (state == "installed") & ~backed, "no_backup")
    )
    return rows.select("tx", "path", "kind", state.alias("state"), F.coalesce(done, F.lit(False)).alias("done"), conflict.alias("conflict"), backed.alias("backed_up"), must.alias("must_exist"))


def outcomes(judged: DataFrame, states: DataFrame) -> DataFrame:
    """tx, outcome, conflicts: forward where it was committed (states: tx, state) or all targets are as it wants them,
    conflict where a target has one, back otherwise. A conflict doesn't count where all is installed."""
    each = judged.where("kind is not null").groupBy("tx").agg(F.bool_and("done").alias("whole"))
    bad = judged.groupBy("tx").agg(F.count("conflict").alias("conflicts"))
    rows = states.select("tx", "state").join(each, "tx", "left").join(bad, "tx", "left")
    forward = (F.col("state") == "committed") | F.coalesce("whole", F.lit(False))
    outcome = F.when(forward, "forward").when(F.coalesce("conflicts", F.lit(0)) > 0, "conflict").otherwise("back")
    return rows.select("tx", outcome.alias("outcome"), F.when(outcome == "conflict", F.col("conflicts")).otherwise(0).cast("long").alias("conflicts"))


def repairs(judged: DataFrame, decided: DataFrame) -> DataFrame:
    """tx, path, action of each target: keep, and where its transaction goes back remove (a file that was not there
    before) or restore (from the backup)."""
    rows = judged.where("kind is not null").join(decided.select("tx", "outcome"), "tx")
    back = F.when(F.col("state") == "original", "keep").when(F.col("backed_up"), "restore").when((F.col("kind") == "write") & (F.col("state") == "installed"), "remove").otherwise("keep")
    return rows.select("tx", "path", F.when(F.col("outcome") == "back", back).otherwise("keep").alias("action"))
