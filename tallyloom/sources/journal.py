"""A folder of files that is changed as one transaction, with a journal from which a run that was cut off is completed
or undone.

What is written, what it replaces and the journal are tables below `.transaction`, written by Spark; the files are read,
replaced and removed by tasks, each file under a name of its own first and then renamed. Every step can be repeated:
a task that runs twice finds its file as it wants it. Markers name the state: staged, verified, moving, committed.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery
from ..operators.output import broken_preconditions
from .sinks import PreconditionError

HOME = ".transaction"
LEDGER, STATE = ".ledger", ".state.json"
#: The hash of what is there but isn't a file.
NO_FILE = "sha256:-"
#: Bytes of content that a task gathers before it hands them on.
HELD_BYTES = 4 << 20


class RecoveryConflictError(RuntimeError):
    """Files are neither as before a transaction nor as it wanted them; everything was left as it is."""

    exit_code = 6

    def __init__(self, conflicts: list[tuple[str, str]]):
        super().__init__("; ".join(f"{path}: {why}" for path, why in conflicts[:5]))
        self.conflicts = conflicts


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _content(fs, at: str) -> bytes | None:
    """A file's bytes, or None where there is nothing; a folder raises IsADirectoryError."""
    from pyarrow.fs import FileType

    try:
        with fs.open_input_stream(at) as f:
            return f.read()
    except FileNotFoundError:
        return None
    except OSError as e:
        kind = fs.get_file_info(at).type
        if kind == FileType.NotFound:
            return None
        if kind != FileType.File:
            raise IsADirectoryError(at) from e
        raise


def content_id(data: bytes) -> str:
    return f"sha256:{hashlib.sha256(data).hexdigest()}"


def _put(fs, base: str, path: str, data: bytes) -> None:
    at = f"{base}/{path}"
    folder, name = at.rsplit("/", 1)
    aside = f"{folder}/.{name}.new"
    try:
        out = fs.open_output_stream(aside)
    except FileNotFoundError:  # most files come to a folder that is there
        fs.create_dir(folder, recursive=True)
        out = fs.open_output_stream(aside)
    with out as f:
        f.write(data)
    try:
        fs.move(aside, at)
    except OSError:  # a store whose rename does not replace
        fs.delete_file(at)
        fs.move(aside, at)


def _remove(fs, base: str, path: str) -> None:
    from pyarrow.fs import FileType

    at = f"{base}/{path}"
    if fs.get_file_info(at).type == FileType.File:
        fs.delete_file(at)


class FileTree:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.home = f"{self.root}/{HOME}"
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self.jvm.org.apache.hadoop.fs.Path(at)

    def _marked(self, state: str) -> bool:
        return self.fs.exists(self._path(f"{self.home}/{state}"))

    def _mark(self, state: str) -> None:
        self.fs.create(self._path(f"{self.home}/{state}"), True).close()

    def _discard(self) -> None:
        """The journal goes last: until then a run that is cut off finds the transaction as it was."""
        for name in ("staged.parquet", "backup.parquet", "expected.parquet"):
            self.fs.delete(self._path(f"{self.home}/{name}"), True)
        self.fs.delete(self._path(self.home), True)

    def state(self) -> str | None:
        """The state of the transaction that is open, or None."""
        return next((s for s in reversed(recovery.STATES) if self._marked(s)), None)

    # --- files, by tasks

    def contents(self, paths: DataFrame) -> DataFrame:
        """path, content, hash of the files that are there, of the given paths. What is no file has the hash `NO_FILE`."""
        return self._read(paths, True)

    def _read(self, paths: DataFrame, whole: bool) -> DataFrame:
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _open(root)
            for batch in batches:
                out, held = [], 0
                for path in batch.column(0).to_pylist():
                    try:
                        data = _content(fs, f"{base}/{path}")
                        found = None if data is None else content_id(data)
                    except IsADirectoryError:
                        data, found = None, NO_FILE
                    if found is not None:
                        out.append((path, data if whole else None, found))
                        held += len(data or b"") if whole else 0
                    if held >= HELD_BYTES:
                        yield rows(out)
                        out, held = [], 0
                yield rows(out)

        def rows(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.string()))], names=["path", "content", "hash"])

        return self._dealt(paths.select("path").distinct()).mapInArrow(run, "path string, content binary, hash string")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows in as many tasks as a shuffle has: a file takes its time however few bytes its row has, and by their bytes
        alone tasks would be put together. By a hash of the path, as a join by paths would count as dealt already."""
        return rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("path"))

    def hashes(self, paths: DataFrame) -> DataFrame:
        """path, hash as contents() gives them; no content leaves the tasks."""
        return self._read(paths, False).select("path", "hash")

    def change(self, rows: DataFrame) -> DataFrame:
        """path, done for rows of path, content (null: remove) and accepted, the hashes of what may be replaced ("" for no
        file). Anything else is left alone and not done. The change happens when the result is read. Folders stay, see prune()."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _open(root)
            for batch in batches:
                out = []
                for path, content, accepted in ((x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):
                    try:
                        live = _content(fs, f"{base}/{path}")
                        now = "" if live is None else content_id(live)
                    except IsADirectoryError:
                        now = NO_FILE
                    wanted = "" if content is None else content_id(content)
                    if now != wanted and now in accepted:
                        _remove(fs, base, path) if content is None else _put(fs, base, path, content)
                    out.append((path, now == wanted or now in accepted))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.bool_())], names=["path", "done"])

        return self._dealt(rows.select("path", "content", "accepted")).mapInArrow(run, "path string, done boolean")

    def prune(self, removed: DataFrame) -> None:
        """Removes the folders that removed files (path) left empty. It comes after all changes, deepest folders first, and
        lists each of them once, however many of its files went."""
        root, parts = self.root, F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("path")))
        folders = removed.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("x")).select("x.depth", "x.path").distinct()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow.fs import FileSelector, FileType

            fs, base = _open(root)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    at = f"{base}/{path}"
                    if fs.get_file_info(at).type == FileType.Directory and not fs.get_file_info(FileSelector(at)):
                        fs.delete_dir(at)
                yield batch.slice(0, 0)

        for depth in range(folders.agg(F.max("depth")).first()[0] or 0, 0, -1):
            self._dealt(folders.where(F.col("depth") == depth).select("path")).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()

    def clear(self, paths: DataFrame) -> None:
        """Removes the folder and all below it; the files of `paths` by tasks, as one after the other they take long."""
        root = self.root

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = _open(root)
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    _remove(fs, base, path)
                yield batch.slice(0, 0)

        self._dealt(paths.select("path").distinct()).mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
        self.fs.delete(self._path(self.root), True)

    def read(self) -> DataFrame:
        """path, content, hash of all files below the folder; names that start with a dot or an underscore are not read."""
        if not self.fs.exists(self._path(self.root)):
            return self.spark.createDataFrame([], "path string, content string, hash string")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root)
        base = self.fs.makeQualified(self._path(self.root)).toUri().getPath() + "/"
        path = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
        return files.select(path.alias("path"), F.decode("content", "utf-8").alias("content"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))

    # --- transactions

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/{name}.parquet")

    def install(self, writes: DataFrame, deletes: DataFrame | None = None, expected: DataFrame | None = None, on_state: Callable[[str], None] = lambda state: None) -> None:
        """Writes path, content and removes the paths of `deletes`, all or nothing. `expected` (path, hash, null for no file)
        is what must be live, of targets and other files; without it, what is live now counts. A target that `expected` does
        not name must not exist. A failure in between is undone at once; a run that is cut off is for recover()."""
        if self.fs.exists(self._path(f"{self.home}/journal.parquet")):
            raise RuntimeError("a transaction is open: recover it first")
        self._discard()
        none = self.spark.createDataFrame([], "path string")
        staged = writes.select("path", F.col("content").cast("binary").alias("content"))
        staged.withColumn("hash", F.concat(F.lit("sha256:"), F.sha2("content", 256))).write.parquet(f"{self.home}/staged.parquet")
        targets = self._table("staged").select("path", F.lit("write").alias("kind"), F.col("hash").alias("new_hash")).unionByName((none if deletes is None else deletes).select("path", F.lit("delete").alias("kind"), F.lit(None).cast("string").alias("new_hash")))
        (self.hashes(targets) if expected is None else expected.select("path", "hash")).write.parquet(f"{self.home}/expected.parquet")
        expected = self._table("expected")
        journal = targets.join(expected.withColumnRenamed("hash", "old_hash"), "path", "left").select(F.lit(0).alias("tx"), "path", "kind", "old_hash", "new_hash")
        journal.write.parquet(f"{self.home}/journal.parquet")
        issues = recovery.journal_issues(self._table("journal")).limit(5).collect()
        if issues:
            self._discard()
            raise ValueError("; ".join(f"{r['path']}: {r['code']}" for r in issues))
        self._mark("staged")
        on_state("staged")
        try:
            self._move(expected, on_state)
        except PreconditionError:
            self.recover() if self._marked("moving") else self._discard()
            raise
        self._discard()

    def _move(self, expected: DataFrame, on_state: Callable[[str], None]) -> None:
        journal, staged = self._table("journal"), self._table("staged")
        wanted = journal.select("path", F.col("old_hash").alias("hash")).unionByName(expected.join(journal, "path", "left_anti"))
        self._hold(wanted.join(journal.where("old_hash is not null"), "path", "left_anti"))  # the others by their backup
        self.contents(journal.where("old_hash is not null")).write.parquet(f"{self.home}/backup.parquet")
        self._hold(journal.where("old_hash is not null").select("path", F.col("old_hash").alias("hash")), self._table("backup"))
        self._mark("verified")
        on_state("verified")
        self._mark("moving")
        accepted = F.array(F.coalesce("old_hash", F.lit("")))
        moves = journal.join(staged.select("path", "content"), "path", "left").select("path", F.when(F.col("kind") == "write", F.col("content")).alias("content"), accepted.alias("accepted"))
        left = self.change(moves).agg(F.count_if(~F.col("done")).alias("n"), F.min(F.when(~F.col("done"), F.col("path"))).alias("path")).first()
        on_state("moving")
        if left["n"]:
            raise PreconditionError(f"changed meanwhile: {left['path']} and {left['n'] - 1} others")
        self._hold(journal.select("path", F.col("new_hash").alias("hash")).unionByName(expected.join(journal, "path", "left_anti")))
        self.prune(journal.where("kind = 'delete'"))
        self._mark("committed")
        on_state("committed")

    def _hold(self, wanted: DataFrame, live: DataFrame | None = None) -> None:
        broken = broken_preconditions(wanted, self.hashes(wanted) if live is None else live).limit(5).collect()
        if broken:
            raise PreconditionError(f"changed meanwhile: {', '.join(r['path'] for r in broken)}")

    def recover(self) -> str | None:
        """forward, back, or None where no transaction is open. Where files are neither as before nor as wanted, nothing is
        touched, the transaction stays, and RecoveryConflictError names them."""
        if not self.fs.exists(self._path(f"{self.home}/journal.parquet/_SUCCESS")):
            self._discard()  # nothing live was touched before the journal was whole
            return None
        state = self.state() or "staged"
        journal = self._table("journal")
        issues = recovery.journal_issues(journal).limit(5).collect()
        if issues:
            raise RecoveryConflictError([(r["path"], r["code"]) for r in issues])
        tx = F.lit(0).alias("tx")
        whole = self.fs.exists(self._path(f"{self.home}/backup.parquet/_SUCCESS"))
        backup = self._table("backup") if whole else self.spark.createDataFrame([], "path string, content binary, hash string")
        judged = recovery.verdicts(journal, self.hashes(journal).select(tx, "path", "hash"), backup.select(tx, "path", "hash"))
        decided = recovery.outcomes(judged, self.spark.createDataFrame([(0, state)], "tx int, state string"))
        outcome = decided.first()["outcome"]
        if outcome == "conflict":
            raise RecoveryConflictError([(r["path"], r["conflict"]) for r in judged.where("conflict is not null").orderBy("path").limit(100).collect()])
        if outcome == "back":
            undo = recovery.repairs(judged, decided).where("action <> 'keep'").join(backup.select("path", "content"), "path", "left").join(journal.select("path", "old_hash", "new_hash"), "path")
            accepted = F.array(F.coalesce("new_hash", F.lit("")), F.lit(""), F.coalesce("old_hash", F.lit("")))
            self.change(undo.select("path", F.when(F.col("action") == "restore", F.col("content")).alias("content"), accepted.alias("accepted"))).write.format("noop").mode("overwrite").save()
        self.prune(journal.where("kind = 'delete'" if outcome == "forward" else "old_hash is null"))
        self._discard()
        return outcome

    def commit(self, documents: DataFrame, expected: DataFrame | None = None, batch: tuple[str, int] | None = None, state: dict | None = None) -> bool:
        """Makes path, content the whole of the folder: what `expected` names (or, without it, what is there) and the
        documents don't goes. With batch, a stream's name and a batch's number, the number is kept in the same transaction,
        and a batch that is there already changes nothing; so is a state. Returns whether anything was installed."""
        if batch is not None and batch[1] <= self.last_batch(batch[0]):
            return False
        live = self.read().select("path", "hash") if expected is None else expected.select("path", "hash")
        live = live.where("hash is not null")
        writes = documents.select("path", F.col("content").cast("binary").alias("content"))
        marks = ([(f"{LEDGER}/{batch[0]}", str(batch[1]).encode())] if batch else []) + ([(STATE, json.dumps(state).encode())] if state else [])
        if marks:
            marks = self.spark.createDataFrame(marks, "path string, content binary")
            writes, live = writes.unionByName(marks), live.unionByName(self.hashes(marks))
        self.install(writes, live.where(~F.startswith("path", F.lit(f"{LEDGER}/")) & (F.col("path") != STATE)).join(documents.select("path"), "path", "left_anti"), live)
        return True

    def kept_state(self) -> dict | None:
        """What the last commit that came with a state said of it."""
        found = self.contents(self.spark.createDataFrame([(STATE,)], "path string")).first()
        return json.loads(found["content"]) if found else None

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that was committed, -1 before the first."""
        found = self.contents(self.spark.createDataFrame([(f"{LEDGER}/{stream}",)], "path string")).first()
        return int(found["content"]) if found else -1
