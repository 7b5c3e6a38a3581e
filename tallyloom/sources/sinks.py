"""Writing a set of files so that readers see all of it or none."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.output import broken_preconditions

POINTER = "CURRENT"


class PreconditionError(RuntimeError):
    pass


class VersionedStore:
    """A folder of versions, each written whole by Spark, and numbered pointer files, of which the last names the version
    that counts.

    A commit writes a new version, checks that the live hashes are still the expected ones, and puts the next pointer in
    place, which fails where somebody else has put that number: of two commits on the same version one is refused. A
    pointer also holds the last batch of each stream, so that a version and the batch that made it count together or
    not at all. What a crash leaves is a version that no pointer names, which prune() removes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self.path(self.root)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def pointer(self) -> tuple[int, dict]:
        """The number of the last pointer (0 before the first commit) and what it holds: the version, the last batch of each
        stream, and the state that goes with it."""
        n = max((int(x.removeprefix(f"{POINTER}-")) for x in self._names() if x.startswith(f"{POINTER}-")), default=0)
        if not n:
            return 0, {"version": None, "batches": {}, "state": None}
        return n, json.loads(self.spark.read.text(f"{self.root}/{POINTER}-{n:012d}", wholetext=True).first()[0])

    def version(self) -> str | None:
        return self.pointer()[1]["version"]

    def last_batch(self, stream: str) -> int:
        """The number of the last batch of a stream that was committed, -1 before the first."""
        return self.pointer()[1]["batches"].get(stream, -1)

    def kept_state(self) -> dict | None:
        """What the last commit that came with a state said of it."""
        return self.pointer()[1]["state"]

    def recover(self) -> None:
        """Nothing is to be completed or undone: readers follow committed pointers only."""

    def read(self) -> DataFrame:
        """path, content, hash of the committed version; none before the first commit."""
        v = self.version()
        return self.spark.read.parquet(f"{self.root}/{v}") if v else self.spark.createDataFrame([], "path string, content string, hash string")

    def commit(self, documents: DataFrame, expected: DataFrame | None = None, batch: tuple[str, int] | None = None, state: dict | None = None) -> str:
        """Installs path, content. `expected` (path, hash) is what must be live; else the commit is refused. With batch, a
        stream's name and a batch's number, a batch that is there already changes nothing. A state is kept with the
        version, or else the one before. Returns the version that counts."""
        number, kept = self.pointer()
        batches = kept["batches"]
        if batch is not None and batch[1] <= batches.get(batch[0], -1):
            return kept["version"]
        name = f"v-{uuid.uuid4().hex}"
        documents.select("path", "content", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash")).write.parquet(f"{self.root}/{name}")
        if expected is not None:
            broken = broken_preconditions(expected, self.read()).limit(5).collect()
            if broken:
                raise PreconditionError(f"changed meanwhile: {', '.join(r['path'] for r in broken)}")
        self._point(number + 1, {"version": name, "batches": batches if batch is None else batches | {batch[0]: batch[1]}, "state": state or kept["state"]})
        return name

    def _point(self, number: int, kept: dict) -> None:
        """Writes a pointer aside and renames it to its number, unless that is taken."""
        aside = self.path(f"{self.root}/new-{uuid.uuid4().hex}")
        out = self.fs.create(aside, True)
        out.write(bytearray(json.dumps(kept).encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, self.fs.makeQualified(self.path(f"{self.root}/{POINTER}-{number:012d}")), options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self.fs.delete(aside, False)
            raise PreconditionError(f"another commit is number {number}") from None

    def prune(self) -> list[str]:
        """Removes versions and states that aren't the committed ones, pointers before the last, and what never became one."""
        n, kept = self.pointer()
        keep, gone = {kept["version"], (kept["state"] or {}).get("at"), f"{POINTER}-{n:012d}"}, []
        for name in self._names():
            if name.startswith(("v-", "new-", ".state-", f"{POINTER}-")) and name not in keep:
                self.fs.delete(self.path(f"{self.root}/{name}"), True)
                gone.append(name)
        return gone


def write_state(files: DataFrame, components: DataFrame, root: str) -> None:
    """The state as two tables; keys make their order."""
    files.select("path", "source_hash", "role", "triggers", "component_key", "root_component").orderBy("path").write.mode("overwrite").parquet(f"{root}/files")
    components.orderBy("component_key", "root_component").write.mode("overwrite").parquet(f"{root}/components")
