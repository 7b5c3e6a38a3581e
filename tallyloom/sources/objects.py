"""The objects of a repository as tables: loose ones and those in packs, a commit's tree, and blobs within a limit.

No process is started. What an object is and how large comes first, without its content: of a pack the index (each of its
256 parts is a row for a task) and the heads of its entries. An entry that is a delta names another; these pointers are
followed by doubling, until each object has its chain of entries. Content is read only of objects that are asked for,
by tasks, each object's chain in place.
"""

from __future__ import annotations

import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .journal import _open
from .tables import stored

# Kinds of objects by their number in a pack; the last two are deltas.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag", 6: "by_place", 7: "by_id"}
TREE_MODE, LINK_MODE = "040000", "160000"
#: Bytes of inflated entries that a task keeps for the next chains.
KEPT_BYTES = 64 << 20
STEP = 1 << 14
OBJECTS = "oid string, kind string, size long, pack string, chain array<long>"


class Reader:
    """Entries of packs and loose objects, as a task reads them; open packs and inflated entries are kept for a while."""

    def __init__(self, git_dir: str, id_bytes: int):
        self.fs, self.base = _open(git_dir)
        self.id_bytes, self.files = id_bytes, {}
        self.kept: OrderedDict[tuple[str, int], bytes] = OrderedDict()
        self.size = 0

    def file(self, name: str):
        if name not in self.files:
            self.files[name] = self.fs.open_input_file(f"{self.base}/objects/{name}")
        return self.files[name]

    def head(self, pack: str, offset: int) -> tuple[int, int, int, int | None, str | None]:
        """number of the kind, size (of a delta: of what it makes), where the deflated part starts, and a delta's base."""
        f = self.file(f"pack/{pack}.pack")
        f.seek(offset)
        raw = f.read(64)
        at, byte = 1, raw[0]
        number, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte & 128:
            byte = raw[at]
            size |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
        base, base_id = None, None
        if KINDS[number] == "by_place":
            byte = raw[at]
            back, at = byte & 127, at + 1
            while byte & 128:
                byte = raw[at]
                back, at = (back + 1) << 7 | byte & 127, at + 1
            base = offset - back
        elif KINDS[number] == "by_id":
            base_id, at = raw[at : at + self.id_bytes].hex(), at + self.id_bytes
        start = offset + at
        if number > 4:
            first = self.inflated(f, start, 24)
            _, at = _varint(first, 0)
            size, _ = _varint(first, at)
        return number, size, start, base, base_id

    def inflated(self, f, start: int, most: int | None = None) -> bytes:
        f.seek(start)
        stream, out = zlib.decompressobj(), []
        while not stream.eof:
            more = f.read(STEP if most is None else 64)
            if not more:
                raise ValueError("an object is cut off")
            out.append(stream.decompress(more))
            if most is not None and sum(map(len, out)) >= most:
                break
        return b"".join(out)

    def entry(self, pack: str, offset: int) -> bytes:
        key = pack, offset
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        data = self.inflated(self.file(f"pack/{pack}.pack"), self.head(pack, offset)[2])
        self.kept[key] = data
        self.size += len(data)
        while self.size > KEPT_BYTES and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1])
        return data

    def content(self, oid: str, pack: str | None, chain: list[int] | None) -> bytes:
        if pack is None:
            with self.fs.open_input_file(f"{self.base}/objects/{oid[:2]}/{oid[2:]}") as f:  # read once: not kept open
                return self.inflated(f, 0).split(b"\0", 1)[1]
        data = self.entry(pack, chain[0])
        for offset in chain[1:]:
            data = apply_delta(data, self.entry(pack, offset))
        return data

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        byte = raw[at]
        out |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if not byte & 128:
            return out, at


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """The object that a delta makes of its base: copied ranges and literal bytes."""
    was, at = _varint(delta, 0)
    size, at = _varint(delta, at)
    if was != len(base):
        raise ValueError("a delta is of another base")
    out = bytearray()
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            numbers = []
            for bits, width in ((op & 15, 4), (op >> 4 & 7, 3)):
                number = 0
                for i in range(width):
                    if bits >> i & 1:
                        number |= delta[at] << 8 * i
                        at += 1
                numbers.append(number)
            start, n = numbers[0], numbers[1] or 65536
            out += base[start : start + n]
        else:
            out += delta[at : at + op]
            at += op
    if len(out) != size:
        raise ValueError("a delta makes another size")
    return bytes(out)


def tree_entries(data: bytes, id_bytes: int) -> list[tuple[str, str, str]]:
    """mode (six digits), name, object id of a tree's entries."""
    out, at = [], 0
    while at < len(data):
        blank, end = data.index(b" ", at), data.index(b"\0", at)
        out.append((data[at:blank].decode().zfill(6), data[blank + 1 : end].decode("utf-8"), data[end + 1 : end + 1 + id_bytes].hex()))
        at = end + 1 + id_bytes
    return out


class Repository:
    """`git_dir` is the folder that holds `objects`, by a path or address that all machines see."""

    def __init__(self, spark: SparkSession, git_dir: str, id_bytes: int = 20):
        self.spark, self.git_dir, self.id_bytes = spark, git_dir.rstrip("/"), id_bytes
        self._objects: DataFrame | None = None

    def _names(self, pattern: str) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.git_dir}/objects/{pattern}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(s.getPath().getName() for s in found or [])

    def objects(self) -> DataFrame:
        """oid, kind, size, pack (null: loose), chain of each object once; no content is read. Written once."""
        if self._objects is None:
            both = self._packed().unionByName(self._loose())
            one = both.groupBy("oid").agg(F.min_by(F.struct("kind", "size", "pack", "chain"), F.coalesce("pack", F.lit(""))).alias("x"))
            self._objects = stored(one.select("oid", "x.*"))
        return self._objects

    def _each(self, rows: DataFrame, schema: str, read) -> DataFrame:
        """Rows made of rows by `read`(reader, row), by tasks."""
        git_dir, id_bytes = self.git_dir, self.id_bytes
        names = rows.columns
        fields = self.spark.createDataFrame([], schema).schema

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            reader, arrow = Reader(git_dir, id_bytes), to_arrow_schema(fields)
            try:
                for batch in batches:
                    for row in zip(*(batch.column(i).to_pylist() for i in range(len(names))), strict=True):
                        out = list(read(reader, *row))
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            finally:
                reader.close()

        return rows.mapInArrow(run, schema)

    def _loose(self) -> DataFrame:
        """Loose objects, folder by folder; of a file its first bytes are read."""

        def read(reader: Reader, folder: str):
            from pyarrow.fs import FileSelector

            for info in reader.fs.get_file_info(FileSelector(f"{reader.base}/objects/{folder}")):
                name = info.path.rsplit("/", 1)[1]
                if len(name) == 2 * reader.id_bytes - 2:
                    with reader.fs.open_input_file(info.path) as f:
                        kind, size = reader.inflated(f, 0, 32).split(b"\0", 1)[0].decode().split(" ")
                    yield folder + name, kind, int(size), None, None

        folders = self._names("[0-9a-f][0-9a-f]")
        return self._each(self.spark.createDataFrame([(x,) for x in folders], "folder string").repartition(max(1, len(folders) // 8)), OBJECTS, read)

    def _index(self) -> DataFrame:
        """pack, oid, offset: the packs' indexes, each of their 256 parts by a row of its own."""

        def read(reader: Reader, pack: str, part: int):
            f = reader.file(f"pack/{pack}.idx")
            f.seek(0)
            if f.read(8) != b"\xfftOc\0\0\0\2":
                raise ValueError(f"{pack}.idx is of another version")
            counts = np.frombuffer(f.read(1024), ">u4").astype(np.int64)
            low, high, n, w = int(counts[part - 1]) if part else 0, int(counts[part]), int(counts[255]), reader.id_bytes
            if low == high:
                return
            f.seek(1032 + low * w)
            ids = f.read((high - low) * w)
            f.seek(1032 + n * (w + 4) + 4 * low)
            offsets = np.frombuffer(f.read(4 * (high - low)), ">u4").astype(np.int64)
            for i, offset in enumerate(offsets.tolist()):
                if offset >> 31:  # beyond 2 GB: a place in the table of long offsets
                    f.seek(1032 + n * (w + 8) + 8 * (offset & 0x7FFFFFFF))
                    offset = int.from_bytes(f.read(8), "big")
                yield pack, ids[i * w : (i + 1) * w].hex(), offset

        packs = [x.removesuffix(".idx") for x in self._names("pack/*.idx")]
        parts = self.spark.createDataFrame([(p,) for p in packs], "pack string").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(255)))).repartition(max(1, 8 * len(packs)))
        return self._each(parts, "pack string, oid string, offset long", read)

    def _packed(self) -> DataFrame:
        def read(reader: Reader, pack: str, oid: str, offset: int):
            number, size, _, base, base_id = reader.head(pack, offset)
            yield oid, pack, offset, KINDS[number], size, base, base_id

        entries = self._index().repartitionByRange("pack", "offset").sortWithinPartitions("pack", "offset")
        heads = stored(self._each(entries.select("pack", "oid", "offset"), "oid string, pack string, offset long, kind string, size long, base long, base_id string", read))
        named = heads.select("pack", F.col("oid").alias("base_id"), F.col("offset").alias("place"))
        now = heads.join(named, ["pack", "base_id"], "left").select("oid", "pack", "offset", "kind", "size", F.coalesce("base", "place").alias("up"), F.array("offset").alias("chain"))
        now = stored(now.withColumn("lost", F.col("kind").isin("by_place", "by_id") & F.col("up").isNull()))
        if not now.where("lost").isEmpty():
            raise ValueError("a delta's base is not in its pack")
        now = now.drop("lost")
        while not now.where("up is not null").isEmpty():
            base = now.select("pack", F.col("offset").alias("up"), F.col("kind").alias("k"), F.col("up").alias("further"), F.col("chain").alias("before"))
            kind = F.coalesce("k", "kind").alias("kind")
            now = stored(now.join(base, ["pack", "up"], "left").select("oid", "pack", "offset", kind, "size", F.col("further").alias("up"), F.when(F.col("before").isNull(), F.col("chain")).otherwise(F.concat("before", "chain")).alias("chain")))
        return now.select("oid", "kind", "size", "pack", "chain")

    def contents(self, objects: DataFrame) -> DataFrame:
        """oid, kind, size, data of the given objects (rows of objects())."""

        def read(reader: Reader, oid: str, kind: str, size: int, pack: str | None, chain: list[int] | None):
            data = reader.content(oid, pack, chain)
            if len(data) != size:
                raise ValueError(f"{oid} has another size")
            yield oid, kind, size, data

        rows = objects.select("oid", "kind", "size", "pack", "chain").sortWithinPartitions("pack", F.element_at("chain", 1))
        return self._each(rows, "oid string, kind string, size long, data binary", read)

    def exists(self, revision: str) -> bool:
        """Whether there is a commit of that id."""
        self._checked(revision)
        return not self.objects().where((F.col("oid") == revision) & (F.col("kind") == "commit")).isEmpty()

    def _checked(self, oid: str) -> None:
        if len(oid) != 2 * self.id_bytes or set(oid) - set("0123456789abcdef"):
            raise ValueError("that is no object id")

    def blobs(self, oids: DataFrame, most_bytes: int) -> DataFrame:
        """oid, size, truncated, data of blobs (oid); of one above the limit the content is not read. Ids of other objects,
        and of none, have no row."""
        if most_bytes <= 0:
            raise ValueError("the limit must be positive")
        found = self.objects().where("kind = 'blob'").join(oids.select("oid").distinct(), "oid", "left_semi")
        small = self.contents(found.where(F.col("size") <= most_bytes)).select("oid", "size", F.lit(False).alias("truncated"), "data")
        return small.unionByName(found.where(F.col("size") > most_bytes).select("oid", "size", F.lit(True).alias("truncated"), F.lit(None).cast("binary").alias("data")))

    def tree(self, revision: str, below: str = "") -> DataFrame:
        """path, mode, oid, size of a commit's files, those in or at `below` alone, where it is given; folders beside it are
        not read. The size of what is no blob here is null. The walk goes down a level of folders at a time."""
        self._checked(revision)
        commit = self.objects().where((F.col("oid") == revision) & (F.col("kind") == "commit"))
        root = self.contents(commit).first()
        if root is None:
            raise LookupError(f"there is no commit {revision}")
        first = root["data"].split(b"\n", 1)[0].decode().removeprefix("tree ")
        open_, out, id_bytes = self.spark.createDataFrame([("", first)], "folder string, oid string"), None, self.id_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(f"{folder}{name}", mode, oid) for folder, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for mode, name, oid in tree_entries(data, id_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["path", "mode", "oid"])

        trees = self.objects().where("kind = 'tree'")
        inside = lambda path: (path == below) | F.startswith(path, F.lit(f"{below}/")) | F.lit(not below)
        while True:
            data = self.contents(trees.join(open_.select("oid").distinct(), "oid", "left_semi")).select("oid", "data")
            rows = stored(open_.join(data, "oid").select("folder", "data").mapInArrow(run, "path string, mode string, oid string"))
            files = rows.where((F.col("mode") != TREE_MODE) & inside(F.col("path")))
            out = files if out is None else out.unionByName(files)
            folders = rows.where(F.col("mode") == TREE_MODE)
            on_the_way = inside(F.col("path")) | F.startswith(F.lit(below), F.concat("path", F.lit("/")))
            open_ = folders.where(on_the_way).select(F.concat("path", F.lit("/")).alias("folder"), "oid")
            if open_.isEmpty():
                break
        sizes = self.objects().where("kind = 'blob'").select("oid", "size")
        return out.join(sizes, "oid", "left").select("path", "mode", "oid", "size")

    def file(self, revision: str, path: str, most_bytes: int) -> tuple[int, bool, bytes | None] | None:
        """size, truncated, data of one file of a commit, or None where it has none of that path."""
        found = self.blobs(self.tree(revision, path).where(F.col("path") == path), most_bytes).first()
        return (found["size"], found["truncated"], found["data"]) if found else None
