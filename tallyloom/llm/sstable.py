"""Token-id output as sorted-string-table shards.

A shard file holds documents in ascending key order:

    data block*   zstd of: entry*; an entry is varint(shared), varint(unshared), varint(bytes of value),
                  key suffix, value. `shared` is how many leading key bytes equal the previous entry's; it
                  is 0 at a block's first entry.
    index block   zstd of: for each data block varint(key length), first key, varint(offset), varint(bytes)
    bloom block   bits of a Bloom filter over the shard's keys
    footer        fixed 64 bytes: index offset and bytes, bloom offset and bytes, number of entries, number of
                  ids, number of hash functions (unsigned 64 bits each, little endian), magic

A key is the document identifier, big endian with the sign bit flipped so that byte order is numeric order, after
one byte that is 0 for a null identifier (nulls sort first) and 1 else, and followed by a 4-byte sequence number
within equal identifiers: repeated identifiers keep all their rows. A value is the ids, 2 bytes each where the
vocabulary allows and 4 else (the first value byte says which).

Rows may have a place of their own instead, such as that in a training mix: then the place is the key, and the value's
first byte is 16 more and the identifier (a byte that is 0 for null, and 8 bytes) comes before the ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read, scratch, slices
from .tokenize import tokenizer as load_tokenizer

MAGIC = b"TLSSTBL1"
FOOTER = struct.Struct("<7Q8s")
BLOCK_BYTES = 64 << 10
#: Bytes of text that are tokenised at once; a longer document is a step of its own.
ENCODE_BYTES = 2 << 20
BITS_PER_KEY = 10
HASHES = 7


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def make_key(doc_id: int | None, seq: int = 0) -> bytes:
    head = b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)
    return head + struct.pack(">I", seq)


def key_id(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:9])[0] - (1 << 63) if key[0] else None


def bloom_at(head: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(head)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and a path in it; a plain path is local, as in tests."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


#: What the first byte of a value has more if the identifier is in the value, and the bytes that this takes.
WITH_ID, ID_BYTES = 16, 9


def encode_value(ids: np.ndarray, wide: bool, identifier: bytes = b"") -> bytes:
    return bytes([(4 if wide else 2) + (WITH_ID if identifier else 0)]) + identifier + ids.astype("<u4" if wide else "<u2").tobytes()


def decode_value(value: bytes) -> np.ndarray:
    size, with_id = value[0] & 7, value[0] & WITH_ID
    return np.frombuffer(value, dtype="<u4" if size == 4 else "<u2", offset=1 + (ID_BYTES if with_id else 0)).astype("<u4")


def entry_id(key: bytes, value: bytes) -> int | None:
    """The document's identifier, wherever the entry has it."""
    return key_id(value[1 : 1 + ID_BYTES]) if value[0] & WITH_ID else key_id(key)


def read_order(docs: DataFrame) -> Column:
    """The place of each row in the order of the Parquet files that `docs` was read from, as Spark names them
    (part-N, -cN) and within them: the order in which a sorted table was written. Where the rows have no such
    file, the order of their partitions."""
    as_dealt = F.monotonically_increasing_id()
    try:
        docs.select("_metadata.file_name", "_metadata.row_index")
    except AnalysisException:
        return as_dealt
    name = F.col("_metadata.file_name")
    part, chunk = (F.try_to_number(F.regexp_extract(name, rx, 1), F.lit("9999999999")) for rx in (r"^part-(\d+)", r"-c(\d+)\."))
    placed = F.shiftleft(part.cast("long"), 40) + F.shiftleft(F.coalesce(chunk, F.lit(0)).cast("long"), 30) + F.col("_metadata.row_index")
    return F.coalesce(placed, as_dealt)


class ShardWriter:
    """Writes one shard in one pass; memory holds a block, the index and the keys' hashes."""

    def __init__(self, sink, block_bytes: int = BLOCK_BYTES):
        self.sink, self.block_bytes = sink, block_bytes
        self.block, self.index, self.heads = bytearray(), [], []
        self.first = self.last = b""
        self.entries = self.ids = self.at = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray, wide: bool, identifier: bytes = b"") -> None:
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = encode_value(ids, wide, identifier)
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        if not self.heads or self.heads[-1] != key[:9]:
            self.heads.append(key[:9])
        self.last = key
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self.flush()

    def put(self, data: bytes) -> tuple[int, int]:
        self.sink.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def flush(self) -> None:
        if self.block:
            self.index.append((self.first, *self.put(self.zip.compress(bytes(self.block)))))
            self.block = bytearray()

    def finish(self) -> None:
        self.flush()
        index = self.put(self.zip.compress(b"".join(varint(len(k)) + k + varint(o) + varint(n) for k, o, n in self.index)))
        bits = max(64, -(-len(self.heads) * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, dtype=bool)
        for head in self.heads:
            bloom[bloom_at(head, bits)] = True
        at = self.put(np.packbits(bloom, bitorder="little").tobytes())
        self.put(FOOTER.pack(*index, *at, self.entries, self.ids, HASHES, MAGIC))


class ShardReader:
    """Reads the footer, the index and the filter at once, data blocks when asked for."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        io, inb, bo, bn, self.entries, self.ids, _, magic = FOOTER.unpack(self.range(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        raw, at, self.index = self.unzip(self.range(io, inb)), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key = raw[at : at + n]
            o, at = read_varint(raw, at + n)
            b, at = read_varint(raw, at)
            self.index.append((key, o, b))
        self.bloom, self.bits = self.range(bo, bn), bn * 8

    def range(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    @staticmethod
    def unzip(data: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(data)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, o, n = self.index[i]
        raw, at, key = self.unzip(self.range(o, n)), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row with this identifier: filter, then binary search in the index, then blocks."""
        head = make_key(doc_id)[:9]
        if not self.entries or not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in bloom_at(head, self.bits)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose first key is past all keys before this identifier's
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < head else (lo, mid)
        found = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0][:9] > head:
                break
            found += [decode_value(v) for k, v in self.block(i) if k[:9] == head]
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, out: str | None = None, shards: int | None = None, place: Column | None = None) -> DataFrame:
    """Tokenises whole texts and writes shards in ascending identifier order below `out` (default: the shared folder).

    Returns (shard int, path string, entries long, ids long), a row for each shard, from a table that was written:
    reading it again writes nothing. Texts are range-partitioned by identifier and sorted within partitions, so
    shard n's identifiers all come before shard n+1's. A shard is written under a name of its attempt's own and
    then renamed, so that a retried or lost task leaves no half file under a listed name.

    Null texts count as empty and give the end id alone. Null identifiers sort first. Equal identifiers stay
    apart, ordered by a hash of the text; equal rows are all kept. An empty table gives no shards. Other columns are ignored.
    With `place`, a long column, shards are in its ascending order (equal places by text), and keys are places.
    """
    spark, placed = docs.sparkSession, place is not None
    base = out or scratch(spark, "shards")
    doc_id = F.col(id_col).cast("long")
    rows = docs.select((doc_id if place is None else place).alias("key"), F.col(text_col).cast("string").alias("text"), *([] if place is None else [doc_id.alias("id")]))
    # a key of very many rows is dealt out over several shards by a hash of the text, which sorts before the text in it
    order = ["key", F.xxhash64("text")]
    ranged = (rows.repartitionByRange(shards, *order) if shards else rows.repartitionByRange(*order)).sortWithinPartitions(*order, "text")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, writer, last, seq = load_tokenizer(tokenizer), None, object(), 0
        fs, root = open_fs(base)
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        wide = max(encoder.size, end_id + 1) > 1 << 16
        for batch, text in slices(batches, 1, ENCODE_BYTES):
            if writer is None:
                fs.create_dir(root, recursive=True)
                sink = fs.open_output_stream(f"{name}.tmp")
                writer = ShardWriter(sink)
            ids, ends = encoder.encode(text)
            at = 0
            keys = batch.column(0).to_pylist()
            names = [make_key(i)[:ID_BYTES] for i in batch.column(2).to_pylist()] if placed else [b""] * len(keys)
            for key, name_, to in zip(keys, names, ends.tolist(), strict=True):
                seq = seq + 1 if key == last else 0
                last = key
                writer.add(make_key(key, seq), np.append(ids[at:to], end_id), wide, name_)
                at = to
        if writer is not None:
            writer.finish()
            sink.close()
            fs.move(f"{name}.tmp", f"{name}.sst")
            scheme = base[: base.index(root)] if root in base else ""
            yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "path": [f"{scheme}{name}.sst"], "entries": [writer.entries], "ids": [writer.ids]})

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("entries", T.LongType()), T.StructField("ids", T.LongType())])
    written = ranged.mapInArrow(write, schema)
    written.write.parquet(f"{base}/manifest")
    return spark.read.schema(schema).parquet(f"{base}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the shard files alone, in their order.

    start counts the ids of all documents before, over all shards; the counts before each shard come from the
    manifest, one row a shard. ids_crc32 is over the ids as little-endian unsigned 32-bit integers.
    """
    spark = manifest.sparkSession
    before, at = {}, 0
    for r in manifest.orderBy("shard").select("shard", "ids").toLocalIterator():  # a row for each shard
        before[r["shard"]], at = at, at + r["ids"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not before:
        return spark.createDataFrame([], schema)
    starts = spark.sparkContext.broadcast(before)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, start, rows = ShardReader(path), starts.value[shard], []
                for key, value in reader:
                    ids = decode_value(value)
                    rows.append((entry_id(key, value), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield as_batch(rows)
                        rows = []
                reader.close()
                if rows:
                    yield as_batch(rows)

    def as_batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("shard", "path").repartition(min(len(before), 4096), "shard").mapInArrow(scan, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's place, number of ids and checksum, read back from the shards."""
    import public_tokenizers

    return read_shards(write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
