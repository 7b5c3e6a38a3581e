"""The prefix trie of conversations, family by family first.

Conversations of one base identifier are a family. Its rows come to one task in order, the base's first turns before the
rest, and stream through it: each conversation is rebuilt, and the family's small trie is given as soon as the family ends.
Only these combined nodes are shuffled and merged. A node is known by a digest of its turns (128 bits), chained turn by turn.

Sums below a node need no walk of the tree. The nodes whose smallest member is the same conversation are one vertical
chain; chains hang on chains, a table with a row a conversation at most, which is summed by doubling its pointers. Within a
chain a running sum from the deepest node upward gives each node's part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, remove, scratch, stored

FAMILY = 100
#: A rebuilt conversation starts with fewer turns of its base than this.
HEADS = 6
#: Rows of a family that come to one task; a larger family is dealt over several by conversation.
FAMILY_ROWS = 200_000
#: Nodes that a task holds before it gives them unmerged, and rows that it gives at once.
TRIE_NODES, ROWS_AT_ONCE = 50_000, 10_000
#: Identifiers that one piece of a node's list has.
PIECE = 4096
ROOT = bytes(16)
NODE = "node binary, depth long, parent binary, conv_id long, n long, chars long, is_end boolean"


def step(node: bytes, role: str, text: str) -> bytes:
    """The digest of the sequence that has one turn more."""
    of = role.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(node + len(of).to_bytes(8, "little") + of + text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def heads(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def families(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family_rows: int = FAMILY_ROWS) -> DataFrame:
    """(base, part, member, conv_id, role, text): each family's rows in one place and in order, first the base's first
    turns (member false), then all turns of each conversation."""
    c = F.col(conv_col).cast("long")
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select((c - c % FAMILY).alias("base"), c.alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # at most a row for each `family_rows` rows of the table
    large = rows.groupBy("base").count().where(F.col("count") > family_rows).select("base", F.ceil(F.col("count") / family_rows).cast("int").alias("parts"))
    rows = rows.join(F.broadcast(large), "base", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    first = rows.where(F.col("conv_id") == F.col("base")).withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))).where(F.col("nth") < HEADS)
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("member", F.lit(False))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("conv_id"), F.col("parts")).cast("int")).withColumn("member", F.lit(True))
    columns = ["base", "part", "member", "conv_id", "turn", "role", "text"]
    both = rows.select(*columns).union(first.select(*columns))
    return both.repartition("base", "part").sortWithinPartitions("base", "part", "member", "conv_id", *order).select("base", "part", "member", "conv_id", "role", "text")


class FamilyTrie:
    """The nodes of one family (or part of one) and where its conversations end."""

    def __init__(self):
        self.base: list[tuple[bytes, int]] = [(ROOT, 0)]  # the base's first nodes, with the length of their last text
        self.nodes: dict[bytes, list] = {}
        self.ends: list[tuple[bytes, int]] = []
        self.conv, self.skip, self.at = None, 0, ROOT

    def head(self, role: str, text: str) -> None:
        self.base.append((step(self.base[-1][0], role, text), len(text)))

    def visit(self, node: bytes, depth: int, parent: bytes | None, chars: int) -> None:
        known = self.nodes.get(node)
        if known:
            known[3] += 1
        else:  # conversations come in ascending order: the first is the smallest member
            self.nodes[node] = [depth, parent, self.conv, 1, chars]

    def start(self, conv: int) -> None:
        self.end()
        self.conv, self.skip = conv, heads(conv)
        own = self.base[: self.skip + 1]
        for depth, (node, chars) in enumerate(own):
            self.visit(node, depth, own[depth - 1][0] if depth else None, chars)
        self.at, self.depth = own[-1][0], len(own) - 1

    def turn(self, role: str, text: str) -> None:
        if self.skip:
            self.skip -= 1
            return
        node = step(self.at, role, text)
        self.depth += 1
        self.visit(node, self.depth, self.at, len(text))
        self.at = node

    def end(self) -> None:
        if self.conv is not None:
            self.ends.append((self.at, self.conv))
        self.conv = None

    def rows(self) -> Iterator[pa.RecordBatch]:
        """What there is so far; nodes that come again later are merged with these by their digest."""
        schema = pa.schema([("node", pa.binary()), ("depth", pa.int64()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("is_end", pa.bool_())])
        out = [(node, *v, False) for node, v in self.nodes.items()] + [(node, None, None, conv, None, None, True) for node, conv in self.ends]
        for i in range(0, len(out), ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + ROWS_AT_ONCE], strict=True), schema, strict=True)], schema=schema)
        self.nodes, self.ends = {}, []


def family_tries(rows: DataFrame) -> DataFrame:
    """The nodes of each family's trie (with the members that the family has) and, is_end, each member's last node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, key = FamilyTrie(), None
        for batch in batches:
            for base, part, member, conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (base, part) != key:
                    trie.end()
                    yield from trie.rows()
                    trie, key = FamilyTrie(), (base, part)
                if not member:
                    trie.head(role, text)
                    continue
                if conv != trie.conv:
                    trie.start(conv)
                trie.turn(role, text)
                if len(trie.nodes) + len(trie.ends) >= TRIE_NODES:
                    yield from trie.rows()
        trie.end()
        yield from trie.rows()

    return rows.mapInArrow(run, NODE)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes at which conversations end. The identifiers are range-sorted, joined to pieces where
    they lie, and the pieces of a node stream through one digest."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []
        for batch in batches:
            for of, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (of != node or len(ids) == PIECE):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = of
                ids.append(conv)
            yield give(out)
            out = []
        if ids:
            yield give([(node, ids[0], ",".join(map(str, ids)))])

    def give(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            out = []
            for of, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if of == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = of, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["node", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    ordered = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    joined = ordered.mapInArrow(pieces, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digests, "node binary, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of (conv_id, up, leaves, saved): a chain's own sums with those of all chains that hang on
    it, at any remove. In each round a chain hands its sums to the chain that its pointer names, and pointers double; the
    rounds are the logarithm of the chains' nesting, and each is a table that goes once the next is written."""
    spark, at = chains.sparkSession, None
    now = chains
    while True:
        before, at = at, scratch(spark, "chains")
        now.write.parquet(at)
        now = spark.read.schema(chains.schema).parquet(at)
        if before:
            remove(spark, before)
        linked = now.where("up is not null")
        if linked.isEmpty():
            return now.select("conv_id", "leaves", "saved")
        add = linked.groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        hop = linked.select(F.col("conv_id").alias("up"), F.col("up").alias("further"))
        total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        now = now.join(add, "conv_id", "left").join(hop, "up", "left").select("conv_id", F.col("further").alias("up"), total("leaves", "l"), total("saved", "s"))


def trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family_rows: int = FAMILY_ROWS) -> DataFrame:
    """The nodes of the trie over all rebuilt conversations, with what the contract of the query names.

    Turns are ordered by turn (nulls first), then by role and text; repeated rows are turns of their own. Null roles and
    texts count as empty, rows without a conversation are left out. A negative identifier's base is above it (-5 has 0). One
    conversation's turns are one task's stream, however many they are. An empty table has no node, not even a root. Other
    columns are ignored; long texts count whole."""
    rows = stored(family_tries(families(conversations, conv_col, turn_col, role_col, text_col, family_rows)))
    nodes = stored(rows.where("not is_end").groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("chars").alias("chars")))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(children, "node", "left").join(ends_digest(rows.where("is_end")), "node", "left").join(parents, "parent", "left")
    full = full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    full = stored(full)
    leaf = (F.col("n_children") == 0).cast("long")
    # a chain's first node is the one whose parent is another conversation's, or the root
    first = F.min(F.struct("depth", "parent_conv_id"))
    chains = stored(full.groupBy("conv_id").agg(first.alias("first"), F.sum(leaf).alias("leaves"), F.sum("own").alias("saved")).select("conv_id", F.col("first.parent_conv_id").alias("up"), (F.col("first.depth") - 1).alias("at"), "leaves", "saved"))
    hung = chains.select("conv_id", "up", "at").where("up is not null").join(chain_totals(chains.drop("at")), "conv_id")
    hung = hung.groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("leaves_hung"), F.sum("saved").alias("saved_hung"))
    full = full.join(hung, ["conv_id", "depth"], "left")
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda own, more: F.sum(own + F.coalesce(more, F.lit(0))).over(below)
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total(leaf, "leaves_hung").alias("n_leaves"), total(F.col("own"), "saved_hung").alias("saved_tokens"), "ends_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the nodes of the trie over all `conversations`."""
    return trie(read(spark, sf_dir, "conversations"))


#: The same in DuckDB's SQL: CRC-32 bit by bit, and a node is known by its turns' digests in a row.
ORACLE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT k.c, t.pos, role, text FROM k JOIN t ON t.c = k.c - k.c % 100 AND t.pos <= k.h
  UNION ALL SELECT k.c, t.pos + 1000000, role, text FROM k JOIN t ON t.c = k.c AND t.pos > k.h),
n AS (SELECT c, text, row_number() OVER w AS d, string_agg(md5(length(role) || ':' || role || text) || '/', '') OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
m AS (SELECT c, d, path, length(text) AS chars FROM n UNION ALL SELECT c, 0, '', 0 FROM k),
e AS (SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM m GROUP BY c) GROUP BY path),
v AS (SELECT path, d, min(c) AS c, count(*) AS n, (count(*) - 1) * max(chars) AS own FROM m GROUP BY path, d),
ch AS (SELECT left(path, (d - 1)::INTEGER * 33) AS path, count(*) AS children FROM v WHERE d > 0 GROUP BY 1),
a AS (SELECT v.*, coalesce(children, 0) AS children FROM v LEFT JOIN ch USING (path)),
up AS (SELECT left(path, j::INTEGER * 33) AS path, sum((children = 0)::BIGINT)::BIGINT AS leaves, sum(own)::BIGINT AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM a) GROUP BY 1)
SELECT a.c AS conv_id, a.d::BIGINT AS depth, p.c AS parent_conv_id, a.n::BIGINT AS n_convs, a.children::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM a LEFT JOIN v p ON a.d > 0 AND p.path = left(a.path, (a.d - 1)::INTEGER * 33) JOIN up ON up.path = a.path LEFT JOIN e ON e.path = a.path
"""
