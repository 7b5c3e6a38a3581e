"""URL filters: rules by host and path, and a Bloom filter cascade for a list of keys."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_prefix, read, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Keys of the universe that one shard's cascade tells apart, about; a task builds a shard.
KEYS_A_SHARD = 500_000
#: Bytes of all cascades that are broadcast at most; beyond it the rows are dealt out to the shards.
MOST_BYTES = 64 << 20
#: Tasks that one shard's rows are dealt out to, as one key may be a third of all rows.
SALTS = 8
MASK = (1 << 56) - 1


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Null, and a url without "://", give two empty texts."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    def __str__(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


#: The rules of the query.
RULES = [UrlRule("com", "/", True), UrlRule("example.com", "/en/", False), UrlRule("www.example.com", "/en/", True), UrlRule("net", "/es/", False), UrlRule("net", "/fr/", False)]


def rule_columns(rules: list[UrlRule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and whether it allows; of equally long ones the one that allows."""
    text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for r in sorted(rules, key=lambda r: (len(str(r)), r.allow, str(r))):
        text, allow = F.when(r.fits(host, path), F.lit(str(r))).otherwise(text), F.when(r.fits(host, path), F.lit(r.allow)).otherwise(allow)
    return text, allow


@dataclass
class Level:
    """One Bloom filter over pairs of 56-bit hashes; probes are (a + i b) mod bits after mixing in the level."""

    salt: int
    bits: int
    probes: int
    data: np.ndarray = field(repr=False)

    @staticmethod
    def shape(n: int, rate: float) -> tuple[int, int]:
        per = math.log2(1 / rate)
        return max(64, -(-int(math.ceil(n * per * 1.4427)) // 64) * 64), max(1, round(per))

    @staticmethod
    def mixed(a: np.ndarray, b: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        mul = np.uint64(0x9E3779B97F4A7C15)
        mix = lambda x, s: ((x ^ np.uint64(s)) * mul) ^ (((x ^ np.uint64(s)) * mul) >> np.uint64(29))
        return mix(a.astype(np.uint64), 2 * salt + 1) >> np.uint64(8), mix(b.astype(np.uint64), 2 * salt + 2) >> np.uint64(8) | np.uint64(1)

    def positions(self, a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        return (a + np.uint64(i) * b) % np.uint64(self.bits)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.mixed(a, b, self.salt)
        for i in range(self.probes):
            p = self.positions(a, b, i)
            np.bitwise_or.at(self.data, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = self.mixed(a, b, self.salt)
        out = np.ones(len(a), dtype=bool)
        for i in range(self.probes):
            p = self.positions(a, b, i)
            out &= (self.data[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


@dataclass
class Cascade:
    """Levels in turn hold listed keys and the keys of the universe that the level before takes in wrongly. The
    first level without a key decides: an even one says not listed, an odd one listed; exact on the universe."""

    levels: list[Level]

    def member(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(a), len(self.levels) % 2 == 1), np.ones(len(a), dtype=bool)
        for k, level in enumerate(self.levels):
            gone = open_ & ~level.has(a, b)
            out[gone] = k % 2 == 1
            open_ &= ~gone
        return out


def key_hashes(key: Column) -> list[Column]:
    return [F.xxhash64(F.lit(s), key).bitwiseAND(F.lit(MASK)) for s in (11, 23)]


def build(inside: np.ndarray, outside: np.ndarray) -> Cascade:
    """A cascade that tells the keys (rows of two hashes) of `inside` from those of `outside`, two disjoint sets."""
    levels, rate = [], min(0.5, max(len(inside), 1) / max(len(outside) * math.sqrt(2), 1))
    while len(inside):
        bits, probes = Level.shape(len(inside), rate)
        level = Level(len(levels), bits, probes, np.zeros(bits // 64, np.uint64))
        level.add(inside[:, 0], inside[:, 1])
        levels.append(level)
        inside, outside, rate = outside[level.has(outside[:, 0], outside[:, 1])], inside, 0.5
    return Cascade(levels)


def cascades(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, data): the pickled cascade of each shard, built by a task from its distinct keys (a, b, and l for listed)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column(0))
            borders = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for lo, hi in zip(borders, borders[1:], strict=False):
                if held and lo < hi and held[-1].column(0)[0].as_py() != int(shard[lo]):
                    yield built(held)
                    held = []
                if lo < hi:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield built(held)

    def built(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, listed = (np.concatenate([x.column(k).to_numpy(zero_copy_only=False) for x in held]) for k in (1, 2, 3))
        both = np.stack([a, b], axis=1)
        cascade = build(both[listed], both[~listed])
        return pa.RecordBatch.from_pydict({"shard": held[0].column(0).slice(0, 1), "data": [pickle.dumps(cascade)]})

    dealt = keys.select(F.pmod("b", F.lit(shards)).cast("int").alias("shard"), "a", "b", "l").repartition("shard").sortWithinPartitions("shard")
    return stored(dealt.mapInArrow(run, "shard int, data binary"))


def _member(cascades_, shards: int):
    """Looks keys up in broadcast cascades."""

    @F.pandas_udf("boolean")
    def member(a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(), b.to_numpy()
        out, shard = np.zeros(len(a), dtype=bool), b % shards
        for k in np.unique(shard).tolist():
            at = shard == k
            if k in cascades_.value:
                out[at] = cascades_.value[k].member(a[at], b[at])
        return pd.Series(out)

    return member


def _met(rows: DataFrame, built: DataFrame, shards: int, p: str) -> DataFrame:
    """`rows` with `listed`, where each shard's rows come to the shard's cascade, which is sorted before them. Rows have the
    hashes in {p}a and {p}b. A shard's rows go to SALTS tasks, each with a copy of its cascade; there is no join."""
    names, schema = rows.columns, rows.schema
    dealt = rows.withColumns({f"{p}shard": F.pmod(f"{p}b", F.lit(shards)).cast("int"), f"{p}salt": F.pmod(F.xxhash64(*[c for c in names if not c.startswith(p)], F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"), f"{p}data": F.lit(None).cast("binary")})
    heads = built.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields], F.col("shard").alias(f"{p}shard"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(f"{p}salt"), F.col("data").alias(f"{p}data"))
    both = dealt.unionByName(heads).repartition(f"{p}shard", f"{p}salt").sortWithinPartitions(f"{p}shard", f"{p}salt", F.col(f"{p}data").isNull())
    width, at = len(names), [names.index(p + x) for x in "ab"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = Cascade([])
        for batch in batches:
            data = batch.column(width + 2)
            heads = np.flatnonzero(np.asarray(data.is_valid())).tolist()
            for lo, hi in zip([-1, *heads], [*heads, len(data)], strict=True):
                if lo >= 0:
                    cascade = pickle.loads(data[lo].as_py())
                part = batch.slice(lo + 1, hi - lo - 1)
                if len(part):
                    a, b = (part.column(k).to_numpy(zero_copy_only=False) for k in at)
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], pa.array(cascade.member(a, b))], names=[*names, "listed"])

    return both.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("listed", T.BooleanType())]))


def mark_listed(rows: DataFrame, key: Column, listed: DataFrame, listed_key: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`rows` with a boolean column `listed` (instead of one that is there): whether the key is one of the list's.

    The universe is all keys of `rows`, so membership is exact for each of them (keys count as equal if their 112
    hash bits are). Nothing is joined: listed and other keys are told apart by one aggregation, dealt out to shards by
    hash, and a task builds each shard's cascade. Cascades of `most_bytes` together are broadcast; more are met by the
    rows of their shards, dealt out by the same hash, in one pass. A null key is not listed; null keys of the list are
    left out. An empty list lists nothing. Repeated keys on either side don't matter; an empty table gives none.
    """
    spark, rows = rows.sparkSession, rows.drop("listed")
    p = free_prefix(rows, "key_")
    hashed = lambda df, k, flag: df.select(k.alias("k")).where("k is not null").select(*[c.alias(n) for c, n in zip(key_hashes(F.col("k")), "ab", strict=True)], F.lit(flag).alias("l"))
    keys = stored(hashed(listed, listed_key, True).union(hashed(rows, key, False)).groupBy("a", "b").agg(F.bool_or("l").alias("l")))
    shards = max(1, -(-keys.count() // KEYS_A_SHARD))
    built = cascades(keys, shards)
    size = built.agg(F.sum(F.length("data"))).first()[0] or 0
    a, b = (F.coalesce(h, F.lit(0)) for h in key_hashes(key))
    marked = rows.withColumns({f"{p}a": a, f"{p}b": b, f"{p}no": key.isNull()})
    if size <= most_bytes:
        shared = spark.sparkContext.broadcast({r["shard"]: pickle.loads(r["data"]) for r in built.toLocalIterator()})  # `most_bytes` at most
        marked = marked.withColumn("listed", _member(shared, shards)(f"{p}a", f"{p}b"))
    else:
        marked = _met(marked, built, shards, p)
    return marked.withColumn("listed", F.col("listed") & ~F.col(f"{p}no")).drop(f"{p}a", f"{p}b", f"{p}no")


def judge(pages: DataFrame, listed: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and listed of every row: the longest rule's verdict, else block if host
    and path together are one of the keys in the column `key` of `listed`, else allow.

    A null url, or one without "://", has an empty host and path and is judged like any other. Repeated rows and
    null identifiers are kept; other columns are ignored; an empty table gives none.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    text, allow = rule_columns(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": text, "allowed": allow})
    rows = mark_listed(rows, F.concat("host", "path"), listed, F.col("key"))
    verdict = F.when(F.coalesce("allowed", ~F.col("listed")), "allow").otherwise("block")
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the verdict on every page. The tables bring no list, so the listed keys are those of the pages on
    mobile mirrors (hosts that start with "m."), given key by key as a list would."""
    pages = read(spark, sf_dir, "pages")
    host, path = host_and_path(F.col("url"))
    listed = pages.select(host.alias("host"), path.alias("path")).where(F.col("host").startswith("m.")).select(F.concat("host", "path").alias("key"))
    return judge(pages, listed, RULES)


ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '\A[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(h, p, ok) AS (VALUES ('com', '/', true), ('example.com', '/en/', false), ('www.example.com', '/en/', true), ('net', '/es/', false), ('net', '/fr/', false)),
fit AS (
  SELECT p.page_id, p.host, p.path, rules.h || rules.p AS rule, rules.ok,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rules.h || rules.p) DESC) AS n
  FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN rules ON (p.host = rules.h OR ends_with(p.host, '.' || rules.h)) AND starts_with(p.path, rules.p))
SELECT p.page_id, p.host, p.path, fit.rule, CASE WHEN coalesce(fit.ok, NOT starts_with(p.host, 'm.')) THEN 'allow' ELSE 'block' END AS verdict,
       starts_with(p.host, 'm.') AS listed
FROM p LEFT JOIN fit ON fit.n = 1 AND p.page_id IS NOT DISTINCT FROM fit.page_id AND p.host = fit.host AND p.path = fit.path
"""
