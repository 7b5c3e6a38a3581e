"""The bit-sliced index, the wavelet trees and the prefix trie against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import bit_sliced, prefix_trie, wavelet

VECTORS = "vec_id long, embedding array<float>"
DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def ask(spark, rows, k=5, block_rows=64, every=5):
    df = spark.createDataFrame(rows, VECTORS).repartition(3).select("*", F.lit("x").alias("q"), F.lit(1).alias("block"), F.lit(2).alias("batch"))
    kept = bit_sliced.usable(df)
    found = bit_sliced.search(bit_sliced.build(kept, block_rows), kept.where(F.col("vec_id") % every == 0), k)
    return sorted(tuple(r) for r in found.collect())


def best_by_hand(rows, k=5, every=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in sorted((r for r in ok if r[0] is not None and r[0] % every == 0), key=lambda r: r[1], reverse=True):
        queries[i] = v
    out = []
    for i, v in queries.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), w_id is None, w_id or 0) for w_id, w in ok if w_id != i))
        out += [(i, n, None if null else w_id, -s) for n, (s, null, w_id) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_bit_sliced(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(9)]) for i in range(200)]
    assert ask(spark, rows) == best_by_hand(rows)
    assert ask(spark, rows, block_rows=1000) == best_by_hand(rows)


def test_bit_sliced_odd(spark):
    rng = random.Random(2)
    same = [0.5, -0.25, 0.0, 1.0]
    rows = [(i, same) for i in range(150)] + [(i, [rng.uniform(-3, 3) for _ in range(4)]) for i in range(200, 260)]
    rows += [(300, None), (305, [1.0, None, 0.0, 0.0]), (310, [float("nan"), 0.0, 0.0, 0.0]), (315, [float("inf"), 0.0, 0.0, 0.0]), (None, same), (None, [9.0, -9.0, 9.0, 9.0]), (320, []), (325, [2.0, -1.0]), (330, [70000.0, 1e9, -1e9, 3.0]), (-5, [0.1] * 4), (201, same), (201, same), (205, [0.0] * 4)]
    assert ask(spark, rows) == best_by_hand(rows)
    few = [(5, [1.0]), (6, [0.5]), (7, [-0.001])]
    assert ask(spark, few) == [(5, 1, 6, 256 * 128), (5, 2, 7, -256)]
    assert ask(spark, []) == [] and ask(spark, [(3, [1.0])]) == [] and ask(spark, [(5, [1.0])]) == []
    assert ask(spark, [(5, [3e38, 3e38]), (6, [3e38, 3e38])]) == [(5, 1, 6, (1 << 63) - 1)]


def test_signed_digits_and_sums():
    rng = np.random.default_rng(3)
    for c in [0, 1, -1, 7, -7, 255, -256, 12345]:
        digits = bit_sliced.signed_digits(c)
        assert sum(s << p for p, s in digits) == c and all(b[0] - a[0] > 1 for a, b in zip(digits, digits[1:], strict=False))
    q = rng.integers(-50, 90, (130, 3))
    low, bits, slices = bit_sliced.slice_block(q)
    block = bit_sliced.Block(130, np.concatenate([np.arange(130), np.zeros(130, np.int64)]).tobytes(), low.tolist(), bits.tolist(), slices.tobytes())
    want = q @ np.array([3, -11, 0])
    assert block.top(-1, [3, -11, 0], 130) == block.top(-1, [3, -11], 130) and sorted(block.top(-1, [3, -11, 0], 130)) == [(i, int(s)) for i, s in enumerate(want)]


def rank_by_hand(docs, items, k=10):
    fold = lambda t: re.findall(wavelet.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(fold(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    N, L, df = len(bags), sum(sum(c.values()) for _, c in bags), Counter(t for _, c in bags for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for d, c in bags:
            m = 25 + (75 * sum(c.values()) * N) // L
            s = sum(n * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in Counter(fold(text)).items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item_id, n, None if null else d, -s) for n, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def rank(spark, docs, items, most=wavelet.PASS_ITEMS, shard_postings=wavelet.SHARD_POSTINGS):
    df = spark.createDataFrame(docs, DOCS).repartition(2).select("*", F.lit(1).alias("docs"), F.lit(2).alias("terms"), F.lit("y").alias("no"))
    index, n = wavelet.build(df, shard_postings=shard_postings)
    return sorted((tuple(r) for r in wavelet.search(index, n, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()), key=repr)


WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di do du éa".split() for b in "n r s t l Ü".split()]


@pytest.mark.parametrize("shard_postings", [40, 900, 1 << 20])
def test_wavelet(spark, shard_postings):
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices(WORDS, weights=range(1, len(WORDS) + 1), k=rng.randrange(0, 60)))) for i in range(250)]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 12)))) for i in range(20)]
    assert rank(spark, docs, items, shard_postings=shard_postings) == rank_by_hand(docs, items)


def test_wavelet_odd(spark):
    rng = random.Random(6)
    copy = "Ban bon, dar-dar! der"
    docs = [(i, copy) for i in range(100, 160)] + [(7, None), (8, ""), (9, " ,;\n"), (None, copy), (None, "ban"), (10, "ban"), (10, "ban"), (11, "BAN ban"), (12, "É ban_bon"), (13, " ".join(rng.choices(WORDS, k=40_000))), (-3, copy), (14, "ban" * 5000), (15, "x\x00y 你好 ban")]
    items = [(1, copy), (1, copy), (1, "bon"), (2, None), (3, "--"), (4, "nothinglikeit"), (5, "é É"), (None, "ban ban dar"), (6, "你好 x"), (7, "ban " * 300)]
    want = rank_by_hand(docs, items)
    assert rank(spark, docs, items) == want and rank(spark, docs, items, most=2, shard_postings=50) == want
    assert rank(spark, [], items) == [] and rank(spark, docs, []) == [] and rank(spark, [(1, None)], items) == []
    # a term of every document weighs nothing, so nothing is above 0
    assert rank(spark, [(i, "one") for i in range(4000)], [(1, "one")]) == []


def trie_by_hand(rows):
    turns, rebuilt = defaultdict(list), {}
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(ts)] for c, ts in turns.items()}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    children, out = defaultdict(list), []
    for seq in members:
        if seq:
            children[seq[:-1]].append(seq)
    below = {}
    for seq in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[seq]]
        own = (len(members[seq]) - 1) * (len(seq[-1][1]) if seq else 0)
        below[seq] = (sum(k[0] for k in kids) or 1, own + sum(k[1] for k in kids))
    for seq, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if len(rebuilt[c]) == len(seq)))
        out.append((min(cs), len(seq), min(members[seq[:-1]]) if seq else None, len(cs), len(children[seq]), *below[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def nodes(spark, rows, family_rows=prefix_trie.FAMILY_ROWS):
    df = spark.createDataFrame(rows, TURNS).repartition(3).select("*", F.lit(1).alias("base"), F.lit(1).alias("node"), F.lit(1).alias("depth"), F.lit(1).alias("parts"))
    return sorted(tuple(r) for r in prefix_trie.trie(df, family_rows=family_rows).collect())


@pytest.mark.parametrize("family_rows", [7, 200_000])
def test_trie(spark, monkeypatch, family_rows):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "ccc"])) for c in [*range(0, 130), 399, 400, 20_050, 20_000, -150, -100, -7, 3] for t in range(rng.randrange(1, 9))]
    assert nodes(spark, rows, family_rows) == trie_by_hand(rows)


def test_trie_odd(spark):
    rows = [(c, t, "user", "same") for c in range(1000, 1400) for t in range(3)]  # one conversation, over and over
    rows += [(5000, t, "user", f"turn {t}") for t in range(700)]  # a long one
    rows += [(5001, 0, None, None), (5002, 0, "", ""), (5003, None, "user", "x"), (5003, None, "user", "x"), (5003, 0, "user", "a"), (None, 1, "user", "y"), (7777, 0, "user", "base is absent"), (-1, 0, "a", "b"), (5004, 0, "u\x00", "v" * 200_000)]
    rows += [(6000, t, "user", "t") for t in range(60)] + [(6000 + i, t, "user", "t") for i in range(1, 40) for t in range(i)]  # chains on chains
    assert nodes(spark, rows) == trie_by_hand(rows)
    assert nodes(spark, []) == [] and nodes(spark, [(None, 0, "user", "z")]) == []


def test_trie_in_pieces(spark, monkeypatch):
    """Tasks that give nodes early, and lists of ends in several pieces."""
    monkeypatch.setattr(prefix_trie, "TRIE_NODES", 5)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", f"{t * (c % 4)}") for c in range(300, 380) for t in range(1 + c % 9)]
    df = spark.createDataFrame(rows, TURNS)
    tries = prefix_trie.family_tries(prefix_trie.families(df))
    got = {(r["depth"], r["node"]): r["n"] for r in tries.where("not is_end").groupBy("node", "depth").agg(F.sum("n").alias("n")).collect()}
    assert sum(n for (d, _), n in got.items() if d == 0) == 80
    ends = tries.where("is_end")
    want = defaultdict(list)
    for r in ends.collect():
        want[bytes(r["node"])].append(r["conv_id"])
    want = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
    assert {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie.ends_digest(ends).collect()} == want


def test_the_first_condition_is_the_best_of_all():
    """Every border of every statistic, one by one, against what a rule begins with."""
    from tallyloom.llm import rules

    rng = np.random.default_rng(9)
    for _ in range(20):
        x = {k: np.round(rng.normal(size=80), 1) for k in ("u", "v", "w")}
        bad = (x["u"] + 0.3 * rng.normal(size=80)) > 0.4
        if not bad.any() or bad.all():
            continue
        gains = {}
        for name, values in x.items():
            for border in sorted(set(values))[:-1]:
                for above in (False, True):
                    hit = values > border if above else values <= border
                    p, n = (hit & bad).sum(), hit.sum()
                    gains[name, border, above] = p * (np.log2(p / n) - np.log2(bad.mean())) if p else 0.0
        first = rules._grow(x, bad, 1)[0]
        border = max(v for v in x[first.feature] if v <= first.threshold)
        assert gains[first.feature, border, first.above] == pytest.approx(max(gains.values()))
        whole = rules._grow(x, bad)
        held = rules._covered(whole, x, len(bad))
        assert held.any() and (held & ~bad).sum() == 0


def test_near_copies_meet_by_simhash(spark):
    """Fingerprints within 2 bits link their nodes, equal ones too, whatever the bands say."""
    from tallyloom.llm import near_copies

    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 255), (5, 1 << 40)], "node long, fp long")
    assert {tuple(sorted(r)) for r in near_copies.met(nodes).collect()} == {(1, 2), (1, 3), (1, 5)}
    row = near_copies.sketches(spark.createDataFrame([(1, 2, "a b c d e f")], "doc_id long, key long, text string")).first()
    from tallyloom.llm import simhash

    assert row["fp"] % 2**64 == simhash.simhash(b"a b c d e f", 5)
