"""Operators against brute force, and on odd tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import decontaminate, fm, mixing, rules, secrets, simhash, sstable, suffix_dedup, tool_calls, url_filter
from tallyloom.llm.common import components
from tallyloom.llm.text_stats import document_stats

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
WORDS = [f"{a}{b}" for a in "ba be bi bo bu da de di do du".split() for b in "n r s t l".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def odd_rows():
    rng = random.Random(4)
    base = prose(rng, 80)
    rows = [(1, base, "en", "a", 1), (2, base, "en", "a", 1), (2, base, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "b", 0), (None, "no id here at all", "en", "b", 3), (5, " \n\t ", "de", "b", 4)]
    rows += [(6, "É" * 40 + " " + prose(rng, 30_000), "fr", "c", 9), (7, base.upper(), "en", "a", 1), (8, "one", "en", "a", 3), (9, "one two", "en", None, 7), (10, base + " more", "en", "c", 2), (10, prose(rng, 30), "en", "c", 2)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    clash = ["fp", "row", "bucket", "size", "h", "span", "component_id", "stay_id", "mix_at", "stat_n_words", "listed", "a", "b"]
    df = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    return df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(clash)])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (1, 0, 0)], LABELS)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 3), (7, 5), (5, 7)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1


def test_url_filter(spark, monkeypatch):
    urls = ["http://A.com/x?y", "https://www.Example.com/en/1", "http://example.com/en/", "http://x.net/es/#a", "http://m.net/fr", "nothing", None, "http://m.org/p", "http://m.org/p", "x://", "http://É.org/q", "http://org"]
    pages = spark.createDataFrame([(i if i != 9 else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("m.org/p",), ("m.net/fr",), (None,), ("absent/z",), ("m.org/p",)], "key string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, listed, url_filter.RULES).collect()}
    assert got == {
        (0, "a.com", "/x", "com/", "allow"), (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "example.com", "/en/", "example.com/en/", "block"), (3, "x.net", "/es/", "net/es/", "block"), (4, "m.net", "/fr", None, "block"), (5, "", "", None, "allow"),
        (6, "", "", None, "allow"), (7, "m.org", "/p", None, "block"), (8, "m.org", "/p", None, "block"), (None, "", "", None, "allow"), (10, "É.org", "/q", None, "allow"), (11, "org", "", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), listed, url_filter.RULES).count() == 0
    # big levels are built by tasks, and a list above the bound is used in shards
    keys = spark.range(6000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    some = keys.where("crc32(key) % 5 = 0")
    keys = keys.unionByName(keys.limit(1).crossJoin(spark.range(2000).select()))  # one key with a quarter of the rows
    keys = keys.unionByName(spark.createDataFrame([(None,)], "key string")).select("key", F.lit("x").alias("key_a"), F.lit("y").alias("listed"))
    for shard_keys in (1_000_000, 500):
        monkeypatch.setattr(url_filter, "KEYS_A_SHARD", shard_keys)
        for bound in (1 << 20, 100):
            marked = url_filter.mark_listed(keys, F.col("key"), some, F.col("key"), bound)
            assert marked.where("listed <> coalesce(crc32(key) % 5 = 0, false)").count() == 0 and marked.count() == 8001 and marked.columns == ["key", "key_a", "listed"]
    assert not url_filter.mark_listed(keys, F.col("key"), some.limit(0), F.col("key")).where("listed").count()


# --- 2


def test_secrets(spark, odd, empty):
    long_hex = "0123456789abcdef" * 2
    texts = ['password = "abcdefgh"', "PassWord:short", "api_key='A/b+c=d.e-f_g'", "token=secret=abcdefgh1", "AKIA" + "A" * 12 + " AKIA123", "x" + long_hex + "g", "é token: " + "z" * 9, "pſſword=abcdefgh", "passphrase: xK9$mQ2!vLp7", "pwd: password1", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in secrets.scan(df).collect()}
    for i, t in enumerate(texts):
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "") if len(m[2]) >= 8]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 16]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 32]
        assert [s for s in got[i] if s[2] != "guess"] == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[2])))
    # the value of a base span is scored too, and a costly one is a span of its own
    assert got[2] == [(0, 22, "assign"), (9, 22, "guess")] and got[0] == [(0, 20, "assign")]
    scored = {r["doc_id"]: [(v["start"], v["end"], round(v["cost"], 3), v["cut"]) for v in r["scored"]] for r in secrets.scan(df).collect()}
    assert scored[0] == [(12, 20, 2.505, "walk:12:20")] and scored[3] == [(6, 22, 6.965, "word:6:12 brute:12:13 walk:13:21 brute:21:22")] and scored[11] == []
    assert [s[2] for s in got[8]] == ["guess"] and texts[8][slice(*got[8][0][:2])] == "xK9$mQ2!vLp7" and got[9] == []
    assert got[3] == [(0, 22, "assign")] and secrets.redact(texts[0], got[0]) == "[assign]\""
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0


def test_guess_cost_is_the_least():
    model = secrets.GuessCost(["pass", "word", "password"])
    for value in ["password", "passpass1", "a1b2c3", "qwerty12", "20190504xx", "aaaaab", "P4ssword"]:
        parts = {}
        for a, b, cost, _ in model.segments(value):
            parts[a, b] = min(cost, parts.get((a, b), 99))
        best = [0.0] + [99.0] * len(value)
        for end in range(1, len(value) + 1):
            for start in range(end):
                brute = sum(map(secrets._brute, value[start:end]))
                best[end] = min(best[end], best[start] + (secrets.JOINT if start else 0) + min(brute, parts.get((start, end), 99)))
        cost, cut = model.best(value)
        assert cost == pytest.approx(best[-1]) and cut[0][0] == 0 and cut[-1][1] == len(value)


def test_guess_cost_takes_any_part_of_a_run():
    """Walks and repeats by the definition: every span is looked at, whatever run it is part of."""
    model, rng = secrets.GuessCost(), random.Random(9)
    near = {p for row in secrets.ROWS for a, b in zip(row, row[1:]) for p in ((a, b), (b, a))}
    values = ["monkeyuiop12", "xaaaaaab", "abababa1", "9876passw0rd", "aaa" * 15, "qwerty" * 9, "abcdefghijklmnopqrstuvwxyzyxwvutsrqponmlkjihgfedcbapassword"]
    for value in values + ["".join(rng.choice("aab1qwe2") for _ in range(24)) for _ in range(60)]:
        n, low = len(value), value.lower()
        parts = {(a, b): sum(map(secrets._brute, value[a:b])) for a in range(n) for b in range(a + 1, n + 1)}
        found = [(a, b, cost) for a, b, cost, _ in model.fixed(value)]
        for a, b in parts:
            if b - a >= 3 and all((x, y) in near for x, y in zip(low[a:b], low[a + 1 : b])):
                found.append((a, b, np.log10(40 * (b - a))))
            for unit in range(1, 9):
                if b - a >= max(3, 2 * unit) and value[a : b - unit] == value[a + unit : b]:
                    found.append((a, b, sum(map(secrets._brute, value[a : a + unit])) + np.log10((b - a) / unit + 1)))
        for a, b, cost in found:
            parts[a, b] = min(parts[a, b], cost)
        least = [0.0]
        for b in range(1, n + 1):
            least.append(min(least[a] + (secrets.JOINT if a else 0) + parts[a, b] for a in range(b)))
        assert model.best(value)[0] == pytest.approx(least[-1])
    assert model.best("monkeyuiop12")[0] < 6 and secrets.scan_text(b"pwd: monkeyuiop12", model)[1][0].cost < 6


def test_every_value_of_a_table_is_scored(spark):
    """Costs of the query on real rows against a programme that looks at every span of a value by definition."""
    words = secrets.WORDS + secrets.vocabulary_words(TOKENIZER)
    rank, near = {}, {p for row in secrets.ROWS for a, b in zip(row, row[1:]) for p in ((a, b), (b, a))}
    for i, w in enumerate(words):
        rank.setdefault(w, i)
    brute = lambda t: sum(1.0 if c.isdigit() else np.log10(26) if c.isalpha() else np.log10(33) for c in t)

    def span_cost(t):
        found, low = [brute(t)], t.lower()
        for text, extra in ((low, 0.0), (low.translate(secrets.LEET), 0.5)):
            if len(t) > 1 and text in rank:
                upper = sum(map(str.isupper, t))
                found.append(np.log10(rank[text] + 2) + extra + (0 if not upper else 0.3 if upper == len(t) or (upper == 1 and t[0].isupper()) else 0.3 * upper))
                break
        found += [np.log10(366 * 120)] if (m := secrets.DATE.match(t)) and m.end() == len(t) else []
        found += [np.log10(120)] if re.fullmatch(r"(?:19|20)\d\d", t) else []
        found += [np.log10(40 * len(t))] if len(t) >= 3 and all(p in near for p in zip(low, low[1:])) else []
        found += [brute(t[:u]) + np.log10(len(t) / u + 1) for u in range(1, 9) if len(t) >= max(3, 2 * u) and t[:-u] == t[u:]]
        return min(found)

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()}
    rows = [(r["doc_id"], c.split(":", 3)) for r in secrets.query(spark, "/root/testdata/sf0.01").where("n_scored > 0").collect() for c in r["costs"].split(",")]
    assert len(rows) >= 10
    for doc, (a, b, cost, _) in rows:
        value, least = docs[doc][int(a) : int(b)], [0.0]
        for end in range(1, len(value) + 1):
            least.append(min(least[k] + (secrets.JOINT if k else 0) + span_cost(value[k:end]) for k in range(end)))
        assert float(cost) == pytest.approx(least[-1], abs=1e-5)


# --- 3


def test_mixing(spark, odd, empty):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count()
    by, size = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in got:
        by.setdefault(r["source"], []).append(r)
    totals = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    assert sum(totals.values()) == sum(size(r[1]) for r in odd_rows())
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(totals.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= 2 * totals[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
            open_.remove(s)
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(target[s]) and rs[0]["source_size"] == totals[s]
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= max(r["size"] for r in rs) / 2 + 1
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and all(0 <= p <= 1 for p in r["positions"]) for r in rs)
    assert mixing.mix(empty).count() == 0 and mixing.curriculum(empty).count() == 0
    rows = mixing.curriculum(odd)
    assert rows.columns == odd.columns and rows.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == sum(r["taken"] for r in got)


def test_time_of_inverts_the_schedule(spark):
    for r0, r1 in mixing.SCHEDULE:
        t = spark.range(1).select(*[mixing.time_of(F.lit(x), F.lit(r0), F.lit(r1)).alias(f"t{i}") for i, x in enumerate((0.0, 0.25, 0.9, 1.0))]).first()
        for x, at in zip((0.0, 0.25, 0.9, 1.0), t, strict=True):
            assert (r0 * at + (r1 - r0) * at * at / 2) / ((r0 + r1) / 2) == pytest.approx(x)


# --- 4


def slow_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hs) > len(hs)) << b for b in range(64))


def test_simhash(spark, odd, empty):
    short = [r for r in odd_rows() if not r[1] or len(r[1]) < 5000]
    for r in short:
        assert simhash.simhash(None if r[1] is None else r[1].encode()) == slow_simhash(r[1])
    assert spark.range(1).select(F.xxhash64(F.lit("a é b"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a é b".encode(), 42)
    got = simhash.near_duplicates(odd)
    assert got.count() == odd.count() and got.where("fp = 0").select("component_id").distinct().count() == 1
    assert simhash.near_duplicates(empty).count() == 0


def test_edited_copies_go(spark, odd, empty):
    """The groups that stay are those of comparing all pairs of whole 5-word shingle sets at 0.8."""
    rng = random.Random(6)
    rows = []
    for _ in range(12):  # chains and stars of edited copies, a word or more at a time
        words = prose(rng, rng.randrange(60, 400)).split()
        for _ in range(8):
            rows.append(" ".join(words))
            edited = list(words)
            for _ in range(max(1, len(words) // 60)):
                edited[rng.randrange(len(words))] = rng.choice(WORDS) + "x"
            words = edited if rng.random() < 0.6 else words
    rows += [prose(rng, 60) for _ in range(20)] + ["a b c", "A b  c", "a b d", None, "", " "]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((r or "").lower().split() for r in rows)]
    root = list(range(len(rows)))
    exact = len({frozenset(s) for s in sets})
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    least = {r: min(i for i, q in enumerate(root) if q == r) for r in root}
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(rows)], DOCS).repartition(5)
    assert len(least) < exact - 20
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == sorted(least.values())
    stay = corpus_pipeline.simhash_near_dedup(spark, odd, "")
    assert stay.columns == odd.columns and sorted(str(r["doc_id"]) for r in stay.collect()) == ["1", "10", "3", "6", "8", "9", "None"]
    assert corpus_pipeline.simhash_near_dedup(spark, empty, "").count() == 0


@pytest.mark.parametrize("paired", [1000, 4])
def test_links_lose_nothing(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "MOST_PAIRED", paired)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    seed = rng.getrandbits(64)
    for _ in range(60):  # a crowd that shares one half
        fps.add(seed ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)))
    fps |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(fps)[:20]}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    pairs = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}
    found = {(r["a"], r["b"]) for r in simhash.links(df).collect()}
    assert found <= pairs
    if paired == 1000:
        assert found == pairs
    root = lambda edges: {r["node"]: r["root"] for r in components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert root(found) == root(pairs)


# --- 5


def test_factorisation_machine(spark, odd, empty, labels):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(rng, 60) if not bad else " ".join(w.upper() + "!!" for w in prose(rng, 12).split()) * 3, "en", "s", 0))
        marks.append((i, int(not bad), 0))
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, LABELS)
    got = fm.classify(df, lab).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 50 and np.mean([r["predicted"] == marks[r["doc_id"]][1] for r in held]) > 0.95
    # the identity against all pairs
    docs = [fm.features(r[1].encode()) for r in rows[:6]]
    model = fm.train(docs, np.array([m[1] for m in marks[:6]], float), epochs=2)
    index, value, starts = model.rows(docs)
    margin, _ = model.margin(index, value, starts)
    for k in range(2):
        i, x = index[starts[k] : starts[k + 1]], value[starts[k] : starts[k + 1]]
        pairs = sum(model.v[i[p]] @ model.v[i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p + 1, len(i)))
        assert margin[k] == pytest.approx(model.w0 + model.w[i] @ x + pairs)
    assert fm.classify(odd, labels).count() == odd.count() and fm.classify(empty, labels).count() == 0
    assert {r["score"] for r in fm.classify(odd, labels.limit(0)).collect()} == {0.5}
    # a thousand texts under one labelled identifier are one row of the sample
    crowd = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows, marks = fm.training_rows(crowd.unionByName(df.select("doc_id", "text").where("doc_id <> 7")), lab, most=50)
    assert len(rows) == len(marks) <= 50


def test_held_out_quality(spark):
    """Scores and rules against the labels that neither has seen."""
    at = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{at}/labels.parquet").where(rules.held_out(F.col("doc_id"))).select("doc_id", "quality")
    rows = fm.query(spark, at).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert len(good) > 50 and len(bad) > 5 and np.mean([[g > b for b in bad] for g in good]) > 0.95
    kept = rules.query(spark, at).join(labels, "doc_id").select("kept", "quality").collect()
    assert np.mean([r["kept"] for r in kept if r["quality"] == 1]) > 0.9 and np.mean([r["kept"] for r in kept if r["quality"] == 0]) < 0.2


# --- 6


def test_tool_calls(spark):
    tools = [tool_calls.Tool("f", {"n": "integer", "s": "string"}, ("n",))]
    call = lambda i, a='{"n":1}', after=None, seq=0, name="f", conv=1: (conv, i, seq, name, a, after)
    calls = [call("a"), call("b", after="a", seq=1), call("c", after="b", seq=2), call("c", seq=9), call("x", after="y"), call("y", after="x"), call("z", after="y"), call("d", "[1]"), call("e", "{"), call("g", '{"s":"t"}'), call("h", '{"n":1,"q":2}'), call("i", '{"s":1, "n":2}'), call("j", name="none"), call(None), call("k", None), call("l", after="gone"), call("a", conv=2)]
    results = [(1, "a", 5, "ra"), (1, "b", 0, "rb"), (1, "q", 1, "rq"), (1, None, 1, "r0"), (1, "a", 6, "again"), (1, "l", 9, None), (1, "x", 9, "rx")]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, seq long, name string, arguments string, after_id string").withColumn("depth", F.lit(0))
    r = spark.createDataFrame(results, "conv_id long, call_id string, seq long, content string")
    got = {(x["conv_id"], x["kind"], x["call_id"], x["seq"]): (x["depth"], x["error"]) for x in tool_calls.link(c, r, tools).collect()}
    want = {
        ("call", "a", 0): (1, None), ("call", "b", 1): (2, None), ("call", "c", 2): (3, "unanswered"), ("call", "c", 9): (None, "duplicate_id"), ("call", "x", 0): (None, "circle"), ("call", "y", 0): (None, "circle"), ("call", "z", 0): (None, "circle"), ("call", "d", 0): (1, "not_an_object"), ("call", "e", 0): (1, "not_an_object"),
        ("call", "g", 0): (1, "missing:n"), ("call", "h", 0): (1, "unknown:q"), ("call", "i", 0): (1, "type:s"), ("call", "j", 0): (1, "unknown_tool"), ("call", None, 0): (None, "null_id"), ("call", "k", 0): (1, "not_an_object"), ("call", "l", 0): (1, None),
        ("result", "a", 5): (1, None), ("result", "b", 0): (2, "early"), ("result", "q", 1): (None, "orphan"), ("result", None, 1): (None, "null_id"), ("result", "a", 6): (None, "duplicate_id"), ("result", "l", 9): (1, None), ("result", "x", 9): (None, "circle"),
    }
    assert {k[1:]: v for k, v in got.items() if k[0] == 1} == want and got[2, "call", "a", 0] == (1, "unanswered")
    json = {(x["call_id"], x["seq"]): x["json"] for x in tool_calls.link(c, r, tools).where("kind = 'call' and conv_id = 1").collect()}
    assert json["i", 0] == '{"arguments":"{\\"n\\":2,\\"s\\":1}","id":"i","name":"f","type":"call"}'
    assert tool_calls.link(c.limit(0), r.limit(0), tools).count() == 0


def test_schemas(spark):
    """Enums, bounds, nested objects, items of arrays, and names with dots, blanks and quotes."""
    schema = {"a.b": "integer", "x y": "string", "it's": "boolean", "e": {"type": "string", "enum": ["u", "é"]}, "n": {"type": "number", "minimum": 1, "maximum": 2.5}, "l": {"type": "array", "items": {"type": "integer", "minimum": 0}}, "o": {"type": "object", "properties": {"p": {"type": "object", "properties": {"q": "string"}}}, "required": ["p"]}}
    cases = {
        '{"a.b":1,"x y":"s","it\'s":true,"e":"é","n":2.5,"l":[1,2],"o":{"p":{"q":"r"}}}': None, '{"a.b":"1"}': "type:a.b", '{"a":{"b":1}}': "unknown:a", '{"x y":1}': "type:x y", '{"it\'s":0}': "type:it's", '{"e":"w"}': "enum:e", '{"n":0.5}': "minimum:n", '{"n":3}': "maximum:n", '{"n":"3"}': "type:n",
        '{"l":[1,"2",-1]}': "type:l[]", '{"l":[1,-1,"2"]}': "minimum:l[]", '{"l":[]}': None, '{"l":{}}': "type:l", '{"o":{}}': "missing:o.p", '{"o":{"p":{},"z":1}}': "unknown:o.z", '{"o":{"p":{"q":1}}}': "type:o.p.q", '{"o":{"p":1}}': "type:o.p", '{"e":null}': "type:e", "{}": None,
    }
    df = spark.createDataFrame([("t", a) for a in cases], "name string, arguments string")
    got = {r["arguments"]: r["e"] for r in df.select("arguments", tool_calls.argument_error(F.col("name"), F.col("arguments"), [tool_calls.Tool("t", schema)]).alias("e")).collect()}
    assert got == cases
    with pytest.raises(ValueError):
        tool_calls.argument_error(F.col("name"), F.col("arguments"), [tool_calls.Tool("t", {"a'\"": "string"})])


def test_long_chains(spark):
    """Depths along one chain of a conversation beside short ones, a circle, and columns with the names of helpers."""
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(70)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "b"), (3, "a", None)]
    calls = spark.createDataFrame([(v, i, 0, "f", "{}", a) for v, i, a in rows], "conv_id long, call_id string, seq long, name string, arguments string, after_id string").select("*", *[F.lit("x").alias(c) for c in ("h", "called", "depth", "call_h", "result_seq", "known", "ptr")])
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in tool_calls.link(calls, calls.selectExpr("conv_id", "call_id", "seq", "'r' content", "'x' h").limit(0), [tool_calls.Tool("f")]).collect()}
    assert got == {(1, f"c{i}"): i + 1 for i in range(70)} | {(2, x): None for x in "abc"} | {(3, "a"): 1}


def test_a_null_role_is_a_call(spark, tmp_path):
    rows = [("c", 0, None, "who?"), ("c", 1, "assistant", "me"), ("c", 2, "user", "why?")]
    spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r["seq"], r["kind"], r["call_id"], r["depth"], r["error"]) for r in tool_calls.query(spark, str(tmp_path)).collect())
    assert got == [(0, "call", "c0", 1, "unknown_tool"), (1, "result", "c0", 1, None), (2, "call", "c2", 2, "unanswered")]


def test_messages_with_calls(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":"{}"},{"id":"b","name":"f","arguments":"{}","after":"a"}]}'), (1, 2, "tool", '{"tool_call_id":"a","content":"x"}'), (1, 3, "assistant", "text"), (1, 4, "assistant", None)]
    calls, results = tool_calls.parse_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r["call_id"] for r in calls.orderBy("seq").collect()] == ["a", "b"] and results.where("call_id = 'a'").first()["content"] == "x"


# --- 7


def compare_repeats(df, **options):
    rows = [(r["doc_id"], None if r["text"] is None else r["text"].encode()) for r in df.select("doc_id", "text").collect()]
    want = sorted(((i, *x) for (i, _), x in zip(rows, suffix_dedup.brute_force([t for _, t in rows]), strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove_repeats(df, **options).collect()), key=repr)
    assert got == want
    return sum(r[2] for r in got)


def test_repeats(spark, odd, empty):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q, z = text(700), text(199), text(200)
    texts = ["a" * 1000, "a" * 150, "ab" * 400, None, "", p, text(50) + p[100:500] + text(90), text(300) + q + text(10), text(3) + q, z + "x" + z, "é" * 300, text(100) + z[:199] + "~" + z, p[:300] + "#" + p[301:], p[:300] + "@" + p[301:], text(400) * 2, "x" * 5000 + text(30) + "x" * 300]
    texts += [p[: rng.randrange(700)] + text(20) + p[rng.randrange(700) :] for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    # buckets of a few bytes are halved down to single windows
    assert compare_repeats(df) > 0 and compare_repeats(df, bucket_bytes=500) > 0 and compare_repeats(df, bucket_bytes=1500) > 0
    assert compare_repeats(odd) > 0
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_a_text_longer_than_a_chunk(monkeypatch):
    rng = np.random.default_rng(2)
    raw = bytes(rng.integers(97, 100, 3000, dtype=np.uint8))
    whole = suffix_dedup.anchors(raw)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    cut = suffix_dedup.anchors(raw)
    starts = lambda a: sorted((int(b), s, int(p) - s) for b, p, f, l in zip(*a, strict=True) for s in range(f, l + 1))  # noqa: E731, E741
    assert starts(whole) == starts(cut) and len(starts(cut)) == 2801


# --- 8


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    items = [prose(rng, n) for n in (15, 30, 31, 60, 3, 5)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(98, None, ""), (99, " .. ", "")], "item_id long, text string, doc_id string")
    words = items[3].split()
    edit = " ".join(words[:30] + ["changed"] + words[31:])
    half = " ".join(words[:30])
    texts = [prose(rng, 100) + " " + items[0].upper() + " " + prose(rng, 50), items[1], edit, half, prose(rng, 400), "** " + " ** ".join(items[4].split()) + " **", None, "", prose(rng, 20) + " " + items[5] + "!", items[2].replace(" ", "\n\n")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(df, bench).collect()}
    norm = [decontaminate.normal_words(t.encode()) for t in items]
    want = {}
    for d, t in enumerate(texts):
        w = decontaminate.normal_words((t or "").encode())
        for i, item in enumerate(norm):
            n, width = min(len(item), len(w)), min(5, len(item))
            if len(w) >= width:
                best = max(decontaminate.weighted_similarity(decontaminate.shingle_hashes(w[s : s + n], width), decontaminate.shingle_hashes(item)) for s in range(len(w) - n + 1))
                if best >= 0.8:
                    want[d, i] = best
    assert got == pytest.approx(want) and {(0, 0), (1, 1), (2, 3), (5, 4), (8, 5), (9, 2)} <= set(got) and (3, 3) not in got
    assert got == {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.leaks(df, bench, items_a_pass=2).collect()}
    clean = decontaminate.clean(odd, bench)
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0 and decontaminate.clean(df, bench).count() == len(texts) - len({d for d, _ in want})


def test_lookup_finds_all_within_radius():
    rng = np.random.default_rng(5)
    index = decontaminate.ItemIndex([(i, " ".join(f"w{rng.integers(9)}" for _ in range(12)).encode()) for i in range(50)])
    at, items, _ = index.by_size[12]
    far = lambda n: np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for _ in range(len(items))], np.uint64)
    fps = np.concatenate([items, rng.integers(0, 2**63, 200, dtype=np.uint64), *(items ^ far(n) for n in range(1, 20)), *(items ^ far(15) for _ in range(40))])
    near = {(w, int(at[i])) for w in range(len(fps)) for i in range(len(items)) if int(fps[w] ^ items[i]).bit_count() <= decontaminate.RADIUS}
    assert set(index.lookup(12, fps)) == near and len(near) > 50 * 50


def test_recall_of_edited_items():
    """Items with as many words changed as similarity 0.8 allows: the fingerprints' radius keeps 0.9 of them or more."""
    rng = random.Random(12)
    items = [prose(rng, rng.choice([15, 25, 40, 60])) for _ in range(400)]
    index = decontaminate.ItemIndex([(i, t.encode()) for i, t in enumerate(items)])
    held = found = 0
    for i, t in enumerate(items):
        words = decontaminate.normal_words(t.encode())
        edited = list(words)
        for _ in range(6):  # ends and neighbours, so that a change costs few shingles
            edited[rng.choice([0, 1, -1, -2, rng.randrange(len(edited))])] = rng.choice(WORDS).encode() + b"q"
            similar = decontaminate.weighted_similarity(decontaminate.shingle_hashes(edited), decontaminate.shingle_hashes(words))
            if similar < 0.8:
                break
            held += 1
            found += any(index.ids[k] == i for k, _, _ in index.find(b"x y z " + b" ".join(edited) + b" z y x"))
    assert held > 300 and found >= 0.95 * held


# --- 9


def test_shards(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    more = spark.createDataFrame([(-5, "Don't <|endoftext|> İstanbul ΑΣ 中文 ½² 'S nbsp\x85z a\u0301 🙂"), (2**62, "K ſ ß ÿ Ÿ\x7f a\xadb l'Été")], "doc_id long, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    manifest = sstable.write_shards(df, TOKENIZER, out=str(tmp_path / "out"), shards=3)
    got = [tuple(r) for r in sstable.read_shards(manifest).orderBy("start").collect()]
    rows = sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63) % 2**64 if r[1] is not None else 42 + 2**63))
    want, at = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    found = {i: [] for i in (2, 10, None, -5, 77)}
    for r in manifest.orderBy("shard").collect():
        reader = sstable.ShardReader(r["path"])
        for i in found:
            found[i] += [x.tolist() for x in reader.lookup(i)]
        reader.close()
    assert {i: [len(x) for x in v] for i, v in found.items()} == {i: [n for j, _, n, _ in want if j == i] for i in found}
    assert sstable.read_shards(sstable.write_shards(empty, TOKENIZER)).count() == 0


def test_the_mix_order_is_in_the_shards(spark, odd, empty, tmp_path):
    mixed = mixing.curriculum(odd.withColumns({"text": F.col("text"), "mix_id": F.lit("x")}))
    order = [r["doc_id"] for r in mixed.collect()]
    assert len(order) > 5 and order == [r["doc_id"] for r in mixing.curriculum(odd).collect()]
    mixed.write.parquet(str(tmp_path / "mixed"))
    back = spark.read.parquet(str(tmp_path / "mixed")).repartition(5)
    table = spark.read.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.token_shards(spark, table, "").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == order
    # rows without a file are taken in the order of their partitions
    assert corpus_pipeline.token_shards(spark, back.select("*").sort("doc_id", "text"), "").count() == len(order)
    assert corpus_pipeline.token_shards(spark, empty, "").count() == 0


def test_blocks_and_lookup(tmp_path):
    path = tmp_path / "s.sst"
    with path.open("wb") as sink:
        w = sstable.ShardWriter(sink, 256)
        for i in range(-300, 300):
            w.add(sstable.make_key(i * 7), np.arange(i % 50), i % 2 == 0)
        w.finish()
    r = sstable.ShardReader(str(path))
    assert len(r.index) > 5 and r.entries == 600 and [sstable.key_id(k) for k, _ in r] == [i * 7 for i in range(-300, 300)]
    assert all(r.lookup(i * 7)[0].tolist() == list(range(i % 50)) for i in range(-300, 300)) and not r.lookup(1) and not r.lookup(None)


# --- 10


def slow_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {k for i, w in enumerate(five) if five.count(w) > 1 for k in range(i, i + 5)}
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_statistics():
    rng = random.Random(2)
    texts = [None, "", "a", "é|é #x", "l\nl\n \n \nl x\r\nl", "a b c d e a b c d e f", " ".join(rng.choice("ab") for _ in range(60)), "x\x1cy\x85z\u00a0w"]
    for t in texts:
        assert document_stats(None if t is None else t.encode())[:5] == slow_stats(t)


def test_one_row_for_each_identifier_is_learned_from(spark):
    names = [*rules.BASE, *rules.MORE]
    stats = spark.createDataFrame([(5, *([3] * 13)), (5, *([2] + [9] * 12)), (7, *([1] * 13))], "doc_id long, " + ", ".join(f"{n} long" for n in names))
    x, bad = rules.labelled_sample(stats, spark.createDataFrame([(5, 0), (7, 1), (5, 1)], "doc_id long, quality int"))
    assert x["n_words"].tolist() in ([2.0, 1.0], [2.0], [1.0]) and len(bad) == len(x["n_words"])


def test_rules(spark, odd, empty, labels):
    rng = np.random.default_rng(1)
    x = {"u": rng.random(2000), "v": rng.random(2000), "w": rng.random(2000)}
    bad = (x["u"] > 0.9) | ((x["v"] < 0.2) & (x["w"] > 0.7))
    found = rules.learn(x, bad)
    hit = np.zeros(2000, bool)
    for r in found:
        hit |= r.holds(x)
    assert (hit & bad).sum() > 0.95 * bad.sum() and (hit & ~bad).sum() < 0.02 * (~bad).sum()
    assert rules.learn(x, np.zeros(2000, bool)) == [] and rules.learn({k: v[:0] for k, v in x.items()}, bad[:0]) == []
    # the expression says what the rules say
    df = spark.createDataFrame([tuple(float(x[k][i]) for k in "uvw") for i in range(200)], "u double, v double, w double")
    got = [r[0] for r in df.select(rules.verdict(found, {k: F.col(k) for k in "uvw"})).collect()]
    assert [g is not None for g in got] == hit[:200].tolist()
    judged, _ = rules.judge(odd, labels)
    for r in judged.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and (not r["base_failed"] or not r["kept"])
    kept = rules.kept_rows(odd, labels)
    assert kept.columns == odd.columns and kept.count() == judged.where("kept").count()
    assert rules.judge(empty, labels)[0].count() == 0 and rules.kept_rows(empty, labels.limit(0)).count() == 0
