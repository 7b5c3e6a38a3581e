"""Secret spans in texts: fixed patterns, and a password guess-cost model for values in a credential's context."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices

# The base patterns and the least length of what each must find.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "guess"]

#: A credential's name, what may stand between it and its value, and the value.
CONTEXT = re.compile(r"""(?ai:\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|signing|auth)[_-]?key|client[_-]?secret|credentials?|bearer|auth(?:orization)?))["']?[\x20\t]{0,8}(?::=|=>|[:=])[\x20\t]{0,8}["'`]?(?ai:bearer\x20)?([^\s"'`,;<>]{6,})""")
HINTS = (b"pass", b"pwd", b"secret", b"token", b"key", b"credential", b"bearer", b"auth")

# Common parts of weak passwords, the most common first; a ranked vocabulary may follow them.
WORDS = """password admin letmein welcome monkey dragon login master qwerty secret test example changeme default
guest root user hello sunshine princess football baseball shadow superman batman trustno freedom whatever starwars
summer winter spring autumn monday friday january love money please access pass token key api my your the sample dummy
placeholder none null true false todo redacted hidden value string here server database system computer internet
service company account public private temp demo prod dev local host""".split()
ROWS = ["qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz", "0123456789"]
LEET = str.maketrans("@4310$5!7", "aaeiosslt")

#: Signs of a repeat's unit at most. It is part of the model: a longer unit takes 10^9 guesses by itself.
MOST_UNIT = 8


def vocabulary_words(path: str) -> list[str]:
    """The whole words of a word-level BPE tokenizer's vocabulary, the most common first: its tokens stand in order of
    merging, and "</w>" ends a word. Words of fewer than three letters, and what isn't a word, are left out."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return [w[:-4] for w in sorted(vocabulary, key=vocabulary.get) if w.endswith("</w>") and len(w) > 6 and w[:-4].isalpha()]


DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d")
YEAR = re.compile(r"(?:19|20)\d\d")
#: log10 of the guesses for a date and a year, and what each further segment adds.
DATE_COST, YEAR_COST, JOINT = math.log10(366 * 120), math.log10(120), 0.3


def _brute(ch: str) -> float:
    return 1.0 if ch.isdigit() else math.log10(26) if ch.isalpha() else math.log10(33)


def _runs(lines: list[str], least: int = 3) -> dict[str, set[str]]:
    """For each sign the ones that may follow it on a walk, forwards and backwards."""
    follow: dict[str, set[str]] = {}
    for row in lines:
        for a, b in zip(row, row[1:], strict=False):
            follow.setdefault(a, set()).add(b)
            follow.setdefault(b, set()).add(a)
    return follow


class GuessCost:
    """log10 of the guesses for a value: the cheapest way to cut it into common words (in any case, with usual
    replacements), dates, years, repeats of a unit of up to MOST_UNIT signs, walks on a keyboard or an alphabet, and
    single signs found by brute force. A word's guesses are its rank in `words`, the first place of several. Time
    grows with the value's length; no value is cut off."""

    def __init__(self, words: list[str] = WORDS, rows: list[str] = ROWS):
        self.cost = {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words))) if len(w) > 1}
        self.longest = max(map(len, self.cost), default=0)
        self.follow = _runs(rows)

    def fixed(self, value: str) -> Iterator[tuple[int, int, float, str]]:
        """Words, dates and years."""
        n, low = len(value), value.lower()
        plain = low.translate(LEET)
        for i in range(n):
            for m in range(2, min(self.longest, n - i) + 1):
                for text, extra in ((low, 0.0), (plain, 0.5)):
                    if (c := self.cost.get(text[i : i + m])) is not None:
                        upper = sum(map(str.isupper, value[i : i + m]))
                        yield i, i + m, c + extra + (0 if not upper else 0.3 if upper in (1, m) and (upper == m or value[i].isupper()) else 0.3 * upper), "word"
                        break
            for rx, cost, kind in ((DATE, DATE_COST, "date"), (YEAR, YEAR_COST, "year")):
                if value[i].isdigit() and (hit := rx.match(value, i)):
                    yield i, hit.end(), cost, kind

    def segments(self, value: str) -> Iterator[tuple[int, int, float, str]]:
        """All segments but brute force: (start, end, cost, kind). Runs have many; best() doesn't list them."""
        yield from self.fixed(value)
        n, low = len(value), value.lower()
        for a in range(n):
            for unit in range(1, MOST_UNIT + 1):
                for b in range(a + unit + 1, n + 1):
                    if value[b - 1] != value[b - 1 - unit]:
                        break
                    if b - a >= max(3, 2 * unit):
                        yield a, b, sum(map(_brute, value[a : a + unit])) + math.log10((b - a) / unit + 1), "repeat"
            for b in range(a + 2, n + 1):
                if low[b - 1] not in self.follow.get(low[b - 2], ()):
                    break
                if b - a >= 3:
                    yield a, b, math.log10(40 * (b - a)), "walk"

    def best(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        """The least cost, and the cut that has it.

        A repeat or a walk may start and end anywhere in its run. Its cost grows with its length ever more slowly, and
        a repeat's unit costs the same at each start of a run: so a start that an earlier one of its run matches can't
        win at a later end, and is left out from there on.
        """
        n, low = len(value), value.lower()
        ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
        for a, b, cost, kind in self.fixed(value):
            ending[b].append((a, cost, kind))
        # brute force extends a span without a joint
        best, brute, how = [0.0] + [math.inf] * n, [math.inf] * (n + 1), [None] * (n + 1)
        from_brute = [0] * (n + 1)
        # of repeats by unit, and of walks at 0: the run's start, and the starts that may still win with their cost
        first, live = [0] * (MOST_UNIT + 1), [[] for _ in range(MOST_UNIT + 1)]
        for i in range(1, n + 1):
            step = _brute(value[i - 1])
            start, longer = best[i - 1] + (JOINT if i > 1 else 0) + step, brute[i - 1] + step
            brute[i], from_brute[i] = (start, i - 1) if start <= longer else (longer, from_brute[i - 1])
            best[i], how[i] = brute[i], (from_brute[i], "brute")
            for a, cost, kind in ending[i]:
                if (c := best[a] + cost + (JOINT if a else 0)) < best[i]:
                    best[i], how[i] = c, (a, kind)
            for unit in range(MOST_UNIT + 1):
                if unit and i > unit and value[i - 1] != value[i - 1 - unit]:
                    first[unit], live[unit] = i - unit, []
                elif not unit and i > 1 and low[i - 1] not in self.follow.get(low[i - 2], ()):
                    first[0], live[0] = i - 1, []
                a = i - max(3, 2 * unit)
                if a < first[unit]:
                    continue
                each = sum(map(_brute, value[a : a + unit])) if unit else math.log10(40)
                live[unit].append((a, best[a] + (JOINT if a else 0) + each))
                least, stay = math.inf, []
                for a, c in live[unit]:
                    if (now := c + math.log10((i - a) / unit + 1 if unit else i - a)) < least:
                        least = now
                        stay.append((a, c))
                live[unit] = stay
                if least < best[i]:
                    best[i], how[i] = least, (stay[-1][0], "repeat" if unit else "walk")
        cut, at = [], n
        while at:
            a, kind = how[at]
            cut.append((a, at, kind))
            at = a
        return best[n], cut[::-1]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass(frozen=True)
class Value:
    """A value in a credential's context: its place in code points, its cost and the cut that has it."""

    start: int
    end: int
    cost: float
    cut: list[tuple[int, int, str]]


def context_values(text: str, model: GuessCost) -> list[Value]:
    """Every value in a credential's context, those of base spans too."""
    return [Value(*m.span(1), *model.best(m[1])) for m in CONTEXT.finditer(text)]


_LONG_HEX = re.compile(rb"[0-9a-f]{32}")


def scan_text(raw: bytes | None, model: GuessCost) -> tuple[list[tuple[int, int, str]], list[Value]]:
    """Base spans and scored values of a whole text, in code points. Bytes are looked at first, as most texts have none."""
    if not raw:
        return [], []
    low = raw.lower()
    hint = any(h in low for h in HINTS) and (b"=" in raw or b":" in raw)
    if not hint and b"AKIA" not in raw and not _LONG_HEX.search(raw):
        return [], []
    text = raw.decode("utf-8", "replace")
    return base_spans(text), context_values(text, model) if hint else []


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 8.0, words: list[str] = WORDS, rows: list[str] = ROWS) -> DataFrame:
    """(doc_id, spans, scored): spans are structs of start, end (code points, end exclusive), kind and cost, by start and
    then kind; scored are the values in a credential's context with their cost (log10 of the guesses) and the cut that
    has it, as kind:start:end of each segment, joined by blanks.

    The spans are the base ones, without a cost, and one of kind "guess" for each scored value that takes 10**least_cost
    guesses or more, also inside a base span. The document's whole text is searched. Null texts count as empty and
    have none. Each row is judged alone: repeated rows give repeated results, null identifiers are kept. Other columns
    are ignored; an empty table gives none.
    """
    span = "array<struct<start:int,end:int,kind:string,cost:double>>"
    value = "array<struct<start:int,end:int,cost:double,cut:string>>"
    ranked = docs.sparkSession.sparkContext.broadcast(words)  # a dictionary that was given

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GuessCost(ranked.value, rows)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("cost", pa.float64())]))
        kept = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64()), ("cut", pa.string())]))
        for batch, text in slices(batches, 1):
            found, scored = [], []
            for raw in text.to_pylist():
                base, values = scan_text(raw, model)
                all_ = [(*s, None) for s in base] + [(v.start, v.end, "guess", v.cost) for v in values if v.cost >= least_cost]
                found.append([{"start": a, "end": b, "kind": k, "cost": c} for a, b, k, c in sorted(all_, key=lambda s: (s[0], KINDS.index(s[2])))])
                scored.append([{"start": v.start, "end": v.end, "cost": v.cost, "cut": " ".join(f"{k}:{v.start + a}:{v.start + b}" for a, b, k in v.cut)} for v in values])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(scored, kept)], names=["doc_id", "spans", "scored"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, spans {span}, scored {value}")


def redact(text: str, spans: list, mask: Callable[[str], str] = lambda kind: f"[{kind}]") -> str:
    """The text with its spans masked; overlapping spans are masked as one, under the first's kind."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s[0], s[1])):
        if s[0] >= at:
            out += [text[at : s[0]], mask(s[2])]
        at = max(at, s[1])
    return "".join([*out, text[at:]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: counts and digests of the spans of every document, and the cost and cut of every value in a credential's
    context; words are ranked by the list above and then by a public tokenizer's vocabulary."""
    import public_tokenizers

    words = WORDS + vocabulary_words(public_tokenizers.path("word_bpe_49k.json"))
    found = scan(read(spark, sf_dir, "documents"), words=words)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    costs = F.array_join(F.transform("scored", lambda v: F.concat(v["start"], F.lit(":"), v["end"], F.lit(":"), F.format_number(v["cost"], 6), F.lit(":"), v["cut"])), ",")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), F.size("scored").cast("long").alias("n_scored"), costs.alias("costs"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
