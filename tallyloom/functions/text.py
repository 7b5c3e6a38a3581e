"""Text expressions for rendering and checking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import depth

#: The signs that Markdown gives a meaning inside a line.
MARKDOWN = r"([\\`*_\[\]<>])"
# Entities that diagram text needs, in natural order.
DIAGRAM_ENTITIES = {'"': "#quot;", "#": "#35;", ";": "#59;", "<": "#lt;", ">": "#gt;"}


def escape_inline(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN, r"\\$1")


def escape_cell(text: Column) -> Column:
    """As escape_inline, then bars, then line breaks as one space each."""
    return F.regexp_replace(F.replace(escape_inline(text), F.lit("|"), F.lit("\\|")), r"\r\n|\r|\n", " ")


def escape_diagram(text: Column) -> Column:
    """Entities in one pass: signs go to private-use places first, so that no entity is escaped again."""
    signs = list(DIAGRAM_ENTITIES)
    out = F.translate(text, "".join(signs), "".join(chr(0xE000 + i) for i in range(len(signs))))
    for i, s in enumerate(signs):
        out = F.replace(out, F.lit(chr(0xE000 + i)), F.lit(DIAGRAM_ENTITIES[s]))
    return out


def code_span(text: Column) -> Column:
    """Text between backticks: one each if it has none, else, spaced, one more than its longest run. Control and
    formatting signs are written as escapes."""
    odd = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Cc}|\p{Cf})"), F.lit(1)))
    text = F.when(F.size(odd) > 0, F.aggregate(odd, text, lambda t, c: F.replace(t, c, F.concat(F.lit("\\u{"), F.conv(F.hex(F.encode(c, "utf-32")), 16, 16), F.lit("}"))))).otherwise(text)
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r))), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(longest > 0, " ").otherwise("")
    return F.concat(fence, pad, text, pad, fence)


def percent_path(path: Column) -> Column:
    """A path for a link: all but letters, digits and -_.~$&+:=@/ percent-encoded. Form encoding does that but for a
    few signs, which are put right."""
    out = F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for sign in "$&+/:=@~":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


def source_link(path: Column, document: Column) -> Column:
    """A link from a document to a file, up as many folders as the document is deep."""
    return F.concat(F.lit("["), code_span(path), F.lit("]("), F.repeat(F.lit("../"), depth(document)), percent_path(path), F.lit(")"))


def framed_hash(*fields: Column) -> Column:
    """SHA-256 over the fields, each after its length in 8 big-endian bytes: no two lists of fields read alike."""
    framed = [part for f in fields for part in (F.unhex(F.lpad(F.hex(F.octet_length(f).cast("long")), 16, "0")), F.encode(f, "utf-8"))]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(*framed), 256))


def content_hash(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False))


def struct_hash(*columns) -> Column:
    """A hash of the columns as JSON, in the order given, nulls included."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def identity(key: Column, root: Column) -> Column:
    """A key that sorts the root component first."""
    return F.concat(F.when(root, "0:").otherwise("1:"), key)


def branch_name(title: Column, prefix: str = "docs/") -> Column:
    """Lower case, runs of other signs as one dash, 40 signs at most, then 12 digits of a hash of the title."""
    slug = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    slug = F.trim(F.left(slug, F.lit(40)), F.lit("-"))
    return F.concat(F.lit(prefix), F.when(slug == "", "update").otherwise(slug), F.lit("-"), F.left(F.sha2(title, 256), F.lit(12)))


def short_id(text: Column) -> Column:
    return F.left(F.trim(text), F.lit(12))


def endpoint_hash(url: Column) -> Column:
    """A hash of scheme and host in lower case, the port, and the path without trailing slashes."""
    authority = F.lower(F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+\z", "")
    return F.sha2(F.concat(authority, rest), 256)


def fallback_title(key: Column) -> Column:
    """The last part's ASCII words, each with a capital first and the rest as it was; 200 bytes at most."""
    words = F.filter(F.split(F.regexp_replace(F.substring_index(key, "/", -1), "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), " ")
    return F.left(F.when(title == "", "Component").otherwise(title), F.lit(200))


@F.pandas_udf(T.StringType())
def _percent(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c if c.isascii() and (c.isalnum() or c in "._/-") else "".join(f"%{b:02X}" for b in c.encode()) for c in t), na_action="ignore")


def safe_key(key: Column) -> Column:
    """A key that prose may hold: signs other than ASCII letters, digits and . _ / - percent-encoded."""
    return F.when(key.rlike(r"\A[A-Za-z0-9._/-]*\z"), key).otherwise(_percent(key))


def tidy(text: Column) -> Column:
    """No two blank lines in a row, and one line break at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"\n+\z", ""), F.lit("\n"))


# What plain prose must not hold, in the order in which it is reported, and the reasons.
SIGN_RULES = [
    (r"[^\P{Cc}\n\t]", "a control character"),
    (r"\p{Cf}", "a formatting character"),
    ("[\u2500-\u257f]", "box-drawing characters"),
]
#: The first such sign of a text is reported before anything else; then the first of these that the text has.
PROSE_RULES = [
    (r"(?i)(?:[a-z][a-z0-9+.\-]*://|\b(?:javascript|data|vbscript|mailto|tel|file):)", "a URI scheme"),
    (r"\]\(", "a Markdown link"),
    (r"(?i)</?[a-z!][^>]*>", "HTML"),
    (r"```|~~~", "a code fence"),
    (r"-->|<--|==>|<==|[-=_]{4,}", "an ASCII diagram"),
    (r"""(?i)(?:\A|[\t\n\f\r "'(<])(?:[a-z]:\\|/(?:users|home|root|private|var|tmp|etc|opt|usr|mnt|dev|proc|sys)(?:/|\z|[\t\n\f\r ]))""", "a machine path"),
]
#: The same for a line without its leading blanks; the first line with a problem is reported.
LINE_RULES = [
    (r"\A#", "a heading"),
    (r"\A(?:[-*+][\t\f\r ]+|[0-9]+[.)][\t\f\r ]+)", "a list"),
    (r"(?i)\A(?:graph|flowchart)[\t\f\r ]+(?:tb|td|bt|rl|lr|dt)\b|\A(?:sequencediagram|classdiagram|erdiagram|statediagram(?:-v2)?|gantt|pie|journey|gitgraph|mindmap|timeline)\b", "diagram syntax"),
]


def prose_problem(text: Column) -> Column:
    """Why a text is no plain prose, or null: the first sign that it must not hold, then the whole text's rules in turn,
    then the first line that breaks one."""
    sign = F.regexp_extract(text, "(" + "|".join(rx for rx, _ in SIGN_RULES) + ")", 1)

    def of_sign(found: Column) -> Column:
        out = None
        for rx, why in SIGN_RULES:
            out = F.when(found.rlike(rx), why) if out is None else out.when(found.rlike(rx), why)
        return out

    def of_line(line: Column) -> Column:
        bare, found = F.regexp_replace(line, r"\A[ \t]+", ""), None
        for rx, why in LINE_RULES:
            found = F.when(bare.rlike(rx), why) if found is None else found.when(bare.rlike(rx), why)
        return found

    # the text is searched for a sign once, and what was found is named in a list of one
    out = F.get(F.transform(F.array(sign), of_sign), F.lit(0))
    whole = None
    for rx, why in PROSE_RULES:
        whole = F.when(text.rlike(rx), why) if whole is None else whole.when(text.rlike(rx), why)
    lines = F.filter(F.transform(F.split(text, "\n"), of_line), lambda x: x.isNotNull())
    # most texts have no such line at all, which one search tells
    any_line = "(?m)^[ \\t]*(?:" + "|".join(rx.replace(r"\A", "") for rx, _ in LINE_RULES) + ")"
    return F.coalesce(out, whole.otherwise(F.when(text.rlike(any_line), F.get(lines, F.lit(0)))))


def label_problem(text: Column) -> Column:
    """As prose_problem; a line break comes first."""
    return F.when(text.rlike(r"[\r\n]"), "a line break").otherwise(prose_problem(text))
