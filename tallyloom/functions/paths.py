"""Path expressions: columns in, columns out, all inside Catalyst but for percent-encoding."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Device names that a portable file name can't have.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"{p}{n}" for p in ("COM", "LPT") for n in range(1, 10))]


def segments(path: Column) -> Column:
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; "." for a path without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(".")


def extension(path: Column) -> Column:
    """The last dot of the file name and what follows, else the empty string."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def depth(path: Column) -> Column:
    """Slashes in the path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last; empty for a path at the root."""
    parts = segments(path)
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def prefixes(path: Column) -> Column:
    """A path and the directories above it."""
    parts = segments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def has_segment(path: Column, names: list[str]) -> Column:
    return path.rlike(rf"(?:\A|/)(?:{'|'.join(map(re.escape, names))})(?:/|\z)")


def within(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root + "/")


def is_clean(path: Column) -> Column:
    """Whether a path is relative, valid UTF-8 and normal: no empty, "." or ".." parts, no NUL."""
    bad = path.rlike(r"\A/|//|/\z|\x00|(?:\A|/)\.{1,2}(?:/|\z)")
    return F.coalesce((F.length(path) > 0) & ~bad & F.is_valid_utf8(path), F.lit(False))


def glob_regex(pattern: str) -> str:
    """A regular expression for a glob: * and ? stay within a part, ** spans parts, {a,b} chooses, [..] is a class."""
    out, i, braces = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("/**", i) and i + 3 == len(pattern):
            out.append("(?:/.*)?")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*" if pattern == "**" else "[^/]*")
            i += 2
            continue
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end + 1
            continue
        if c == "\\" and i + 1 < len(pattern):
            out.append(re.escape(pattern[i + 1]))
            i += 2
            continue
        if c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c))
        i += 1
    return rf"(?s)\A(?:{''.join(out)})\z"


def matches_any(path: Column, globs: list[str]) -> Column:
    """Whether one of the globs fits; none do if there are none."""
    return path.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def _encode(segment: str) -> str:
    raw = segment.encode()
    plain = len(raw) - (len(raw) - len(raw.rstrip(b".")))
    device = segment.split(".")[0].upper() in DEVICES
    keep = lambda i, b: (97 <= b <= 122 or 48 <= b <= 57 or b in b"._-") and not (device and i == 0) and not (b == 46 and i >= plain)
    return "".join(chr(b) if keep(i, b) else f"%{b:02X}" for i, b in enumerate(raw))


def encode_key(key: str) -> str:
    """A component key as a portable path: other signs, trailing dots and a device name's first sign percent-encoded."""
    return "/".join(map(_encode, key.split("/")))


def decode_key(text: str) -> str | None:
    """The key whose encoding this is, or null if it is no canonical encoding."""
    if not text or not re.fullmatch(r"(?:[^%]|%[0-9A-F]{2})*", text, re.S):
        return None
    raw = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), text.encode())
    try:
        key = raw.decode()
    except UnicodeDecodeError:
        return None
    return key if encode_key(key) == text and not any(p in ("", ".", "..") for p in key.split("/")) else None


@F.pandas_udf(T.StringType())
def _encode_udf(keys: pd.Series) -> pd.Series:
    return keys.map(encode_key, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decode_udf(keys: pd.Series) -> pd.Series:
    return keys.map(decode_key, na_action="ignore")


def encoded_key(key: Column) -> Column:
    """encode_key; a key that has nothing to encode and no part that may be a device doesn't leave the JVM's row."""
    plain = key.rlike(r"\A[a-z0-9_-]+(?:/[a-z0-9_-]+)*\z") & ~key.rlike(r"(?i)(?:\A|/)(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:/|\z)")
    return F.when(plain, key).otherwise(_encode_udf(key))


def decoded_key(text: Column) -> Column:
    return _decode_udf(text)


def component_page(docs_dir: str, key: Column, root: Column) -> Column:
    return F.concat_ws("/", F.lit(docs_dir), F.lit("components"), F.when(root, F.lit("@root")).otherwise(encoded_key(key)), F.lit("index.md"))
