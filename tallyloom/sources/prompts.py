"""Prompt resources as a static table, known by a hash over all of them."""

from __future__ import annotations

import hashlib
import json
import struct

from pyspark.sql import DataFrame, SparkSession

from ..operators.dossiers import ENUMS, FRAGMENT_ITEMS, FRAGMENT_LIMITS, OVERVIEW, SPEC, _all_fields

IDENTIFIER = "tallyloom-fragments-1"
SYSTEM = "You describe source code for its maintainers. Answer with one JSON object that fits the schema, in plain prose, and cite only the paths that you were given."
REPAIR = "Your answer did not fit the schema. Answer again with one JSON object that has none of the listed issues."
DOSSIER = "Describe the component as a whole: title, purpose, and every section that the sources support."
SYNTHESIS = "Combine the partial dossiers of one component into one. Cite only paths that they cite."


def schema(kind: str) -> dict:
    """The JSON schema of a kind's answer, made from the contract that checks it."""

    def of(fields: list) -> dict:
        out = {}
        for name, rule, more, _ in fields:
            if rule == "list":
                out[name] = {"type": "array", "maxItems": FRAGMENT_ITEMS.get(kind, 0) if name == "items" else FRAGMENT_LIMITS.get(name, 100), "items": {"type": "object", "additionalProperties": False, "properties": of(more), "required": [f[0] for f in more]}}
            elif rule in ("evidence", "labels"):
                out[name] = {"type": "array", "items": {"type": "string"}, "maxItems": FRAGMENT_LIMITS["source_paths" if rule == "evidence" else "members"]}
            elif rule == "enum":
                out[name] = {"type": "string", "enum": ENUMS[more]}
            else:
                out[name] = {"type": {"flag": "boolean", "count": "integer"}.get(rule, "string")}
        return out

    fields = OVERVIEW if kind == "overview" else _all_fields(kind)
    return {"type": "object", "additionalProperties": False, "properties": of(fields), "required": [f[0] for f in fields if f[3]]}


def resources() -> dict[str, str]:
    """Every resource by its path."""
    out = {"system.txt": SYSTEM, "repair.txt": REPAIR, "dossier.txt": DOSSIER, "synthesis.txt": SYNTHESIS}
    for kind in ["overview_candidate", *SPEC, "diagrams", "overview"]:
        out[f"{kind}.txt"] = f"Give the {kind.replace('_', ' ')} that these sources show."
        out[f"{kind}.schema.json"] = json.dumps(schema(kind), ensure_ascii=False, sort_keys=True)
    return out


def framed_digest(values: list[str]) -> str:
    """SHA-256 over texts, each after its length in 8 big-endian bytes."""
    digest = hashlib.sha256()
    for v in values:
        data = v.encode()
        digest.update(struct.pack(">Q", len(data)) + data)
    return "sha256:" + digest.hexdigest()


def content_hash(identifier: str = IDENTIFIER, found: dict[str, str] | None = None) -> str:
    """A hash of the identifier, then of each resource's path and text in order of the paths."""
    found = resources() if found is None else found
    return framed_digest([identifier, *[x for path in sorted(found) for x in (path, found[path])]])


def prompt_hash(strategy: str) -> str:
    """The hash that a strategy's answers depend on: of what it sends, and of both for `auto`."""
    every = resources()
    whole = {p: t for p, t in every.items() if p in ("system.txt", "repair.txt", "dossier.txt", "synthesis.txt")}
    parts = {p: t for p, t in every.items() if p not in ("dossier.txt", "synthesis.txt")}
    return content_hash(found={"dossier": whole, "fragments": parts, "auto": every}[strategy])


def table(spark: SparkSession) -> DataFrame:
    """path, text, bytes: the resources as rows."""
    return spark.createDataFrame([(p, t, len(t.encode())) for p, t in sorted(resources().items())], "path string, text string, bytes long")


def kind_of(resource: str) -> str:
    return resource.split(".", 1)[0]
