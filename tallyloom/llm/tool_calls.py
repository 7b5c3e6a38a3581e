"""Tool-call linking for chat data, in DataFrame and SQL functions only."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stored


@dataclass(frozen=True)
class Tool:
    """A tool's arguments and which of them must be there. An argument's schema is a type (string, integer, number,
    boolean, array, object) or a dictionary with `type` and, as far as wanted, `enum` (values), `minimum` and `maximum`
    (numbers), `items` (the schema of an array's elements), `properties` and `required` (of an object)."""

    name: str
    arguments: dict[str, str | dict] = field(default_factory=dict)
    required: tuple[str, ...] = ()


#: What schema_of_variant calls the values of each type of a tool's schema.
VARIANT_TYPES = {"string": r"STRING", "integer": r"BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL.*", "boolean": r"BOOLEAN", "array": r"ARRAY.*", "object": r"OBJECT.*"}


def _step(name: str) -> str:
    """A path's step to a key, whatever signs are in it but both kinds of quotes."""
    if "'" in name and '"' in name:
        raise ValueError(f"no path leads to an argument with both kinds of quotes: {name}")
    return f'["{name}"]' if "'" in name else f"['{name}']"


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).rlike(rf"\A(?:{VARIANT_TYPES[kind]})\z"), F.lit(False))


def _object_error(value: Column, arguments: dict, required, at: str) -> list[tuple[Column, Column]]:
    """(condition, error) pairs for an object that is one: what is missing, unknown or wrong, in this order."""
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), F.array().cast("array<string>"))
    checks = [(~F.array_contains(keys, a), F.lit(f"missing:{at}{a}")) for a in sorted(required)]
    stray = F.array_min(F.array_except(keys, F.array(*[F.lit(a) for a in sorted(arguments)]).cast("array<string>")))
    checks.append((stray.isNotNull(), F.concat(F.lit(f"unknown:{at}"), stray)))
    for a, schema in sorted(arguments.items()):
        wrong = _value_error(F.try_variant_get(value, f"${_step(a)}", "variant"), {"type": schema} if isinstance(schema, str) else schema, at + a)
        checks.append((F.array_contains(keys, a) & wrong.isNotNull(), wrong))
    return checks


def _value_error(value: Column, schema: dict, at: str) -> Column:
    """The first thing wrong with a value, or null."""
    kind = schema["type"]
    checks = [(~_is(value, kind), F.lit(f"type:{at}"))]
    if "enum" in schema:
        checks.append((~F.coalesce(F.to_json(value).isin([json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]), F.lit(False)), F.lit(f"enum:{at}")))
    number = F.try_variant_get(value, "$", "double")
    for bound, beyond in (("minimum", lambda b: number < b), ("maximum", lambda b: number > b)):
        if bound in schema:
            checks.append((beyond(schema[bound]), F.lit(f"{bound}:{at}")))
    if kind == "array" and "items" in schema:
        items = schema["items"] if isinstance(schema["items"], dict) else {"type": schema["items"]}
        wrong = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: _value_error(x, items, f"{at}[]")), lambda e: e.isNotNull())
        checks.append((F.size(wrong) > 0, F.try_element_at(wrong, F.lit(1))))
    if kind == "object" and "properties" in schema:
        checks += _object_error(value, schema["properties"], schema.get("required", ()), f"{at}.")
    return _first(checks)


def _first(checks: list[tuple[Column, Column]]) -> Column:
    error = F.when(*checks[0])
    for condition, text in checks[1:]:
        error = error.when(condition, text)
    return error


def argument_error(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """The first thing wrong with a call's arguments, or null: an unknown tool, no JSON object, an argument that is
    missing, unknown, or wrong by its schema (type, enum, minimum, maximum, items, properties; arguments in code
    point order)."""
    value = F.try_parse_json(arguments)
    checks = [(name.isNull() | ~F.coalesce(name, F.lit("")).isin([t.name for t in tools]), F.lit("unknown_tool")), (value.isNull() | ~_is(value, "object"), F.lit("not_an_object"))]
    for t in sorted(tools, key=lambda t: t.name):
        checks += [((name == t.name) & wrong, text) for wrong, text in _object_error(value, t.arguments, t.required, "")]
    return _first(checks)


def parse_messages(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages hold as JSON: an assistant's text {"tool_calls": [{"id", "name", "arguments",
    "after"}]}, and a tool's text {"tool_call_id", "content"}. Other texts, null ones included, hold none."""
    m = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    said = m.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.from_json("text", "tool_calls array<struct<id string, name string, arguments string, after string>>")["tool_calls"]).alias("n", "c"))
    calls = said.select("conv_id", F.col("c.id").alias("call_id"), (F.col("turn") * 1000 + F.col("n")).alias("seq"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after_id"))
    got = m.where("role = 'tool'").select("conv_id", "turn", F.from_json("text", "tool_call_id string, content string").alias("r"))
    return calls, got.select("conv_id", F.col("r.tool_call_id").alias("call_id"), (F.col("turn") * 1000).alias("seq"), F.col("r.content").alias("content"))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): how many calls a call comes after, itself included, along after_id; null on and
    behind a circle. Each (conv_id, call_id) stands once, neither is null.

    Pointer doubling: each round a call takes over what its pointer points to, so the rounds are the logarithm of
    the longest chain, and each is a hash join on (conversation, call). Only calls that still point are written anew;
    the others are written once, when they are done. A pointer to no call counts as none. No chain is longer than its
    conversation: after that many rounds what still points is on or behind a circle.
    """
    known = calls.select("conv_id", F.col("call_id").alias("after_id"), F.lit(True).alias("known"))
    at = calls.select("conv_id", "call_id", "after_id").join(known.hint("shuffle_hash"), ["conv_id", "after_id"], "left")
    at = stored(at.select("conv_id", "call_id", F.when(F.col("known"), F.col("after_id")).alias("ptr"), F.lit(1).cast("long").alias("depth")))
    longest = at.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done, open_ = at.where("ptr is null"), at.where("ptr is not null")
    for _ in range(longest.bit_length() + 1):
        if open_.isEmpty():
            break
        to = done.unionByName(open_).select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("depth").alias("more"))
        at = stored(open_.join(to.hint("shuffle_hash"), ["conv_id", "ptr"]).select("conv_id", "call_id", F.col("next").alias("ptr"), (F.col("depth") + F.col("more")).alias("depth")))
        done, open_ = done.unionByName(at.where("ptr is null")), at.where("ptr is not null")
    return done.unionByName(open_.withColumn("depth", F.lit(None).cast("long"))).select("conv_id", "call_id", "depth")


def link(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """A row for each call and each result: conv_id, call_id, kind, seq, depth, error, json.

    `calls`: conv_id, call_id, seq, name, arguments (JSON text), after_id (a call of the conversation that must come
    first, or null). `results`: conv_id, call_id, seq, content. Both meet by hash joins on conversation and identifier;
    what one identifier is known by (places and hashes, no texts) is joined to the rows. Rows without one of the two
    take no part. Of equal identifiers the first by seq, then by a hash of the row, is the one that links; rows equal
    in all are one, and the others are duplicate_id. Errors, the
    first that holds: null_id, duplicate_id, circle, the argument errors, unanswered for a call, and for a result
    orphan, or early if it stands before its call. (depth, seq) is a topological order of a conversation, a call
    before its result and before calls after it; depth is null where there is none.

    json is canonical: keys in code point order, no white space, nulls left out; arguments are the text of their own
    canonical JSON, or as they came where they don't parse. Null contents and names are kept as missing keys; an empty table gives
    none; other columns are ignored. No conversation is gathered in one row or task.
    """
    calls = calls.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "name", "arguments", "after_id").withColumn("h", F.xxhash64("name", F.lit(0), "arguments", F.lit(1), "after_id"))
    results = results.select("conv_id", "call_id", F.col("seq").cast("long").alias("seq"), "content").withColumn("h", F.xxhash64("content"))
    named = "call_id is not null and conv_id is not null"
    keys = ["conv_id", "call_id"]
    first_call = calls.where(named).groupBy(*keys).agg(F.min(F.struct("seq", "h", "after_id")).alias("c"))
    first_call = stored(first_call.select(*keys, F.col("c.seq").alias("call_seq"), F.col("c.h").alias("call_h"), "c.after_id"))
    first_result = results.where(named).groupBy(*keys).agg(F.min(F.struct("seq", "h")).alias("r"))
    first_result = first_result.select(*keys, F.col("r.seq").alias("result_seq"), F.col("r.h").alias("result_h"))
    depth = depths(first_call.select(*keys, "after_id"))
    both = first_call.drop("after_id").join(depth.hint("shuffle_hash"), keys).withColumn("called", F.lit(True))
    both = stored(both.join(first_result.hint("shuffle_hash"), keys, "full_outer")).hint("shuffle_hash")
    known = [F.lit(None).cast(t).alias(n) for n, t in both.dtypes if n not in keys]
    met = lambda df: df.where(named).join(both, keys, "left").unionByName(df.where(f"not ({named})").select("*", *known))

    c = met(calls)
    parsed = F.try_parse_json("arguments")
    is_first = F.expr("called and seq <=> call_seq and h = call_h")
    error = F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "null_id").when(~is_first, "duplicate_id").when(F.col("depth").isNull(), "circle")
    error = F.coalesce(error, argument_error(F.col("name"), F.col("arguments"), tools), F.when(F.col("result_h").isNull(), "unanswered"))
    json_ = F.to_json(F.struct(F.coalesce(F.to_json(parsed), F.col("arguments")).alias("arguments"), F.col("call_id").alias("id"), "name", F.lit("call").alias("type")))
    c = c.select(*keys, F.lit("call").alias("kind"), "seq", F.when(is_first, F.col("depth")).alias("depth"), error.alias("error"), json_.alias("json"))
    r = met(results)
    is_first = F.expr("seq <=> result_seq and h <=> result_h")
    error = F.when(F.col("call_id").isNull() | F.col("conv_id").isNull(), "null_id").when(~is_first, "duplicate_id").when(F.col("called").isNull(), "orphan").when(F.col("depth").isNull(), "circle").when(F.col("seq") < F.col("call_seq"), "early")
    json_ = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("type")))
    r = r.select(*keys, F.lit("result").alias("kind"), "seq", F.when(is_first, F.col("depth")).alias("depth"), error.alias("error"), json_.alias("json"))
    return c.unionByName(r)


#: The tool of the query: every user turn calls it.
ASK = Tool("ask", {"query": "string", "turn": "integer"}, ("query", "turn"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the table holds no tool calls, so each turn that isn't an assistant's becomes a call, of the tool `ask` for
    a user's and of one that no schema knows for the others; each assistant's turn is the result of the turn before
    it; and each call comes after the call two turns before, if there is one.
    A null role is not an assistant's: its turn is a call without a name, which is an unknown_tool."""
    m = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ident = lambda back: F.concat(F.lit("c"), (F.col("turn") - back).cast("string"))
    calls = m.where("not (role <=> 'assistant')").select("conv_id", ident(0).alias("call_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", "ask").otherwise(F.col("role")).alias("name"), F.to_json(F.struct(F.col("text").alias("query"), "turn")).alias("arguments"), ident(2).alias("after_id"))
    results = m.where("role = 'assistant'").select("conv_id", ident(1).alias("call_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return link(calls, results, [ASK])


#: The same in DuckDB's SQL; a chain of calls is walked by recursion.
ORACLE = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, 'c' || turn AS call_id, CASE WHEN role = 'user' THEN 'ask' ELSE role END AS name, text FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
walk(conv_id, turn, depth) AS (
  SELECT conv_id, turn, 1::BIGINT FROM c WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, walk.depth + 1 FROM walk JOIN c ON c.conv_id = walk.conv_id AND c.turn = walk.turn + 2),
r AS (SELECT conv_id, turn, 'c' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.call_id, 'call' AS kind, c.turn AS seq, walk.depth,
       CASE WHEN c.name IS DISTINCT FROM 'ask' THEN 'unknown_tool' WHEN r.turn IS NULL THEN 'unanswered' END AS error,
       '{"arguments":' || to_json(('{"query":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '}')::VARCHAR)::VARCHAR || ',"id":"' || c.call_id || '"' || coalesce(',"name":"' || c.name || '"', '') || ',"type":"call"}' AS json
FROM c JOIN walk USING (conv_id, turn) LEFT JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id
UNION ALL
SELECT r.conv_id, r.call_id, 'result', r.turn, walk.depth, CASE WHEN c.turn IS NULL THEN 'orphan' END,
       '{"content":' || to_json(r.text)::VARCHAR || ',"id":"' || r.call_id || '","type":"result"}'
FROM r LEFT JOIN c ON r.conv_id = c.conv_id AND r.call_id = c.call_id LEFT JOIN walk ON walk.conv_id = c.conv_id AND walk.turn = c.turn
"""
