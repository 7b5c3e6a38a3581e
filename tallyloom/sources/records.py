"""Reading what a version control tool prints, files, state and model answers. No process is started and no network used."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import is_clean
from ..functions.text import is_hash
from ..operators.classify import ROLES

OBJECT_ID = r"(?:[0-9a-f]{40}|[0-9a-f]{64})"
INDEX = rf"\A([0-7]{{6}}) ({OBJECT_ID}) ([0-3])\t((?s:.+))\z"
TREE = rf"\A([0-7]{{6}}) (blob|commit|tree) ({OBJECT_ID}) +(-|[0-9]+)\t((?s:.+))\z"
MOST_STATE_BYTES = 8 << 20


def index_records(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Entries (path, mode, object_id) and rejects (record, reason) of NUL-separated index records.

    Rejected are records of another shape, unmerged stages, unclean paths, and paths that occur twice.
    """
    rows = raw.select(F.explode(F.filter(F.split(F.col(column), "\0"), lambda r: r != "")).alias("record"))
    rows = rows.withColumns({"mode": F.regexp_extract("record", INDEX, 1), "object_id": F.regexp_extract("record", INDEX, 2), "stage": F.regexp_extract("record", INDEX, 3), "path": F.regexp_extract("record", INDEX, 4)})
    twice = rows.where("path <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit(True).alias("twice"))
    rows = rows.join(twice, "path", "left")
    reason = F.when(F.col("mode") == "", "malformed").when(F.col("stage") != "0", "unmerged").when(~is_clean(F.col("path")), "unclean_path").when(F.col("twice"), "duplicate_path")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("path", "mode", "object_id"), rows.where("reason is not null").select("record", "reason")


def tree_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """path, mode, kind, object_id, size of NUL-separated tree records; size is null where there is none."""
    rows = raw.select(F.explode(F.filter(F.split(F.col(column), "\0"), lambda r: r != "")).alias("r"))
    g = lambda n: F.regexp_extract("r", TREE, n)
    return rows.where(F.col("r").rlike(TREE)).select(g(5).alias("path"), g(1).alias("mode"), g(2).alias("kind"), g(3).alias("object_id"), F.try_to_number(g(4), F.lit("9999999999999999")).cast("long").alias("size"))


def change_records(raw: DataFrame, column: str = "raw") -> DataFrame:
    """status, old_path, new_path, similarity of NUL-separated change fields: A, M, T and D have one path, R and a
    number two. T is a modification. A record of another kind raises."""
    fields = F.filter(F.split(F.col(column), "\0"), lambda r: r != "")
    start = "cast(struct(array(), '', '') as struct<out: array<struct<status: string, a: string, b: string>>, status: string, a: string>)"
    step = """case when acc.status = '' then named_struct('out', acc.out, 'status', f, 'a', '')
                   when acc.status like 'R%' and acc.a = '' then named_struct('out', acc.out, 'status', acc.status, 'a', f)
                   when acc.status like 'R%' then named_struct('out', array_append(acc.out, named_struct('status', acc.status, 'a', acc.a, 'b', f)), 'status', '', 'a', '')
                   else named_struct('out', array_append(acc.out, named_struct('status', acc.status, 'a', f, 'b', f)), 'status', '', 'a', '') end"""
    rows = raw.select(fields.alias("fields")).select(F.explode(F.expr(f"aggregate(fields, {start}, (acc, f) -> {step}, acc -> acc.out)")).alias("x"))
    kind = F.left("x.status", F.lit(1))
    status = F.when(kind == "A", "added").when(kind.isin("M", "T"), "modified").when(kind == "D", "deleted").when(kind == "R", "renamed").otherwise(F.raise_error(F.concat(F.lit("unknown change "), "x.status")).cast("string"))
    return rows.select(status.alias("status"), F.when(kind.isin("D", "R"), F.col("x.a")).alias("old_path"), F.when(kind != "D", F.col("x.b")).alias("new_path"), F.when(kind == "R", F.substring("x.status", 2, 3).cast("int")).alias("similarity"))


def worktree(spark: SparkSession, root: str, most_bytes: int, glob: str = "*") -> DataFrame:
    """path, data, size, truncated of all files below `root`; the content of a file above the limit isn't kept.
    Columns that a query doesn't select are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    path = F.expr(f"substring(path, instr(path, '{base}') + {len(base)})")
    return files.select(path.alias("path"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("data"), F.col("length").alias("size"), (F.col("length") > most_bytes).alias("truncated"))


def worktree_files(paths: DataFrame, root: str, most_bytes: int) -> DataFrame:
    """path, data, size, truncated, problem of given paths below `root`, a folder that all machines see as local files. No
    link is followed: a link's content is its target, and a path through a link is refused. problem: unclean_path,
    link_in_path, missing, not_a_file; a file above the limit is truncated and has no data."""
    root = root.rstrip("/")

    def look(path: str) -> tuple[bytes | None, int | None, bool, str | None]:
        at, parts = root, path.split("/")
        for i, part in enumerate(parts):
            at = f"{at}/{part}"
            try:
                mode = os.lstat(at)
            except (FileNotFoundError, NotADirectoryError):
                return None, None, False, "missing"
            if i < len(parts) - 1 and stat.S_ISLNK(mode.st_mode):
                return None, None, False, "link_in_path"
        if stat.S_ISLNK(mode.st_mode):
            data = os.readlink(at.encode())
            return (data if len(data) <= most_bytes else None), len(data), len(data) > most_bytes, None
        if not stat.S_ISREG(mode.st_mode):
            return None, None, False, "not_a_file"
        with open(os.open(at, os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
            size = os.fstat(f.fileno()).st_size
            data = f.read(most_bytes + 1) if size <= most_bytes else b""
        cut = size > most_bytes or len(data) > most_bytes
        return (None if cut else data), max(size, len(data)), cut, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, clean in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, size, cut, problem = look(path) if clean else (None, None, False, "unclean_path")
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([data], pa.binary()), pa.array([size], pa.int64()), pa.array([cut], pa.bool_()), pa.array([problem], pa.string())], names=["path", "data", "size", "truncated", "problem"])

    return paths.select("path", F.coalesce(is_clean(F.col("path")), F.lit(False)).alias("clean")).mapInArrow(run, "path string, data binary, size long, truncated boolean, problem string")


STATE = "version int, files array<struct<path string, source_hash string, role string, triggers boolean, component_key string, root_component boolean>>, components array<struct<component_key string, root_component boolean, input_hash string, document string>>, generated map<string,string>, config_hash string"


def load_state(spark: SparkSession, path: str) -> tuple[str, DataFrame | None]:
    """"missing", "invalid" or "valid", and the state as one row. Unknown names at any level, a wrong type, a file above the
    bound and a broken rule of state_issues() make it invalid."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.text(path, wholetext=True)
        if raw.isEmpty():
            return "missing", None
    except AnalysisException:
        return "missing", None
    return _state(raw)


def load_tree_state(repository, revision: str, path: str) -> tuple[str, DataFrame | None]:
    """The same of the state that a commit holds."""
    found = repository.file(revision, path, MOST_STATE_BYTES)
    if found is None:
        return "missing", None
    if found[1]:
        return "invalid", None
    return _state(repository.spark.createDataFrame([(found[2].decode("utf-8", "replace"),)], "value string"))


def _state(raw: DataFrame) -> tuple[str, DataFrame | None]:
    shape = F.from_json("value", STATE)
    ok = raw.select(shape.alias("s"), (F.try_parse_json("value").isNotNull() & (F.size(unknown_names("value")) == 0) & (F.octet_length("value") <= MOST_STATE_BYTES)).alias("ok")).where("ok and s.version is not null")
    if ok.isEmpty() or not state_issues(ok.select("s.*")).isEmpty():
        return "invalid", None
    return "valid", ok.select("s.*")


def unknown_names(column: str) -> Column:
    """Names in a state (JSON) that it may not have, at its top and within files and components, sorted."""
    types = T.StructType.fromDDL(STATE)
    maps = lambda name: F.from_json(F.get_json_object(column, f"$.{name}"), "array<map<string,string>>")
    names = [F.coalesce(F.json_object_keys(column), F.array().cast("array<string>"))]
    extra = [F.array_except(names[0], F.array(*map(F.lit, types.names)))]
    for part in ("files", "components"):
        used = F.array_distinct(F.flatten(F.transform(F.coalesce(maps(part), F.array().cast("array<map<string,string>>")), lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
        extra.append(F.transform(F.array_except(used, F.array(*map(F.lit, types[part].dataType.elementType.names))), lambda n: F.concat(F.lit(f"{part}."), n)))  # noqa: B023
    return F.array_sort(F.concat(*extra))


def state_issues(state: DataFrame) -> DataFrame:
    """path, code of the files of a state (one row, whose size load_state() bounds) that break a rule."""
    return file_issues(state.select(F.lit(0).alias("state"), F.posexplode("files").alias("n", "f")).select("state", "n", "f.*")).drop("state")


def file_issues(files: DataFrame) -> DataFrame:
    """state, path, code of files that break a rule: order, uniqueness, path, hash, role. `files`: state, n (the place in
    it), path, source_hash, role. A path out of order is one that comes before the path that it follows."""
    before = F.lag("path").over(Window.partitionBy("state").orderBy("n"))
    late = files.withColumn("before", before).where("path < before").select("state", "path", F.lit("unsorted").alias("code"))
    return _row_issues(files, ["state"]).unionByName(late)


def table_issues(files: DataFrame) -> DataFrame:
    """path, code of the same, but for the order, of a state that is a table."""
    return _row_issues(files, [])


def _row_issues(files: DataFrame, key: list[str]) -> DataFrame:
    twice = files.groupBy(*key, "path").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*key, "path", F.lit("duplicate_path").alias("code"))
    codes = F.array(F.when(~is_clean(F.col("path")), "unclean_path"), F.when(~is_hash(F.col("source_hash")), "bad_hash"), F.when(~F.coalesce(F.col("role").isin(list(ROLES)), F.lit(False)), "unknown_role"))
    each = files.select(*key, "path", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
    return twice.unionByName(each)


def _bounded(finish_failure: Column, content: Column, most_bytes: int) -> Column:
    """The failure of a finished answer: how it finished, else none at all, too many bytes, no valid text."""
    return F.coalesce(finish_failure, F.when(F.coalesce(content, F.lit("")) == "", "empty").when(F.octet_length(content) > most_bytes, "response_too_large").when(~F.is_valid_utf8(content), "invalid_utf8"))


def _normalised(raw: DataFrame, finish: Column, request: Column, content: Column, failure: Column, usage: list[Column]) -> DataFrame:
    named = [finish.alias("finish_reason"), request.alias("provider_request_id"), F.when(failure.isNull(), content).alias("body"), failure.alias("failure")]
    counts = [F.when(failure.isNull(), c).alias(n) for n, c in zip(("prompt", "completion", "total"), usage, strict=True)]
    return raw.select("*", *named, *counts)


CHAT = "id string, choices array<struct<finish_reason string, message struct<content string>>>, usage struct<prompt_tokens long, completion_tokens long, total_tokens long>"
REPLY = "id string, status string, incomplete_details struct<reason string>, output array<struct<content array<struct<type string, text string>>>>, usage struct<input_tokens long, output_tokens long, total_tokens long>"


def chat_answers(raw: DataFrame, most_bytes: int, column: str = "raw") -> DataFrame:
    """All columns with finish_reason, provider_request_id, body, failure, prompt, completion, total of chat envelopes (JSON).

    Failures: invalid_envelope for what is no JSON object, empty without a choice, truncated where it finished for
    "length", incomplete for any other reason than "stop", then empty, response_too_large, invalid_utf8."""
    e, ok = F.from_json(column, CHAT), F.startswith(F.schema_of_variant(F.try_parse_json(column)), F.lit("OBJECT"))
    first = F.get(e["choices"], F.lit(0))
    finish, content = first["finish_reason"], first["message"]["content"]
    early = F.when(~F.coalesce(ok, F.lit(False)), "invalid_envelope").when(first.isNull(), "empty").when(finish == "length", "truncated").when(~finish.eqNullSafe(F.lit("stop")), "incomplete")
    return _normalised(raw, finish, e["id"], content, _bounded(early, content, most_bytes), [e["usage"][c] for c in ("prompt_tokens", "completion_tokens", "total_tokens")])


def reply_answers(raw: DataFrame, most_bytes: int, column: str = "raw") -> DataFrame:
    """As chat_answers(), of envelopes with a status and a list of output items, whose text parts are joined.

    Not "completed" is truncated where the status is "incomplete" for "max_output_tokens", and incomplete else."""
    e, ok = F.from_json(column, REPLY), F.startswith(F.schema_of_variant(F.try_parse_json(column)), F.lit("OBJECT"))
    why = e["incomplete_details"]["reason"]
    parts = F.flatten(F.transform(F.coalesce(e["output"], F.array().cast("array<struct<content:array<struct<type:string,text:string>>>>")), lambda o: F.coalesce(o["content"], F.array().cast("array<struct<type:string,text:string>>"))))
    content = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin("output_text", "text")), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    cut_off = (e["status"] == "incomplete") & (why == "max_output_tokens")
    early = F.when(~F.coalesce(ok, F.lit(False)), "invalid_envelope").when(F.coalesce(cut_off, F.lit(False)), "truncated").when(~e["status"].eqNullSafe(F.lit("completed")), "incomplete")
    return _normalised(raw, F.coalesce(why, e["status"]), e["id"], content, _bounded(early, content, most_bytes), [e["usage"][c] for c in ("input_tokens", "output_tokens", "total_tokens")])
