"""Generating dossiers: in one request, in batches with a synthesis, or in fragments, scope by scope and kind by kind, that
are checked, merged and reduced. Model calls go through a generator that is given; `keep` writes a table and reads it again,
so that no call is repeated."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fallback_title
from ..sources import generator
from . import dossiers, merge
from .packing import MAPPED, halves_with_overlap, total

KEY = ["component_key", "root_component"]
SCOPE = [*KEY, "batch", "batch_count", "chunk", "chunk_count", "split_path"]
SECTIONS = list(dossiers.SPEC)
NAMES = {"architecture": "title", "interfaces": "name", "data_models": "name", "workflows": "name", "dependencies": "name", "review_gaps": "description"}
# What a reducer is shown of each section, and what a provider must be able to do.
PROJECTED = 8
MINIMUM_OUTPUT_TOKENS, MINIMUM_RESPONSE_BYTES = 8_192, 8_192
ISSUE_BYTES = {"code": 64, "path": 256, "message": 256}
MOST_ISSUES = 50
SPLIT_DEPTH = 3

Keep = Callable[[DataFrame], DataFrame]
Call = Callable[[str], tuple[str, str]]


def within_budget(requests: DataFrame, spent: DataFrame | None, limit: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The requests that a component may still make, in order, and the components (component_key, root_component) that
    reached their limit of calls. `spent`: component_key, root_component, calls made so far."""
    rows = requests
    if "request_id" in requests.columns:  # numbered without their texts: a window holds thousands of rows
        rows = requests.select(*dict.fromkeys(["request_id", *KEY, *order]))
    rows = rows.withColumn("nth_", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order)))
    rows = rows.withColumn("calls", F.lit(0).cast("long")) if spent is None else rows.join(spent.select(*KEY, "calls"), KEY, "left")
    ok = F.col("nth_") + F.coalesce("calls", F.lit(0)) <= limit
    over = rows.where(~ok)
    if "request_id" not in requests.columns:
        within = rows.where(ok).drop("nth_", "calls")
    else:
        within = requests if over.isEmpty() else requests.join(over.select("request_id"), "request_id", "left_anti").select(*requests.columns)
    return within, over.select(*KEY).distinct()


def charged(requests: DataFrame, spent: DataFrame | None, limit: int, order: list[str]) -> DataFrame:
    """All columns of requests (with `repaired`, whether a request needs a second call) with `called` and `again`: whether
    its first and its second call are within the limit, if a component's calls are made one after the other in order. A
    running sum charges both calls of all requests before, so that the cut falls at the same call."""
    each = F.lit(1) + F.col("repaired").cast("int")
    before = F.coalesce(F.sum(each).over(Window.partitionBy(*KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = requests.withColumn("before_", before)
    rows = rows.withColumn("calls_", F.lit(0).cast("long")) if spent is None else rows.join(spent.select(*KEY, F.col("calls").alias("calls_")), KEY, "left")
    used = F.coalesce("calls_", F.lit(0)) + F.col("before_")
    return rows.withColumns({"called": used < limit, "again": F.col("repaired") & (used + 1 < limit)}).drop("before_", "calls_")


def baseline_calls(scopes: Column) -> Column:
    """The most calls that a component of so many scopes takes if no scope is halved: every kind of each scope and both
    reducers, each with a repair."""
    return 2 * (len(MAPPED) * scopes + 2)


def _request_id() -> Column:
    return F.concat_ws("#", "component_key", F.col("root_component").cast("string"), "split_path", "kind").alias("request_id")


def _with_shown(rows: DataFrame, shown: DataFrame | None) -> tuple[DataFrame, list[str]]:
    """The rows with what their component is shown beside its sources, and the names of these columns."""
    if shown is None:
        return rows, []
    names = [c for c in shown.columns if c not in KEY]
    return rows.join(shown, KEY, "left"), names


def map_requests(scopes: DataFrame, keep: Keep, context: DataFrame | None = None, shown: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A request (request_id, text_id, kind, the scope's columns) for each scope and kind; their texts (text_id, text), with
    the files' content, once for all kinds, see worded(); and what each may cite (request_id, path). scopes: the scope's
    columns, path, data; a scope's files are a batch at most. context: component_key, root_component, path of supporting
    files and manifests, that may be cited too. shown: a row a component with further fields of its requests, within their
    bytes: the context's content and the changes."""
    # gathered by one name, as rows that a join has dealt by component would else be gathered where they are, a component a task
    named = scopes.withColumn("text_id", F.concat_ws("#", "component_key", F.col("root_component").cast("string"), "split_path"))
    files = named.groupBy("text_id").agg(*[F.first(c).alias(c) for c in SCOPE], F.array_sort(F.collect_list(F.struct("path", F.decode("data", "utf-8").alias("data")))).alias("files"))
    each, extra = _with_shown(files, shown)
    text = F.substr(F.to_json(F.struct("component_key", "split_path", "files", *extra)), F.lit(2))
    whole = keep(each.select("text_id", *SCOPE, text.alias("text"), F.transform("files", lambda f: f["path"]).alias("paths")))
    requests = whole.select("text_id", *SCOPE, "paths", F.explode(F.array(*map(F.lit, MAPPED))).alias("kind")).select(_request_id(), "text_id", "kind", *SCOPE, "paths")
    evidence = requests.select("request_id", F.explode("paths").alias("path"))
    if context is not None:
        evidence = evidence.unionByName(requests.select("request_id", *KEY).join(context.select(*KEY, "path"), KEY).select("request_id", "path"))
    return requests.drop("paths"), whole.select("text_id", "text"), evidence.distinct()


def worded(requests: DataFrame, texts: DataFrame | None) -> DataFrame:
    """The requests with their text (request): the kind, and what their scope's requests have in common. It is made where it
    is read and not to be kept, as a scope's content would be written once for each kind. Without texts they have theirs."""
    if texts is None:
        return requests
    text = F.concat(F.lit('{"kind":"'), "kind", F.lit('",'), "text").alias("request")
    return requests.join(texts, "text_id").select(*[c for c in requests.columns if c != "text_id"], text)


def split_requests(requests: DataFrame) -> DataFrame:
    """parent and the columns of a request, with paths: each request as two, the first and the second half of its files, or
    of its only file's text, whose second half starts with the first one's last line. One without a place to cut gives no
    row. Both halves are chunks of two and one level further down the split path."""
    names = ["parent", "kind", *SCOPE, "request", "paths"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                asked = json.loads(row["request"])
                files = asked.get("files") or []
                if len(files) > 1:
                    parts = [files[: len(files) // 2], files[len(files) // 2 :]]
                else:
                    two = halves_with_overlap((files[0].get("data") or "").encode()) if files else None
                    parts = [[files[0] | {"data": x.decode()}] for x in two or []]
                for i, part in enumerate(parts):
                    at = f"{row['split_path']}/{i}"
                    text = json.dumps(asked | {"split_path": at, "files": part}, ensure_ascii=False, separators=(",", ":"))
                    child = row | {"parent": row["request_id"], "split_path": at, "chunk": i + 1, "chunk_count": len(parts), "request": text, "paths": [f["path"] for f in part]}
                    out.append([child[n] for n in names])
            yield pd.DataFrame(out, columns=names)

    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields} | {"parent": "string", "paths": "array<string>"}
    halves = requests.select("request_id", "kind", *SCOPE, "request").mapInPandas(run, ", ".join(f"{n} {types[n]}" for n in names))
    return halves.select("parent", _request_id(), "kind", *SCOPE, "request", "paths")


@dataclass
class Answers:
    """good: request_id, body; bad: request_id, code (the first); used: request_id, path; calls: request_id, calls, repaired."""

    good: DataFrame
    bad: DataFrame
    used: DataFrame
    calls: DataFrame


def _checked(answers: DataFrame, kinds: list[str], evidence: DataFrame, catalog: DataFrame, keep: Keep) -> tuple[DataFrame, DataFrame]:
    """Issues and used evidence of answers (request_id, kind, body) of several kinds."""
    out = used = None
    for kind in kinds:
        issues, cited = dossiers.validated(answers.where(F.col("kind") == kind).select("request_id", "body"), "request_id", kind, evidence, catalog, keep=keep)
        out, used = (issues, cited) if out is None else (out.unionByName(issues), used.unionByName(cited))
    return out, used


def ask(requests: DataFrame, kinds: list[str], evidence: DataFrame, catalog: DataFrame, call: Call, keep: Keep, room: DataFrame | None = None, order: list[str] = ["request_id"], texts: DataFrame | None = None) -> Answers:  # noqa: B006
    """Asks every request (request_id, kind, request; or text_id of `texts`, see worded()), checks the answers, and asks once more, with the issues, where an
    answer can be repaired. An answer that did not finish with "stop" is bad and isn't repaired: `length` is truncated,
    anything else incomplete. room (component_key, root_component, left): how many calls a component has left besides these
    first ones; repairs are made in order while there are some, and the others are bad with the code call_limit."""
    text = "request" if texts is None else "text_id"

    def one(asked: DataFrame, request: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
        said = generator.generate(worded(asked, texts).select("request_id", request.alias("request")), call)
        got = keep(said.join(asked.select("request_id", "kind"), "request_id"))
        whole = got.where("finish_reason = 'stop'")
        issues, used = _checked(whole, kinds, evidence, catalog, keep)
        early = got.where("finish_reason <> 'stop'").select("request_id", F.when(F.col("finish_reason") == "length", "truncated").otherwise("incomplete").alias("code"))
        first = issues.groupBy("request_id").agg(F.min_by("code", "place").alias("code"), F.array_sort(F.collect_list(F.struct("place", "code", "path"))).alias("issues"))
        return whole, keep(first.unionByName(early.withColumn("issues", F.lit(None).cast(first.schema["issues"].dataType)))), keep(used)

    first, wrong, used = one(requests.select("request_id", "kind", text), F.col("request"))
    repair = requests.join(wrong.where("issues is not null"), "request_id").join(first.select("request_id", "body"), "request_id")
    late = None
    if room is not None:
        nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))  # here too, texts stay out of the window
        again = requests.select(*dict.fromkeys(["request_id", *KEY, *order])).join(wrong.where("issues is not null").select("request_id"), "request_id", "left_semi")
        again = again.join(room.select(*KEY, "left"), KEY, "left").withColumn("may", nth <= F.coalesce("left", F.lit(0)))
        late = keep(again.where("not may").select("request_id", F.lit("call_limit").alias("code")))
        repair = repair.join(late.select("request_id"), "request_id", "left_anti")
    cut = (F.octet_length("body") > dossiers.MOST_FRAGMENT_BYTES).alias("invalid_is_cut")
    again = keep(repair.select("request_id", "kind", text, F.left("body", F.lit(dossiers.MOST_FRAGMENT_BYTES)).alias("invalid"), cut, "issues"))
    if late is not None:
        wrong = keep(wrong.join(late.withColumnRenamed("code", "late"), "request_id", "left").select("request_id", F.coalesce("late", "code").alias("code"), F.when(F.col("late").isNull(), F.col("issues")).alias("issues")))
    if again.isEmpty():
        good = first.join(wrong.select("request_id"), "request_id", "left_anti").select("request_id", "body")
        calls = requests.select("request_id", F.lit(1).alias("calls"), F.lit(0).alias("repaired"))
        return Answers(keep(good), wrong.select("request_id", "code"), used, calls)
    second, still, used_again = one(again, F.to_json(F.struct(F.col("request").alias("repair_of"), "invalid", "invalid_is_cut", "issues")))
    good = first.join(wrong.select("request_id"), "request_id", "left_anti").unionByName(second.join(still.select("request_id"), "request_id", "left_anti")).select("request_id", "body")
    bad = wrong.where("issues is null").select("request_id", "code").unionByName(still.select("request_id", "code"))
    cited = used.join(again.select("request_id"), "request_id", "left_anti").unionByName(used_again).join(good.select("request_id"), "request_id", "left_semi")
    calls = requests.select("request_id").join(again.select("request_id", F.lit(1).alias("r")), "request_id", "left").select("request_id", (F.lit(1) + F.coalesce("r", F.lit(0))).alias("calls"), F.coalesce("r", F.lit(0)).alias("repaired"))
    return Answers(keep(good), keep(bad), cited, calls)


def merged_sections(bodies: DataFrame, most_items: int | None = merge.MOST_ITEMS) -> DataFrame:
    """component_key, root_component, section, position, name, content, paths, support: the items of all scopes' fragments
    (component_key, root_component, kind, body), equal ones as one with all their evidence, the `most_items` best supported
    of each section, or all. content is the item as JSON, without its evidence."""
    rows = None
    for section in SECTIONS:
        item = F.explode(F.from_json("body", dossiers.body_type(section))["items"]).alias("x")
        each = bodies.where(F.col("kind") == section).select(*KEY, F.lit(section).alias("section"), item)
        content = F.to_json(F.struct(*[F.col(f"x.{f[0]}").alias(f[0]) for f in dossiers.SPEC[section] if f[0] != "source_paths"]))
        one = each.select(*KEY, "section", F.coalesce(F.col(f"x.{NAMES[section]}"), F.lit("")).alias("name"), content.alias("content"), F.explode_outer("x.source_paths").alias("path"))
        rows = one if rows is None else rows.unionByName(one)
    group = [*KEY, "section"]
    return merge.best_supported(merge.merged(rows, ["name", "content"], group), group, "name", most_items).select(*group, "position", "name", "content", "paths", "support")


def projection(sections: DataFrame) -> DataFrame:
    """component_key, root_component, section, count, names: what the overview's reducer is shown: how many items a section
    has and the names of its first; of gaps the number only."""
    shown = dossiers.first_names(sections, [*KEY, "section"], "name", "position", PROJECTED)
    return shown.withColumn("names", F.when(F.col("section") == "review_gaps", F.array().cast("array<string>")).otherwise(F.col("names")))


def diagram_projection(sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """component_key, root_component, items: the first items of architecture, data models and workflows, with bounded
    evidence and nested lists, for the diagram's reducer; and the evidence that it may cite."""
    some = sections.where(F.col("section").isin("architecture", "data_models", "workflows") & (F.col("position") <= PROJECTED)).withColumn("paths", F.slice("paths", 1, dossiers.FRAGMENT_LIMITS["source_paths"]))
    limits = dossiers.FRAGMENT_LIMITS
    model, flow = F.from_json("content", dossiers.item_type("data_models")), F.from_json("content", dossiers.item_type("workflows"))
    nested = F.when(F.col("section") == "data_models", F.to_json(F.slice(model["relationships"], 1, limits["relationships"]))).when(F.col("section") == "workflows", F.to_json(F.slice(flow["steps"], 1, limits["steps"])))
    rows = some.select(*KEY, "section", "position", "name", "paths", nested.alias("nested"))
    items = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("section", "position", "name", "paths", "nested"))).alias("items"))
    return items, rows.select(*KEY, F.explode("paths").alias("path")).distinct()


def _identified(rows: DataFrame, kind: str, request: Column) -> DataFrame:
    name = F.concat_ws("#", "component_key", F.col("root_component").cast("string"), F.lit(kind))
    return rows.select(name.alias("request_id"), F.lit(kind).alias("kind"), *KEY, request.alias("request"))


def _left(components: DataFrame, spent: DataFrame, limit: int) -> DataFrame:
    """component_key, root_component, left: the calls that components may still make."""
    used = F.coalesce("calls", F.lit(0))
    return components.select(*KEY).distinct().join(spent.select(*KEY, "calls"), KEY, "left").select(*KEY, F.greatest(F.lit(limit) - used, F.lit(0)).cast("long").alias("left"))


def _spent(calls: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [c.select(*KEY, "calls") for c in calls]).groupBy(*KEY).agg(total("calls").alias("calls"))


def _reduced(requests: DataFrame, kind: str, evidence: DataFrame, catalog: DataFrame, call: Call, keep: Keep, spent: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An optional reducer: component_key, root_component, body of the good answers, its calls, and the components that
    reached their limit of calls. An answer that isn't good falls back; the limit does not, it fails the component."""
    requests = keep(requests.join(_left(requests, spent, limit), KEY))
    may = requests.where("left > 0")
    got = ask(may.drop("left"), [kind], evidence, catalog, call, keep, may.select(*KEY, (F.col("left") - 1).alias("left")))
    over = requests.where("left = 0").select(*KEY).unionByName(may.join(got.bad.where("code = 'call_limit'"), "request_id").select(*KEY))
    return may.join(got.good, "request_id").select(*KEY, "body"), keep(may.select("request_id", *KEY).join(got.calls, "request_id")), keep(over)


def assembled(sections: DataFrame, overviews: DataFrame, diagrams: DataFrame, components: DataFrame, evidence: DataFrame) -> DataFrame:
    """component_key, root_component and a dossier's columns: the sections in order, title and purpose of the overview
    (component_key, root_component, title, purpose) or made from the key, the diagrams (a body each) or none, and the
    cited paths, the first of them in order. Lists hold what the sections' bounds let through."""
    out = components.select(*KEY).distinct()
    for section in SECTIONS:
        item = F.from_json("content", dossiers.item_type(section))
        full = F.struct(*[(F.col("paths") if f[0] == "source_paths" else item[f[0]]).alias(f[0]) for f in dossiers.SPEC[section]])
        listed = sections.where(F.col("section") == section).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("position", full.alias("i")))).alias("l"))
        out = out.join(listed.select(*KEY, F.transform("l", lambda x: x["i"]).alias(section)), KEY, "left")
        out = out.withColumn(section, F.coalesce(section, F.array().cast(f"array<{dossiers.item_type(section)}>")))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("path"))
    paths = evidence.withColumn("nth", nth).where(F.col("nth") <= merge.MOST_PATHS).groupBy(*KEY).agg(F.array_sort(F.collect_list("path")).alias("source_paths"))
    drawn = diagrams.select(*KEY, F.from_json("body", dossiers.body_type("diagrams"))["items"].alias("diagrams"))
    out = out.join(paths, KEY, "left").join(overviews.select(*KEY, "title", "purpose"), KEY, "left").join(drawn, KEY, "left")
    name = fallback_title(F.col("component_key"))
    none = F.array().cast(f"array<{dossiers.item_type('diagrams')}>")
    return out.select(*KEY, F.coalesce("title", name).alias("title"), F.coalesce("purpose", F.concat(F.lit("Provides the responsibilities of "), name, F.lit("."))).alias("purpose"), F.coalesce("source_paths", F.array().cast("array<string>")).alias("source_paths"), *SECTIONS, F.coalesce("diagrams", none).alias("diagrams"))


def dossier_issues(found: DataFrame, evidence: DataFrame, catalog: DataFrame) -> DataFrame:
    """The whole contract held against assembled dossiers, once more: component_key, place, code, path. A diagram is
    written with its own lists only."""
    drawn = F.transform("diagrams", lambda d: F.from_json(F.to_json(dossiers.normalised_diagram(d)), dossiers.item_type("diagrams")))
    body = F.to_json(F.struct("title", "purpose", "source_paths", *SECTIONS, drawn.alias("diagrams")))
    rows = found.select("component_key", body.alias("body"))
    return dossiers.validated(rows, "component_key", "dossier", evidence.select("component_key", "path"), catalog)[0]


@dataclass
class Generated:
    """dossiers; failures (component_key, root_component, category); stats (component_key, root_component, calls,
    repairs, overview_fallback, diagram_fallback); coverage of fragments, see Mapped."""

    dossiers: DataFrame
    failures: DataFrame
    stats: DataFrame
    coverage: DataFrame | None = None


@dataclass
class Mapped:
    """bodies (component_key, root_component, kind, body) of the answers that count; used (component_key, root_component,
    path); failures (component_key, root_component, category); calls (component_key, root_component, calls, repaired);
    coverage (component_key, root_component, kind, split_path, state) of required kinds, state one of complete, saturated,
    replaced and pending."""

    bodies: DataFrame
    used: DataFrame
    failures: DataFrame
    calls: DataFrame
    coverage: DataFrame


def mapped(scopes: DataFrame, catalog: DataFrame, call: Call, keep: Keep, limit: int, depth: int, context: DataFrame | None = None, spent: DataFrame | None = None, shown: DataFrame | None = None) -> Mapped:
    """Asks each scope for each kind. A required answer that was cut off, or whose list is saturated (not complete, or as
    long as it may be), is replaced by its scope's two halves, `depth` times at most; all that are open are asked at once,
    a level at a time. Where nothing can be halved, a saturated answer stays and one that was cut off fails its component,
    as any other bad answer does, and as the limit of calls does, which repairs count against too. `spent`
    (component_key, root_component, calls) was called before. Components that failed aren't asked further."""
    bodies, used, failed, calls, coverage = [], [], [], [], []
    order = ["batch", "chunk", "split_path", "kind"]
    before = spent
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    open_, texts, evidence = map_requests(scopes, keep, context, shown)
    evidence = keep(evidence)
    sizes = F.element_at(F.create_map(*[F.lit(x) for k in SECTIONS for x in (k, dossiers.FRAGMENT_ITEMS[k])]), F.col("kind"))
    saturated = (F.get_json_object("body", "$.complete") == "false") | (F.json_array_length(F.get_json_object("body", "$.items")) == sizes)
    for level in range(depth + 1):
        open_, over = within_budget(keep(open_), spent, limit, order)
        open_ = keep(open_)
        asked = open_.groupBy(*KEY).agg(F.count(F.lit(1)).alias("calls"))
        room = keep(_left(open_, asked if spent is None else _spent([asked, spent]), limit))
        got = ask(open_, MAPPED, evidence, catalog, call, keep, room, order, texts)
        required = F.col("kind") != "overview_candidate"
        state = F.when(F.col("body").isNull(), F.col("code")).when(required & saturated, "saturated").otherwise("complete")
        answers = open_.select("request_id", "kind", *KEY, "split_path").join(got.good, "request_id", "left").join(got.bad, "request_id", "left")
        answers = keep(answers.withColumn("state", state))
        twice = None
        cut = answers.where(required & F.col("state").isin("truncated", "saturated")).select("request_id")
        if level < depth and not cut.isEmpty():
            twice = keep(split_requests(worded(open_.join(cut, "request_id", "left_semi"), texts)))
            parents = twice.select(F.col("parent").alias("request_id")).distinct()
            coverage.append(answers.join(parents, "request_id", "left_semi").where(required).select(*KEY, "kind", "split_path", F.lit("replaced").alias("state")))
            answers = answers.join(parents, "request_id", "left_anti")
        ends = F.when(F.col("body").isNull(), "pending").otherwise(F.col("state")).alias("state")
        coverage.append(answers.where(required).select(*KEY, "kind", "split_path", ends))
        bodies.append(answers.where("body is not null").select(*KEY, "kind", "body"))
        used.append(answers.where("body is not null").join(got.used, "request_id").select(*KEY, "path"))
        category = F.when(F.col("state").isin("truncated", "incomplete", "call_limit"), F.col("state")).otherwise("schema_validation").alias("category")
        stops = F.col("body").isNull() & (required | (F.col("state") == "call_limit"))
        failed += [over.withColumn("category", F.lit("call_limit")), answers.where(stops).select(*KEY, category)]
        calls.append(open_.select("request_id", *KEY).join(got.calls, "request_id"))
        if twice is None or level == depth:
            break
        failed = [keep(union(failed))]
        open_ = keep(twice.join(failed[0].select(*KEY).distinct(), KEY, "left_anti"))
        if open_.isEmpty():
            break
        evidence = open_.select("request_id", F.explode("paths").alias("path"))
        if context is not None:
            evidence = evidence.unionByName(open_.select("request_id", *KEY).join(context.select(*KEY, "path"), KEY).select("request_id", "path"))
        evidence, open_, texts = keep(evidence.distinct()), open_.drop("parent", "paths"), None  # halves have texts of their own
        spent = keep(_spent([*calls, *([] if before is None else [before])]))
    failures = keep(union(failed).groupBy(*KEY).agg(F.min("category").alias("category")))
    return Mapped(union(bodies), keep(union(used).distinct()), failures, union(calls), union(coverage))


def by_fragments(scopes: DataFrame, catalog: DataFrame, call: Call, keep: Keep, limit: int = 80, context: DataFrame | None = None, depth: int = SPLIT_DEPTH, spent: DataFrame | None = None, shown: DataFrame | None = None, most_items: int | None = merge.MOST_ITEMS) -> Generated:
    """Dossiers from fragments: each scope is asked for each kind and halved where its answer is cut off or saturated (see
    mapped), required kinds must come good or their component fails, overview candidates need not; items are merged, then
    overview and diagrams are reduced, each with a fall-back. A component's limit counts every call, repairs and reducers
    too, and those that were made before (`spent`). shown: see map_requests(). Sections hold `most_items` items, or all."""
    got = mapped(scopes, catalog, call, keep, limit, depth, context, spent, shown)
    before = [] if spent is None else [spent]
    failures = got.failures
    bodies = got.bodies.join(failures, KEY, "left_anti")
    live = scopes.select(*KEY).distinct().join(failures, KEY, "left_anti")
    sections = keep(merged_sections(bodies, most_items))
    used = got.used.join(failures, KEY, "left_anti")

    candidates = bodies.where("kind = 'overview_candidate'").select(*KEY, F.from_json("body", dossiers.body_type("overview_candidate")).alias("c"), "body")
    shown = projection(sections).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("section", "count", "names"))).alias("sections"))
    some = candidates.groupBy(*KEY).agg(F.array_sort(F.collect_list("body")).alias("candidates")).join(shown, KEY, "left")
    asked = _identified(some, "overview", F.to_json(F.struct(F.lit("overview").alias("kind"), "component_key", "candidates", "sections")))
    may = asked.select("request_id", *KEY).join(used, KEY).select("request_id", "path")
    calls = keep(_spent([got.calls, *before]))
    overview, overview_calls, over = _reduced(asked, "overview", may, catalog, call, keep, calls, limit)
    live = keep(live.join(over, KEY, "left_anti"))
    titles = overview.select(*KEY, F.from_json("body", dossiers.body_type("overview")).alias("o")).select(*KEY, "o.title", "o.purpose")
    first = candidates.select(*KEY, F.element_at("c.source_paths", 1).alias("path"), F.col("c.title").alias("title"), F.col("c.purpose").alias("purpose"))
    picked = merge.overview(first, KEY, "title", "purpose", None)
    titles = keep(picked.select(*KEY, F.col("title").alias("t"), F.col("purpose").alias("p")).join(titles, KEY, "left").select(*KEY, F.coalesce("title", "t").alias("title"), F.coalesce("purpose", "p").alias("purpose"), F.col("title").isNotNull().alias("reduced")))

    shown, cites = diagram_projection(sections)
    asked = _identified(live.join(shown, KEY, "left"), "diagrams", F.to_json(F.struct(F.lit("diagrams").alias("kind"), "component_key", "items")))
    may = asked.select("request_id", *KEY).join(cites, KEY).select("request_id", "path")
    drawn, diagram_calls, over_too = _reduced(asked, "diagrams", may, catalog, call, keep, keep(_spent([calls, overview_calls])), limit)
    drawn, live = keep(drawn), keep(live.join(over_too, KEY, "left_anti"))
    failures = keep(failures.unionByName(over.unionByName(over_too).distinct().withColumn("category", F.lit("call_limit"))))
    out = keep(assembled(sections, titles, drawn, live, used))
    calls = got.calls.unionByName(overview_calls).unionByName(diagram_calls)
    stats = calls.groupBy(*KEY).agg(total("calls").alias("calls"), total("repaired").alias("repairs")).join(titles.select(*KEY, "reduced"), KEY, "left").join(drawn.select(*KEY, F.lit(True).alias("drawn")), KEY, "left")
    stats = stats.select(*KEY, "calls", "repairs", (~F.coalesce("reduced", F.lit(False))).alias("overview_fallback"), F.col("drawn").isNull().alias("diagram_fallback"))
    return Generated(out, failures, keep(stats), got.coverage)


def by_dossier(batches: DataFrame, catalog: DataFrame, call: Call, keep: Keep, shown: DataFrame | None = None, limit: int | None = None) -> Generated:
    """Dossiers at once, or batch by batch with a synthesis that may cite only what its batches cited. batches:
    component_key, root_component, batch, path, data; a component of one batch is one request. Any bad answer fails its
    component, by the category of the first in order. shown: see map_requests(). With a limit of calls, repairs beyond it
    aren't made."""
    files = batches.groupBy(*KEY, "batch").agg(F.array_sort(F.collect_list(F.struct("path", F.decode("data", "utf-8").alias("data")))).alias("files"))
    name = F.concat_ws("#", "component_key", F.col("root_component").cast("string"), F.concat(F.lit("batch"), F.col("batch").cast("string")))
    files, extra = _with_shown(files, shown)
    requests = keep(files.select(name.alias("request_id"), F.lit("dossier").alias("kind"), *KEY, "batch", F.to_json(F.struct(F.lit("dossier").alias("kind"), "component_key", "batch", "files", *extra)).alias("request"), F.transform("files", lambda f: f["path"]).alias("paths")))
    room = None if limit is None else _left(requests, requests.groupBy(*KEY).agg(F.count(F.lit(1)).alias("calls")), limit)
    got = ask(requests.drop("paths"), ["dossier"], requests.select("request_id", F.explode("paths").alias("path")), catalog, call, keep, room, ["batch"])
    named = requests.select("request_id", *KEY, "batch")
    category = F.when(F.col("code").isin("truncated", "incomplete", "call_limit"), F.col("code")).otherwise("schema_validation")
    failed = keep(named.join(got.bad, "request_id").groupBy(*KEY).agg(F.min_by(category, "batch").alias("category")))
    counts = named.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    good = keep(named.join(got.good, "request_id").join(failed, KEY, "left_anti").join(counts, KEY))
    parts = good.where("n > 1").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("batch", "body"))).alias("parts"))
    again = keep(_identified(parts, "dossier", F.to_json(F.struct(F.lit("synthesis").alias("kind"), "component_key", "parts"))))
    if again.isEmpty():
        calls = named.select("request_id", *KEY).join(got.calls, "request_id")
        stats = calls.groupBy(*KEY).agg(total("calls").alias("calls"), total("repaired").alias("repairs")).select("*", F.lit(False).alias("overview_fallback"), F.lit(False).alias("diagram_fallback"))
        whole = good.select(*KEY, F.from_json("body", dossiers.DOSSIER).alias("d")).select(*KEY, "d.*")
        return Generated(keep(whole), failed, keep(stats))
    cited = again.select("request_id", *KEY).join(named.join(got.used, "request_id").select(*KEY, "path").distinct(), KEY).select("request_id", "path")
    made = ask(again, ["dossier"], cited, catalog, call, keep)
    final = good.where("n = 1").select(*KEY, "body").unionByName(again.join(made.good, "request_id").select(*KEY, "body"))
    late = again.join(made.bad, "request_id").select(*KEY, category.alias("category"))
    calls = named.select("request_id", *KEY).join(got.calls, "request_id").unionByName(again.select("request_id", *KEY).join(made.calls, "request_id"))
    stats = calls.groupBy(*KEY).agg(total("calls").alias("calls"), total("repaired").alias("repairs")).select("*", F.lit(False).alias("overview_fallback"), F.lit(False).alias("diagram_fallback"))
    return Generated(keep(final.select(*KEY, F.from_json("body", dossiers.DOSSIER).alias("d")).select(*KEY, "d.*")), keep(failed.unionByName(late)), keep(stats))


def automatic(batches: DataFrame, scopes: DataFrame, catalog: DataFrame, call: Call, keep: Keep, limit: int = 80, depth: int = SPLIT_DEPTH, context: DataFrame | None = None, shown: DataFrame | None = None) -> Generated:
    """One request for each component that fits one (it has a single batch); those whose answer was cut off, and no others, go
    on to fragments, as components of `scopes` do that don't fit. Both share the limit of calls."""
    small = keep(batches.groupBy(*KEY).agg(F.count_distinct("batch").alias("n")).where("n = 1").select(*KEY))
    large = scopes.select(*KEY).distinct().join(small, KEY, "left_anti")
    once = by_dossier(batches.join(small, KEY, "left_semi"), catalog, call, keep, shown, limit)
    cut = once.failures.where("category = 'truncated'").select(*KEY)
    rest = keep(cut.unionByName(large))
    if rest.isEmpty():
        return once
    spent = keep(once.stats.join(cut, KEY, "left_semi").select(*KEY, "calls"))
    made = by_fragments(scopes.join(rest, KEY, "left_semi"), catalog, call, keep, limit, context, depth, spent, shown)
    stats = once.stats.unionByName(made.stats).groupBy(*KEY).agg(total("calls").alias("calls"), total("repairs").alias("repairs"), F.bool_or("overview_fallback").alias("overview_fallback"), F.bool_or("diagram_fallback").alias("diagram_fallback"))
    return Generated(once.dossiers.unionByName(made.dossiers.select(*once.dossiers.columns)), once.failures.join(cut, KEY, "left_anti").unionByName(made.failures), stats, made.coverage)


# --- bounds that hold before any call


def largest_fragment(kind: str) -> dict:
    """A fragment of a kind that is as large as its limits allow; of diagrams the largest of the three types."""
    limits = dossiers.FRAGMENT_LIMITS
    paths = [("p" * (limits["path"] - 1)) + str(i) for i in range(limits["source_paths"])]

    def of(fields: list) -> dict:
        out = {}
        for name, rule, more, _ in fields:
            if rule == "list":
                out[name] = [of(more)] * limits[name]
            elif rule == "evidence":
                out[name] = paths
            elif rule == "labels":
                out[name] = ["x" * limits["diagram_label"]] * limits["members"]
            elif rule == "enum":
                out[name] = max(dossiers.ENUMS[more], key=len)
            elif rule == "flag":
                out[name] = False
            else:
                out[name] = "x" * (limits["path"] if rule == "dependency" else limits["diagram_key"] if rule in ("key", "ref") else limits["diagram_label"] if rule == "label" else limits[more])
        return out

    if kind == "overview_candidate":
        return of(dossiers.CANDIDATE)
    head = {"complete": False, "omitted_count": dossiers.MOST_OMITTED}
    if kind != "diagrams":
        return head | {"items": [of(dossiers.SPEC[kind])] * dossiers.FRAGMENT_ITEMS[kind]}
    every = []
    for name, lists in dossiers.DIAGRAMS.items():
        parts = {n: [of(f)] * limits["class_relationships" if n == "relationships" else n] for n, f in lists}
        every.append(head | {"items": [{"type": name, "title": "x" * limits["title"], "source_paths": paths} | parts]})
    return max(every, key=canonical_bytes)


def canonical_bytes(value: dict) -> int:
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode())


def repair_bytes(request_bytes: int) -> int:
    """The most that a repair may take: the request, an answer of which every byte is escaped to six, and all issues."""
    issues = MOST_ISSUES * (6 * sum(ISSUE_BYTES.values()) + 64)
    return request_bytes + 6 * dossiers.MOST_FRAGMENT_BYTES + issues


def profile(request_bytes: dict[str, int]) -> dict[str, int]:
    """What a provider has to be able to do, for requests of so many bytes by kind: the largest answer and repair."""
    return {"canonical_bytes": max(canonical_bytes(largest_fragment(k)) for k in [*MAPPED, "diagrams"]), "repair_bytes": max(map(repair_bytes, request_bytes.values()), default=0), "output_tokens": MINIMUM_OUTPUT_TOKENS, "response_bytes": MINIMUM_RESPONSE_BYTES}


def profile_problems(needed: dict[str, int], output_tokens: int, response_bytes: int, request_limit: int) -> list[str]:
    checks = [
        (needed["canonical_bytes"] <= needed["output_tokens"], "a fragment may need more output tokens than the profile has"),
        (needed["canonical_bytes"] <= needed["response_bytes"], "a fragment may need more bytes than the profile has"),
        (output_tokens >= needed["output_tokens"], f"at least {needed['output_tokens']} output tokens are needed"),
        (response_bytes >= needed["response_bytes"], f"at least {needed['response_bytes']} response bytes are needed"),
        (request_limit >= needed["repair_bytes"], f"at least {needed['repair_bytes']} request bytes are needed for the largest repair"),
    ]
    return [text for ok, text in checks if not ok]


def reducer_bytes(scopes: Column) -> tuple[Column, Column]:
    """The most bytes of an overview's and a diagram's reducer for so many scopes: every candidate and name at its limit."""
    limits = dossiers.FRAGMENT_LIMITS
    candidate = canonical_bytes(largest_fragment("overview_candidate"))
    names = len(SECTIONS) * (PROJECTED * (limits["title"] + 3) + 64)
    nested = PROJECTED * (limits["title"] + limits["source_paths"] * (limits["path"] + 3) + 5 * (2 * limits["name"] + limits["short_text"]))
    return scopes.cast("long") * (2 * candidate) + names + 1024, F.lit(3 * nested + 1024).cast("long")


def typed_stub(request: str) -> tuple[str, str]:
    """A deterministic, valid answer to any request made here: it cites the first path that it was shown."""
    asked = json.loads(request)
    asked = json.loads(asked["repair_of"]) if "repair_of" in asked else asked
    kind, paths = asked["kind"], sorted(f["path"] for f in asked.get("files") or [])[:1]
    at = asked.get("split_path", "all")
    items = {
        "architecture": {"title": f"Part {at}", "description": "Holds code."}, "interfaces": {"name": "Entry", "kind": "function", "direction": "inbound", "description": "Is called."}, "data_models": {"name": "Row", "kind": "entity", "description": "A row.", "fields": [], "relationships": []},
        "workflows": {"name": "Run", "description": "Runs.", "steps": [{"actor": "User", "action": "starts it", "target": ""}]}, "dependencies": {"name": "platform", "kind": "tool", "purpose": "Runs it.", "component_key": ""}, "review_gaps": {"kind": "uncertainty", "description": f"Unclear in {at}.", "recommendation": "Ask."},
    }
    if kind in items:
        body = {"complete": True, "omitted_count": 0, "items": [items[kind] | {"source_paths": paths}]}
    elif kind == "diagrams":
        cites = [p for i in asked.get("items") or [] for p in i["paths"]][:1]
        body = {"complete": True, "items": [{"type": "flowchart", "title": "Parts", "source_paths": cites, "nodes": [{"key": "a", "label": "Part"}], "edges": []}] if cites else []}
    elif kind in ("overview", "overview_candidate"):
        body = {"title": "Component", "purpose": "Does its work."} | ({"source_paths": paths} if kind == "overview_candidate" else {})
    else:
        cites = paths or sorted(p for part in asked.get("parts") or [] for p in json.loads(part["body"])["source_paths"])[:1]
        body = {"title": "Component", "purpose": "Does its work.", "source_paths": cites} | {k: [items[k] | {"source_paths": cites}] if k == "architecture" else [] for k in dossiers.KINDS}
    return json.dumps(body), "stop"
