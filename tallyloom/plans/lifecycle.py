"""plan, sync and check over DataFrames: tracked files and a prior state in, actions, documents and a verdict out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import component_page
from ..functions.text import content_hash
from ..operators import changes, components, documents, fragments, output, packing, planning, rendering
from ..operators.classify import SourcePolicy, language_histogram, scan, secret_content
from ..sources import records
from ..sources.journal import FileTree, content_id
from ..sources.sinks import VersionedStore, write_state
from ..sources.tables import stored

VERSIONS = {"schema_version": "1", "generator_version": "1", "planner_version": "2", "prompt_version": "1", "render_version": "1", "output_schema_version": "1"}
KEY = ["component_key", "root_component"]
STATE_FILES = "path string, source_hash string, role string, triggers boolean, component_key string, root_component boolean"
STATE_COMPONENTS = "component_key string, root_component boolean, input_hash string"


class StaleError(RuntimeError):
    """What is installed isn't what the sources ask for."""

    exit_code = 2


@dataclass(frozen=True)
class Settings:
    policy: SourcePolicy = field(default_factory=SourcePolicy)
    roots: tuple[str, ...] = ()
    explicit: bool = False
    batch_bytes: int = 80_000
    context_bytes: int = 120_000
    supporting_bytes: int = 20_000
    manifest_bytes: int = 20_000
    docs_dir: str = "docs"
    request_bytes: int = 500_000
    response_bytes: int = 65_536
    output_tokens: int = 8_192
    call_limit: int = 80
    split_depth: int = 3
    strategy: str = "dossier"

    def problems(self) -> list[str]:
        out = [f"{n} must be positive" for n in ("batch_bytes", "context_bytes", "supporting_bytes", "manifest_bytes", "request_bytes", "call_limit") if getattr(self, n) <= 0]
        out += [f"unknown strategy {self.strategy}"] * (self.strategy not in ("auto", "dossier", "fragments"))
        out += ["batch_bytes must not exceed context_bytes"] * (self.batch_bytes > self.context_bytes)
        out += ["explicit needs roots"] * (self.explicit and not self.roots)
        return out

    def hashes(self) -> dict[str, str]:
        """A hash for each group of settings, and `aggregate`, the hash of them all."""
        groups = {
            "paths": [self.docs_dir, self.policy.state_path], "source": [str(self.policy)], "components": [self.roots, self.explicit],
            "context": [self.batch_bytes, self.context_bytes, self.supporting_bytes, self.manifest_bytes, self.request_bytes], "generation": [self.strategy, self.call_limit, self.split_depth, self.response_bytes, self.output_tokens],
        }
        found = {g: content_id(json.dumps(v).encode()) for g, v in groups.items()}
        return found | {"aggregate": content_id(json.dumps(found).encode())}


@dataclass
class Prior:
    """The state that a run finds. status is missing, invalid or valid; hashes are those of Settings.hashes()."""

    status: str = "missing"
    files: DataFrame | None = None
    components: DataFrame | None = None
    versions: dict[str, str] = field(default_factory=dict)
    hashes: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(files: DataFrame | None, components: DataFrame | None, settings: Settings) -> Prior:
        """A state that this version left under the same settings, or none."""
        return Prior() if files is None else Prior("valid", files, components, VERSIONS, settings.hashes())

    def compatible(self) -> bool:
        return self.status == "valid" and self.versions == VERSIONS

    def impact(self, settings: Settings) -> set[str]:
        """Which groups of settings differ, "unknown" where the state doesn't tell."""
        now = settings.hashes()
        if not self.compatible() or self.hashes.get("aggregate") == now["aggregate"]:
            return set()
        if any(not self.hashes.get(g) for g in planning.CONFIG_GROUPS):
            return {"unknown"}
        return {g for g in planning.CONFIG_GROUPS if self.hashes[g] != now[g]}


def prior(store: VersionedStore | FileTree) -> Prior:
    """What the last sync() on this store left, checked."""
    kept = store.kept_state()
    if kept is None:
        return Prior()
    try:
        files, parts = (store.spark.read.parquet(f"{store.root}/{kept['at']}/{name}") for name in ("files", "components"))
    except AnalysisException:
        return Prior("invalid")
    if not records.table_issues(files).isEmpty():
        return Prior("invalid")
    return Prior("valid", files, parts, kept["versions"], kept["hashes"])


@dataclass
class Plan:
    files: DataFrame
    hashes: DataFrame
    changes: DataFrame
    actions: DataFrame
    reason: str | None
    decisions: DataFrame
    selected: DataFrame
    context: DataFrame

    def is_noop(self) -> bool:
        return self.actions.where("action <> 'skip_unchanged'").isEmpty()


def full_run_reason(found: Prior, settings: Settings, full: bool, base_found: bool) -> str | None:
    """The first reason for which everything is done anew."""
    checks = [
        (full, "explicit_full"), (not base_found, "base_revision_unavailable"), (found.status == "missing", "state_missing"), (found.status == "invalid", "state_invalid"),
        (not found.compatible(), "state_incompatible"), ("paths" in found.impact(settings), "output_paths_changed"),
    ]
    return next((why for holds, why in checks if holds), None)


def plan(tracked: DataFrame, old_files: DataFrame | None, old_components: DataFrame | None, settings: Settings = Settings(), full: bool = False, state: Prior | None = None, feed: DataFrame | None = None, base_found: bool = True, keep: Callable[[DataFrame], DataFrame] = stored) -> Plan:
    """Which components a run has to create, regenerate, delete or may skip, and why.

    The state is `state`, or else the two tables as Prior.of() takes them. feed (status, old_path, new_path) is what version
    control tells of a range of revisions; without it changes are found by comparing the files with the state's. A run
    over all components has one reason of six; else changes, owners and differing settings select."""
    spark = tracked.sparkSession
    if found := settings.problems():
        raise ValueError("; ".join(found))
    state = state or Prior.of(old_files, old_components, settings)
    reason = full_run_reason(state, settings, full, base_found)
    old_files = spark.createDataFrame([], STATE_FILES) if state.files is None else state.files
    old_components = spark.createDataFrame([], STATE_COMPONENTS) if state.components is None else state.components
    decisions = scan(tracked, settings.policy)
    files = tracked.select("path", "data", "size").join(decisions.where("included").select("path", "role", "triggers"), "path").withColumn("source_hash", content_hash(F.coalesce("data", F.lit(""))))
    files = components.component_key(files, settings.roots, settings.explicit)
    narrow = keep(components.digested(files))
    told = spark.createDataFrame([], "status string, old_path string, new_path string") if feed is None else feed.select("status", "old_path", "new_path")
    raw = planning.change_source("" if feed is None else "range", state.compatible(), old_files, narrow, told)
    norm = keep(changes.normalized(raw, old_files, narrow))
    shown = keep(components.context(narrow, settings.supporting_bytes, settings.manifest_bytes))
    hashes = keep(components.input_hash(narrow, tuple(VERSIONS.values()), settings.hashes()["aggregate"], shown, norm))
    chosen = planning.selected(old_files, narrow, norm, state.impact(settings), reason)
    actions = changes.actions(chosen, hashes, old_components, full=reason is not None)
    return Plan(files, hashes, norm, actions, reason, decisions, chosen, shown)


class GenerationError(RuntimeError):
    """A component has no dossier: which, and the category of the failure."""

    exit_code = 5


class OutputError(RuntimeError):
    """The documents that were made must not be installed."""

    exit_code = 6


#: Bytes of changes that a request tells of.
CHANGE_BYTES = 20_000


def shown_fields(p: Plan, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """component_key, root_component, context, changes: what a component's requests hold beside its sources, one row each: the
    supporting files and manifests within their bytes, with content, and the changes in path order as far as theirs reach."""
    texts = p.context.join(p.files.select("path", "data"), "path").groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("kind", "path", "data"))).alias("context"))
    told = changes.component_changes(p.changes)
    so_far = F.sum(F.octet_length("path") + F.octet_length("status")).over(Window.partitionBy(*KEY).orderBy("path", "status"))
    told = told.withColumn("bytes", so_far).where(F.col("bytes") <= CHANGE_BYTES).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("path", "status"))).alias("changes"))
    return keep(texts.join(told, KEY, "full_outer"))


def generated(p: Plan, settings: Settings, keep: Callable[[DataFrame], DataFrame], call: Callable[[str], tuple[str, str]]) -> fragments.Generated:
    """A dossier for each component that the plan makes anew, by the strategy that the settings ask for. For fragments, and
    for `auto`, which may fall back to them, the provider's profile and the most calls that a component may take are checked
    before anything is called."""
    fresh = p.actions.where("action in ('create', 'regenerate')").select(*KEY)
    files = p.files.where("triggers").join(fresh, KEY, "left_semi").select(*KEY, "path", "data", "size")
    catalog, shown = p.files.select("component_key").distinct(), shown_fields(p, keep)
    context = p.context.select(*KEY, "path")
    if settings.strategy != "dossier":
        needed = fragments.profile({"map": 0})
        if found := fragments.profile_problems(needed, settings.output_tokens, settings.response_bytes, settings.request_bytes):
            raise GenerationError("; ".join(found))
        scopes = _scopes(files, settings, keep)
    if settings.strategy == "fragments":
        return fragments.by_fragments(scopes, catalog, call, keep, settings.call_limit, context, settings.split_depth, shown=shown)
    batches = packing.greedy_batches(files, settings.context_bytes, "error" if settings.strategy == "dossier" else "alone").select(*KEY, "path", "batch")
    rows = keep(files.join(batches, [*KEY, "path"]).select(*KEY, "batch", "path", F.encode("data", "utf-8").alias("data")))
    if settings.strategy == "dossier":
        return fragments.by_dossier(rows, catalog, call, keep, shown)
    sizes = rows.groupBy(*KEY).agg(_request_bytes(F.count(F.lit(1)), F.sum(F.length("data"))).alias("bytes"))
    fits = sizes.join(shown.select(*KEY, F.octet_length(F.to_json(F.struct("context", "changes"))).alias("more")), KEY, "left").where(F.col("bytes") + F.coalesce("more", F.lit(0)) <= settings.request_bytes)
    return fragments.automatic(rows.join(fits, KEY, "left_semi"), scopes, catalog, call, keep, settings.call_limit, settings.split_depth, context, shown)


def _request_bytes(n: Column, size: Column) -> Column:
    return size + 64 * n + 1024


def _scopes(files: DataFrame, settings: Settings, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    more = 2 if settings.strategy == "auto" else 0
    cut = planning.refined_scopes(planning.source_scopes(files, settings.batch_bytes), _request_bytes, settings.request_bytes, keep, ceiling=lambda n: fragments.baseline_calls(n) + more, call_limit=settings.call_limit)
    return keep(planning.numbered_scopes(cut))


def documents_of(p: Plan, dossiers: DataFrame, live: DataFrame, docs_dir: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """path, content of the whole document set: fresh dossiers, and what is installed of the components that stay."""
    decisions = p.decisions
    parts = keep(p.files.where("triggers").select(*KEY).distinct())
    page = component_page(docs_dir, F.col("component_key"), F.col("root_component"))
    named = keep(parts.withColumn("document", page))
    stay = named.join(dossiers.select(*KEY), KEY, "left_anti")
    found, _ = rendering.sections(live, "path", "content")
    reused = found.select("topic", F.col("key").alias("component_key"), "content").join(stay.select(*KEY), "component_key")
    pages = live.join(stay.select(F.col("document").alias("path")), "path", "left_semi")
    tree = components.parents(parts)
    omitted = rendering.hierarchy(tree)[1].first()[0]
    info = documents.codebase_info(decisions, language_histogram(p.files), p.files.where("role = 'dependency_manifest'").select("path"), parts, rendering.hierarchy_text(tree), docs_dir, omitted)
    return documents.document_set(dossiers.join(named, KEY), decisions, documents.index(named, docs_dir).unionByName(info), docs_dir, omitted, keep(reused), pages)


def sync(tracked: DataFrame, store: VersionedStore | FileTree, old_files: DataFrame | None = None, old_components: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = stored, settings: Settings = Settings(), call=fragments.typed_stub, full: bool = False, state: Prior | None = None, feed: DataFrame | None = None, base_found: bool = True) -> tuple[Plan, DataFrame | None]:
    """Makes what the plan asks for, reuses the rest, checks the whole set and commits it, with the state that the next run
    begins from, if nothing changed meanwhile. An open transaction is recovered first. `keep` writes a table and reads it
    again, so that no model call is repeated. Returns the plan and the diff, or no diff for a no-op. A component without a
    dossier raises, and so does a set that fails its checks; nothing is installed."""
    store.recover()
    p = plan(tracked, old_files, old_components, settings, full, state, feed, base_found, keep)
    p.actions = keep(p.actions)
    if p.is_noop():
        return p, None
    live = keep(store.read())
    got = generated(p, settings, keep, call)
    failed = got.failures.orderBy("component_key").limit(5).collect()
    if failed:
        raise GenerationError("; ".join(f"{r['component_key']}: {r['category']}" for r in failed))
    made = keep(documents_of(p, got.dossiers, live, settings.docs_dir, keep))
    hashed = made.select("path", content_hash(F.col("content")).alias("hash"))
    expected = documents.expected_sections(p.files.where("triggers").select(*KEY).distinct(), settings.docs_dir)
    wrong = output.candidate_checks(made, rendering.sections(made, "path", "content"), expected, hashed, rendering.DOCUMENTS, settings.docs_dir, secret_content)
    first = wrong.orderBy("step", "path").first()
    if first:
        raise OutputError(f"{first['path']}: {first['code']}")
    before = state.components if state else old_components
    at = f".state-{uuid.uuid4().hex}"
    write_state(p.files, state_components(p, before, settings.docs_dir), f"{store.root}/{at}")
    store.commit(made, live.select("path", "hash"), state={"at": at, "versions": VERSIONS, "hashes": settings.hashes()})
    return p, output.output_diff(hashed, live)


def state_components(p: Plan, before: DataFrame | None, docs_dir: str) -> DataFrame:
    """component_key, root_component, input_hash, document of all components there are now: those that were made anew with
    the hash of this run, the others with the one that they had."""
    fresh = p.actions.where("action in ('create', 'regenerate')").select(*KEY, F.lit(True).alias("fresh"))
    rows = p.hashes.join(fresh, KEY, "left")
    if before is not None:
        rows = rows.join(before.select(*KEY, F.col("input_hash").alias("was")), KEY, "left").withColumn("input_hash", F.when(F.col("fresh"), F.col("input_hash")).otherwise(F.coalesce("was", "input_hash")))
    return rows.select(*KEY, "input_hash", component_page(docs_dir, F.col("component_key"), F.col("root_component")).alias("document"))


def check(tracked: DataFrame, store: VersionedStore | FileTree, owned: DataFrame, old_files: DataFrame | None = None, old_components: DataFrame | None = None, settings: Settings = Settings(), state: Prior | None = None) -> None:
    """Raises StaleError unless installed documents are as the state (path, hash) says and the plan has nothing to do."""
    store.recover()
    broken = output.first_reason(output.integrity(owned, store.read())).first()[0]
    if broken:
        raise StaleError(broken)
    if not plan(tracked, old_files, old_components, settings, state=state).is_noop():
        raise StaleError("the sources changed")


def run_report(p: Plan) -> DataFrame:
    """One row: what was planned, as counts and lists."""
    a = p.actions.agg(*[F.count_if(F.col("action") == x).alias(x) for x in ("create", "regenerate", "delete", "skip_unchanged")], F.array_sort(F.collect_list(F.struct(*KEY, "action"))).alias("components"))
    return a.select(F.lit(5).alias("schema_version"), F.lit(p.reason).alias("full_run_reason"), "*")
