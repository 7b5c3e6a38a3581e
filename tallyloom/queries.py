"""Every reproduced operator as a query over the driver's tables, each with its twin in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracle as O
from . import views as V
from .functions import numbers as N
from .functions import paths as P
from .functions import text as X
from .operators import changes, classify, components, coverage, documents, merge, output, packing, rendering, requests, validation
from .sources import generator, records
from .sources.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["component_key", "root_component"]
VERSIONS = ["input-1", "plan-1", "render-1"]
BATCH, BUDGET = 80_000, 20_000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- scan and classification

POLICY = classify.SourcePolicy(docs_dir="services/src1", exclude=("**/*.yaml",), max_bytes=15_000)
_SECRET = "contains(upper(data), '-----BEGIN PRIVATE KEY-----') OR contains(upper(data), '-----BEGIN RSA PRIVATE KEY-----') OR contains(upper(data), '-----BEGIN EC PRIVATE KEY-----') OR contains(upper(data), '-----BEGIN OPENSSH PRIVATE KEY-----') OR " + " OR ".join(f"regexp_matches(data, '{p}')" for p in classify.SECRET_PATTERNS)
_SCAN = f"""WITH {O.TRACKED}, d AS (SELECT path, CASE
    WHEN path = 'services/src1' OR starts_with(path, 'services/src1/') THEN 'tool_owned_output' WHEN mode = '160000' THEN 'git_submodule' WHEN mode NOT IN ('100644', '100755', '120000') THEN 'unsupported_git_mode'
    WHEN ends_with(path, '.yaml') THEN 'source_exclude_pattern' WHEN size > 15000 THEN 'file_size_limit' WHEN contains(data, chr(0)) THEN 'binary_content' END AS early, {O.REASON} AS late, {O.ROLE} AS role, {O.EARLY_ROLE} AS early_role, size, {_SECRET} AS secret FROM tracked),
s AS (SELECT path, CASE early WHEN 'tool_owned_output' THEN 'generated_documentation' WHEN 'git_submodule' THEN 'special_git_entry' WHEN 'unsupported_git_mode' THEN 'special_git_entry' WHEN 'source_exclude_pattern' THEN early_role WHEN 'file_size_limit' THEN 'oversized'
    WHEN 'binary_content' THEN 'binary' ELSE role END AS role, coalesce(early, late) AS reason, early IS NULL AND role NOT IN ('lock_file', 'fixture', 'generated_code') AS included, early IS NULL AND role NOT IN {O.QUIET} AS triggers,
    CASE WHEN early IN ('tool_owned_output', 'git_submodule', 'unsupported_git_mode', 'source_exclude_pattern') THEN 0 ELSE size END AS size, secret FROM d),
scan AS (SELECT path, role, reason, included, triggers, size::BIGINT AS size, included AND secret AS secret FROM s)"""


@query("scan_decisions", _SCAN + " SELECT * FROM scan")
def _(spark, d):
    return classify.scan(V.tracked(spark, d), POLICY)


@query("role_classification", f"WITH {O.TRACKED} SELECT path, {O.ROLE} AS role, {O.REASON} AS reason FROM tracked")
def _(spark, d):
    return V.tracked(spark, d).select("path", classify.role_expression(F.col("path"), F.col("data")).alias("role"), classify.reason_expression(F.col("path"), F.col("data")).alias("reason"))


@query("role_policy_join", f"WITH {O.CUR} SELECT path, role, role NOT IN ('lock_file', 'fixture', 'generated_code') AS included, role NOT IN {O.QUIET} AS triggers FROM cur")
def _(spark, d):
    return V.files_cur(spark, d).select("path", "role").join(F.broadcast(classify.policy_table(spark)), "role").select("path", "role", "included", "triggers")


@query("role_overrides", f"WITH {O.TRACKED} SELECT path, CASE WHEN ends_with(path, '.md') THEN 'contract' WHEN starts_with(path, 'services/src2/') THEN 'fixture' ELSE {O.ROLE} END AS role FROM tracked")
def _(spark, d):
    return V.tracked(spark, d).select("path", classify.role_expression(F.col("path"), F.col("data"), (("**/*.md", "contract"), ("services/src2/**", "fixture"))).alias("role"))


@query("decision_counts", _SCAN + " SELECT count(*) FILTER (WHERE included) AS included, count(*) FILTER (WHERE triggers) AS triggering, count(*) FILTER (WHERE NOT included) AS excluded, count(*) FILTER (WHERE secret) AS secrets FROM scan")
def _(spark, d):
    return classify.scan(V.tracked(spark, d), POLICY).agg(F.count_if("included").alias("included"), F.count_if("triggers").alias("triggering"), F.count_if(~F.col("included")).alias("excluded"), F.count_if("secret").alias("secrets"))


@query("review_worthy", _SCAN + " SELECT path, reason, size FROM scan WHERE reason IN ('file_size_limit', 'binary_content')")
def _(spark, d):
    return classify.review_worthy(classify.scan(V.tracked(spark, d), POLICY)).select("path", "reason", "size")


_LANG = f"""CASE {O.SUFFIX} WHEN '.go' THEN 'Go' WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.jsx' THEN 'JavaScript' WHEN '.ts' THEN 'TypeScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.java' THEN 'Java' WHEN '.kt' THEN 'Kotlin'
  WHEN '.rb' THEN 'Ruby' WHEN '.rs' THEN 'Rust' WHEN '.c' THEN 'C' WHEN '.h' THEN 'C' WHEN '.cc' THEN 'C++' WHEN '.cpp' THEN 'C++' WHEN '.cs' THEN 'C#' WHEN '.php' THEN 'PHP' WHEN '.swift' THEN 'Swift' WHEN '.scala' THEN 'Scala'
  WHEN '.sh' THEN 'Shell' WHEN '.sql' THEN 'SQL' WHEN '.proto' THEN 'Protocol Buffers' ELSE 'Other' END"""


@query("language_histogram", f"WITH {O.CUR} SELECT {_LANG} AS language, count(*) AS files FROM cur WHERE role IN ('production_source', 'unknown_source') GROUP BY 1")
def _(spark, d):
    return classify.language_histogram(V.files_cur(spark, d))


_HITS = [("-----begin rsa private key-----",), ("key AKIA" + "ABCDEFGHIJ234567" + " end",), ("token ghp_" + "a1" * 18,), ("github_pat_" + "A_" * 25,), ("xoxb-" + "1a-" * 7,), ("AKIA123",), ("nothing",)]


@query("secret_content_flags", "WITH t AS (SELECT text AS data FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT unnest([" + ", ".join(f"'{x[0]}'" for x in _HITS) + f"])) SELECT count(*) AS texts, count(*) FILTER (WHERE {_SECRET}) AS flagged FROM t")
def _(spark, d):
    texts = V.table(spark, d, "documents").select("text").union(V.table(spark, d, "conversations").select("text")).union(spark.createDataFrame(_HITS, "text string"))
    return texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if(classify.secret_content(F.col("text"))).alias("flagged"))


@query("source_hash", "SELECT doc_id, 'sha256:' || sha256(text) AS source_hash, strlen(text)::BIGINT AS size FROM documents")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("source_hash"), F.octet_length("text").cast("long").alias("size"))


@query("duplicate_content", "SELECT sha256(text) AS h, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return output.duplicates(V.table(spark, d, "documents").select(F.sha2("text", 256).alias("h")), ["h"])


# --- components


@query("component_key", f"WITH {O.CUR} SELECT path, component_key, root_component FROM cur")
def _(spark, d):
    return V.files_cur(spark, d).select("path", *KEY)


@query("component_key_explicit", f"WITH {O.CUR} SELECT path, CASE WHEN starts_with(path, 'services/src0/en/') THEN 'services/src0/en' WHEN starts_with(path, 'services/src0/') THEN 'services/src0' ELSE '@root' END AS component_key, NOT starts_with(path, 'services/src0/') AS root_component FROM cur")
def _(spark, d):
    files = V.files_cur(spark, d).select("path", "role")
    return components.component_key(files, ("services/src0", "services/src0/en"), explicit=True).select("path", *KEY)


@query("component_summary", f"""WITH {O.CUR} SELECT component_key, root_component, count(*) FILTER (WHERE triggers) AS triggering, count(*) FILTER (WHERE NOT triggers) AS supporting, count(*) FILTER (WHERE role = 'dependency_manifest') AS manifests,
  coalesce(sum(size) FILTER (WHERE triggers), 0)::BIGINT AS triggering_bytes, coalesce(sum(size) FILTER (WHERE NOT triggers), 0)::BIGINT AS supporting_bytes, coalesce(sum(size) FILTER (WHERE role = 'dependency_manifest'), 0)::BIGINT AS manifest_bytes
  FROM cur GROUP BY 1, 2 HAVING count(*) FILTER (WHERE triggers) > 0""")
def _(spark, d):
    return components.summary(V.files_cur(spark, d))


@query("component_files", f"WITH {O.CUR} SELECT component_key, root_component, string_agg(path, ',' ORDER BY path) FILTER (WHERE triggers) AS triggering, coalesce(string_agg(path, ',' ORDER BY path) FILTER (WHERE NOT triggers), '') AS supporting FROM cur GROUP BY ALL HAVING count(*) FILTER (WHERE triggers) > 0")
def _(spark, d):
    names = lambda c: F.array_join(F.transform(c, lambda f: f["path"]), ",")
    return components.files_of(V.files_cur(spark, d)).select(*KEY, names("triggering").alias("triggering"), names("supporting").alias("supporting"))


@query("supporting_semi", f"WITH {O.CUR} SELECT path, component_key FROM cur WHERE NOT triggers AND (component_key, root_component) IN (SELECT component_key, root_component FROM cur WHERE triggers)")
def _(spark, d):
    return components.supporting(V.files_cur(spark, d)).select("path", "component_key")


@query("manifest_context", f"WITH {O.CUR} SELECT c.component_key, m.path AS manifest FROM (SELECT DISTINCT component_key FROM cur WHERE triggers AND NOT root_component) c, (SELECT 'go.mod' AS path UNION ALL SELECT path FROM cur WHERE role = 'dependency_manifest' AND root_component) m")
def _(spark, d):
    files = V.files_cur(spark, d)
    top = spark.createDataFrame([("go.mod", "dependency_manifest", True, "@root", True)], "path string, role string, triggers boolean, component_key string, root_component boolean")
    return components.manifest_context(files.select(*top.columns).unionByName(top))


@query("hierarchy_parent", f"""WITH {O.CUR}, k AS (SELECT DISTINCT component_key FROM cur) SELECT k.component_key, CASE WHEN k.component_key <> '@root' THEN coalesce(max_by(p.component_key, length(p.component_key)), '@root') END AS parent
  FROM k LEFT JOIN k p ON starts_with(k.component_key, p.component_key || '/') GROUP BY 1""")
def _(spark, d):
    return components.parents(V.files_cur(spark, d))


@query("display_order", f"WITH {O.CUR} SELECT component_key, root_component, row_number() OVER (ORDER BY root_component DESC, component_key) AS place FROM (SELECT DISTINCT component_key, root_component FROM cur)")
def _(spark, d):
    keys = V.files_cur(spark, d).select(*KEY).distinct()  # a row a component
    return keys.select(*KEY, F.row_number().over(Window.orderBy(F.desc("root_component"), "component_key")).cast("long").alias("place"))


@query("component_catalog", f"WITH {O.CUR} SELECT string_agg(DISTINCT component_key, ',' ORDER BY component_key) AS catalog FROM cur WHERE triggers")
def _(spark, d):
    return V.files_cur(spark, d).where("triggers").agg(F.array_join(F.array_sort(F.collect_set("component_key")), ",").alias("catalog"))


# --- changes


def _both(spark, d):
    return V.files_old(spark, d), V.files_cur(spark, d)


@query("snapshot_changes", f"WITH {O.CUR}, {O.OLD}, {O.CHANGES} SELECT * FROM changes")
def _(spark, d):
    return changes.snapshot_changes(*_both(spark, d))


@query("normalized_changes", f"WITH {O.CUR}, {O.OLD}, {O.CHANGES}, {O.NORM} SELECT * FROM norm")
def _(spark, d):
    old, cur = _both(spark, d)
    return changes.normalized(changes.snapshot_changes(old, cur), old, cur)


_RENAMES = """gone AS (SELECT source_hash, path, row_number() OVER (PARTITION BY source_hash ORDER BY path) AS n FROM old WHERE path NOT IN (SELECT path FROM cur)),
fresh AS (SELECT source_hash, path, row_number() OVER (PARTITION BY source_hash ORDER BY path) AS n FROM cur WHERE path NOT IN (SELECT path FROM old)),
pairs AS (SELECT gone.path AS old_path, fresh.path AS new_path FROM gone JOIN fresh USING (source_hash, n))"""


@query("renames", f"WITH {O.CUR}, {O.OLD}, {_RENAMES} SELECT old_path, new_path, 100 AS similarity FROM pairs")
def _(spark, d):
    return changes.renames(*_both(spark, d))


@query("renamed_changes", f"""WITH {O.CUR}, {O.OLD}, {O.CHANGES}, {_RENAMES} SELECT * FROM changes WHERE NOT (status = 'added' AND new_path IN (SELECT new_path FROM pairs)) AND NOT (status = 'deleted' AND old_path IN (SELECT old_path FROM pairs))
  UNION ALL SELECT 'renamed', old_path, new_path FROM pairs""")
def _(spark, d):
    old, cur = _both(spark, d)
    return changes.with_renames(changes.snapshot_changes(old, cur), changes.renames(old, cur))


@query("ownership_changes", f"WITH {O.CUR}, {O.OLD}, {O.OWNERSHIP} SELECT x.k AS component_key, x.r AS root_component, path FROM ownership")
def _(spark, d):
    return changes.ownership_changes(*_both(spark, d))


@query("policy_differences", f"WITH {O.CUR}, {O.OLD}, {O.POLICY} SELECT * FROM policy")
def _(spark, d):
    return changes.policy_differences(*_both(spark, d))


_AFFECTED = f"{O.CUR}, {O.OLD}, {O.CHANGES}, {O.NORM}, {O.OWNERSHIP}, {O.POLICY}, {O.PICKED}, {O.KNOWN}, {O.REASONS}"


def _stored_both(spark, d):
    """Both snapshots without their content, written once: what follows names them many times."""
    names = ["path", *changes.ATTRIBUTES]
    return tuple(stored(x.select(*names)) for x in _both(spark, d))


@query("affected_reasons", f"WITH {_AFFECTED} SELECT component_key, root_component, array_to_string(reasons, ',') AS reasons FROM affected")
def _(spark, d):
    return changes.affected(*_stored_both(spark, d)).select(*KEY, F.array_join("reasons", ",").alias("reasons"))


@query("component_changes", f"WITH {O.CUR}, {O.OLD}, {O.CHANGES}, {O.NORM} SELECT old_key AS component_key, old_root AS root_component, status, coalesce(nullif(new_path, ''), old_path) AS path FROM norm WHERE old_key <> '' UNION SELECT new_key, new_root, status, coalesce(nullif(new_path, ''), old_path) FROM norm WHERE new_key <> ''")
def _(spark, d):
    old, cur = _both(spark, d)
    return changes.component_changes(changes.normalized(changes.snapshot_changes(old, cur), old, cur))


SUPPORTING, MANIFESTS = 30_000, 40
# the files, two manifests at the top, one of them above its bytes, and the context that fits
_CONTEXT = f"""with_top AS (SELECT path, data, size, source_hash, role, triggers, component_key, root_component FROM cur UNION ALL SELECT unnest(['go.mod', 'package.json']), unnest(['module x', repeat('long', 20)]), unnest([8, 80]), unnest(['sha256:' || sha256('module x'), 'sha256:' || sha256(repeat('long', 20))]), 'dependency_manifest', true, '@root', true),
sup AS (SELECT component_key, root_component, path, size, row_number() OVER (PARTITION BY component_key, root_component ORDER BY path) AS n FROM with_top WHERE NOT triggers AND (component_key, root_component) IN (SELECT component_key, root_component FROM with_top WHERE triggers)),
fit(component_key, root_component, n, bytes, path, took) AS (SELECT component_key, root_component, 1::BIGINT, CASE WHEN size <= {SUPPORTING} THEN size ELSE 0 END, path, size <= {SUPPORTING} FROM sup WHERE n = 1 UNION ALL
  SELECT s.component_key, s.root_component, s.n, CASE WHEN f.bytes + s.size <= {SUPPORTING} THEN f.bytes + s.size ELSE f.bytes END, s.path, f.bytes + s.size <= {SUPPORTING} FROM fit f JOIN sup s ON s.component_key = f.component_key AND s.root_component = f.root_component AND s.n = f.n + 1),
shown AS (SELECT component_key, root_component, 'supporting' AS kind, path FROM fit WHERE took UNION ALL SELECT DISTINCT component_key, root_component, 'manifest', 'go.mod' FROM with_top WHERE triggers AND NOT root_component)"""


def _with_top(spark, d):
    files = V.files_cur(spark, d).drop("doc_id")
    top = spark.createDataFrame([("go.mod", "module x"), ("package.json", "long" * 20)], "path string, data string")
    top = top.select("path", "data", F.length("data").cast("long").alias("size"), X.content_hash(F.col("data")).alias("source_hash"), F.lit("dependency_manifest").alias("role"), F.lit(True).alias("triggers"), F.lit("@root").alias("component_key"), F.lit(True).alias("root_component"))
    return files.unionByName(top)


@query("component_context", f"WITH RECURSIVE {O.CUR}, {_CONTEXT} SELECT * FROM shown")
def _(spark, d):
    return components.context(_with_top(spark, d), SUPPORTING, MANIFESTS).select(*KEY, "kind", "path")


@query("input_hash", f"""WITH RECURSIVE {O.CUR}, {O.OLD}, {O.CHANGES}, {O.NORM}, {_CONTEXT}, {O.input_hash('ih', 'with_top', 'data', [*VERSIONS, 'cfg'], 'shown', 'norm')} SELECT * FROM ih""")
def _(spark, d):
    """With the catalogue, the context that fits, and the changes since the old snapshot."""
    old, cur = _stored_both(spark, d)
    norm = changes.normalized(changes.snapshot_changes(old, cur), old, cur)
    files = stored(components.digested(_with_top(spark, d)))
    return components.input_hash(files, tuple(VERSIONS), "cfg", components.context(files, SUPPORTING, MANIFESTS), norm)


@query("component_actions", f"""WITH {_AFFECTED}, {O.input_hash('now', 'cur', "''", [*VERSIONS, 'cfg'])}, {O.input_hash('was', 'old', "''", [*VERSIONS, 'cfg'])}
  SELECT component_key, root_component, CASE WHEN now.input_hash IS NULL THEN 'delete' WHEN was.input_hash IS NULL THEN 'create' WHEN now.input_hash = was.input_hash THEN 'skip_unchanged' ELSE 'regenerate' END AS action
  FROM now FULL JOIN was USING (component_key, root_component) SEMI JOIN affected USING (component_key, root_component)""")
def _(spark, d):
    old, cur = _stored_both(spark, d)
    hashed = lambda files: components.input_hash(files.withColumn("data", F.lit("")), tuple(VERSIONS), "cfg")
    return changes.actions(changes.affected(old, cur), hashed(cur), hashed(old))


@query("full_run_reason", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'explicit_full' WHEN event_id % 7 = 0 THEN 'base_revision_unavailable' WHEN event_id % 5 = 0 THEN 'state_missing' WHEN event_id % 5 = 1 THEN 'state_invalid' WHEN event_id % 3 = 0 THEN 'state_incompatible' WHEN event_id % 2 = 0 THEN 'output_paths_changed' END AS reason FROM events""")
def _(spark, d):
    e = F.col("event_id")
    state = F.when(e % 5 == 0, "missing").when(e % 5 == 1, "invalid").otherwise("valid")
    return V.table(spark, d, "events").select("event_id", changes.full_run_reason(e % 11 == 0, e % 7 != 0, state, e % 3 != 0, e % 2 != 0).alias("reason"))


# --- packing and estimates

_WALK = """{name}_s AS (SELECT component_key, root_component, path, size, row_number() OVER (PARTITION BY component_key, root_component ORDER BY path) AS n FROM cur {where})"""


@query("budget_first_fit", f"""WITH RECURSIVE {O.CUR}, {_WALK.format(name='w', where='')},
  r(component_key, root_component, n, bytes, taken) AS (SELECT component_key, root_component, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM w_s WHERE n = 1 UNION ALL
    SELECT r.component_key, r.root_component, s.n, CASE WHEN r.bytes + s.size <= {BUDGET} THEN r.bytes + s.size ELSE r.bytes END, CASE WHEN r.bytes + s.size <= {BUDGET} THEN r.taken + 1 ELSE r.taken END
    FROM r JOIN w_s s ON s.component_key = r.component_key AND s.root_component = r.root_component AND s.n = r.n + 1)
  SELECT component_key, root_component, max(taken) AS selected, max(bytes) AS bytes, max(n) - max(taken) AS omitted FROM r GROUP BY ALL""")
def _(spark, d):
    return packing.first_fit(V.files_cur(spark, d), BUDGET)


_BATCHES = f"""{_WALK.format(name='b', where='')},
  br(component_key, root_component, n, path, size, bytes, batch) AS (SELECT component_key, root_component, n, path, size, CASE WHEN size > {BUDGET} THEN {BUDGET} + 1 ELSE size END, 1 FROM b_s WHERE n = 1 UNION ALL
    SELECT s.component_key, s.root_component, s.n, s.path, s.size, CASE WHEN s.size > {BUDGET} THEN {BUDGET} + 1 WHEN r.bytes + s.size > {BUDGET} THEN s.size ELSE r.bytes + s.size END,
           CASE WHEN s.size > {BUDGET} OR r.bytes + s.size > {BUDGET} THEN r.batch + 1 ELSE r.batch END
    FROM br r JOIN b_s s ON s.component_key = r.component_key AND s.root_component = r.root_component AND s.n = r.n + 1)"""


@query("greedy_batches", f"WITH RECURSIVE {O.CUR}, {_BATCHES} SELECT component_key, root_component, path, size, batch FROM br")
def _(spark, d):
    return packing.greedy_batches(V.files_cur(spark, d), BUDGET, "alone")


@query("batch_bytes", f"""WITH RECURSIVE {O.CUR}, {_BATCHES} SELECT component_key, root_component, batch, count(*) AS files, sum(size)::BIGINT AS bytes, max(max(batch)) OVER (PARTITION BY component_key, root_component) AS batch_count, 'b' || batch AS split_path FROM br GROUP BY component_key, root_component, batch""")
def _(spark, d):
    return packing.batch_bytes(packing.greedy_batches(V.files_cur(spark, d), BUDGET, "alone"))


@query("newline_chunks", "SELECT doc_id, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents")
def _(spark, d):
    chunks = packing.newline_chunks(V.table(spark, d, "documents"), 1 << 20, "doc_id", "text")
    whole = chunks.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk", F.hex("data").alias("h")))).alias("c"))
    data = F.unhex(F.array_join(F.transform("c", lambda c: c["h"]), ""))
    return whole.select(F.col("id").alias("doc_id"), F.octet_length(data).cast("long").alias("bytes"), F.sha2(data, 256).alias("sha256"))


# where each line of a text ends, as the number of bytes up to and with its line break
_ENDS = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS lines FROM documents), ends AS (SELECT doc_id, sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY n)::BIGINT AS e, n, lines FROM l QUALIFY n < lines), d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS size FROM documents)"


@query("newline_chunk_sizes", f"""WITH RECURSIVE {_ENDS}, r(doc_id, size, chunk, start, stop) AS (SELECT doc_id, size, -1, 0::BIGINT, 0::BIGINT FROM d UNION ALL
    SELECT r.doc_id, r.size, r.chunk + 1, r.stop, CASE WHEN r.size - r.stop <= 4000 THEN r.size ELSE (SELECT max(e) FROM ends WHERE ends.doc_id = r.doc_id AND e > r.stop AND e <= r.stop + 4000) END FROM r WHERE r.stop IS NOT NULL AND (r.stop < r.size OR r.chunk = -1)),
  bad AS (SELECT DISTINCT doc_id FROM r WHERE stop IS NULL)
  SELECT doc_id AS id, chunk::INTEGER AS chunk, (count(*) OVER (PARTITION BY doc_id))::INTEGER AS chunk_count, (stop - start)::INTEGER AS bytes FROM r WHERE chunk >= 0 AND doc_id NOT IN (SELECT doc_id FROM bad) UNION ALL SELECT doc_id, -1, 0, NULL FROM bad""")
def _(spark, d):
    return packing.newline_chunks(V.table(spark, d, "documents"), 4000, "doc_id", "text").select("id", "chunk", "chunk_count", F.octet_length("data").alias("bytes"))


@query("bisected_texts", f"""WITH {_ENDS}, c AS (SELECT d.doc_id, size, coalesce(max(e) FILTER (WHERE e <= size // 2), min(e) FILTER (WHERE e > size // 2)) AS mid FROM d LEFT JOIN ends USING (doc_id) GROUP BY ALL), ok AS (SELECT * FROM c WHERE mid > 0 AND mid < size),
  o AS (SELECT ok.doc_id, size, mid, coalesce(max(e) FILTER (WHERE e <= mid - 1), 0) AS line FROM ok LEFT JOIN ends USING (doc_id) GROUP BY ALL), s AS (SELECT *, CASE WHEN line > 0 AND mid - line <= 1024 THEN line ELSE mid - 1 END AS start FROM o), t AS (SELECT * FROM s WHERE start > 0 AND start < mid)
  SELECT doc_id AS id, 0 AS chunk, mid::INTEGER AS bytes, false AS overlap FROM ok UNION ALL SELECT doc_id, 1, (size - mid)::INTEGER, false FROM ok UNION ALL SELECT doc_id, -1, NULL, false FROM d WHERE doc_id NOT IN (SELECT doc_id FROM ok)
  UNION ALL SELECT doc_id, 0, mid::INTEGER, true FROM t UNION ALL SELECT doc_id, 1, (size - start)::INTEGER, true FROM t UNION ALL SELECT doc_id, -1, NULL, true FROM d WHERE doc_id NOT IN (SELECT doc_id FROM t)""")
def _(spark, d):
    docs = V.table(spark, d, "documents")
    each = lambda o: packing.bisected(docs, o, "doc_id", "text").select("id", "chunk", F.octet_length("data").alias("bytes"), F.lit(o).alias("overlap"))
    return each(False).unionByName(each(True))


_ESTIMATES = f"""kinds AS (SELECT unnest(['overview_candidate', 'architecture', 'interfaces', 'data_models', 'workflows', 'dependencies', 'review_gaps', 'overview', 'diagrams']) AS kind, unnest(range(9))::INTEGER AS ordinal), per AS (SELECT component_key, root_component, max(batch)::BIGINT AS n, sum(size)::BIGINT AS bytes FROM br GROUP BY ALL),
est AS (SELECT component_key, root_component, kind, ordinal, CASE WHEN kind IN ('overview', 'diagrams') THEN 1 ELSE n END AS calls, CASE WHEN kind IN ('overview', 'diagrams') THEN 0 ELSE bytes END AS bytes FROM per, kinds)"""


def _estimates(spark, d):
    return packing.call_estimates(packing.greedy_batches(V.files_cur(spark, d), BUDGET, "alone"))


@query("call_estimates", f"WITH RECURSIVE {O.CUR}, {_BATCHES}, {_ESTIMATES} SELECT *, bytes AS tokens_most, (bytes + 3) // 4 AS tokens_usual, calls * 6 AS attempts FROM est")
def _(spark, d):
    return _estimates(spark, d)


@query("estimate_rollup", f"WITH RECURSIVE {O.CUR}, {_BATCHES}, {_ESTIMATES} SELECT component_key, kind, sum(calls)::BIGINT AS calls, sum(bytes)::BIGINT AS bytes, max(bytes)::BIGINT AS largest, grouping(component_key, kind)::INTEGER AS level FROM est GROUP BY ROLLUP (component_key, kind)")
def _(spark, d):
    return packing.estimate_rollup(_estimates(spark, d))


@query("call_bounds", f"""WITH RECURSIVE {O.CUR}, {_BATCHES}, n AS (SELECT component_key, root_component, max(batch)::BIGINT AS scopes FROM br GROUP BY ALL) SELECT component_key, root_component, scopes, 7 * scopes + 2 AS calls, 14 * scopes + 4 AS most, 14 * scopes + 4 > 80 AS above FROM n""")
def _(spark, d):
    n = packing.greedy_batches(V.files_cur(spark, d), BUDGET, "alone").groupBy(*KEY).agg(F.max("batch").cast("long").alias("scopes"))
    return n.select("*", *[c.alias(a) for c, a in zip(packing.call_bounds(F.col("scopes"), 80), ("calls", "most", "above"), strict=True)])


@query("saturating_totals", "SELECT user_id, least(sum(CASE WHEN event_id % 3 = 0 THEN 9223372036854775807::HUGEINT ELSE event_id END), 9223372036854775807)::BIGINT AS total FROM events GROUP BY 1")
def _(spark, d):
    rows = V.table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(N.MOST)).otherwise(F.col("event_id")).alias("v"))
    return rows.groupBy("user_id").agg(packing.total("v").alias("total"))


@query("saturating_numbers", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 9223372036854775807 ELSE event_id + 5 END AS added, CASE WHEN event_id % 2 = 0 AND event_id > 1 THEN 9223372036854775807 WHEN event_id % 2 = 0 THEN 0 ELSE event_id * 5 END AS multiplied,
  (event_id + 6) // 7 AS ceiling, least(0.5 * (event_id % 100 + 1), 20.0)::DOUBLE AS wait, least((event_id % 9) * ((1::BIGINT << (event_id % 5 + 1)::INTEGER) - 2), 40) AS below, event_id * 6 AS attempts FROM events""")
def _(spark, d):
    e = F.col("event_id")
    big = F.when(e % 2 == 0, F.lit(N.MOST)).otherwise(F.lit(5))
    return V.table(spark, d, "events").select(
        "event_id", N.add_saturating(e, F.when(e % 2 == 0, F.lit(N.MOST)).otherwise(F.lit(5).cast("long"))).alias("added"), N.multiply_saturating(e, big).alias("multiplied"), N.ceil_div(e, 7).alias("ceiling"),
        N.back_off(e % 100, 0.5).alias("wait"), N.split_descendants(e % 9, e % 5, F.lit(40).cast("long")).alias("below"), N.attempts(e, 2, 2).alias("attempts"))


# --- findings

GROUP, CONTENT = ["component_key", "section"], ["title", "description"]


def _merged(spark, d):
    return merge.merged(V.items(spark, d), CONTENT, GROUP)


@query("merge_items", f"WITH {O.ITEMS}, {O.MERGED} SELECT component_key, section, title, description, array_to_string(paths, ',') AS paths, support, paths_omitted, digest FROM mi")
def _(spark, d):
    return _merged(spark, d).select(*GROUP, *CONTENT, F.array_join("paths", ",").alias("paths"), "support", "paths_omitted", "digest")


@query("item_conflicts", f"WITH {O.ITEMS}, c AS (SELECT component_key, section, lower(title) AS identity, count(DISTINCT description) AS contents FROM items GROUP BY ALL HAVING count(DISTINCT description) > 1) SELECT DISTINCT component_key, section, identity, contents, path FROM c JOIN (SELECT *, lower(title) AS identity FROM items) USING (component_key, section, identity)")
def _(spark, d):
    return merge.conflicts(V.items(spark, d), CONTENT, GROUP, F.lower("title"))


_TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY component_key, section ORDER BY support DESC, paths[1], title, digest, canonical) AS rank FROM mi), pos AS (SELECT *, row_number() OVER (PARTITION BY component_key, section ORDER BY paths[1], title, digest, canonical) AS position FROM top WHERE rank <= 6)"


@query("top_items", f"WITH {O.ITEMS}, {O.MERGED}, {_TOP} SELECT component_key, section, title, description, support, position::INTEGER AS position FROM pos")
def _(spark, d):
    return merge.best_supported(_merged(spark, d), GROUP, "title", 6).select(*GROUP, *CONTENT, "support", "position")


@query("items_omitted", f"WITH {O.ITEMS}, {O.MERGED} SELECT component_key, section, greatest(count(*) - 6, 0) AS items_omitted, sum(paths_omitted)::BIGINT AS paths_omitted FROM mi GROUP BY ALL")
def _(spark, d):
    return merge.omitted(_merged(spark, d), GROUP, 6)


@query("top_evidence", f"""WITH {O.ITEMS}, x AS (SELECT component_key, regexp_replace(path, '/[^/]*$', '') AS path, title, description FROM items), c AS (SELECT component_key, path, count(DISTINCT title || '|' || description) AS citations FROM x GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY component_key ORDER BY citations DESC, path) AS position FROM c) SELECT component_key, path, citations, position::INTEGER AS position FROM r WHERE position <= 3""")
def _(spark, d):
    items = V.items(spark, d).withColumn("path", F.regexp_replace("path", r"/[^/]*\z", ""))
    return merge.top_evidence(items, ["component_key"], CONTENT, limit=3)


@query("overview_pick", f"WITH {O.ITEMS} SELECT component_key, arg_min(title, (path, title, description)) AS title, arg_min(description, (path, title, description)) AS purpose FROM items GROUP BY 1")
def _(spark, d):
    return merge.overview(V.items(spark, d), ["component_key"], "title", "description")


@query("notices", f"""WITH {O.ITEMS}, {O.MERGED}, c AS (SELECT component_key, count(*) FILTER (WHERE support > 1) AS c0, greatest(count(*) - 50, 0) AS c2 FROM mi GROUP BY 1)
  SELECT component_key, 0 AS slot, 'inconsistency' AS kind, 'Assembly retained conflicting claims for ' || c0 || ' structural identities.' AS description FROM c WHERE c0 > 0
  UNION ALL SELECT component_key, 2, 'missing_context', 'Assembly omitted ' || c2 || ' items because assembled section limits were reached.' FROM c WHERE c2 > 0""")
def _(spark, d):
    counts = _merged(spark, d).groupBy("component_key").agg(F.count_if(F.col("support") > 1).alias("c0"), F.greatest(F.count(F.lit(1)) - 50, F.lit(0)).alias("c2"))
    zero = F.lit(0).cast("long")
    return merge.notices(counts.withColumns({"c1": zero, "c3": zero, "c3b": zero, "c4": zero, "c5": zero}), ["component_key"]).drop("recommendation")


# --- validation

# the rules as the reproduced tool has them, written out
_SIGN = r"regexp_extract(t, '([\x00-\x08\x0B-\x1F\x7F-\x{9F}]|\p{Cf}|[\x{2500}-\x{257F}])', 1)"
_PROSE = rf"""CASE WHEN regexp_matches({_SIGN}, '[\x00-\x1F\x7F-\x{{9F}}]') THEN 'a control character' WHEN regexp_matches({_SIGN}, '\p{{Cf}}') THEN 'a formatting character' WHEN {_SIGN} <> '' THEN 'box-drawing characters'
  WHEN regexp_matches(t, '(?i)([a-z][a-z0-9+.\-]*://|\b(?:javascript|data|vbscript|mailto|tel|file):)') THEN 'a URI scheme' WHEN contains(t, '](') THEN 'a Markdown link' WHEN regexp_matches(t, '(?i)</?[a-z!][^>]*>') THEN 'HTML'
  WHEN contains(t, '```') OR contains(t, '~~~') THEN 'a code fence' WHEN regexp_matches(t, '-->|<--|==>|<==|[-=_]{{4,}}') THEN 'an ASCII diagram'
  WHEN regexp_matches(t, '(?i)(?:^|[\s"''(<])(?:[a-z]:\\|/(?:users|home|root|private|var|tmp|etc|opt|usr|mnt|dev|proc|sys)(?:/|$|\s))') THEN 'a machine path'"""
_BARE = r"ltrim(line, ' ' || chr(9))"
_LINES = rf"""CASE WHEN starts_with({_BARE}, '#') THEN 'a heading' WHEN regexp_matches({_BARE}, '^(?:[-*+]\s+|\d+[.)]\s+)') THEN 'a list'
  WHEN regexp_matches({_BARE}, '(?i)^(?:graph|flowchart)\s+(?:tb|td|bt|rl|lr|dt)\b|^(?:sequencediagram|classdiagram|erdiagram|statediagram(?:-v2)?|gantt|pie|journey|gitgraph|mindmap|timeline)\b') THEN 'diagram syntax' END"""
_VARIED = "CASE doc_id % 9 WHEN 0 THEN '# ' || text WHEN 1 THEN '  - ' || text WHEN 2 THEN 'see http://x.y ' || text WHEN 3 THEN text || ' --> b' WHEN 4 THEN 'under /home/me/' || text WHEN 5 THEN '<b>' || text WHEN 6 THEN text || chr(9472) || chr(7) WHEN 7 THEN chr(7) || chr(8203) || text ELSE text END"


@query("prose_issues", f"""WITH t AS (SELECT doc_id, {_VARIED} AS t FROM documents), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM t),
  f AS (SELECT doc_id, arg_min(why, n) AS why FROM (SELECT doc_id, n, {_LINES} AS why FROM l) WHERE why IS NOT NULL GROUP BY 1), p AS (SELECT t.doc_id, t, coalesce({_PROSE} END, f.why) AS why FROM t LEFT JOIN f USING (doc_id))
  SELECT doc_id, 1 AS seq, 'string_too_long' AS code, '4000' AS detail FROM p WHERE strlen(t) > 4000 UNION ALL SELECT doc_id, 2, 'unsafe_prose', why FROM p WHERE why IS NOT NULL""")
def _(spark, d):
    n, t = F.col("doc_id") % 9, F.col("text")
    varied = F.when(n == 0, F.concat(F.lit("# "), t)).when(n == 1, F.concat(F.lit("  - "), t)).when(n == 2, F.concat(F.lit("see http://x.y "), t)).when(n == 3, F.concat(t, F.lit(" --> b"))).when(n == 4, F.concat(F.lit("under /home/me/"), t)).when(n == 5, F.concat(F.lit("<b>"), t)).when(n == 6, F.concat(t, F.lit("\u2500\x07"))).when(n == 7, F.concat(F.lit("\x07\u200b"), t)).otherwise(t)
    return validation.prose_issues(V.table(spark, d, "documents").select("doc_id", varied.alias("t")), "doc_id", "t", 4000)


_BODY = "CASE event_id % 7 WHEN 0 THEN props || '}' WHEN 1 THEN '[1]' WHEN 2 THEN '{\"page\":1}' WHEN 3 THEN '{\"ref\":1,\"n\":\"x\"}' WHEN 4 THEN '{\"n\":2,\"ref\":\"a\"}' ELSE '{\"n\":2,\"ref\":\"a\",\"more\":null}' END"


@query("json_strict", f"""WITH b AS (SELECT event_id, {_BODY} AS body FROM events) SELECT event_id, CASE WHEN NOT json_valid(body) THEN 'trailing_data' WHEN json_type(body) <> 'OBJECT' THEN 'invalid_type' WHEN len(list_filter(json_keys(body), lambda k: k NOT IN ('n', 'ref'))) > 0 THEN 'unknown_field'
  WHEN len(json_keys(body)) < 2 THEN 'empty_value' WHEN json_type(body, '$.n') NOT IN ('UBIGINT', 'BIGINT') OR json_type(body, '$.ref') <> 'VARCHAR' THEN 'invalid_type' END AS code FROM b""")
def _(spark, d):
    body = F.expr(_BODY)
    return V.table(spark, d, "events").select("event_id", validation.json_issue(body, {"n": "BIGINT", "ref": "STRING"}, 8192).alias("code"))


@query("evidence_unknown", f"WITH {O.ITEMS}, {O.OLD} SELECT doc_id, path FROM items WHERE path NOT IN (SELECT path FROM old)")
def _(spark, d):
    return validation.unknown_evidence(V.items(spark, d), V.files_old(spark, d)).select("doc_id", "path")


@query("evidence_issues", f"""WITH {O.ITEMS}, {O.OLD}, e AS (SELECT doc_id, unnest([path, path, 'gone/' || doc_id, ' ']) AS path, unnest([0, 1, 2, 3])::INTEGER AS place FROM items WHERE doc_id % 5 <> 0)
  SELECT doc_id, place, CASE place WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'unknown_evidence_path' ELSE 'empty_value' END AS code FROM e WHERE place > 0 UNION ALL SELECT doc_id, place, 'unknown_evidence_path' FROM e WHERE place < 2 AND path NOT IN (SELECT path FROM old)
  UNION ALL SELECT doc_id, -1, 'too_many_items' FROM e WHERE place = 0 UNION ALL SELECT doc_id, -1, 'empty_value' FROM items WHERE doc_id % 5 = 0""")
def _(spark, d):
    paths = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array("path", "path", F.concat(F.lit("gone/"), F.col("doc_id").cast("string")), F.lit(" ")))
    return validation.evidence_issues(V.items(spark, d).select("doc_id", paths.alias("paths")), ["doc_id"], V.files_old(spark, d), 3)


@query("dependency_issues", """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'internal_component' ELSE 'library' END AS kind, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN '' WHEN 2 THEN ' ' || source WHEN 3 THEN 'none/' || source END AS k FROM documents),
  y AS (SELECT doc_id, CASE WHEN kind = 'internal_component' AND trim(k) = '' THEN 'missing_component_key' WHEN trim(k) = '' THEN NULL WHEN k <> trim(k) THEN 'invalid_value' WHEN k NOT IN (SELECT source FROM documents) THEN 'unknown_component_key' END AS code FROM x) SELECT * FROM y WHERE code IS NOT NULL""")
def _(spark, d):
    docs, n = V.table(spark, d, "documents"), F.col("doc_id")
    key = F.when(n % 4 == 0, F.col("source")).when(n % 4 == 1, "").when(n % 4 == 2, F.concat(F.lit(" "), "source")).otherwise(F.concat(F.lit("none/"), "source"))
    rows = docs.select("doc_id", F.when(n % 2 == 0, "internal_component").otherwise("library").alias("kind"), key.alias("k"))
    catalog = docs.select(F.col("source").alias("k"), F.lit(True).alias("ok")).distinct()
    rows = rows.join(catalog, "k", "left")
    return rows.select("doc_id", validation.dependency_issue(F.col("kind"), F.col("k"), known=F.coalesce("ok", F.lit(False))).alias("code")).where("code is not null")


@query("diagram_issues", """SELECT doc_id AS key, 'invalid_diagram_reference' AS code, 'x' AS at FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'duplicate_key', 'a' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'invalid_diagram_type', 'pie' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'diagram_field_not_allowed', 'nodes' FROM documents WHERE doc_id % 5 = 0""")
def _(spark, d):
    return validation.diagram_issues(_diagrams(V.table(spark, d, "documents")))


def _diagrams(docs):
    n = F.col("doc_id")
    node = lambda k: F.struct(F.lit(k).alias("key"), F.concat(F.lit(k + "; \""), F.col("lang"), F.lit('"')).alias("label"))
    edge = lambda a, b, label="": F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.lit(label).alias("label"))
    nodes = F.when(n % 4 == 0, F.array(node("a"), node("b"), node("a"))).otherwise(F.array(node("a"), node("b")))
    edges = F.when(n % 3 == 0, F.array(edge("a", "b"), edge("x", "a"))).otherwise(F.array(edge("a", "b", "uses #1")))
    return docs.select(n.alias("key"), F.when(n % 5 == 0, "pie").otherwise("flowchart").alias("type"), nodes.alias("nodes"), edges.alias("edges"))


@query("flowchart_text", """SELECT doc_id AS key, 'flowchart TD' || chr(10) || '  n0["a#59; #quot;' || lang || '#quot;"]' || chr(10) || '  n1["b#59; #quot;' || lang || '#quot;"]' || chr(10) || '  n0 -->|"uses #35;1"| n1' AS content FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0""")
def _(spark, d):
    return rendering.flowchart(_diagrams(V.table(spark, d, "documents").where("doc_id % 3 <> 0 and doc_id % 4 <> 0")))


@query("issue_cap", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, (n - 1)::INTEGER AS n, strlen(line)::INTEGER AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS r FROM l) WHERE r <= 3")
def _(spark, d):
    lines = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return validation.first_issues(lines, ["doc_id"], ["n"], 3).select("doc_id", "n", F.octet_length("line").alias("bytes"))


@query("state_issues", f"WITH {O.CUR} SELECT component_key AS state, path, 'bad_hash' AS code FROM cur WHERE doc_id % 10 = 0 UNION ALL SELECT component_key, '../' || path, 'unclean_path' FROM cur WHERE doc_id % 10 = 1 UNION ALL SELECT component_key, path, 'unknown_role' FROM cur WHERE doc_id % 10 = 2 UNION ALL SELECT component_key, p, 'unsorted' FROM (SELECT component_key, CASE WHEN doc_id % 10 = 1 THEN '../' ELSE '' END || path AS p, lag(CASE WHEN doc_id % 10 = 1 THEN '../' ELSE '' END || path) OVER (PARTITION BY component_key ORDER BY doc_id) AS b FROM cur) WHERE p < b")
def _(spark, d):
    f = V.files_cur(spark, d)
    n = F.col("doc_id") % 10
    path = F.when(n == 1, F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    return records.file_issues(f.select(F.col("component_key").alias("state"), F.col("doc_id").alias("n"), path.alias("path"), F.when(n == 0, "md5:1").otherwise(F.col("source_hash")).alias("source_hash"), F.when(n == 2, "poem").otherwise(F.col("role")).alias("role")))


# --- coverage

_KINDS = ["user", "assistant", "system"]


@query("coverage_gaps", "SELECT s.conv_id, k.kind FROM (SELECT DISTINCT conv_id FROM conversations) s, (SELECT unnest(['user', 'assistant', 'system']) AS kind) k ANTI JOIN conversations c ON c.conv_id = s.conv_id AND c.role = k.kind")
def _(spark, d):
    return coverage.gaps(V.scopes(spark, d), ["conv_id"], "kind", _KINDS)


@query("coverage_contiguity", "SELECT conv_id, count(DISTINCT turn) AS n, min(turn) = 0 AND max(turn) = count(DISTINCT turn) - 1 AS contiguous FROM conversations WHERE conv_id % 5 <> 0 OR turn <> 1 GROUP BY 1")
def _(spark, d):
    return coverage.contiguity(V.scopes(spark, d).where("conv_id % 5 <> 0 or turn <> 1"), ["conv_id"], "turn", 0)


@query("replacement_issues", """WITH p AS (SELECT doc_id, 'b' || doc_id AS s FROM documents), c AS (SELECT * FROM (VALUES (1, 'too_few'), (2, 'kind'), (3, 'lineage'), (4, 'foreign_evidence'), (5, 'lost_evidence')) v(n, code)) SELECT s AS split_path, code FROM p JOIN c ON p.doc_id % 6 = c.n""")
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("s"))
    n = F.col("doc_id") % 6
    parents = docs.select(F.col("s").alias("split_path"), F.lit("k").alias("kind"), F.array(F.lit("e1"), F.lit("e2")).alias("evidence"))
    second = F.struct(F.when(n == 2, "j").otherwise("k").alias("kind"), F.concat(F.when(n == 3, "z").otherwise(F.col("s")), F.lit("/1")).alias("split_path"), F.when(n == 4, F.array(F.lit("e2"), F.lit("e3"))).when(n == 5, F.array(F.lit("e1"))).otherwise(F.array(F.lit("e2"))).alias("evidence"))
    first = F.struct(F.lit("k").alias("kind"), F.concat("s", F.lit("/0")).alias("split_path"), F.array(F.lit("e1")).alias("evidence"))
    children = docs.select(F.col("s").alias("parent"), F.explode(F.when(n == 1, F.array(first)).otherwise(F.array(first, second))).alias("c")).select("parent", "c.*")
    return coverage.replacement_issues(parents, children)


@query("settled_scopes", """WITH c AS (SELECT 'b' || conv_id AS split_path, 'replaced' AS state FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 'b' || conv_id || '/c' || turn, CASE WHEN role = 'system' THEN 'pending' ELSE 'complete' END FROM conversations)
  SELECT c.split_path, NOT bool_or(l.state = 'pending') AS done FROM c JOIN c l ON l.state <> 'replaced' AND (l.split_path = c.split_path OR starts_with(l.split_path, c.split_path || '/')) GROUP BY 1""")
def _(spark, d):
    t = V.scopes(spark, d)
    top = t.select(F.concat(F.lit("b"), F.col("conv_id").cast("string")).alias("split_path"), F.lit("replaced").alias("state")).distinct()
    low = t.select(F.concat(F.lit("b"), F.col("conv_id").cast("string"), F.lit("/c"), F.col("turn").cast("string")).alias("split_path"), F.when(F.col("kind") == "system", "pending").otherwise("complete").alias("state"))
    return coverage.settled(top.unionByName(low))


# --- rendering and text


@query("markdown_cells", r"""SELECT doc_id, regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g') AS inline, regexp_replace(replace(regexp_replace(text, '([\\`*_\[\]<>])', '\\\1', 'g'), '|', '\|'), '\r\n|\r|\n', ' ', 'g') AS cell FROM documents""")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.escape_inline(F.col("text")).alias("inline"), X.escape_cell(F.col("text")).alias("cell"))


@query("diagram_labels", """SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text || '#;"<>', '#', chr(57344)), ';', chr(57345)), '"', '#quot;'), '<', '#lt;'), '>', '#gt;'), chr(57344), '#35;'), chr(57345), '#59;') AS label FROM documents""")
def _(spark, d):
    return V.table(spark, d, "documents").select("doc_id", X.escape_diagram(F.concat("text", F.lit('#;"<>'))).alias("label"))


@query("key_functions", f"""SELECT doc_id, 'docs/' || rtrim(left(regexp_replace(lower(source || ' ' || lang || ' Update'), '[^a-z0-9]+', '-', 'g'), 40), '-') || '-' || left(sha256(source || ' ' || lang || ' Update'), 12) AS branch, left(sha256(text), 12) AS short, upper(left(lang, 1)) || substr(lang, 2) || ' Doc ' || doc_id AS title,
  sha256('https://api.example.com:8080/v1') AS endpoint, {O.framed('source', 'lang', 'text')} AS framed FROM documents""")
def _(spark, d):
    t = F.concat_ws(" ", "source", "lang", F.lit("Update"))
    return V.table(spark, d, "documents").select("doc_id", X.branch_name(t).alias("branch"), X.short_id(F.sha2("text", 256)).alias("short"), X.fallback_title(F.concat(F.lit("a/b/"), "lang", F.lit("-doc__"), F.col("doc_id").cast("string"))).alias("title"), X.endpoint_hash(F.lit("HTTPS://API.example.com:8080/v1//?q=1")).alias("endpoint"), X.framed_hash(F.col("source"), F.col("lang"), F.col("text")).alias("framed"))


@query("source_links", f"WITH {O.CUR} SELECT path, '[`' || path || '`](../../' || path || ')' AS link FROM cur")
def _(spark, d):
    return V.files_cur(spark, d).select("path", X.source_link(F.col("path"), F.lit("docs/generated/index.md")).alias("link"))


@query("encoded_keys", """WITH k AS (SELECT doc_id, source || '/' || upper(left(lang, 1)) || substr(lang, 2) || '/con.é ' || doc_id || '.' AS key, source || '/' || printf('%%%02X', ascii(upper(left(lang, 1)))) || substr(lang, 2) || '/%63on.%C3%A9%20' || doc_id || '%2E' AS encoded FROM documents) SELECT doc_id, key, 'docs/components/' || encoded || '/index.md' AS page, encoded, key AS decoded FROM k""")
def _(spark, d):
    key = F.concat_ws("/", "source", F.initcap("lang"), F.concat(F.lit("con.é "), F.col("doc_id").cast("string"), F.lit(".")))
    rows = V.table(spark, d, "documents").select("doc_id", key.alias("key"), P.component_page("docs", key, F.lit(False)).alias("page"), P.encoded_key(key).alias("encoded"))
    return rows.withColumn("decoded", P.decoded_key(F.col("encoded")))


@query("section_parse", "SELECT doc_id AS doc, 't' AS topic, lang AS key, source AS content, 1 AS begin_line, 3 AS end_line FROM documents WHERE doc_id % 5 IN (1, 2, 3)")
def _(spark, d):
    return rendering.sections(_marked(spark, d))[0]


@query("section_errors", "SELECT doc_id AS doc, 1 AS line, 'unexpected end' AS reason FROM documents WHERE doc_id % 5 = 4")
def _(spark, d):
    return rendering.sections(_marked(spark, d))[1]


def _marked(spark, d):
    n = F.col("doc_id") % 5
    whole = F.concat(F.lit("x\n"), rendering.owned_section(F.lit("t"), F.col("lang"), F.col("source")))
    body = F.when(n == 0, "plain").when(n == 4, F.concat(F.lit("\n"), rendering.marker("end", F.lit("t"), F.lit("k")))).otherwise(whole)
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), body.alias("body"))


@query("topic_document", f"""WITH {O.ITEMS}, {O.MERGED}, {_TOP}, b AS (SELECT section, component_key, string_agg('- **' || title || '**: ' || description || ' (' || array_to_string(list_transform(paths, lambda p: '[`' || p || '`](../' || p || ')'), ', ') || ')', chr(10) ORDER BY position) AS body FROM pos GROUP BY ALL),
  s AS (SELECT section, component_key, '<!-- tallyloom:begin topic="Findings" key="' || component_key || '" -->' || chr(10) || '## ' || component_key || chr(10) || chr(10) || body || chr(10) || '<!-- tallyloom:end topic="Findings" key="' || component_key || '" -->' || chr(10) AS s FROM b)
  SELECT 'docs/' || section || '.md' AS doc, '# Findings' || chr(10) || chr(10) || string_agg(s, chr(10) ORDER BY component_key) AS content FROM s GROUP BY section""")
def _(spark, d):
    top = merge.best_supported(_merged(spark, d), GROUP, "title", 6)
    return rendering.topic_document(rendering.topic_lines(top), F.lit("Findings"))


# --- installed output


def _hashes(df):
    return df.select("path", F.col("source_hash").alias("hash"))


@query("integrity_reasons", f"""WITH {O.CUR}, {O.OLD}, o AS (SELECT path, CASE WHEN doc_id % 23 = 0 THEN '' ELSE source_hash END AS hash FROM old), p AS (SELECT coalesce(o.path, c.path) AS path, CASE WHEN o.path IS NULL THEN 0 WHEN c.path IS NULL THEN 1 WHEN o.hash = '' THEN 2 WHEN o.hash <> c.source_hash THEN 3 END AS priority
  FROM o FULL JOIN cur c ON o.path = c.path) SELECT path, priority, {O.q(output.REASONS)}[priority + 1] AS reason FROM p WHERE priority IS NOT NULL""")
def _(spark, d):
    old, cur = _both(spark, d)
    return output.integrity(_owned(old), _hashes(cur))


def _owned(old):
    return old.select("path", F.when(F.col("doc_id") % 23 == 0, "").otherwise(F.col("source_hash")).alias("hash"))


@query("first_integrity_reason", f"""WITH {O.CUR}, {O.OLD}, o AS (SELECT path, doc_id, CASE WHEN doc_id % 23 = 0 THEN '' ELSE source_hash END AS hash FROM old), i AS (SELECT path, source_hash FROM cur WHERE path IN (SELECT path FROM old)),
  p AS (SELECT o.path, CASE WHEN i.path IS NULL THEN 'an owned generated document is missing' WHEN o.hash = '' THEN 'prior state has no content hash for an owned document' WHEN o.hash <> i.source_hash THEN 'an installed generated document was modified since it was generated' END AS reason FROM o LEFT JOIN i USING (path))
  SELECT arg_min(reason, path) AS reason FROM p WHERE reason IS NOT NULL""")
def _(spark, d):
    old, cur = _both(spark, d)
    return output.first_reason(output.integrity(_owned(old), _hashes(cur).join(old.select("path"), "path", "left_semi")))


@query("output_diff", f"WITH {O.CUR}, {O.OLD} SELECT coalesce(c.path, o.path) AS path, CASE WHEN c.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' WHEN c.source_hash <> o.source_hash THEN 'changed' ELSE 'unchanged' END AS status FROM old o FULL JOIN cur c ON o.path = c.path")
def _(spark, d):
    old, cur = _both(spark, d)
    return output.output_diff(_hashes(cur), _hashes(old))


@query("write_set", f"WITH {O.CUR}, {O.OLD} SELECT c.path, CASE WHEN o.path IS NULL THEN 'added' ELSE 'changed' END AS status FROM cur c LEFT JOIN old o ON o.path = c.path WHERE o.path IS NULL OR o.source_hash <> c.source_hash")
def _(spark, d):
    old, cur = _both(spark, d)
    return output.write_set(output.output_diff(_hashes(cur), _hashes(old)), full=False)


@query("unowned_files", f"WITH {O.CUR}, {O.OLD} SELECT path, 'refuse' AS verdict FROM cur WHERE path NOT IN (SELECT path FROM old)")
def _(spark, d):
    old, cur = _both(spark, d)
    return output.unowned(cur, old)


@query("broken_preconditions", f"WITH {O.CUR}, {O.OLD} SELECT o.path FROM old o LEFT JOIN cur c USING (path) WHERE o.source_hash IS DISTINCT FROM c.source_hash")
def _(spark, d):
    old, cur = _both(spark, d)
    return output.broken_preconditions(_hashes(old), _hashes(cur))


_URL_PATH = "coalesce(nullif(regexp_extract(url, '://[^/]*(/[^?#]*)', 1), ''), '/')"


@query("broken_links", f"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages), d AS (SELECT DISTINCT {_URL_PATH} AS path FROM pages)
  SELECT page_id, target FROM l WHERE starts_with(target, '/') AND regexp_extract(target, '\\A([^?#]*)', 1) NOT IN (SELECT path FROM d)""")
def _(spark, d):
    documents = V.table(spark, d, "pages").select(F.coalesce(F.nullif(F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1), F.lit("")), F.lit("/")).alias("path"))
    return output.broken_links(V.links(spark, d), documents, "page_id")


@query("candidate_issues", f"""WITH c AS (SELECT 'docs/' || doc_id AS path, text, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE 'sha256:' || sha256(text) END AS hash, doc_id FROM documents), k AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'else/' || doc_id WHEN doc_id < 9 THEN 'docs/' || {O.q(rendering.DOCUMENTS)}[doc_id + 1] ELSE path END AS path, text, hash FROM c)
  SELECT 0 AS priority, 'docs/index.md' AS path, 'required_missing' AS code UNION ALL SELECT 1, path, 'outside_root' FROM k WHERE starts_with(path, 'else/') UNION ALL SELECT 3, path, 'hash_mismatch' FROM k WHERE hash = 'x' UNION ALL SELECT 4, max(path), 'too_many' FROM k HAVING count(*) > 100""")
def _(spark, d):
    n = F.col("doc_id")
    path = F.when(n % 11 == 0, F.concat(F.lit("else/"), n.cast("string"))).when(n < 9, F.concat(F.lit("docs/"), F.element_at(F.array(*map(F.lit, rendering.DOCUMENTS)), F.least(n + 1, F.lit(9)).cast("int")))).otherwise(F.concat(F.lit("docs/"), n.cast("string")))
    docs = V.table(spark, d, "documents").select(path.alias("path"), F.col("text").alias("content"), F.when(n % 7 == 0, "x").otherwise(X.content_hash(F.col("text"))).alias("hash"))
    return output.candidate_issues(docs, rendering.DOCUMENTS, "docs", 100)


@query("usage_totals", "SELECT event_type, count(*) AS calls, count(v) AS with_usage, sum(v)::BIGINT AS prompt, sum(v + 1)::BIGINT AS completion, sum(2 * v + 1)::BIGINT AS total FROM (SELECT event_type, CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END AS v FROM events) GROUP BY 1")
def _(spark, d):
    v = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50)
    return output.usage_totals(V.table(spark, d, "events").select("event_type", v.alias("prompt"), (v + 1).alias("completion"), (2 * v + 1).alias("total")), ["event_type"])


@query("calls_by_kind", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) AS calls FROM events GROUP BY 1")
def _(spark, d):
    return V.table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("click"), F.count_if(F.col("event_type") == "view").alias("view"), F.count(F.lit(1)).alias("calls"))


# --- records and generation


@query("index_records", f"WITH {O.TRACKED} SELECT path, mode, left(sha256(data), 40) AS object_id FROM tracked WHERE doc_id % 6 <> 0")
def _(spark, d):
    return records.index_records(_index(spark, d))[0]


@query("index_rejects", f"WITH {O.TRACKED} SELECT count(*) AS n, CASE WHEN doc_id % 12 = 0 THEN 'unmerged' ELSE 'unclean_path' END AS reason FROM tracked WHERE doc_id % 6 = 0 GROUP BY 2")
def _(spark, d):
    return records.index_records(_index(spark, d))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _index(spark, d):
    n = F.col("doc_id")
    row = F.concat("mode", F.lit(" "), F.left(F.sha2("data", 256), F.lit(40)), F.when(n % 12 == 0, " 2\t").otherwise(" 0\t"), F.when(n % 12 == 6, "../").otherwise(""), "path", F.lit("\0"))
    return V.tracked(spark, d).select(row.alias("raw"))


@query("change_records", "SELECT CASE doc_id % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' WHEN 2 THEN 'deleted' ELSE 'renamed' END AS status, CASE WHEN doc_id % 4 >= 2 THEN 'a' || doc_id END AS old_path, CASE doc_id % 4 WHEN 2 THEN NULL WHEN 3 THEN 'b' || doc_id ELSE 'a' || doc_id END AS new_path, CASE WHEN doc_id % 4 = 3 THEN 87 END::INTEGER AS similarity FROM documents")
def _(spark, d):
    n, s = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    raw = F.concat(F.element_at(F.array(*map(F.lit, ["A", "M", "D", "R087"])), (n + 1).cast("int")), F.lit("\0a"), s, F.when(n == 3, F.concat(F.lit("\0b"), s)).otherwise(""), F.lit("\0"))
    return records.change_records(V.table(spark, d, "documents").select(raw.alias("raw")))


@query("response_failures", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'truncated' WHEN 1 THEN 'empty' WHEN 2 THEN 'response_too_large' WHEN 3 THEN 'incomplete' WHEN 5 THEN 'incomplete' WHEN 6 THEN 'invalid_envelope' WHEN 7 THEN 'empty' END AS failure, CASE WHEN event_id % 8 = 4 THEN 'ok' END AS body, CASE WHEN event_id % 8 = 4 THEN event_id END AS total FROM events""")
def _(spark, d):
    n = F.col("event_id") % 8
    content = F.when(n == 1, "").when(n == 2, F.repeat(F.lit("x"), 99)).otherwise("ok")
    finish = F.when(n == 0, "length").when(n == 3, "content_filter").when(n == 5, "tool_calls").otherwise("stop")
    choice = F.struct(finish.alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    envelope = F.to_json(F.struct(F.lit("r").alias("id"), F.when(n == 7, F.array()).otherwise(F.array(choice)).alias("choices"), F.struct(F.col("event_id").alias("total_tokens")).alias("usage")))
    rows = V.table(spark, d, "events").select("event_id", F.when(n == 6, "{").otherwise(envelope).alias("raw"))
    return records.chat_answers(rows, 50).select("event_id", "failure", "body", "total")


@query("reply_failures", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'truncated' WHEN 1 THEN 'incomplete' WHEN 2 THEN 'empty' WHEN 3 THEN 'incomplete' WHEN 4 THEN 'invalid_envelope' END AS failure, CASE WHEN event_id % 6 = 5 THEN 'ab' END AS body FROM events""")
def _(spark, d):
    n = F.col("event_id") % 6
    status = F.when(n < 2, "incomplete").when(n == 3, "failed").otherwise("completed")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), F.lit(text).alias("text"))
    content = F.when(n == 2, F.array(part("refusal", "no"))).otherwise(F.array(part("output_text", "a"), part("refusal", "x"), part("text", "b")))
    envelope = F.to_json(F.struct(status.alias("status"), F.struct(F.when(n == 0, "max_output_tokens").otherwise("content_filter").alias("reason")).alias("incomplete_details"), F.array(F.struct(content.alias("content"))).alias("output")))
    rows = V.table(spark, d, "events").select("event_id", F.when(n == 4, "[1]").otherwise(envelope).alias("raw"))
    return records.reply_answers(rows, 50).select("event_id", "failure", "body")


@query("generated_responses", """WITH r AS (SELECT conv_id || ':' || turn AS request_id, text, sha256(text) AS h FROM conversations), b AS (SELECT *, '{"complete": true, "omitted_count": 0, "items": [{"title": "Item ' || left(h, 8) || '", "description": "Derived from request ' || substr(h, 9, 8) || '."}]}' AS body FROM r)
  SELECT request_id, body, 'stop' AS finish_reason, (strlen(text) // 4 + 1)::INTEGER AS prompt_tokens, (strlen(body) // 4 + 1)::INTEGER AS completion_tokens, (strlen(text) // 4 + strlen(body) // 4 + 2)::INTEGER AS total_tokens, 1 AS attempts FROM b""")
def _(spark, d):
    requests = V.table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("request_id"), F.col("text").alias("request"))
    return generator.generate(requests)


# --- requests


@query("request_sizes", "SELECT doc_id, strlen('{\"component\":' || to_json(source)::VARCHAR || ',\"text\":' || to_json(text)::VARCHAR || '}')::BIGINT + 1024 AS bytes, 100 + 3 * 65536 * (doc_id % 9) AS synthesis FROM documents")
def _(spark, d):
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", requests.request_bytes(F.col("source").alias("component"), "text").alias("bytes"), requests.synthesis_bytes(F.lit(100).cast("long"), F.col("doc_id") % 9, 65536).alias("synthesis"))


@query("strategy_choice", f"""WITH {O.CUR}, c AS (SELECT component_key, root_component, sum(size) FILTER (WHERE triggers)::BIGINT AS bytes, max(size) FILTER (WHERE triggers) AS largest, ['auto', 'dossier', 'fragments'][strlen(component_key) % 3 + 1] AS wanted FROM cur GROUP BY ALL HAVING count(*) FILTER (WHERE triggers) > 0),
  s AS (SELECT *, bytes <= 60000 AND bytes + 1024 <= 50000 AS once FROM c), t AS (SELECT *, CASE WHEN wanted <> 'auto' THEN wanted WHEN once THEN 'dossier' ELSE 'fragments' END AS strategy FROM s)
  SELECT component_key, root_component, strategy, CASE WHEN strategy = 'fragments' THEN 'fragments' WHEN once THEN 'normal' WHEN largest > 12000 OR (bytes + 11999) // 12000 < 2 THEN 'error' ELSE 'batches' END AS mode FROM t""")
def _(spark, d):
    c = V.files_cur(spark, d).where("triggers").groupBy(*KEY).agg(F.sum("size").alias("bytes"), F.max("size").alias("largest"))
    wanted = F.element_at(F.array(F.lit("auto"), F.lit("dossier"), F.lit("fragments")), F.octet_length("component_key") % 3 + 1)
    once = requests.fits_once(F.col("bytes"), F.col("bytes") + 1024, 60_000, 50_000)
    c = c.withColumn("strategy", requests.strategy(wanted, once))
    return c.select(*KEY, "strategy", requests.request_mode(F.col("strategy"), once, F.col("largest"), N.ceil_div(F.col("bytes"), 12_000), 12_000).alias("mode"))


@query("config_impact", """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'unknown' ELSE concat_ws(',', CASE WHEN doc_id % 2 = 0 THEN 'paths' END, CASE WHEN doc_id % 3 = 0 THEN 'source' END) END AS impact FROM documents""")
def _(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", F.col("lang").alias("paths"), "source")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "x").otherwise(F.col("paths")).alias("paths"), F.when(F.col("doc_id") % 3 == 0, None).otherwise(F.col("source")).alias("source"))
    return requests.config_impact(old, docs, "doc_id").select("doc_id", F.array_join("impact", ",").alias("impact"))


@query("failure_categories", """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'call_limit' WHEN 2 THEN 'truncated' WHEN 3 THEN 'transport' WHEN 4 THEN 'schema_validation' WHEN 5 THEN 'output_validation' WHEN 6 THEN 'response_too_large' ELSE 'generation' END AS category, CASE WHEN event_id % 4 = 0 OR event_id % 3 = 0 THEN 'full' ELSE 'incremental' END AS kind FROM events""")
def _(spark, d):
    n = F.col("event_id")
    error = F.element_at(F.array(*map(F.lit, ["deadline_exceeded", "call_limit", "completion", "transport", "dossier_validation", "output_validation", "completion", "odd"])), (n % 8 + 1).cast("int"))
    return V.table(spark, d, "events").select("event_id", requests.failure_category(error, F.when(n % 8 == 2, "truncated").otherwise("response_too_large")).alias("category"), requests.change_kind(n % 4 == 0, n % 3).alias("kind"))


@query("scope_order", """WITH s AS (SELECT '1:' || conv_id AS identity, turn::INTEGER AS batch, (conv_id % 3 + 1)::INTEGER AS batch_count, (turn % 2)::INTEGER AS chunk, 1 AS chunk_count, 'b' || turn || CASE WHEN role = 'user' THEN '/0' ELSE '' END AS split_path, CASE role WHEN 'user' THEN 'workflows' WHEN 'assistant' THEN 'architecture' ELSE 'interfaces' END AS kind FROM conversations)
  SELECT identity, batch, batch_count, split_path, kind, row_number() OVER (ORDER BY identity, batch, batch_count, chunk, chunk_count, split_path, kind) AS place FROM s""")
def _(spark, d):
    t = V.scopes(spark, d)
    kind = F.when(F.col("kind") == "user", "workflows").when(F.col("kind") == "assistant", "architecture").otherwise("interfaces")
    path = F.concat(F.lit("b"), F.col("turn").cast("string"), F.when(F.col("kind") == "user", "/0").otherwise(""))
    rows = t.select(F.concat(F.lit("1:"), F.col("conv_id").cast("string")).alias("identity"), F.col("turn").cast("int").alias("batch"), (F.col("conv_id") % 3 + 1).cast("int").alias("batch_count"), (F.col("turn") % 2).cast("int").alias("chunk"), F.lit(1).alias("chunk_count"), path.alias("split_path"), kind.alias("kind"))
    return requests.scope_order(rows).select("identity", "batch", "batch_count", "split_path", "kind", F.col("place").cast("long").alias("place"))


def _expected(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_INDEX = "# Repository Documentation\n\nThis knowledge base is generated by tallyloom. It is the primary entry point for\nmaintainers, onboarding engineers, API consumers, and AI coding assistants.\n\n## Documents\n\n- [Codebase Info](codebase_info.md) — Scanner metadata, detected languages, manifests, and the component hierarchy.\n- [Components](components.md) — Catalog of components with purpose and responsibilities.\n- [Architecture](architecture.md) — Architectural responsibilities and boundaries per component.\n- [Interfaces](interfaces.md) — APIs, events, commands, and integration points per component.\n- [Data Models](data_models.md) — Entities, schemas, fields, relationships, and class diagrams.\n- [Workflows](workflows.md) — Runtime and development flows with flow and sequence diagrams.\n- [Dependencies](dependencies.md) — External and internal dependencies per component.\n- [Review Notes](review_notes.md) — Deterministic scanner notes and model-reported review gaps.\n\n## Components\n\n"
_INDEX_END = "\n\n## Navigation\n\nStart with the topic documents for a cross-component view, or open a component page\nfor its complete dossier. Each component owns clearly marked sections in the topic\ndocuments; generated content is managed by tallyloom and should not be edited by hand.\n"


@query("index_document", f"WITH {O.CUR}, k AS (SELECT DISTINCT component_key, root_component FROM cur) SELECT 'docs/index.md' AS path, {_expected(_INDEX)} || string_agg('- [`' || component_key || '`](components/' || component_key || '/index.md)', chr(10) ORDER BY root_component DESC, component_key) || {_expected(_INDEX_END)} AS content FROM k")
def _(spark, d):
    keys = V.files_cur(spark, d).select(*KEY).distinct()
    return documents.index(keys.withColumn("document", F.concat(F.lit("docs/components/"), "component_key", F.lit("/index.md"))), "docs")


_TREE = """k AS (SELECT component_key, row_number() OVER (ORDER BY component_key) AS n FROM (SELECT DISTINCT component_key FROM cur WHERE component_key <> '@root') QUALIFY n <= 59),
  p AS (SELECT k.component_key, k.n, coalesce(max_by(q.n, length(q.component_key)), 0) AS pn FROM k LEFT JOIN k q ON starts_with(k.component_key, q.component_key || '/') GROUP BY ALL),
  t AS (SELECT 1 AS part, n, '  n' || n || '["' || component_key || '"]' AS line FROM p UNION ALL SELECT 2, n, '  n' || pn || ' --> n' || n FROM p),
  tree AS (SELECT 'flowchart TD' || chr(10) || '  n0["@root"]' || chr(10) || string_agg(line, chr(10) ORDER BY part, n) AS content FROM t)"""
_HEAD = "# Codebase Info\n\nDeterministic metadata collected by the scanner. This document contains no model output.\n\n## Summary\n\n| Metric | Value |\n| --- | --- |\n| Tracked files | "


@query("codebase_document", _SCAN + f""", {O.CUR.replace(O.TRACKED + "," + chr(10), "")}, {_TREE}, l AS (SELECT {_LANG} AS language, count(*) AS files FROM scan WHERE role IN ('production_source', 'unknown_source') GROUP BY 1)
  SELECT 'docs/codebase_info.md' AS path, {_expected(_HEAD)} || (SELECT count(*) FROM scan) || ' |' || chr(10) || '| Included as context | ' || (SELECT count(*) FROM scan WHERE included) || ' |' || chr(10) || '| Triggering regeneration | ' || (SELECT count(*) FROM scan WHERE triggers) || ' |' || chr(10) || '| Excluded | ' || (SELECT count(*) FROM scan WHERE NOT included) || ' |' || chr(10)
  || '| Components | ' || (SELECT count(*) FROM (SELECT DISTINCT component_key, root_component FROM cur)) || ' |' || chr(10) || chr(10) || '## Languages' || chr(10) || chr(10) || '| Language | Files |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || language || ' | ' || files || ' |', chr(10) ORDER BY files DESC, language) FROM l) || chr(10) || chr(10)
  || '## Dependency Manifests' || chr(10) || chr(10) || (SELECT string_agg('- [`' || path || '`](../' || path || ')', chr(10) ORDER BY path) FROM cur WHERE role = 'dependency_manifest') || chr(10) || chr(10) || '## Component Hierarchy' || chr(10) || chr(10) || '```mermaid' || chr(10) || (SELECT content FROM tree) || chr(10) || '```' || chr(10) || chr(10) || '_3 additional component(s) omitted from the diagram; see review notes._' || chr(10) AS content""")
def _(spark, d):
    decisions, files = classify.scan(V.tracked(spark, d), POLICY), V.files_cur(spark, d)
    manifests = files.where("role = 'dependency_manifest'").select("path")
    return documents.codebase_info(decisions, classify.language_histogram(decisions), manifests, files.select(*KEY).distinct(), rendering.hierarchy_text(components.parents(files)), "docs", 3)


@query("hierarchy_diagram", f"""WITH {O.CUR}, k AS (SELECT component_key, row_number() OVER (ORDER BY component_key) AS n FROM (SELECT DISTINCT component_key FROM cur WHERE component_key <> '@root') QUALIFY n <= 59),
  p AS (SELECT k.component_key, k.n, coalesce(max_by(q.n, length(q.component_key)), 0) AS pn FROM k LEFT JOIN k q ON starts_with(k.component_key, q.component_key || '/') GROUP BY ALL),
  l AS (SELECT 1 AS part, n, '  n' || n || '["' || component_key || '"]' AS line FROM p UNION ALL SELECT 2, n, '  n' || pn || ' --> n' || n FROM p) SELECT 'flowchart TD' || chr(10) || '  n0["@root"]' || chr(10) || string_agg(line, chr(10) ORDER BY part, n) AS content FROM l""")
def _(spark, d):
    return rendering.hierarchy_text(components.parents(V.files_cur(spark, d)))


@query("reused_documents", f"WITH {O.CUR}, {O.OLD} SELECT coalesce(c.path, o.path) AS path, coalesce(c.source_hash, o.source_hash) AS content FROM (SELECT * FROM cur WHERE doc_id % 2 = 0) c FULL JOIN old o ON c.path = o.path")
def _(spark, d):
    old, cur = _both(spark, d)
    return rendering.reused(cur.where("doc_id % 2 = 0").select("path", F.col("source_hash").alias("content")), old.select("path", F.col("source_hash").alias("content")))


@query("review_request", f"WITH {O.CUR}, {O.OLD}, s AS (SELECT CASE WHEN c.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'added' WHEN c.source_hash <> o.source_hash THEN 'changed' ELSE 'unchanged' END AS status FROM old o FULL JOIN cur c ON o.path = c.path) SELECT '# Update' || chr(10) || chr(10) || count(*) || ' documents: ' || count(*) FILTER (WHERE status = 'added') || ' added, ' || count(*) FILTER (WHERE status = 'changed') || ' changed, ' || count(*) FILTER (WHERE status = 'deleted') || ' deleted.' || chr(10) AS body FROM s")
def _(spark, d):
    old, cur = _both(spark, d)
    n = output.output_diff(_hashes(cur), _hashes(old)).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("status") == x).alias(x) for x in ("added", "changed", "deleted")])
    return n.select(rendering.request_text(F.lit("Update"), F.col("all"), F.col("added"), F.col("changed"), F.col("deleted")).alias("body"))


@query("candidate_checks", """WITH c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'else/' ELSE 'docs/' END || doc_id || '.md' AS path FROM documents), v(step, code, m, k) AS (VALUES (2, 'outside_root', 11, 0), (3, 'sections', 5, 1), (4, 'secret', 5, 2), (5, 'broken_link', 5, 3), (7, 'hash_mismatch', 5, 4))
  SELECT step, path, code FROM c JOIN v ON doc_id % m = k UNION ALL SELECT 6, path, 'hash_missing' FROM c WHERE doc_id % 7 = 0 AND doc_id % 5 <> 4 UNION ALL SELECT 1, 'docs/index.md', 'required_missing' UNION ALL SELECT 8, 'docs/gone.md', 'not_rendered'""")
def _(spark, d):
    n = F.col("doc_id")
    path = F.concat(F.when(n % 11 == 0, "else/").otherwise("docs/"), n.cast("string"), F.lit(".md"))
    own = rendering.owned_section(F.lit("t"), F.lit("k"), F.lit("see [it](./x/../a.md) and [up](../y.go)"))
    body = F.when(n % 5 == 1, rendering.marker("end", F.lit("t"), F.lit("k"))).when(n % 5 == 2, F.lit("-----BEGIN PRIVATE KEY-----")).when(n % 5 == 3, "[x](nowhere.md) [y](http://z/q)").otherwise(F.when(n == 0, own).otherwise("plain"))
    docs = V.table(spark, d, "documents").select("doc_id", path.alias("path"), body.alias("content"))
    a = spark.createDataFrame([("docs/a.md", "plain"), ("else/a.md", "x")], "path string, content string").where("path = 'docs/a.md' or path = 'else/a.md'")
    rows = docs.select("path", "content").unionByName(a)
    hashed = rows.select("path", X.content_hash(F.col("content")).alias("hash")).join(docs.select("path", "doc_id"), "path", "left")
    state = hashed.where("doc_id is null or doc_id % 7 <> 0 or doc_id % 5 = 4").select("path", F.when(F.coalesce(n % 5 == 4, F.lit(False)), "x").otherwise(F.col("hash")).alias("hash"))
    state = state.unionByName(spark.createDataFrame([("docs/gone.md", "h")], "path string, hash string"))
    expected = docs.where("doc_id = 0").select(F.col("path").alias("doc"), F.lit(1).alias("n"), F.lit("t").alias("topic"), F.lit("k").alias("key"))
    found = output.candidate_checks(rows, rendering.sections(rows, "path", "content"), expected, state, ["index.md"], "docs", classify.secret_content)
    return found.where("path not in ('docs/a.md', 'else/a.md')")


@query("identities", """SELECT doc_id, sha256('{"source":"' || source || '","none":null}') AS struct_hash, CASE WHEN doc_id % 2 = 0 THEN '0:' ELSE '1:' END || source AS identity, source || '/a%20b%C3%A9' AS safe FROM documents""")
def _(spark, d):
    docs = V.table(spark, d, "documents").withColumn("none", F.lit(None).cast("string"))
    return docs.select("doc_id", X.struct_hash("source", "none").alias("struct_hash"), X.identity(F.col("source"), F.col("doc_id") % 2 == 0).alias("identity"), X.safe_key(F.concat("source", F.lit("/a bé"))).alias("safe"))


@query("section_sequence", "SELECT doc_id AS doc, 1 AS n FROM documents WHERE doc_id % 5 IN (0, 4) UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 5 = 3")
def _(spark, d):
    found = rendering.sections(_marked(spark, d))[0].select("doc", "topic", "key", "begin_line")
    n = F.col("doc_id") % 5
    expected = V.table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.lit(1).alias("n"), F.lit("t").alias("topic"), F.when(n == 3, "other").otherwise(F.col("lang")).alias("key"))
    return rendering.sequence_issues(found, expected)


@query("coverage_plan_issues", "SELECT component_key, code FROM (SELECT DISTINCT source AS component_key, substr(source, 4)::INTEGER % 5 AS m FROM documents) JOIN (VALUES (1, 'batches'), (2, 'kinds'), (3, 'evidence'), (4, 'chunks')) v(k, code) ON m = v.k")
def _(spark, d):
    names = V.table(spark, d, "documents").select(F.col("source").alias("component_key")).distinct()
    m = F.substring("component_key", 4, 9).cast("int") % 5
    rows = names.select("component_key", m.alias("m"), F.explode(F.array(F.lit(1), F.lit(2))).alias("b")).select("*", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("kind"))
    rows = rows.where("not (m = 2 and b = 1 and kind = 'y')")
    plan = rows.select("component_key", F.when((F.col("m") == 1) & (F.col("b") == 2), 3).otherwise(F.col("b")).alias("batch"), F.when(F.col("m") == 1, 3).otherwise(2).alias("batch_count"), F.lit(1).alias("chunk"), F.when(F.col("m") == 4, 2).otherwise(1).alias("chunk_count"), "kind", F.array(F.when(F.col("m") == 3, F.col("kind")).otherwise("e")).alias("evidence"))
    return coverage.plan_issues(plan, ["x", "y"])


@query("enum_issues", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'empty_value' WHEN 1 THEN 'invalid_enum' END AS code, event_id % 2 = 1 OR event_id % 5 = 2 AS saturated, CASE WHEN event_id % 2 = 0 AND event_id % 4 > 0 THEN 'invalid_value' END AS claim FROM events")
def _(spark, d):
    e = F.col("event_id")
    value = F.when(e % 3 == 0, "").when(e % 3 == 1, "odd").otherwise("inbound")
    saturated, claim = validation.saturation(e % 2 == 0, e % 5, 2, e % 4)
    return V.table(spark, d, "events").select("event_id", validation.enum_issue(value, ["inbound", "outbound", "internal"]).alias("code"), saturated.alias("saturated"), claim.alias("claim"))


@query("all_notices", """WITH c AS (SELECT doc_id FROM documents WHERE doc_id % 9 = 1) SELECT doc_id, v.slot, v.kind, replace(v.text, '#', '2') AS description FROM c, (VALUES
  (0, 'inconsistency', 'Assembly retained conflicting claims for # structural identities.'), (1, 'missing_context', 'Fragment coverage reached a bounded item limit for # source scopes.'), (2, 'missing_context', 'Assembly omitted # items because assembled section limits were reached.'),
  (3, 'missing_context', 'Assembly omitted # item citations and # top-level source paths because evidence limits were reached.'), (4, 'uncertainty', 'Assembly used a deterministic component overview after # bounded fallback event.'), (5, 'missing_context', 'Assembly omitted diagrams after # bounded fallback event.')) v(slot, kind, text)""")
def _(spark, d):
    counts = V.table(spark, d, "documents").select("doc_id", *[F.when(F.col("doc_id") % 9 == 1, 2).otherwise(0).cast("long").alias(c) for c in ("c0", "c1", "c2", "c3", "c3b", "c4", "c5")])
    return merge.notices(counts, ["doc_id"]).drop("recommendation")
