"""Scan decisions and roles of tracked files, as one projection over path, mode and content."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import basename, extension, has_segment, matches_any, within

# What file names, extensions and folders tell of a file's role. All matching is on lower-case paths.
GENERATED_FOLDERS = ["generated", "gen", "dist", "build", "target", "vendor", "node_modules"]
LOCK_NAMES = ["go.sum", "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock"]
FIXTURE_FOLDERS = ["fixture", "fixtures", "snapshot", "snapshots", "testdata", "__snapshots__"]
TEST_FOLDERS = ["test", "tests", "__tests__", "spec", "specs"]
CONTRACT_EXTENSIONS = [".proto", ".graphql", ".gql", ".avsc", ".thrift", ".wsdl", ".xsd"]
CONTRACT_FOLDERS = ["contracts", "schemas"]
DATABASE_FOLDERS = ["migration", "migrations"]
MANIFEST_NAMES = ["go.mod", "package.json", "pyproject.toml", "pipfile", "cargo.toml", "pom.xml", "build.gradle", "build.gradle.kts", "composer.json", "gemfile", "mix.exs", "setup.py", "setup.cfg", "environment.yml", "environment.yaml"]
RUNTIME_FOLDERS = ["deploy", "deployment", "k8s", "kubernetes", "helm", "terraform"]
RUNTIME_EXTENSIONS = [".yaml", ".yml", ".toml", ".ini", ".conf", ".properties", ".tf", ".hcl"]
SOURCE_EXTENSIONS = [
    ".go", ".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".kts", ".scala", ".rs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".cs", ".fs", ".fsx", ".rb", ".php", ".swift", ".m", ".mm", ".ex", ".exs", ".erl", ".hrl", ".clj", ".cljs",
    ".sh", ".bash", ".zsh", ".fish", ".lua", ".r", ".dart", ".vue", ".svelte", ".sol", ".html", ".htm", ".css", ".scss", ".sass", ".less", ".templ", ".tmpl", ".hbs",
]
SOURCE_FOLDERS = ["cmd", "src", "lib", "app", "internal", "pkg", "services", "packages"]
INTERPRETERS = ["python", "node", "deno", "ruby", "perl", "php", "bash", "sh", "zsh"]
PROSE_EXTENSIONS = [".md", ".mdx", ".markdown", ".adoc", ".asciidoc", ".rst", ".txt"]
SECRET_NAMES = [".env", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json", "secrets.yml", "secrets.yaml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519"]
SECRET_EXTENSIONS = [".key", ".p12", ".pfx", ".jks"]
SECRET_HEADERS = ["PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"]
SECRET_PATTERNS = ["AKIA[0-9A-Z]{16}", "gh[pousr]_[A-Za-z0-9]{36,}", "github_pat_[A-Za-z0-9_]{50,}", "xox[baprs]-[A-Za-z0-9-]{20,}"]
#: The roles in the order in which they are tried, with the reason each gives.
ROLES = {
    "generated_code": "generated_code",
    "lock_file": "dependency_lock",
    "fixture": "fixture_or_snapshot",
    "test": "test_source",
    "contract": "contract_or_schema",
    "database": "database_schema_or_migration",
    "dependency_manifest": "dependency_manifest",
    "runtime_configuration": "runtime_or_tool_configuration",
    "production_source": "production_source",
    "prose": "handwritten_prose",
    "unknown_source": "unknown_text_source",
}
MODES = ["100644", "100755", "120000"]


@dataclass(frozen=True)
class SourcePolicy:
    """What is scanned, and which of the optional roles serve as context or trigger work."""

    docs_dir: str = "docs/generated"
    state_path: str = ".state/state.json"
    report_path: str = ""
    include: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = ()
    overrides: tuple[tuple[str, str], ...] = ()
    max_bytes: int = 1 << 20
    tests: tuple[bool, bool] = (True, False)
    generated: tuple[bool, bool] = (False, False)
    fixtures: tuple[bool, bool] = (False, False)
    extra: dict = field(default_factory=dict, compare=False)


def header(data: Column) -> Column:
    """The first 4096 bytes, in lower case."""
    return F.lower(F.decode(F.substring(F.encode(data, "utf-8"), 1, 4096), "iso-8859-1"))


def marked(head: Column) -> Column:
    """Whether a header says that the file is generated."""
    return (head.contains("code generated") & head.contains("do not edit")) | head.contains("@generated") | head.contains("autogenerated file")


def generated_header(data: Column) -> Column:
    return marked(header(data))


def role_tests(path: Column, data: Column | None, parts: tuple[Column, Column, Column, Column] | None = None) -> dict[str, Column]:
    """For each role the test for it, on path and, where given, content. parts: columns that hold the lower path, its base
    name, its extension and the content's header already."""
    p = F.lower(path)
    p, base, ext, head = parts or (p, basename(p), extension(p), None if data is None else header(data))
    content = lambda test: F.coalesce(test(data), F.lit(False)) if data is not None else F.lit(False)
    shebang = rf"(?i)\A#![^\n]*(?:{'|'.join(INTERPRETERS)})"
    return {
        "generated_code": has_segment(p, GENERATED_FOLDERS) | content(lambda _: marked(head)),
        "lock_file": (ext == ".lock") | base.isin(LOCK_NAMES),
        "fixture": has_segment(p, FIXTURE_FOLDERS) | base.contains(".min.") | base.endswith(".map"),
        "test": has_segment(p, TEST_FOLDERS) | base.rlike(r"_test\.go\z|\Atest_.*\.py\z|\.test\.|\.spec\."),
        "contract": ext.isin(CONTRACT_EXTENSIONS) | base.rlike(r"openapi|swagger|schema\.json") | has_segment(p, CONTRACT_FOLDERS),
        "database": (ext == ".sql") | has_segment(p, DATABASE_FOLDERS),
        "dependency_manifest": base.isin(MANIFEST_NAMES) | base.rlike(r"\Arequirements.*\.txt\z"),
        "runtime_configuration": p.startswith(".github/workflows/") | has_segment(p, RUNTIME_FOLDERS) | base.rlike(r"\Adockerfile(?:\.|\z)|\Adocker-compose|\Amakefile\z|\Atsconfig.*\.json\z|\A\.eslintrc|\A\.prettierrc|\A\..*(?:rc\z|config)") | ext.isin(RUNTIME_EXTENSIONS),
        "production_source": ext.isin(SOURCE_EXTENSIONS) | ((ext == "") & has_segment(p, SOURCE_FOLDERS)) | content(lambda d: d.rlike(shebang)),
        "prose": ext.isin(PROSE_EXTENSIONS),
    }


def _first(tests: dict[str, Column], values: dict[str, str], last: str, overrides: list[tuple[Column, str]]) -> Column:
    chain = None
    for test, value in [*overrides, *((tests[r], values[r]) for r in tests)]:
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(last)


def role_expression(path: Column, data: Column | None = None, overrides: tuple[tuple[str, str], ...] = ()) -> Column:
    """The first role whose test holds; the first override glob that fits comes before all."""
    return _first(role_tests(path, data), {r: r for r in ROLES}, "unknown_source", [(matches_any(path, [g]), r) for g, r in overrides])


def reason_expression(path: Column, data: Column | None = None, overrides: tuple[tuple[str, str], ...] = ()) -> Column:
    return _first(role_tests(path, data), ROLES, ROLES["unknown_source"], [(matches_any(path, [g]), "role_override") for g, _ in overrides])


def with_role(files: DataFrame, overrides: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Files (path, data) with their role. What the tests share is bound to columns first, and the role comes out of a
    generator of one row: a filter on the role then stays above it, where the optimizer would else write all tests, with all
    that path and content are made of, into each filter, and the generated method would be too long to be compiled."""
    rows = files.withColumns({"lower_": F.lower("path"), "head_": header(F.col("data"))})
    rows = rows.withColumns({"base_": basename(F.col("lower_")), "ext_": extension(F.col("lower_"))})
    tests = role_tests(F.col("path"), F.col("data"), tuple(F.col(c) for c in ("lower_", "base_", "ext_", "head_")))
    role = _first(tests, {r: r for r in ROLES}, "unknown_source", [(matches_any(F.col("path"), [g]), r) for g, r in overrides])
    return rows.select(*files.columns, F.explode(F.array(role)).alias("role"))


def secret_path(path: Column) -> Column:
    base = F.lower(basename(path))
    ext = extension(base)
    return base.isin(SECRET_NAMES) | base.startswith(".env.") | ext.isin(SECRET_EXTENSIONS) | (base.contains("service-account") & (ext == ".json"))


def secret_content(data: Column) -> Column:
    """A private key's header in any case, or one of the patterns."""
    headers = "|".join(SECRET_HEADERS)
    return data.rlike(rf"(?i)-----BEGIN (?:{headers})-----") | data.rlike("|".join(f"(?:{p})" for p in SECRET_PATTERNS))


def binary_content(data: Column) -> Column:
    return (F.instr(data, "\0") > 0) | ~F.is_valid_utf8(data)


def policy_table(spark, policy: SourcePolicy = SourcePolicy()) -> DataFrame:
    """role, included, triggers: sixteen rows at most, to be joined by role."""
    fixed = {"test": policy.tests, "generated_code": policy.generated, "fixture": policy.fixtures, "prose": (True, False)}
    never = ["lock_file", "generated_documentation", "secret", "binary", "oversized", "special_git_entry"]
    rows = [(r, *fixed.get(r, (True, True))) for r in ROLES if r not in never] + [(r, False, False) for r in never]
    return spark.createDataFrame(rows, "role string, included boolean, triggers boolean")


def scan(tracked: DataFrame, policy: SourcePolicy = SourcePolicy(), strict: bool = False) -> DataFrame:
    """path, role, reason, included, triggers, size, secret: a decision for each row of `tracked` (path, mode, data, size).

    The first rule that holds decides; those on path and mode come first, so that filters on them need no content.
    A secret in the content of a file that serves as context is flagged, or raises where `strict`.
    """
    path, data = F.col("path"), F.col("data")
    before = [
        (secret_path(path), "secret", "secret_filename"),
        (within(path, policy.docs_dir) | path.isin(policy.state_path, policy.report_path or policy.state_path), "generated_documentation", "tool_owned_output"),
        (F.col("mode") == "160000", "special_git_entry", "git_submodule"),
        (~F.coalesce(F.col("mode").isin(MODES), F.lit(False)), "special_git_entry", "unsupported_git_mode"),
        (~matches_any(path, list(policy.include)), None, "source_include_miss"),
        (matches_any(path, list(policy.exclude)), None, "source_exclude_pattern"),
        (F.col("size") > policy.max_bytes, "oversized", "file_size_limit"),
        (binary_content(data), "binary", "binary_content"),
    ]
    early = role_expression(path, None, policy.overrides)
    role, reason = None, None
    for test, r, why in before:
        value = F.lit(r) if r else early
        role = F.when(test, value) if role is None else role.when(test, value)
        reason = F.when(test, F.lit(why)) if reason is None else reason.when(test, F.lit(why))
    ruled_out = F.coalesce(*[F.when(t, F.lit(True)) for t, *_ in before], F.lit(False))
    # the tests on path and content run once, for the reason; a reason tells the role, but for overrides
    by_reason = F.create_map(*[F.lit(x) for r, why in ROLES.items() for x in (why, r)])
    late = role_expression(path, data, policy.overrides) if policy.overrides else F.try_element_at(by_reason, F.col("late"))
    rows = tracked.withColumns({"late": reason_expression(path, data, policy.overrides), "ruled_out": ruled_out})
    rows = rows.select("*", role.otherwise(late).alias("role"), reason.otherwise(F.col("late")).alias("reason"))
    rows = rows.join(F.broadcast(policy_table(tracked.sparkSession, policy).withColumnsRenamed({"included": "by_role", "triggers": "triggers_by_role"})), "role", "left")
    included = F.coalesce("by_role", F.lit(False)) & ~F.col("ruled_out")
    triggers = F.coalesce("triggers_by_role", F.lit(False)) & ~F.col("ruled_out")
    secret = included & F.coalesce(secret_content(data), F.lit(False))
    if strict:
        secret = F.when(secret, F.raise_error(F.concat(F.lit("secret value in "), path)).cast("boolean")).otherwise(secret)
    size = F.when(F.col("reason").isin("secret_filename", "tool_owned_output", "git_submodule", "unsupported_git_mode", "source_include_miss", "source_exclude_pattern"), 0).otherwise(F.col("size"))
    return rows.select("path", "role", "reason", included.alias("included"), triggers.alias("triggers"), size.cast("long").alias("size"), secret.alias("secret"))


# The languages that extensions stand for.
LANGUAGES = {
    ".go": "Go", ".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript",
    ".ts": "TypeScript", ".tsx": "TypeScript", ".java": "Java", ".kt": "Kotlin",
    ".rb": "Ruby", ".rs": "Rust", ".c": "C", ".h": "C", ".cc": "C++", ".cpp": "C++",
    ".cs": "C#", ".php": "PHP", ".swift": "Swift", ".scala": "Scala", ".sh": "Shell",
    ".sql": "SQL", ".proto": "Protocol Buffers",
}


def language(path: Column) -> Column:
    """The language that the extension stands for, else Other."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.lower(extension(path))), F.lit("Other"))


def language_histogram(files: DataFrame) -> DataFrame:
    """Files by language, of production and unknown sources only; the most common first."""
    counted = files.where(F.col("role").isin("production_source", "unknown_source")).groupBy(language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("files"))
    return counted.orderBy(F.desc("files"), "language")


def review_worthy(decisions: DataFrame) -> DataFrame:
    """Exclusions that a reader should know of."""
    return decisions.where(F.col("reason").isin("file_size_limit", "binary_content")).orderBy("path")
