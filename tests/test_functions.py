import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import paths as P
from tallyloom.functions import text as X
from tallyloom.operators import classify


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("one_"))
    return row.select(expr).first()[0]


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("**", "a/b", True), ("*.go", "a.go", True), ("*.go", "d/a.go", False), ("**/*.go", "d/e/a.go", True), ("**/*.go", "a.go", True), ("d/**", "d", True), ("d/**", "d/x/y", True), ("d/**", "dx", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("{a,b}/*.x", "b/1.x", True), ("[!a]b", "cb", True), ("[!a]b", "ab", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("a.c", "abc", False)],
)
def test_globs(glob, path, fits):
    assert bool(re.search(P.glob_regex(glob).replace(r"\z", r"\Z"), path)) == fits


@pytest.mark.parametrize(("key", "text"), [("a/b", "a/b"), ("A b", "%41%20b"), ("con", "%63on"), ("x/nul.txt", "x/%6Eul.txt"), ("end..", "end%2E%2E"), ("é", "%C3%A9")])
def test_keys_round_trip(key, text):
    assert P.encode_key(key) == text and P.decode_key(text) == key


@pytest.mark.parametrize("text", ["", "%4", "%zz", "%61", "a//b", "../a", "%ff"])
def test_keys_that_are_no_encoding(text):
    assert P.decode_key(text) is None


@pytest.mark.parametrize(("path", "clean"), [("a/b.c", True), ("", False), ("/a", False), ("a//b", False), ("a/../b", False), ("./a", False), ("a/", False), ("..a/b", True)])
def test_clean_paths(spark, path, clean):
    assert one(spark, P.is_clean(F.col("p")), p=path) == clean


@pytest.mark.parametrize(
    ("path", "data", "role"),
    [
        ("src/gen/x.go", "", "generated_code"), ("a.go", "// Code generated by x. DO NOT EDIT.", "generated_code"), ("go.sum", "", "lock_file"), ("x/testdata/a.json", "", "fixture"), ("app.min.js", "", "fixture"), ("pkg/a_test.go", "", "test"), ("test_a.py", "", "test"), ("ui/a.spec.ts", "", "test"),
        ("api/v.proto", "", "contract"), ("openapi.yaml", "", "contract"), ("db/migrations/1.txt", "", "database"), ("requirements-dev.txt", "", "dependency_manifest"), ("Dockerfile", "", "runtime_configuration"), (".github/workflows/x.md", "", "runtime_configuration"), ("lib/run", "", "production_source"),
        ("run", "#!/usr/bin/env python\nx", "production_source"), ("run", "#!/usr/bin/awk\npython", "unknown_source"), ("README.md", "", "prose"), ("data.bin", "", "unknown_source"), ("setup.cfg", "", "dependency_manifest"), (".eslintrc", "", "runtime_configuration"),
    ],
)
def test_roles(spark, path, data, role):
    assert one(spark, classify.role_expression(F.col("p"), F.col("d")), p=path, d=data) == role


def test_a_generated_header_counts_within_4096_bytes(spark):
    mark = "@generated"
    assert one(spark, classify.generated_header(F.col("d")), d="é" * 2043 + mark)
    assert not one(spark, classify.generated_header(F.col("d")), d="é" * 2048 + mark)


@pytest.mark.parametrize(("path", "secret"), [(".env", True), ("a/.ENV.local", True), ("k/id_rsa", True), ("x.pfx", True), ("my-service-account-1.json", True), ("service-account.txt", False), ("env", False)])
def test_secret_names(spark, path, secret):
    assert one(spark, classify.secret_path(F.col("p")), p=path) == secret


def test_scan_first_rule_decides(spark):
    rows = [(".env", "160000", "x", 1), ("docs/generated/a.go", "100644", "x", 1), ("m", "160000", "x", 1), ("n", "100666", "x", 1), ("skip.py", "100644", "x", 1), ("big.py", "100644", "x" * 20, 20), ("bin.py", "100644", "a\0b", 3), ("a.py", "100644", "x", 1), ("s.py", "100644", "AKIA" + "A" * 16, 20 - 19)]
    df = spark.createDataFrame(rows, "path string, mode string, data string, size long")
    got = {r["path"]: r for r in classify.scan(df, classify.SourcePolicy(exclude=("skip.*",), max_bytes=10)).collect()}
    assert {p: r["reason"] for p, r in got.items()} == {".env": "secret_filename", "docs/generated/a.go": "tool_owned_output", "m": "git_submodule", "n": "unsupported_git_mode", "skip.py": "source_exclude_pattern", "big.py": "file_size_limit", "bin.py": "binary_content", "a.py": "production_source", "s.py": "production_source"}
    assert [p for p, r in got.items() if r["included"]] == ["a.py", "s.py"] and got["s.py"]["secret"] and got["skip.py"]["size"] == 0
    with pytest.raises(Exception, match="secret value in s.py"):
        classify.scan(df, classify.SourcePolicy(), strict=True).collect()


@pytest.mark.parametrize(
    ("text", "why"),
    [("plain text", None), ("a\x07b", "a control character"), ("a​b", "a formatting character"), ("─", "box-drawing characters"), ("mailto:x", "a URI scheme"), ("[a](b)", "a Markdown link"), ("<i>x", "HTML"), ("```", "a code fence"), ("a ==> b", "an ASCII diagram"), ("in /tmp/x", "a machine path"), ("x\n # h", "a heading"), ("x\n1. y", "a list"), ("graph TD", "diagram syntax"), ("x\n- y\n# z", "a list")],
)
def test_prose(spark, text, why):
    assert one(spark, X.prose_problem(F.col("t")), t=text) == why


def test_text_functions(spark):
    assert one(spark, X.code_span(F.col("t")), t="a``b") == "``` a``b ```"
    assert one(spark, X.code_span(F.col("t")), t="a\x07b") == "`a\\u{7}b`"
    assert one(spark, X.percent_path(F.col("t")), t="a b/c*&d;é~") == "a%20b/c%2A&d%3B%C3%A9~"
    assert one(spark, X.escape_diagram(F.col("t")), t='#;"<>') == "#35;#59;#quot;#lt;#gt;"
    assert one(spark, X.tidy(F.col("t")), t="a\n\n\n\nb\n\n") == "a\n\nb\n"
    assert one(spark, X.fallback_title(F.col("t")), t="x/---") == "Component"
    assert one(spark, X.framed_hash(F.col("a"), F.col("b")), a="ab", b="c") != one(spark, X.framed_hash(F.col("a"), F.col("b")), a="a", b="bc")
