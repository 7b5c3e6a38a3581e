"""Repository objects against what the version control program says of a fixture that it made; without it, skipped."""

import hashlib
import os
import random
import shutil
import subprocess
import zlib

import pytest

from tallyloom.sources import objects, records
from tallyloom.sources.objects import Repository

pytestmark = pytest.mark.skipif(not shutil.which("git"), reason="the fixture needs git")
STATE = '{"version":1,"files":[],"components":[],"generated":{},"config_hash":"x"}'


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    env = os.environ | {k: v for who in ("AUTHOR", "COMMITTER") for k, v in {f"GIT_{who}_NAME": "n", f"GIT_{who}_EMAIL": "e", f"GIT_{who}_DATE": "2024-01-01T00:00:00Z"}.items()} | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null", "HOME": str(at)}

    def git(*args):
        return subprocess.run(["git", *args], cwd=at, env=env, check=True, capture_output=True, timeout=60).stdout

    git("init", "-q")
    rng, commits = random.Random(3), []
    lines = [f"line {i} {rng.random()}" for i in range(400)]
    for n in range(4):
        for i in range(6):
            path = at / f"services/s{i % 2}/deep/er/file{i}.txt"
            path.parent.mkdir(parents=True, exist_ok=True)
            lines[rng.randrange(400)] = f"changed {n} {i}"
            path.write_text("\n".join(lines[: 300 + i * 10]))
        (at / "README.md").write_text(f"é {n}\n")
        (at / "big.bin").write_bytes(bytes(rng.randrange(256) for _ in range(30_000)))
        (at / ".state").mkdir(exist_ok=True)
        (at / ".state/state.json").write_text(STATE)
        if n == 1:
            os.symlink("../outside", at / "link")
            (at / "run.sh").write_text("#!/bin/sh\n")
            (at / "run.sh").chmod(0o755)
        git("add", "-A")
        git("commit", "-q", "-m", f"c{n}")
        if n == 2:
            git("repack", "-adfq", "--depth=50")  # one pack with chains; what follows stays loose
        commits.append(git("rev-parse", "HEAD").decode().strip())
    return at, git, commits


def test_objects_and_contents(spark, repo):
    at, git, _ = repo
    repository = Repository(spark, str(at / ".git"))
    want = {x.split()[0]: (x.split()[1], int(x.split()[2])) for x in git("cat-file", "--batch-all-objects", "--batch-check").decode().splitlines()}
    got = repository.objects().collect()
    assert {r["oid"]: (r["kind"], r["size"]) for r in got} == want and len(got) == len(want)
    assert max(len(r["chain"]) for r in got if r["chain"]) > 3 and any(r["pack"] is None for r in got)
    for r in repository.contents(repository.objects()).collect():
        assert hashlib.sha1(f"{r['kind']} {r['size']}\0".encode() + r["data"]).hexdigest() == r["oid"]


def test_trees(spark, repo):
    at, git, commits = repo
    repository = Repository(spark, str(at / ".git"))
    for commit in (commits[0], commits[3]):
        raw = spark.createDataFrame([(git("ls-tree", "-r", "-l", "-z", "--full-tree", commit).decode(),)], "raw string")
        want = sorted((r["path"], r["mode"], r["object_id"], r["size"]) for r in records.tree_records(raw).collect())
        assert sorted(tuple(r) for r in repository.tree(commit).collect()) == want
    some = sorted(r["path"] for r in repository.tree(commits[1], "services/s1/deep").collect())
    assert some == [f"services/s1/deep/er/file{i}.txt" for i in (1, 3, 5)]
    assert [r["path"] for r in repository.tree(commits[1], "README.md").collect()] == ["README.md"]
    modes = {r["path"]: r["mode"] for r in repository.tree(commits[1]).collect()}
    assert modes["link"] == "120000" and modes["run.sh"] == "100755"


def test_revisions_blobs_and_state(spark, repo, tmp_path):
    at, git, commits = repo
    repository = Repository(spark, str(at / ".git"))
    tree = git("rev-parse", f"{commits[0]}^{{tree}}").decode().strip()
    assert repository.exists(commits[0]) and not repository.exists("0" * 40) and not repository.exists(tree)
    with pytest.raises(LookupError):
        repository.tree("0" * 40)
    for bad in ("HEAD", "--all", "A" * 40):
        with pytest.raises(ValueError):
            repository.exists(bad)
    listed = {r["path"]: r for r in repository.tree(commits[3]).collect()}
    found = {r["oid"]: r for r in repository.blobs(repository.tree(commits[3]), 10_000).collect()}
    big, small = found[listed["big.bin"]["oid"]], found[listed["README.md"]["oid"]]
    assert (big["truncated"], big["data"], big["size"]) == (True, None, 30_000) and small["data"].decode() == "é 3\n"
    assert repository.file(commits[3], "link", 100) == (10, False, b"../outside")
    assert repository.file(commits[3], "none", 100) is None and repository.file(commits[0], "big.bin", 1)[1]
    assert records.load_tree_state(repository, commits[3], ".state/state.json")[0] == "valid"
    assert records.load_tree_state(repository, commits[3], "README.md")[0] == "invalid" and records.load_tree_state(repository, commits[3], "gone.json")[0] == "missing"


def test_broken_objects(spark, tmp_path):
    oid = "ab" + "0" * 38
    (tmp_path / "objects/ab").mkdir(parents=True)
    (tmp_path / f"objects/ab/{oid[2:]}").write_bytes(zlib.compress(b"blob 9\0short"))
    repository = Repository(spark, str(tmp_path))
    assert [tuple(r)[:3] for r in repository.objects().collect()] == [(oid, "blob", 9)]
    with pytest.raises(Exception, match="another size"):
        repository.contents(repository.objects()).collect()
    empty = Repository(spark, str(tmp_path / "nothing"))
    assert empty.objects().collect() == [] and not empty.exists("0" * 40)


def test_deltas():
    base = b"0123456789" * 20
    delta = bytes([200, 1, 13]) + bytes([0b10010001, 5, 10]) + bytes([3]) + b"new"
    assert objects.apply_delta(base, delta) == base[5:15] + b"new"
    with pytest.raises(ValueError):
        objects.apply_delta(b"x", delta)


def test_worktree_does_not_follow_links(spark, tmp_path):
    (tmp_path / "tree/sub").mkdir(parents=True)
    (tmp_path / "secret.txt").write_text("outside")
    (tmp_path / "tree/a.txt").write_text("inside")
    (tmp_path / "tree/sub/big.txt").write_text("x" * 100)
    os.symlink("../secret.txt", tmp_path / "tree/link")
    os.symlink("../..", tmp_path / "tree/sub/up")
    paths = spark.createDataFrame([(p,) for p in ("a.txt", "sub/big.txt", "link", "sub/up", "sub/up/secret.txt", "none", "../secret.txt", "sub")], "path string")
    got = {r["path"]: r for r in records.worktree_files(paths, str(tmp_path / "tree"), 50).collect()}
    assert bytes(got["a.txt"]["data"]) == b"inside" and (got["sub/big.txt"]["truncated"], got["sub/big.txt"]["data"], got["sub/big.txt"]["size"]) == (True, None, 100)
    assert bytes(got["link"]["data"]) == b"../secret.txt" and got["link"]["problem"] is None and bytes(got["sub/up"]["data"]) == b"../.."
    assert {p: got[p]["problem"] for p in got if got[p]["problem"]} == {"sub/up/secret.txt": "link_in_path", "none": "missing", "../secret.txt": "unclean_path", "sub": "not_a_file"}
