"""Transactions on a folder of files: cut off at every step, recovered, refused, repeated."""

import pathlib
import uuid

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import recovery
from tallyloom.sources import journal
from tallyloom.sources.journal import HOME, FileTree, RecoveryConflictError, content_id
from tallyloom.sources.sinks import PreconditionError

FILES = "path string, content string"
OLD = {"a.md": "a", "sub/b.md": "b", "sub/deep/c.md": "c", "keep.md": "k"}
NEW = {"a.md": "a2", "sub/b.md": "b", "fresh/d.md": "d"}


class Crash(BaseException):
    pass


@pytest.fixture
def tree(spark, tmp_path):
    for path, text in OLD.items():
        at = tmp_path / "live" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return FileTree(spark, str(tmp_path / "live"))


def found(tree):
    at = pathlib.Path(tree.root)
    return {str(p.relative_to(at)): p.read_text() for p in at.rglob("*") if p.is_file() and HOME not in p.parts and not p.name.endswith(".crc")}


def frame(spark, files):
    return spark.createDataFrame(list(files.items()), FILES)


def gone(spark):
    return spark.createDataFrame([("sub/deep/c.md",)], "path string")


WANTED = {"a.md": "a2", "sub/b.md": "b", "fresh/d.md": "d", "keep.md": "k"}


def test_install(spark, tree):
    tree.install(frame(spark, NEW), gone(spark))
    assert found(tree) == WANTED and not (pathlib.Path(tree.root) / "sub/deep").exists() and tree.state() is None and tree.recover() is None
    assert {r["path"]: r["content"] for r in tree.read().collect()} == WANTED


@pytest.mark.parametrize("state", recovery.STATES)
def test_cut_off_at_each_step(spark, tree, state):
    def crash(at):
        if at == state:
            raise Crash

    with pytest.raises(Crash):
        tree.install(frame(spark, NEW), gone(spark), on_state=crash)
    assert tree.state() == state
    with pytest.raises(RuntimeError, match="recover it first"):
        tree.install(frame(spark, NEW))
    # all is moved before "moving" is told, so there recovery finds it whole and goes on
    forward = state in ("moving", "committed")
    assert tree.recover() == ("forward" if forward else "back")
    assert found(tree) == (WANTED if forward else OLD) and tree.recover() is None


def half_moved(spark, tree):
    """A crash between the first and the last file."""

    def crash(at):
        if at == "verified":
            raise Crash

    with pytest.raises(Crash):
        tree.install(frame(spark, NEW), gone(spark), on_state=crash)
    tree._mark("moving")
    root = pathlib.Path(tree.root)
    (root / "a.md").write_text("a2")
    (root / "fresh").mkdir()
    (root / "fresh/d.md").write_text("d")
    return root


def test_cut_off_between_files(spark, tree):
    half_moved(spark, tree)
    assert tree.recover() == "back" and found(tree) == OLD


def test_recovery_that_is_cut_off_can_be_repeated(spark, tree):
    root = half_moved(spark, tree)
    (root / "a.md").write_text("a")  # undone already
    assert tree.recover() == "back" and found(tree) == OLD


def test_conflict_leaves_everything(spark, tree):
    root = half_moved(spark, tree)
    (root / "sub/b.md").write_text("somebody else's")
    (root / "sub/deep/c.md").unlink()
    before = found(tree)
    with pytest.raises(RecoveryConflictError) as e:
        tree.recover()
    assert e.value.conflicts == [("sub/b.md", "foreign_content")] and found(tree) == before and tree.state() == "moving"
    (root / "sub/b.md").write_text("b")  # a person decides; now all is as the transaction wants it
    assert tree.recover() == "forward" and found(tree) == WANTED


def test_preconditions(spark, tree):
    hashes = lambda files: spark.createDataFrame([(p, None if t is None else content_id(t.encode())) for p, t in files.items()], "path string, hash string")
    for expected in ({"a.md": "other", "sub/b.md": "b", "sub/deep/c.md": "c"}, {"sub/b.md": "b", "sub/deep/c.md": "c"}, OLD | {"fresh/d.md": "x"}, OLD | {"keep.md": "other"}):
        with pytest.raises(PreconditionError):
            tree.install(frame(spark, NEW), gone(spark), hashes(expected))
        assert found(tree) == OLD and tree.state() is None
    (pathlib.Path(tree.root) / "fresh/d.md").mkdir(parents=True)
    with pytest.raises(PreconditionError):  # a folder where a file shall be
        tree.install(frame(spark, NEW), gone(spark), hashes(OLD))
    for bad in ("../out.md", "/abs.md"):
        with pytest.raises(ValueError, match="unclean_path"):
            tree.install(frame(spark, {bad: "x"}), expected=hashes(OLD))
    with pytest.raises(ValueError, match="unexpected_delete"):
        tree.install(frame(spark, {"n.md": "x"}), spark.createDataFrame([("nothing.md",)], "path string"), hashes({}))
    assert found(tree) == OLD and tree.recover() is None


def test_changed_while_moving(spark, tree):
    def meddle(at):
        if at == "verified":
            (pathlib.Path(tree.root) / "a.md").write_text("meddled")

    with pytest.raises(RecoveryConflictError):
        tree.install(frame(spark, NEW), gone(spark), on_state=meddle)
    assert found(tree)["a.md"] == "meddled" and tree.state() == "moving"


def test_batches_count_once(spark, tree):
    assert tree.last_batch("s") == -1
    assert tree.commit(frame(spark, {"a.md": "1"}), batch=("s", 0)) and not tree.commit(frame(spark, {"a.md": "2"}), batch=("s", 0))
    assert {r["path"]: r["content"] for r in tree.read().collect()} == {"a.md": "1"} and tree.last_batch("s") == 0
    assert tree.commit(frame(spark, {"b.md": "3"}), batch=("s", 4)) and tree.last_batch("s") == 4 and tree.last_batch("t") == -1
    assert tree.commit(frame(spark, {"b.md": "3", "c.md": "4"})) and tree.last_batch("s") == 4
    assert {r["path"]: r["content"] for r in tree.read().collect()} == {"b.md": "3", "c.md": "4"}


def test_odd_journals(spark):
    h = "sha256:" + "a" * 64
    rows = [(1, "d/x", "write", None, h), (1, "d/x", "delete", h, None), (1, "e/y", "write", h, h), (1, ".state", "write", None, h), (1, "d/../z", "write", None, h), (1, "d/w", "write", None, "?"), (1, "d/v", "move", h, None), (1, "d/u", "delete", None, None), (1, None, "write", None, h)]
    journal = spark.createDataFrame(rows, "tx int, path string, kind string, old_hash string, new_hash string")
    got = sorted(((r["path"], r["code"]) for r in recovery.journal_issues(journal, "d", ".state").collect()), key=repr)
    assert got == sorted([("d/x", "duplicate_path"), ("e/y", "foreign_path"), ("d/../z", "unclean_path"), ("d/w", "bad_hash"), ("d/v", "unknown_kind"), ("d/u", "unexpected_delete"), (None, "unclean_path"), (None, "foreign_path")], key=repr)
    none = spark.createDataFrame([], "tx int, path string, hash string")
    assert recovery.outcomes(recovery.verdicts(journal.limit(0), none, none), spark.createDataFrame([(9, "staged")], "tx int, state string")).collect()[0][:] == (9, "back", 0)


def test_verdicts(spark):
    old, new, other = (content_id(x) for x in (b"o", b"n", b"x"))
    cases = {  # kind, old, live, backup: state, conflict
        ("write", old, old, None): ("original", None), ("write", old, old, old): ("original", None), ("write", old, new, old): ("installed", None), ("write", old, new, None): ("installed", "no_backup"),
        ("write", old, None, old): ("absent", None), ("write", old, None, None): ("absent", "lost_original"), ("write", old, other, old): ("foreign", "foreign_content"), ("write", old, old, other): ("original", "changed_backup"),
        ("write", None, None, None): ("absent", None), ("write", None, new, None): ("installed", None), ("write", None, other, None): ("foreign", "foreign_content"), ("write", None, None, old): ("absent", "unplanned_backup"),
        ("delete", old, old, old): ("original", None), ("delete", old, None, old): ("installed", None), ("delete", old, None, None): ("installed", "lost_original"), ("delete", old, other, old): ("foreign", "foreign_content"), ("delete", None, None, None): ("installed", "unexpected_delete"),
        (None, None, None, old): ("foreign", "unplanned_backup"),
    }
    table = lambda i: spark.createDataFrame([(n, "p", k[i]) for n, k in enumerate(cases) if k[i]], "tx int, path string, hash string")
    journal = spark.createDataFrame([(n, "p", k[0], k[1], new if k[0] == "write" else None) for n, k in enumerate(cases) if k[0]], "tx int, path string, kind string, old_hash string, new_hash string")
    judged = recovery.verdicts(journal, table(2), table(3))
    assert {r["tx"]: (r["state"], r["conflict"]) for r in judged.collect()} == dict(enumerate(cases.values()))
    decided = recovery.outcomes(judged, spark.createDataFrame([(n, "moving") for n in range(len(cases))], "tx int, state string"))
    want = {n: "forward" if v[0] == "installed" else "conflict" if v[1] else "back" for n, v in enumerate(cases.values())}
    assert {r["tx"]: r["outcome"] for r in decided.collect()} == want
    acts = {r["tx"]: r["action"] for r in recovery.repairs(judged, decided).where(F.col("action") != "keep").collect()}
    assert acts == {4: "restore"}


def test_a_folder_is_listed_once_however_many_files_go(spark, tmp_path, monkeypatch):
    """A folder that loses many files is looked at once, not once for each of them, and goes when all have gone."""
    lists = tmp_path / "lists"
    lists.mkdir()

    def spied(root, real=journal._open, at=str(lists)):
        fs, base = real(root)

        class Spy:
            def __getattr__(self, name):
                return getattr(fs, name)

            def get_file_info(self, what):
                if hasattr(what, "base_dir"):
                    open(f"{at}/{uuid.uuid4().hex}", "w").write(what.base_dir)
                return fs.get_file_info(what)

        return Spy(), base

    tree = FileTree(spark, str(tmp_path / "live"))
    files = {f"some/{i}.md": "x" for i in range(200)} | {f"all/deep/{i}.md": "x" for i in range(50)}
    tree.install(frame(spark, files))
    monkeypatch.setattr(journal, "_open", spied)
    go = [p for p in files if p != "some/7.md"]
    tree.install(frame(spark, {"other.md": "y"}), spark.createDataFrame([(p,) for p in go], "path string"))
    assert found(tree) == {"some/7.md": "x", "other.md": "y"} and not (tmp_path / "live/all").exists()
    assert sorted(p.read_text().rsplit("live/", 1)[1] for p in lists.iterdir()) == ["all", "all/deep", "some"]
