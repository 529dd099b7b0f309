"""Working trees of real checkouts against what git says of them."""

import hashlib
import os
import shutil
import struct
import subprocess

import pytest

from sieveworks.operators.correlate import merge_snapshots
from sieveworks.plans.ruleset import parse
from sieveworks.plans.scan import scan
from sieveworks.sources.gittree import Objects, git_folder, head_commit, index_entries, read_index, tree_files, working_tree

needs_git = pytest.mark.skipif(not shutil.which("git"), reason="no git")


def git(root, *args, check=True):
    env = os.environ | {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@example.org", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@example.org", "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(root), *args], capture_output=True, check=check, env=env).stdout.decode()


def write(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def by_git(root):
    """{(path, status)} of `git status`."""
    out, fields = set(), git(root, "status", "--porcelain", "-z", "--untracked-files=all", "--no-renames").split("\0")
    for x in filter(None, fields):
        code, path = x[:2], x[3:]
        if code == "??":
            out.add((path, "untracked"))
        elif "U" in code or code in ("AA", "DD"):
            out.add((path, "changed"))
        else:
            out |= {(path, "staged")} if code[0] not in " D" else set()
            out |= {(path, "changed")} if code[1] not in " D" else set()
    return out


@pytest.fixture
def checkout(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    git(root, "init", "-q")
    big = "".join(f"line {i} of a long file\n" for i in range(4000))
    write(root, {".gitignore": "*.log\nout/\n", "a.txt": "one\n", "d/b.txt": "two\n", "d/e/c.txt": "three\n", "big.txt": big, "run.sh": "#!/bin/sh\n", "gone.txt": "x\n", "é.txt": "ü\n"})
    git(root, "add", "."), git(root, "commit", "-qm", "first")
    write(root, {"big.txt": big.replace("line 7 ", "line seven "), "more.txt": "m\n"})
    git(root, "add", "."), git(root, "commit", "-qm", "second")
    # Staged, changed, both, new, deleted, ignored, of another mode, only meant to be added.
    write(root, {"a.txt": "one, staged\n", "d/b.txt": "two, changed\n", "big.txt": big + "staged\n", "new.txt": "new\n", "wish.txt": "w\n", "x.log": "no", "out/y.txt": "no", "d/e/new.txt": "untracked\n", "d/force.log": "f\n"})
    git(root, "add", "a.txt", "big.txt", "new.txt"), git(root, "add", "-f", "d/force.log"), git(root, "add", "-N", "wish.txt")
    write(root, {"big.txt": big + "staged, then changed\n"})
    os.chmod(root / "run.sh", 0o755)
    os.remove(root / "gone.txt")
    return root


def found(spark, root):
    return {(r.path, r.status): r for r in working_tree(spark, str(root)).collect()}


@needs_git
@pytest.mark.parametrize("version", [2, 3, 4])
def test_status_of_a_checkout(spark, checkout, version):
    git(checkout, "update-index", "--index-version", str(version))
    got = found(spark, checkout)
    assert set(got) == by_git(checkout)
    assert got["big.txt", "staged"].text.endswith("\nstaged\n") and got["big.txt", "changed"].text.endswith("then changed\n")
    assert got["d/e/new.txt", "untracked"].provenance_type == "git-untracked" and got["a.txt", "staged"].provenance_type == "git-index"
    assert got["a.txt", "staged"].oid == git(checkout, "rev-parse", ":a.txt").strip()


@needs_git
def test_packed_objects_links_and_linked_work_trees(spark, checkout, tmp_path):
    os.symlink("a.txt", checkout / "link")
    git(checkout, "add", "link"), git(checkout, "gc", "-q", "--aggressive")
    os.remove(checkout / "link")
    os.symlink("d/b.txt", checkout / "link")
    got = found(spark, checkout)
    assert set(got) == by_git(checkout) and got["link", "staged"].text == "a.txt" and got["link", "changed"].text == "d/b.txt"
    folder = git_folder(str(checkout))
    objects = Objects(folder)
    for line in git(checkout, "rev-list", "--objects", "--all").splitlines():
        oid = line.split()[0]
        kind, body = objects.get(oid)
        assert hashlib.sha1(f"{kind} {len(body)}\0".encode() + body).hexdigest() == oid
    tree = {(p, o) for p, _, o in tree_files(objects, head_commit(folder))}
    assert tree == {(x.split("\t")[1], x.split()[2]) for x in git(checkout, "-c", "core.quotePath=false", "ls-tree", "-r", "HEAD").splitlines()}
    with pytest.raises(KeyError):
        objects.get("0" * 40)
    git(checkout, "worktree", "add", "-q", str(tmp_path / "linked"), "HEAD~1")
    write(tmp_path / "linked", {"a.txt": "changed here\n"})
    assert set(found(spark, tmp_path / "linked")) == {("a.txt", "changed")}


@needs_git
def test_conflicts_and_first_commits(spark, checkout):
    git(checkout, "reset", "-q", "--hard"), git(checkout, "checkout", "-qb", "other"), write(checkout, {"a.txt": "other\n"}), git(checkout, "commit", "-qam", "o")
    git(checkout, "checkout", "-q", "-"), write(checkout, {"a.txt": "mine\n"}), git(checkout, "commit", "-qam", "m"), git(checkout, "merge", "-q", "other", check=False)
    assert set(found(spark, checkout)) == by_git(checkout) and ("a.txt", "changed") in by_git(checkout)
    fresh = checkout.parent / "fresh"
    fresh.mkdir()
    git(fresh, "init", "-q"), write(fresh, {"x": "1", "y": "2"})
    assert set(found(spark, fresh)) == {("x", "untracked"), ("y", "untracked")}
    git(fresh, "add", "x")
    assert set(found(spark, fresh)) == {("x", "staged"), ("y", "untracked")}


@needs_git
def test_both_sides_of_a_finding_go_together(spark, checkout):
    write(checkout, {"s.txt": "tok-abc\n"})
    git(checkout, "add", "s.txt"), write(checkout, {"s.txt": "tok-abc\ntok-def\n", "u.txt": "tok-ghi"})
    rules = parse("[[rules]]\nid = 't'\nregex = 'tok-\\w+'\nkeywords = ['tok-']")
    content = working_tree(spark, str(checkout))
    rows = scan(content.withColumnRenamed("status", "message"), rules).selectExpr("fingerprint", "provenance_type", "secret", "start_line as position")
    got = {(r.secret, r.provenance_type) for r in merge_snapshots(rows).collect()}
    assert got == {("tok-abc", "git-index+worktree"), ("tok-def", "git-worktree"), ("tok-ghi", "git-untracked")}


def entry(path, version=2, flags=0, extended=None):
    body = struct.pack(">10I", 0, 0, 0, 0, 0, 0, 0o100644, 0, 0, 5) + bytes(range(20)) + struct.pack(">H", flags | (0x4000 if extended is not None else 0) | len(path))
    body += struct.pack(">H", extended) if extended is not None else b""
    return body + path + b"\0" * (8 - (len(body) + len(path)) % 8)


def index(version, *entries):
    data = b"DIRC" + struct.pack(">II", version, len(entries)) + b"".join(entries)
    return data + hashlib.sha1(data).digest()


def test_entries_by_value():
    data = index(3, entry(b"a"), entry(b"b/longer/path.txt", flags=0x2000), entry(b"c", extended=0x4000), entry(b"d", extended=0x2000))
    oid = bytes(range(20)).hex()
    assert list(index_entries(data)) == [("a", 0o100644, oid, 5, 0, False, False), ("b/longer/path.txt", 0o100644, oid, 5, 2, False, False), ("c", 0o100644, oid, 5, 0, True, False), ("d", 0o100644, oid, 5, 0, False, True)]
    for bad in (b"", b"DIRC", data[:-1], data.replace(b"longer", b"longes"), b"XIRC" + data[4:], index(5), index(2, entry(b"a", extended=0))):
        with pytest.raises(ValueError):
            list(index_entries(bad))


def test_no_checkout(spark, tmp_path):
    with pytest.raises(ValueError):
        read_index(spark, str(tmp_path))
