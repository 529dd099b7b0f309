"""Ignore files found in a tree, against what git says."""

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from sieveworks.sources.content import file_content, followed, links
from sieveworks.sources.ignores import drop_ignored_paths, ignore_rule

FILES = {
    ".gitignore": "# top\n*.log\n!keep.log\n/build/\nlogs/\n**/cache\ndoc/*.txt\ndoc/**/*.pdf\n a\\ b \n\\#odd\n\\!bang\n*.[oa]\n[!a-c]x\nfoo/**\n!foo/keep\nend\\ \ntmp*\n!tmpkeep/\n[[:digit:]]z\nq?t\n[z-a]\nun[closed\n",
    "src/.gitignore": "!*.log\n/gen\nbuild\n*\n!*/\n!*.py\n!.gitignore\n",
    "src/deep/.gitignore": "secret.py\n!*.o\n!important.txt\r\n",
    "logs/.gitignore": "!a.txt\n",
    "empty/.gitignore": "\n\n# none\n   \n",
}
PATHS = [
    "a.log", "keep.log", "x/keep.log", "x/y.log", "build/a", "x/build/a", "build", "logs/a.txt", "x/logs/a.txt", "logs", "x/logs", "cache", "x/cache/y", "x/y/cache", "doc/a.txt", "doc/x/a.txt", "doc/a.pdf", "doc/x/y/a.pdf",
    "z/doc/a.txt", " a b", "a b", "#odd", "!bang", "x.o", "x.a", "x.b", "ax", "bx", "dx", "y/dx", "foo/a", "foo/keep", "foo/b/c", "end ", "end", "tmp1", "tmpkeep/a", "tmpkeep", "1z", "az", "qat", "q/t", "src/a.log", "src/gen",
    "src/x/gen", "src/build/a.py", "src/a.py", "src/a.txt", "src/x/a.py", "src/x/a.c", "src/deep/secret.py", "src/deep/ok.py", "src/deep/a.o", "src/deep/important.txt", "src/deep/x/secret.py", "src/.gitignore", "empty/a.log", "empty/b", "un[closed", "é/日.log", "é/日.py",
]
#: What `git check-ignore` names of these, in a work tree where they are files.
IGNORED = {
    " a b", "!bang", "#odd", "1z", "a.log", "build/a", "cache", "doc/a.pdf", "doc/a.txt", "doc/x/y/a.pdf", "dx", "empty/a.log", "end ", "foo/a", "foo/b/c", "logs/a.txt", "qat", "src/a.log", "src/a.txt", "src/deep/secret.py", "src/deep/x/secret.py", "src/gen", "src/x/a.c", "src/x/gen", "tmp1", "x.a", "x.o", "x/cache/y", "x/logs/a.txt", "x/y.log", "x/y/cache", "y/dx", "z/doc/a.txt", "é/日.log",
}


def result(spark, files, paths, partitions=3):
    rules = spark.createDataFrame(list(files.items()), "path string, text string")
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, size int").repartition(partitions)
    return set(paths) - {r.path for r in drop_ignored_paths(rows, rules).collect()}


def asked_of_git(tmp_path, files, paths):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    for p in paths:
        full = tmp_path / p
        try:
            full.parent.mkdir(parents=True, exist_ok=True)
            if not full.exists():
                full.write_text("")
        except (FileExistsError, NotADirectoryError):
            pass
    out = subprocess.run(["git", "-C", str(tmp_path), "-c", "core.quotePath=false", "check-ignore", "-z", "--stdin", "--no-index"], input="\0".join(paths).encode(), capture_output=True, check=False)
    return set(out.stdout.decode().split("\0")) - {""}


#: One path is a file or a folder, not both.
AS_FILES = [p for p in PATHS if not any(q.startswith(p + "/") for q in PATHS)]


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_what_git_ignores_now(spark, tmp_path):
    assert result(spark, FILES, AS_FILES) == asked_of_git(tmp_path, FILES, AS_FILES)


def test_what_git_ignores_by_value(spark):
    assert result(spark, FILES, AS_FILES) == IGNORED


def test_folders_are_decided_before_what_is_in_them(spark):
    files = {".gitignore": "out/\n!out/keep.txt\n", "out/.gitignore": "!*\n", "lib/.gitignore": "*\n!sub/\n!sub/keep.txt\n"}
    paths = ["out/keep.txt", "out/x/y", "lib/a", "lib/sub/keep.txt", "lib/sub/other", "z"]
    assert result(spark, files, paths) == {"out/keep.txt", "out/x/y", "lib/a", "lib/sub/other"}


def test_kinds_outweigh_depth(spark):
    files = {".ignore": "!a.txt\n", "x/.gitignore": "*.txt\n", ".sieveignore": "b.txt\n", "x/.ignore": "!b.txt\n"}
    assert result(spark, files, ["x/a.txt", "x/b.txt", "x/c.txt", "b.txt"]) == {"x/b.txt", "x/c.txt", "b.txt"}


def test_odd_lines_and_rows(spark):
    assert [ignore_rule(x) for x in ("", "# c", "  ", "/", "!", "a\\", "[[:nope:]]", "[ab")] == [None] * 8
    rules = spark.createDataFrame([(".gitignore", None), ("x/.gitignore", "")], "path string, text string")
    rows = spark.createDataFrame([("a", 1), (None, 2), ("a", 1), ("", 3)], "path string, target int").withColumn("folder", F.lit("x"))
    assert drop_ignored_paths(rows, rules).count() == 4
    assert drop_ignored_paths(rows.limit(0), rules).count() == 0 and drop_ignored_paths(rows, rules.limit(0)).columns == rows.columns


def test_many_files_under_few_rules(spark):
    rules = spark.createDataFrame([(".gitignore", "*.log\nnode_modules/\n" + "".join(f"r{i}.txt\n" for i in range(50))), ("d7/.gitignore", "!*.log\n")], "path string, text string")
    paths = spark.range(200_000).select(F.concat(F.lit("d"), F.col("id") % 10, F.when(F.col("id") % 4 == 0, "/node_modules/").otherwise("/src/"), F.col("id"), F.when(F.col("id") % 3 == 0, ".log").otherwise(".py")).alias("path"))
    kept = drop_ignored_paths(paths, rules)
    want = sum(i % 4 != 0 and (i % 3 != 0 or i % 10 == 7) for i in range(200_000))
    assert kept.count() == want


def tree(top, files):
    for name, text in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)


def test_ignore_files_of_a_tree(spark, tmp_path):
    tree(tmp_path, {".gitignore": "*.log\n", "a.log": "1", "a.txt": "2", "d/.gitignore": "!*.log\nb.txt\n", "d/a.log": "3", "d/b.txt": "4", "d/.hidden": "5"})
    got = {r.path: r.text for r in file_content(spark, str(tmp_path), ignored_by=(".gitignore",)).collect()}
    assert set(got) == {".gitignore", "a.txt", "d/.gitignore", "d/a.log", "d/.hidden"} and got["d/a.log"] == "3"


def test_links_are_followed_inside_the_root_once(spark, tmp_path):
    top, outside = tmp_path / "top", tmp_path / "outside"
    tree(top, {"real/a.txt": "a", "real/sub/b.txt": "b", "c.txt": "c"} | {f"many/{i}/x{i}.txt": "x" for i in range(80)})
    tree(outside, {"secret.txt": "s"})
    # A loop to the folder above, one of two links, links to a folder, a file, outside and nothing.
    for name, to in {"real/loop": "..", "one": "two", "two": "one", "z-folder": "real", "b-folder": "real/sub", "file": "c.txt", "file2": "file", "out": str(outside), "out2": "../outside/secret.txt", "none": "nowhere", "many/79/deep": "../../real/sub/b.txt"}.items():
        (top / name).symlink_to(to)
    rows = followed(spark, str(top)).select("path", "symlink_file").collect()
    got = {r.path: r.symlink_file for r in rows}
    assert len(rows) == len(got) == 83
    assert got["real/a.txt"] == "real/loop/real/a.txt" and got["c.txt"] == "file" and got["real/sub/b.txt"] == "b-folder/b.txt" and got["many/3/x3.txt"] == "real/loop/many/3/x3.txt"
    content = file_content(spark, str(top), follow=True, max_bytes=10)
    assert {(r.path, r.text) for r in content.where("path in ('c.txt', 'real/a.txt')").collect()} == {("c.txt", "c"), ("real/a.txt", "a")}
    assert [r.target for r in links(spark, str(top)).where("path = 'file2'").collect()] == ["c.txt"]
