"""Ignore files of a tree, found in the listing and applied as a join on folders.

A line of an ignore file holds for what is below its folder. Folders are decided before what is in them:
nothing under an ignored folder comes back. Of all lines that match a folder or file the one counts whose file is
the most specific kind, stands deepest, and within it comes last.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of ignore files; later ones outweigh earlier ones, wherever they stand.
IGNORE_FILES = (".gitignore", ".ignore", ".sieveignore")
# POSIX classes in brackets.
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
}
RULES = "array<struct<rx:string,back:boolean,folders:boolean>>"


def _literal(c: str) -> str:
    return c if c.isalnum() or c in "_/ " or ord(c) > 127 else f"\\{c}"


def _bracket(text: str, i: int) -> tuple[str, int] | None:
    """A bracket expression that begins at i, as a class, and where it ends; None if it is not closed."""
    j, out = i + 1, ""
    negated = text[j : j + 1] in ("!", "^")
    j += negated
    first = True
    while j < len(text) and (text[j] != "]" or first):
        first = False
        if m := re.compile(r"\[:(\w+):\]").match(text, j):
            if m[1] not in _POSIX:
                return None
            out, j = out + _POSIX[m[1]], m.end()
            continue
        j += text[j] == "\\" and j + 1 < len(text)
        low = text[j]
        if text[j + 1 : j + 2] == "-" and text[j + 2 : j + 3] not in ("", "]"):
            j += 2 + (text[j + 2] == "\\" and j + 3 < len(text))
            # Of a range that runs backwards only the beginning matches.
            out += f"{_literal(low)}-{_literal(text[j])}" if low <= text[j] else _literal(low)
        else:
            out += _literal(low)
        j += 1
    if j >= len(text):
        return None
    body = f"[^/{out}]" if negated else f"[{out}&&[^/]]" if out else "(?!)"
    return body, j + 1


def ignore_rule(line: str) -> tuple[str, bool, bool] | None:
    """A line as (regular expression over paths below its folder, whether it brings back, whether only folders
    match); None for blank lines and comments, and for patterns that match nothing."""
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text[0] == "#":
        return None
    back = text[0] == "!"
    text = text[back:]
    folders = text.endswith("/")
    text = text[:-1] if folders else text
    anchored = "/" in text
    text = text.removeprefix("/")
    if not text:
        return None
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**", i) and (not i or text[i - 1] == "/") and text[i + 2 : i + 3] in ("", "/"):
            # Whole parts of a path: any number of folders, or all that is in one.
            out, i = (out + "(?:.*/)?", i + 3) if text[i + 2 : i + 3] else (out + ".+", i + 2)
        elif c == "*":
            out += "[^/]*+" if i + 1 == len(text) else "[^/]*"
            i += 1
            while text[i : i + 1] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            if (found := _bracket(text, i)) is None:
                return None
            out, i = out + found[0], found[1]
        elif c == "\\":
            if i + 1 == len(text):
                return None
            out, i = out + _literal(text[i + 1]), i + 2
        else:
            out, i = out + _literal(c), i + 1
    return f"(?s)^{out}\\z", back, folders


def _parsed(names: tuple[str, ...]):
    kinds = pa.list_(pa.struct([("rx", pa.string()), ("back", pa.bool_()), ("folders", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folders, ranks, rules = [], [], []
            for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                folder, _, name = path.rpartition("/")
                lines = (text.as_py() or "").removeprefix("﻿").split("\n")
                folders.append(folder)
                ranks.append(names.index(name))
                rules.append([{"rx": r[0], "back": r[1], "folders": r[2]} for r in map(ignore_rule, lines) if r])
            yield pa.RecordBatch.from_arrays([pa.array(folders, pa.string()), pa.array(ranks, pa.int32()), pa.array(rules, kinds)], names=["folder", "kind", "rules"])

    return run


def _above(path: str, whole: bool) -> Column:
    """The folders of a path from the top down, without the root; with `whole`, the path itself, too."""
    parts = F.split(path, "/", -1)
    count = F.size(parts) - (0 if whole else 1)
    return F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.when(i <= count, F.array_join(F.slice(parts, F.lit(1), i), "/")))


def ignored(paths: DataFrame, ignore_files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """The distinct folders and files (target, is_folder) of paths(path) that a line of
    ignore_files(path, text) ignores by itself; what is below them is ignored with them. Folders are
    decided once, however many files they hold."""
    rules = ignore_files.select("path", F.col("text").cast("string")).mapInArrow(_parsed(names), f"folder string, kind int, rules {RULES}").where(F.size("rules") > 0)
    folders = paths.select(F.explode(_above("path", False)).alias("target")).where("target is not null").distinct().withColumn("is_folder", F.lit(True))
    targets = folders.unionByName(paths.select(F.col("path").alias("target")).distinct().withColumn("is_folder", F.lit(False)))
    above = F.concat(F.array(F.lit("")), F.array_compact(_above("target", False)))
    met = targets.select("target", "is_folder", F.explode(above).alias("folder")).join(rules, "folder")
    below = F.substring("target", F.when(F.col("folder") == "", 1).otherwise(F.char_length("folder") + 2), F.char_length("target"))
    met = met.withColumn("_below", below)
    # The last line that matches: 1 ignores, 0 brings back.
    says = F.aggregate("rules", F.lit(None).cast("int"), lambda at, r: F.when((F.col("is_folder") | ~r["folders"]) & F.regexp_like(F.col("_below"), r["rx"]), F.when(r["back"], 0).otherwise(1)).otherwise(at))
    said = met.select("target", "is_folder", "kind", F.char_length("folder").alias("depth"), says.alias("says")).where("says is not null")
    return said.groupBy("target", "is_folder").agg(F.max_by("says", F.struct("kind", "depth")).alias("says")).where("says = 1").select("target", "is_folder")


def drop_ignored_paths(files: DataFrame, ignore_files: DataFrame, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """files(path, ...) without those that the ignore files leave out: by a line that matches the file, or any
    folder above it. Paths are relative to the root of the tree, with forward slashes; rows without a path
    stay."""
    out = ignored(files.select("path").where("path is not null"), ignore_files, names)
    reached = files.select("path").distinct().select("path", F.explode(F.array_compact(_above("path", True))).alias("target"))
    # A folder's decision is for what is below it, a file's for itself.
    reached = reached.withColumn("is_folder", F.col("target") != F.col("path"))
    gone = reached.join(out, ["target", "is_folder"], "left_semi").select("path").distinct()
    return files.join(gone, "path", "left_anti").select(*files.columns)
