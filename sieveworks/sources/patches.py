"""Git patch text as content: the added lines of each hunk, with their commit."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_COMMIT = re.compile(r"^commit ([0-9a-f]{7,64})")
_PERSON = re.compile(r"^Author:\s*(.*?)\s*<(.*)>\s*$")
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
SCHEMA = "path string, text string, start_line int, commit string, author string, email string, date string, message string"


def unquote(path: str) -> str:
    """A path as Git prints it: quoted ones with octal escapes are decoded, the side's prefix dropped."""
    path = path.rstrip("\t")
    if path.startswith('"') and path.endswith('"'):
        names = {"n": 10, "t": 9, "r": 13, "a": 7, "b": 8, "f": 12, "v": 11, '"': 34, "\\": 92}
        raw = re.sub(rb"\\([0-7]{3}|.)", lambda m: bytes([int(m[1], 8) if len(m[1]) == 3 else names.get(m[1].decode(), m[1][0])]), path[1:-1].encode())
        path = raw.decode("utf-8", "replace")
    return path[2:] if path[:2] in ("a/", "b/") else path


def parse_patch(text: str) -> Iterator[dict]:
    """A row for each run of added lines, and one with an empty path for a commit without any, so that
    commits can be counted."""
    commit = author = email = date = path = ""
    message: list[str] = []
    seen = True
    added: list[str] = []
    start = line = 0
    left = -1

    def meta() -> dict:
        return {"commit": commit, "author": author, "email": email, "date": date, "message": "\n".join(message).strip()}

    def flush() -> Iterator[dict]:
        nonlocal added, seen
        if added:
            yield {"path": path, "text": "\n".join(added), "start_line": start, **meta()}
            added, seen = [], True

    for row in text.split("\n"):
        if left > 0 and row[:1] in ("+", " ", "-", "\\"):
            if row.startswith("+"):
                if not added:
                    start = line
                added.append(row[1:])
                line, left = line + 1, left - 1
                continue
            if row[:1] == " ":
                line, left = line + 1, left - 1
            if row[:1] != "\\":
                yield from flush()
            continue
        if m := _COMMIT.match(row):
            yield from flush()
            if not seen:
                yield {"path": "", "text": "", "start_line": 0, **meta()}
            commit, author, email, date, path, message, seen, left = m[1], "", "", "", "", [], False, -1
        elif m := _PERSON.match(row):
            author, email = m[1], m[2]
        elif row.startswith("Date:") and not path:
            date = row[5:].strip()
        elif row.startswith("    ") and left < 0 and not path:
            message.append(row[4:])
        elif row.startswith("diff --git "):
            yield from flush()
            path, left = " ", 0
        elif row.startswith("+++ "):
            path = "" if row[4:].strip() == "/dev/null" else unquote(row[4:])
        elif m := _HUNK.match(row):
            yield from flush()
            line, left = int(m[1]), int(m[2]) if m[2] is not None else 1
    yield from flush()
    if not seen:
        yield {"path": "", "text": "", "start_line": 0, **meta()}


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("text", pa.string()), ("start_line", pa.int32()), *[(c, pa.string()) for c in ("commit", "author", "email", "date", "message")]])
    for b in batches:
        yield pa.RecordBatch.from_pylist([row for t in b.column(0) for row in parse_patch(t.as_py() or "")], kind)


def patch_content(patches: DataFrame) -> DataFrame:
    """The fragments of patches(text), each a whole `git log -p` or `git diff` output or one commit of it.
    Long histories are best given as a row for each commit, which Spark then deals out."""
    return patches.select("text").mapInArrow(_fragments, SCHEMA)


def commit_count(fragments: DataFrame) -> DataFrame:
    return fragments.where("commit <> ''").agg(F.countDistinct("commit").alias("commits"))
