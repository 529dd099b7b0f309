"""Content from tables and files: path, text and provenance, ready for a scan."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ignores import IGNORE_FILES, drop_ignored_paths
from .signatures import signature_type

#: Bytes that decide whether a file is binary.
PROBE = 8000


def table_content(df: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    """A table's text column as content: the path is prefix/key, input_id the key."""
    return df.select(F.col(key).cast("long").alias("input_id"), F.concat(F.lit(f"{prefix}/"), F.col(key).cast("string")).alias("path"), F.col(text).cast("string").alias("text"))


def utf16_text(content: Column) -> Column:
    """Bytes with a UTF-16 byte-order mark, decoded; null without one."""
    head = F.hex(F.substring(content, 1, 2))
    body = F.substring(content, 3, 1 << 30)
    return F.when(head == "FFFE", F.decode(body, "UTF-16LE")).when(head == "FEFF", F.decode(body, "UTF-16BE"))


def is_binary(content: Column, native: bool) -> Column:
    """Native: a zero byte among the first bytes, unless they begin with a UTF-16 mark. Strict: a
    signature of an application format."""
    if native:
        marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
        return ~marked & F.contains(F.substring(content, 1, PROBE), F.lit(b"\0"))
    return F.coalesce(signature_type(content) == "application", F.lit(False))


_LINK = pa.schema([("path", pa.string()), ("target", pa.string()), ("folder", pa.bool_())])


def links(spark: SparkSession, root: str) -> DataFrame:
    """A row (path, target, folder) for each link under a local root, its path and its target, resolved to the
    end, relative to the root. The target is null for links out of the root, to nothing, and in circles.
    Folders are dealt over tasks like those of a listing."""
    top = os.path.realpath(_absolute(root).removeprefix("file://"))
    seeds, level = [], [""]
    found: list[tuple[str, str, bool]] = []

    def look(folder: str) -> tuple[list[tuple[str, str, bool]], list[str]]:
        rows, below = [], []
        with os.scandir(os.path.join(top, folder)) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_symlink():
                    try:
                        real = os.path.realpath(e.path, strict=True)
                    except OSError:
                        real = ""
                    inside = real == top or real.startswith(top.rstrip("/") + "/")
                    rows.append((path, real[len(top) :].strip("/") if inside else None, os.path.isdir(real)))
                elif e.is_dir(follow_symlinks=False):
                    below.append(path)
        return rows, below

    while level and len(level) + len(seeds) < LISTED_FOLDERS:
        rows, below = look(level.pop(0))
        found += rows
        level += below
    seeds += level

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for folder in b.column(0).to_pylist():
                todo = [folder]
                while todo:
                    rows, below = look(todo.pop())
                    todo += below
                    yield pa.RecordBatch.from_pylist([dict(zip(_LINK.names, r, strict=True)) for r in rows], schema=_LINK)

    out = spark.createDataFrame(found, "path string, target string, folder boolean")
    if seeds:
        dealt = spark.createDataFrame([(d,) for d in seeds], "folder string").repartition(len(seeds))
        out = out.union(dealt.mapInArrow(walk, "path string, target string, folder boolean"))
    return out


def followed(spark: SparkSession, root: str) -> DataFrame:
    """The listing of a local tree with symlink_file: the first, in order, of the links inside the root that lead
    to a file, by itself or through a linked folder above it; empty for files that no link leads to. Since
    whatever a link may lead to is in the tree, each file is listed once, under its own path, and circles
    end by themselves; what is outside is refused. One link is followed on a path, not links below links."""
    files = listing(spark, root)
    known = links(spark, root)
    files = files.join(known.select("path").where("not folder"), "path", "left_anti")
    parts = F.split("path", "/", -1)
    # The file itself, its folders, and the root.
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    # Links without a target meet nothing.
    reached = files.select("path", F.explode(above).alias("target")).join(known.withColumnRenamed("path", "link"), "target")
    name = F.when(F.col("folder"), F.concat("link", F.lit("/"), F.substring("path", F.when(F.col("target") == "", 1).otherwise(F.char_length("target") + 2), F.char_length("path")))).otherwise(F.col("link"))
    named = reached.groupBy("path").agg(F.min(name).alias("symlink_file"))
    return files.join(named, "path", "left").withColumn("symlink_file", F.coalesce("symlink_file", F.lit("")))


#: Folders among which the listing of a tree is dealt; above them the driver lists.
LISTED_FOLDERS = 64


def _absolute(root: str) -> str:
    return root if re.match(r"[a-z0-9]+:", root) else os.path.abspath(root)


def _opened(root: str) -> tuple[FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if not re.match(r"[a-z0-9]+:", root):
        return LocalFileSystem(), root
    return FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", root)))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """A row (path, location, length) for each file under a root, the path relative to it. Hidden files and
    folders, which Spark's own readers pass over, are listed too; links to folders are not followed. The
    driver only lists folders, down to where there are LISTED_FOLDERS of them; tasks list what is below."""
    root = _absolute(root)
    fs, top = _opened(root)
    local = isinstance(fs, LocalFileSystem)

    def children(folder: str) -> tuple[list, list]:
        infos = fs.get_file_info(FileSelector(folder, recursive=False, allow_not_found=True))
        files = [i for i in infos if i.type == FileType.File]
        return files, [i.path for i in infos if i.type == FileType.Directory and not (local and os.path.islink(i.path))]

    one = fs.get_file_info(top)
    files, level, deep = ([one], [], []) if one.type == FileType.File else ([], [top], [])
    while level and len(level) + len(deep) < LISTED_FOLDERS:
        found, below = children(level.pop(0))
        files += found
        level += below
    deep += level
    base = top.rpartition("/")[0] if one.type == FileType.File else top.rstrip("/")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, _ = _opened(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                todo = [folder]
                while todo:
                    infos = inside.get_file_info(FileSelector(todo.pop(), recursive=False, allow_not_found=True))
                    todo += [i.path for i in infos if i.type == FileType.Directory and not (local and os.path.islink(i.path))]
                    rows = [(i.path, i.size) for i in infos if i.type == FileType.File]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int64()))], names=["location", "length"])

    known = spark.createDataFrame([(i.path, i.size) for i in files], "location string, length long")
    if deep:
        folders = spark.createDataFrame([(d,) for d in deep], "folder string").repartition(len(deep))
        known = known.union(folders.mapInArrow(walk, "location string, length long"))
    relative = F.substring("location", len(base) + 2, 1 << 20)
    return known.select(relative.alias("path"), "location", "length")


def _contents(root: str):
    """Adds the bytes of each file, a file at a time; those that are gone by now are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(root)
        for b in batches:
            for row in b.to_pylist():
                try:
                    with fs.open_input_stream(row["location"]) as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], names=["path", "content", "length"])

    return run


def ignore_files(files: DataFrame, root: str, names: tuple[str, ...] = IGNORE_FILES) -> DataFrame:
    """The ignore files of a listing, as (path, text)."""
    found = files.where(F.substring_index("path", "/", -1).isin(list(names))).select("path", "location")
    return found.mapInArrow(_contents(_absolute(root)), "path string, content binary, length long").select("path", F.col("content").cast("string").alias("text"))


def file_content(spark: SparkSession, root: str, native: bool = False, max_bytes: int | None = None, ignore: list[str] | None = None, ignored_by: tuple[str, ...] = (), follow: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """The files under a root, hidden ones included. Sizes and ignored paths are settled before contents
    are read. Rows: path (relative), text, length, sha256 of the original bytes. Binary files and those of
    more than max_bytes have no text, so that only rules of paths apply to them; the latter are not read.
    ignored_by: names of ignore files that are honoured wherever they stand in the tree, as in IGNORE_FILES.
    follow: files that links lead to have the link as symlink_file; see followed(). listed: rows of a
    listing of the root, to read these only."""
    files = listed if listed is not None else followed(spark, root) if follow else listing(spark, root)
    if ignored_by:
        files = drop_ignored_paths(files, ignore_files(files, root, ignored_by), ignored_by)
    for rx, keep in ignore_patterns(ignore or []):
        files = files.withColumn("_skip", F.when(F.regexp_like("path", F.lit(rx)), F.lit(not keep)).otherwise(F.col("_skip") if "_skip" in files.columns else F.lit(False)))
    if "_skip" in files.columns:
        files = files.where(~F.col("_skip")).drop("_skip")
    fits = F.col("length") <= max_bytes if max_bytes is not None else F.lit(True)
    read = files.where(fits).select("path", "location")
    read = read.mapInArrow(_contents(_absolute(root)), "path string, content binary, length long")
    names = files.select("path", "symlink_file") if follow else None
    text = F.coalesce(utf16_text(F.col("content")), F.col("content").cast("string")) if native else F.col("content").cast("string")
    text = F.when(~is_binary(F.col("content"), native), text)
    out = read.select("path", text.alias("text"), "length", F.sha2("content", 256).alias("blob_sha256"), F.lit("file").alias("provenance_type"))
    if max_bytes is not None:
        nothing = F.lit(None).cast("string")
        out = out.union(files.where(~fits).select("path", nothing, "length", nothing, F.lit("file")))
    return out.join(names, "path") if follow else out


def ignore_patterns(lines: list[str]) -> list[tuple[str, bool]]:
    """Lines of an ignore file as (regular expression over relative paths, whether it brings back)."""
    out = []
    for line in lines:
        text = line.rstrip()
        if not text or text.startswith("#"):
            continue
        back = text.startswith("!")
        text = text.removeprefix("!").removeprefix("\\")
        anchored = "/" in text.rstrip("/")
        body = ""
        for part in re.split(r"(\*\*/|/\*\*|\*|\?|\[[^\]]*\])", text.strip("/")):
            body += {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(part) or (fnmatch.translate(part)[4:-3] if part.startswith("[") else re.escape(part))
        out.append((f"^{'' if anchored else '(?:.*/)?'}{body}{'/.*' if text.endswith('/') else '(?:/.*)?'}$", back))
    return out


def fragments(content: DataFrame, size: int = 100_000, ahead: int = 25_000) -> DataFrame:
    """Long texts cut into fragments of about `size` characters, each going on to the next blank line if
    one comes within `ahead`, with the offset and line where it begins. Shorter texts are one fragment. A
    text is cut by a fold over its blocks between blank lines, so that cuts never depend on partitions."""
    def cut(text: str) -> list[dict]:
        out, at, line = [], 0, 1
        while at < len(text) or not out:
            end = min(len(text), at + size)
            if end < len(text):
                blank = re.compile(r"\n[ \t\r]*\n").search(text, max(at, end - 1), min(len(text), end + ahead))
                end = blank.end() if blank else min(len(text), end + ahead)
            out.append({"fragment": len(out), "start_offset": at, "start_line": line, "text": text[at:end]})
            line += text.count("\n", at, end)
            at = end
        return out

    kind = pa.list_(pa.struct([("fragment", pa.int32()), ("start_offset", pa.int64()), ("start_line", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([cut(t.as_py() or "") for t in b.column("text")], kind)], names=["path", "parts"])

    parts = content.select("path", "text").mapInArrow(run, "path string, parts array<struct<fragment:int,start_offset:long,start_line:int,text:string>>")
    return parts.select("path", F.inline("parts"))
