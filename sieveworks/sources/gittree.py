"""The working tree of a Git checkout as content: what is staged, changed, and untracked.

The index and the objects are read as files, without Git: a task streams the index's entries and the tree of the
last commit as rows; which files differ is a join of the three sides, and only those that differ are
read. Checkouts are local folders that all executors see.
"""

from __future__ import annotations

import hashlib
import mmap
import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .content import ignore_files, listing, utf16_text
from .ignores import drop_ignored_paths

ENTRIES = pa.schema([("path", pa.string()), ("mode", pa.int32()), ("oid", pa.string()), ("size", pa.int64()), ("stage", pa.int32()), ("skipped", pa.bool_()), ("added", pa.bool_())])
TREE = pa.schema([("path", pa.string()), ("mode", pa.int32()), ("oid", pa.string())])
ROWS = 10_000
#: Modes of links and of commits of submodules.
LINK, SUBMODULE = 0o120000, 0o160000


def index_entries(data: bytes) -> Iterator[tuple[str, int, str, int, int, bool, bool]]:
    """(path, mode, oid, size, stage, whether the work tree skips it, whether it is only meant to be added)
    of each entry of an index of version 2, 3 or 4; raises ValueError if it is none, or damaged."""
    if len(data) < 32 or data[:4] != b"DIRC":
        raise ValueError("no index")
    version, count = struct.unpack_from(">II", data, 4)
    if version not in (2, 3, 4):
        raise ValueError(f"index version {version}")
    if any(data[-20:]) and hashlib.sha1(data[:-20]).digest() != data[-20:]:
        raise ValueError("the index is damaged")
    i, before = 12, b""
    for _ in range(count):
        start = i
        mode, size = struct.unpack_from(">I8xI", data, i + 24)
        oid = data[i + 40 : i + 60].hex()
        (flags,) = struct.unpack_from(">H", data, i + 60)
        i += 62
        extended = 0
        if flags & 0x4000:
            if version < 3:
                raise ValueError("more flags than version 2 has")
            (extended,) = struct.unpack_from(">H", data, i)
            i += 2
        if version == 4:
            # How many bytes of the path before are dropped, and what follows in their place.
            drop, shift = data[i] & 127, data[i] & 128
            while shift:
                i += 1
                drop = (drop + 1 << 7) | data[i] & 127
                shift = data[i] & 128
            end = data.index(0, i + 1)
            path = before[: len(before) - drop] + data[i + 1 : end]
            i = end + 1
        else:
            end = data.index(0, i)
            path = data[i:end]
            i = start + (end - start + 8) // 8 * 8
        if i > len(data) - 20:
            raise ValueError("the index is cut off")
        before = path
        yield path.decode("utf-8", "surrogateescape"), mode, oid, size, flags >> 12 & 3, bool(extended & 0x4000), bool(extended & 0x2000)


class Objects:
    """The objects of a repository, loose and packed, also those of its alternates."""

    KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}

    def __init__(self, folder: str):
        self.folders = [os.path.join(folder, "objects")]
        for at in self.folders:
            listed = os.path.join(at, "info", "alternates")
            if os.path.exists(listed):
                with open(listed) as f:
                    more = [os.path.normpath(os.path.join(at, x.strip())) for x in f if x.strip() and x[0] != "#"]
                self.folders += [x for x in more if x not in self.folders]
        self.packs: list[tuple[mmap.mmap, str]] | None = None
        self.open: dict[str, mmap.mmap] = {}

    def get(self, oid: str) -> tuple[str, bytes]:
        """The kind and the content of an object; raises KeyError."""
        for at in self.folders:
            try:
                with open(os.path.join(at, oid[:2], oid[2:]), "rb") as f:
                    head, _, body = zlib.decompress(f.read()).partition(b"\0")
                return head.split()[0].decode(), body
            except FileNotFoundError:
                continue
        for index, pack in self._packs():
            if (offset := self._offset(index, bytes.fromhex(oid))) is not None:
                return self._packed(pack, offset)
        raise KeyError(oid)

    def _packs(self) -> list[tuple[mmap.mmap, str]]:
        if self.packs is None:
            self.packs = []
            for at in self.folders:
                folder = os.path.join(at, "pack")
                for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                    if name.endswith(".idx"):
                        index = self._mapped(os.path.join(folder, name))
                        if index[:8] != b"\xfftOc\0\0\0\2":
                            raise ValueError(f"no pack index of version 2: {name}")
                        self.packs.append((index, os.path.join(folder, name[:-4] + ".pack")))
        return self.packs

    def _mapped(self, path: str) -> mmap.mmap:
        if path not in self.open:
            with open(path, "rb") as f:
                self.open[path] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        return self.open[path]

    @staticmethod
    def _offset(index: mmap.mmap, oid: bytes) -> int | None:
        """Where an object stands in its pack, by bisection among those with its first byte."""
        fan = lambda b: struct.unpack_from(">I", index, 8 + 4 * b)[0]
        low, high, total = fan(oid[0] - 1) if oid[0] else 0, fan(oid[0]), fan(255)
        names = 8 + 1024
        while low < high:
            mid = (low + high) // 2
            here = index[names + 20 * mid : names + 20 * mid + 20]
            if here == oid:
                (offset,) = struct.unpack_from(">I", index, names + 24 * total + 4 * mid)
                if offset & 0x80000000:
                    (offset,) = struct.unpack_from(">Q", index, names + 28 * total + 8 * (offset & 0x7FFFFFFF))
                return offset
            low, high = (mid + 1, high) if here < oid else (low, mid)
        return None

    def _packed(self, pack: str, offset: int) -> tuple[str, bytes]:
        """An object of a pack. Deltas are collected down to their base, then applied from it upwards."""
        data, deltas = self._mapped(pack), []
        while True:
            i = offset
            kind, more = data[i] >> 4 & 7, data[i] & 128
            i += 1
            while more:
                more = data[i] & 128
                i += 1
            base = None
            if kind == 6:
                back = data[i] & 127
                while data[i] & 128:
                    i += 1
                    back = (back + 1 << 7) | data[i] & 127
                i += 1
            elif kind == 7:
                base, i = data[i : i + 20].hex(), i + 20
            body = self._inflated(data, i)
            if kind in self.KINDS:
                found = self.KINDS[kind], body
                break
            deltas.append(body)
            if kind == 6:
                offset -= back
            elif kind == 7:
                found = self.get(base)
                break
            else:
                raise ValueError("no kind of object")
        name, body = found
        for d in reversed(deltas):
            body = _patched(body, d)
        return name, body

    @staticmethod
    def _inflated(data: mmap.mmap, at: int) -> bytes:
        z, out = zlib.decompressobj(), []
        while not z.eof:
            chunk = data[at : at + (1 << 16)]
            if not chunk:
                raise ValueError("the pack is cut off")
            out.append(z.decompress(chunk))
            at += len(chunk)
        return b"".join(out)


def _patched(base: bytes, delta: bytes) -> bytes:
    """A delta applied: it copies stretches of the base and adds bytes of its own."""

    def size(i: int) -> tuple[int, int]:
        v = shift = 0
        while True:
            v |= (delta[i] & 127) << shift
            shift += 7
            i += 1
            if not delta[i - 1] & 128:
                return v, i

    _, i = size(0)
    total, i = size(i)
    out = []
    while i < len(delta):
        op = delta[i]
        i += 1
        if op & 128:
            at = n = 0
            for k in range(4):
                if op >> k & 1:
                    at, i = at | delta[i] << 8 * k, i + 1
            for k in range(3):
                if op >> 4 + k & 1:
                    n, i = n | delta[i] << 8 * k, i + 1
            out.append(base[at : at + (n or 0x10000)])
        else:
            out.append(delta[i : i + op])
            i += op
    body = b"".join(out)
    if len(body) != total:
        raise ValueError("the delta does not fit its base")
    return body


def git_folder(root: str) -> str:
    """The folder of the repository that a checkout belongs to."""
    at = os.path.join(root, ".git")
    if os.path.isfile(at):
        with open(at) as f:
            return os.path.normpath(os.path.join(root, f.read().strip().removeprefix("gitdir: ")))
    if not os.path.isdir(at):
        raise ValueError(f"no checkout: {root}")
    return at


def _common(folder: str) -> str:
    """The folder that a linked work tree shares with its repository."""
    link = os.path.join(folder, "commondir")
    if os.path.exists(link):
        with open(link) as f:
            return os.path.normpath(os.path.join(folder, f.read().strip()))
    return folder


def head_commit(folder: str) -> str | None:
    """The commit that HEAD names; None before the first one."""
    with open(os.path.join(folder, "HEAD")) as f:
        at = f.read().strip()
    for _ in range(8):
        if not at.startswith("ref: "):
            return at
        name = at[5:]
        for base in (folder, _common(folder)):
            path = os.path.join(base, *name.split("/"))
            if os.path.exists(path):
                with open(path) as f:
                    at = f.read().strip()
                break
        else:
            packed = os.path.join(_common(folder), "packed-refs")
            lines = open(packed).read().splitlines() if os.path.exists(packed) else []
            at = next((x.split()[0] for x in lines if x[:1] not in "#^" and x.split()[1:] == [name]), "")
            return at or None
    raise ValueError("references go round in circles")


def tree_files(objects: Objects, commit: str | None) -> Iterator[tuple[str, int, str]]:
    """(path, mode, oid) of the files of a commit's tree, folder by folder."""
    if commit is None:
        return
    kind, body = objects.get(commit)
    while kind == "tag":
        kind, body = objects.get(body[7:47].decode())
    todo = [("", body[5:45].decode())]
    while todo:
        folder, oid = todo.pop()
        _, body = objects.get(oid)
        i = 0
        while i < len(body):
            space, end = body.index(b" ", i), body.index(b"\0", i)
            mode, path = int(body[i:space], 8), folder + body[space + 1 : end].decode("utf-8", "surrogateescape")
            oid, i = body[end + 1 : end + 21].hex(), end + 21
            if mode == 0o040000:
                todo.append((path + "/", oid))
            else:
                yield path, mode, oid


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema=schema)
            held = []
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in held], schema=schema)


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """The entries of a checkout's index; none before the first file is added."""
    path = os.path.join(git_folder(root), "index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            if os.path.exists(path):
                with open(path, "rb") as f:
                    yield from _in_batches(index_entries(f.read()), ENTRIES)

    return spark.range(1, numPartitions=1).mapInArrow(run, "path string, mode int, oid string, size long, stage int, skipped boolean, added boolean")


def read_head(spark: SparkSession, root: str) -> DataFrame:
    """The files of the commit that a checkout stands on."""
    folder = git_folder(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _in_batches(tree_files(Objects(_common(folder)), head_commit(folder)), TREE)

    return spark.range(1, numPartitions=1).mapInArrow(run, "path string, mode int, oid string")


def read_blobs(rows: DataFrame, root: str) -> DataFrame:
    """rows(path, oid) with the content of each blob, a blob at a time."""
    folder = _common(git_folder(root))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        objects = Objects(folder)
        for b in batches:
            for path, oid in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([objects.get(oid)[1]], pa.binary())], names=["path", "content"])

    return rows.select("path", "oid").mapInArrow(run, "path string, content binary")


def changes(index: DataFrame, head: DataFrame, files: DataFrame) -> DataFrame:
    """A row (path, status, oid) for each file that is staged (the index has another blob or mode than the
    head; oid is the index's), changed (files(path, oid, mode) has another than the index) or untracked (no
    entry of the index). A file can be staged and changed. Files in conflict are changed and not staged;
    submodules, files that the work tree skips, and files only meant to be added are not staged or changed."""
    entries = index.where(F.col("mode") != SUBMODULE)
    plain = entries.where("stage = 0 and not skipped").select("path", "mode", "oid", "added")
    was = head.select("path", F.col("mode").alias("was_mode"), F.col("oid").alias("was_oid"))
    staged = plain.where("not added").join(was, "path", "left").where(~(F.col("oid").eqNullSafe(F.col("was_oid")) & F.col("mode").eqNullSafe(F.col("was_mode"))))
    now = files.select("path", F.col("oid").alias("now_oid"), F.col("mode").alias("now_mode"))
    changed = plain.join(now, "path").where(F.col("added") | (F.col("oid") != F.col("now_oid")) | (F.col("mode") != F.col("now_mode"))).select("path", F.col("now_oid").alias("oid"))
    conflict = entries.where("stage > 0").select("path").distinct().join(now, "path").select("path", F.col("now_oid").alias("oid"))
    untracked = now.join(index.select("path").distinct(), "path", "left_anti").select("path", F.col("now_oid").alias("oid"))
    parts = (("staged", staged.select("path", "oid")), ("changed", changed.unionByName(conflict)), ("untracked", untracked))
    out = [df.select("path", F.lit(status).alias("status"), "oid") for status, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def _digests(root: str):
    """Adds to each file its blob's digest and its mode; a link's blob is where it leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                full = os.path.join(root, path)
                try:
                    if os.path.islink(full):
                        body, mode = os.readlink(full).encode(), LINK
                        digest = hashlib.sha1(b"blob %d\0" % len(body) + body)
                    else:
                        size = os.path.getsize(full)
                        digest, mode = hashlib.sha1(b"blob %d\0" % size), 0o100755 if os.access(full, os.X_OK) else 0o100644
                        with open(full, "rb") as f:
                            while chunk := f.read(1 << 20):
                                digest.update(chunk)
                except FileNotFoundError:
                    continue
                rows.append({"path": path, "mode": mode, "oid": digest.hexdigest()})
            yield pa.RecordBatch.from_pylist(rows, schema=TREE)

    return run


def _worktree(root: str):
    """Adds the bytes of each file of the work tree, a file at a time; of links, where they lead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                full = os.path.join(root, path)
                try:
                    if os.path.islink(full):
                        body = os.readlink(full).encode()
                    else:
                        with open(full, "rb") as f:
                            body = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([body], pa.binary())], names=["path", "content"])

    return run


def working_tree(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """The content of what is staged (provenance_type git-index, from the index), changed (git-worktree) and
    untracked and not ignored (git-untracked), as rows (path, text, status, provenance_type, oid) that a scan takes;
    the findings of both sides go together by merge_snapshots. Line endings are compared as they are."""
    root = os.path.abspath(root)
    every = listing(spark, root).where("path <> '.git' and not startswith(path, '.git/') and not contains(path, '/.git/')")
    index = read_index(spark, root)
    tracked = every.join(index.select("path").distinct(), "path", "left_semi")
    other = drop_ignored_paths(every.join(index.select("path").distinct(), "path", "left_anti"), ignore_files(every, root, names), names)
    files = tracked.unionByName(other).select("path").mapInArrow(_digests(root), "path string, mode int, oid string")
    found = changes(index, read_head(spark, root), files)
    staged = read_blobs(found.where("status = 'staged'"), root).withColumn("status", F.lit("staged"))
    rest = found.where("status <> 'staged'")
    here = rest.select("path").mapInArrow(_worktree(root), "path string, content binary").join(rest.select("path", "status"), "path")
    both = staged.unionByName(here).join(found, ["path", "status"])
    kinds = F.when(F.col("status") == "staged", "git-index").when(F.col("status") == "changed", "git-worktree").otherwise("git-untracked")
    text = F.coalesce(utf16_text(F.col("content")), F.col("content").cast("string"))
    return both.select("path", text.alias("text"), "status", kinds.alias("provenance_type"), "oid")
