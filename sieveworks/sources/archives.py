"""Archives as content: zip, tar, gzip and Zstandard, nested, with budgets."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Budget:
    """What one archive may unfold to. The defaults."""

    depth: int = 1
    entries: int = 4096
    total_bytes: int = 512 << 20
    ratio: int = 1000
    used_entries: int = field(default=0, init=False)
    used_bytes: int = field(default=0, init=False)

    def take(self, size: int, packed: int) -> bool:
        self.used_entries += 1
        self.used_bytes += size
        return self.used_entries <= self.entries and self.used_bytes <= self.total_bytes and size <= self.ratio * max(packed, 1)


def safe(name: str) -> str | None:
    """An entry's name with forward slashes, or None if it leads out of the archive."""
    name = name.replace("\\", "/")
    parts = name.split("/")
    if name.startswith("/") or ".." in parts or (len(name) > 1 and name[1] == ":") or not name.strip("/"):
        return None
    return "/".join(p for p in parts if p not in ("", "."))


def kind_of(data: bytes) -> str | None:
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstd"
    return "tar" if data[257:262] == b"ustar" else None


def _inner(name: str) -> str:
    """The name of what a compressed single file holds."""
    base = name.rsplit("/", 1)[-1].rsplit("!", 1)[-1]
    for end, new in ((".tgz", ".tar"), (".tzst", ".tar"), (".gz", ""), (".zst", "")):
        if base.lower().endswith(end):
            return base[: -len(end)] + new
    return base


def expand(name: str, data: bytes, budget: Budget, depth: int = 0) -> Iterator[tuple[str, bytes]]:
    """(path, content) of the files in an archive, paths written outer!inner; what is no archive, or lies
    deeper than the budget allows, is given as it is. Unsafe names and entries beyond the budget are left
    out. Damaged archives give what could be read before the damage."""
    kind = kind_of(data)
    if kind is None or depth > budget.depth:
        yield name, data
        return
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    path = safe(i.filename)
                    if path and not i.is_dir() and not i.flag_bits & 1 and budget.take(i.file_size, i.compress_size):
                        yield from expand(f"{name}!{path}", z.read(i), budget, depth + 1)
        elif kind == "tar":
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for m in t:
                    path = safe(m.name)
                    if path and m.isfile() and budget.take(m.size, m.size):
                        yield from expand(f"{name}!{path}", t.extractfile(m).read(), budget, depth + 1)
        else:
            if kind == "gzip":
                stream = gzip.GzipFile(fileobj=io.BytesIO(data))
            else:
                import zstandard

                stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True)
            most = min(budget.total_bytes - budget.used_bytes, budget.ratio * len(data))
            out = stream.read(most + 1)
            if len(out) <= most and budget.take(len(out), len(data)):
                # A tar within is the same archive, not one nested in it.
                yield from expand(f"{name}!{_inner(name)}", out, budget, depth if kind_of(out) == "tar" else depth + 1)
    except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, zlib.error, RuntimeError, NotImplementedError):
        return


def _expanded(budget: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = content.as_py()
                if data is None:
                    continue
                for name, inner in expand(path, data, Budget(**budget)):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([name]), pa.array([inner], pa.binary())], names=["archive", "path", "content"])

    return run


def archive_content(files: DataFrame, budget: Budget | None = None) -> DataFrame:
    """The files within files(path, content): a row (archive, path, content) for each, and for what is no
    archive one row. Each archive is opened by one task and given out entry by entry."""
    b = budget or Budget()
    settings = {"depth": b.depth, "entries": b.entries, "total_bytes": b.total_bytes, "ratio": b.ratio}
    return files.select("path", "content").mapInArrow(_expanded(settings), "archive string, path string, content binary")


def image_layers(files: DataFrame, budget: Budget | None = None) -> DataFrame:
    """Files of container images (docker save or OCI layouts): layers are unfolded one level deeper, and
    fingerprint_path is the path within the image, the same whatever the layer is called."""
    b = budget or Budget(depth=2)
    inner = archive_content(files, b)
    return inner.withColumn("fingerprint_path", F.regexp_replace("path", r"^.*?!(?:[^!]*(?:layer\.tar|\.tar|blobs/sha256/[0-9a-f]+)!)?", ""))
