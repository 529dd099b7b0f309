"""Recursive decoding of encoded stretches: percent, Unicode escapes, hexadecimal, base64, and in native
mode concatenated string literals of C# files.

Each depth gives one more text of an input, with the stretches replaced by what they decode to, and a
map from its offsets to those of the original text, so that findings point at the source.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: How encoded stretches look, in the order in which they are tried. Fixed names: the tags of findings.
ENCODINGS = {
    # From the beginning of a run of plain characters on, so that a long one is read once.
    "percent": re.compile(r"(?<![\w.~-])(?:[\w.~-]*+%[0-9A-Fa-f]{2})++[\w.~-]*+"),
    "unicode": re.compile(r"(?:\\u[0-9A-Fa-f]{4}|U\+[0-9A-Fa-f]{4,6} ?)+"),
    "hex": re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){8,}(?![0-9A-Za-z])"),
    "base64": re.compile(r"(?<![\w/+])(?=[\w/+=-]{16})[\w/+-]{14,}={0,2}(?![\w/+=])"),
}
CONCAT = re.compile(r'"(?:[^"\\\n]|\\.)*"(?:\s*\+\s*"(?:[^"\\\n]|\\.)*")+|(?i:string)\.Concat\(\s*"(?:[^"\\\n]|\\.)*"(?:\s*,\s*"(?:[^"\\\n]|\\.)*")+\s*\)')
_LITERAL = re.compile(r'"((?:[^"\\\n]|\\.)*)"')
MIN_CONCAT = 8


def _plain(b: bytes) -> str | None:
    """The bytes as text, if they are printable UTF-8."""
    try:
        s = b.decode()
    except UnicodeDecodeError:
        return None
    return s if s and all(c.isprintable() or c in "\t\r\n" for c in s) else None


def decode_one(kind: str, text: str) -> str | None:
    if kind == "percent":
        return _plain(unquote_to_bytes(text))
    if kind == "unicode":
        codes = [int(a or b, 16) for a, b in re.findall(r"\\u([0-9A-Fa-f]{4})|U\+([0-9A-Fa-f]{4,6})", text)]
        try:
            return _plain("".join(map(chr, codes)).encode("utf-16", "surrogatepass").decode("utf-16").encode())
        except (UnicodeError, ValueError):
            return None
    if kind == "hex":
        return _plain(bytes.fromhex(text))
    try:
        raw = text.rstrip("=").replace("-", "+").replace("_", "/")
        return _plain(base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True))
    except (binascii.Error, ValueError):
        return None


def decode_text(text: str, concat: bool = False) -> tuple[str, list[tuple[int, int, int, int]], list[str]]:
    """The text with its encoded stretches decoded, once; a segment (start, end, from, to) for each, the
    first two in the new text; and the encodings found. Where stretches overlap, the first kind wins."""
    # Disjoint and sorted, so that only the neighbours of a stretch can overlap it.
    taken: list[tuple[int, int, str]] = []
    kinds: list[str] = []

    def offer(kind: str, start: int, end: int, new: str | None) -> None:
        if new is None or new == text[start:end]:
            return
        at = bisect.bisect_left(taken, (start,))
        if (at == len(taken) or taken[at][0] >= end) and (not at or taken[at - 1][1] <= start):
            taken.insert(at, (start, end, new))
            if kind not in kinds:
                kinds.append(kind)

    if concat:
        for m in CONCAT.finditer(text):
            new = "".join(re.sub(r"\\(.)", r"\1", x) for x in _LITERAL.findall(m[0]))
            offer("csharp-concat", m.start(), m.end(), new if len(new.encode()) >= MIN_CONCAT else None)
    for kind, rx in ENCODINGS.items():
        for m in rx.finditer(text):
            offer(kind, m.start(), m.end(), decode_one(kind, m[0]))
    out, at, segments, n = [], 0, [], 0
    for start, end, new in taken:
        out += [text[at:start], new]
        n += start - at
        segments.append((n, n + len(new), start, end))
        n, at = n + len(new), end
    return "".join(out) + text[at:], segments, kinds


def compose(first: list[tuple[int, int, int, int]], then: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Segments of two decodings as those of one: the newer ones, mapped back through the older ones, and
    the older ones that the newer leave alone, moved to where they now stand."""

    def back(p: int, end: bool) -> int:
        shift = 0
        for s, e, f, t in first:
            if p < s or p == s and not end:
                break
            if p < e or p == e and end:
                return t if end else f
            shift = t - e
        return p + shift

    def moved(p: int) -> int:
        shift = 0
        for s, e, f, t in then:
            if p < t:
                break
            shift = e - t
        return p + shift

    out = [(s, e, back(f, False), back(t, True)) for s, e, f, t in then]
    for s, e, f, t in first:
        if not any(a < e and s < b for _, _, a, b in then):
            out.append((moved(s), moved(e), f, t))
    return sorted(out)


def _passes(depth: int, native: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for row in b.to_pylist():
                rows.append(row | {"decode_path": [], "original": None, "segments": []})
                text, segments, path = row["text"], [], []
                for _ in range(depth):
                    text, new, kinds = decode_text(text, native and row["path"].endswith(".cs"))
                    if not new:
                        break
                    segments = compose(segments, new)
                    path = path + [k for k in kinds if k not in path]
                    rows.append(row | {"text": text, "decode_path": path, "original": row["text"], "segments": [dict(zip(("start", "end", "from", "to"), s, strict=True)) for s in segments]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


_TEXTS = ["path", "text", "commit", "author", "email", "date", "message", "symlink_file", "provenance_type"]
_SEGMENT = "struct<start:int,end:int,from:int,to:int>"


def decoded_passes(inputs: DataFrame, depth: int, native: bool) -> DataFrame:
    """inputs, and with depth > 0 a row for each depth that decodes something: decode_path names the
    encodings met, original and segments lead back to the source."""
    if depth <= 0:
        return inputs.withColumns(
            {"decode_path": F.array().cast("array<string>"), "original": F.lit(None).cast("string"), "segments": F.expr("cast(array() as array<struct<start:int,end:int,from:int,to:int>>)")}
        )
    inputs = inputs.withColumn("input_id", F.col("input_id").cast("long"))
    # What pieces of large texts know of themselves goes along.
    rest = [f for f in inputs.schema if f.name not in ("input_id", *_TEXTS)]
    read = inputs.select("input_id", *_TEXTS, *[f.name for f in rest])
    fields = ["input_id long", *[f"{t} string" for t in _TEXTS], *[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "decode_path array<string>", "original string", f"segments array<{_SEGMENT}>"]
    kinds = {f.name: to_arrow_type(f.dataType) for f in read.schema}
    schema = pa.schema([*kinds.items(), ("decode_path", pa.list_(pa.string())), ("original", pa.string()), ("segments", pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "from", "to")])))])
    return read.mapInArrow(_passes(depth, native, schema), ", ".join(fields))


def original_offset(offset: Column, segments: Column, end: bool) -> Column:
    """Where an offset of a decoded text stands in the original: a segment stands for all of its source."""

    def step(acc: Column, s: Column) -> Column:
        inside = (offset > s["start"]) & (offset <= s["end"]) if end else (offset >= s["start"]) & (offset < s["end"])
        past = offset > s["end"] if end else offset >= s["end"]
        return F.when(inside, s["to"] if end else s["from"]).when(past, offset + s["to"] - s["end"]).otherwise(acc)

    return F.aggregate(segments, offset.cast("int"), step)
