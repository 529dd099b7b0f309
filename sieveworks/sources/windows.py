"""Large texts as bounded pieces that are scanned on their own, with absolute positions.

Strict scans cut a text into fragments that do not overlap. Native scans read windows that overlap on both
sides. A window owns the stretch between its cut and the next, and of the findings in it only those that begin
in its own stretch count, so that each one is found once, without comparing the findings of
windows. Cuts fall behind characters that no match can hold, where the rules have any: else a window that begins
within matches that follow one on the other could pair what they consist of otherwise than the whole text does.
Pieces of one text are rows of their own and can be dealt over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveworks.operators.filters import INLINE_MARK

#: Bytes of a strict fragment, and how far it may go on to the next blank line.
FRAGMENT_BYTES, AHEAD_BYTES = 100_000, 25_000
#: Bytes between the cuts of native windows, and how far windows reach beyond their stretch on both sides.
WINDOW_BYTES, OVERLAP_BYTES = 1 << 18, 1 << 16
#: Bytes of pieces that one batch to the JVM holds.
BATCH_BYTES = 8 << 20
_BLANK = re.compile(rb"\n[ \t\r]*\n")
_SPACE = b" \t\r\n"

#: What a piece is besides its text: its number, the 1-based line and column of its first character in the whole
#: text, the stretch (in code points of the piece, end excluded) whose findings it owns, and lines that a cut
#: went through and that hold the mark of allowed lines.
PIECE = {"fragment": pa.int32(), "source_line": pa.int32(), "source_column": pa.int32(), "owned_from": pa.int32(), "owned_to": pa.int32(), "allowed_lines": pa.list_(pa.int32())}
PIECE_DDL = "fragment int, source_line int, source_column int, owned_from int, owned_to int, allowed_lines array<int>"
Piece = tuple[bytes, int, int, int, int, list[int]]


def _whole_character(data: bytes, at: int) -> int:
    """The first place not after `at` where a character begins."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def fragment_cuts(data: bytes, size: int, ahead: int) -> list[int]:
    """Where the fragments of a text begin: after `size` bytes, and on to the end of the next blank line if one
    ends within `ahead` bytes more; else behind those. A fragment that ends in a blank line is not extended."""
    cuts, at = [0], 0
    while at + size < len(data):
        end = _whole_character(data, at + size)
        space = len(data[at:end].rstrip(_SPACE)) + at
        if data.count(b"\n", space, end) < 2:
            blank = _BLANK.search(data, space, min(len(data), end + ahead))
            end = blank.end() if blank else _whole_character(data, min(len(data), end + ahead))
        if end >= len(data):
            break
        at = end if end > at else min(len(data), at + size + 4)
        cuts.append(at)
    return cuts


def window_cuts(data: bytes, size: int, breaks: bytes = b"") -> list[int]:
    """Where the stretches of a text begin: at the last line that begins in the second half of `size` bytes,
    or, where lines are longer, at the first character behind them. With breaks, only behind one of these ASCII
    characters: the last one in that half, or the first one behind it, however far it is."""
    cuts, at = [0], 0
    if breaks:
        one = b"[" + re.escape(breaks) + b"]"
        last, first = re.compile(b"(?s).*" + one), re.compile(one)
        while at + size < len(data):
            found = last.match(data, at + size // 2, at + size) or first.search(data, at + size)
            if not found or found.end() == len(data):
                break
            at = found.end()
            cuts.append(at)
        return cuts
    while at + size < len(data):
        line = data.rfind(b"\n", at + size // 2, at + size) + 1
        at = line or max(_whole_character(data, at + size), at + 1)
        cuts.append(at)
    return cuts


def fragment_pieces(data: bytes, size: int, ahead: int) -> Iterator[Piece]:
    cuts, line = fragment_cuts(data, size, ahead), 1
    for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
        text = data[a:b]
        yield text, line, 1, 0, 1 << 30, []
        line += text.count(b"\n")


def window_pieces(data: bytes, size: int, overlap: int, breaks: bytes = b"") -> Iterator[Piece]:
    """Each stretch with up to `overlap` bytes on both sides; before it, from the beginning of a line if one
    begins there. Positions are counted on from stretch to stretch."""
    cuts, mark = window_cuts(data, size, breaks), INLINE_MARK.encode()
    allowed, counted, n, line_end = [], 0, 1, -1
    for c in cuts[1:]:
        if data[c - 1 : c] != b"\n" and c > line_end:
            start, line_end = data.rfind(b"\n", 0, c) + 1, data.find(b"\n", c)
            line_end = line_end if line_end >= 0 else len(data)
            n += data.count(b"\n", counted, start)
            counted = start
            if data.find(mark, start, line_end) >= 0:
                allowed.append(n)
    # Windows begin one behind the other, so that positions are counted on from each to the next.
    place, line, column = 0, 1, 1
    for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True):
        begin = _whole_character(data, max(0, a - overlap))
        if begin:
            begin = data.find(b"\n", begin - 1, a) + 1 or begin
        end = _whole_character(data, min(len(data), b + overlap))
        last = data.rfind(b"\n", place, begin) + 1
        column = _length(data[max(last, place) : begin]) + (1 if last else column)
        line += data.count(b"\n", place, begin)
        place = begin
        before = _length(data[begin:a])
        # What begins at the very end of a text is its last window's, too.
        yield data[begin:end], line, column, before, before + _length(data[a:b]) + (b == len(data)), allowed


def _length(data: bytes) -> int:
    return len(data.decode("utf-8", "replace"))


def _cut(pieces: Callable[[bytes], Iterator[Piece]], whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            rows: list[int] = []
            found: list[Piece] = []
            numbers: list[int] = []
            held = 0

            def send(b=b, at=at, rows=rows, found=found, numbers=numbers) -> pa.RecordBatch:
                cols = list(b.take(pa.array(rows, pa.int64())).columns)
                cols[at] = pa.array([p[0].decode("utf-8", "replace") for p in found], pa.string())
                extra = [numbers, *([p[k] for p in found] for k in range(1, 6))]
                cols += [pa.array(v, t) for v, t in zip(extra, PIECE.values(), strict=True)]
                return pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *PIECE])

            for i, text in enumerate(b.column(at)):
                data = b"" if not text.is_valid else text.as_buffer().to_pybytes()
                few = [(data, 1, 1, 0, 1 << 30, [])] if len(data) <= whole else pieces(data)
                for k, piece in enumerate(few):
                    rows.append(i)
                    found.append(piece)
                    numbers.append(k)
                    held += len(piece[0])
                    if held >= BATCH_BYTES:
                        yield send()
                        rows.clear(), found.clear(), numbers.clear()
                        held = 0
            if rows:
                yield send()

    return run


def _pieces(content: DataFrame, pieces: Callable[[bytes], Iterator[Piece]], whole: int, deal: bool) -> DataFrame:
    kept = content.drop(*PIECE)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    nothing = {"fragment": F.lit(0), "source_line": F.lit(1), "source_column": F.lit(1), "owned_from": F.lit(0), "owned_to": F.lit(1 << 30), "allowed_lines": F.expr("cast(array() as array<int>)")}
    # Only large texts go through Python, and only they are dealt.
    small = kept.where(size <= whole).select("*", *[v.alias(k) for k, v in nothing.items()])
    large = kept.where(size > whole).mapInArrow(_cut(pieces, whole), f"{fields}, {PIECE_DDL}")
    return small.unionByName(large.repartition("path", "fragment") if deal else large)


def byte_fragments(content: DataFrame, size: int = FRAGMENT_BYTES, ahead: int = AHEAD_BYTES, deal: bool = False) -> DataFrame:
    """content(path, text, ...) with a row for each fragment of a text of more than `size` bytes, in the columns
    of PIECE besides its own. No character is in two fragments or lost; null texts stay one row of no text."""
    return _pieces(content, lambda data: fragment_pieces(data, size, ahead), size, deal)


def windows(content: DataFrame, size: int = WINDOW_BYTES, overlap: int = OVERLAP_BYTES, deal: bool = False, breaks: bytes = b"") -> DataFrame:
    """content(path, text, ...) with a row for each window of a text of more than size + overlap bytes, in the
    columns of PIECE besides its own. Stretches are about `size` bytes, and a finding of up to `overlap` bytes
    is seen whole by the window that owns it. With deal, windows of large texts are dealt over tasks by path
    and number, so that one huge text is no single task's work. breaks: ASCII characters that no match can hold;
    with them every match is seen whole and as in the whole text, and a stretch without any stays in one piece.
    Null texts stay one row."""
    return _pieces(content, lambda data: window_pieces(data, size, overlap, breaks), size + overlap, deal)
