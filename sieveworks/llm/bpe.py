"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece, exactly one token can stand last in the prefix's encoding: the
token t whose bytes end the prefix such that t fits behind the last token of the prefix before
it. Two tokens fit when merging, lowest rank first and leftmost first, would never join a piece
across their boundary; then encoding their concatenation gives the two back. So a table of last
tokens is filled from left to right, read off from the end, appended to without touching what
is there, and refilled only from the first changed byte after an edit.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import released

_NEVER = 1 << 62
#: Pieces that are worth filling together.
FEW = 8


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank from a rank file: a line of base64 and a number for each token."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def piece_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern, with white space as Unicode defines it."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class _Steps:
    """The steps of a trie as a table that arrays of nodes and bytes are looked up in."""

    def __init__(self, step: dict[int, int]):
        self.bits = (4 * len(step)).bit_length()
        self.keys, self.nodes = np.full(1 << self.bits, -1, np.int32), np.zeros(1 << self.bits, np.int32)
        keys, nodes = np.fromiter(step, np.int32, len(step)), np.fromiter(step.values(), np.int32, len(step))
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]], self.nodes[place[free]] = keys[free], nodes[free]
            rest = self.keys[place] != keys
            keys, nodes, place = keys[rest], nodes[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int32)

    def take(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that these steps lead to; 0 where there is no such step."""
        keys = node << 8 | byte
        place = self._place(keys)
        held = self.keys[place]
        out = np.where(held == keys, self.nodes[place], 0)
        wrong = np.flatnonzero((held != keys) & (held >= 0))
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & ((1 << self.bits) - 1)
            held = self.keys[place[wrong]]
            right = held == keys[wrong]
            out[wrong[right]] = self.nodes[place[wrong[right]]]
            wrong = wrong[~right & (held >= 0)]
        return out


class PrefixBpe:
    """The fitting of tokens, and last tokens of prefixes, for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = max(ranks.values(), default=0) + 1
        self.bytes_of = [b""] * self.width
        for b, r in ranks.items():
            self.bytes_of[r] = b
        # A trie of the tokens' bytes from the last to the first. Its nodes are ends of tokens, node 0 the
        # empty one; a step from a node to the byte before has the key node << 8 | byte.
        at = {b"": 0}
        for b in ranks:
            for i in range(len(b) - 1, -1, -1):
                at.setdefault(b[i:], len(at))
        self.token = np.full(len(at), -1, np.int32)
        for b, r in ranks.items():
            self.token[at[b]] = r
        self.step = {at[b[1:]] << 8 | b[0]: n for b, n in at.items() if b}
        self._steps = _Steps(self.step)
        self.length = np.zeros(self.width, np.int32)
        for b, r in ranks.items():
            self.length[r] = len(b)
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._spines: tuple[dict, dict] = {}, {}
        self._fit: dict[int, bool] = {}
        #: The pairs asked for lately, each in one place by its hash: 2 * pair + whether it fits.
        self._recent = np.full(1 << 18, -1, np.int64)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes."""
        if token not in self._parts:
            b = self.bytes_of[token]
            p = [b[i : i + 1] for i in range(len(b))]
            while len(p) > 2:
                low = min(range(len(p) - 1), key=lambda i: self.ranks.get(p[i] + p[i + 1], _NEVER))
                p[low : low + 2] = [p[low] + p[low + 1]]
            self._parts[token] = (self.ranks[p[0]], self.ranks[p[1]]) if len(p) == 2 else None
        return self._parts[token]

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end of this token while it is merged, each with the rank
        at which the next merge takes it."""
        out = self._spines[side].get(token)
        if out is None:
            out = [(token, _NEVER)]
            while (p := self.parts(out[-1][0])) is not None:
                out.append((p[side], out[-1][0]))
            self._spines[side][token] = out
        return out

    def fits(self, left: int, right: int) -> bool:
        key = left * self.width + right
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) > 1 << 18:
                self._fit.clear()
            known = self._fit[key] = self._fits(left, right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        ranks, bytes_of, ends = self.ranks, self.bytes_of, self._spine(right, 0)
        for a, a_until in self._spine(left, 1):
            for b, b_until in ends:
                # They stand side by side for a while; on equal ranks the left merge goes first.
                if a <= b_until and b < a_until:
                    m = ranks.get(bytes_of[a] + bytes_of[b], _NEVER)
                    if m < a_until and m <= b_until and m != _NEVER:
                        return False
        return True

    def fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """fits for arrays of tokens."""
        pair = left.astype(np.int64) * self.width + right
        place = ((pair.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).view(np.int64)
        held = self._recent[place]
        new = np.flatnonzero(held >> 1 != pair)
        if len(new):
            asked, back = np.unique(pair[new], return_inverse=True)
            ok = np.fromiter((self.fits(*divmod(k, self.width)) for k in asked.tolist()), bool, len(asked))
            held[new] = pair[new] * 2 + ok[back]
            self._recent[place[new]] = held[new]
        return (held & 1).astype(bool)

    def fill(self, piece: bytes, last: list[int]) -> None:
        """Extend last, which holds the last token of each prefix so far, over the whole piece."""
        step, token, fits = self.step.get, self.token.item, self.fits
        for j in range(len(last), len(piece)):
            node, i, ends = step(piece[j]), j, []
            while node:
                if (t := token(node)) >= 0:
                    ends.append((t, i))
                i -= 1
                node = step(node << 8 | piece[i]) if i >= 0 else None
            # The longest first.
            for t, i in reversed(ends):
                if not i or fits(last[i - 1], t):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")

    def fill_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of all these pieces, the longest first, one behind the other, and where each
        starts. Position by position for all pieces together; the few that are longer than the others are
        then filled on one by one."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        start = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.empty(len(data), np.int32)
        together = int(sizes[FEW - 1]) if len(pieces) >= FEW else 0
        running = len(pieces)
        for j in range(together):
            while sizes[running - 1] <= j:
                running -= 1
            here = start[:running] + j
            rows, node, ends = here, np.zeros(running, np.int32), []
            for n in range(1, j + 2):
                node = self._steps.take(node, data[rows - (n - 1)])
                on = node > 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                t = self.token[node]
                found = t >= 0
                ends.append((n, rows[found], t[found]))
            last[here] = -1
            for n, rows, t in reversed(ends):
                left = last[rows] < 0
                rows, t = rows[left], t[left]
                if n <= j and len(rows):
                    ok = self.fit(last[rows - n], t)
                    rows, t = rows[ok], t[ok]
                last[rows] = t
            if last[here].min() < 0:
                raise ValueError("the vocabulary lacks a single byte")
        for i in range(int(np.searchsorted(-sizes, -together))):
            table = last[start[i] : start[i] + together].tolist()
            self.fill(pieces[i], table)
            last[start[i] : start[i + 1]] = table
        return last, start

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of these pieces as little-endian unsigned 32-bit integers."""
        out = [self.ranks[p].to_bytes(4, "little") if p in self.ranks else b"" for p in pieces]
        order = sorted((i for i, x in enumerate(out) if not x), key=lambda i: -len(pieces[i]))
        last, start = self.fill_many([pieces[i] for i in order])
        # Which prefixes end where a token ends, found from the ends of the pieces.
        ends, at = np.zeros(len(last) + 1, bool), start[1:][np.diff(start) > 0]
        first = np.zeros(len(last) + 1, bool)
        first[start] = True
        while len(at):
            ends[at] = True
            at = at - self.length[last[at - 1]]
            at = at[~first[at]]
        ids = last[ends[1:]].astype("<u4").tobytes()
        bounds = (4 * np.concatenate([[0], np.cumsum(ends[1:])])[start]).tolist()
        for k, i in enumerate(order):
            out[i] = ids[bounds[k] : bounds[k + 1]]
        return out

    def read_off(self, last: list[int]) -> list[int]:
        out, j = [], len(last)
        while j:
            out.append(last[j - 1])
            j -= len(self.bytes_of[out[-1]])
        return out[::-1]


class PrefixTable:
    """One piece with its table of last tokens, for appends and edits."""

    def __init__(self, bpe: PrefixBpe, piece: bytes = b""):
        self.bpe, self.piece, self.last = bpe, b"", []
        self.append(piece)

    def append(self, data: bytes) -> None:
        self.piece += data
        self.bpe.fill(self.piece, self.last)

    def replace(self, start: int, end: int, data: bytes) -> None:
        """Put data in place of piece[start:end]; prefixes up to start stay as they are."""
        self.piece = self.piece[:start] + data + self.piece[end:]
        del self.last[start:]
        self.bpe.fill(self.piece, self.last)

    def tokens(self) -> list[int]:
        return self.bpe.read_off(self.last)


class PieceIds(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers. A Python worker keeps it from task to
    task; it is cleared when it is full."""

    limit = 1 << 17

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe = bpe

    def learn(self, pieces: set[str]) -> None:
        """Encode those of these pieces that are not known yet."""
        new = [p for p in pieces if p not in self]
        if len(self) + len(new) > self.limit:
            self.clear()
            new = list(pieces)
        self.update(zip(new, self.bpe.encode_many([p.encode() for p in new]), strict=True))


_LOADED: dict[bytes, PieceIds] = {}


def _loaded(data: bytes) -> PieceIds:
    """The vocabulary of a rank file, read once by each Python worker, with the pieces encoded so far."""
    if data not in _LOADED:
        _LOADED.clear()
        _LOADED[data] = PieceIds(PrefixBpe(read_ranks(data)))
    return _LOADED[data]


def _slices(b: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about so many bytes of text, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < b.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield b.slice(at, to - at)
        at = to


def _encoder(ranks: bytes, pattern: str, decode: bool, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, find = _loaded(ranks), piece_pattern(pattern).findall
        token = ids.bpe.bytes_of.__getitem__
        for batch in batches:
            for b in _slices(batch):
                split = [find(t.as_py() or "") for t in b.column(1)]
                ids.learn(set().union(*split))
                coded = [b"".join(map(ids.__getitem__, pieces)) for pieces in split]
                cols = [b.column(0), pa.array(coded, pa.binary())]
                if decode:
                    cols.append(pa.array([b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in coded], pa.binary()))
                if keep_text:
                    cols.append(b.column(1))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", *["decoded"] * decode, *["text"] * keep_text])

    return run


def _decoder(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _loaded(ranks).bpe.bytes_of.__getitem__
        for batch in batches:
            for b in _slices(batch):
                decoded = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decoded, pa.binary())], names=["doc_id", "decoded"])

    return run


def load_ranks(path: str) -> bytes:
    """A rank file, read on the driver; tasks get its bytes (under a megabyte for 50,000 tokens)."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks: bytes, pattern: str, decode: bool = False, keep_text: bool = False) -> DataFrame:
    """A row (doc_id, ids[, decoded][, text]) for each row of docs(doc_id, text, ...).

    ids is a binary column: the token ids of the whole text as little-endian unsigned 32-bit
    integers, each match of pattern encoded separately, without special tokens. decoded (with
    decode=True) is what these ids decode to, as bytes. A null or empty text has no ids and
    decodes to no bytes. Repeated rows give repeated results, further columns are ignored, an empty
    table gives no rows. Nothing is shuffled; a task holds one small slice of its rows."""
    schema = "doc_id long, ids binary" + (", decoded binary" if decode else "") + (", text string" if keep_text else "")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(released(_encoder(ranks, pattern, decode, keep_text)), schema)


def decode(coded: DataFrame, ranks: bytes) -> DataFrame:
    """A row (doc_id, decoded) for each row of coded(doc_id, ids, ...); null ids decode to null."""
    return coded.select("doc_id", "ids").mapInArrow(released(_decoder(ranks)), "doc_id long, decoded binary")
