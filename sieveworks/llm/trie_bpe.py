"""Byte-level BPE with a list of merges, by a depth-first walk over the trie of distinct words.

A tokenizer file of the tokenizers library names its merges as pairs, lowest rank first. For every
prefix of a word exactly one token can stand last in the prefix's encoding (see ``bpe``); which one
depends on the prefix alone, so words that begin alike share it. The distinct words of a slice of the
documents are put into a trie, and its nodes are visited depth first. A node's state is two numbers: the last
token of its prefix, and the state of an automaton (Aho and Corasick) over the vocabulary that knows
which tokens the prefix ends with. Both follow from the states on the path above, which is all that the walk
holds. At the end of a word its encoding is read off the path from the back.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import released
from .bpe import PieceIds, _slices, piece_pattern

#: Fixed value: the splitting pattern of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 62
#: Pairs of tokens, and steps of the automaton that are not in the vocabulary's own trie, that are remembered.
REMEMBERED = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes for themselves, the
    others in order for the code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordTrie:
    """Distinct words as a trie whose nodes are numbered in preorder of a depth-first walk: sorted, a word's
    new nodes are the bytes behind what it shares with the word before."""

    def __init__(self, words: list[bytes]):
        self.order = sorted(range(len(words)), key=words.__getitem__)
        self.words = words

    def walk(self) -> Iterator[tuple[int, bytes, int]]:
        """(index, word, depth) in depth-first order: the path of the word before stays down to this depth,
        and the nodes of the word's bytes from there on are new."""
        before = b""
        for i in self.order:
            word = self.words[i]
            depth, end = 0, min(len(word), len(before))
            while depth < end and word[depth] == before[depth]:
                depth += 1
            yield i, word, depth
            before = word


class MergeBpe:
    """One vocabulary with its merges, its automaton, and what is known about pairs of tokens."""

    def __init__(self, config: dict):
        model, letters = config["model"], byte_letters()
        pre, post = config.get("pre_tokenizer") or {}, config.get("decoder") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        byte_level = pre.get("type") == post.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if odd or model.get("type") != "BPE" or not byte_level or config.get("normalizer"):
            raise ValueError(f"no plain byte-level BPE: {odd or config.get('normalizer') or pre or model.get('type')}")
        added = config.get("added_tokens", [])
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added) or len({t.get("normalized") for t in added}) > 1:
            raise ValueError("added tokens that look at their surroundings")
        vocab = model["vocab"]
        self.added = {t["content"]: t["id"] for t in added}
        self.width = max([*vocab.values(), *self.added.values()], default=0) + 1
        self.bytes_of = [b""] * self.width
        for text, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in text) if all(c in letters for c in text) else text.encode()
        for text, i in self.added.items():
            self.bytes_of[i] = text.encode()
        #: The rank of the merge that makes a token, -1 for single bytes; and the two that it merges.
        self.rank = [-1] * self.width
        self.parts: list[tuple[int, int] | None] = [None] * self.width
        self.merge: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            if self.parts[made] is not None or max(self.rank[a], self.rank[b]) >= rank or any(len(self.bytes_of[x]) > 1 and self.parts[x] is None for x in (a, b)):
                raise ValueError(f"merge {rank} makes a token again, or before its parts")
            self.rank[made], self.parts[made] = rank, (a, b)
            self.merge[a * self.width + b] = rank
        self._spines: tuple[dict, dict] = {}, {}
        self._fit: dict[int, bool] = {}
        self.single = {self.bytes_of[i][0]: i for t, i in vocab.items() if len(self.bytes_of[i]) == 1 and len(t) == 1}
        self._automaton()

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of this token while it is merged, below itself, each with the rank at
        which the next merge takes it."""
        out = self._spines[side].get(token)
        if out is None:
            out, t = [], token
            while (p := self.parts[t]) is not None:
                out.append((p[side], self.rank[t]))
                t = p[side]
            self._spines[side][token] = out
        return out

    def _apart(self, left: int, right: int, until: int = _NEVER) -> bool:
        """Whether, up to this rank, no merge joins a piece across the boundary of two tokens that stand
        side by side."""
        rank, merge, width = self.rank, self.merge, self.width
        ends = [(right, until), *self._spine(right, 0)]
        for a, a_until in ((left, until), *self._spine(left, 1)):
            for b, b_until in ends:
                # They stand side by side for a while; on equal ranks the left merge goes first.
                if rank[a] <= b_until and rank[b] < a_until:
                    m = merge.get(a * width + b, _NEVER)
                    if m < a_until and m <= b_until:
                        return False
        return True

    def fits(self, left: int, right: int) -> bool:
        key = left * self.width + right
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) >= REMEMBERED:
                self._fit.clear()
            known = self._fit[key] = self._apart(left, right)
        return known

    def _automaton(self) -> None:
        """The automaton over all tokens that their own bytes encode to: for each state the tokens that a
        text in it ends with, the longest first, each with its length."""
        whole = [False] * self.width
        for t in self.single.values():
            whole[t] = True
        made = sorted((t for t in range(self.width) if self.parts[t]), key=self.rank.__getitem__)
        for t in made:
            a, b = self.parts[t]
            whole[t] = whole[a] and whole[b] and self._apart(a, b, self.rank[t])
        self.step: dict[int, int] = {}
        token = [-1]
        for t in (*self.single.values(), *made):
            if whole[t]:
                at = 0
                for byte in self.bytes_of[t]:
                    at = self.step.setdefault(at << 8 | byte, len(token))
                    if at == len(token):
                        token.append(-1)
                token[at] = t
        below: list[list[tuple[int, int]]] = [[] for _ in token]
        for key, to in self.step.items():
            below[key >> 8].append((key & 255, to))
        self.fail = [0] * len(token)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(token)
        todo = deque([0])
        while todo:
            s = todo.popleft()
            for byte, to in below[s]:
                f = self.fail[s]
                while f and f << 8 | byte not in self.step:
                    f = self.fail[f]
                self.fail[to] = self.step.get(f << 8 | byte, 0) if s else 0
                own = ((token[to], len(self.bytes_of[token[to]])),) if token[to] >= 0 else ()
                self.ends[to] = own + self.ends[self.fail[to]]
                todo.append(to)
        self._jumps: dict[int, int] = {}

    def _jump(self, key: int) -> int:
        """The state behind a step that the vocabulary's trie does not have."""
        to = self._jumps.get(key)
        if to is None:
            s, byte = self.fail[key >> 8] if key >> 8 else -1, key & 255
            while s > 0 and s << 8 | byte not in self.step:
                s = self.fail[s]
            if len(self._jumps) >= REMEMBERED:
                self._jumps.clear()
            to = self._jumps[key] = self.step.get(s << 8 | byte, 0) if s >= 0 else 0
        return to

    def encode_many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these words as little-endian unsigned 32-bit integers; each prefix that
        words share is worked out once."""
        out = [b""] * len(words)
        #: The path's states and last tokens; its length is the depth of the node.
        states, last, lengths = [0], [], []
        step, ends, fit, width = self.step.get, self.ends, self._fit.get, self.width
        for i, word, depth in WordTrie(words).walk():
            del states[depth + 1 :], last[depth:], lengths[depth:]
            state = states[-1]
            for j in range(depth, len(word)):
                key = state << 8 | word[j]
                state = step(key)
                if state is None:
                    state = self._jump(key)
                for token, n in ends[state]:
                    if n > j:
                        break
                    before = last[j - n]
                    known = fit(before * width + token)
                    if known if known is not None else self.fits(before, token):
                        break
                else:
                    raise ValueError("the vocabulary lacks a single byte")
                states.append(state)
                last.append(token)
                lengths.append(n)
            j, ids = len(word), []
            while j:
                ids.append(last[j - 1])
                j -= lengths[j - 1]
            ids.reverse()
            out[i] = np.array(ids, "<u4").tobytes() if len(ids) > 8 else b"".join([t.to_bytes(4, "little") for t in ids])
        return out


class _Coder:
    """A tokenizer file, read once by each Python worker, with the words encoded so far."""

    def __init__(self, data: bytes):
        config = json.loads(data)
        self.bpe = MergeBpe(config)
        self.words = PieceIds(self.bpe)
        self.find = piece_pattern(PATTERN).findall
        self.added = {t: i.to_bytes(4, "little") for t, i in self.bpe.added.items()}
        # Of added tokens at one place the longest; a group, so that split() gives them back.
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def encode(self, texts: list[str]) -> list[bytes]:
        split: list[list[list[str] | bytes]] = []
        for t in texts:
            if self.cut and any(a in t for a in self.added):
                split.append([self.added[x] if i % 2 else self.find(x) for i, x in enumerate(self.cut(t))])
            else:
                split.append([self.find(t)])
        self.words.learn({w for parts in split for p in parts if isinstance(p, list) for w in p})
        ids = self.words.__getitem__
        return [b"".join([p if isinstance(p, bytes) else b"".join(map(ids, p)) for p in parts]) for parts in split]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bpe.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_CODERS: dict[bytes, _Coder] = {}


def coder(data: bytes) -> _Coder:
    if data not in _CODERS:
        _CODERS.clear()
        _CODERS[data] = _Coder(data)
    return _CODERS[data]


def _encoder(data: bytes, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(data)
        for batch in batches:
            for b in _slices(batch):
                coded = c.encode([t.as_py() or "" for t in b.column(1)])
                cols, names = [b.column(0), pa.array(coded, pa.binary())], ["doc_id", "ids"]
                if with_text:
                    cols, names = [*cols, pa.array([c.decode(x) for x in coded], pa.string())], [*names, "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _decoder(data: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(data)
        for batch in batches:
            for b in _slices(batch):
                decoded = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(decoded, pa.string())], names=["doc_id", "decoded"])

    return run


def load(path: str) -> bytes:
    """A tokenizer file, read on the driver; tasks get its bytes."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: bytes, decode: bool = False) -> DataFrame:
    """A row (doc_id, ids[, decoded]) for each row of docs(doc_id, text, ...).

    ids is a binary column: the token ids that the tokenizers library gives for the whole text with
    add_special_tokens=False, as little-endian unsigned 32-bit integers; strings of added tokens inside a text
    are those tokens, as is its default. decoded (with decode=True) is the text that the ids stand for,
    added tokens included. A null or empty text has no ids and decodes to the empty text. Repeated rows
    give repeated results, further columns are ignored, an empty table gives no rows. Nothing is shuffled:
    a task builds one trie for the new words of each slice of about a megabyte, and a worker keeps the
    encodings of so many words (``PieceIds.limit``) from slice to slice."""
    schema = "doc_id long, ids binary" + (", decoded string" if decode else "")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(released(_encoder(tokenizer, decode)), schema)


def decode(coded: DataFrame, tokenizer: bytes) -> DataFrame:
    """A row (doc_id, decoded) for each row of coded(doc_id, ids, ...); null ids decode to null."""
    return coded.select("doc_id", "ids").mapInArrow(released(_decoder(tokenizer)), "doc_id long, decoded string")
