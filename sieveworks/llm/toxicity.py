"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted over the letters of all documents, into tables of a
   fixed size, so that it can be sent to every task whatever the corpus.
2. A token that looks disguised (symbols or digits among letters, letters repeated three times
   or more, letters spaced out) becomes a lattice: every character may be itself, a letter it
   stands for, or noise, runs may shrink to one or two, and words may be cut where separators
   stood. The Viterbi path under the character model, with a cost for each kind of disguise, is
   the restored text. Other tokens have one path: themselves without outer punctuation.
3. Restored words and their first four to six letters are the evidence. Each one's weight is
   its log odds of standing in toxic documents, learned from a bounded sample of labelled rows.
   The heaviest piece of evidence of a document and the next two give the score by a logistic
   curve, fitted on weights that leave the document's own label out.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, released

#: Labelled rows that the classifier is fitted on, at most: those with the least hash of doc_id.
SAMPLE_ROWS = 12_000
#: The least toxic documents that a piece of evidence stands in, and its least weight.
SUPPORT, LEAST_WEIGHT = 3, 2.0
TRI, BI = 1 << 18, 1 << 14
_BOUND = 0

# The letters that digits and symbols stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
#: Costs, in natural logarithms: a letter disguised; a character dropped that looks like a letter, that
#: may stand for one, or that is plain noise; a run shrunk; a cut.
DISGUISED, DROPPED, SHRUNK, CUT = 0.7, {"@$€£": 12.0, "!|+(<¡*": 1.2, "": 0.3}, 0.5, 3.0

_KEPT = re.compile(r"[\w@$€£]")
_EDGE = re.compile(r"(?<!\S)[!|+(<¡*]{1,2} | [!|+(<¡*]{1,2}(?!\S)")
_ODD = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
#: Letters (or what stands for them) and separators have no character in common, so that a chain of them
#: can be read in one way only and is found in one pass.
_LETTER = r"[^\W_]|[@$!|+]"
_CHAIN = re.compile(rf"(?:{_LETTER})(?:[ ._*\-]{{1,2}}+(?:{_LETTER})){{2,}}+")
_LINK = re.compile(_LETTER)
_APART = frozenset(".,;:!?")


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, with everything that is no letter as a boundary."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[c], c, _BOUND)


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))
    return _LETTERS[0]


def _bi(a, b):
    return (a * 31 + b * 131 + (a >> 5)) % BI


def _tri(a, b, c):
    return (a * 524287 + b * 8191 + c * 131 + (c >> 6)) % TRI


def _chunks(column: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of a column in lists of about so many characters."""
    held, n = [], 0
    for t in column:
        held.append(t.as_py() or "")
        n += len(held[-1])
        if n >= chars:
            yield held
            held, n = [], 0
    if held:
        yield held


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, slot, n) of one task: how often each slot of the tables was hit."""
    tri, bi = np.zeros(TRI, np.int64), np.zeros(BI, np.int64)
    for b in batches:
        for texts in _chunks(b.column(0)):
            # Texts parted by boundaries count as they do one by one.
            c = _codes(f"  {'  '.join(texts)} ").astype(np.int64)
            for i in range(0, len(c) - 2, 1 << 20):
                x, y, z = c[i : i + (1 << 20)], c[i + 1 : i + (1 << 20) + 1], c[i + 2 : i + (1 << 20) + 2]
                x, y = x[: len(z)], y[: len(z)]
                real = (y != _BOUND) | (z != _BOUND)
                # What stands before a boundary does not matter for the word after it.
                x = np.where(y == _BOUND, _BOUND, x)[real]
                y, z = y[real], z[real]
                tri += np.bincount(_tri(x, y, z), minlength=TRI)
                bi += np.bincount(_bi(x, y), minlength=BI)
    for kind, n in ((3, tri), (2, bi)):
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(n[at])], names=["kind", "slot", "n"])


class CharModel:
    """log P(c | a, b) from the two tables."""

    def __init__(self, tri: np.ndarray, bi: np.ndarray):
        self.tri, self.bi = tri.astype(np.float32), bi.astype(np.float32)
        self.known: dict[tuple[int, int, int], float] = {}

    def log(self, a: int, b: int, c: int) -> float:
        v = self.known.get((a, b, c))
        if v is None:
            if len(self.known) >= TRI:
                self.known.clear()
            v = self.known[a, b, c] = math.log((self.tri[_tri(a, b, c)] + 0.1) / (self.bi[_bi(a, b)] + 6.0))
        return v


def char_model(docs: DataFrame) -> CharModel:
    """Counted over all documents; a task sends at most TRI + BI rows, and so do all together."""
    counted = docs.select(F.col("text").cast("string")).mapInArrow(released(_char_counts), "kind int, slot int, n long")
    tables = {3: np.zeros(TRI, np.int64), 2: np.zeros(BI, np.int64)}
    for r in counted.groupBy("kind", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        tables[r.kind][r.slot] = r.n
    return CharModel(tables[3], tables[2])


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of equal characters what it can be, each with its cost; "" is nothing, " " a cut."""
    out = []
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, n = m[1], len(m[0])
        if c.isalpha():
            options = [(c, 0.0 if n == 1 else SHRUNK)]
            if n == 2:
                options.append((c + c, 0.0))
            elif n > 2:
                options.append((c + c, SHRUNK))
        else:
            options = [(x, DISGUISED + SHRUNK * (n > 1)) for x in STANDS_FOR.get(c, "")]
            options += [(x + x, DISGUISED) for x in STANDS_FOR.get(c, "") if n > 1]
            kind = "@$€£" if c.isdigit() else next(k for k in DROPPED if c in k or not k)
            options += [("", DROPPED[kind]), (" ", CUT + 2.5 * (kind == "@$€£"))]
        out.append(options)
    return out


def restore(token: str, model: CharModel) -> str:
    """The most likely plain text behind a lower-cased token; words are parted by one space. The states of
    the Viterbi decoding are the last two characters, so that there are no more of them at a place than
    pairs of letters that the token's characters can be; none is pruned. A state points back to the one
    before it, so that time and memory are linear in the token."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(_BOUND, _BOUND): (0.0, None)}
    for options in [*lattice(token), [(" ", 0.0)]]:
        nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for put, cost in options:
                s, x, y = score - cost, a, b
                for ch in put:
                    z = _BOUND if ch == " " else ord(ch)
                    if z or y:
                        s += model.log(x, y, z)
                    x, y = (_BOUND, _BOUND) if not z else (y, z)
                if (x, y) not in nxt or s > nxt[x, y][0]:
                    nxt[x, y] = (s, (path, put))
        states = nxt
    # The last place ends in a boundary, so that one state is left.
    (_, path), puts = states[_BOUND, _BOUND], []
    while path is not None:
        path, put = path
        puts.append(put)
    return " ".join("".join(reversed(puts)).split())


def _core(token: str) -> str:
    """The token without outer punctuation."""
    first = _KEPT.search(token)
    return token[first.start() : len(token) - _KEPT.search(token[::-1]).start()] if first else ""


def disguised(token: str) -> bool:
    """Letters with something else among them, or a letter three times running."""
    return bool((_RUN if token.isalpha() else _ODD).search(token))


def plain(token: str, model: CharModel) -> tuple[str, ...]:
    """The words of a lower-cased token, restored if it looks disguised. Symbols around it that may stand
    for letters are punctuation in one reading and part of the lattice in another."""
    core = token if token.isalpha() else _core(token)
    out = tuple(restore(core, model).split()) if disguised(core) else (core,) if core else ()
    if core != token and core and _EDGE.search(token.replace(core, " ", 1)):
        out = tuple(dict.fromkeys((*out, *restore(token, model).split())))
    return out


class Restorer(dict):
    """token -> its restored words, for the tokens seen lately."""

    limit = 1 << 17

    def __init__(self, model: CharModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) >= self.limit:
            self.clear()
        words = self[token] = plain(token, self.model)
        return words

    def words(self, text: str) -> set[str]:
        """The distinct restored words of a whole text, spaced-out words included."""
        low = text.lower()
        out: set[str] = set(self.spaced(low))
        for token in set(low.split()):
            out.update(self[token])
        return out

    def spaced(self, low: str) -> list[str]:
        """The restored words of the letters that stand spaced out in a lower-cased text."""
        closed = (re.sub(r"(?<=\S)[ ._*\-](?=\S)", "", chain) for chain in spaced_chains(low))
        return [w for token in closed for w in restore(token, self.model).split()]


def spaced_chains(low: str) -> Iterator[str]:
    """Three letters or more that are parted by one or two separators each: of each such chain, from its
    first letter that has space or punctuation before it to its last that has it behind."""
    apart = lambda i: i < 0 or i >= len(low) or low[i].isspace() or low[i] in _APART
    for m in _CHAIN.finditer(low):
        at = [x.start() for x in _LINK.finditer(low, *m.span())]
        first = next((k for k, i in enumerate(at) if apart(i - 1)), len(at))
        last = next((k for k in range(len(at) - 1, -1, -1) if apart(at[k] + 1)), -1)
        if last - first >= 2:
            yield low[at[first] : at[last] + 1]


def evidence(word: str) -> Iterator[str]:
    yield word
    for n in (4, 5, 6):
        if len(word) >= n:
            yield word[:n] + "-"


def _feature_counts(model: CharModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model)
        for b in batches:
            n: dict[str, list[int]] = {}
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist(), strict=True):
                for f in {f for w in restorer.words(text.as_py() or "") for f in evidence(w)}:
                    n.setdefault(f, [0, 0])[1 - toxic] += 1
            t = pa.array([v[0] for v in n.values()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.string()), t, pa.array([v[1] for v in n.values()], pa.int64())], names=["f", "t", "c"])

    return run


class ToxicityModel:
    """The character model, the evidence with its counts, and the logistic curve."""

    def __init__(self, chars: CharModel, counts: dict[str, tuple[int, int]], toxic: int, clean: int):
        self.chars, self.counts, self.toxic, self.clean = chars, counts, toxic, clean
        self.slopes, self.offset = (1.0, 0.0), -4.0
        self.weights = {f: w for f in counts if (w := self.weight(f)) >= LEAST_WEIGHT}
        self.starts = {f[:4] for f in self.weights}

    def weight(self, f: str, label: int | None = None) -> float:
        """The log odds of a piece of evidence; with a label, as if one such row were left out."""
        t, c = self.counts[f]
        t, c, big_t, big_c = t - (label == 1), c - (label == 0), self.toxic - (label == 1), self.clean - (label == 0)
        return math.log((t + 0.5) / (big_t + 1)) - math.log((c + 0.5) / (big_c + 1)) - 1 / (t + 0.5)

    def found(self, words: set[str], label: int | None = None) -> list[tuple[float, str]]:
        """The pieces of evidence in these words, the heaviest first, one for each word."""
        return sorted(self.pieces(words, label), reverse=True)

    def pieces(self, words: Iterable[str], label: int | None = None) -> set[tuple[float, str]]:
        """The heaviest piece of evidence of each word that has one above zero."""
        best = set()
        for w in words:
            if w[:4] not in self.starts:
                continue
            held = [(self.weights[f] if label is None else self.weight(f, label), f) for f in evidence(w) if f in self.weights]
            if held and max(held)[0] > 0:
                best.add(max(held))
        return best

    @staticmethod
    def inputs(found: list[tuple[float, str]]) -> tuple[float, float]:
        """What the curve sees: the heaviest weight, and the next two together."""
        return (found[0][0] if found else 0.0, sum(v for v, _ in found[1:3]))

    def fit(self, inputs: np.ndarray, labels: np.ndarray) -> None:
        """A logistic curve over the inputs, by Newton steps with a slight ridge."""
        x = np.column_stack([inputs, np.ones(len(inputs))])
        w = np.array([0.5, 0.0, -3.0])
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (labels - p) - 0.05 * w
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            step = np.linalg.solve(h, g)
            w = w + np.clip(step, -1, 1)
            if abs(step).max() < 1e-6:
                break
        self.slopes, self.offset = (float(max(w[0], 0.05)), float(max(w[1], 0.0))), float(w[2])

    def score(self, found: list[tuple[float, str]]) -> float:
        z = self.offset + sum(a * b for a, b in zip(self.slopes, self.inputs(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _loo_inputs(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.chars)
        for b in batches:
            labels = b.column("toxic").to_pylist()
            x = [model.inputs(model.found(restorer.words(t.as_py() or ""), y)) for t, y in zip(b.column("text"), labels, strict=True)]
            cols = [pa.array([v[i] for v in x], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(labels, pa.int32())], names=["x1", "x2", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> ToxicityModel:
    """A model for docs(doc_id, text, ...) from labels(doc_id, toxic, ...). The character model is
    counted over all documents; the evidence comes from at most SAMPLE_ROWS labelled rows for which
    `usable`, a condition on doc_id, holds. Rows without a doc_id or label are left out, a doc_id
    labelled twice counts as toxic if either label says so. Without labels nothing is evidence."""
    chars = char_model(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About twice as many as needed, by their hash, so that only these are sorted and sent.
    share = max(1, known.count() // (2 * SAMPLE_ROWS))
    sample = known.where(F.pmod(F.xxhash64(F.lit(4), F.col("doc_id")), F.lit(share)) == 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bounded: SAMPLE_ROWS rows of two numbers.
    rows = materialize(texts.join(F.broadcast(sample), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic")).repartition(24))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    counted = rows.mapInArrow(released(_feature_counts(chars)), "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    # What the sample's whole texts hold bounds the evidence; what can have no weight stays where it is.
    big_t, big_c = n.get(1, 0), n.get(0, 0)
    t, c = F.col("t"), F.col("c")
    weight = F.log((t + 0.5) / (big_t + 1)) - F.log((c + 0.5) / (big_c + 1)) - 1 / (t + 0.5)
    kept = counted.where((t >= SUPPORT) & (t > c) & (weight >= LEAST_WEIGHT - 1e-6))
    model = ToxicityModel(chars, {r.f: (r.t, r.c) for r in kept.collect()}, big_t, big_c)
    seen = rows.mapInArrow(released(_loo_inputs(model)), "x1 double, x2 double, toxic int").collect()
    if n.get(1) and n.get(0):
        model.fit(np.array([(r.x1, r.x2) for r in seen]), np.array([r.toxic for r in seen], float))
    return model


class Pieces(dict):
    """token -> the pieces of evidence in its restored words, for the tokens seen lately."""

    limit = 1 << 17

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model, self.restorer = model, Restorer(model.chars)

    def __missing__(self, token: str) -> set[tuple[float, str]]:
        if len(self) >= self.limit:
            self.clear()
        v = self[token] = self.model.pieces(plain(token, self.model.chars)) or _NOTHING
        return v

    def found(self, text: str) -> list[tuple[float, str]]:
        """What ToxicityModel.found gives for the words of a whole text."""
        low = text.lower()
        out = self.model.pieces(self.restorer.spaced(low))
        return sorted(out.union(*map(self.__getitem__, set(low.split()))), reverse=True)


_NOTHING: frozenset = frozenset()


def _scores(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(model)
        for b in batches:
            found = [pieces.found(t.as_py() or "") for t in b.column(1)]
            scores = pa.array([model.score(f) for f in found], pa.float64())
            hits = pa.array([[f for _, f in x[:3]] for x in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), scores, hits], names=["doc_id", "score", "hits"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """A row (doc_id, score, hits) for each row of docs(doc_id, text, ...): the score of the whole
    text, and the heaviest pieces of evidence in its restored words (a trailing - marks the start of
    a word). Null and empty texts have the score of no evidence. Repeated rows give repeated results,
    further columns are ignored, an empty table gives no rows."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(released(_scores(model)), "doc_id long, score double, hits array<string>")
