"""Language-model scoring by deleted interpolation.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1): maximum-likelihood estimates of
two orders and a uniform floor. The weights depend on the bucket of c(v), by powers of two, and
are learned by expectation-maximisation on held-out counts: a fifth of the corpus is kept out of
the counts that its own n-grams are predicted with. Final counts hold all training documents.

Plan. Texts are tokenised once, into blocks of documents stored as arrays of token numbers with
the block's own vocabulary. For unigrams, then bigrams, a block sends its distinct n-grams with
its counts, as sorted arrays dealt by hash range; each range adds up the counts and answers every
block in the order of its request. So a frequent word is one entry of a block, never a row for each
occurrence, no task holds more than a hash range or a block, and nothing of the corpus passes
through the driver but N, V and a histogram of fixed size for the weights. The number of ranges grows
with the corpus. The stored blocks are bucketed by block, so that answers join them without moving
them again; what is stored lies in the shared folder and goes when the scores are there, or fail.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import delete_shared, fold, in_runs, materialize, released, shared_path, text_bytes, whole_runs, write_shared
from .shingles import WordDigests, mix, words_of

#: Text bytes of one block; a task holds about ten times as much.
BLOCK_BYTES = 8 << 20
#: Text bytes whose n-grams fall into one hash range, which a task holds one at a time.
RANGE_BYTES = 16 << 20
FOLDS, HELD_OUT, WEIGHTS_FOLD = 5, 1, 0
_END, _START = np.uint64(0x5E7D), np.uint64(0x57A7)
_BLOCK = "block long, vocab binary, doc_id array<long>, fold array<int>, size array<int>, tokens binary"
_ASK = "part int, block long, key binary, main binary, train binary"
_REPLY = "part int, block long, main binary, train binary, n_main long, n long, v long"
#: Histogram steps for each doubling of a ratio of probabilities.
STEPS = 4


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes with equal places together, which compresses better."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unplanes(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digests, seq = WordDigests(), 0
    first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids, folds, words, size, held = [], [], [], [], 0

    def block() -> pa.RecordBatch:
        vocab, tokens = np.unique(np.concatenate(words), return_inverse=True)
        cols = [pa.array([first + seq]), pa.array([_planes(vocab)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([folds], pa.list_(pa.int32())), pa.array([size], pa.list_(pa.int32())), pa.array([_planes(tokens.astype(np.uint32))], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "vocab", "doc_id", "fold", "size", "tokens"])

    for b in batches:
        for doc_id, f, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            w = words_of(text.as_py())
            words.append(np.append(digests.of(w), _END))
            ids.append(doc_id)
            folds.append(f)
            size.append(len(w) + 1)
            held += 9 * len(w) + 64
            if held >= BLOCK_BYTES:
                yield block()
                ids, folds, words, size, held, seq = [], [], [], [], 0, seq + 1
    if ids:
        yield block()


class Block:
    """One stored block: its vocabulary, and for each token its document's part in training."""

    def __init__(self, row: dict):
        self.vocab = _unplanes(row["vocab"], np.uint64)
        self.tokens = _unplanes(row["tokens"], np.uint32).astype(np.int64)
        self.doc_id, self.size = row["doc_id"], np.array(row["size"], np.int64)
        f = np.array([HELD_OUT if x is None else x for x in row["fold"]], np.int64)
        self.held_out = [x == HELD_OUT for x in row["fold"]]
        each = np.repeat(f, self.size)
        self.train = each != HELD_OUT
        self.weigh = each == WEIGHTS_FOLD
        self.starts = np.cumsum(self.size) - self.size

    def unigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct digests, sorted, and for each token which one it is."""
        return self.vocab, self.tokens

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        v = len(self.vocab)
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.starts] = v
        code, each = np.unique(before * (v + 1) + self.tokens, return_inverse=True)
        ext = mix(np.append(self.vocab, _START))
        key = mix(ext[code // (v + 1)] + np.append(self.vocab, _START)[code % (v + 1)] * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        return key[order], place[each]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _ranges(key: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of digests begins and ends in sorted digests."""
    edges = [np.uint64((i << 64) // parts) for i in range(parts)]
    return np.append(np.searchsorted(key, np.array(edges, np.uint64)), len(key))


def _ask(which: Callable[[Block], tuple[np.ndarray, np.ndarray]], parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = Block(row)
            key, each = which(block)
            train = np.bincount(each[block.train], minlength=len(key)).astype(np.uint32)
            main = train - np.bincount(each[block.weigh], minlength=len(key)).astype(np.uint32)
            cut = _ranges(key, parts)
            spans = [(p, lo, hi) for p, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if hi > lo]
            cols = [pa.array([p for p, _, _ in spans], pa.int32()), pa.array([row["block"]] * len(spans), pa.int64())]
            cols += [pa.array([_planes(a[lo:hi]) for _, lo, hi in spans], pa.binary()) for a in (key, main, train)]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "block", "key", "main", "train"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every request of a hash range, the corpus counts in the request's order."""
    for t, at in whole_runs(batches, ["part"], 1):
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            rows = t.slice(s, e - s)
            keys = [_unplanes(x.as_py(), np.uint64) for x in rows.column("key")]
            found, each = np.unique(np.concatenate(keys), return_inverse=True)
            main, train = (np.bincount(each, np.concatenate([_unplanes(x.as_py(), np.uint32) for x in rows.column(c)]), len(found)).astype(np.uint64) for c in ("main", "train"))
            stops = np.cumsum([len(k) for k in keys])
            for i, stop in enumerate(stops.tolist()):
                own = each[stop - len(keys[i]) : stop]
                cols = [rows.column("part")[i : i + 1], rows.column("block")[i : i + 1], [_planes(main[own])], [_planes(train[own])]]
                cols += [[int(x) if not i else 0] for x in (main.sum(), train.sum(), (train > 0).sum())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.to_pylist() if isinstance(c, pa.ChunkedArray) else c, f) for c, f in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    names=["part", "block", "main", "train", "n_main", "n", "v"],
                )


def _asked(blocks: DataFrame, which: Callable, parts: int, stored: list[str]) -> DataFrame:
    asked = blocks.mapInArrow(released(_ask(which, parts)), _ASK)
    out, path = write_shared(in_runs(asked, ["part"], _answer, _REPLY, parts), "counts")
    stored.append(path)
    return out


def _counted(block: Block, replies: pa.Table, order: int, which: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The corpus counts of each token's n-gram, without and with the held-out part."""
    rows = replies.filter(pa.compute.equal(replies.column("order"), order)).sort_by("part")
    _, each = which(block)
    main, train = (np.concatenate([_unplanes(x.as_py(), np.uint64) for x in rows.column(c)]).astype(np.float64) for c in ("main", "train"))
    return main[each], train[each]


def _all_counts(left: pa.Table, right: pa.Table) -> tuple[Block, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """A block and, without and with the held-out part, each token's c(v), c(w) and c(v, w)."""
    import pyarrow.compute  # noqa: F401  makes pa.compute known

    block = Block(left.to_pylist()[0])
    one = _counted(block, right, 1, Block.unigrams)
    two = _counted(block, right, 2, Block.bigrams)
    out = []
    for c1, c2 in zip(one, two, strict=True):
        before = np.empty_like(c1)
        before[1:] = c1[:-1]
        # As many documents start as end; every block has an end.
        before[block.starts] = c1[block.starts[0] + block.size[0] - 1]
        out.append((before, c1, c2))
    return block, out


def _bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.log2(np.maximum(c, 1)).astype(np.int64), -1)


def _ratios(n: float, v: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Counts by bucket and by how much likelier than the floor each order makes a token."""
        block, ((cv, cw, cvw), _) = _all_counts(left, right)
        m = block.weigh
        cv, cw, cvw = cv[m], cw[m], cvw[m]
        step = lambda p: np.where(p > 0, np.rint(STEPS * np.log2(np.maximum(p, 1e-300) * (v + 1))), -9999).astype(np.int64)
        cells = np.stack([_bucket(cv), step(cvw / np.maximum(cv, 1)), step(cw / max(n, 1))], 1)
        found, times = np.unique(cells, axis=0, return_counts=True) if len(cells) else (np.empty((0, 3), np.int64), np.empty(0, np.int64))
        return pa.table({"bucket": found[:, 0], "r2": found[:, 1], "r1": found[:, 2], "times": times.astype(np.int64)})

    return run


def learn_weights(cells: np.ndarray, rounds: int = 60) -> dict[int, np.ndarray]:
    """For each bucket the weights (l2, l1, l0), by expectation-maximisation over rows
    (bucket, r2, r1, times). One pseudo-token for each order keeps every weight above zero."""
    out = {}
    for b in np.unique(cells[:, 0]):
        rows = cells[cells[:, 0] == b].astype(np.float64)
        ratio = np.stack([np.where(rows[:, i] > -9999, 2.0 ** (rows[:, i] / STEPS), 0) for i in (1, 2)] + [np.ones(len(rows))], 1)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            p = ratio * w
            share = (p / p.sum(1, keepdims=True) * rows[:, 3:4]).sum(0) + 1
            w = share / share.sum()
        out[int(b)] = w
    return out


def _scored(n: float, v: float, weights: dict[int, np.ndarray]):
    low = min(weights, default=-1)
    high = max(weights, default=-1)
    span = np.stack([weights.get(b, weights.get(max((x for x in weights if x <= b), default=low), np.full(3, 1 / 3))) for b in range(low, high + 1)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block, (_, (cv, cw, cvw)) = _all_counts(left, right)
        w = span[np.clip(_bucket(cv), low, high) - low]
        # An order that has seen nothing leaves its share to the next lower one.
        p1 = cw / n if n else np.full(len(cw), 1 / (v + 1))
        p2 = np.where(cv > 0, cvw / np.maximum(cv, 1), p1)
        p = w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)
        base = np.log10((cw + 0.5) / (n + 0.5 * (v + 1)))
        sums = [np.add.reduceat(x, block.starts) for x in (np.log10(p), base, (cw > 0).astype(np.int64))]
        return pa.table({"doc_id": pa.array(block.doc_id, pa.int64()), "held_out": block.held_out, "n_tokens": block.size, "n_known": sums[2], "base_score": sums[1], "score": sums[0]})

    return run


def score(docs: DataFrame) -> DataFrame:
    """A row (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of
    docs(doc_id, text, ...): log10 probabilities of the whole text, its tokens being its words (runs of
    bytes other than ASCII white space, A-Z lower-cased) and one end.

    Learned from the documents whose crc32(doc_id as text) mod 5 is not 1; of these, those with
    remainder 0 weigh the orders. base_score is the add-half unigram model's. Null texts count as
    empty: one token, the end. Rows without a doc_id are scored, never learned from, and not held
    out. Repeated rows count and are scored each time. Without training rows every token has
    probability 1 under the base model and 1 / (V + 1) = 1 under the other. Further columns are ignored;
    an empty table gives no rows."""
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold("doc_id", FOLDS).cast("int").alias("fold"), text_bytes().alias("text"))
    # A hash range takes the n-grams of so much text, however large the corpus.
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    name = f"blocks_{uuid.uuid4().hex}"
    path = shared_path(spark, name)
    stored = [path]
    try:
        blocks = read.mapInArrow(released(_blocks), _BLOCK)
        # Bucketed, in the shared folder; only its name stands in the catalog. Spark allows so many buckets;
        # a larger corpus has several blocks in each, which are read one after the other.
        buckets = min(parts, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000")))
        blocks.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
        return _scored_blocks(spark.table(name), parts, stored)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        for p in stored:
            delete_shared(spark, p)


def _scored_blocks(blocks: DataFrame, parts: int, stored: list[str]) -> DataFrame:
    """The scores of the documents in stored blocks; paths of what it stores are added to stored."""
    one = _asked(blocks, Block.unigrams, parts, stored)
    n_main, n, v = (int(x or 0) for x in one.agg(F.sum("n_main"), F.sum("n"), F.sum("v")).first())
    two = _asked(blocks, Block.bigrams, parts, stored)
    replies = one.select("block", "part", "main", "train", F.lit(1).alias("order"))
    replies = replies.union(two.select("block", "part", "main", "train", F.lit(2).alias("order")))

    def by_block(fn: Callable, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(fn, schema)

    cells = by_block(_ratios(n_main, v), "bucket long, r2 long, r1 long, times long")
    cells = cells.groupBy("bucket", "r2", "r1").agg(F.sum("times").alias("times")).collect()
    weights = learn_weights(np.array([tuple(r) for r in cells], np.int64).reshape(-1, 4))
    out = by_block(_scored(n, v, weights or {-1: np.full(3, 1 / 3)}), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return materialize(out.withColumn("train_tokens", F.lit(n).cast("long")))
