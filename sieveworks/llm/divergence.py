"""Audit of how sources of a language differ in their words, by two-dimensional group-block tiling.

Terms are counted by language and source; each language keeps the terms that stand in enough of its
documents. Smoothed shares of the kept terms, as whole numbers, are compared by the triangular divergence
f(p, q) = floor((p - q)^2 / (p + q)). The kept terms of a language are dealt into vocabulary chunks, and its
sources into blocks. A source's counts in a chunk are one packed vector. The vectors of every two blocks meet in
a tile: its task goes through the chunks one after the other and adds up the submatrix of the pairs. Only terms
that some source of the tile has are looked at; all others add the same to a pair, which is known
beforehand. Long vocabularies are cut into spans of chunks, so that tiles of few sources are many tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import join_checked, materialize, released, spread_blocks, whole_runs

#: Documents of a language that a kept term stands in, at least; ranks of terms that are reported.
LEAST_DOCUMENTS, TOP_TERMS = 10, 10
#: Sources of a block, terms of a vocabulary chunk, chunks of a span, on average.
BLOCK, CHUNK, SPAN = 32, 4096, 16
#: Counts that a task holds before it sends them on.
HELD = 1 << 19
#: Shares are out of so many; a product with it is formed in three steps of BASE, as it passes 64 bits.
SCALE, BASE = 10**9, 1000

# Terms are runs of letters: ASCII letters and all that is beyond ASCII. On UTF-8, lower-cased byte by byte.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
COUNTS = "lang string, source string, term binary, n long, docs long"


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs) of one task's documents, several times for a term where it holds
    more than HELD counts."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def send() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            names = [pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(terms), np.int32)), pa.array([x])).dictionary_decode() for x in (lang, source)]
            counts = [pa.array(np.fromiter(map(c.__getitem__, terms), np.int64, len(terms))) for c in (n, docs)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(terms, pa.binary()), *counts], names=["lang", "source", "term", "n", "docs"])
        held.clear()

    for b in batches:
        for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if (group := held.get((lang, source))) is None:
                group = held[lang, source] = Counter(), Counter()
            n, docs = group
            size -= len(n)
            words = _TERM.findall(text.as_buffer().to_pybytes().lower())
            n.update(words)
            docs.update(set(words))
            size += len(n)
            if size > HELD:
                yield from send()
                size = 0
    yield from send()


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _quotient(a: Column, b: Column) -> Column:
    """floor(a / b) of longs, a not negative and the quotient below 2 ** 50: what divides evenly is at most
    a rounding away from a whole number as a double."""
    return F.round((a - a % b) / b).cast("long")


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * v)) in 64 bits: at once where the product fits, else by long
    division in steps of BASE."""
    # Without kept terms there is no share; the divisor is 1 so that nothing divides by zero.
    whole = F.greatest(total + 2 * v, F.lit(1).cast("long"))
    out, rest = F.lit(0).cast("long"), n + 2
    for _ in range(3):
        scaled = rest * BASE
        out, rest = out * BASE + _quotient(scaled, whole), scaled % whole
    fits = n < (1 << 63) // SCALE - 2
    return F.when(fits, _quotient((n + 2) * SCALE, whole)).otherwise(out) + 1


def shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The same for arrays; whole is total + 2 * v, or 1."""
    if n.size and n.max() < (1 << 63) // SCALE - 2:
        return (n + 2) * SCALE // whole + 1
    out, rest = np.zeros(np.broadcast_shapes(n.shape, whole.shape), np.int64), n + 2
    for _ in range(3):
        digit, rest = np.divmod(rest * BASE, whole)
        out = out * BASE + digit
    return out + 1


def triangular(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


TILE = ["lang", "b1", "b2", "span"]


class _Tile:
    """The pairs of two blocks of sources, and what the chunks so far add to them beyond what terms that
    no source of the tile has add."""

    def __init__(self, key: tuple, roster: pa.Table):
        self.lang, b1, b2, self.span = key
        self.names = roster.column("source").to_pylist()
        self.row = {name: i for i, name in enumerate(self.names)}
        blk, total = (roster.column(c).to_numpy() for c in ("blk", "n_group"))
        self.v = int(roster.column("v")[0].as_py())
        self.whole = np.maximum(total + 2 * self.v, 1)[:, None]
        self.p0 = shares(np.zeros((len(self.names), 1), np.int64), self.whole)
        first, second = np.flatnonzero(blk == b1), np.flatnonzero(blk == b2)
        #: Each source of the first block with its partners in the second, each pair once.
        self.pairs = [(i, second[second > i] if b1 == b2 else second) for i in first]
        self.sums = [np.zeros(len(js), np.int64) for _, js in self.pairs]

    def add(self, vectors: pa.Table) -> None:
        """One chunk: the packed vectors of the sources that have terms in it."""
        places, counts = (vectors.column(c).combine_chunks() for c in ("idx", "n"))
        lengths = np.diff(places.offsets.to_numpy())
        cols, at = np.unique(places.flatten().to_numpy(), return_inverse=True)
        rows = np.repeat([self.row[s] for s in vectors.column("source").to_pylist()], lengths)
        dense = np.zeros((len(self.names), len(cols)), np.int64)
        dense[rows, at] = counts.flatten().to_numpy()
        p = shares(dense, self.whole)
        for (i, js), sums in zip(self.pairs, self.sums, strict=True):
            sums += triangular(p[i], p[js]).sum(axis=1) - len(cols) * triangular(self.p0[i], self.p0[js])[:, 0]

    def result(self) -> pa.RecordBatch:
        # Each term of the vocabulary adds what one without counts adds; once, in the first span.
        bare = self.v if self.span == 0 else 0
        a = [self.names[i] for i, js in self.pairs for _ in js]
        b = [self.names[j] for _, js in self.pairs for j in js]
        value = [s + bare * triangular(self.p0[i], self.p0[js])[:, 0] for (i, js), s in zip(self.pairs, self.sums, strict=True)]
        flat = np.concatenate([np.empty(0, np.int64), *value])
        return pa.RecordBatch.from_arrays([pa.array([self.lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(flat)], names=["lang", "a", "b", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (lang, a, b, value) for each pair of sources of each tile's span: the tile's roster comes first,
    as chunk -1, then the vectors of one chunk after the other."""
    tile = None
    for t, at in whole_runs(batches, [*TILE, "chunk"], rows=1):
        chunks = t.column("chunk").to_numpy()
        for start, end in zip(at[:-1], at[1:], strict=True):
            run = t.slice(start, end - start)
            if chunks[start] < 0:
                if tile:
                    yield tile.result()
                tile = _Tile(tuple(run.column(k)[0].as_py() for k in TILE), run)
            else:
                tile.add(run)
    if tile:
        yield tile.result()


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank) over the sources of docs(lang, source, text, ...).

    Part `pair`: for each other source of the language the divergence of their shares over all terms that the
    language keeps (those in at least least_documents of its rows). Part `term`: of the terms that the source
    has more often than its language, the top_terms whose shares diverge most from the language's. Ranks count
    from 1 by value, descending, then by item. Null text, lang and source count as empty, repeated rows
    as documents of their own, doc_id is not looked at; sources without terms are compared like all others,
    and where a language keeps no term all its pairs are 0. Further columns are ignored, an empty table gives
    no rows. Counts of up to 9 * 10 ** 15 are exact. A task holds HELD counts, or the vectors of one chunk of two
    blocks of sources."""
    spark = docs.sparkSession
    read = docs.select(_text("lang").alias("lang"), _text("source").alias("source"), _text("text").alias("text"))
    counts = read.mapInArrow(released(_term_counts), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    seen = counts.withColumns({"total": F.sum("n").over(same), "df": F.sum("docs").over(same), "leads": F.min("source").over(same) == F.col("source")})
    kept = materialize(seen.where(F.col("df") >= least_documents).select("lang", "source", "term", "n", "total", "leads"))

    groups = read.select("lang", "source").distinct()
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("leads").alias("v"))
    blocks = groups.groupBy("lang").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("nb"))
    roster = groups.join(sizes, ["lang", "source"], "left").join(blocks.join(langs, "lang", "left"), "lang")
    roster = materialize(
        roster.select("lang", "source", "nb", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_group", "n_lang", "v")])
        .withColumn("blk", F.pmod(F.xxhash64("source"), F.col("nb")).cast("int"))
        .withColumn("spans", F.greatest(F.ceil(F.col("v") / (CHUNK * SPAN)), F.lit(1)).cast("int"))
    )
    wide = F.octet_length("lang") + F.octet_length("source") + 64
    placed = join_checked(kept, roster.withColumn("wide", wide), ["lang", "source"], "inner", F.col("wide"))

    # The terms of a chunk are numbered, so that vectors hold numbers only.
    chunk = F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK)).cast("int")
    terms = placed.where("leads").select("lang", "term", chunk.alias("chunk"))
    terms = terms.withColumn("idx", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1)
    vectors = placed.join(terms.hint("merge"), ["lang", "term"]).groupBy("lang", "source", "blk", "nb", "n_group", "v", "chunk").agg(F.collect_list(F.struct("idx", "n")).alias("at"))
    columns = ["lang", "source", "blk", "nb", "n_group", "v", "span", "chunk", "idx", "n"]
    vectors = vectors.withColumn("span", F.floor(F.col("chunk") / SPAN).cast("int")).withColumns({"idx": F.col("at.idx"), "n": F.col("at.n")})
    spans = roster.withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans") - 1))).withColumns({"chunk": F.lit(-1), "idx": F.expr("cast(array() as array<int>)"), "n": F.expr("cast(array() as array<long>)")})
    tiles = spread_blocks(spans.select(columns).unionByName(vectors.select(columns)))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(partitions, *TILE).sortWithinPartitions(*TILE, "chunk")
    pairs = tiles.mapInArrow(released(_tiles), "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pair = both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value").select("*", ranked)

    p, q = share(F.col("n"), F.col("n_group"), F.col("v")), share(F.col("total"), F.col("n_lang"), F.col("v"))
    told = placed.select("lang", "source", F.col("term").cast("string").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    value = _quotient((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
    term = told.select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value")).select("*", ranked).where(F.col("rank") <= top_terms)
    return pair.unionByName(term)
