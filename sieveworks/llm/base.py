"""What the operators of this subpackage share: shared storage, size-checked joins,
runs of equal keys in sorted batches, and connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks import on_workers

#: A side of a join is broadcast only when its rows, times their width, stay below this.
BROADCAST_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset and Spark runs on
    this machine alone (as in tests) a new folder, which then becomes the checkpoint folder."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir")
    if not configured and not sc.getCheckpointDir() and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="sieveworks-"))
    return configured or sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder, with the lineage cut; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a Parquet table in the shared folder and read back, with its path."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def delete_shared(spark: SparkSession, path: str) -> None:
    """Remove a table of write_shared once nothing lazy reads it any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def join_checked(large: DataFrame, small: DataFrame, on: list[str] | str, how: str, row_bytes: int | Column) -> DataFrame:
    """large joined with small; small is broadcast only if its counted rows times row_bytes (or, with a
    column that gives the bytes of a row, their sum) stay below BROADCAST_BYTES, and is shuffled otherwise.
    small is materialized for the count."""
    small = materialize(small)
    size = small.count() * row_bytes if isinstance(row_bytes, int) else small.agg(F.sum(row_bytes)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return large.join(F.broadcast(small), on, how)
    return large.join(small.hint("merge"), on, how)


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text column; null stays null."""
    return F.col(column).cast("string").cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Let Arrow carry at most a thousand rows or 16 MB at a time to Python workers: texts are long, and
    a batch stands several times in an executor's memory. Values that were set are left alone."""
    for key, default, value in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def released(fn: Callable) -> Callable:
    """fn, a function from batches to batches, that gives its memory back to the machine when its task
    ends. Python workers live on from task to task, and allocators would keep what a task had freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: how rows are dealt into training and held-out parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by keys, tables that hold whole runs of equal keys, with the offsets
    of the runs (their starts, then the number of rows). Memory: `rows` and the longest run."""
    held: list[pa.Table] = []
    held_rows = 0

    def starts(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in keys:
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        held_rows += batch.num_rows
        if held_rows < rows:
            continue
        t = pa.concat_tables(held)
        at = starts(t)
        if at[-1]:
            yield t.slice(0, at[-1]), at
        held, held_rows = [t.slice(at[-1])], t.num_rows - at[-1]
    if held_rows:
        t = pa.concat_tables(held)
        yield t, np.append(starts(t), t.num_rows)


def dealt_blocks(df: DataFrame, keys: list[str], member: str, size: int) -> DataFrame:
    """df with the number of blocks nb of the row's group and the row's own block blk. A group of n
    rows has blocks of about max(size, 2 * sqrt(n)) rows, so that its block pairs (see spread_blocks)
    hold at most n ** 1.5 / 2 rows together; a group of up to `size` rows is one block."""
    large = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > size)
    dealt = join_checked(df, large, keys, "left", 16 + 16 * len(keys))
    block = F.greatest(F.lit(float(size)), 2 * F.sqrt("_n"))
    dealt = dealt.withColumn("nb", F.coalesce(F.ceil(F.col("_n") / block), F.lit(1)).cast("int")).drop("_n")
    return dealt.withColumn("blk", F.pmod(F.xxhash64(member), F.col("nb")).cast("int"))


def spread_blocks(df: DataFrame) -> DataFrame:
    """A row for each block pair (b1, b2), b1 <= b2, that has the row's block: every two rows of a
    group meet in a block pair. Groups of one block get no copies."""
    return (
        df.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("_o"))
        .withColumn("b1", F.least("blk", "_o"))
        .withColumn("b2", F.greatest("blk", "_o"))
        .drop("nb", "_o")
    )


def in_runs(df: DataFrame, keys: list[str], fn: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """mapInArrow of fn over df, dealt and sorted by keys so that equal keys stand together."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(released(fn), schema)


def forest(n: int, partners: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest over n rows, from partners(i): the rows after i linked with i."""
    label, edges = np.arange(n), []
    for i in range(n - 1):
        j = partners(i)
        j = j[label[j] != label[i]]
        if len(j):
            other, first = np.unique(label[j], return_index=True)
            edges += [(i, int(x)) for x in j[first]]
            label[np.isin(label, other)] = label[i]
    return edges


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): a row (node, comp) for each node that has an edge to
    another, comp the smallest node that it reaches.

    Alternates the large-star and small-star steps until nothing changes. Each step is a minimum by
    node and a join of two stored tables on the node, so that Spark combines before the shuffle and
    can split the rows of a much-linked node. Nothing is collected but the count and a checksum."""
    e = materialize(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        at = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if at == seen or not at[0]:
            break
        seen = at
        both = e.union(e.select(F.col("v"), F.col("u")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
