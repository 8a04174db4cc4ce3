"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import shared_root

#: Bytes of text that one unit of grouped Python work holds on average.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one is made on a local master only."""
    return shared_root(spark)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more deleted now: Spark deletes them when
    the driver's garbage is collected, and a driver that only waits may not do that for long."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of all texts; two numbers, whatever the size of the input."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def chunk_count(total_bytes: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    return max(1, -(-total_bytes // chunk_bytes))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes outside 0x20 and 0x09-0x0D; optionally A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def release() -> None:
    """Give freed memory back: workers live on between tasks, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for a partition of batches, with memory released at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


class UnionFind:
    """Disjoint sets over arbitrary hashable ids; the root of a set is its smallest member."""

    def __init__(self) -> None:
        self.parent: dict = {}

    def find(self, x):
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.parent[b] = a
        return True


def flat_labels(label: np.ndarray) -> np.ndarray:
    """Each label's root."""
    while (up := label[label]).tobytes() != label.tobytes():
        label = up
    return label


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hook the larger root under the smaller one until each pair (i, j) has one root."""
    while len(i):
        label[:] = flat_labels(label)
        p, q = label[i], label[j]
        apart = p != q
        if not apart.any():
            return
        i, j, p, q = i[apart], j[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit lanes."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Hot keys that may be broadcast; more are joined by a shuffle.
HOT_KEYS = 50_000


def parts(df: DataFrame, key: list[str], spread: str, limit: int, weight: str | None = None) -> DataFrame:
    """Rows with ``_k``, the number of parts of their key, and ``part``, theirs, by a hash of ``spread``.

    A key of up to ``limit`` rows is one part, a larger one has parts of about ``limit`` rows. With a
    column ``weight`` the limit is one of its sum, not of rows.
    """
    spark = df.sparkSession
    amount = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*key).agg(amount.alias("_n")).where(F.col("_n") > limit)
    hot = cut(counts.withColumn("_k", F.ceil(F.col("_n") / F.lit(limit)).cast("int")).drop("_n"))
    few = hot.limit(HOT_KEYS + 1).collect()
    if len(few) <= HOT_KEYS:
        hot = F.broadcast(spark.createDataFrame(few, hot.schema))
    parted = df.join(hot, key, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    return parted.withColumn("part", F.pmod(F.xxhash64(spread), F.col("_k")).cast("int"))


def deal(parted: DataFrame, key: list[str]) -> DataFrame:
    """Rows with ``_k, part`` in cells (i, j) of their key: each pair of its parts meets in one."""
    dealt = parted.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "_o"), "j": F.greatest("part", "_o")}).drop("_k", "_o")
    return dealt.repartition(shuffle_partitions(parted.sparkSession), *key, "i", "j").sortWithinPartitions(*key, "i", "j", "part")


def cells(df: DataFrame, key: list[str], spread: str, limit: int, weight: str | None = None) -> DataFrame:
    """Rows dealt to cells (i, j) of their key, each of which holds two parts of it at most.

    A key of up to ``limit`` rows is one cell, (0, 0). A larger one has its rows dealt by a hash of
    ``spread`` to parts of about ``limit`` rows, and each pair of parts meets in one cell, so every
    pair of rows meets and no task holds a hot key whole. Adds ``i, j, part``; sorted by them.
    With a column ``weight`` the limit is one of its sum, not of rows.
    """
    return deal(parts(df, key, spread, limit, weight), key)


def cell_tables(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """(key, rows) of each run of rows that agree in the first ``keys`` columns, which are integers."""
    held: list[pa.RecordBatch] = []
    now: tuple[int, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy() for c in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.nonzero(change)[0].tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            own = tuple(int(c[a]) for c in columns)
            if own != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = own
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)
