"""Asking the whole corpus about hashes without a row for each hash.

Documents are dealt to chunks by hash. A chunk sorts its distinct hashes and sends each bucket of
the hash space one packed array; a bucket meets the arrays of all chunks, answers for each, and the
answer goes back to the chunk's documents. A hash that a third of all documents hold is one entry of
each chunk, so neither a bucket nor a chunk is hot, and no pair of documents is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunk_count, release, shuffle_partitions, text_bytes

#: doc_id of rows without one: they are larger than any other and have nothing removed.
NO_ID = np.iinfo(np.int64).max
BLOBS = "bucket int, chunk long, data binary"


def chunked(docs: DataFrame, chunk_bytes: int, keep: tuple[str, ...] = (), buckets_per_chunk: float = 0.25) -> tuple[DataFrame, int]:
    """doc_id, text, chunk and kept columns as c0, c1, ..., dealt by chunk; and a number of buckets."""
    _, total = text_bytes(docs)
    chunks = chunk_count(total, chunk_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    # The input's partition is part of the hash, so rows repeated without end aren't one chunk.
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(chunks)))
    return rows.repartition(shuffle_partitions(docs.sparkSession), "chunk"), max(4, round(chunks * buckets_per_chunk))


def send(docs: DataFrame, pack: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(bucket, data) that ``pack`` makes of each chunk's documents."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        try:
            return _table(((b, key[0].as_py(), d) for b, d in pack(rows)))
        finally:
            release()

    return docs.groupBy("chunk").applyInArrow(run, BLOBS)


def answer(sent: DataFrame, meet: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """For each bucket, ``meet`` gets what all chunks sent and gives an answer (or none) to each."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        answers = meet(rows.column("data").to_pylist())
        release()
        return _table((key[0].as_py(), c, a) for c, a in zip(rows.column("chunk").to_pylist(), answers, strict=True) if a is not None)

    return sent.groupBy("bucket").applyInArrow(run, BLOBS)


def receive(docs: DataFrame, answers: DataFrame, use: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """``use`` gets each chunk's documents and its answers by ascending bucket."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        try:
            return use(rows, found.sort_by("bucket").column("data").to_pylist())
        finally:
            release()

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def send_again(docs: DataFrame, answers: DataFrame, pack: Callable[[pa.Table, list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Like send, with the answers to what was sent before."""

    def use(rows: pa.Table, found: list[bytes]) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py() if rows.num_rows else -1
        return _table((b, chunk, d) for b, d in pack(rows, found))

    return receive(docs, answers, use, BLOBS)


def _table(rows: Iterator[tuple[int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["bucket", "chunk", "data"])


def bucket_slices(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of the ranges of ascending hashes that have any: a bucket is an even part
    of the hash space, and work is by what is there, not by how many buckets there are."""
    number = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = runs(number)
    ends = np.append(starts[1:], len(hashes))[: len(starts)]
    return list(zip(number[starts].astype(np.int64).tolist(), starts.tolist(), ends.tolist(), strict=True))


def compressed(*arrays: np.ndarray) -> bytes:
    """Arrays end to end, packed; see ``column`` for how they are read. Signed 64-bit ones (ids, whose
    high bytes are mostly alike) go byte by byte: all first bytes, then all second ones and so on."""
    data = b"".join((a.reshape(-1, 1).view(np.uint8).T if a.dtype == np.int64 else a).tobytes() for a in arrays)
    return np.int64(len(data)).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def column(data: bytes, kind: type, count: int, at: int) -> np.ndarray:
    """``count`` values from byte ``at`` of what ``expanded`` gave."""
    if kind is not np.int64:
        return np.frombuffer(data, dtype=kind, count=count, offset=at)
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8, count=8 * count, offset=at).reshape(8, count).T).view(np.int64).reshape(-1)


def expanded(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int(np.frombuffer(blob, dtype=np.int64, count=1)[0]), codec="zstd", asbytes=True)


def runs(ordered: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    if not len(ordered):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.nonzero(ordered[1:] != ordered[:-1])[0] + 1])


class Distinct:
    """Ascending distinct hashes of a chunk, and which of them more than one document holds."""

    def __init__(self, hashes: np.ndarray, owner: np.ndarray, flag: np.ndarray | None = None) -> None:
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        starts = runs(ordered)
        self.hashes = ordered[starts]
        self.of = np.empty(len(hashes), dtype=np.int64)
        self.of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
        if len(starts):
            own = owner[order]
            self.shared = np.minimum.reduceat(own, starts) != np.maximum.reduceat(own, starts)
            self.count = np.diff(np.append(starts, len(hashes)))
            self.flag = np.ones(len(starts), dtype=bool) if flag is None else np.logical_or.reduceat(flag[order], starts)
        else:
            self.shared = self.flag = np.zeros(0, dtype=bool)
            self.count = np.zeros(0, dtype=np.int64)

    def packed(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """Per bucket: the number of hashes, their low halves, and both flags as bits."""
        low = (self.hashes & np.uint64(0xFFFFFFFF)).astype("<u4")
        for b, lo, hi in bucket_slices(self.hashes, buckets):
            yield b, np.int64(hi - lo).tobytes() + low[lo:hi].tobytes() + np.packbits(self.shared[lo:hi]).tobytes() + np.packbits(self.flag[lo:hi]).tobytes()

    def unpacked(self, answers: list[bytes], buckets: int) -> np.ndarray:
        """The answered value of each hash, in order: 1 if it is shared, 2 if it is hot besides."""
        sizes = [hi - lo for _, lo, hi in bucket_slices(self.hashes, buckets)]
        parts = [np.unpackbits(np.frombuffer(a, dtype=np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n).sum(axis=0) for a, n in zip(answers, sizes, strict=True)]
        return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def shared_hashes(blobs: list[bytes], hot: tuple[int, int] | None = None) -> list[bytes]:
    """Bits of the hashes that two documents or more hold, at least one with its flag set.

    With ``hot``, (weight of an entry with its flag set, least sum), flags are no condition but
    weigh; a second set of bits follows, of the shared hashes whose entries weigh so much.
    """
    keys, shared, flag, sizes = [], [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, dtype=np.int64, count=1)[0])
        bits = -(-n // 8)
        keys.append(np.frombuffer(blob, dtype="<u4", count=n, offset=8))
        shared.append(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, count=bits, offset=8 + 4 * n), count=n))
        flag.append(np.unpackbits(np.frombuffer(blob, dtype=np.uint8, count=bits, offset=8 + 4 * n + bits), count=n))
        sizes.append(n)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    starts = runs(key[order])
    many = np.diff(np.append(starts, len(key)))
    hit = (many > 1) | np.maximum.reduceat(np.concatenate(shared)[order], starts).astype(bool)
    flagged = np.concatenate(flag)[order]
    found = [hit]
    if hot is None:
        hit &= np.maximum.reduceat(flagged, starts).astype(bool)
    else:
        found.append(hit & (many + (hot[0] - 1) * np.add.reduceat(flagged, starts, dtype=np.int64) >= hot[1]))
    out = [b""] * len(sizes)
    for values in found:
        bit = np.empty(len(key), dtype=bool)
        bit[order] = np.repeat(values, many)
        out = [o + np.packbits(bit[e - n : e]).tobytes() for o, e, n in zip(out, np.cumsum(sizes), sizes, strict=True)]
    return out


def pair_runs(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal pairs."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    return np.concatenate([[0], np.nonzero((h[1:] != h[:-1]) | (g[1:] != g[:-1]))[0] + 1])


def pair_lookup(h: np.ndarray, g: np.ndarray, mine: np.ndarray, also: np.ndarray) -> np.ndarray:
    """Places of the pairs (mine, also) among pairs (h, g) that ascend by h; -1 where there is none."""
    at = np.searchsorted(h, mine, "left")
    out = np.full(len(mine), -1, dtype=np.int64)
    left = np.nonzero(at < len(h))[0]
    while len(left):
        left = left[(at[left] < len(h))]
        left = left[h[at[left]] == mine[left]]
        same = g[at[left]] == also[left]
        out[left[same]] = at[left[same]]
        left = left[~same]
        at[left] += 1
    return out
