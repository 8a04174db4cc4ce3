"""Token ids in fixed-length rows: best-fit-decreasing packing with a segment tree of capacities."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, releasing
from tidemark.llm.tokenizers_ import BYTE_BPE_RANKS, rank_encoding, vocabulary_path

#: Ids in one row, and the id that ends every document (free in the vocabulary).
ROW_IDS, END_ID = 2048, 50256
#: Ids that a task gathers before it packs them.
BUFFER_IDS = 1 << 22
_TWO_BLANKS = re.compile(r"\s\s")


@lru_cache(maxsize=2)
def _encoders(path: str):
    """The vocabulary's own pattern, and one without look-ahead, alike where no two blanks meet."""
    import tiktoken

    own = rank_encoding(path)
    lookahead = r"|\s+(?!\S)"
    if lookahead not in own._pat_str:
        return own, own
    plain = tiktoken.Encoding("plain", pat_str=own._pat_str.replace(lookahead, ""), mergeable_ranks=own._mergeable_ranks, special_tokens={})
    return own, plain


def encode(text: str | None, path: str) -> np.ndarray:
    own, plain = _encoders(path)
    ids = (own if _TWO_BLANKS.search(text or "") or (text or "")[-1:].isspace() else plain).encode_ordinary(text or "")
    return np.array([*ids, END_ID], dtype=np.uint16)


class Capacities:
    """Open rows by free room; a segment tree finds the least room that is large enough."""

    def __init__(self, room: int) -> None:
        self.size = 1 << room.bit_length()
        self.tree = bytearray(2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(room + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        if len(self.rows[room]) == 1:
            at = self.size + room
            while at and not self.tree[at]:
                self.tree[at] = 1
                at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row of least room >= need, removed: (room, row)."""
        at = self.size + need
        if not self.tree[at]:
            # Up to the first ancestor with something to its right, then down to its leftmost leaf.
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.size
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.tree[at] = 0
            at >>= 1
            while at and not (self.tree[2 * at] or self.tree[2 * at + 1]):
                self.tree[at] = 0
                at >>= 1
        return room, row


def best_fit_decreasing(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Rows of item numbers; each length is from 1 to ``room``. Ties keep the items' order."""
    order = np.argsort(-lengths, kind="stable")
    rows: list[list[int]] = []
    open_ = Capacities(room)
    for item in order.tolist():
        need = int(lengths[item])
        found = open_.take(need)
        if found is None:
            left, row = room - need, len(rows)
            rows.append([item])
        else:
            left, row = found[0] - need, found[1]
            rows[row].append(item)
        if left:
            open_.put(left, row)
    return rows


#: Rows with fewer ids than this share of a row are packed once more, so many segments at a time.
FULL, TAIL_SEGMENTS = 0.98, 1 << 16
_SCHEMA = "ids binary, n_ids int, cu_seqlens array<int>, doc_ids array<long>, starts array<long>"


def _packed(doc: list[int | None], start: list[int], parts: list[np.ndarray], room: int) -> pa.RecordBatch:
    """Segments, which are no longer than a row, in rows."""
    length = [len(p) for p in parts]
    rows = best_fit_decreasing(np.array(length, dtype=np.int64), room)
    matrix = np.full((len(rows), room), END_ID, dtype="<u2")
    cumulative = []
    for r, items in enumerate(rows):
        at, ends = 0, [0]
        for k in items:
            matrix[r, at : at + length[k]] = parts[k]
            at += length[k]
            ends.append(at)
        cumulative.append(ends)
    return pa.RecordBatch.from_arrays(
        [
            _binary(matrix),
            pa.array([e[-1] for e in cumulative], pa.int32()),
            pa.array(cumulative, pa.list_(pa.int32())),
            pa.array([[doc[k] for k in items] for items in rows], pa.list_(pa.int64())),
            pa.array([[start[k] for k in items] for items in rows], pa.list_(pa.int64())),
        ],
        ["ids", "n_ids", "cu_seqlens", "doc_ids", "starts"],
    )


def _binary(matrix: np.ndarray) -> pa.Array:
    """One binary cell for each row of 16-bit values."""
    width = matrix.shape[1] * 2
    offsets = pa.py_buffer(np.arange(0, (len(matrix) + 1) * width, width, dtype=np.int32).tobytes()[: 4 * (len(matrix) + 1)])
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix, dtype="<u2").tobytes())])


def pack_documents(docs: DataFrame, row_ids: int = ROW_IDS, buffer_ids: int = BUFFER_IDS, folder: str | None = None) -> DataFrame:
    """Rows of ``row_ids`` token ids that hold every document whole, each ended by END_ID.

    Returns ``ids`` (little-endian 16-bit matrix row, padded with END_ID), ``n_ids`` (ids before the
    padding), ``cu_seqlens`` (cumulative segment lengths, from 0), ``positions`` (little-endian
    16-bit, from 0 in every segment and in the padding), ``doc_ids`` and ``starts`` (for each segment
    its document and the place of its first id in it). A document of more ids than a row is cut into
    full rows and a rest, so its segments by start give all of its ids. A null or empty text is
    END_ID alone; repeated rows and equal doc_ids are packed one by one; an empty table gives an
    empty one. Which documents share a row depends on how the table's files are split.

    Each task packs what it reads, BUFFER_IDS ids at a time, without a shuffle, so no key can be hot
    and memory doesn't grow with the input. Rows that a buffer leaves underfilled, a few for each,
    are gathered in bounded groups and packed once more, however small the partitions are.
    """
    if row_ids > 1 << 16:
        raise ValueError("a row holds 65,536 ids at most: positions are 16-bit")
    path = vocabulary_path(BYTE_BPE_RANKS, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, parts, n = [], [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py(), path)
                for at in range(0, len(ids), row_ids):
                    doc.append(i)
                    start.append(at)
                    parts.append(ids[at : at + row_ids])
                n += len(ids)
                if n >= buffer_ids:
                    yield _packed(doc, start, parts, row_ids)
                    doc, start, parts, n = [], [], [], 0
        if parts:
            yield _packed(doc, start, parts, row_ids)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, parts = [], [], []
        for batch in batches:
            for cell, ends, docs_, starts in zip(*(batch.column(c) for c in (0, 2, 3, 4)), strict=True):
                ids = np.frombuffer(cell.as_py(), dtype="<u2")
                e = ends.as_py()
                doc += docs_.as_py()
                start += starts.as_py()
                parts += [ids[a:b] for a, b in zip(e, e[1:], strict=False)]
            if len(parts) >= TAIL_SEGMENTS:
                yield _packed(doc, start, parts, row_ids)
                doc, start, parts = [], [], []
        if parts:
            yield _packed(doc, start, parts, row_ids)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.stack([position_ids(c, row_ids) for c in batch.column(2).to_pylist()]) if batch.num_rows else np.zeros((0, row_ids))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(at.astype("<u2")), *batch.columns[3:]], ["ids", "n_ids", "cu_seqlens", "positions", "doc_ids", "starts"])

    first = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), _SCHEMA))
    under = F.col("n_ids") < int(FULL * row_ids)
    tails, segments = first.where(under).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()
    rows = first
    if tails > 1:
        groups = max(1, -(-segments // TAIL_SEGMENTS), -(-tails * row_ids // buffer_ids))
        rows = first.where(~under).unionByName(first.where(under).repartition(groups).mapInArrow(releasing(again), _SCHEMA))
    return rows.mapInArrow(releasing(placed), _SCHEMA.replace("cu_seqlens array<int>,", "cu_seqlens array<int>, positions binary,"))


def position_ids(cu_seqlens: list[int], row_ids: int = ROW_IDS) -> np.ndarray:
    """Positions of a row: from 0 in each segment and in the padding."""
    out = np.arange(row_ids, dtype=np.int32)
    for a, b in zip(cu_seqlens, [*cu_seqlens[1:], row_ids], strict=True):
        out[a:b] -= a
    return out


def write_packed(packed: DataFrame, path: str) -> None:
    """The matrix as Parquet: one binary cell of ids for each row, beside its segment tables."""
    packed.write.mode("overwrite").parquet(path)
