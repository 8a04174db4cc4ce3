"""Byte-level substring deduplication by column-wise multi-document suffix sorting."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from functools import lru_cache
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir, mix64
from tidemark.llm.exchange import (
    NO_ID,
    Distinct,
    answer,
    bucket_slices,
    chunked,
    column,
    compressed,
    expanded,
    pair_lookup,
    pair_runs,
    receive,
    send,
    send_again,
    shared_hashes,
)

#: Bytes of a repeat, and of the anchors inside it.
WINDOW, ANCHOR = 50, 16
CHUNK_BYTES = 2 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:int,end:int>>"
_POSITION = np.uint64((1 << 28) - 1)
#: Places whose least hashes are found at once.
STRETCH = 1 << 24
#: An anchor is hot from so much weight on: one for each chunk that has it, HOT_CHUNK for one that
#: has it so often. The windows of a hot anchor go to buckets by their own hash.
HOT_CHUNK, HOT = 64, 2048
NO_RANK = np.iinfo(np.int32).max
_BASE = 0x9E3779B97F4A7C15
_SYMBOL = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Base and symbols of the two lanes of a hash, of the second of which half is used.
_LANES = ((_BASE, _SYMBOL), (0xC2B2AE3D27D4EB4F, mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))))


class ColumnSuffixes:
    """Sorted suffixes of a collection of rows, built by one symbol of each row a round.

    Rows occupy columns ``begin`` to ``end`` of a matrix and end in terminators that sort first and
    equal nothing. A round goes one column to the left. It reads what the round before wrote: the
    rows' order, their common prefixes and the collection's Burrows-Wheeler transform, which has the
    symbol that stands before each suffix. These symbols, with the last ones of rows that end here,
    are stably sorted: the step of the transform from a suffix to the one before it. Common prefixes
    grow by one within a symbol's block, from the minimum between two neighbours, and are zero at
    its edge. Then the round inserts the next symbol of each row in the transform and appends all
    three to files that are only ever read and written in sequence.
    """

    def __init__(self, matrix: np.ndarray, begin: np.ndarray, end: np.ndarray, open_file: Callable[[str], BinaryIO]) -> None:
        self.matrix, self.begin, self.end = matrix, begin, end
        self.columns: list[tuple[int, int]] = []
        self.files = {name: (open_file(name), kind) for name, kind in (("order", np.int32), ("lcp", np.uint8), ("bwt", np.int16))}
        before = {name: np.zeros(0, dtype=kind) for name, (_, kind) in self.files.items()}
        for column in range(matrix.shape[1] - 1, -1, -1):
            if self.columns:
                before = {name: self._read(name, self.columns[-1][1], sum(n for _, n in self.columns[:-1])) for name in self.files}
            order, lcp = self._round(column, **before)
            # The next symbol to the left; -1 where a row has none.
            bwt = np.where(begin[order] < column, matrix[order, column - 1].astype(np.int16), np.int16(-1))
            for name, x in (("order", order), ("lcp", lcp), ("bwt", bwt)):
                f, kind = self.files[name]
                f.seek(0, 2)
                f.write(x.astype(kind).tobytes())
            self.columns.append((column, len(order)))

    def _read(self, name: str, count: int, skip: int) -> np.ndarray:
        f, kind = self.files[name]
        f.seek(skip * np.dtype(kind).itemsize)
        return np.frombuffer(f.read(count * np.dtype(kind).itemsize), dtype=kind)

    def _round(self, column: int, order: np.ndarray, lcp: np.ndarray, bwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.nonzero(self.end == column + 1)[0].astype(np.int32)
        q = np.concatenate([new, order])
        symbols = np.concatenate([self.matrix[new, column].astype(np.int16), bwt])
        common = np.concatenate([np.zeros(len(new), dtype=np.uint8), lcp])
        if len(q):
            common[min(len(new), len(q) - 1)] = 0
        at = np.nonzero(symbols >= 0)[0]
        symbol = symbols[at].astype(np.uint8)
        sort = np.argsort(symbol, kind="stable")
        at, symbol = at[sort], symbol[sort]
        out = np.zeros(len(at), dtype=np.uint8)
        same = np.nonzero(symbol[1:] == symbol[:-1])[0] if len(at) else at
        if len(same):
            out[same + 1] = np.minimum(_range_min(common, at[same] + 1, at[same + 1]), 254) + 1
        return q[at], out

    def rounds(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(column, row order, common prefix with the row before) of all rounds, read in sequence."""
        skip = 0
        for column, n in self.columns:
            yield column, self._read("order", n, skip), self._read("lcp", n, skip)
            skip += n


@contextmanager
def external_files(folder: str | None) -> Iterator[Callable[[str], BinaryIO]]:
    """Makes files that are gone at the end: in the shared folder if it is one that tasks can open,
    else (a store behind a scheme) in memory."""
    with ExitStack() as stack:
        where = None if folder is None else stack.enter_context(tempfile.TemporaryDirectory(prefix="columns-", dir=folder))
        yield lambda name: stack.enter_context(io.BytesIO() if where is None else open(os.path.join(where, name), "w+b"))


def openable(folder: str) -> str | None:
    """The path of a folder as executors open it, if it is one of a file system."""
    path = folder.removeprefix("file://") if folder.startswith("file:///") else folder.removeprefix("file:")
    return path if path.startswith("/") else None


def _range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of x over each inclusive range, from a table of powers of two."""
    width = last - first + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(first), dtype=x.dtype)
    table, step = x, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        own = np.nonzero(level == k)[0]
        if len(own):
            out[own] = np.minimum(table[first[own]], table[last[own] - step + 1])
        table = np.minimum(table[:-step], table[step:]) if step < len(table) else table
        step *= 2
    return out


class _Bytes:
    """The bytes of a chunk's documents, end to end, and their anchored pieces.

    The anchor of a window is its sub-string of least hash, the leftmost of equals; it depends on
    the window's bytes alone. Windows in a row with one anchor make up a piece.
    """

    def __init__(self, rows: pa.Table, window: int, k: int) -> None:
        self.window, self.k = window, k
        self.doc_ids = rows.column("doc_id").to_pylist()
        self.texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in rows.column("text")]
        lengths = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.raw = np.frombuffer(b"".join(self.texts), dtype=np.uint8)
        self.id = np.array([NO_ID if i is None else i for i in self.doc_ids], dtype=np.int64)
        n, tail = len(self.raw), window - k + 1
        if n < window:
            self.s = self.e = self.offset = self.row = np.zeros(0, dtype=np.int64)
            self.anchor = np.zeros(0, dtype=np.uint64)
            return
        h = self._rolling(k)
        at = np.concatenate([b + self._least(h[b : b + STRETCH + tail - 1], tail) for b in range(0, len(h) - tail + 1, STRETCH)])
        whole = np.zeros(len(at) + window, dtype=np.int32)
        long = lengths >= window
        np.add.at(whole, (self.ends - lengths)[long], 1)
        np.add.at(whole, (self.ends - window + 1)[long], -1)
        s = np.nonzero(np.cumsum(whole)[: len(at)] > 0)[0]
        p = at[s]
        first = np.nonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (p[1:] != p[:-1])]))[0] if len(s) else s
        last = np.append(first[1:], len(s)) - 1 if len(s) else s
        self.s, self.e = s[first], s[last] + window
        self.offset = p[first] - self.s
        # Least hashes crowd at the low end; mixed once more they spread over the buckets.
        self.anchor = mix64(h[p[first]] ^ np.uint64(_BASE))
        self.row = np.searchsorted(self.ends, self.s, "right")

    @staticmethod
    def _least(h: np.ndarray, tail: int) -> np.ndarray:
        """Where the least of each ``tail`` hashes in a row is, the leftmost of equals in the bits
        that its place leaves; STRETCH bounds the place, however long a text is."""
        low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step * 2 <= tail:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if tail > step:
            low = np.minimum(low[: len(low) - (tail - step)], low[tail - step :])
        return (low & _POSITION).astype(np.int64)

    def _rolling(self, k: int) -> np.ndarray:
        """Hash of the k bytes from each place: doubling, then the binary digits of k."""
        h, n, power = _SYMBOL[self.raw], 1, _BASE
        out, done = None, 0
        while n <= k:
            if k & n:
                if out is None:
                    out, done = h, n
                else:
                    tail = h[done:]
                    m = min(len(out), len(tail))
                    out, done = out[:m] * np.uint64(power) + tail[:m], done + n
            if 2 * n <= k:
                h = h[:-n] * np.uint64(power) + h[n:]
            n, power = 2 * n, power * power % (1 << 64)
        return mix64(out)

    def distinct_anchors(self) -> Distinct:
        """The flag marks anchors that the chunk has often."""
        found = Distinct(self.anchor, self.row)
        found.flag = found.count >= HOT_CHUNK
        return found

    def span_hashes(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each byte range: 64 bits, and 32 more."""
        n, out = len(self.raw), []
        if not len(s):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
        for lane, (_, symbols) in enumerate(_LANES):
            total = np.zeros(n + 1, dtype=np.uint64)
            powers = (_large(n, lane, False)[:, None] * _small(lane, False)[None, :]).reshape(-1)[:n]
            powers *= symbols[self.raw]
            np.cumsum(powers, out=total[1:])
            del powers
            x = total[e]
            x -= total[s]
            x *= _small(lane, True)[s & ((1 << _STEP) - 1)]
            x *= _large(n, lane, True)[s >> _STEP]
            out.append(mix64(x + ((e - s).astype(np.uint64) << np.uint64(32))))
        return out[0], (out[1] >> np.uint64(32)).astype(np.uint32)

    def piece_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each piece's bytes and of its anchor's place in it."""
        h, g = self.span_hashes(self.s[at], self.e[at])
        return h + _SYMBOL[self.offset[at] & 255], g

    def windows(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of all windows of the pieces."""
        many = self.e[piece] - self.s[piece] - self.window + 1
        of = np.repeat(piece, many)
        return self.s[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), of


_STEP = 11


@lru_cache(maxsize=8)
def _small(lane: int, back: bool) -> np.ndarray:
    """The first powers of a lane's base, or of its inverse."""
    base = _LANES[lane][0]
    out = np.full(1 << _STEP, pow(base, -1, 1 << 64) if back else base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def _large(n: int, lane: int, back: bool) -> np.ndarray:
    """Every so many a power, as many as reach power n: the rest are products of two."""
    base = pow(_LANES[lane][0], (-1 if back else 1) << _STEP, 1 << 64)
    out = np.full((n >> _STEP) + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


class _Pieces:
    """What one chunk sends a bucket: distinct pieces with the least and the largest doc_id, and
    distinct windows of hot anchors likewise."""

    HEAD = ((np.uint64, 8), (np.uint32, 4), (np.int64, 8), (np.int64, 8), (np.uint8, 1), (np.uint8, 1))
    WINDOWS = ((np.uint64, 8), (np.uint32, 4), (np.uint64, 8), (np.int64, 8), (np.int64, 8))

    @staticmethod
    def pack(own: _Bytes, found: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
        at = np.nonzero(found == 1)[0]
        h, g = own.piece_hashes(at)
        (h, g, least, most), at = _distinct(h, g, own.id[own.row[at]], at)
        order = np.argsort(own.anchor[at], kind="stable")
        h, g, least, most, at = (x[order] for x in (h, g, least, most, at))
        slices = {b: (lo, hi) for b, lo, hi in bucket_slices(own.anchor[at], buckets)}
        place, piece = own.windows(np.nonzero(found == 2)[0])
        wh, wg = own.span_hashes(place, place + own.window)
        (wh, wg, wleast, wmost), piece = _distinct(wh, wg, own.id[own.row[piece]], piece)
        hot = {b: (lo, hi) for b, lo, hi in bucket_slices(wh, buckets)}
        for b in sorted(slices.keys() | hot.keys()):
            lo, hi = slices.get(b, (0, 0))
            part = at[lo:hi]
            size = own.e[part] - own.s[part]
            raw = own.raw[np.repeat(own.s[part] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            a, z = hot.get(b, (0, 0))
            yield b, compressed(
                np.array([hi - lo, z - a], dtype=np.uint64), h[lo:hi], g[lo:hi], least[lo:hi], most[lo:hi] - least[lo:hi], size.astype(np.uint8), own.offset[part].astype(np.uint8),
                wh[a:z], wg[a:z], own.anchor[piece[a:z]], wleast[a:z], wmost[a:z] - wleast[a:z], raw,
            )

    @classmethod
    def unpack(cls, blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, list[int], list[np.ndarray], list[int]]:
        """The columns and bytes of all pieces and each blob's number of them; the windows' likewise."""
        columns, raws, sizes = [[] for _ in cls.HEAD], [], []
        hot, counts = [[] for _ in cls.WINDOWS], []
        for blob in blobs:
            data = expanded(blob)
            (n, m), at = np.frombuffer(data, dtype=np.uint64, count=2).tolist(), 16
            for target, kinds, many in ((columns, cls.HEAD, n), (hot, cls.WINDOWS, m)):
                for c, (kind, width) in zip(target, kinds, strict=True):
                    c.append(column(data, kind, many, at))
                    at += width * many
                # The largest doc_id is sent as how far it is above the least one, the column before.
                most = 4 if target is hot else 3
                target[most][-1] = target[most][-1] + target[most - 1][-1]
            raws.append(np.frombuffer(data, dtype=np.uint8, offset=at))
            sizes.append(n)
            counts.append(m)
        return [np.concatenate(c) for c in columns], np.concatenate(raws), sizes, [np.concatenate(c) for c in hot], counts


def _distinct(h: np.ndarray, g: np.ndarray, who: np.ndarray, at: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct pairs (h, g), ascending, with the least and the largest of ``who`` and one of ``at``."""
    order = np.lexsort((who, g, h))
    h, g, who, at = h[order], g[order], who[order], at[order]
    first = pair_runs(h, g)
    last = np.append(first[1:], len(h))[: len(first)] - 1
    return (h[first], g[first], who[first], who[last]), at[first]


def _least_holders(least: np.ndarray, size: np.ndarray, offset: np.ndarray, raw: np.ndarray, window: int, k: int, folder: str | None) -> np.ndarray:
    """For each piece and window column, the smallest holder of the window's bytes.

    ``least`` and the result are ranks of doc_ids, to be small; windows that aren't there have the
    largest rank of all.
    """
    tail = window - k + 1
    begin = tail - 1 - offset.astype(np.int64)
    length = size.astype(np.int64)
    m = len(least)
    matrix = np.zeros((m, window + tail - 1), dtype=np.uint8)
    ramp = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    matrix[np.repeat(np.arange(m), length), np.repeat(begin, length) + ramp] = raw
    low = np.full((m, tail), NO_RANK, dtype=np.int32)
    with external_files(folder) as files:
        for column, order, lcp in ColumnSuffixes(matrix, begin, begin + length, files).rounds():
            if column < tail and len(order):
                starts = np.nonzero(np.concatenate([[True], lcp[1:] < window]))[0]
                groups = np.minimum.reduceat(least[order], starts)
                low[order, column] = np.repeat(groups, np.diff(np.append(starts, len(order))))
    columns = np.arange(tail)
    low[(columns < begin[:, None]) | (columns > (begin + length - window)[:, None])] = NO_RANK
    return low


def _resolve(blobs: list[bytes], window: int, k: int, folder: str | None) -> list[bytes | None]:
    """For each chunk, where it matters: (piece hash, first column, last column, smallest doc_id) and,
    for windows of hot anchors, (window hash, anchor, smallest doc_id)."""
    (h, g, least, most, size, offset), raw, sizes, hot, counts = _Pieces.unpack(blobs)
    columns = _piece_answers(h, g, least, most, size, offset, raw, window, k, folder) if len(h) else None
    wide = _window_answers(*hot)
    out: list[bytes | None] = []
    for e, n, f, m in zip(np.cumsum(sizes), sizes, np.cumsum(counts), counts, strict=True):
        part = [np.zeros(0, dtype=kind) for kind, _, _ in ANSWER]
        if columns is not None:
            of, base, count, value, first, last = columns
            entry = np.arange(e - n, e)
            many = count[of[entry]]
            run = np.repeat(base[of[entry]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            entry = np.repeat(entry, many)
            use = value[run] < most[entry]
            run, entry = run[use], entry[use]
            part = [h[entry], g[entry], value[run], first[run], last[run]]
        own = [x[f - m : f][wide[-1][f - m : f]] for x in wide[:-1]]
        if len(part[0]) or len(own[0]):
            out.append(compressed(np.array([len(part[0]), len(own[0])], dtype=np.uint64), *[x.astype(kind) for x, (kind, _, _) in zip((*part, *own), ANSWER + HOT_ANSWER, strict=True)]))
        else:
            out.append(None)
    return out


#: Columns of an answer, as (type, bytes, name).
ANSWER = ((np.uint64, 8, "h"), (np.uint32, 4, "g"), (np.int64, 8, "low"), (np.uint8, 1, "first"), (np.uint8, 1, "last"))
HOT_ANSWER = ((np.uint64, 8, "h"), (np.uint32, 4, "g"), (np.uint64, 8, "anchor"), (np.int64, 8, "low"))


def _window_answers(h: np.ndarray, g: np.ndarray, anchor: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """h, g, anchor, the smallest holder of each window, and whether that matters to its sender."""
    order = np.lexsort((g, h))
    starts = pair_runs(h[order], g[order])
    low = np.empty(len(h), dtype=np.int64)
    if len(h):
        low[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(h))))
    return h, g, anchor, low, low < most


def _piece_answers(h, g, least, most, size, offset, raw, window, k, folder) -> tuple[np.ndarray, ...]:
    """Each entry's distinct piece; and of each piece the runs of columns with one smallest holder."""
    order = np.lexsort((g, h))
    starts = pair_runs(h[order], g[order])
    of = np.empty(len(h), dtype=np.int64)
    of[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
    pick = order[starts]
    ends = np.cumsum(size, dtype=np.int64)
    length = size[pick].astype(np.int64)
    bytes_ = raw[np.repeat(ends[pick] - length - np.cumsum(length) + length, length) + np.arange(int(length.sum()))]
    ids, rank = np.unique(np.minimum.reduceat(least[order], starts), return_inverse=True)
    low = _least_holders(rank.astype(np.int32), size[pick], offset[pick], bytes_, window, k, folder)
    useful = low < np.searchsorted(ids, np.maximum.reduceat(most[order], starts)).astype(np.int32)[:, None]
    low[~useful] = NO_RANK
    padded = np.pad(low, ((0, 0), (1, 1)), constant_values=NO_RANK)
    change = padded[:, 1:] != padded[:, :-1]
    piece, first = np.nonzero(change[:, :-1] & useful)
    _, last = np.nonzero(change[:, 1:] & useful)
    count = np.bincount(piece, minlength=len(pick))
    return of, np.cumsum(count) - count, count, ids[low[piece, first]], first, last


def _answers(found: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts: tuple[list, list] = ([[] for _ in ANSWER], [[] for _ in HOT_ANSWER])
    for blob in found:
        data = expanded(blob)
        at = 16
        for n, kinds, target in zip(np.frombuffer(data, dtype=np.uint64, count=2).tolist(), (ANSWER, HOT_ANSWER), parts, strict=True):
            for (kind, width, _), into in zip(kinds, target, strict=True):
                into.append(column(data, kind, n, at))
                at += width * n
    return tuple([np.concatenate(c) for c in p] for p in parts)


def deduplicate_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = (), texts: bool = False, hot: int = HOT) -> DataFrame:
    """Remove each byte of a ``window``-byte string that also starts in a document with a smaller doc_id.

    Texts are their UTF-8 bytes; matches never cross documents and are judged on the input. Returns
    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``spans``, the maximal removed ranges.
    ``keep`` names columns to carry along; they come back as ``c0, c1, ...`` in that order. With
    ``texts`` there is a column ``kept_text`` too, by ``cut_text``.
    A null or empty text has no bytes; a row without a doc_id removes nothing and keeps all; equal
    doc_ids aren't smaller than each other; other columns aren't read; an empty table gives an
    empty one. A cut may fall inside a character; see ``cut_texts`` for texts.

    Three passes over the documents, which are shuffled once. (1) Every window has an anchor, its
    sub-string of least hash; anchors that no second document has can't lie in a repeat. (2) Pieces,
    the windows in a row around one occurrence of a shared anchor, go to the bucket of their anchor.
    There the distinct pieces, lined up at their anchors, are suffix-sorted column by column; rows
    whose common prefix is a window or longer hold the same string, so the smallest doc_id of such
    an interval is known for each window of each piece. (3) Bytes are removed. Pieces of equal bytes
    are recognised by 96 bits of hash; whatever differs is compared byte by byte in the sorting.
    An anchor that very many documents have would fill its bucket, so the windows of a hot one (see
    HOT) go to buckets by their own 96 bits of hash and are compared by them.
    """
    rows, buckets = chunked(docs, chunk_bytes, keep, buckets_per_chunk=1.0)
    folder = openable(checkpoint_dir(docs.sparkSession))
    carried = [f"c{i}" for i in range(len(keep))]
    kinds = dict(docs.dtypes)
    schema = SCHEMA + "".join(f", {c} {kinds[k]}" for c, k in zip(carried, keep, strict=True)) + ", kept_text string" * texts

    def anchors(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        yield from _Bytes(table, window, anchor).distinct_anchors().packed(buckets)

    def pieces(table: pa.Table, found: list[bytes]) -> Iterator[tuple[int, bytes]]:
        own = _Bytes(table, window, anchor)
        distinct = own.distinct_anchors()
        yield from _Pieces.pack(own, distinct.unpacked(found, buckets)[distinct.of], buckets)

    def remove(table: pa.Table, found: list[bytes]) -> pa.Table:
        own = _Bytes(table, window, anchor)
        gone = np.zeros(len(own.raw) + 1, dtype=np.int64)
        if found:
            (h, g, low, first, last), hot = _answers(found)
            if len(h):
                order = np.lexsort((g, h))
                h, g, low, first, last = (x[order] for x in (h, g, low, first.astype(np.int64), last.astype(np.int64)))
                starts = pair_runs(h, g)
                ends = np.append(starts[1:], len(h))
                mine, also = own.piece_hashes(np.arange(len(own.s)))
                k = pair_lookup(h[starts], g[starts], mine, also)
                piece = np.nonzero(k >= 0)[0]
                many = (ends - starts)[k[piece]]
                run = np.repeat(starts[k[piece]] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
                piece = np.repeat(piece, many)
                who = own.id[own.row[piece]]
                use = (low[run] < who) & (who != NO_ID)
                run, piece = run[use], piece[use]
                zero = own.s[piece] + own.offset[piece] - (window - anchor)
                np.add.at(gone, zero + first[run], 1)
                np.add.at(gone, zero + last[run] + window, -1)
            if len(hot[0]):
                order = np.argsort(hot[0], kind="stable")
                h, g, anchors_, low = (x[order] for x in hot)
                place, piece = own.windows(np.nonzero(np.isin(own.anchor, anchors_))[0])
                k = pair_lookup(h, g, *own.span_hashes(place, place + window))
                who = own.id[own.row[piece]]
                place = place[(k >= 0) & (low[k] < who) & (who != NO_ID)]
                np.add.at(gone, place, 1)
                np.add.at(gone, place + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        out, begin = [], 0
        for text, end in zip(own.texts, own.ends.tolist(), strict=True):
            c = covered[begin:end]
            if c.any():
                edges = np.nonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))[0].reshape(-1, 2).tolist()
                kept = own.raw[begin:end][~c].tobytes()
            else:
                edges, kept = [], text
            out.append((len(text), len(text) - len(kept), len(edges), hashlib.sha256(kept).hexdigest(), [{"begin": a, "end": b} for a, b in edges]))
            begin = end
        cols = list(zip(*out, strict=True)) or [()] * 5
        new = [pa.array([cut_text(t, [(x["begin"], x["end"]) for x in o[4]]) for t, o in zip(table.column("text").to_pylist(), out, strict=True)], pa.string())] if texts else []
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))]
        return pa.table(
            [pa.array(own.doc_ids, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, types, strict=True)), *(table.column(c) for c in carried), *new],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *carried, *["kept_text"] * texts],
        )

    hits = answer(send(rows, anchors), lambda blobs: shared_hashes(blobs, (HOT_CHUNK, hot)))
    found = answer(send_again(rows, hits, pieces), lambda blobs: _resolve(blobs, window, anchor, folder))
    return receive(rows, found, remove, schema)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with their columns, each text without its repeats and n_chars to match.

    A text that repeats end to end has nothing left, and its row goes; null and empty texts stay.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = deduplicate_bytes(docs, keep=("doc_id", *others), texts=True, **options)
    found = found.where("n_bytes = 0 or kept_text <> ''")
    kinds = dict(docs.dtypes)
    back = {"doc_id": "c0", "text": "kept_text"} | {c: f"c{i + 1}" for i, c in enumerate(others)}
    out = found.select(*[F.col(back[c]).alias(c) for c in docs.columns])
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(kinds["n_chars"]))
    return out


def cut_text(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the byte ranges; characters that a range cuts in two go whole."""
    if not spans:
        return text
    raw = (text or "").encode("utf-8", "surrogatepass")
    parts, at = [], 0
    for begin, end in spans:
        parts.append(raw[at:begin].decode("utf-8", "ignore"))
        at = end
    parts.append(raw[at:].decode("utf-8", "ignore"))
    return "".join(parts)
