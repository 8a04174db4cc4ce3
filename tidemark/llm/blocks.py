"""Word-level substring deduplication by fixed-block anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.common import mix64, words_of
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

#: Words of a repeat. A block may be half of that: a window then holds a whole block of any document.
WINDOW = 13
CHUNK_BYTES = 4 << 20
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<begin:int,end:int>>"


_FACTORS = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)


#: Types and places, for each window, of what is sent: 96 bits of hash, least doc_id, and how far the
#: largest one is above it.
SENT = ((np.uint64, 0), (np.uint32, 8), (np.int64, 12), (np.int64, 20))


class _Words:
    """The words of a chunk's documents, end to end."""

    def __init__(self, rows: pa.Table) -> None:
        self.doc_ids = rows.column("doc_id").to_pylist()
        self.words = [words_of(t.as_py()) for t in rows.column("text")]
        self.ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        self.n = int(self.ends[-1]) if len(self.ends) else 0
        digests = b"".join([xxhash.xxh3_128_digest(x) for w in self.words for x in w])
        #: Two 64-bit lanes of each word's hash.
        self.hash = np.frombuffer(digests, dtype=np.uint64).reshape(-1, 2).T.copy()
        lengths = np.diff(self.ends, prepend=0)
        self.row = np.repeat(np.arange(len(lengths)), lengths)
        self.id = np.array([NO_ID if i is None else i for i in self.doc_ids], dtype=np.int64)
        self.left = (self.ends[self.row] - np.arange(self.n)) if self.n else np.zeros(0, dtype=np.int64)
        self.at = lengths[self.row] - self.left if self.n else self.left

    def starts(self, k: int) -> np.ndarray:
        """Where k words of one document begin."""
        return np.nonzero(self.left >= k)[0]

    def further(self, k: int, at: np.ndarray) -> np.ndarray:
        """32 more bits of the hash of the k words from the given starts."""
        return (self.rolling(k, 1, at) >> np.uint64(32)).astype(np.uint32)

    def rolling(self, k: int, lane: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """A lane of the hash of the k words from each start, or from the given ones."""
        n = max(0, self.n - k + 1)
        out = np.zeros(n if at is None else len(at), dtype=np.uint64)
        for p in range(k):
            out *= np.uint64(_FACTORS[lane])
            out += self.hash[lane, p : p + n] if at is None else self.hash[lane, at + p]
        return mix64(out) if at is not None else mix64(out)[self.starts(k)] if n else out


def _anchors(own: _Words, block: int) -> Distinct:
    """All rolling windows of a block's length; the flag marks those that are a block of a document."""
    at = own.starts(block)
    return Distinct(own.rolling(block), own.row[at], own.at[at] % block == 0)


def deduplicate_words(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Remove repeats of ``window`` words that also start in a document with a smaller doc_id.

    Words are runs outside white space, unchanged. Each word that such a window covers goes; windows
    are judged on the input. Returns ``doc_id, n_words, n_removed, kept_sha256`` (kept words, joined
    by a space) and ``spans``, the maximal removed word ranges. A null or blank text has no words;
    a row without a doc_id removes nothing and keeps all; equal doc_ids aren't smaller than each
    other; other columns aren't read; an empty table gives an empty one.

    Three passes over the documents, which are shuffled once. (1) The non-overlapping blocks of
    (window + 1) / 2 words that start a document's every such many words are the index; all rolling
    windows of that length probe it. (2) Around hits in another document the windows of full length
    are looked up with the smallest doc_id that holds each: neighbouring ones make up the maximal
    exact repeat. (3) Words are removed. Words are told apart by 128
    bits of hash, full windows by 96.
    """
    block = (window + 1) // 2
    rows, buckets = chunked(docs, chunk_bytes)

    def probe(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        yield from _anchors(_Words(table), block).packed(buckets)

    def extend(table: pa.Table, found: list[bytes]) -> Iterator[tuple[int, bytes]]:
        own = _Words(table)
        anchors = _anchors(own, block)
        hit = np.zeros(own.n + 1, dtype=np.int64)
        hit[own.starts(block) + 1] = anchors.unpacked(found, buckets)[anchors.of] > 0
        upto = np.cumsum(hit)
        at = own.starts(window)
        # Blocks that start in the first window - block + 1 places lie inside the window.
        near = upto[at + window - block + 1] > upto[at]
        at = at[near]
        h, g, who = own.rolling(window, 0, at), own.further(window, at), own.id[own.row[at]]
        order = np.lexsort((who, g, h))
        h, g, who = h[order], g[order], who[order]
        first = pair_runs(h, g)
        if not len(first):
            return
        last = np.append(first[1:], len(h)) - 1
        h, g, least, most = h[first], g[first], who[first], who[last]
        for b, lo, hi in bucket_slices(h, buckets):
            yield b, np.int64(hi - lo).tobytes() + compressed(h[lo:hi], g[lo:hi], least[lo:hi], most[lo:hi] - least[lo:hi])

    def smallest(blobs: list[bytes]) -> list[bytes | None]:
        sizes = [int(np.frombuffer(b, dtype=np.int64, count=1)[0]) for b in blobs]
        data = [expanded(b[8:]) for b in blobs]
        h, g, least, over = (np.concatenate([column(d, kind, n, start * n) for d, n in zip(data, sizes, strict=True)]) for kind, start in SENT)
        most = least + over
        order = np.lexsort((g, h))
        starts = pair_runs(h[order], g[order])
        low = np.empty(len(h), dtype=np.int64)
        low[order] = np.repeat(np.minimum.reduceat(least[order], starts), np.diff(np.append(starts, len(h))))
        useful = low < most
        out: list[bytes | None] = []
        for e, n in zip(np.cumsum(sizes), sizes, strict=True):
            use = np.nonzero(useful[e - n : e])[0] + e - n
            out.append(np.int64(len(use)).tobytes() + compressed(h[use], g[use], low[use]) if len(use) else None)
        return out

    def remove(table: pa.Table, found: list[bytes]) -> pa.Table:
        own = _Words(table)
        gone = np.zeros(own.n + 1, dtype=np.int64)
        if found:
            parts = [(int(np.frombuffer(f, dtype=np.int64, count=1)[0]), expanded(f[8:])) for f in found]
            h, g, low = (np.concatenate([column(d, kind, n, start * n) for n, d in parts]) for kind, start in SENT[:3])
            at = own.starts(window)
            mine = own.rolling(window)
            some = np.nonzero(h[np.minimum(np.searchsorted(h, mine), len(h) - 1)] == mine)[0]
            at, mine = at[some], mine[some]
            k = pair_lookup(h, g, mine, own.further(window, at))
            who = own.id[own.row[at]]
            drop = at[(k >= 0) & (low[k] < who) & (who != NO_ID)]
            gone[drop] += 1
            np.subtract.at(gone, drop + window, 1)
        covered = np.cumsum(gone)[: own.n] > 0
        out, begin = [], 0
        for words, end in zip(own.words, own.ends.tolist(), strict=True):
            c = covered[begin:end]
            kept = [w for w, g in zip(words, c.tolist(), strict=True) if not g] if c.any() else words
            edges = np.nonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))[0].reshape(-1, 2)
            out.append((len(words), int(c.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"begin": a, "end": b} for a, b in edges.tolist()]))
            begin = end
        n, removed, sha, spans = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table(
            [pa.array(own.doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
        )

    hits = answer(send(rows, probe), shared_hashes)
    low = answer(send_again(rows, hits, extend), smallest)
    return receive(rows, low, remove, SCHEMA)
