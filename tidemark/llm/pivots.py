"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cell_tables, cells, cut, flat_labels, join_labels, releasing
from tidemark.llm.components import connected_components

#: Pivots of a small table and of the largest ones; between them about the root of the rows.
PIVOTS, MOST_PIVOTS = 256, 4096
#: Vectors for each pivot that pivots are chosen from, how many of them the index is fitted on, and
#: the largest cosine between two pivots.
SAMPLE, FIT, APART = 4, 1024, 0.6
#: Share of pairs right at the threshold that the fitted index is to find.
RECALL = 0.995
#: Rows of one pivot's list on average from which lists are keyed by two pivots.
LONG_LISTS = 1 << 16
#: Vectors in one part of an inverted list.
LIST_ROWS = 2048
_ROWS = 256


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision, without overflow."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def describe(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the ``length`` nearest pivots of each unit row, nearest first; ties by number."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :length].astype(number(pivots))


def number(pivots: np.ndarray) -> type:
    """The type of a pivot's number."""
    return np.uint8 if len(pivots) <= 256 else np.uint16


def padded(vectors: list, width: int) -> np.ndarray:
    """Vectors as unit rows of one width: shorter ones get zeros, longer ones are cut."""
    x = np.zeros((len(vectors), width))
    for r, v in enumerate(vectors):
        own = np.asarray(v, dtype=np.float64)[:width]
        x[r, : len(own)] = own
    x[~x.any(axis=1)] = 1.0
    return unit(x)


@dataclass
class Index:
    """What a table is indexed by. An index without pivots has one list of all vectors, and is exact.

    A vector is described by the order of its ``length`` nearest ``pivots``. It is posted under each
    choice of ``keys`` among the ``near`` first of them, and two vectors of a list are compared if
    they share ``shared`` pivots of their whole descriptions.
    """

    pivots: np.ndarray
    length: int = 0
    near: int = 0
    keys: int = 1
    shared: int = 0

    def post(self, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and list keys of descriptions; a key is the numbers of its pivots plus one."""
        if not len(self.pivots):
            return np.arange(len(top)), np.zeros(len(top), dtype=np.int64)
        first = np.sort(top[:, : self.near].astype(np.int64), axis=1)
        keys = []
        for chosen in combinations(range(first.shape[1]), min(self.keys, first.shape[1])):
            key = np.zeros(len(top), dtype=np.int64)
            for c in chosen:
                key = key << 16 | first[:, c] + 1
            keys.append(key)
        return np.tile(np.arange(len(top)), len(keys)), np.concatenate(keys)

    def is_home(self, key: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether this list is the first that the descriptions of each row of a and b share."""
        if not key:
            return np.ones(len(a), dtype=bool)
        own = []
        while key:
            own.append((key & 0xFFFF) - 1)
            key >>= 16
        earlier = np.zeros(len(a), dtype=bool)
        a, b = a[:, : self.near], b[:, : self.near]
        for c in range(a.shape[1]):
            p = a[:, c]
            earlier |= (p < own[0]) & ~np.isin(p, own) & (b == p[:, None]).any(axis=1)
        return ~earlier

    def bits(self, top: np.ndarray) -> np.ndarray:
        """Descriptions as sets: 64-bit words with a bit for each pivot."""
        out = np.zeros((len(top), max(1, -(-len(self.pivots) // 64))), dtype=np.uint64)
        for c in range(top.shape[1]):
            out[np.arange(len(top)), top[:, c] >> 6] |= np.uint64(1) << (top[:, c] & 63).astype(np.uint64)
        return out


def _counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pivots that each row of a shares with each row of b."""
    out = np.zeros((len(a), len(b)), dtype=np.int32)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] & b[None, :, w])
    return out


def fit(classes: DataFrame, rows: int, threshold: float, pivots: int | None = None, apart: float = APART, recall: float = RECALL) -> Index:
    """An index fitted on a bounded sample, drawn by a hash of the vector.

    Pivots are vectors of the sample; one with a cosine over ``apart`` to a pivot isn't taken, as a
    group of near copies would give many pivots whose order says nothing. Then vectors of the sample
    are turned, by the angle of the threshold, towards random directions and towards each other:
    lists are as many, and the shared pivots as few, as it takes to find ``recall`` of these pairs.
    """
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(PIVOTS, 1 << (max(1, rows - 1).bit_length() + 1) // 2))
    drawn = classes.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE * pivots).select("embedding").collect()
    width = max((len(r[0]) for r in drawn), default=0)
    x = padded([r[0] for r in drawn], width) if drawn else np.zeros((0, 0))
    taken: list[int] = []
    nearest = np.full(len(x), -2.0)
    for at in range(len(x)):
        if len(taken) < pivots and nearest[at] <= apart:
            taken.append(at)
            nearest = np.maximum(nearest, x @ x[at])
    chosen = x[taken]
    if len(chosen) < 2:
        return Index(np.zeros((0, 0)))
    length = min(len(chosen), 48 if len(chosen) <= 256 else 64)
    own = x[-FIT:]
    rng = np.random.default_rng(0)
    turned = []
    for other in (rng.normal(size=own.shape), np.roll(own, 1, axis=0)):
        side = other - (other * own).sum(axis=1, keepdims=True) * own
        norm = np.sqrt((side * side).sum(axis=1))
        some = norm > 1e-6
        y = threshold * own[some] + np.sqrt(max(0.0, 1 - threshold**2)) * side[some] / norm[some, None]
        turned.append((describe(own[some], chosen, length), describe(y, chosen, length)))
    a, b = (np.concatenate(t) for t in zip(*turned, strict=True))
    index = Index(chosen, length)
    same = (a[:, :, None] == b[:, None, :]) if len(a) else np.zeros((1, length, length), dtype=bool)
    index.shared = int(np.quantile(same.any(axis=2).sum(axis=1), (1 - recall) / 2))
    met = np.array([same[:, :k, :k].any(axis=2).sum(axis=1) for k in range(1, length + 1)])
    for index.keys in (1, 2):
        enough = np.nonzero((met >= index.keys).mean(axis=1) >= 1 - (1 - recall) / 2)[0]
        index.near = int(enough[0]) + 1 if len(enough) else length
        if rows * index.near // len(chosen) <= LONG_LISTS:
            break
    return index


def _posted(classes: DataFrame, index: Index) -> DataFrame:
    """``key, cls, top``: the inverted lists, of numbers and descriptions; no vector is in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                if len(index.pivots):
                    top = describe(padded([v.values for v in batch.column(1)], index.pivots.shape[1]), index.pivots, index.length)
                else:
                    top = np.zeros((batch.num_rows, 0), dtype=np.uint8)
                rows, keys = index.post(top)
                tops = pa.array([t.tobytes() for t in top], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(pa.array(rows)), tops.take(pa.array(rows))], ["key", "cls", "top"])

    return classes.select("cls", "embedding").mapInArrow(releasing(run), "key long, cls long, top binary")


def _tops(column: pa.ChunkedArray, index: Index) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=number(index.pivots)).reshape(-1, index.length) if index.length else np.zeros((len(column), 0), dtype=np.uint8)


_CELL = ["key", "i", "j"]


def _survivors(posted: DataFrame, index: Index, list_rows: int) -> DataFrame:
    """The rows of each list that share enough pivots with another row, of which it is the home."""
    dealt = cells(posted, ["key"], "cls", list_rows).select(*_CELL, "part", "cls", "top")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), rows in cell_tables(batches, 3):
            if rows.num_rows < 2:
                continue
            part, top = rows.column("part").to_numpy(), _tops(rows.column("top"), index)
            first = np.nonzero(part == i)[0]
            second = first if i == j else np.nonzero(part == j)[0]
            sets = index.bits(top)
            live = np.zeros(rows.num_rows, dtype=bool)
            for at in range(0, len(first), _ROWS):
                own = first[at : at + _ROWS]
                p, q = np.nonzero(_counts(sets[own], sets[second]) >= index.shared)
                p, q = own[p], second[q]
                if i == j:
                    p, q = p[p < q], q[p < q]
                home = index.is_home(key, top[p], top[q])
                live[p[home]] = live[q[home]] = True
            if live.any():
                yield from rows.filter(pa.array(live)).combine_chunks().to_batches()

    return dealt.mapInArrow(releasing(run), "key long, i int, j int, part int, cls long, top binary")


class _Part:
    """Vectors of one part of a list."""

    def __init__(self, rows: pa.Table, index: Index) -> None:
        self.cls, self.ids, self.copies = (rows.column(c).to_numpy() for c in ("cls", "id", "copies"))
        vectors = [v.values for v in rows.column("embedding")]
        self.lengths = np.array([len(v) for v in vectors])
        self.x = padded(vectors, int(self.lengths.max()))
        self.top = _tops(rows.column("top"), index)


def verified(a: _Part, b: _Part, key: int, threshold: float, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs that reach the threshold, and whether this list is the first that they share."""
    x, y = a.x, b.x
    width = max(x.shape[1], y.shape[1])
    x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
    for at in range(0, len(x), _ROWS):
        s = x[at : at + _ROWS] @ y.T
        i, j = np.nonzero(s >= threshold - 1e-9)
        i += at
        keep = a.lengths[i] == b.lengths[j]
        if a is b:
            keep &= i < j
        i, j = i[keep], j[keep]
        near = np.nonzero(np.abs(s[i - at, j] - threshold) < 1e-9)[0]
        if len(near):
            p, q = x[i[near]], y[j[near]]
            exact = (p * q).sum(1) / np.sqrt((p * p).sum(1) * (q * q).sum(1))
            keep = np.ones(len(i), dtype=bool)
            keep[near] = exact >= threshold
            i, j = i[keep], j[keep]
        if len(i):
            yield i, j, index.is_home(key, a.top[i], b.top[j])


def _linked(rows: DataFrame, threshold: float, index: Index) -> DataFrame:
    """Rows of two kinds: links gained by a class (cls, n), and edges of a forest (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j), cell in cell_tables(batches, 3):
            part = cell.column("part").to_numpy()
            if cell.num_rows < 2 or i != j and (part == part[0]).all():
                continue
            a = _Part(cell.filter(pa.array(part == i)), index)
            b = a if i == j else _Part(cell.filter(pa.array(part == j)), index)
            na, nb = np.zeros(len(a.cls), dtype=np.int64), np.zeros(len(b.cls), dtype=np.int64)
            ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
            label = np.arange(len(ids))
            shift = 0 if a is b else len(a.ids)
            for p, q, home in verified(a, b, key, threshold, index):
                na += np.bincount(p[home], weights=b.copies[q[home]], minlength=len(na)).astype(np.int64)
                nb += np.bincount(q[home], weights=a.copies[p[home]], minlength=len(nb)).astype(np.int64)
                join_labels(label, p, q + shift)
            root = ids[flat_labels(label)]
            apart = root != ids
            for names, columns in ((("cls", "n"), (np.concatenate([a.cls[na > 0], b.cls[nb > 0]]), np.concatenate([na[na > 0], nb[nb > 0]]))), (("a", "b"), (ids[apart], root[apart]))):
                if len(columns[0]):
                    own = dict(zip(names, columns, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(own[c], pa.int64()) if c in own else pa.nulls(len(columns[0]), pa.int64()) for c in ("cls", "n", "a", "b")], ["cls", "n", "a", "b"])

    return rows.mapInArrow(releasing(run), "cls long, n long, a long, b long")


def embedding_links(vectors: DataFrame, threshold: float = 0.9, pivots: int | None = None, list_rows: int = LIST_ROWS, recall: float = RECALL, exact: bool = False) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors(vec_id, embedding)``.

    Two vectors link at a cosine (double precision) of ``threshold`` or more. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do vectors of
    different lengths. Equal vectors (by 128 bits of hash) are one class with a count of copies;
    copies aren't compared pair by pair. Every class is in the index, which is fitted on a bounded sample (see ``fit``) to
    find ``recall`` of the pairs right at the threshold; ``exact`` gives all, by comparing all.

    Inverted lists hold numbers and ordered descriptions; in a list, rows that share enough pivots
    with another one survive, and only their vectors are fetched and compared. Of the lists that two
    share only the first one counts their link. Counts and spanning forests leave a list, never its
    pairs; a long list is parted. Repeated vec_ids are one vertex of a component; other columns
    aren't read; an empty table gives an empty table.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    valid = F.coalesce((F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.when(valid, x).alias("embedding"), F.when(valid, F.xxhash64(x)).alias("h1"), F.when(valid, F.xxhash64(F.lit(1), x)).alias("h2"))
    classes = rows.where("embedding is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()))
    index = Index(np.zeros((0, 0))) if exact else fit(classes, classes.count(), threshold, pivots, recall=recall)
    alive = cut(_survivors(cut(_posted(classes, index)), index, list_rows))
    held = alive.join(classes, "cls").select(*_CELL, "part", "cls", "top", "id", "copies", "embedding")
    held = held.repartition(*_CELL).sortWithinPartitions(*_CELL, "part")
    found = cut(_linked(held, threshold, index))
    labels = connected_components(found.where("a is not null").select("a", "b"))
    gained = found.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("n"))
    named = (
        classes.join(gained, "cls", "left")
        .join(labels, "id", "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    return rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
