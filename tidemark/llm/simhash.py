"""SimHash near-duplicates through sharded BK-trees."""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import UnionFind, cell_tables, cells, cut, deal, drop_shuffles, mix64, parts, releasing, words_of
from tidemark.llm.components import connected_components

#: Fingerprints that one tree may hold; a shard with more is split into cells of two such parts.
TREE_NODES = 2048
_SLICE = 1 << 15


def shingles(words: list[bytes], k: int) -> list[bytes]:
    """All runs of k words with repeats, joined by one space; a shorter sequence is one run."""
    if len(words) <= k:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def fingerprint(words: list[bytes], k: int, lanes: int = 1) -> tuple[int, ...]:
    """``lanes`` unsigned 64-bit words; a bit is 1 if set in over half of the shingle hashes.

    Shingles count as often as they occur. One lane is of XXH64 with seed 42; an even number of lanes is of 128-bit hashes. No words: zero.
    """
    return majority(shingles(words, k), lanes)


def majority(runs: list[bytes], lanes: int = 1) -> tuple[int, ...]:
    """The fingerprint of these shingles."""
    if not runs:
        return (0,) * lanes
    set_bits = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(runs), _SLICE):
        part = runs[at : at + _SLICE]
        if lanes == 1:
            raw = np.array([xxhash.xxh64_intdigest(r, 42) for r in part], dtype="<u8").view(np.uint8).reshape(-1, 8)
        else:
            digests = [b"".join(xxhash.xxh3_128_digest(r, seed) for r in part) for seed in range(lanes // 2)]
            raw = np.concatenate([np.frombuffer(d, dtype=np.uint8).reshape(-1, 16) for d in digests], axis=1)
        set_bits += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    over = set_bits * 2 > len(runs)
    return tuple(np.packbits(over, bitorder="little").view("<u8").tolist())


class BKTree:
    """Fingerprints keyed by Hamming distance to their parent."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, value: int, payload) -> None:
        node = self.root
        if node is None:
            self.root = [value, payload, {}]
            return
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = [value, payload, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> Iterator[tuple[int, object]]:
        """(distance, payload) of each entry within the radius, following only edges within it."""
        if self.root is None:
            return
        stack = [self.root]
        while stack:
            own, payload, children = stack.pop()
            d = (own ^ value).bit_count()
            if d <= radius:
                yield d, payload
            if children:
                if len(children) > 2 * radius + 1:
                    for edge in range(max(1, d - radius), d + radius + 1):
                        child = children.get(edge)
                        if child is not None:
                            stack.append(child)
                    if d <= radius and 0 in children:
                        stack.append(children[0])
                else:
                    for edge, child in children.items():
                        if -radius <= edge - d <= radius:
                            stack.append(child)


def fingerprints(docs: DataFrame, k: int, lanes: int = 1, lower: bool = True) -> DataFrame:
    """doc_id and fingerprint lanes ``f0..`` of every whole text (null or blank: zero)."""
    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(words_of(t.as_py(), lower), k, lanes) for t in batch.column(1)]
            lanes_ = [
                pa.array(np.array([p[i] for p in prints], dtype=np.uint64).view(np.int64), pa.int64())
                for i in range(lanes)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lanes_], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), schema)


def block_shards(radius: int, bits: int = 64, rows: int = 0, shard_rows: int = TREE_NODES // 4) -> list[list[int]]:
    """Choices of ``n - radius`` of n disjoint blocks of bits: fingerprints within the radius differ in
    ``radius`` blocks at most, so they agree on one of the choices.

    With n one more than the radius each block is a choice. More and narrower blocks make longer
    keys: n grows until a shard of spread ``rows`` holds ``shard_rows`` on average, so that a shard's
    work doesn't grow with the table. Nothing is lost with any n.
    """
    n = radius + 1
    while n < bits and (rows >> (bits * (n - radius) // n)) > shard_rows:
        n += 1
    edges = [bits * i // n for i in range(n + 1)]
    blocks = [list(range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen, []) for chosen in combinations(blocks, n - radius)]


def sampled_shards(tables: int, sample: int, bits: int, seed: int = 7) -> list[list[int]]:
    """Random bit samples: for radii where disjoint blocks would be too short to part anything."""
    rng = random.Random(seed)
    return [sorted(rng.sample(range(bits), sample)) for _ in range(tables)]


def sample_plan(rows: int) -> tuple[int, int]:
    """(tables, bits of a sample) for so many fingerprints: a longer sample keeps shards small, and
    more tables keep the chance that a pair of similarity 0.8 shares one."""
    more = (rows >> 20).bit_length()
    return -int(-TABLES // 0.85**more), SAMPLE + more


def _masks(shards: list[list[int]], lanes: int) -> list[list[int]]:
    """For each shard group the signed 64-bit mask of its bits in each lane."""
    out = []
    for positions in shards:
        masks = [sum(1 << (p % 64) for p in positions if p // 64 == lane) for lane in range(lanes)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def links(prints: DataFrame, radius: int, shards: list[list[int]], lanes: int = 1, tree_lanes: int | None = None, tree_nodes: int = TREE_NODES) -> DataFrame:
    """``a, b, distance``: a minimum spanning forest, per shard, of all pairs within the radius.

    ``prints`` has one row per distinct fingerprint: ``id`` and the lanes. Each fingerprint goes to
    one shard per bit group (over all lanes; distances are over the first ``tree_lanes``); a shard's BK-tree is built and probed where its rows meet. Shards of
    more than ``tree_nodes`` rows are split: each pair of parts is a cell with one part as the tree
    and the other as probes, so no task holds a shard whole. A dense group gives a tree of links,
    not all its pairs; links in the forest are the closest ones.
    """
    names = [f"f{i}" for i in range(lanes)]
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in own]) for own in _masks(shards, lanes)])
    keyed = prints.select("id", *names, F.posexplode(masks).alias("at", "mask"))
    chosen = [F.col(x).bitwiseAND(F.get("mask", F.lit(lane))) for lane, x in enumerate(names)]
    # Bits that meet by a collision of this hash are only compared in vain.
    names = names[: tree_lanes or lanes]
    keyed = keyed.select("id", *names, F.xxhash64("at", *chosen).alias("shard"))
    dealt = cells(keyed, ["shard"], "id", tree_nodes).select("shard", "i", "j", "part", "id", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        cell, tree, pairs = None, BKTree(), []

        def close() -> None:
            pairs.sort()
            sets = UnionFind()
            out.extend((a, b, d) for d, a, b in pairs if sets.union(a, b))
            pairs.clear()

        for batch in batches:
            shard, i, j, part, ids, *fs = (batch.column(x).to_numpy(zero_copy_only=False).tolist() for x in range(batch.num_columns))
            for at in range(len(ids)):
                if cell != (now := (shard[at], i[at], j[at])):
                    close()
                    cell, tree = now, BKTree()
                value = 0
                for f in fs:
                    value = value << 64 | f[at] & 0xFFFFFFFFFFFFFFFF
                same = i[at] == j[at]
                if same or part[at] == j[at]:
                    pairs.extend((d, other, ids[at]) for d, other in tree.within(value, radius))
                    if len(pairs) > 200_000:
                        pairs.sort()
                        sets = UnionFind()
                        pairs[:] = [p for p in pairs if sets.union(p[1], p[2])]
                if same or part[at] == i[at]:
                    tree.insert(value, ids[at])
            if len(out) > 10_000:
                yield _edges(out)
                out = []
        close()
        yield _edges(out)

    return dealt.mapInArrow(releasing(run), "a long, b long, distance int")


def _edges(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.int32())], ["a", "b", "distance"]
    )


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """Fingerprint and component of every document, linked at ``radius`` or fewer differing bits.

    Returns ``doc_id, fingerprint, component_id``. Documents with equal fingerprints are one vertex
    (its smallest doc_id). Null, empty and blank texts have the zero fingerprint and link like any
    other. An empty table gives an empty table; other columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, k))
    vertices = prints.groupBy("f0").agg(F.min("doc_id").alias("id"))
    vertices = cut(vertices)
    edges = links(vertices, radius, block_shards(radius, rows=vertices.count()))
    labels = connected_components(edges)
    named = vertices.join(labels, "id", "left").select("f0", F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, "f0").select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id"
    )


#: For near-duplicates by shingles: 64-bit lanes that shards sample, and those that trees hold; tables
#: of sampled bits and bits of a sample; and the radius within which pairs are verified. At a
#: similarity of 0.8 a pair differs in 15 of 100 bits on average, give or take 2, so that 64 samples
#: of 14 bits miss about one such pair in 200. Shorter samples miss fewer, but their shards grow.
#: Of 192 bits such a pair differs in 29, give or take 5, and an unlike one in 96, give or take 7: within
#: the radius lies one unlike pair in 3e8. (Within 40 of 128 bits, one in 7e4: a million texts then
#: have over ten such partners each, and grow together to one loose component.)
LANES, TREE_LANES, TABLES, SAMPLE, RADIUS = 4, 3, 64, 14, 56
#: Fingerprints that one tree of such a shard may hold.
NEAR_NODES = 4096
#: Texts of at most so many distinct shingles, whose fingerprints vary more, are joined exactly.
SHORT = 64


def shingle_set(runs: list[bytes]) -> np.ndarray:
    """The distinct hashed shingles in order; none: the one shingle 0, so texts without words are alike."""
    if not runs:
        return np.zeros(1, dtype=np.int64)
    return np.unique(np.array([xxhash.xxh64_intdigest(r) for r in runs], dtype=np.uint64)).view(np.int64)


#: Shingles in a part of a group whose pairs are compared on their sets, and what a row counts besides.
PART_SHINGLES, ROW_SHINGLES = 1 << 20, 256


#: Rows that are compared with all others before one label may be passed over.
FIRST_ROWS = 32


def _joined(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links after which no two groups of linked rows have a similar pair.

    Rows are compared with all others that share a shingle. After the first FIRST_ROWS the largest
    group is the hub; from then on its rows, each of which would be compared with rows that are
    compared themselves, are passed over, so a group of near copies costs next to nothing.
    """
    n = len(ids)
    sizes = np.array([len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    posting = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")]
    many = np.bincount(token)
    first, ends = np.cumsum(many) - many, np.cumsum(sizes)
    root, hub = np.arange(n), None
    # Rows in an order that is no order of the texts, so that the first ones are like the rest.
    order = np.argsort(mix64(ids.astype(np.uint64)), kind="stable")
    out = []
    for k, x in enumerate(order):
        if k >= FIRST_ROWS:
            if hub is None:
                hub = int(order[np.argmax(np.bincount(root, minlength=n)[root[order]])])
            if root[x] == root[hub]:
                continue
        t = token[ends[x] - sizes[x] : ends[x]]
        spread = np.repeat(first[t] - np.cumsum(many[t]) + many[t], many[t])
        common = np.bincount(posting[spread + np.arange(len(spread))], minlength=n)
        hits = np.nonzero((common >= similarity * (sizes + sizes[x] - common)) & (root != root[x]))[0]
        for y in hits[np.unique(root[hits], return_index=True)[1]]:
            out.append((int(ids[x]), int(ids[y])))
            root[root == root[y]] = root[x]
    return out


def exact_links(rows: DataFrame, key: str, similarity: float, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``a, b``: links that join all similar pairs of each key, verified on the sets before they join.

    ``rows`` has the key, ``v, shingles``. A set goes once to where its key's rows meet; a key with
    more than ``part_shingles`` shingles is split into cells of two such parts.
    """
    weighed = rows.withColumn("_w", F.size("shingles") + ROW_SHINGLES)
    dealt = cells(weighed, [key], "v", part_shingles, "_w").select(key, "i", "j", "v", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in cell_tables(batches, 3):
            if cell.num_rows < 2:
                continue
            sets = cell.column("shingles").combine_chunks()
            sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
            flat, ends = sets.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))
            yield from _found(_joined(cell.column("v").to_numpy(), np.split(flat, ends[:-1]), similarity))

    return dealt.mapInArrow(releasing(run), "a long, b long")


def _found(pairs: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], ["a", "b"])


def exact_text_links(rows: DataFrame, texts: DataFrame, key: str, k: int, similarity: float, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """``exact_links`` of texts that are still to be fetched.

    ``rows`` has the key, ``v, n`` (its distinct shingles) and the text's ``h1, h2, id``; ``texts`` has
    ``row`` (the text) and what ``first_rows`` matches. Texts go to the cells, and their sets are made
    there: they are less than half of their sets, and no set is written.
    """
    weighed = rows.withColumn("_w", F.col("n") + ROW_SHINGLES)
    parted = parts(weighed, [key], "v", part_shingles, "_w").select(key, "v", "_k", "part", "h1", "h2", "id")
    dealt = deal(first_rows(texts, parted).select(key, "v", "_k", "part", "row"), [key]).select(key, "i", "j", "v", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, cell in cell_tables(batches, 3):
            if cell.num_rows > 1:
                sets = [shingle_set(shingles(words_of(t.as_py(), True), k)) for t in cell.column("row")]
                yield from _found(_joined(cell.column("v").to_numpy(), sets, similarity))

    return dealt.mapInArrow(releasing(run), "a long, b long")


def by_text(rows: DataFrame, row: Column) -> DataFrame:
    """``row`` and what tells the rows of a text and doc_id: ``h1, h2, _id, _none``."""
    number = F.col("doc_id").cast("long")
    return rows.select(row.alias("row"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), F.coalesce(number, F.lit(0)).alias("_id"), number.isNull().alias("_none"))


def first_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (no two of the same ``h1, h2, id``) with the ``row`` of one of ``rows``, as by_text gives
    them, that has this text and doc_id. The rows are shuffled once; copies are told by their doc_id,
    so the rows of a text that is repeated very often go to many tasks. Merged, as the rows stay
    where they met for the aggregation; after a broadcast they would be shuffled again."""
    keys, others = ["h1", "h2", "_id", "_none"], [c for c in wanted.columns if c not in ("h1", "h2")]
    keyed = wanted.withColumns({"_id": F.coalesce("id", F.lit(0)), "_none": F.col("id").isNull()})
    met = rows.join(keyed.hint("merge"), keys).groupBy(*keys)
    return met.agg(F.first("row").alias("row"), *[F.first(c).alias(c) for c in others])


def short_links(sets: DataFrame, similarity: float, most: int | None = SHORT) -> DataFrame:
    """``a, b``: links that join all similar pairs of ``sets(v, shingles)`` of ``most`` shingles or fewer
    (None: of any number).

    Two similar sets, in one order of all shingles, share one of the first n - ceil(similarity * n)
    + 1 of each; texts meet by these.
    """
    n = F.size("shingles")
    first = F.slice(F.array_sort("shingles"), F.lit(1), n - F.ceil(F.lit(similarity) * n - 1e-9).cast("int") + 1)
    keyed = sets.where((n > 0) & (F.lit(most is None) | (n <= (most or 0)))).select(F.explode(first).alias("key"), "v", "shingles")
    return exact_links(keyed, "key", similarity)


def near_groups(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = RADIUS, short: int | None = SHORT) -> DataFrame:
    """Groups of near copies: ``h1, h2`` (a text's identity), ``id`` and ``kept_id``.

    ``id`` is the smallest doc_id with the text, ``kept_id`` the smallest one of its group. Texts
    link if the Jaccard similarity of their k-word shingle sets (A-Z lower-cased; a shorter text is
    one shingle) is ``similarity`` or more. Candidates come from SimHash fingerprints of these sets in
    BK-trees over shards of sampled bits, as the closest-first spanning forests of pairs within the
    radius. A forest connects what all candidates do, so every candidate pair lies within a component
    of the forests, and the texts of such a component are linked on their exact sets: a false
    candidate takes no true one's place, and a text is sent once, however many candidates it is in.
    Texts of ``short`` shingles or fewer are joined exactly; with None all texts are, at the
    price of a row for each of a fifth of a text's shingles. Texts without words are one group.
    """
    spark = docs.sparkSession
    identity = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *identity)
    lanes = [f"f{i}" for i in range(LANES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                prints, sizes, few = [], [], []
                for t in batch.column(1):
                    runs = list(dict.fromkeys(shingles(words_of(t.as_py(), True), k)))
                    prints.append(majority(runs, LANES))
                    sizes.append(max(1, len(runs)))
                    few.append(shingle_set(runs) if short is None or len(runs) <= short else None)
                own = [pa.array(np.array([p[i] for p in prints], dtype=np.uint64).view(np.int64), pa.int64()) for i in range(LANES)]
                sets = pa.array(few, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sizes, pa.int32()), sets, *own], ["doc_id", "h1", "h2", "n", "shingles", *lanes])

    prints = keyed.mapInArrow(releasing(run), "doc_id long, h1 long, h2 long, n int, shingles array<long>, " + ", ".join(f"{x} long" for x in lanes))
    texts = prints.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), *[F.first(x).alias(x) for x in ("n", "shingles", *lanes)])
    texts = cut(texts.withColumn("v", F.monotonically_increasing_id()))
    # A text of so few shingles that all texts like it are short is joined exactly only.
    long = texts.where(F.lit(short is not None) & (F.col("n") > int(similarity * (short or 0) + 1e-9))).select(F.col("v").alias("id"), *lanes)
    near = links(long, radius, sampled_shards(*sample_plan(long.count()), 64 * LANES), LANES, TREE_LANES, NEAR_NODES)
    labels = cut(connected_components(near).select(F.col("id").alias("v"), F.col("component").alias("loose")))
    drop_shuffles(spark)
    loose = labels.join(texts.select("v", "id", "h1", "h2", "n"), "v")
    more = exact_text_links(loose, by_text(docs, F.col("text")), "loose", k, similarity)
    whole = more.unionByName(short_links(texts.where("shingles is not null").select("v", "shingles"), similarity, short))
    groups = texts.join(connected_components(whole).withColumnRenamed("id", "v"), "v", "left").withColumn("g", F.coalesce("component", "v"))
    groups = cut(groups.select("h1", "h2", "id", "g"))
    drop_shuffles(spark)
    least = groups.groupBy("g").agg(F.min("id").alias("kept_id"))
    return groups.join(least, "g").select("h1", "h2", "id", "kept_id", "g")


def one_of_each_group(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all columns, that are the first of their group of near copies.

    The smallest doc_id stays; of rows that repeat it with the same text one stays. Texts with no
    words are copies of each other. Rows without a doc_id stay only where no row of the group has
    one. An empty table gives an empty one.
    """
    groups = near_groups(docs, k, similarity)
    kept = groups.where(F.col("id").eqNullSafe(F.col("kept_id")))
    # Two texts of one group may share the smallest doc_id; the smaller hash stays.
    kept = kept.groupBy("g").agg(F.min(F.struct("h1", "h2", "id")).alias("s")).select("s.*")
    rows = by_text(docs, F.struct(*docs.columns))
    return first_rows(rows, kept.select("h1", "h2", "id")).select("row.*")
