"""Benchmark decontamination by spaced-seed hashing."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, mix64, releasing, words_of

#: A window of this many words is an overlap if at least so many of them agree (0.8 and more).
WINDOW, AGREE = 13, 11
#: Word positions that a seed reads. Any two substitutions in a window leave one of them whole.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Items of so many words or more are searched; with 1 every item is that has a word.
SHORTEST = 5
#: Items of fewer words than a window and of so many or more may have a fifth of their words changed.
TOLERANT = 8
#: Benchmark words in one broadcast index; a larger benchmark is searched in slices of this size.
INDEX_WORDS = 1 << 20
#: Pairs of a document's contexts and an item's that are compared at once.
PAIRS = 1 << 16
#: Bits of a map in front of the sorted seeds, at most; 16 for each seed where that is less.
_BITS = 22
#: What stands beside an end of a text: never equal to each other, nor to a word's hash.
_NO_ITEM, _NO_DOC = np.uint64(0), np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    h[h <= _NO_DOC] += np.uint64(2)
    return h


def seed_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """One hash for each start at which the mask fits."""
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for p in mask:
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[p : p + n]
    return mix64(out ^ np.uint64(len(mask) * 64 + mask[-1]))


def tolerated(words: int) -> int:
    """Substitutions that a window of an item of so many words may have."""
    if words >= WINDOW:
        return WINDOW - AGREE
    return words // 5 if words >= TOLERANT else 0


def masks_of(words: int) -> list[tuple[int, tuple[int, ...]]]:
    """(place of its first word in the window, mask) of the seeds for items of so many words.

    Shorter items than a window are a window of their own; of one mask more than the substitutions
    it tolerates, which share no word, one is left whole.
    """
    if words >= WINDOW:
        return [(0, m) for m in MASKS]
    parts = tolerated(words) + 1
    return [(r, tuple(range(0, words - r, parts))) for r in range(parts)]


def _classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal rows, and the set of each row; told apart by 128 bits."""
    a, b = np.zeros(len(rows), dtype=np.uint64), np.zeros(len(rows), dtype=np.uint64)
    for c in range(rows.shape[1]):
        a = a * np.uint64(0x9E3779B97F4A7C15) + rows[:, c]
        b = b * np.uint64(0xC2B2AE3D27D4EB4F) + mix64(rows[:, c])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    of = np.empty(len(rows), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


@dataclass
class Seeds:
    """One mask's seeds of all items that use it, and the distinct contexts that they stand in.

    A context is the words of all windows that hold the seed; ``before`` of them stand left of it.
    Equal contexts are kept once, however often they occur in an item or in how many items.
    """

    window: int
    need: int
    mask: tuple[int, ...]
    before: int
    bits: np.ndarray
    hashes: np.ndarray
    contexts: np.ndarray
    holders: np.ndarray
    bounds: np.ndarray

    @classmethod
    def build(cls, items: list[tuple[int, np.ndarray]], words: int, first: int, mask: tuple[int, ...]) -> Seeds:
        """``items`` are (number, word hashes); all have ``words`` words, or a window and more."""
        window = min(words, WINDOW)
        before = window - mask[-1] - 1 if words >= WINDOW else first
        size = window + before if words >= WINDOW else window
        seeds, rows, holder = [], [], []
        for k, h in items:
            own = seed_hashes(h, mask) if words >= WINDOW else seed_hashes(h[first:], mask)[:1]
            padded = np.concatenate([np.full(before, _NO_ITEM), h, np.full(size, _NO_ITEM)])
            at = np.arange(len(own)) if words >= WINDOW else np.array([first])
            seeds.append(own)
            rows.append(np.lib.stride_tricks.sliding_window_view(padded, size)[at])
            holder.append(np.full(len(own), k, dtype=np.int64))
        seed, row, who = np.concatenate(seeds), np.concatenate(rows), np.concatenate(holder)
        pick, of = _classes(row)
        # Equal contexts have equal seeds.
        pairs = np.unique(np.stack([of, who], axis=1), axis=0)
        order = np.argsort(seed[pick], kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        pairs[:, 0] = rank[pairs[:, 0]]
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        hashes = seed[pick][order]
        width = min(_BITS, (16 * len(hashes)).bit_length())
        bits = np.zeros(1 << width, dtype=bool)
        bits[hashes >> np.uint64(64 - width)] = True
        return cls(window, window - tolerated(words), mask, before, bits, hashes, row[pick][order], pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)))

    def touched(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a seed of h is one of an item; and the range of contexts that share it."""
        s = seed_hashes(h, self.mask)
        at = np.nonzero(self.bits[s >> np.uint64(65 - len(self.bits).bit_length())])[0]
        begin = np.searchsorted(self.hashes, s[at], "left")
        end = np.searchsorted(self.hashes, s[at], "right")
        hit = end > begin
        return at[hit], begin[hit], end[hit]

    def matched(self, h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(item, places, what is there) of verified overlaps: a bit for a covered word, two for an
        agreeing one. Distinct contexts of the document meet distinct ones of the items, PAIRS at a
        time, so a word repeated without end in both is one pair."""
        at, begin, end = self.touched(h)
        if not len(at):
            return
        size = self.contexts.shape[1]
        padded = np.concatenate([np.full(self.before, _NO_DOC), h, np.full(size, _NO_DOC)])
        views = np.lib.stride_tricks.sliding_window_view(padded, size)
        pick, of = _classes(views[at])
        rows, begin, many = views[at[pick]], begin[pick], (end - begin)[pick]
        stop = np.cumsum(many)
        found: dict[int, dict[int, np.ndarray]] = {}
        for lo in range(0, int(stop[-1]), PAIRS):
            pair = np.arange(lo, min(lo + PAIRS, int(stop[-1])))
            d = np.searchsorted(stop, pair, "right")
            c = begin[d] + pair - (stop[d] - many[d])
            mine, theirs = rows[d], self.contexts[c]
            sums = np.pad(np.cumsum(mine == theirs, axis=1), ((0, 0), (1, 0)))
            blank = np.pad(np.cumsum((mine == _NO_DOC) | (theirs == _NO_ITEM), axis=1), ((0, 0), (1, 0)))
            w = self.window
            good = (sums[:, w:] - sums[:, :-w] >= self.need) & (blank[:, w:] == blank[:, :-w])
            hit = np.nonzero(good.any(axis=1))[0]
            covered = np.zeros((len(hit), size), dtype=bool)
            for o in range(good.shape[1]):
                covered[:, o : o + w] |= good[hit, o][:, None]
            state = covered.astype(np.uint8) | (covered & (mine[hit] == theirs[hit])).astype(np.uint8) << 1
            for k, own, ctx in zip(d[hit].tolist(), state, c[hit].tolist(), strict=True):
                for item in self.holders[self.bounds[ctx] : self.bounds[ctx + 1]].tolist():
                    seen = found.setdefault(item, {})
                    seen[k] = seen[k] | own if k in seen else own
        if not found:
            return
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(pick) + 1))
        for item, seen in found.items():
            places = [at[order[starts[k] : starts[k + 1]]] for k in seen]
            what = np.repeat(np.stack(list(seen.values())), [len(p) for p in places], axis=0)
            yield item, np.concatenate(places) - self.before, what


@dataclass
class SeedIndex:
    """The seeds of some benchmark items, by the masks that their lengths call for."""

    seeds: list[Seeds]
    ids: list[int | None]

    @classmethod
    def build(cls, items: list[tuple[int | None, str | None]], shortest: int = SHORTEST) -> SeedIndex:
        ids, by_length = [], {}
        for i, text in items:
            h = word_hashes(words_of(text, lower=True))
            if len(h) >= max(1, shortest):
                by_length.setdefault(min(len(h), WINDOW), []).append((len(ids), h))
                ids.append(i)
        return cls([Seeds.build(own, n, first, mask) for n, own in sorted(by_length.items()) for first, mask in masks_of(n)], ids)

    def touched(self, h: np.ndarray) -> Iterator[np.ndarray]:
        """Places of h whose seeds are in the index."""
        for s in self.seeds:
            yield s.touched(h)[0]

    def overlaps(self, h: np.ndarray) -> list[tuple[int | None, int, int, int]]:
        """(item id, begin, end, agreeing words) of verified overlaps: the maximal word ranges of the
        document that an item's windows cover, from an agreeing word to an agreeing word."""
        marks: dict[int, np.ndarray] = {}
        for s in self.seeds:
            for item, places, what in s.matched(h):
                state = marks.setdefault(item, np.zeros(len(h), dtype=np.uint8))
                for j in range(what.shape[1]):
                    some = np.nonzero(what[:, j])[0]
                    state[places[some] + j] |= what[some, j]
        out = []
        for item in sorted(marks):
            state = marks[item]
            covered = np.diff(np.concatenate([[0], (state > 0).astype(np.int8), [0]]))
            for begin, end in zip(np.nonzero(covered > 0)[0].tolist(), np.nonzero(covered < 0)[0].tolist(), strict=True):
                agree = np.nonzero(state[begin:end] & 2)[0]
                out.append((self.ids[item], begin + int(agree[0]), begin + int(agree[-1]) + 1, len(agree)))
        return out


def _parts(benchmark: DataFrame, index_words: int) -> int:
    """The number of slices; a word is taken as two bytes at least."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(total) // (2 * index_words)))


def _index(benchmark: DataFrame, part: int, parts: int, shortest: int) -> SeedIndex:
    """The index of a slice: its items, of a bounded size, are all that the driver sees."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct()
    return SeedIndex.build([tuple(r) for r in own.collect()], shortest)


def contaminated(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """``doc_id, n_words, n_overlaps, item_ids, n_covered, overlaps`` of every whole document.

    Words are runs outside white space with A-Z lower-cased. A document overlaps an item if 13
    consecutive words of both, word by word, agree in 11 or more places. An item of fewer words has
    to be there whole, if of 8 to 12 words with one in five changed at most; an item of fewer than
    ``shortest`` words is no evidence and is ignored (1: none is). ``overlaps`` holds the maximal
    word ranges that an item's windows cover, by item and place, ``n_covered`` the words in their
    union. Items without an id are searched too and named by null; equal items are one. Null and
    empty texts overlap nothing; rows are judged one by one, so repeats and equal ids keep their
    own; other columns aren't read; empty tables are fine on both sides.

    Seeds of the benchmark meet seeds of the documents by hash; around a hit, the distinct contexts
    of both sides are compared, a bounded number at a time, so a word or a phrase repeated without
    end costs one comparison. The benchmark's side is broadcast in slices of at most
    ``index_words`` words (an item is never cut), one after another: a large benchmark takes more
    passes over the documents, not more memory. Documents aren't shuffled.
    """
    parts = _parts(benchmark, index_words)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts == 1:
        return _summary(_searched(rows, _index(benchmark, 0, 1, shortest), "doc_id"))
    # A pass for each slice writes the rows with hits; numbers of their own put the passes together.
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    hits = None
    for part in range(parts):
        found = _searched(rows, _index(benchmark, part, parts, shortest), "row", done=True).where(F.size("overlaps") > 0)
        hits = found if hits is None else hits.unionByName(found)
    order = lambda o: F.struct(o["item_id"].alias("item_id"), o["begin"].alias("begin"), o["end"].alias("end"), o["agree"].alias("agree"))
    merged = hits.groupBy("row").agg(F.array_sort(F.transform(F.flatten(F.collect_list("overlaps")), order)).alias("overlaps"))
    counted = _searched(rows, SeedIndex([], []), "doc_id", "row").drop("overlaps")
    none = F.array().cast(dict(merged.dtypes)["overlaps"])
    return _summary(counted.join(merged, "row", "left").withColumn("overlaps", F.coalesce("overlaps", none)))


def clean(docs: DataFrame, benchmark: DataFrame, index_words: int = INDEX_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """The rows of docs that overlap no benchmark item (see ``contaminated``), with all columns."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = f"c{docs.columns.index('text')}"
    out, parts = docs.toDF(*names), _parts(benchmark, index_words)
    for part in range(parts):
        found = _searched(out, _index(benchmark, part, parts, shortest), *names, text=text, done=parts > 1)
        out = found.where(F.size("overlaps") == 0).select(*names)
    return out.toDF(*docs.columns)


def _searched(rows: DataFrame, index: SeedIndex, *keep: str, text: str = "text", done: bool = False) -> DataFrame:
    """The kept columns of every row, its number of words and its overlaps; written at once, and the
    index taken back from the executors, if ``done``."""
    shared = rows.sparkSession.sparkContext.broadcast(index)
    fields = pa.struct([("item_id", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("agree", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        gap = np.zeros(WINDOW, dtype=np.uint64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hashes = [word_hashes(words_of(t.as_py(), lower=True)) for t in batch.column(text)]
                # All documents are probed at once; a gap of blank words lies between them.
                joined = np.concatenate([x for h in hashes for x in (h, gap)])
                begins = np.cumsum([0, *(len(h) + WINDOW for h in hashes)])
                hit = set()
                for p in index.touched(joined):
                    hit.update(np.unique(np.searchsorted(begins, p, "right") - 1).tolist())
                spans = [index.overlaps(h) if k in hit else [] for k, h in enumerate(hashes)]
                rows_ = [[dict(zip(("item_id", "begin", "end", "agree"), s, strict=True)) for s in own] for own in spans]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in keep), pa.array([len(h) for h in hashes], pa.int64()), pa.array(rows_, pa.list_(fields))],
                    [*keep, "n_words", "overlaps"],
                )

    kinds = dict(rows.dtypes)
    kept = "".join(f"{k} {kinds[k]}, " for k in keep)
    schema = f"{kept}n_words long, overlaps array<struct<item_id:long,begin:int,end:int,agree:int>>"
    found = rows.select(*dict.fromkeys([*keep, text])).mapInArrow(releasing(run), schema)
    if done:
        found = cut(found)
        shared.unpersist()
    return found


def _summary(found: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.transform("overlaps", lambda o: F.struct(o["begin"].alias("begin"), o["end"].alias("end"))))
    step = lambda acc, o: F.struct(
        (acc["n"] + F.greatest(F.lit(0), o["end"] - F.greatest(o["begin"], acc["upto"]))).alias("n"), F.greatest(acc["upto"], o["end"]).alias("upto")
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("overlaps").alias("n_overlaps"),
        F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item_id"]))).alias("item_ids"),
        F.aggregate(ordered, start, step, lambda a: a["n"]).cast("long").alias("n_covered"),
        "overlaps",
    )
