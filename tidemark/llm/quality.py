"""Document quality by Bradley-Terry pairwise ranking."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import releasing

#: Labelled rows that the model is fitted on: a fixed bound, drawn by a hash of the id.
FIT_ROWS = 12_000
#: Preference pairs drawn from them.
FIT_PAIRS = 60_000
_LETTER_CLASSES = (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("digit", b"0123456789"), ("space", b" \t"), ("line", b"\r\n"), ("stop", b".,;:"), ("shout", b"!?"), ("bar", b"|"), ("symbol", b"#$%&*"), ("mark", b"<>[]{}()/\\=_+^~@`"), ("quote", b"\"'-"))
FEATURES = (*(name for name, _ in _LETTER_CLASSES), "high", "log_words", "word_length", "distinct_words", "top_word", "repeated_word", "repeated_line", "long_word", "symbol_word")
_CLASS_OF = np.full(256, len(_LETTER_CLASSES), dtype=np.intp)
for _at, (_, _bytes) in enumerate(_LETTER_CLASSES):
    _CLASS_OF[list(_bytes)] = _at
_CLASS_OF[:128][_CLASS_OF[:128] == len(_LETTER_CLASSES)] = len(_LETTER_CLASSES) + 1


def features(text: str | None) -> np.ndarray:
    """Shares and shapes of a whole text; all zero for a null or blank one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS_OF, weights=counts, minlength=len(_LETTER_CLASSES) + 2) / len(raw)
    k = len(_LETTER_CLASSES) + 1
    out[:k] = np.sqrt(shares[:k])
    seen = Counter(words)
    # Distinct words fall with length by themselves, so they are judged against n to the power 0.9;
    # a repeat says little in a text of a few words.
    lines = [x for x in raw.split(b"\n") if x]
    out[k:] = (
        np.log1p(n) / 10,
        np.log1p(sum(map(len, words)) / n) / 3,
        len(seen) / n**0.9,
        (max(seen.values()) - 1) / (n + 10),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / (n + 10),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) > 25 for w in words) / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in (b".", b",") for w in words) / n,
    )
    return out


@dataclass(frozen=True)
class Ranker:
    """score(text) = logistic((w . x - threshold) / scale); documents under 0.5 are rejected."""

    mean: tuple[float, ...]
    weight: tuple[float, ...]
    threshold: float
    scale: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - np.array(self.mean)) @ np.array(self.weight) - self.threshold) / self.scale
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = FIT_PAIRS, ridge: float = 1e-3, seed: int = 11) -> Ranker:
    """Bradley-Terry weights from pairs of one row of label 1 and one of label 0.

    The loss is -log logistic(w . (x1 - x0)), averaged over drawn pairs, plus a ridge; solved by
    Newton steps. The threshold is the quantile of the rows' scores at the share of label 0.
    Without both labels all weights are zero, so every document scores 0.5.
    """
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranker((0.0,) * x.shape[1], (0.0,) * x.shape[1], 0.0, 1.0)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread < 1e-9] = np.inf
    good, bad = (good - mean) / spread, (bad - mean) / spread
    rng = np.random.default_rng(seed)
    d = good[rng.integers(len(good), size=pairs)] - bad[rng.integers(len(bad), size=pairs)]
    w = np.zeros(x.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, -(d @ v)).mean() + ridge * (v @ v))

    for _ in range(50):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        gradient = -(d * p[:, None]).mean(axis=0) + 2 * ridge * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 2 * ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-7:
            break
    s = ((x - mean) / spread) @ w
    threshold = float(np.quantile(s, (y == 0).mean(), method="midpoint"))
    return Ranker(tuple(mean), tuple(np.where(np.isinf(spread), 0, w / spread)), threshold, 1.0)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows whose labels are never learned: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Ranker:
    """Fit on at most ``rows`` labelled documents outside the held-out third.

    Labels other than 0 and 1, and ids that are null or missing from either table, are left out;
    the rows with the smallest hash of id and text are taken, so a rerun takes the same ones.
    """
    wanted = labels.where(F.col("quality").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    wanted = wanted.orderBy(F.xxhash64("_id", "_y"), "_id").limit(rows)
    both = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_id"))
    k = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64())), batch.column(2)], ["doc_id", "x", "y"])

    found = both.select(F.col("doc_id").cast("long"), "text", "_y").mapInArrow(releasing(run), "doc_id long, x array<double>, y int")
    # Repeated ids may give more rows than labels; the bound holds for what reaches the driver.
    got = found.orderBy("doc_id", "y", "x").limit(rows).toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, k)
    return fit_pairs(x, got.column("y").to_numpy())


def _scored(docs: DataFrame, model: Ranker, keep: list[str], least: float | None = None) -> DataFrame:
    """The kept columns as c0, c1, ... and ``score``, for every row that scores ``least`` or more."""
    names = [f"c{i}" for i in range(len(keep))]
    text = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                score = model.scores(np.array([features(t.as_py()) for t in batch.column(text)]))
                out = pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], [*names, "score"])
                yield out if least is None else out.filter(pa.array(score >= least))

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True)) + ", score double"
    given = [F.col(c).alias(n) for n, c in zip(names, keep, strict=True)] + ([] if "text" in keep else [F.col("text").alias("t")])
    return docs.select(*given).mapInArrow(releasing(run), schema)


def score_documents(docs: DataFrame, model: Ranker) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of docs.

    Only the text is an input. Null, empty and blank texts have zero features and are scored like
    any other; equal texts have equal scores; other columns are ignored; an empty table gives an
    empty one.
    """
    return _scored(docs, model, ["doc_id"]).select(
        F.col("c0").alias("doc_id"),
        held_out(F.col("c0").cast("string")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, model: Ranker) -> DataFrame:
    """The rows of docs that the model scores 0.5 or more, with all their columns."""
    scored = _scored(docs, model, docs.columns, least=0.5)
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
