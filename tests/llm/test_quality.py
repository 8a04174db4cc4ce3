import math
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_features_are_finite_for_odd_texts():
    for t in [None, "", " \n", "a", "é" * 5, "x " * 50000, "\n\n\n", "| | |", "\x00"]:
        assert np.isfinite(Q.features(t)).all()
    assert not Q.features(None).any() and not Q.features(" \n").any()


def test_pairs_order_scores():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + 0.2 * rng.normal(size=600) > -1).astype(int)
    m = Q.fit_pairs(x, y)
    s = m.scores(x)
    assert s[y == 1].mean() > s[y == 0].mean() + 0.5
    assert abs((s < 0.5).mean() - (y == 0).mean()) < 0.02
    one = Q.fit_pairs(x, np.ones(600, dtype=int))
    assert (one.scores(x) == 0.5).all()
    none = Q.fit_pairs(np.zeros((0, 4)), np.zeros(0, dtype=int))
    assert (none.scores(x) == 0.5).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in Q.score_documents(docs, Q.train(docs, labels)).collect()}
    rows = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(held) > 1000 and all(got[r["doc_id"]].held_out for r in held)
    right = [got[r["doc_id"]].predicted == r["quality"] for r in held]
    assert np.mean(right) > 0.98
    clean = [got[r["doc_id"]].predicted for r in held if r["quality"] == 1]
    assert np.mean(clean) > 0.99


def test_rows(spark):
    docs = spark.createDataFrame(
        [(1, "A fine text.", 5.0), (1, "A fine text.", 5.0), (None, None, None), (2, "", 0.1)], "doc_id long, text string, score double"
    )
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (2, 7, "x"), (None, 0, "x"), (9, None, "x")], "doc_id long, quality int, text string")
    got = Q.score_documents(docs, Q.train(docs, labels)).collect()
    assert len(got) == 4
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert sorted((r.doc_id or 0, r.held_out) for r in got) == sorted(
        [(i or 0, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in (1, 1, None, 2)]
    )
    assert Q.score_documents(docs.limit(0), Q.train(docs.limit(0), labels)).collect() == []
    assert Q.train(docs, labels.limit(0)).weight == (0.0,) * len(Q.FEATURES)


@pytest.mark.parametrize("rows", [50])
def test_the_fit_is_bounded(spark, rows):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a, b = Q.train(docs, labels, rows=rows), Q.train(docs.repartition(7), labels, rows=rows)
    assert np.allclose(a.weight, b.weight)


def plain_features(text):
    """The same figures character by character, written apart from the operator's tables."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(Q.FEATURES)
    kinds = dict.fromkeys([*(n for n, _ in Q._LETTER_CLASSES), "high"], 0)
    for b in raw:
        name = "high" if b >= 128 else next((n for n, own in Q._LETTER_CLASSES if bytes([b]) in [bytes([c]) for c in own]), None)
        if name:
            kinds[name] += 1
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x]
    repeated = sum(words[k] == words[k + 1] for k in range(n - 1))
    return [(c / len(raw)) ** 0.5 for c in kinds.values()] + [
        math.log(1 + n) / 10,
        math.log(1 + sum(len(w) for w in words) / n) / 3,
        len(set(words)) / n**0.9,
        (max(Counter(words).values()) - 1) / (n + 10),
        repeated / (n + 10),
        1 - len(set(lines)) / max(1, len(lines)),
        sum(len(w) > 25 for w in words) / n,
        sum(not chr(w[-1]).isalnum() and w[-1] < 128 and w[-1] not in b".," for w in words) / n,
    ]


def test_query_against_a_plain_fit(spark):
    """Features, fit and scores of the registered query, all worked out another way."""
    from tidemark.llm.queries import op7_pairwise_quality

    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    labels = [(r["doc_id"], r["quality"]) for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    x = np.array([plain_features(docs[i]) for i, _ in labels])
    y = np.array([q for _, q in labels])
    assert len(labels) < Q.FIT_ROWS
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) < 1e-9, np.inf, x.std(axis=0))
    # The operator draws preference pairs; here each pair of one label 1 and one label 0 counts.
    d = (z[y == 1][:, None, :] - z[y == 0][None, :, :]).reshape(-1, z.shape[1])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))
        curve = np.einsum("n,ni,nj->ij", p * (1 - p), d, d, optimize=True) / len(d) + 2e-3 * np.eye(len(w))
        w += 0.7 * np.linalg.solve(curve, (p @ d) / len(d) - 2e-3 * w)
    s = z @ w
    cut = np.quantile(s, (y == 0).mean(), method="midpoint")
    got = {r.doc_id: r for r in op7_pairwise_quality(spark, SF).collect()}
    assert sorted(got) == sorted(docs)
    mine, agree = [], 0
    for i, t in docs.items():
        own = ((np.array(plain_features(t)) - x.mean(axis=0)) / np.where(x.std(axis=0) < 1e-9, np.inf, x.std(axis=0))) @ w - cut
        mine.append(own)
        agree += (own >= 0) == bool(got[i].predicted)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and got[i].predicted == int(got[i].score >= 0.5)
    theirs = np.array([got[i].score for i in docs])
    rank = lambda v: np.argsort(np.argsort(v))
    order = np.corrcoef(rank(np.array(mine)), rank(theirs))[0, 1]
    assert order > 0.99 and agree >= 0.985 * len(docs), (order, agree, len(docs))


def test_fit_is_a_minimum_of_its_loss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=300) > 0).astype(int)
    m = Q.fit_pairs(x, y, pairs=4000)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    draws = np.random.default_rng(11)
    good, bad = z[y == 1], z[y == 0]
    d = good[draws.integers(len(good), size=4000)] - bad[draws.integers(len(bad), size=4000)]
    w = np.array(m.weight) * x.std(axis=0)
    loss = lambda v: sum(math.log(1 + math.exp(-float(r @ v))) for r in d) / len(d) + 1e-3 * float(v @ v)
    base = loss(w)
    assert all(loss(w + e) > base for k in range(3) for e in (np.eye(3)[k] * 1e-2, -np.eye(3)[k] * 1e-2))
