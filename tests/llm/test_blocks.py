import hashlib
import random

import pyarrow.parquet as pq

from tidemark.llm import blocks as B


def naive(rows, window):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k : k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i if i is not None else -9, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts():
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(60)] + ["é", "X"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    common = [say(n) for n in (13, 14, 12, 30, 80)]
    out = []
    for _ in range(120):
        w = say(rng.randrange(40))
        for _ in range(rng.randrange(3)):
            w += rng.choice(common)[rng.randrange(3) :] + say(rng.randrange(20))
        out.append((rng.choice(["\n", " ", " \t "])).join(w))
    out += [out[0], out[0], None, "", " ", "Der " * 400, "Der " * 30, "a b " * 40, "\x1c".join(say(5)), " ".join(common[4])]
    return out


def got(df, **k):
    return sorted((r.doc_id if r.doc_id is not None else -9, r.n_words, r.n_removed, r.kept_sha256) for r in B.deduplicate_words(df, **k).collect())


def test_against_brute_force(spark):
    rng = random.Random(2)
    own = texts()
    ids = list(range(0, 3 * len(own), 3))
    rng.shuffle(ids)
    rows = list(zip(ids, own, strict=True)) + [(5, own[3]), (5, own[3]), (None, own[3]), (None, own[90])]
    df = spark.createDataFrame([(i, t, 7, ["z"]) for i, t in rows], "doc_id long, text string, chunk int, spans array<string>")
    for chunk_bytes in (1 << 20, 2000):
        assert got(df, chunk_bytes=chunk_bytes) == naive(rows, 13)
    assert got(df, window=4, chunk_bytes=5000) == naive(rows, 4)
    for r in B.deduplicate_words(df).collect():
        assert sum(s.end - s.begin for s in r.spans) == r.n_removed


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(df, chunk_bytes=200_000) == naive(rows, 13)


def test_empty(spark):
    assert B.deduplicate_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == naive([(1, None), (2, "")], 13)
