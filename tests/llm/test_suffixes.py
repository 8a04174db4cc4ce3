import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import suffixes as S


def naive(rows, window):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - window + 1):
                g = raw[k : k + window]
                if first.get(g, i + 1) > i:
                    first[g] = i
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, dtype=int)
        for k in range(len(raw) - window + 1):
            if i is not None and first[raw[k : k + window]] < i:
                gone[k] += 1
                gone[k + window] -= 1 if k + window < len(gone) else 0
        c = np.cumsum(gone)[:-1] > 0
        kept = bytes(b for b, g in zip(raw, c, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        out.append((i if i is not None else -9, len(raw), int(c.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df, **k):
    return sorted((r.doc_id if r.doc_id is not None else -9, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.deduplicate_bytes(df, **k).collect())


def test_columns_sort_suffixes(tmp_path):
    rng = random.Random(4)
    rows = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    begin = np.array([rng.randrange(15 - len(r)) for r in rows])
    matrix = np.zeros((60, 15), dtype=np.uint8)
    for k, r in enumerate(rows):
        matrix[k, begin[k] : begin[k] + len(r)] = list(r)
    end = begin + np.array([len(r) for r in rows])
    for folder in (str(tmp_path), None):
        with S.external_files(folder) as files:
            rounds = [(c, o.copy(), x.copy()) for c, o, x in S.ColumnSuffixes(matrix, begin, end, files).rounds()]
    assert not list(tmp_path.iterdir()) and len(rounds) == 15
    for column, order, lcp in rounds:
        own = [bytes(matrix[k, column : end[k]]) for k in range(60) if begin[k] <= column < end[k]]
        found = [bytes(matrix[k, column : end[k]]) for k in order]
        assert found == sorted(own)
        for a, b, n in zip(found, found[1:], lcp[1:], strict=False):
            want = next((x for x in range(min(len(a), len(b))) if a[x] != b[x]), min(len(a), len(b)))
            assert n == want


def texts():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    common = [say(n) for n in (49, 50, 51, 60, 200)]
    out = []
    for _ in range(150):
        t = say(rng.randrange(80))
        for _ in range(rng.randrange(3)):
            t += rng.choice(common)[rng.randrange(3) :] + say(rng.randrange(60))
        out.append(t)
    return out + [out[0], out[0], None, "", " ", "Der " * 300, "Der " * 30, "ab" * 100, "x" * 700, "x" * 49, "x" * 50, "\x00" * 60, "é" * 90, common[4]]


def test_against_brute_force(spark):
    own = texts()
    ids = list(range(0, 2 * len(own), 2))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, own, strict=True)) + [(7, own[5]), (7, own[5]), (None, own[5]), (None, own[-1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, bucket int, n_bytes int")
    for chunk_bytes in (1 << 20, 1500):
        assert got(df, chunk_bytes=chunk_bytes) == naive(rows, 50)
    assert got(df, window=20, anchor=7, chunk_bytes=4000) == naive(rows, 20)
    # Windows of hot anchors go by their own hash: all shared anchors, and some of them.
    for hot in (1, 3, 70):
        assert got(df, chunk_bytes=1500, hot=hot) == naive(rows, 50)


def test_a_string_in_every_document(spark):
    """One anchor in all texts, in different surroundings and at the ends of a common passage."""
    rng = random.Random(3)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, passage = "All rights kept.", say(90)
    rows = [(i, say(30) + line + say(40) + passage[: rng.choice([45, 60, 90])] + say(20) + line) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = naive(rows, 50)
    assert sum(w[2] for w in want) > 0
    for hot in (S.HOT, 8):
        assert got(df, chunk_bytes=1000, hot=hot) == want


def test_repeated_rows_are_not_one_chunk(spark):
    rows = [(5, "the same text again and again, longer than fifty bytes, of one document")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    from tidemark.llm.exchange import chunked

    assert chunked(df, 1000)[0].select("chunk").distinct().count() > 3
    assert got(df, chunk_bytes=1000) == naive(rows, 50)


def test_places_beyond_a_stretch(monkeypatch):
    """Anchors don't depend on where a text is cut for the search of least hashes."""
    import pyarrow as pa

    rows = pa.table({"doc_id": [1, 2], "text": ["".join(random.Random(2).choice("abcd") for _ in range(3000)), "x" * 500]})
    whole = S._Bytes(rows, 50, 16)
    monkeypatch.setattr(S, "STRETCH", 97)
    parts = S._Bytes(rows, 50, 16)
    for name in ("s", "e", "offset", "anchor", "row"):
        assert (getattr(whole, name) == getattr(parts, name)).all()


def test_clashes_of_one_lane_are_told_apart():
    import pyarrow as pa

    own = S._Bytes(pa.table({"doc_id": list(range(150)), "text": texts()[:150]}), 50, 16)
    at = np.arange(len(own.s))
    h, g = own.piece_hashes(at)
    (h, g, least, most), at = S._distinct(h, g, own.id[own.row[at]], at)
    size = (own.e[at] - own.s[at]).astype(np.uint8)
    raw = np.concatenate([own.raw[own.s[k] : own.e[k]] for k in at])
    answers = [S._piece_answers(x, g, least, most, size, own.offset[at].astype(np.uint8), raw, 50, 16, None) for x in (h, np.zeros_like(h))]
    told = [{(int(g[k]), int(a[1][a[0][k]] - a[1][a[0][k]])): [(int(v), int(x), int(y)) for v, x, y in zip(*(c[a[1][a[0][k]] : a[1][a[0][k]] + a[2][a[0][k]]] for c in a[3:]), strict=True)] for k in range(len(g))} for a in answers]
    assert told[0] == told[1] and any(told[0].values())
    keys = np.array([3, 3, 3, 9], dtype=np.uint64)
    also = np.array([5, 6, 7, 5], dtype=np.uint64)
    assert S.pair_lookup(keys, also, np.array([3, 3, 9, 9, 1, 10], dtype=np.uint64), np.array([7, 8, 5, 6, 5, 5], dtype=np.uint64)).tolist() == [2, -1, 3, -1, -1, -1]


def test_documents(spark):
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))
    assert got(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), chunk_bytes=60_000) == naive(rows, 50)


def test_empty(spark):
    assert S.deduplicate_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert got(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")) == naive([(1, None), (2, "")], 50)


def test_cut_text():
    assert S.cut_text("héllo", [(1, 2)]) == "hllo"
    assert S.cut_text("abc", []) == "abc" and S.cut_text(None, []) is None
    assert S.cut_text("abcdef", [(0, 2), (4, 6)]) == "cd"
