import random

import numpy as np
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing as P
from tidemark.llm.tokenizers_ import BYTE_BPE_RANKS, rank_encoding, vocabulary_path

PATH = vocabulary_path(BYTE_BPE_RANKS)


def naive(lengths, room):
    rows, free = [], []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[k]]
        if fits:
            r = min(fits, key=lambda r: free[r])
            rows[r].append(k)
            free[r] -= lengths[k]
        else:
            rows.append([k])
            free.append(room - lengths[k])
    return sorted(free)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_is_the_naive_one(lengths):
    rows = P.best_fit_decreasing(np.array(lengths, dtype=int), 37)
    assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
    assert sorted(37 - sum(lengths[k] for k in r) for r in rows) == naive(lengths, 37)


def test_both_patterns_agree():
    own = rank_encoding(PATH)
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["the", " ", "\n", "it's", "é", "12", "!!", "  ", "\t", "日", "'ll"]) for _ in range(12))
        assert P.encode(t, PATH).tolist() == [*own.encode_ordinary(t), P.END_ID], repr(t)


def test_round_trip(spark, tmp_path):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    texts += [None, "", " \n ", texts[0], "word " * 20000]
    df = spark.createDataFrame([(i, t, b"", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids binary, n_ids int")
    packed = P.pack_documents(df, row_ids=256, buffer_ids=20_000)
    P.write_packed(packed, str(tmp_path / "m"))
    own = rank_encoding(PATH)
    found: dict = {}
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    for r in rows:
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == 256 and r.cu_seqlens[-1] == r.n_ids and (ids[r.n_ids :] == P.END_ID).all()
        where = np.frombuffer(r.positions, dtype="<u2")
        assert len(where) == 256 and (where == P.position_ids(r.cu_seqlens, 256)).all()
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert where[a:b].tolist() == list(range(b - a))
            found.setdefault(d, []).append((s, ids[a:b].tolist()))
    for i, t in enumerate(texts):
        assert sum((p for _, p in sorted(found[i])), []) == [*own.encode_ordinary(t or ""), P.END_ID]
    assert sum(r.n_ids for r in rows) > 0.97 * 256 * len(rows)
    assert P.pack_documents(df.limit(0)).collect() == []


def test_small_partitions_leave_full_rows(spark):
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = P.pack_documents(df.repartition(100), row_ids=512).collect()
    assert sum(r.n_ids for r in rows) > 0.97 * 512 * len(rows)
    assert sorted({d for r in rows for d in r.doc_ids}) == list(range(len(texts)))
