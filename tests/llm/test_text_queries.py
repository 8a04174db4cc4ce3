"""The registered queries, over whole small tables, against SQL or brute force."""

import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from test_decontaminate import naive as naive_overlaps
from test_simhash import brute, naive_print

from tidemark.llm import queries as Q
from tidemark.llm.packing import END_ID, position_ids
from tidemark.llm.tokenizers_ import BYTE_BPE_RANKS, PIECES, rank_encoding, vocabulary_path

SF = "/root/testdata/sf0.001"
DOCS = pq.read_table(f"{SF}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF), con.sql(Q.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_op1(spark):
    prints = [(d["doc_id"], naive_print(d["text"])) for d in DOCS]
    want = brute(prints)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in Q.op1_simhash(spark, SF).collect()}
    assert got == {(i, f"{f:016x}", want[i]) for i, f in prints}


def test_op4(spark):
    own = rank_encoding(vocabulary_path(BYTE_BPE_RANKS))
    found: dict = {}
    for r in Q.op4_packing(spark, SF).collect():
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(position_ids(r.cu_seqlens)) == len(ids)
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            found.setdefault(d, []).append((s, ids[a:b].tolist()))
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in found.items()} == {d["doc_id"]: [*own.encode_ordinary(d["text"] or ""), END_ID] for d in DOCS}


def test_op5(spark):
    items = [tuple(r.values()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    got = {r.doc_id: r.item_ids for r in Q.op5_spaced_seeds(spark, SF).collect()}
    assert got == {d["doc_id"]: sorted(naive_overlaps(d["text"], items)) for d in DOCS}


def test_op7(spark):
    rows = Q.op7_pairwise_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(d["doc_id"] for d in DOCS)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in rows)


def test_op8(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = set()
    for d in DOCS:
        ids = library.encode(d["text"] or "")
        want.add((d["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in Q.op8_pieces(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want


def test_op10(spark):
    rows = Q.op10_resharding(spark, SF).collect()
    want = sorted((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in DOCS)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by: dict = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(by) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
