import hashlib
import random

import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces as P
from tidemark.llm.tokenizers_ import PIECES, vocabulary_path


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path(PIECES)
    return P.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


ODD = ["", " ", "  ", "     x", "a" * 50, "\n\n", " \n ", "\t", "▁", "▁▁a", "<s>", "</s>", "<0x41>", "<unk>", "é日本語🙂", "\x00", "�", "x  y   z    w     v" + " " * 37, "Der " * 99, "é", "  " * 40 + "t", "\r\n", "  　"]


def test_odd_texts(both):
    own, library = both
    for t in ODD:
        assert own.encode(t) == library.encode(t), repr(t)
        assert own.decode(library.encode(t)) == library.decode(library.encode(t)), repr(t)
    assert own.encode(None) == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from([" ", "  ", "the", "ing", "\n", "ation", "▁", "aaaa", "1234", "er", "tt"])), max_size=20).map("".join))
def test_random_texts(both, text):
    own, library = both
    text = text.encode("utf-8", "ignore").decode()
    ids = library.encode(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids)


def test_letters(both):
    own, library = both
    rng = random.Random(0)
    for _ in range(1500):
        t = "".join(rng.choice("etaoinshr dlu-.'") for _ in range(rng.randrange(40)))
        assert own.encode(t) == library.encode(t), t
    for _ in range(300):
        ids = [rng.randrange(32000) for _ in range(12)]
        assert own.decode(ids) == library.decode(ids), ids


def test_documents(both, spark):
    own, library = both
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + [None, "", " x"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r for r in P.encode_documents(df).collect()}
    for r in P.digest_documents(df).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert got[r.doc_id].ids == ids
        assert got[r.doc_id].decoded == library.decode(ids)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert P.encode_documents(df.limit(0)).collect() == []
