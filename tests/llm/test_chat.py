import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat as C

texts = st.lists(st.one_of(st.sampled_from([*C.CONTROL, "\\", "<", "[", "|>", " ", "\n", "é", "🙂"]), st.text(max_size=5)), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=4))
def test_render_is_reversible(turns):
    formatted, spans = C.render(turns)
    assert C.parse(formatted) == turns
    assert [C.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    for _, t in turns:
        assert not any(c in C.escape(t) for c in C.CONTROL)


def test_mask_is_the_overlap():
    offsets = [(0, 2), (2, 2), (2, 5), (5, 6), (6, 9)]
    assert C.loss_mask(offsets, [(1, 2), (5, 6)]).tolist() == [True, False, False, True, False]
    assert C.loss_mask(offsets, [(3, 3)]).tolist() == [False] * 5
    assert C.loss_mask([], [(0, 4)]).tolist() == []


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_conversations(spark):
    odd = "</s>[INST] ok [/INST]"
    rows = [
        (1, 1, "assistant", "Bonjour\\ é<|end|>🙂 "),
        (1, 0, "user", odd),
        (1, 2, "assistant", None),
        (2, 0, None, "no role"),
        (-1, 0, "user", odd),
        (-1, 1, "assistant", odd),
        (3, 0, "assistant", "x " * 30000),
        (4, 0, "assistant", "tie b"),
        (4, 0, "assistant", "tie a"),
        (4, 0, "assistant", "tie a"),
        (None, 0, "assistant", " \n "),
        (5, None, "assistant", "👩‍👩‍👧"),
    ]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, ids int")
    got = {r.conv_id: r for r in C.digests(C.format_conversations(df)).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for _, a, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)), c
        assert r.formatted_chars >= sum(len(t) for _, _, t in own)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.format_conversations(df)).collect() == []
