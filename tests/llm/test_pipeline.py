import random

import corpus_pipeline as C
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import suffixes as S
from tidemark.llm.common import UnionFind
from tidemark.llm.components import connected_components
from tidemark.llm.simhash import exact_links, near_groups, one_of_each_group
from tidemark.llm.tokenizers_ import PIECES, vocabulary_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else ({tuple(w)} if w else set())


def near_brute(rows, threshold=0.8):
    u = UnionFind()
    own = [(k, sets(r[1])) for k, r in enumerate(rows)]
    for k, x in own:
        for j, y in own[:k]:
            if (not x and not y) or (x or y) and len(x & y) >= threshold * len(x | y) and (x & y):
                u.union(k, j)
    best = {}
    for k, r in enumerate(rows):
        g = u.find(k)
        key = (r[0] is None, r[0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, r[0], r[1])
    return sorted((-1 if i is None else i, t or "") for _, i, t in best.values())


def repeats_brute(rows, window=50):
    first = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - window + 1):
            first[raw[k : k + window]] = min(first.get(raw[k : k + window], i), i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        spans = []
        for k in range(len(raw) - window + 1):
            if first[raw[k : k + window]] < i:
                if spans and spans[-1][1] >= k:
                    spans[-1] = (spans[-1][0], k + window)
                else:
                    spans.append((k, k + window))
        new = S.cut_text(t, spans)
        if new or not t:
            out.append((i, new))
    return out


def near_data():
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 200]))]
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1])):
                if len(w) > 50:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" ".join(w))
    rows += [rows[0], rows[0].upper(), None, "", "  ", "a", "A", "word " * 3000]
    ids = list(range(10, 10 + len(rows)))
    rng.shuffle(ids)
    return [(i, t, "en", "s", len(t or "")) for i, t in zip(ids, rows, strict=True)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_data()
    rows += [rows[3], rows[3], (None, rows[4][1], "x", "y", 3), (None, "only here", "x", "y", 3), (None, "only here", "x", "y", 3)]
    got = one_of_each_group(spark.createDataFrame(rows, COLUMNS))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect())
    assert found == near_brute(rows)


def test_recall_of_near_copies(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows, pairs = [], []
    for g in range(150):
        a = [rng.choice(vocab) for _ in range(200)]
        b = list(a)
        for p in rng.sample(range(200), rng.choice([1, 2, 3, 4])):
            b[p] = rng.choice(vocab)
        pairs.append(len(sets(" ".join(a)) & sets(" ".join(b))) / len(sets(" ".join(a)) | sets(" ".join(b))) >= 0.8)
        rows += [(2 * g, " ".join(a), "", "", 0), (2 * g + 1, " ".join(b), "", "", 0)]
    groups = {r.id: r.kept_id for r in near_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    linked = [groups[2 * g + 1] == 2 * g for g in range(150)]
    assert not any(x and not y for x, y in zip(linked, pairs, strict=True))
    assert sum(linked) >= 0.95 * sum(pairs)


def edits_of_one_template(n, edits, seed=1, words=200):
    """Texts that lie around a similarity of 0.8 of each other."""
    rng = random.Random(seed)
    base = [f"t{rng.randrange(9000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for p in rng.sample(range(words), rng.choice(edits)):
            w[p] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "", "", 0))
    return rows


def groups_brute(rows, threshold=0.8):
    u, own = UnionFind(), [sets(r[1]) for r in rows]
    for k, x in enumerate(own):
        for j, y in enumerate(own[:k]):
            if (c := len(x & y)) >= threshold * (len(x) + len(y) - c):
                u.union(rows[k][0], rows[j][0])
    return {r[0]: u.find(r[0]) for r in rows}


@pytest.mark.parametrize("edits", [(3, 4, 5, 6), (2, 5, 6, 7)])
def test_false_candidates_replace_no_true_link(spark, edits):
    rows = edits_of_one_template(400, edits)
    want = groups_brute(rows)
    assert 300 < len(set(want.values())) < 340
    got = {r.id: r.kept_id for r in near_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == want


def copies_that_repeat_a_line(pairs, body=200, line=12, seed=4):
    """Texts with a line once, and the same with it 5, 10 or 30 times more; next to equal sets."""
    rng = random.Random(seed)
    rows = []
    for g in range(pairs):
        own = " ".join(f"b{rng.randrange(10**6)}" for _ in range(body))
        again = " ".join(f"l{rng.randrange(10**6)}" for _ in range(line))
        rows += [(2 * g, f"{own} {again} {again}", "", "", 0), (2 * g + 1, f"{own} {again} {' '.join([again] * rng.choice([5, 10, 30]))}", "", "", 0)]
    return rows


def test_copies_that_differ_in_how_often_a_line_repeats(spark):
    rows = copies_that_repeat_a_line(60)
    assert all(sets(a[1]) == sets(b[1]) for a, b in zip(rows[::2], rows[1::2], strict=True))
    got = {r.id: r.kept_id for r in near_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def short_copies(pairs, words, more, seed=6):
    """Texts of so many words, and the same with some words more at the end."""
    rng = random.Random(seed)
    rows = []
    for g in range(pairs):
        own = [f"s{rng.randrange(10**6)}" for _ in range(words + more)]
        rows += [(2 * g, " ".join(own[:words]), "", "", 0), (2 * g + 1, " ".join(own), "", "", 0)]
    return rows


def test_short_texts_are_joined_exactly(spark):
    rows = short_copies(150, 8, 1)
    got = {r.id: r.kept_id for r in near_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}


def test_recall_by_pair_and_by_document(spark):
    """20 families of 30 texts around a similarity of 0.8, against all pairs."""
    rows = []
    for f in range(20):
        rows += [(1000 * f + i, t, *rest) for i, t, *rest in edits_of_one_template(30, (2, 3, 4, 5, 6), seed=50 + f, words=300)]
    want = groups_brute(rows)
    got = {r.id: r.kept_id for r in near_groups(spark.createDataFrame(rows, COLUMNS)).collect()}
    own = [(r[0], sets(r[1])) for r in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(own) for b, y in own[:k] if (c := len(x & y)) >= 0.8 * (len(x) + len(y) - c)]
    assert len(pairs) > 400 and all(got[i] in (want[i], i) or want[got[i]] == want[i] for i in want)
    joined = sum(got[a] == got[b] for a, b in pairs)
    gone, found = (sum(g[i] != i for i in want) for g in (want, got))
    print(f"pairs {joined} of {len(pairs)}, documents {found} of {gone}")
    assert joined >= 0.98 * len(pairs) and found >= 0.98 * gone


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_are_shuffled_twice_at_most(spark):
    """Once to be compared and once to be kept; no sets of shingles beside them."""
    rows = edits_of_one_template(8, (20,), words=4000) + [(100 + i, *edits_of_one_template(1, (1,), seed=100 + i, words=4000)[0][1:]) for i in range(150)]
    rows += [(1000 + r[0], r[1] + " more", *r[2:]) for r in rows[:80]]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(4).checkpoint()
    before = shuffled(spark)
    docs.repartition(4).write.format("noop").mode("overwrite").save()
    once = shuffled(spark) - before
    assert one_of_each_group(docs).count() == 151
    before = shuffled(spark)
    one_of_each_group(docs).write.format("noop").mode("overwrite").save()
    after = shuffled(spark) - before
    print(f"{after} bytes, {after / once:.2f} of the texts")
    assert after < 3 * once


def test_rows_that_repeat_with_and_without_a_number(spark):
    """Of rows with one text and doc_id one stays, with its columns, whatever the text."""
    long = edits_of_one_template(1, (1,))[0][1]
    rows = [(i, t, "en", "s", 1) for t in (long, "a b", "", None) for i in (3, 3, 4, None, None)]
    got = one_of_each_group(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted((r.doc_id, (r.text or "").strip(), r.lang, r.n_chars) for r in got) == sorted([(3, long, "en", 1), (3, "a b", "en", 1), (3, "", "en", 1)])
    none = one_of_each_group(spark.createDataFrame([(None, t, "en", "s", 1) for t in (long, long, "a b", "a b")], COLUMNS)).collect()
    assert sorted((r.doc_id is None, r.text) for r in none) == sorted([(True, long), (True, "a b")])


def test_all_texts_joined_exactly(spark):
    rows = edits_of_one_template(60, (3, 4, 5, 6))
    got = {r.id: r.kept_id for r in near_groups(spark.createDataFrame(rows, COLUMNS), short=None).collect()}
    assert got == groups_brute(rows)


def test_exact_links_over_split_keys(spark):
    rows = edits_of_one_template(120, (3, 4, 5), seed=2)
    want = groups_brute(rows)
    hashed = [(1, i, sorted({hash(x) for x in sets(t)})) for i, t, *_ in rows]
    df = spark.createDataFrame(hashed, "key long, v long, shingles array<long>")
    for part in (1 << 20, 10_000):
        links = exact_links(df, "key", 0.8, part)
        found = {r.id: r.component for r in connected_components(links).collect()}
        assert {i: found.get(i, i) for i in want} == want
    assert exact_links(df.withColumn("key", F.col("v")), "key", 0.8).count() == 0


def test_each_stage_keeps_columns_and_takes_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in C.STAGES:
        out = stage(spark, empty, "/root/testdata/sf0.001")
        assert out.collect() == []
        if name != "pieces":
            assert out.columns == empty.columns and out.dtypes == empty.dtypes
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, 0), (None, "x", "c0", "score", 1)], COLUMNS)
    for _, stage in C.STAGES:
        assert stage(spark, odd, "/root/testdata/sf0.001").count() <= 3


def test_columns_with_clashing_names(spark):
    """Names that the operators use inside are only names of columns to carry along."""
    names = "row h1 h2 v id _id g c0 c1 score overlaps n_words shingles chunk bucket data spans kept_text ids n_tokens short loose label part i j key".split()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in C.STAGES:
        plain, out = stage(spark, docs, "/root/testdata/sf0.001"), stage(spark, wide, "/root/testdata/sf0.001")
        got = out.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in plain.collect()), name
        if name != "pieces":
            assert out.columns == wide.columns
            assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_run_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r.values()) for r in pq.read_table(f"{path}/documents.parquet").to_pylist()]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    import numpy as np

    good = [r for r in rows if model.scores(Q.features(r[1])[None])[0] >= 0.5]
    assert 0 < len(good) < len(rows)
    near = near_brute(good)
    cut = repeats_brute(near)
    from test_decontaminate import naive

    items = [tuple(r.values()) for r in pq.read_table(f"{path}/benchmark.parquet").to_pylist()]
    left = [(i, t) for i, t in cut if not naive(t, items)]
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(PIECES))
    want = sorted((i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in left)
    got = C.run(spark, path)
    assert sorted((r.doc_id, r.ids, r.text) for r in got.collect()) == want
    assert got.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert np.isfinite(len(want))
