import math
import random
import resource
from itertools import combinations

from tidemark.llm import decontaminate as D


def naive(doc, items, shortest=5):
    w = (doc or "").encode().lower().split()
    out, have = {}, set(w)
    for i, text in items:
        v = (text or "").encode().lower().split()
        if len(v) < shortest:
            continue
        n, need = (13, 11) if len(v) >= 13 else (len(v), math.ceil(0.8 * len(v)) if len(v) >= 8 else len(v))
        if sum(x in have for x in v) < need:
            continue
        covered = set()
        for a in range(len(w) - n + 1):
            for b in range(len(v) - n + 1):
                if sum(x == y for x, y in zip(w[a : a + n], v[b : b + n], strict=True)) >= need:
                    covered.update(range(a, a + n))
        if covered:
            out[i] = covered
    return out


def test_masks_survive_any_two_substitutions():
    for a, b in combinations(range(D.WINDOW), 2):
        assert any(not {a, b} & {o + m for m in mask} for mask in D.MASKS for o in range(D.WINDOW - mask[-1]))


def test_short_masks_survive_what_they_tolerate():
    for n in range(1, D.WINDOW):
        own = [{first + m for m in mask} for first, mask in D.masks_of(n)]
        assert D.tolerated(n) == (n - math.ceil(0.8 * n) if n >= 8 else 0)
        for gone in combinations(range(n), D.tolerated(n)):
            assert any(not set(gone) & x for x in own)


def data():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "the"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([13, 14, 20, 40, 5, 7, 12, 4, 30, 13, 8, 9, 10, 11, 3, 1])]
    items += [(20, None), (None, " ".join(say(20))), (21, ""), (22, items[3][1])]
    docs = []
    for _, text in items:
        v = (text or "").split()
        for subs in range(5):
            own = list(v)
            for p in rng.sample(range(len(own)), min(subs, len(own))):
                own[p] = "CHANGED"
            docs.append(" \n".join(say(rng.randrange(30)) + own + say(rng.randrange(30))).upper())
        docs.append(" ".join(say(9) + v[: len(v) // 2] + say(9)))
    docs += [None, "", " ", " ".join(say(4000)), "the " * 500, docs[0], docs[0]]
    return items, list(enumerate(docs))


def test_against_brute_force(spark):
    items, docs = data()
    df = spark.createDataFrame([(i, t, ["x"], 1) for i, t in docs], "doc_id long, text string, overlaps array<string>, row int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    by_id = lambda x: (x is not None, x)  # noqa: E731  null first, as Spark sorts
    told = {}
    for words, shortest in ((D.INDEX_WORDS, 5), (120, 5), (D.INDEX_WORDS, 1)):
        got = {r.doc_id: r for r in D.contaminated(df, bench, index_words=words, shortest=shortest).collect()}
        assert len(got) == len(docs)
        told.setdefault(shortest, []).append({i: (r.n_words, r.item_ids, r.n_covered, sorted(r.overlaps, key=lambda o: (by_id(o.item_id), o.begin))) for i, r in got.items()})
        for i, t in docs:
            want = naive(t, items, shortest)
            assert sorted(got[i].item_ids, key=by_id) == sorted(want, key=by_id), i
            assert got[i].n_words == len((t or "").split())
            for o in got[i].overlaps:
                assert set(range(o.begin, o.end)) <= want[o.item_id] and o.agree >= 0.8 * (o.end - o.begin)
            assert (got[i].n_covered > 0) == bool(want)
        kept = {r.doc_id for r in D.clean(df, bench, index_words=words, shortest=shortest).collect()}
        assert kept == {i for i, _ in docs if not got[i].n_overlaps}
    assert told[5][0] == told[5][1]


def test_words_repeated_without_end():
    """Runs and short periods in both texts are a few comparisons, not a row for each pair of places."""
    items = [(i, "the " * 1000) for i in range(100)] + [(100 + i, "a b " * 700) for i in range(20)] + [(200, "x " * 12 + "y")]
    index = D.SeedIndex.build(items)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    h = D.word_hashes([w.encode() for w in ("q " + "the " * 200_000 + "a b " * 2000).split()])
    found = index.overlaps(h)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
    assert {i for i, *_ in found} == set(range(120))
    assert all(begin == 1 and 200_001 <= end <= 200_003 for i, begin, end, _ in found if i < 100)
    assert all(end == len(h) for i, _, end, _ in found if i >= 100)


def test_two_words_in_any_order_are_exact():
    rng = random.Random(2)
    words = [rng.choice(["u", "v"]) for _ in range(300)]
    items = [(i, " ".join(rng.choice(["u", "v"]) for _ in range(n))) for i, n in enumerate([13, 30, 60, 13])]
    found = D.SeedIndex.build(items).overlaps(D.word_hashes([w.encode() for w in words]))
    want = naive(" ".join(words), items)
    assert {i for i, *_ in found} == set(want)
    for i, covered in want.items():
        mine = set().union(*(range(b, e) for j, b, e, _ in found if j == i))
        assert mine <= covered and len(covered - mine) <= 4 * sum(j == i for j, *_ in found)


def test_empty(spark):
    items, docs = data()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.contaminated(df.limit(0), bench).collect() == []
    assert all(r.n_overlaps == 0 for r in D.contaminated(df, bench.limit(0)).collect())
