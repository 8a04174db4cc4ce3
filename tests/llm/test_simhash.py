import math
import random

import xxhash

from tidemark.llm import simhash as S
from tidemark.llm.components import connected_components


def naive_print(text, k=4):
    words = (text or "").encode().lower().split()
    runs = S.shingles(words, k)
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(runs)) if runs else 0


def brute(ids_prints, radius=4):
    from tidemark.llm.common import UnionFind

    u = UnionFind()
    for x, (i, f) in enumerate(ids_prints):
        for j, g in ids_prints[:x]:
            if (f ^ g).bit_count() <= radius:
                u.union(i, j)
    return {i: u.find(i) for i, _ in ids_prints}


def corpus():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(60):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 40, 150]))]
        docs.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append("  ".join(w))
    docs += [None, "", "  \n", docs[0], docs[0].upper(), "Ünï cödé tëxt", "a " * 3000]
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(df).collect()}
    prints = [(i, naive_print(t)) for i, t in rows]
    want = brute(prints)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in prints}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.simhash_components(df).collect() == []


def test_split_shards_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(62)
    prints = {}
    for i in range(150):
        v = base
        for _ in range(rng.randrange(9)):
            v ^= 1 << rng.randrange(62)
        prints.setdefault(v, i)
    df = spark.createDataFrame([(i, v) for v, i in prints.items()], "id long, f0 long")
    edges = S.links(df, 4, S.block_shards(4), tree_nodes=16)
    got = {r.id: r.component for r in connected_components(edges).collect()}
    want = brute([(i, v) for v, i in sorted(prints.items(), key=lambda x: x[1])])
    assert {i: got.get(i, i) for i in want} == want


def test_tree_finds_exactly_the_neighbours():
    rng = random.Random(1)
    values = [rng.getrandbits(16) for _ in range(400)]
    tree = S.BKTree()
    for v in values:
        tree.insert(v, v)
    for q in values[:40]:
        assert sorted(p for _, p in tree.within(q, 3)) == sorted(v for v in values if (v ^ q).bit_count() <= 3)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_longer_keys_lose_no_pair():
    rng = random.Random(9)
    lengths = []
    for rows in (0, 10**7, 10**9, 10**12):
        choices = S.block_shards(4, rows=rows)
        lengths.append(min(map(len, choices)))
        for _ in range(200):
            apart = set(rng.sample(range(64), 4))
            assert any(not apart & set(c) for c in choices)
    assert lengths[0] == 12 and lengths == sorted(lengths) and (10**12 >> lengths[-1]) <= S.TREE_NODES
    assert S.sample_plan(10**5) == (S.TABLES, S.SAMPLE) and S.sample_plan(10**9) > S.sample_plan(10**8)


def test_radius_parts_like_fingerprints_from_unlike_ones():
    """By calculation: two sets of similarity 0.8 have a cosine of 8/9; unlike ones differ in each bit by even chances."""
    bits, p = 64 * S.TREE_LANES, math.acos(8 / 9) / math.pi
    missed = sum(math.comb(bits, d) * p**d * (1 - p) ** (bits - d) for d in range(S.RADIUS + 1, bits + 1))
    false = sum(math.comb(bits, d) for d in range(S.RADIUS + 1)) / 2**bits
    # 13 million texts (30 GB) that have a false partner in a hundred each make up no large component.
    assert missed < 1e-6 and false * 13e6 < 0.1
