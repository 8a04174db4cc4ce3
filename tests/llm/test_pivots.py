import numpy as np
import pyarrow as pa

from tidemark.llm import pivots as P
from tidemark.llm.common import UnionFind


def brute(rows, threshold):
    n = {}
    u = UnionFind()
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    for k, (i, _) in enumerate(rows):
        n[k] = 0
    index = [k for k, (i, v) in enumerate(rows) if v is not None and len(v) and None not in v and np.isfinite(v).all() and np.any(v)]
    links = 0
    for a in range(len(ok)):
        for b in range(a):
            x, y = ok[a][1], ok[b][1]
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                n[index[a]] += 1
                n[index[b]] += 1
                links += 1
                u.union(ok[a][0], ok[b][0])
    return [(i, n[k], u.find(i)) for k, (i, _) in enumerate(rows)], links


def data(spread, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(40):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((base + spread * rng.normal(size=16)).tolist())
    rows += [rows[0], rows[0], (np.array(rows[5]) * 3).tolist(), None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.1], [None] + [1.0] * 15]
    return [(i * 2 + 1, r) for i, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, cls int, id string")


def test_tight_groups_are_exact(spark):
    rows = data(0.05)
    want, _ = brute(rows, 0.9)
    for list_rows in (2048, 16):
        got = P.embedding_links(frame(spark, rows), list_rows=list_rows).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_recall_near_the_threshold(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(150):
        a = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b = rng.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        c = rng.uniform(0.9001, 0.94)
        rows += [a.tolist(), (c * a + np.sqrt(1 - c * c) * b).tolist()]
    rows = list(enumerate(rows))
    want, links = brute(rows, 0.9)
    got = P.embedding_links(frame(spark, rows)).collect()
    exact = {i: n for i, n, _ in want}
    assert all(r.n_links <= exact[r.vec_id] for r in got)
    assert sum(r.n_links for r in got) / 2 >= 0.9 * links


def planted(n, pairs, dim, lo, hi, seed=3):
    """Random unit vectors, and pairs of a cosine between lo and hi."""
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(pairs, dim))
    own = a[:pairs]
    b -= (b * own).sum(axis=1, keepdims=True) * own
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(lo, hi, size=(pairs, 1))
    return np.concatenate([a, c * own + np.sqrt(1 - c * c) * b])


def vectors(spark, x):
    flat = pa.array(x.reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
    return spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": lists}))


def test_recall_at_the_threshold_on_many_vectors(spark):
    """20,000 vectors with 3,000 planted pairs, at 0.9 to 0.905 and at 0.9 to 0.94, against all pairs."""
    for lo, hi in ((0.9001, 0.905), (0.9001, 0.94)):
        x = planted(17_000, 3000, 64, lo, hi)
        df = vectors(spark, x).repartition(8)
        want = np.zeros(len(x), dtype=int)
        for at in range(0, len(x), 2000):
            want[at : at + 2000] = (x[at : at + 2000] @ x.T >= 0.9).sum(axis=1) - 1
        got = {r.vec_id: r.n_links for r in P.embedding_links(df).collect()}
        found = np.array([got[i] for i in range(len(x))])
        assert (found <= want).all() and want.sum() >= 6000
        assert found.sum() >= 0.99 * want.sum()


def test_exact_setting_loses_nothing(spark):
    x = planted(700, 200, 32, 0.9, 0.91)
    rows = list(enumerate(x.tolist())) + [(2000, None), (2001, x[0].tolist())]
    want, links = brute(rows, 0.9)
    for list_rows in (2048, 100):
        got = P.embedding_links(frame(spark, rows), exact=True, list_rows=list_rows).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)


def test_planted_links_agree_with_the_registered_sql(spark, tmp_path):
    """The query's SQL on a table that has links, unlike the given ones: groups, copies and chains."""
    import duckdb

    from tidemark.llm import oracles

    x = np.concatenate([planted(150, 60, 16, 0.93, 0.99), planted(3, 3, 16, 0.99, 0.999, seed=9)])
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())] + [(1000 + i, v) for i, v in enumerate(x[:5].astype(np.float32).tolist())] + [(2000, None), (2001, [0.0] * 16)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    cur = con.execute(oracles.LINKS)
    names = [c[0] for c in cur.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in cur.fetchall())
    got = P.embedding_links(spark.read.parquet(str(tmp_path / "e")))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == want
    assert sum(w[1] for w in want) > 120


def test_fitted_index_grows_with_the_table(spark):
    df = vectors(spark, planted(3000, 0, 24, 0.9, 0.95))
    small, large = P.fit(df, 3000, 0.9), P.fit(df, 10_000_000, 0.9)
    assert len(small.pivots) == 256 and len(large.pivots) > 1000 and large.near >= small.near
    assert P.fit(df, 10**10, 0.9, 512).keys == 2
    assert len(P.fit(df.limit(0), 0, 0.9).pivots) == 0


def test_empty_and_invalid(spark):
    assert P.embedding_links(frame(spark, [])).collect() == []
    got = P.embedding_links(frame(spark, [(1, None), (2, [0.0, 0.0]), (3, [float("nan")])])).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
