import numpy as np

from geoloom.llm import topk_segments as op

from .helpers import finite, vectors_df


def brute(rows, every=100, top=10):
    ok = [(k, i, np.floor(1024 * np.array(v, np.float32).astype(float)).astype(np.int64)) for k, (i, v, *_) in enumerate(rows) if i is not None and finite(v)]
    out = []
    for k, i, q in ok:
        if i % every == 0:
            scored = sorted((-int(q @ x), j) for n, j, x in ok if n != k and len(x) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:top])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(rng.normal(size=(5000, 12)))]
    rows += [(5000 + i, rows[i % 3][1], 1) for i in range(40)]  # ties
    rows += [(100, rows[7][1], 1), (100, rows[100][1], 2), (6000, None, 1), (6100, [], 1), (6200, [1.0, float("nan")] * 6, 1), (6300, [1.0, None] * 6, 1), (6400, [float("inf")] * 12, 1), (None, [1.0] * 12, 1)]
    rows += [(7000 + i, [0.5, -0.5], 1) for i in range(3)] + [(7100, [1.0, 1.0], 1), (-200, [1e5, -1e5] * 6, 3), (-7, [1e5] * 12, 3), (-300, [1e5 + i for i in range(12)], 3)]
    got = op.top_products(vectors_df(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, x = rng.normal(size=(50, 37)), rng.normal(size=(80, 37)) + 1
    for k in (1, 4, 16, 64):
        assert (op.segment_stats(q, k) @ op.segment_stats(x, k).T >= q @ x.T - 1e-9).all()
    assert (op.segment_stats(q, 4) @ op.segment_stats(x, 4).T >= op.segment_stats(q, 16) @ op.segment_stats(x, 16).T - 1e-9).mean() > 0.9
    y, z = (v @ op.axes_of(list(x))[37] for v in (q, x))
    assert np.allclose(y @ z.T, q @ x.T)
    head, rest = op.boxed(z)
    assert (op.box_bound(*op.boxed(y), head.min(0), head.max(0), rest.max()) >= (q @ x.T).max(1) - 1e-9).all()


def clustered(rng, n, dim=32, centers=40, noise=0.15):
    c = rng.normal(size=(centers, dim))
    return (c[rng.integers(0, centers, n)] + noise * rng.normal(size=(n, dim))).astype(np.float32)


def test_many_blocks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i), v.tolist(), 0) for i, v in enumerate(clustered(rng, 4000, 12, 20, 0.05))]
    seen = []
    own = op.block_pairs
    monkeypatch.setattr(op, "block_pairs", lambda blocks, groups: seen.append((blocks.count(), groups, own(blocks, groups).count())) or own(blocks, groups))
    assert sorted(map(tuple, op.top_products(vectors_df(spark, rows), every=10, block=32).collect())) == brute(rows, 10)
    (blocks, groups, left), = seen
    assert blocks > 100 and groups > 20 and left < 0.7 * blocks * groups  # pairs are dropped before anything is read


def test_survivors_on_clustered_vectors():
    """The share of (query, candidate) pairs that each bound leaves."""
    rng = np.random.default_rng(6)
    x = np.floor(1024 * clustered(rng, 6000).astype(float))
    axes = op.axes_of(list(x[:2000]))
    y = op.leading(x, axes, op.CELLS)
    x = x[np.lexsort(np.floor(y / y.std()).T[::-1])]
    ids = np.arange(len(x))
    at = ids[::100]
    home = op.products(x[at], x)
    home[np.arange(len(at)), at] = op.LEAST
    home[ids[None, :] // 200 != at[:, None] // 200] = op.LEAST
    best = op.Best(x[at], at, at, op.nth_score(home, 10), axes)
    for a in range(0, len(x), 200):
        part = x[a : a + 200]
        head, rest = op.boxed(op.rotated(part, axes))
        best.meet(part, ids[a : a + 200], ids[a : a + 200], (head.min(0), head.max(0), rest.max()), axes)
    share = {k: v / best.pairs["all"] for k, v in best.pairs.items()}
    assert share["fine"] <= share["coarse"] <= share["box"] < 0.6 and share["fine"] < 0.15 and share["scored"] < 0.5, share
    exact = op.products(x[at], x)
    exact[np.arange(len(at)), at] = op.LEAST
    assert (np.sort(best.score, 1) == np.sort(exact, 1)[:, -10:]).all()


def test_products_beyond_doubles_and_longs():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0], [-(2.0**20), 5.0]])
    assert op.products(q, x).tolist() == [[2**60 + 3, -(2**60) + 15]]
    q = np.array([[2.0**60, 1.0]])
    assert op.products(q, np.array([[2.0**9, 0.0], [-(2.0**9), 0.0], [1.0, 5.0]])).tolist() == [[op.MOST, op.LEAST + 1, 2**60 + 5]]


def test_few_and_none(spark):
    assert sorted(map(tuple, op.top_products(vectors_df(spark, [(0, [1.0], 1), (5, [2.0], 1)])).collect())) == [(0, 1, 5, 2048 * 1024)]
    assert op.top_products(vectors_df(spark, [(0, [1.0], 1)])).collect() == []
    assert op.top_products(vectors_df(spark, [])).collect() == []
    assert op.top_products(vectors_df(spark, [(1, [1.0], 1)])).collect() == []
