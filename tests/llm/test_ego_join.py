import numpy as np

from geoloom.llm import ego_join as op

from .helpers import components, finite, vectors_df


def brute(rows, cosine=0.9):
    units = {}
    for k, (_, v, *_rest) in enumerate(rows):
        if finite(v) and np.any(np.array(v, np.float32)):
            x = np.array(v, np.float32).astype(float)
            units[k] = x / np.linalg.norm(x)
    links = [(i, j) for i in units for j in units if i < j and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine]
    n = {k: 0 for k in range(len(rows))}
    for i, j in links:
        n[i] += 1
        n[j] += 1
    comps = components(range(len(rows)), links)
    low = {}
    for k, c in comps.items():
        if rows[k][0] is not None:
            low[c] = min(low.get(c, rows[k][0]), rows[k][0])
    return sorted(((rows[k][0], n[k], low.get(comps[k]), rows[k][0] is not None and low[comps[k]] == rows[k][0]) for k in range(len(rows))), key=repr)


def check(spark, rows):
    got = op.near_vectors(vectors_df(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(25, 8))
    rows = [(i, (centers[i % 25] + 0.25 * rng.normal(size=8)).tolist(), 0) for i in range(500)]
    rows += [(1000 + i, rows[i % 2][1], 1) for i in range(150)]  # exact copies
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * 8, 0), (2003, [float("nan")] * 8, 0), (2004, [None] + [1.0] * 7, 0), (None, rows[3][1], 0), (7, rows[9][1], 0), (2005, [1e30] * 8, 0), (2006, [1e-30] * 8, 0), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.1], 0)]
    check(spark, rows)


def test_many_blocks(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, v.tolist(), 0) for i, v in enumerate(rng.normal(size=(1500, 3)))])


def test_a_tree_of_blocks(spark, monkeypatch):
    """Hundreds of blocks, so the tree has levels and tiles have several blocks; what is far apart is never joined."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(30, 16)) * 3
    rows = [(i, (centers[i % 30] + 0.1 * rng.normal(size=16)).tolist(), 0) for i in range(3000)]
    pairs = []
    own = op._interval_pairs
    monkeypatch.setattr(op, "_interval_pairs", lambda blocks, cosine: pairs.append((blocks.count(), own(blocks, cosine).count())) or own(blocks, cosine))
    got = op.near_vectors(vectors_df(spark, rows), block=16)
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = ((u @ u.T) >= 0.9).sum(1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got.collect()} == dict(enumerate(n.tolist()))
    (blocks, left), = pairs
    assert blocks > 150 and left < 0.35 * blocks * (blocks + 1) / 2  # on clustered vectors most pairs of blocks are skipped


def test_join_intervals_in_steps():
    rng = np.random.default_rng(3)
    u = op.units(rng.normal(size=(300, 4)))
    y = op.leading(u, op.axes_of(list(u), op.BOX), op.BOX)
    found = {(a, b) for i, j in op.join_intervals(u, y, u, y, True, 0.9, step=16) for a, b in zip(i.tolist(), j.tolist())}
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if u[i] @ u[j] >= 0.9}
    two = {(a, b) for i, j in op.join_intervals(u[:100], y[:100], u[100:], y[100:], False, 0.9, step=16) for a, b in zip(i.tolist(), j.tolist())}
    assert two == {(i, j - 100) for i, j in found if i < 100 <= j}


def test_few_and_none(spark):
    check(spark, [(4, [1.0, 0.0], 0)])
    check(spark, [(4, None, 0), (5, None, 0)])
    assert op.near_vectors(vectors_df(spark, [])).collect() == []
