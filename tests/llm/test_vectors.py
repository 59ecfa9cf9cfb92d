import numpy as np
import pytest

from timelake.llm import hilbert, pivots
from timelake.llm.vectors import scanned


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 3) for i, v in rows], "vec_id long, embedding array<float>, id int").repartition(3)


def brute(rows, k, every, quantise, zero=True):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}
    if quantise:
        good = {i: np.floor(256 * v).astype(np.int64) for i, v in good.items()}
    out = []
    for q in good:
        if q % every == 0:
            best = sorted((-(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def sample(n=600, d=8, seed=1):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=d)) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(30)]  # ties
    odd = [(5000, None), (5050, [None] * d), (5100, [float("nan")] + [1.0] * (d - 1)), (5150, [float("inf")] * d), (5200, [0.0] * d), (None, [1.0] * d)]
    return rows + odd


def clustered(n, d=16, clusters=20, seed=4):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(clusters, d))
    return [(i, centers[i % clusters] + 0.05 * r.normal(size=d)) for i in range(n)]


@pytest.mark.parametrize("n", [500, 20_000])
def test_clustered_vectors_are_not_all_scanned(spark, n):
    rows = clustered(n)
    early, late, count = pivots.rounds(frame(spark, rows), 5, 50)
    read = early.union(late).agg({"scanned": "sum"}).first()[0]
    assert count == n and read <= 0.2 * n * len(range(0, n, 50))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.top_k(frame(spark, rows), 5, 1000).collect())
    assert got == brute(rows, 5, 1000, True)
    data, visits = hilbert.index(frame(spark, rows), 10, 100)
    assert scanned(data, visits) <= 0.35
    found = {(r.query_id, r.vec_id) for r in hilbert.nearest(frame(spark, rows), 10, 100).collect()}
    want = {(q, i) for q, _, i, _ in brute(rows, 10, 100, False, zero=False)}
    assert len(found & want) >= 0.9 * len(want)


def test_large_components(spark):
    r = np.random.default_rng(9)
    rows = [(i, np.floor(r.uniform(-1, 1, 6) * 2**22)) for i in range(300)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.top_k(frame(spark, rows), 5, 50).collect())
    assert got == brute(rows, 5, 50, True)


@pytest.mark.parametrize("cell", [40, 4096])
def test_exact_top_k(spark, monkeypatch, cell):
    monkeypatch.setattr(pivots, "CELL", cell)
    rows = sample()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.top_k(frame(spark, rows), 5, 50).collect())
    assert got == brute(rows, 5, 50, True)


def test_hilbert_neighbours_are_adjacent():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hilbert.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "CELL", 50)
    rows = sample()
    got = {(r.query_id, r.vec_id): r for r in hilbert.nearest(frame(spark, rows), 20, 20).collect()}
    want = brute(rows, 20, 20, False, zero=False)
    hits = sum((q, i) in got for q, _, i, _ in want)
    assert hits >= 0.9 * len(want)
    true = {(q, i): s for q, _, i, s in want}
    assert all(abs(true[x] - r.score) < 1e-9 for x, r in got.items() if x in true)
    ranks = {}
    for r in got.values():
        ranks.setdefault(r.query_id, []).append(r.rank)
    assert all(sorted(x) == list(range(1, 21)) for x in ranks.values())


def test_few_and_none(spark):
    few = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (3, [0.0, 1.0])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in pivots.top_k(frame(spark, few)).collect()) == brute(few, 5, 50, True)
    assert [(r.query_id, r.rank, r.vec_id) for r in hilbert.nearest(frame(spark, few)).orderBy("query_id", "rank").collect()] == [(0, 1, 50), (0, 2, 3)]
    assert pivots.top_k(frame(spark, [])).count() == hilbert.nearest(frame(spark, [(1, None)])).count() == 0
