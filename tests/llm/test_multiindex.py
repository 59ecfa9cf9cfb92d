import numpy as np
import pytest

from timelake.llm import multiindex


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], t, 1) for i, v, t in rows], "vec_id long, embedding array<float>, label int, c1 int").repartition(3)


def brute(rows, every=100, k=5, low=80, high=100):
    good = {}
    for i, v, t in rows:
        if i is not None and t is not None and v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v):
            good[i] = (np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64), t)
    out = []
    for a, (q, t) in good.items():
        if a % every:
            continue
        order = sorted((-int(x @ q), i, u) for i, (x, u) in good.items() if i != a)
        for s, p, _ in [o for o in order if o[2] == t][:k]:
            hard = [o for o in order if o[2] != t and low * -s <= 100 * -o[0] <= high * -s][:k]
            out += [(a, p, r + 1, i, -s, -n) for r, (n, i, _) in enumerate(hard)]
    return sorted(out)


def found(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def sample(n=700, d=7, seed=2, clusters=0):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(max(clusters, 1), d)) * bool(clusters)
    rows = [(i, centers[i % max(clusters, 1)] + r.normal(size=d) * (0.2 if clusters else 1), int(r.integers(0, 3)) * int(i % 3 > 0)) for i in range(n)]
    rows += [(n + i, rows[100][1], i % 2) for i in range(n // 3)]  # copies of an anchor: ties
    odd = [(5000, None, 1), (5100, [None] * d, 1), (5200, [float("nan")] * d, 2), (5300, [1.0] * d, None), (5400, [0.0] * d, 1), (None, [1.0] * d, 1)]
    return rows + odd


@pytest.mark.parametrize("clusters", [0, 8])
def test_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(multiindex, "SHARD", 100)  # many shards, and a cell of copies in several parts
    monkeypatch.setattr(multiindex, "LANE", 3)
    rows = sample(clusters=clusters)
    assert found(multiindex.mine(frame(spark, rows))) == brute(rows)


def test_large_components_and_other_windows(spark):
    r = np.random.default_rng(9)
    rows = [(i, np.floor(r.uniform(-1, 1, 1 + 4) * 2**22), i % 2) for i in range(200)]
    assert found(multiindex.mine(frame(spark, rows), low=50, high=90)) == brute(rows, low=50, high=90)


def test_few_and_none(spark):
    few = [(0, [1.0], 1), (100, [2.0], 1), (3, [1.5], 2), (4, [0.9], 2)]
    assert found(multiindex.mine(frame(spark, few))) == brute(few) != []
    alone = [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 2)]
    assert multiindex.mine(frame(spark, alone)).count() == multiindex.mine(frame(spark, [])).count() == 0


def test_heap_falls():
    r = np.random.default_rng(1)
    a, b = r.normal(size=9), r.normal(size=7)
    got = list(multiindex.by_falling_sum(a, b))
    assert len({(i, j) for _, i, j in got}) == 63 and all(x[0] >= y[0] for x, y in zip(got, got[1:], strict=False))
    assert all(abs(s - a[i] - b[j]) < 1e-12 for s, i, j in got)


def test_clustered_rows_are_not_all_scored(monkeypatch):
    r = np.random.default_rng(5)
    centers = r.normal(size=(40, 16))
    v = np.floor(256 * (centers[np.arange(4000) % 40] + 0.05 * r.normal(size=(4000, 16))))
    books = [multiindex.codebook(v[:, :8], 40), multiindex.codebook(v[:, 8:], 40)]
    c1, c2 = multiindex.nearest(v[:, :8], books[0]), multiindex.nearest(v[:, 8:], books[1])
    at = np.lexsort((c2, c1))
    shard = multiindex.Shard(c1[at], c2[at], at, at % 2, v[at])
    read = [x[1][4] for x in shard.visits(np.arange(40), np.zeros(40, int), v[:40], [[2**63 - 1]] * 40, [[1 - 2**63]] * 40, 5, True)]
    assert sum(read) <= 0.25 * 40 * 4000
