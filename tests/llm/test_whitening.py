from fractions import Fraction

import numpy as np
import pytest

from timelake.llm import queries, whitening


def frame(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if c is None else float(c) for c in v], i) for i, v in rows], "vec_id long, embedding array<float>, x long")


def sample(n=120, d=5, seed=3):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=d) * np.arange(1, d + 1)) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # a third are copies
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    odd = [(5000, None), (5001, [None] * d), (5002, [float("nan")] + [1.0] * (d - 1)), (5003, [float("inf")] * d), (5004, [1.0] * (d - 1)), (5005, [])]
    return rows, odd


def brute(rows, k, one=False):
    """From exact rational sums: n, deviations, eigenvalues, whitened values (up to sign) by row."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    fit = np.array(sorted(set(map(tuple, x))), dtype=object) if one else x
    n = len(fit)
    s = fit.sum(0)
    gap = n * x - s
    own = n * fit - s
    cov = np.array([[float(Fraction(int((own[:, i] * own[:, j]).sum()), n**3)) for j in range(x.shape[1])] for i in range(x.shape[1])])
    e, p = np.linalg.eigh(cov)
    e, p = e[::-1][:k], p[:, ::-1][:, :k]
    return n, (gap**2).sum(1), e, (gap.astype(float) / n) @ p / np.sqrt(e), e / np.trace(cov)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_brute_force(spark, weights):
    rows, odd = sample()
    got = whitening.whiten(frame(spark, rows + odd), 4, weights=weights).collect()
    n, far, _, z, share = brute(rows, 4, weights == "one")
    want = sorted((-1 if i is None else i, c + 1, n, int(far[r])) for r, (i, _) in enumerate(rows) for c in range(4))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.component, r.n, int(r.deviation)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.component, {})[r.vec_id] = r.whitened
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-10 and r.identity_error < 1e-9
    for c, mine in by.items():
        theirs = {i: z[r, c - 1] for r, (i, _) in enumerate(rows)}
        sign = np.sign(mine[1] * theirs[1])
        assert all(abs(sign * mine[i] - theirs[i]) < 1e-9 for i in mine)


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**44 * i), float(i * i), 1.0 * (i % 3)]) for i in range(40)]
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame(spark, rows), 1).collect()}
    _, far, *_ = brute(rows, 1)
    assert got == {i: int(f) for (i, _), f in zip(rows, far, strict=True)}


def test_none_one_and_flat(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(frame(spark, [(i, [float(i), 3.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and all(abs(r.explained - 1) < 1e-12 for r in flat)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op13_whitening(spark, sf)
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    n, far, _, z, _ = brute([(r.vec_id, r.embedding) for r in vectors], 32)
    rows = got.collect()
    assert dict(got.dtypes)["deviation"] == "bigint" and len(rows) == 32 * len(vectors) and rows[0].identity_error < 1e-9
    at = {r.vec_id: i for i, r in enumerate(vectors)}
    assert all(r.n == n and r.deviation == far[at[r.vec_id]] for r in rows)
    assert all(abs(abs(r.whitened) - abs(z[at[r.vec_id], r.component - 1])) < 1e-6 for r in rows)
