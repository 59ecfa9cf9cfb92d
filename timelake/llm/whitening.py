"""Embedding whitening by weighted multiplicity covariance.

Vectors become whole numbers, x = floor(scale * c) + offset. Identical x vectors form one group, and everything after is done
once a group: sums, covariance, projection. A group weighs as many rows as it has ("counts"), or one (weights="one": the fit
list is then the distinct vectors). Sums are exact; the covariance is a weighted GEMM of the exactly centred vectors, added
up over tasks; its eigenvectors are found on the driver (one matrix of dimensions squared, whatever the number of rows);
every distinct vector is projected once and joined back to the rows that hold it. How far the covariance of the
whitened vectors is from the identity is measured by a second GEMM over what was really written.

Hot groups: copies are counted before the shuffle, and the join back is a merge join whose hot key adaptive execution
splits. Nothing but d*d numbers reaches the driver.

Edge cases: null vectors, those with null or non-finite components and those of an unusual length take no part; null and
repeated keys stay, each row with its result. Components without variance (eigenvalue of at most d * 2**-52 of the largest)
have no whitened value and are left out; a single row, or copies of one vector alone, give no rows, as does an empty table.
Components must stay below 2**52 after scaling. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .vectors import finite_vectors, lists, matrix

_OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def sums(groups: DataFrame, values: str) -> list:
    """Weighted sum of each dimension of the column `values`, in order."""
    each = groups.select("w", F.posexplode(values).alias("j", "y")).groupBy("j").agg(F.sum(F.col("w") * F.col("y")).alias("s"))
    return [r.s for r in each.orderBy("j").collect()]  # one row a dimension


def spread(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: 64-bit where that holds it, else Python's integers."""
    most = max(1, int(np.abs(x).max(initial=0)), max(map(abs, total), default=0) // max(n, 1) + 1)
    if 2 * most * n < 2**62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def gemm(groups: DataFrame, values: str, centred: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """Sum of w * y * y' over all groups, y = centred(values): a matrix for each task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                y = centred(matrix(b.column(0)))
                g += (y * b.column(1).to_numpy()[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), lists(g)], ["i", "g"])

    parts = groups.select(values, "w").mapInArrow(run, "i int, g array<double>")
    cells = parts.select("i", F.posexplode("g").alias("j", "y")).groupBy("i", "j").agg(F.sum("y").alias("y"))
    out = np.zeros((d, d))
    for r in cells.collect():  # d * d numbers
        out[r.i, r.j] = r.y
    return (out + out.T) / 2


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, weights: str = "counts", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each row and component."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    spark = vectors.sparkSession
    bounded_batches(spark)
    # the offset moves every mean alike, so all work is done on x - offset
    rows = finite_vectors(vectors, key, vector).select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    counted = rows.groupBy("x").agg(F.count("*").alias("copies"))
    groups = saved(counted.select("x", (F.col("copies") if weights == "counts" else F.lit(1).cast("long")).alias("w")), "groups")
    n = groups.agg(F.sum("w")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], _OUT)
    total = [int(s) for s in sums(groups, "x")]
    d = len(total)
    cov = gemm(groups, "x", lambda x: spread(x, n, total).astype(np.float64) / n, d) / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values > max(values[0], 0) * d * 2.0**-52).sum())
    e, axes = values[: min(components, kept)], np.ascontiguousarray(axes[:, : min(components, kept)])
    if not len(e):
        return spark.createDataFrame([], _OUT)
    explained = [float(x) for x in e / np.trace(cov)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                gap = spread(matrix(b.column(0)), n, total)
                z = (gap.astype(np.float64) / n) @ axes / np.sqrt(e)
                if gap.dtype != object and d * int(np.abs(gap).max()) ** 2 < 2**63:
                    far = pa.array((gap * gap).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    far = pa.array([Decimal(sum(int(g) ** 2 for g in row)) for row in gap], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), far, lists(z)], ["x", "w", "deviation", "z"])

    done = saved(groups.mapInArrow(project, "x array<long>, w long, deviation decimal(38,0), z array<double>"), "whitened")
    middle = np.array(sums(done, "z")) / n
    error = float(np.abs(gemm(done, "z", lambda z: z - middle, len(e)) / n - np.eye(len(e))).max())
    joined = rows.join(done.select("x", "deviation", "z").hint("merge"), "x")
    flat = joined.select("id", "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.element_at(F.array(*map(F.lit, explained)), F.col("at") + 1)
    return flat.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
