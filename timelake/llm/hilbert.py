"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects the vectors by its own random rotation onto a few dimensions, shifts them and orders them by their
Hilbert key. The keys are cut into ranges of equal frequency (cells), narrower than a query's window at every number of
rows. A query visits the cells around its own on each curve; the windows' rows are scored with the exact inner product
on the original vectors, and the best of all curves stay.

The number of curves (two at least) and the window's share of the rows are fitted on a bounded sample (SAMPLE rows): the
pair that reads the fewest rows among those whose recall there reaches the target. On vectors without structure no
ordering keeps neighbours together, and the share comes out large; on clustered ones it is small. Every row is indexed.
A cell of more than CELL rows (large tables, or many equal keys) is spread over parts by hash, which are all visited. The
driver and the tasks get one row a cell, at most MOST_RANGES of them a curve.

Edge cases: see `valid_vectors` (zero vectors take no part either); with few rows a query gets all others; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, saved
from .vectors import lists, mapped, matrix, ranked, search_cells, valid_vectors

SAMPLE = 4096
CELL, MOST_RANGES = 8192, 4096
#: Cells that a window spans.
WINDOW = 8
BITS = 6
SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, *(i / 20 for i in range(2, 21)))


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), by the transposed-axes method; bits times dimensions must be below 63."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            swap = (x[i] & q) == 0
            t = np.where(swap, (x[0] ^ x[i]) & p, 0)
            x[0] = np.where(swap, x[0] ^ t, x[0] ^ p)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """The projections, scales and shifts of all curves; fitted on a sample of vectors."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, seed: int = 17):
        r = np.random.default_rng(seed)
        d = sample.shape[1]
        dims = min(dims, d)
        self.maps = []
        for _ in range(curves):
            rotation = np.linalg.qr(r.normal(size=(d, d)))[0][:, :dims]
            low, high = (np.percentile(sample @ rotation, p, axis=0) for p in (0.5, 99.5))
            span = np.maximum(high - low, 1e-12) * 1.5
            self.maps.append((rotation, low - span * r.uniform(0, 1 / 3, dims), span))

    def keys(self, v: np.ndarray) -> list[np.ndarray]:
        top = (1 << BITS) - 1
        return [hilbert_key(np.clip((v @ m - low) / span * (top + 1), 0, top), BITS) for m, low, span in self.maps]


def fit_windows(curves: Curves, sample: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """(curves, share of rows around a query on each): what reads the fewest rows and holds `recall` of the neighbours in the sample."""
    n = len(sample)
    asked = np.arange(0, n, max(1, n // 256))
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    truth = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
    gaps = []
    for key in curves.keys(sample):
        place = np.empty(n, int)
        place[np.argsort(key, kind="stable")] = np.arange(n)
        gaps.append(np.abs(place[truth] - place[asked][:, None]))
    fits = []
    for m in range(min(2, len(gaps)), len(gaps) + 1):
        nearest = np.min(gaps[:m], axis=0)
        share = next(s for s in SHARES if s == 1.0 or (nearest <= s * n / 2).mean() >= recall)
        fits.append((m * share, m, share))
    return min(fits)[1:]


def index(vectors: DataFrame, k: int, every: int, curves: int = 4, dims: int = 8, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame] | None:
    """(rows by cell, visits by cell), each (cell, id, v); None below two rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = saved(valid_vectors(vectors, key, vector, zero=False), "vectors")
    n = rows.count()
    if n < 2:
        return None
    sample = np.stack(rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()["v"].to_numpy())
    fitted = Curves(sample, curves, dims)
    used, share = fit_windows(fitted, sample, max(min(5, k), -(-k * len(sample) // n)), recall)
    fitted.maps = fitted.maps[:used]
    # a window of WINDOW cells and one more for where the query stands in its own
    ranges = max(1, min(MOST_RANGES, round(WINDOW / share), n // 8))
    wide = -(-round(share * ranges * 1000) // 2000)
    keyed = saved(mapped(rows, "id long, v array<double>, keys array<long>", lambda ids, v: {"id": pa.array(ids), "v": lists(v), "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * used), pa.array(np.stack(fitted.keys(v), 1).ravel()))}), "keys")
    cuts = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = keyed.agg(*(F.percentile_approx(F.col("keys")[c], cuts, max(10_000, 4 * ranges)).alias(f"c{c}") for c in range(used))).first()
    edges = [np.unique(bounds[c]) if ranges > 1 else np.empty(0, np.int64) for c in range(used)]

    def cells(batches):
        for b in batches:
            keys = matrix(b.column(2))
            own = np.stack([np.searchsorted(edges[c], keys[:, c], side="right") for c in range(used)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * used), pa.array(own.astype(np.int64).ravel()))], ["id", "v", "keys"])

    placed = keyed.mapInArrow(cells, "id long, v array<double>, keys array<long>").select("id", "v", F.posexplode("keys").alias("curve", "place"))
    table = placed.groupBy("curve", "place").count().toPandas().sort_values(["curve", "place"])  # at most curves * MOST_RANGES rows
    table["parts"] = -(-table["count"] // CELL)
    table["cell"] = table["parts"].cumsum() - table["parts"]
    known = F.broadcast(spark.createDataFrame(table[["curve", "place", "cell", "parts"]], "curve int, place long, cell long, parts long"))
    data = placed.join(known, ["curve", "place"]).select((F.col("cell") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("cell"), "id", "v")
    window = F.explode(F.sequence(F.col("place") - wide, F.col("place") + wide))
    asked = placed.where(F.pmod("id", F.lit(every)) == 0).select("id", "v", "curve", window.alias("place")).join(known, ["curve", "place"])
    visits = asked.select(F.explode(F.sequence(F.col("cell"), F.col("cell") + F.col("parts") - 1)).alias("cell"), "id", "v")
    return data, visits


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, curves: int = 4, dims: int = 8, recall: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose key `every` divides."""
    made = index(vectors, k, every, curves, dims, recall, key, vector)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(search_cells(*made, k), k)
