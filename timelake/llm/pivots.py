"""Exact top-k inner products through a pivot-distance index.

Vectors get one more component that brings all to the same norm, so that the largest inner product is the smallest
distance. Every row belongs to its nearest pivot (pivots are spread over a bounded sample, each the farthest from those
before it) and is kept in the order of its distance to the pivot. Each pivot's order is cut into annuli of about CELL rows,
whatever their number: an annulus is what a task holds. A query starts in the annulus that may hold the best score and,
inside it, at its own distance; it expands to both sides in steps, and stops where the triangle inequality leaves no
better score than the k-th so far. That k-th score then bounds all other annuli: those that cannot reach it are never
visited, and in the others the same expansion stops. Scores are exact integers on the original quantised vectors, so
the bounds decide only what is scanned.

The driver and the tasks get one row an annulus, of which there are at most MOST_CELLS, as annuli grow beyond that.
Annuli that many equal distances overfill are spread over parts by hash. On vectors without structure nearly all
distances are equal and little can be left out; `rounds` reports how many rows each visit scanned.

Edge cases: see `valid_vectors` (zero vectors take part); with few rows a query gets all others; an empty table gives
no rows. Components must stay below 2**31 after quantising.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, saved
from .vectors import lists, mapped, matrix, ranked, valid_vectors

#: Rows that pivots are chosen from, and how many pivots there are at most.
SAMPLE, MOST_PIVOTS = 4096, 256
CELL, MOST_CELLS = 4096, 1 << 16
#: Rows that an expansion takes at once, and queries whose bounds are computed at once.
STEP, ASKED = 64, 64


def spread_pivots(sample: np.ndarray, count: int, norm2: float) -> np.ndarray:
    """`count` rows of the sample, each the farthest (lifted) from those before it."""
    x = np.c_[sample, np.sqrt(np.maximum(norm2 - (sample * sample).sum(1), 0))]
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def pivot_of(v: np.ndarray, pivots: np.ndarray, norm2: float) -> np.ndarray:
    """Distances of rows, lifted to norm sqrt(norm2), to the lifted pivots."""
    lift = lambda x: np.c_[x, np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))]
    a, b = lift(v), lift(pivots)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0))


def query_distance(q: np.ndarray, pivots: np.ndarray, norm2: float) -> np.ndarray:
    """Distances of queries (lifted by zero) to the lifted pivots."""
    extra = np.sqrt(np.maximum(norm2 - (pivots * pivots).sum(1), 0))
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (pivots * pivots).sum(1) + extra**2 - 2 * q @ pivots.T, 0))


def slack(q2, norm2: float):
    """What rounding may add to a distance: it is a difference of squares of this size."""
    return 1e-7 * np.sqrt(q2 + norm2)


def upper_bounds(q, d, norm2, cell_pivot, low, high):
    """The largest inner product that each cell can hold for each query (distances d to the pivots), rounding included."""
    q2 = (q * q).sum(1)[:, None]
    near = d[:, cell_pivot]
    gap = np.maximum(np.maximum(low - near, near - high) - slack(q2, norm2), 0)
    return (q2 + norm2 - gap**2) / 2 + 1e-9 * (q2 + norm2)


def reach(least: float, q2: float, norm2: float) -> float:
    """How far a row's pivot distance may lie from the query's if its score is to be `least` or more."""
    return math.sqrt(max(q2 + norm2 - 2 * least, 0) + 1e-9 * (q2 + norm2)) + slack(q2, norm2)


def expand(dist: np.ndarray, ids: np.ndarray, vectors: np.ndarray, asker: int, q: np.ndarray, d: float, least: float, norm2: float, k: int, whole: type) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, rows scanned): the k best rows of an annulus sorted by distance, from the query's distance d outwards."""
    q2 = float((q.astype(np.float64) ** 2).sum())
    left = right = int(np.searchsorted(dist, d))
    best_ids, best = np.empty(0, np.int64), np.empty(0, whole)
    q = q.astype(whole)
    while True:
        below = d - dist[left - 1] if left else math.inf
        above = dist[right] - d if right < len(dist) else math.inf
        if min(below, above) > (reach(least, q2, norm2) if least > -math.inf else math.inf) or not (left or right < len(dist)):
            break
        if below <= above:
            a, b = max(0, left - STEP), left
            left = a
        else:
            a, b = right, min(len(dist), right + STEP)
            right = b
        s, i = vectors[a:b].astype(whole, copy=False) @ q, ids[a:b]
        keep = (s >= least) & (i != asker)
        best, best_ids = np.concatenate([best, s[keep]]), np.concatenate([best_ids, i[keep]])
        if len(best) > k:
            order = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[order], best_ids[order]
        if len(best) == k:
            least = max(least, float(best.min()) if whole is np.float64 else int(best.min()))
    return best_ids, best, right - left


def search_annuli(rows: DataFrame, visits: DataFrame, norm2: float, k: int) -> DataFrame:
    """(query_id, ids, scores, scanned) of each visit. rows: (cell, id, v, dist); visits: (cell, id, v, dist, least).

    A task holds one annulus at a time and takes its visits in batches.
    """
    none = F.lit(None).cast("double")
    both = rows.select("cell", F.lit(0).alias("kind"), "id", "v", "dist", none.alias("least")).union(visits.select("cell", F.lit(1).alias("kind"), "id", "v", "dist", "least"))
    placed = both.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "kind", "dist")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, merged, whole = None, [], None, np.float64
        for b in batches:
            cells, kinds, ids, dist = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            v, least = matrix(b.column(3)), b.column(5).to_numpy(zero_copy_only=False)
            turns = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(cells)] if len(cells) else np.zeros(1, int)
            for x, y in zip(turns[:-1], turns[1:], strict=True):
                if cells[x] != cell:
                    cell, held, merged = cells[x], [], None
                if kinds[x] == 0:
                    held.append((dist[x:y], ids[x:y], v[x:y]))
                    continue
                if not held:
                    continue
                if merged is None:
                    merged = tuple(np.concatenate(part) for part in zip(*held, strict=True))
                # float64 is exact below 2**53; beyond that integers are
                whole = np.int64 if max(np.abs(merged[2]).max(), 1) * max(np.abs(v[x:y]).max(), 1) * v.shape[1] >= 2**53 else np.float64
                found = [expand(*merged, int(ids[i]), v[i], dist[i], least[i], norm2, k, whole) for i in range(x, y)]
                ends = pa.array(np.r_[0, np.cumsum([len(f[0]) for f in found])].astype(np.int32))
                packed = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[j] for f in found]).astype(np.int64))) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x:y]), *packed, pa.array([f[2] for f in found], pa.int64())], ["query_id", "ids", "scores", "scanned"])

    return placed.mapInArrow(run, "query_id long, ids array<long>, scores array<long>, scanned long")


def rounds(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, int] | None:
    """(first round, second round, number of rows): the visits' results and how many rows each scanned; None below two rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    rows = saved(valid_vectors(vectors, key, vector).select("id", whole.alias("v")), "quantised")
    head = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).first()
    if head.n < 2:
        return None
    n, norm2 = head.n, float(head.norm2)
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    pivots = spread_pivots(np.stack(drawn["v"].to_numpy()), min(MOST_PIVOTS, max(32, round(math.sqrt(n) / 2))), norm2)
    size = max(CELL, -(-2 * n // MOST_CELLS))

    def assign(ids, v):
        d = pivot_of(v, pivots, norm2)
        near = d.argmin(1)
        return {"id": pa.array(ids), "v": lists(v), "pivot": pa.array(near.astype(np.int32)), "dist": pa.array(d[np.arange(len(d)), near])}

    keyed = saved(mapped(rows, "id long, v array<double>, pivot int, dist double", assign), "pivots")
    count = {r.pivot: r["count"] for r in keyed.groupBy("pivot").count().collect()}  # one row a pivot
    most = max(2, max(-(-m // size) for m in count.values()))
    near_cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / most for i in range(1, most)], max(10_000, 4 * most)).alias("cuts"))
    cuts = {}
    for r in near_cuts.collect():  # at most MOST_CELLS cut points of each pivot
        own = -(-count[r.pivot] // size)  # as many annuli as the pivot's rows need, of the common cut points
        cuts[r.pivot] = np.unique([r.cuts[round(j * most / own) - 1] for j in range(1, own)])

    def annulus(batches):
        for b in batches:
            p, d = b.column(2).to_numpy(), b.column(3).to_numpy()
            ring = np.zeros(len(p), np.int32)
            for x in np.unique(p):
                ring[p == x] = np.searchsorted(cuts[x], d[p == x], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring)], ["id", "v", "pivot", "dist", "ring"])

    ringed = keyed.mapInArrow(annulus, "id long, v array<double>, pivot int, dist double, ring int")
    table = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("rows"), F.min("dist").alias("low"), F.max("dist").alias("high")).toPandas()
    table = table.sort_values(["pivot", "ring"]).reset_index(drop=True)  # at most MOST_CELLS rows
    table["parts"] = -(-table["rows"] // (2 * size))
    table["cell"] = table["parts"].cumsum() - table["parts"]
    cell_pivot, low, high, held, parts, first_part = (table[c].to_numpy() for c in ("pivot", "low", "high", "rows", "parts", "cell"))
    cells = spark.createDataFrame(table[["pivot", "ring", "cell", "parts"]], "pivot int, ring int, cell long, parts long")
    data = saved(ringed.join(F.broadcast(cells), ["pivot", "ring"]).select((F.col("cell") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("cell"), "id", "v", "dist"), "cells")
    queries = rows.where(F.pmod("id", F.lit(every)) == 0)
    visit = "cell long, id long, v array<double>, dist double, least double"

    def visits(ids, v, least, chosen):
        """Rows of `visit` from the cells that each query is to see."""
        d = query_distance(v, pivots, norm2)
        q = np.repeat(np.arange(len(ids)), [len(c) for c in chosen])
        c = np.concatenate([np.empty(0, int), *chosen]).astype(int)
        times = parts[c]
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        q, c = np.repeat(q, times), np.repeat(c, times)
        return {"cell": pa.array(first_part[c] + part, pa.int64()), "id": pa.array(ids[q]), "v": lists(v[q]), "dist": pa.array(d[q, cell_pivot[c]]), "least": pa.array(least[q])}

    def bounded(v):
        """The upper bounds of a few queries at a time."""
        for a in range(0, len(v), ASKED):
            own = v[a : a + ASKED]
            yield from upper_bounds(own, query_distance(own, pivots, norm2), norm2, cell_pivot, low, high)

    def first(ids, v):
        chosen = []
        for bound in bounded(v):
            order = np.argsort(-bound, kind="stable")
            chosen.append(order[: int(np.searchsorted(np.cumsum(held[order]), k + 1)) + 1])
        return visits(ids, v, np.full(len(ids), -math.inf), chosen)

    started = saved(mapped(queries, visit, first), "visits")
    early = saved(search_annuli(data, started, norm2, k), "early")
    best = ranked(early, k)
    least = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    known = queries.join(least, queries["id"] == least["query_id"], "left").select("id", F.concat("v", F.array(F.coalesce(F.col("least").cast("double"), F.lit(-math.inf)))).alias("v"))

    def rest(ids, v):
        v, least = v[:, :-1], v[:, -1]
        return visits(ids, v, least, [np.flatnonzero(bound >= x) for bound, x in zip(bounded(v), least, strict=True)])

    left = mapped(known, visit, rest).join(started.select("cell", "id"), ["cell", "id"], "left_anti").select("cell", "id", "v", "dist", "least")
    return early, search_annuli(data, left, norm2, k), n


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors quantised to floor(scale * x)."""
    done = rounds(vectors, k, every, scale, key, vector)
    if done is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return ranked(done[0].union(done[1]), k)
