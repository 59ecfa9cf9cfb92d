"""What the vector searches share: valid vectors, and the scoring of query blocks against bounded cells of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions


def finite_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *more: str, zero: bool = True) -> DataFrame:
    """(id, v, columns of `more`): the rows whose vector has finite components only and the usual length.

    The usual length is the most frequent one, the larger on a tie. Keys may be null, and rows may repeat.
    """
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(df[vector].isNotNull()).select(df[key].cast("long").alias("id"), df[vector].cast("array<double>").alias("v"), *(df[c] for c in more))
    rows = rows.where((F.size(v) > 0) & finite)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(v) == (usual[0].d if usual else 0))


def valid_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", zero: bool = True) -> DataFrame:
    """(id, v): one row a key. Null keys, null vectors, null or non-finite components and odd lengths take no part.

    Rows of equal key count once (the smallest vector stays); for the usual length see `finite_vectors`.
    """
    return finite_vectors(df.where(df[key].isNotNull()), key, vector, zero=zero).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def best_of(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the query, id, score): the k largest inner products of each query, ties to the smaller id, without itself."""
    scores = queries @ vectors.T
    scores[query_ids[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
        q, x = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    else:
        q, x = np.nonzero(scores > -np.inf)
    s = (queries[q] * vectors[x]).sum(1)  # the same for a pair in every cell
    order = np.lexsort((ids[x], -s, q))
    q, x, s = q[order], x[order], s[order]
    first = np.searchsorted(q, np.arange(len(query_ids)))
    top = np.arange(len(q)) - first[q] < k
    return q[top], ids[x[top]], s[top]


def search_cells(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, scores): for each query in each of its cells the k best rows of the cell.

    rows: (cell, id, v); queries: (cell, id, v), one row for each cell that a query visits. A task holds one cell's rows
    at a time and takes the queries of the cell in batches; cells are bounded by their maker.
    """
    both = rows.select("cell", F.lit(0).alias("kind"), "id", "v").union(queries.select("cell", F.lit(1).alias("kind"), "id", "v"))
    placed = both.repartition(partitions(rows.sparkSession), "cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, parts = None, [], []
        merged: tuple | None = None
        for b in batches:
            cells, kinds, own = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            v = matrix(b.column(3))
            turns = np.r_[0, np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(cells)]
            for x, y in zip(turns[:-1], turns[1:], strict=True):
                if cells[x] != cell:
                    cell, ids, parts, merged = cells[x], [], [], None
                if kinds[x] == 0:
                    ids.append(own[x:y])
                    parts.append(v[x:y])
                    continue
                if not ids:
                    continue
                if merged is None:
                    merged = (np.concatenate(ids), np.concatenate(parts))
                for a in range(x, y, 128):
                    z = min(a + 128, y)
                    q, found, s = best_of(*merged, own[a:z], v[a:z], k)
                    ends = pa.array(np.searchsorted(q, np.arange(z - a + 1)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(own[a:z]), pa.ListArray.from_arrays(ends, pa.array(found)), pa.ListArray.from_arrays(ends, pa.array(s))], ["query_id", "ids", "scores"])

    return placed.mapInArrow(run, "query_id long, ids array<long>, scores array<double>")


def scanned(rows: DataFrame, queries: DataFrame) -> float:
    """Rows that all visits read together, as a share of all rows times all queries (rows in several cells count once)."""
    held = rows.groupBy("cell").agg(F.count("*").alias("n"))
    read = queries.groupBy("cell").agg(F.count("*").alias("q")).join(held, "cell").agg(F.sum(F.col("n") * F.col("q"))).first()[0] or 0
    return read / max(1, rows.select("id").distinct().count() * queries.select("id").distinct().count())


def ranked(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all cells; a row that several cells found counts once.

    A query's visits each bring at most k rows; they meet as arrays, and only the k best become rows.
    """
    entries = F.transform(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id")), lambda z: F.struct((-z["score"]).alias("neg"), z["id"].alias("id")))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(entries)))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "hit")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (-F.col("hit.neg")).alias("score"))


def mapped(df: DataFrame, out: str, f: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]]) -> DataFrame:
    """(id, v) through `f(ids, matrix)`, which returns the columns of schema `out`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = f(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return df.select("id", "v").mapInArrow(run, out)


def lists(rows: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))
