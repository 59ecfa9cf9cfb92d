"""Hard-negative mining through an inverted multi-index.

Vectors, quantised to whole numbers, are cut into two halves, and each half has a codebook of its own (k-means on a bounded
sample). A pair of codewords is a cell. A half's part of any inner product is at most q.c + |q| r, r being the codeword's
radius (the largest distance of its rows' halves), so a cell's rows score at most the sum of two such half bounds. A search
takes the codewords of each half by falling bound and walks their pairs by falling sum through a heap (multi-sequence), scores
the rows of the cells that it meets, and stops once its windows are certified: no cell that is left can change them.

Neighbouring cells are packed into shards of at most SHARD rows, whatever the number of rows; a cell that is larger alone is
dealt to several by hash. A task holds one shard at a time. An anchor first visits the shards that promise most; what it finds
there bounds its windows, and it visits only those other shards with a cell that reaches into them. The same walk runs twice:
for an anchor's positives (rows of its label, best first), then for the negatives of all its windows
[low * positive / 100, high * positive / 100] at once, where cells that lie wholly above all windows are left out too.
Scores are exact integers; bounds decide only what is scanned.

Hot shards: where very many anchors visit one, its rows are repeated for several lanes of anchors, so no task takes them all.
The driver and the tasks hold one row a cell, at most CODEWORDS squared.

Edge cases: null keys, labels or vectors, null or non-finite components and vectors of an unusual length take no part; rows of
equal key count once (the smallest vector and label stay); zero vectors take part. An anchor without other rows of its label
has no rows, nor has a positive without negatives in its window (a negative score has none). An empty table gives no rows.
Components must stay below 2**31 after scaling. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, partitions
from .vectors import finite_vectors, matrix

#: Rows that the codebooks are learnt from, codewords of a half at most, rows that a cell is meant to hold, k-means passes.
SAMPLE, CODEWORDS, CELL, PASSES = 8192, 256, 64, 8
#: Rows in a shard at most (and what a small table's shards hold at least), visits that one lane of a shard takes, rows scored at once.
SHARD, LEAST, LANE, STEP = 8192, 512, 20_000, 256

_ROW = "shard int, lane int, kind int, c1 int, c2 int, id long, label long, v array<double>, tops array<long>, least array<long>"
_OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def codebook(sample: np.ndarray, count: int) -> np.ndarray:
    """At most `count` centers of the rows by Lloyd's passes, starting from rows that are spread over the sample."""
    distinct = np.unique(sample, axis=0)
    centers = distinct[np.linspace(0, len(distinct) - 1, min(count, len(distinct))).astype(int)]
    for _ in range(PASSES):
        near = nearest(sample, centers)
        held = np.bincount(near, minlength=len(centers))
        total = np.zeros_like(centers)
        np.add.at(total, near, sample)
        centers = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], centers)
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers * centers).sum(1) - 2 * x @ centers.T).argmin(1)


def gaps(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - centers) ** 2).sum(1))


def half_bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(middle, reach) for each query and codeword: the half's score lies within middle +- reach, rounding included."""
    middle, norm = q @ centers.T, np.sqrt((q * q).sum(1))[:, None]
    return middle, norm * radii[None, :] + 1e-9 * norm * (np.sqrt((centers * centers).sum(1)) + radii)[None, :]


def by_falling_sum(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) for all pairs, by falling a[i] + b[j]: the multi-sequence heap."""
    x, y = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, x, y = a[x].tolist(), b[y].tolist(), x.tolist(), y.tolist()
    heap = [(-(a[0] + b[0]), 0, 0)] if a and b else []
    while heap:
        s, i, j = heapq.heappop(heap)
        yield -s, x[i], y[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))


class Windows:
    """The k best of each window (least[i] <= score <= tops[i]), ties to the smaller id."""

    def __init__(self, tops, least, k: int):
        self.tops, self.least, self.k = list(tops), list(least), k
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.tops]

    def floor(self) -> float:
        """No score below it can change a window."""
        return min(self.least)

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for w, (top, least) in enumerate(zip(self.tops, self.least, strict=True)):
            fits = (scores >= least) & (scores <= top)
            if fits.any():
                i, s = np.concatenate([self.found[w][0], ids[fits]]), np.concatenate([self.found[w][1], scores[fits].astype(np.int64)])
                order = np.lexsort((i, -s))[: self.k]
                self.found[w] = i[order], s[order]
                if len(order) == self.k:
                    self.least[w] = max(least, int(s[order[-1]]))


def walk(windows: Windows, fits: Callable, first: tuple, second: tuple, cells: dict, q: np.ndarray, rows: tuple, wide: bool) -> int:
    """Visit cells by falling bound until the windows are certified; how many rows were scored.

    first, second: (middle, reach) of the shard's codewords; cells: rows (from, to) of each pair of them. wide: scores may not
    fit into a double.
    """
    ids, labels, vectors = rows
    (m1, r1), (m2, r2) = first, second
    top, read, todo, held = max(windows.tops), 0, [], 0

    def score():
        at = np.concatenate([np.arange(a, b) for a, b in todo])
        at = at[fits(ids[at], labels[at])]
        windows.take(ids[at], vectors[at].astype(np.int64) @ q.astype(np.int64) if wide else vectors[at] @ q)

    for bound, i, j in by_falling_sum(m1 + r1, m2 + r2):
        if bound < windows.floor():
            break
        if (i, j) not in cells or m1[i] - r1[i] + m2[j] - r2[j] > top:
            continue
        a, b = cells[i, j]
        todo.append((a, b))
        held += b - a
        if held >= STEP:
            score()
            read, held, todo = read + held, 0, []
    if todo:
        score()
    return read + held


def search(data: DataFrame, visits: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(query_id, slot, ids, scores, scanned): the k best rows of the shard in each window of a visit.

    data, visits: rows of _ROW, kind 0 and 1. same: of the query's label (and not itself), else of other labels. A visit
    without finds gives no rows.
    """
    spark = data.sparkSession
    lanes = scratch.saved(visits.groupBy("shard").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes")), "lanes")  # a row a shard
    spread_rows = data.join(lanes, "shard").withColumn("lane", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))).drop("lanes")
    spread_visits = visits.join(lanes, "shard").withColumn("lane", F.pmod(F.xxhash64("id"), F.col("lanes")).cast("int")).drop("lanes")
    both = spread_rows.unionByName(spread_visits)
    placed = both.repartition(partitions(spark), "shard", "lane").sortWithinPartitions("shard", "lane", "kind", "c1", "c2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, shard = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            col = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            place = col["shard"].to_numpy().astype(np.int64) << 32 | col["lane"].to_numpy()
            kinds, ids, labels = (col[c].to_numpy() for c in ("kind", "id", "label"))
            v = matrix(col["v"])
            turns = np.r_[0, np.flatnonzero((place[1:] != place[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(place)]
            for x, y in zip(turns[:-1], turns[1:], strict=True):
                if place[x] != now:
                    now, held, shard = place[x], [], None
                if kinds[x] == 0:
                    held.append((col["c1"].to_numpy()[x:y], col["c2"].to_numpy()[x:y], ids[x:y], labels[x:y], v[x:y]))
                    continue
                if not held:
                    continue
                if shard is None:
                    shard = Shard(*(np.concatenate(part) for part in zip(*held, strict=True)))
                out = []
                tops, least = col["tops"][x:y].to_pylist(), col["least"][x:y].to_pylist()
                for r, (i, slot, found, scores, read) in shard.visits(ids[x:y], labels[x:y], v[x:y], tops, least, k, same):
                    out.append((int(ids[x + r]), slot, found, scores, read if i == 0 else 0))
                if out:
                    ends = pa.array(np.r_[0, np.cumsum([len(o[2]) for o in out])].astype(np.int32))
                    packed = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([o[j] for o in out]))) for j in (2, 3)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()), *packed, pa.array([o[4] for o in out], pa.int64())], ["query_id", "slot", "ids", "scores", "scanned"])

    return placed.mapInArrow(run, "query_id long, slot int, ids array<long>, scores array<long>, scanned long")


class Shard:
    """Rows of a shard by cell, with the codewords and radii that they themselves have."""

    def __init__(self, c1, c2, ids, labels, v):
        h = v.shape[1] // 2
        self.rows, self.most = (ids, labels, v), max(1.0, np.abs(v).max())
        turns = np.r_[0, np.flatnonzero((c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])) + 1, len(c1)]
        codes = [np.unique(c, return_inverse=True) for c in (c1, c2)]
        self.books = []
        for (names, at), half in zip(codes, (v[:, :h], v[:, h:]), strict=True):
            # the middle of the shard's own rows of a codeword: its radius is at most that of the codebook's center
            total = np.zeros((len(names), half.shape[1]))
            np.add.at(total, at, half)
            center = total / np.bincount(at, minlength=len(names))[:, None]
            radius = np.zeros(len(names))
            np.maximum.at(radius, at, gaps(half, center[at]))
            self.books.append((center, radius))
        self.cells = {(int(codes[0][1][a]), int(codes[1][1][a])): (int(a), int(b)) for a, b in zip(turns[:-1], turns[1:], strict=True)}

    def visits(self, ids, labels, v, tops, least, k, same):
        """(row of the visit, (number of the find, slot, ids, scores, rows scored))."""
        h = v.shape[1] // 2
        (m1, r1), (m2, r2) = half_bounds(v[:, :h], *self.books[0]), half_bounds(v[:, h:], *self.books[1])
        for r in range(len(ids)):
            own, label = ids[r], labels[r]
            fits = (lambda i, t, own=own, label=label: (t == label) & (i != own)) if same else (lambda i, t, label=label: t != label)
            windows = Windows(tops[r], least[r], k)
            wide = self.most * max(1.0, np.abs(v[r]).max()) * v.shape[1] >= 2**53
            read = walk(windows, fits, (m1[r], r1[r]), (m2[r], r2[r]), self.cells, v[r], self.rows, wide)
            finds = [(slot, *f) for slot, f in enumerate(windows.found) if len(f[0])]
            for n, (slot, i, s) in enumerate(finds):
                yield r, (n, slot, i, s, read)


class Index:
    """The rows by cell in shards, and the directory of cells by which visits are chosen."""

    def __init__(self, rows: DataFrame, n: int, scratch: Scratch):
        spark = rows.sparkSession
        drawn = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
        sample = np.stack(drawn["v"].to_numpy())
        h = sample.shape[1] // 2
        count = int(min(CODEWORDS, max(1, round((n / CELL) ** 0.5))))
        books = [codebook(x, count) for x in (sample[:, :h], sample[:, h:])]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = matrix(b.column(2))
                    halves = (v[:, :h], v[:, h:])
                    near = [nearest(x, book) for x, book in zip(halves, books, strict=True)]
                    far = [gaps(x, book[c]) for x, book, c in zip(halves, books, near, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int32)) for c in near), *map(pa.array, far)], ["id", "label", "v", "c1", "c2", "r1", "r2"])

        placed = scratch.saved(rows.select("id", "label", "v").mapInArrow(assign, "id long, label long, v array<double>, c1 int, c2 int, r1 double, r2 double"), "placed")
        cells = placed.groupBy("c1", "c2").agg(F.count("*").alias("rows"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).toPandas()
        cells = cells.sort_values(["c1", "c2"]).reset_index(drop=True)  # at most CODEWORDS squared
        size = max(min(LEAST, SHARD), min(SHARD, n // (4 * partitions(spark))))  # a small table is spread over tasks all the same
        shards, parts, at, room = [], [], -1, 0
        for m in cells["rows"].tolist():
            own = -(-m // size)
            if own > 1 or m > room:
                at, room = at + 1, size
            shards.append(at)
            parts.append(own)
            at, room = (at + own - 1, 0) if own > 1 else (at, room - m)
        cells["shard"], cells["parts"] = np.array(shards, np.int32), np.array(parts, np.int32)
        self.h, self.books = h, books
        self.c1, self.c2, self.r1, self.r2, self.rows, self.shard, self.parts = (cells[c].to_numpy() for c in ("c1", "c2", "r1", "r2", "rows", "shard", "parts"))
        table = spark.createDataFrame(cells[["c1", "c2", "shard", "parts"]], "c1 int, c2 int, shard int, parts int")
        none = F.lit(None).cast("array<long>")
        at = (F.col("shard") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard")
        data = placed.join(F.broadcast(table), ["c1", "c2"]).select(at, F.lit(0).alias("lane"), F.lit(0).alias("kind"), "c1", "c2", "id", "label", "v", none.alias("tops"), none.alias("least"))
        self.data = scratch.saved(data, "shards")
        # one place a shard or a run of parts: cells of one shard stand together
        self.first = np.r_[0, np.flatnonzero(np.diff(self.shard)) + 1]

    def reaches(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and group of cells (a shard, or a hot cell's parts): the largest and the least score possible; rows held."""
        one, two = q[:, : self.h], q[:, self.h :]
        norm = [np.sqrt((x * x).sum(1))[:, None] for x in (one, two)]
        middle = (one @ self.books[0].T)[:, self.c1] + (two @ self.books[1].T)[:, self.c2]
        reach = norm[0] * self.r1 + norm[1] * self.r2
        reach = reach + 1e-9 * (np.abs(middle) + reach + 1)
        return np.maximum.reduceat(middle + reach, self.first, axis=1), np.minimum.reduceat(middle - reach, self.first, axis=1), np.add.reduceat(self.rows, self.first)

    def visits(self, asked: DataFrame, chosen: Callable) -> DataFrame:
        """Rows of _ROW: those shards that `chosen(high, low, held, tops, least)` names for each query (id, label, v, tops, least)."""
        index = self._light()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                v, tops, least = matrix(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()
                for a in range(0, len(v), 64):
                    high, low, held = index.reaches(v[a : a + 64])
                    own = [chosen(high[r], low[r], held, tops[a + r], least[a + r]) for r in range(len(high))]
                    at, group = np.repeat(np.arange(a, a + len(own)), [len(o) for o in own]), np.concatenate(own).astype(int)
                    times = index.parts[index.first[group]]
                    part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    at, shard = np.repeat(at, times), (np.repeat(index.shard[index.first[group]], times) + part).astype(np.int32)
                    few = b.take(pa.array(at))
                    zero, one = (pa.array(np.full(len(at), x, np.int32)) for x in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(shard), zero, one, zero, zero, *few.columns], ["shard", "lane", "kind", "c1", "c2", "id", "label", "v", "tops", "least"])

        return asked.select("id", "label", "v", "tops", "least").mapInArrow(run, _ROW)

    def _light(self) -> Index:
        """The directory without its table, for tasks."""
        out = object.__new__(Index)
        out.__dict__ = {k: x for k, x in self.__dict__.items() if k != "data"}
        return out


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, slot, hits): the k best (neg, id) of all shards."""
    entries = F.transform(F.arrays_zip(F.col("scores").alias("score"), F.col("ids").alias("id")), lambda z: F.struct((-z["score"]).alias("neg"), z["id"].alias("id")))
    return found.groupBy("query_id", "slot").agg(F.slice(F.array_sort(F.flatten(F.collect_list(entries))), 1, k).alias("hits"))


def certified(index: Index, asked: DataFrame, k: int, same: bool, scratch: Scratch) -> DataFrame:
    """(query_id, slot, hits) for queries (id, label, v, tops, least): a first look where most is promised, then all that is open."""

    def promising(high, low, held, tops, least):
        order = np.argsort(-high, kind="stable")
        order = order[(low[order] <= max(tops)) & (high[order] >= min(least))]
        return order[: int(np.searchsorted(np.cumsum(held[order]), 4 * k)) + 1]

    def open_(high, low, held, tops, least):
        return np.flatnonzero((high >= min(least)) & (low <= max(tops)))

    started = scratch.saved(index.visits(asked, promising), "visits")
    early = scratch.saved(search(index.data, started, k, same, scratch), "early")
    known = best(early, k).where(F.size("hits") >= k).select("query_id", "slot", (-F.element_at("hits", k)["neg"]).alias("kth"))
    known = known.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "kth"))).alias("kth"))  # one entry a window
    tighter = F.transform("least", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("kth", i), x)))
    more = asked.join(known.withColumnRenamed("query_id", "id"), "id", "left").withColumn("least", F.when(F.col("kth").isNull(), F.col("least")).otherwise(tighter))
    left = index.visits(more, open_).join(started.select("shard", "id"), ["shard", "id"], "left_anti")
    return best(early.unionByName(search(index.data, scratch.saved(left, "visits"), k, same, scratch)), k)


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key `every` divides. An anchor's positives are the best `positives` other rows of its label; for
    each, the best `negatives` rows of other labels with low * positive_score <= 100 * score <= high * positive_score.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("double"))
    named = vectors.where(vectors[key].isNotNull() & vectors[label].isNotNull()).select(vectors[key].alias("id"), vectors[vector].alias("v"), vectors[label].cast("long").alias("label"))
    once = finite_vectors(named, "id", "v", "label").groupBy("id").agg(F.min(F.struct("v", "label")).alias("r"))
    scratch = Scratch()
    rows = scratch.saved(once.select("id", "r.label", "r.v").withColumn("v", whole), "quantised")
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], _OUT)
    index = Index(rows, n, scratch)
    anchors = rows.where(F.pmod("id", F.lit(every)) == 0)
    free = lambda x: F.array(F.lit(x)).cast("array<long>")
    found = certified(index, anchors.select("id", "label", "v", free(2**63 - 1).alias("tops"), free(1 - 2**63).alias("least")), positives, True, scratch)
    pairs = scratch.saved(found.select(F.col("query_id").alias("anchor_id"), F.explode("hits").alias("hit")).select("anchor_id", F.col("hit.id").alias("positive_id"), (-F.col("hit.neg")).alias("positive_score")), "positives")
    windows = bounds(pairs, low, high).where("least <= top").distinct()
    each = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("top", "least", "positive_score"))).alias("w"))  # at most `positives`
    pick = lambda f: F.transform("w", lambda w: w[f])
    asked = anchors.join(each, anchors["id"] == each["anchor_id"]).select("id", "label", "v", pick("top").alias("tops"), pick("least").alias("least"))
    hard = certified(index, asked, negatives, False, scratch)
    slots = each.select(F.col("anchor_id"), F.posexplode("w").alias("slot", "w")).select("anchor_id", "slot", F.col("w.positive_score").alias("positive_score"))
    flat = hard.select(F.col("query_id").alias("anchor_id"), "slot", F.posexplode("hits").alias("rank", "hit")).join(slots, ["anchor_id", "slot"]).join(pairs, ["anchor_id", "positive_score"])
    return scratch.end(flat.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("negative_id"), "positive_score", (-F.col("hit.neg")).alias("negative_score")), "negatives")


def bounds(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """Whole bounds of each positive's window, in long arithmetic only: ceil(low * s / 100) and floor(high * s / 100)."""
    # s = 100 q + r with 0 <= r < 100
    q, r = "((positive_score - pmod(positive_score, 100L)) div 100)", "pmod(positive_score, 100L)"
    least, top = F.expr(f"{low} * {q} - ((-{low} * {r} - pmod(-{low} * {r}, 100L)) div 100)"), F.expr(f"{high} * {q} + ({high} * {r}) div 100")
    return pairs.select("anchor_id", "positive_score", least.alias("least"), top.alias("top"))
