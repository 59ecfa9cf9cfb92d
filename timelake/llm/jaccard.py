"""N-gram Jaccard join: MinHash bands propose pairs, full n-gram sets decide them.

Texts are lower-cased and split at white space; their n-grams are runs of n words (a shorter, non-empty text is one
n-gram). Documents with equal n-gram sets are copies: each distinct set is one node, whatever its documents' keys are.
Band and row counts are chosen for the wanted recall at the threshold. A bucket of at most SMALL nodes proposes all its
pairs. Larger buckets are compared inside tasks (set intersections as a matrix product) by blocks of bounded texts and
n-grams. First each bucket of one band is cut into blocks that share a few centers, which connects a group of near copies
at a cost in proportion to its size; then, in all bands, only texts that no link connects yet meet the others.
A task gives back the verified links that connect its parts. So every pair that shares a bucket is verified, or is
connected by verified links, or has set sizes too far apart; no cap drops a pair. Two similar texts are then in one
component, so the number of links is counted there: blocks of a component meet in tasks once a pair, and only counts
leave the tasks. SMALL and the block sizes decide how the work is dealt, never the result. No side of a join has a proven
bound, so all are merged, and the driver gets counts alone.

Edge cases: null, empty and blank texts have no n-grams, no links and a class of their own. Rows with a null key get
no row. Rows of equal key are one document in the result: it takes the smallest class and the most links of its texts;
the texts themselves are compared one by one, so none hides another. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, drop, free_name, partitions, saved
from .components import components
from .hashing import mix, pieces, window_hashes, word_hashes

#: Buckets of at most this many texts propose all their pairs.
SMALL = 8
#: Larger buckets are compared by blocks of this many texts and n-grams: bounds what a task holds, however long texts are.
BLOCK, GRAMS = 128, 1 << 18
#: Texts of a bucket that all its first blocks share.
CENTERS = 8


def bands_for(threshold: float, recall: float, hashes: int = 110) -> tuple[int, int]:
    """(bands, rows): the most rows whose bands reach the recall at the threshold within the number of hashes."""
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no band count reaches this recall within this many hashes")
    return best


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, one after the other, and their counts."""
    words, counts = word_hashes([t.lower().encode() for t in texts])
    full, windows = window_hashes(words, counts, n)
    ends = np.cumsum(counts)
    short = np.flatnonzero((counts > 0) & (counts < n))
    parts, at = [], np.r_[0, np.cumsum(windows)]
    sizes = np.zeros(len(texts), np.int64)
    few = {int(i): mix(np.array([window_hashes(words[ends[i] - counts[i] : ends[i]], counts[i : i + 1], int(counts[i]))[0][0] + np.uint64(counts[i])])) for i in short}
    for i in range(len(texts)):
        own = few[i] if i in few else np.unique(full[at[i] : at[i + 1]])
        parts.append(own)
        sizes[i] = len(own)
    return np.concatenate([np.empty(0, np.uint64), *parts]), sizes


def _sketch(n: int, bands: int, rows: int):
    r = np.random.default_rng(11)
    a = (r.integers(0, 2**31, bands * rows) * 2 + 1).astype(np.uint32)
    c = r.integers(0, 2**32, bands * rows).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes, texts = b.column(0), b.column(1), b.column(2).to_pylist()
            for x, y in pieces(texts):
                h, sizes = shingles(texts[x:y], n)
                some = np.flatnonzero(sizes)
                first = (np.cumsum(sizes) - sizes)[some]
                low = (h >> np.uint64(32)).astype(np.uint32)
                s1 = np.zeros(y - x, np.uint64)
                s2 = np.zeros(y - x, np.uint64)
                sig = np.empty((bands * rows, len(some)), np.uint64)
                if len(some):
                    s1[some] = np.add.reduceat(mix(h ^ np.uint64(0x1234567)), first)
                    s2[some] = np.add.reduceat(mix(h + np.uint64(0x9E3779B97F4A7C15)), first)
                    for k in range(bands * rows):
                        sig[k] = np.minimum.reduceat((low ^ c[k]) * a[k], first)
                keys = np.empty((bands, len(some)), np.uint64)
                for k in range(bands):
                    key = np.full(len(some), k, np.uint64)
                    for row in sig[k * rows : (k + 1) * rows]:
                        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
                    keys[k] = key
                ends = np.zeros(y - x + 1, np.int32)
                ends[some + 1] = bands
                banded = pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), pa.array(keys.T.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), hashes.slice(x, y - x), pa.array(sizes), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), banded], ["id", "h", "n", "s1", "s2", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for x, y in pieces(texts):
                h, sizes = shingles(texts[x:y], n)
                ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["id", "grams"])

    return run


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs` (with a and b) and their exact Jaccard similarity `sim`."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")).hint("merge"), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")).hint("merge"), "b")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.select(*pairs.columns, (common / (F.size("ga") + F.size("gb") - common)).alias("sim"))


def _verified_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links among `pairs` (a, na, b, nb); set sizes too far apart for the threshold are left out first."""
    possible = pairs.where((F.col("na") >= threshold * F.col("nb")) & (F.col("nb") >= threshold * F.col("na")))
    ordered = possible.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return saved(verified(ordered, sets).where(F.col("sim") >= threshold).select("a", "b"), "links")


def _links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a < b) that connect all similar texts of each bucket. members: (bucket, band, id, n, size)."""
    few = members.where(F.col("size") <= SMALL).select("bucket", F.col("id").alias("a"), F.col("n").alias("na"))
    other = few.select("bucket", F.col("a").alias("b"), F.col("na").alias("nb"))
    links = _verified_links(few.join(other.hint("merge"), "bucket").where("a < b"), sets, threshold)
    large = saved(members.where(F.col("size") > SMALL).select("bucket", "band", "id", "n"), "large")
    links = saved(links.union(_block_links(_first_blocks(large.where("band = 0")), sets, threshold)), "links")
    labels = components(links)
    rows = saved(large.join(labels.hint("merge"), large["id"] == labels["node"], "left").select("bucket", "id", "n", F.coalesce("label", "id").alias("comp")), "labelled")
    more = saved(links.union(_block_links(_blocks(rows, threshold), sets, threshold)), "links")
    drop(large, labels, rows, links)
    return more


def _parts_of(texts, grams, by: int = 1):
    """How many blocks so many texts and n-grams need."""
    return F.ceil(F.greatest(texts / (by * BLOCK), grams / (by * GRAMS))).cast("long")


def _upto(n):
    """The numbers below n."""
    zero = F.lit(0).cast("long")
    return F.filter(F.sequence(zero, n), lambda i: i < n)


def _first_blocks(rows: DataFrame) -> DataFrame:
    """(gid, id, comp): each bucket's texts by blocks, each block with the bucket's centers (the smallest texts by hash)."""
    info = saved(rows.groupBy("bucket").agg(_parts_of(F.count("*"), F.sum("n"), 2).alias("k")), "first-blocks")
    centers = rows.groupBy("bucket", F.pmod(F.xxhash64("id", F.lit("center")), F.lit(CENTERS)).alias("c")).agg(F.min_by("id", F.xxhash64("id", "bucket")).alias("id"))
    shared = centers.join(info.hint("merge"), "bucket").select("bucket", "id", F.explode(_upto(F.col("k"))).alias("j"))
    own = rows.join(info.hint("merge"), "bucket").select("bucket", "id", F.pmod(F.xxhash64("id", "bucket"), F.col("k")).alias("j"))
    return own.union(shared).select(F.xxhash64("bucket", "j", F.lit("first")).alias("gid"), "id", F.col("id").alias("comp"))


def _blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(gid, id, comp): groups of at most two blocks that together hold every pair of a bucket that no link connects yet.

    The bucket's largest connected part (main) and the rest are cut into blocks by hash. Each block of the rest meets
    each other one and each block of the main part; blocks of the main part need not meet. Main texts whose set sizes
    are out of reach for all of the rest are left out.
    """
    parts = saved(rows.groupBy("bucket", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("g"), F.min("n").alias("least"), F.max("n").alias("most")), "parts")
    by = F.struct("k", "comp")
    main = parts.groupBy("bucket").agg(F.max_by("comp", by).alias("main"), F.max("k").alias("k"), F.max_by("g", by).alias("g"), F.sum("k").alias("all"), F.sum("g").alias("all_g")).where("all > k")
    rest = parts.join(main.select("bucket", "main").hint("merge"), "bucket").where("comp <> main")
    reach = rest.groupBy("bucket").agg((F.min("least") * threshold).alias("low"), (F.max("most") / threshold).alias("high"))
    info = main.join(reach.hint("merge"), "bucket").select(
        "bucket", "main", "low", "high", _parts_of(F.col("k"), F.col("g")).alias("n_main"), _parts_of(F.col("all") - F.col("k"), F.col("all_g") - F.col("g")).alias("n_rest"), ((F.col("all") <= 2 * BLOCK) & (F.col("all_g") <= 2 * GRAMS)).alias("one")
    )
    mixed = rows.join(saved(info, "mixed").hint("merge"), "bucket").withColumn("is_main", F.col("comp") == F.col("main"))
    mixed = mixed.where(~F.col("is_main") | F.col("n").between(F.col("low"), F.col("high")))
    own = F.pmod(F.xxhash64("id", "bucket"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest")))
    group = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"), j.cast("long").alias("j"))
    zero = F.lit(0)
    with_rest = F.transform(_upto(F.col("n_rest")), lambda j: group("m", F.col("own"), j))
    of_rest = F.concat(F.transform(_upto(F.col("n_main")), lambda i: group("m", i, F.col("own"))), F.transform(_upto(F.col("n_rest")), lambda j: group("r", F.least(j, F.col("own")), F.greatest(j, F.col("own")))))
    groups = F.when(F.col("one"), F.array(group("a", zero, zero))).when(F.col("is_main"), with_rest).otherwise(of_rest)
    placed = mixed.withColumn("own", own).select("bucket", "id", "comp", F.explode(groups).alias("g"))
    return placed.select(F.xxhash64("bucket", "g.kind", "g.i", "g.j").alias("gid"), "id", "comp")


def _alike(grams: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets are similar, as a square table."""
    m = len(grams)
    owner = np.repeat(np.arange(m), [len(g) for g in grams])
    _, col, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    owner, col = owner[keep], place[col[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    common = np.zeros((m, m), np.float32)
    for low in range(0, int(shared.sum()), 1 << 14):
        a, b = np.searchsorted(col, [low, low + (1 << 14)])
        part = np.zeros((m, min(1 << 14, int(shared.sum()) - low)), np.float32)
        part[owner[a:b], col[a:b] - low] = 1
        common += part @ part.T
    size = np.array([len(g) for g in grams], np.float64)
    return common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6


def _forest(ids: list[int], comps: list[int], grams: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Verified links that connect all similar texts of one group, at most one fewer than its parts."""
    m = len(ids)
    if m < 2:
        return []
    alike = _alike(grams, threshold)
    label, out = np.unique(comps, return_inverse=True)[1], []
    for i in range(m):
        near = np.flatnonzero(alike[i, i + 1 :]) + i + 1
        near = near[label[near] != label[i]]
        if len(near):
            other, first = np.unique(label[near], return_index=True)
            out += [(ids[i], ids[j]) for j in near[first]]
            label[np.isin(label, other)] = label[i]
    return out


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows (without gid and grams) and sets of one gid after another; the batches are sorted by gid."""
    gid, rows, grams = None, [], []
    for b in batches:
        lists = b.column(b.num_columns - 1)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for i, (g, *row) in enumerate(zip(*(b.column(j).to_pylist() for j in range(b.num_columns - 1)), strict=True)):
            if g != gid and rows:
                yield rows, grams
                rows, grams = [], []
            gid = g
            rows.append(tuple(row))
            grams.append(flat[ends[i] : ends[i + 1]].copy())
    if rows:
        yield rows, grams


def _with_sets(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """`groups` and their texts' sets, one group after another; a task holds one group's sets at a time."""
    filled = groups.join(sets.hint("merge"), "id").select(*groups.columns, "grams")
    return filled.repartition(partitions(groups.sparkSession), "gid").sortWithinPartitions("gid")


def _block_links(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a < b) of all groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grams in _by_group(batches):
            ids, comps = zip(*rows, strict=True)
            found = [(min(p), max(p)) for p in _forest(ids, comps, grams, threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return _with_sets(groups, sets).mapInArrow(run, "a long, b long").distinct()


def _meetings(texts: DataFrame, threshold: float) -> DataFrame:
    """(gid, id, copies, side): groups in which any two texts of a component (comp, id, n, copies) meet exactly once.

    A component of few texts is one group. Others are cut by set size into levels, so wide that similar texts are on one
    level or on neighbouring ones, and each level into blocks by hash. Texts of different sides meet, and those of side 2.
    """
    whole = texts.groupBy("comp").agg(((F.count("*") <= 2 * BLOCK) & (F.sum("n") <= 2 * GRAMS)).alias("one"))
    level = F.when(F.col("one"), F.lit(0)).otherwise(F.floor(F.log("n") / (math.log(1 / threshold) + 1e-9))).cast("long")
    leveled = saved(texts.join(saved(whole, "whole").hint("merge"), "comp").select("comp", "id", "n", "copies", level.alias("level")), "leveled")
    blocks = leveled.groupBy("comp", "level").agg(_parts_of(F.count("*"), F.sum("n"), 2).alias("k"))
    by_level = saved(blocks.groupBy("comp").agg(F.map_from_entries(F.collect_list(F.struct("level", "k"))).alias("blocks")), "levels")
    here, zero = F.col("level"), F.lit(0).cast("long")
    blocks_of = lambda at: F.coalesce(F.try_element_at("blocks", at), zero)
    group = lambda low, i, high, j, side: F.struct(low.alias("low"), i.alias("i"), high.alias("high"), j.alias("j"), side.cast("int").alias("side"))
    own = F.col("own")
    among = F.transform(_upto(blocks_of(here)), lambda j: group(here, F.least(own, j), here, F.greatest(own, j), F.when(own == j, 2).when(own < j, 0).otherwise(1)))
    above = F.transform(_upto(blocks_of(here + 1)), lambda j: group(here, own, here + 1, j, F.lit(0)))
    below = F.transform(_upto(blocks_of(here - 1)), lambda i: group(here - 1, i, here, own, F.lit(1)))
    placed = leveled.join(by_level.hint("merge"), "comp").withColumn("own", F.pmod(F.xxhash64("id", "comp"), blocks_of(here)))
    met = placed.select("comp", "id", "copies", F.explode(F.concat(among, above, below)).alias("g"))
    return met.select(F.xxhash64("comp", "g.low", "g.i", "g.high", "g.j").alias("gid"), "id", "copies", F.col("g.side").alias("side"))


def _partners(texts: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, partners): the documents of all different texts that a text (comp, id, n, copies) is similar to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, grams in _by_group(batches):
            ids, copies, sides = (np.array(c) for c in zip(*rows, strict=True))
            pairs = _alike(grams, threshold) & ((sides[:, None] != sides[None, :]) | (sides == 2))
            np.fill_diagonal(pairs, False)
            count = (pairs * copies[None, :]).sum(axis=1)
            some = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some])], ["id", "part"])

    counted = _with_sets(_meetings(texts, threshold), sets).mapInArrow(run, "id long, part long")
    return counted.groupBy("id").agg(F.sum("part").alias("partners"))


_SAME = ["n", "s1", "s2"]


def _classes(docs: DataFrame, n: int, threshold: float, recall: float, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The sketches (id, h, n, s1, s2) of all rows, and one row a distinct n-gram set: its class's smallest document (first), copies, partners."""
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = bands_for(threshold, recall)
    whole = F.coalesce(docs[text].cast("string"), F.lit(""))
    source = docs.where(docs[key].isNotNull()).select(docs[key].cast("long").alias("id"), F.xxhash64(whole).alias("h"), whole.alias("t"))
    sketch = saved(source.mapInArrow(_sketch(n, bands, rows), "id long, h long, n long, s1 long, s2 long, bands array<long>"), "sketch")
    sets_of = sketch.where("n > 0").groupBy(*_SAME).agg(F.min(F.struct("id", "h")).alias("rep"), F.count_distinct("id").alias("copies"), F.first("bands").alias("bands"))
    reps = saved(sets_of.withColumn("node", F.monotonically_increasing_id()), "reps")
    buckets = reps.select(F.col("node").alias("id"), "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = saved(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    members = saved(buckets.join(sizes.hint("merge"), "bucket"), "buckets")
    wanted = members.select("id").distinct().join(reps.hint("merge"), F.col("id") == reps["node"]).select("rep.id", "rep.h", "node")
    # the list of candidates has no bound: it is merged at every size, never broadcast; repeated rows count once
    texts = source.join(wanted.hint("merge"), ["id", "h"]).groupBy("id", "h").agg(F.first("node").alias("node"), F.first("t").alias("t"))
    sets = saved(texts.select("node", "t").mapInArrow(_sets(n), "id long, grams array<long>"), "sets")
    links = _links(members, sets, threshold)
    labels = components(links)
    linked = saved(labels.join(reps.hint("merge"), "node").select(F.col("label").alias("comp"), F.col("node").alias("id"), "n", "copies", "rep"), "linked")
    partners = _partners(linked.select("comp", "id", "n", "copies"), sets, threshold)
    first = saved(linked.groupBy("comp").agg(F.min("rep").alias("first")), "first")
    named = linked.join(first.hint("merge"), "comp").join(partners.hint("merge"), "id", "left").select(F.col("id").alias("node"), "first", "partners")
    by_set = reps.drop("bands").join(named.hint("merge"), "node", "left").select(*_SAME, F.coalesce("first", "rep").alias("first"), "rep", "copies", F.coalesce("partners", F.lit(0)).alias("partners"))
    by_set = saved(by_set, "classes")
    drop(sizes, members, sets, links, labels, linked, first, reps)
    return sketch.drop("bands"), by_set


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per key: class_id (its class's smallest key), n_copies (documents of an equal n-gram set) and n_links.

    n_links counts the other copies and, with their copies, all different texts of its class that are similar to it.
    """
    sketch, by_set = _classes(docs, n, threshold, recall, key, text)
    links = F.col("copies") - 1 + F.col("partners")
    found = sketch.where("n > 0").join(by_set.hint("merge"), _SAME).select("id", F.col("first.id").alias("class_id"), "copies", links.alias("links"))
    alone = sketch.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"), F.lit(0).cast("long").alias("links"))
    return (
        found.union(alone)
        .groupBy(F.col("id").alias(key))
        .agg(F.min("class_id").alias("class_id"), F.max("copies").alias("n_copies"), F.max("links").alias("n_links"))
    )


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9995, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with one row of each class: that with the smallest key (of its several texts the one of smallest hash).

    Rows without n-grams stay, one of equal key and text. Rows with a null key stay. A key with several texts keeps those
    that are no copies of others.
    """
    sketch, by_set = _classes(docs, n, threshold, recall, key, text)
    k, h = free_name(docs, "_key"), free_name(docs, "_hash")
    firsts = by_set.where("rep = first").select("rep.id", "rep.h").union(sketch.where("n = 0").select("id", "h"))
    firsts = firsts.select(F.col("id").alias(k), F.col("h").alias(h))
    rows = docs.where(docs[key].isNotNull()).withColumns({k: F.col(key).cast("long"), h: F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    kept = rows.join(firsts.hint("merge"), [k, h], "left_semi").dropDuplicates([k, h]).select(*docs.columns)
    return kept.union(docs.where(docs[key].isNull()))
