"""Joins and groupings of half-open intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.clocks import EPS, overlaps

#: Longest text segment in seconds; bins of this size give each interval a few bins.
BIN = 120.0


def overlap_join(left: DataFrame, right: DataFrame, key: str = "source_id", bin_size: float = BIN, eps: float = EPS) -> DataFrame:
    """Pairs of intervals (columns start, end) of one key that overlap by a positive length.

    Every interval is put in the time bins that it touches, the join is an equi-join on key and bin, and a pair is
    emitted in the bin of the later start alone. A hot key is spread over its bins. Right columns get the prefix r_.
    """

    def binned(df):
        bins = F.sequence(F.floor(F.col("start") / bin_size), F.floor(F.col("end") / bin_size))
        return df.where(F.col("start") < F.col("end")).withColumn("_bin", F.explode(bins))

    r = binned(right)
    r = r.select(*(F.col(c).alias(c if c in ("_bin", key) else f"r_{c}") for c in r.columns))
    # both sides grow with the data: neither is sent whole to the driver, however small its estimate
    pairs = binned(left).join(r.hint("merge"), [key, "_bin"])
    first = F.floor(F.greatest("start", "r_start") / bin_size)
    return pairs.where(overlaps(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"), eps) & (F.col("_bin") == first)).drop("_bin")


def segments_read(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """(sample_id, segment_id): the text segments that overlap each sample."""
    return overlap_join(samples, segments).select(F.col("id").alias("sample_id"), F.col("r_id").alias("segment_id"))


def used_by(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, used_by): how many samples read each segment, 0 included."""
    counts = segments_read(samples, segments).groupBy("segment_id").agg(F.count("*").alias("n"))
    return segments.select(F.col("id").alias("segment_id")).join(counts, "segment_id", "left").select("segment_id", F.coalesce("n", F.lit(0)).alias("used_by"))


def with_marked(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """`df` with `mark`: the kind of the first marked range (by kind and start) that it overlaps."""
    hit = overlap_join(df.select("id", "source_id", "start", "end"), ranges.select("source_id", "start", "end", "kind"))
    first = hit.groupBy("id").agg(F.min_by("r_kind", F.struct("r_kind", "r_start")).alias("mark"))
    return df.join(first, "id", "left")


def outside_marked(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows that overlap no marked range."""
    hit = overlap_join(df.select("id", "source_id", "start", "end"), ranges.select("source_id", "start", "end")).select("id").distinct()
    return df.join(hit, "id", "left_anti")


def related(samples: DataFrame, k: int = 5) -> DataFrame:
    """(id, other, shared, rank, total): the k samples of the same source that share most time with each, and how many there are."""
    own = samples.select("id", "source_id", "start", "end")
    pairs = overlap_join(own, own, eps=1e-6).where(F.col("id") != F.col("r_id"))
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    w = Window.partitionBy("id")
    ranked = pairs.select("id", F.col("r_id").alias("other"), shared.alias("shared"))
    ranked = ranked.withColumn("rank", F.row_number().over(w.orderBy(F.desc("shared"), "other")))
    totals = ranked.groupBy("id").agg(F.count("*").alias("total"))
    return ranked.where(F.col("rank") <= k).join(totals, "id")


def islands(df: DataFrame, key: str = "source_id", gap: float = 0.0) -> DataFrame:
    """(key, start, end, members): unions of intervals that overlap or lie at most `gap` apart."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members")).drop("_island")


def covered_length(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """(id, covered): how much of each interval the ranges cover, overlaps among them counted once."""
    merged = islands(ranges.select("source_id", "start", "end")).drop("members")
    hits = overlap_join(df.select("id", "source_id", "start", "end"), merged)
    per = hits.groupBy("id").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("covered"))
    return df.select("id").join(per, "id", "left").select("id", F.coalesce("covered", F.lit(0.0)).alias("covered"))


def conflicts_with_cut(new: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, conflicts, can_cut): overlaps of each new interval; it can be cut when all reach in from one side only."""
    hit = overlap_join(new, segments)
    inside = (F.col("r_start") > F.col("start") + EPS) & (F.col("r_end") < F.col("end") - EPS)
    over = (F.col("r_start") <= F.col("start") + EPS) & (F.col("r_end") >= F.col("end") - EPS)
    per = hit.groupBy("id").agg(F.count("*").alias("conflicts"), (F.max((inside | over).cast("int")) == 0).alias("can_cut"))
    return new.select("id").join(per, "id", "left").select("id", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("can_cut", F.lit(False)).alias("can_cut"))


def difference(df: DataFrame, ranges: DataFrame, least: float = EPS) -> DataFrame:
    """(id, source_id, piece, start, end, cut): what the ranges leave of each interval, in order.

    cut: which sides of the piece a range has cut: none, left, right or both. Pieces of at most `least` seconds are no pieces;
    an interval that is covered whole has none.
    """
    merged = islands(ranges.select("source_id", "start", "end")).drop("members")
    own = df.select("id", "source_id", "start", "end")
    hits = overlap_join(own, merged)
    order = Window.partitionBy("id").orderBy("r_start")
    before = hits.select("id", "source_id", F.greatest("start", F.coalesce(F.lag("r_end").over(order), F.col("start"))).alias("a"), F.col("r_start").alias("b"), F.lag("r_end").over(order).isNotNull().alias("left"), F.lit(True).alias("right"))
    last = hits.groupBy("id", "source_id", F.col("end").alias("b")).agg(F.max("r_end").alias("a"))
    after = last.select("id", "source_id", "a", "b", F.lit(True).alias("left"), F.lit(False).alias("right"))
    whole = own.join(hits.select("id"), "id", "left_anti").select("id", "source_id", F.col("start").alias("a"), F.col("end").alias("b"), F.lit(False).alias("left"), F.lit(False).alias("right"))
    pieces = before.unionByName(after).unionByName(whole).where(F.col("b") - F.col("a") > least)
    cut = F.when(F.col("left") & F.col("right"), "both").when(F.col("left"), "left").when(F.col("right"), "right").otherwise("none")
    place = F.row_number().over(Window.partitionBy("id").orderBy("a")) - 1
    return pieces.select("id", "source_id", place.alias("piece"), F.col("a").alias("start"), F.col("b").alias("end"), cut.alias("cut"))


def plan_add(new: DataFrame, segments: DataFrame, resolve: str | None = None) -> DataFrame:
    """(new_id, error, op, id, version, start, end, deleted): what adding each new segment (id, source_id, start, end) takes.

    segments: id, source_id, start, end, version. resolve: replace deletes the segments that the new one overlaps; cut
    moves their end or start to it, which each must allow from one side; none is an error (segment-overlap) where any overlap.
    A new segment that can be added has its own row last, with op create. New segments are planned one by one.
    """
    if resolve not in (None, "replace", "cut"):
        raise ValueError("overlaps are resolved by replace or cut")
    hit = overlap_join(new.select("id", "source_id", "start", "end"), segments.select("id", "source_id", "start", "end", "version"), eps=0.0)
    left = (F.col("r_start") < F.col("start")) & (F.col("start") < F.col("r_end")) & (F.col("r_end") <= F.col("end") + EPS)
    right = (F.col("start") - EPS <= F.col("r_start")) & (F.col("r_start") < F.col("end")) & (F.col("end") < F.col("r_end"))
    judged = hit.withColumns({"_left": F.col("r_start") < F.col("start"), "_cut": left | right})
    per = judged.groupBy("id").agg(F.count("*").alias("n"), F.min("_cut").alias("can"))
    state = new.select("id", "source_id", "start", "end").join(per, "id", "left")
    open_ = F.lit(resolve is None) | (F.lit(resolve == "cut") & ~F.coalesce("can", F.lit(True)))
    state = state.withColumn("error", F.when(F.col("n").isNotNull() & open_, "segment-overlap"))
    none = lambda kind: F.lit(None).cast(kind)
    ok = judged.join(state.where("error is null").select("id"), "id", "left_semi")
    moved = resolve == "cut"
    ops = ok.select(
        F.col("id").alias("new_id"), none("string").alias("error"), F.lit("update").alias("op"), F.col("r_id").alias("id"), F.col("r_version").alias("version"),
        (F.when(~F.col("_left"), F.col("end")) if moved else none("double")).alias("start"), (F.when(F.col("_left"), F.col("start")) if moved else none("double")).alias("end"), F.lit(not moved).alias("deleted"),
    )
    made = state.select(F.col("id").alias("new_id"), "error", F.when(F.col("error").isNull(), "create").alias("op"), none("long").alias("id"), none("long").alias("version"), F.when(F.col("error").isNull(), F.col("start")).alias("start"), F.when(F.col("error").isNull(), F.col("end")).alias("end"), F.lit(False).alias("deleted"))
    return ops.withColumn("id", F.col("id").cast("long")).withColumn("version", F.col("version").cast("long")).unionByName(made)


def with_ordinal(segments: DataFrame) -> DataFrame:
    """The place of each segment in its source, by start, end and id."""
    return segments.withColumn("ordinal", F.row_number().over(Window.partitionBy("source_id").orderBy("start", "end", "id")))


def lay_out(items: DataFrame, beat: float, key: str = "source_id", order: str = "id") -> DataFrame:
    """Items one after the other with a space of one bar (four beats) between them."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumn("at", F.coalesce(F.sum(F.col("end") - F.col("start") + 4 * beat).over(before), F.lit(0.0)))
