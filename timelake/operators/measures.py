"""Measurements over blocks, phones, frames and samples of sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelake.operators.intervals import overlap_join
from timelake.sources.shared import spread

VOWELS = ("a", "i", "u", "e", "o")


def peaks(pcm: DataFrame, bucket: int = 256) -> DataFrame:
    """(asset_id, bucket, low, high): least and largest value of each run of samples over all channels, rounded outwards to int8."""
    g = pcm.groupBy("asset_id", F.floor(F.col("i") / bucket).alias("bucket")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    clamp = lambda c: F.greatest(F.lit(-128), F.least(F.lit(127), c)).cast("int")
    return g.select("asset_id", "bucket", clamp(F.floor(F.col("a") * 127)).alias("low"), clamp(F.ceil(F.col("b") * 127)).alias("high"))


def requery_peaks(found: DataFrame, first: int, last: int, points: int) -> DataFrame:
    """The buckets of [first, last) in at most `points` groups."""
    step = -(-(last - first) // points)
    inside = found.where((F.col("bucket") >= first) & (F.col("bucket") < last))
    return inside.groupBy("asset_id", F.floor((F.col("bucket") - first) / step).alias("point")).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def rms_frames(pcm: DataFrame, rate: int, hop: float = 0.01) -> DataFrame:
    """(asset_id, frame, rms): root mean square of each whole hop."""
    size = round(rate * hop)
    g = pcm.groupBy("asset_id", F.floor(F.col("i") / size).alias("frame")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count_distinct("i").alias("n"))
    return g.where(F.col("n") == size).drop("n")


def glyph(series: DataFrame, k: int = 32) -> DataFrame:
    """(id, cell, value): medians of the finite values of k even parts of each series (id, i, n, x); null where a part has none."""
    cell = F.floor(F.col("i") * k / F.col("n"))
    finite = F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.col("x"))
    return series.groupBy("id", cell.alias("cell")).agg(F.median(finite).alias("value"))


def weighted_median(df: DataFrame, key: str, value: str, weight: str, floor: float = 1e-6) -> DataFrame:
    """(key, value): the lower weighted median: the least value whose running weight reaches half; weights are at least `floor`.

    Rows of equal value are added up first, which bounds what one key sorts.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.sum(F.greatest(F.col(weight).cast("double"), F.lit(floor))).alias("w"))
    run = F.sum("w").over(Window.partitionBy(key).orderBy("v"))
    whole = F.sum("w").over(Window.partitionBy(key))
    return per.withColumn("_run", run).withColumn("_whole", whole).where(F.col("_run") >= F.col("_whole") / 2 - 1e-9).groupBy(key).agg(F.min("v").alias("value"))


def block_attributes(frames: DataFrame) -> DataFrame:
    """(block_id, midi, spread, coverage, trend, loudness) from frames (block_id, t, midi, energy); null midi is unreliable.

    The median needs three reliable frames; the trend five over 60 ms: the last third's median minus the first's.
    """
    w = Window.partitionBy("block_id")
    r = frames.withColumn("_t0", F.min(F.when(F.col("midi").isNotNull(), F.col("t"))).over(w)).withColumn("_t1", F.max(F.when(F.col("midi").isNotNull(), F.col("t"))).over(w))
    third = (F.col("_t1") - F.col("_t0")) / 3
    a = r.groupBy("block_id").agg(
        F.count("midi").alias("_n"),
        F.count("*").alias("_all"),
        F.median("midi").alias("_midi"),
        F.percentile("midi", F.array(F.lit(0.1), F.lit(0.9))).alias("_p"),
        (F.median(F.when(F.col("t") >= F.col("_t1") - third, F.col("midi"))) - F.median(F.when(F.col("t") <= F.col("_t0") + third, F.col("midi")))).alias("_trend"),
        (F.max("_t1") - F.max("_t0")).alias("_span"),
        F.avg("energy").alias("_e"),
    )
    enough = F.col("_n") >= 3
    return a.select(
        "block_id",
        F.when(enough, F.col("_midi")).alias("midi"),
        F.when(enough, (F.col("_p")[1] - F.col("_p")[0]) * 100).alias("spread"),
        (F.col("_n") / F.col("_all")).alias("coverage"),
        F.when((F.col("_n") >= 5) & (F.col("_span") >= 0.06 - 1e-9), F.col("_trend")).alias("trend"),
        F.when(F.col("_e") > 0, 10 * F.log10("_e")).alias("loudness"),
    )


def group_blocks(phones: DataFrame) -> DataFrame:
    """(sample_id, k, onset, end, vowel, first_idx, n, strength) from phones (sample_id, idx, label, start, end, strength).

    A phone joins the block before it when the phone before it is in that block, the space is within [-1, 35] ms, and it
    is a vowel after a vowel, or N after a vowel or N. Every other phone closes the block.
    """
    w = Window.partitionBy("sample_id").orderBy("idx")
    label = F.when(F.col("label").isin("I", "U"), F.lower("label")).otherwise(F.col("label"))
    p = phones.withColumn("_l", label).withColumn("_v", F.col("_l").isin(*VOWELS)).withColumn("_s", F.col("_v") | (F.col("_l") == "N"))
    gap = F.col("start") - F.lag("end").over(w)
    near = (gap >= -0.001 - 1e-9) & (gap <= 0.035 + 1e-9)
    fits = F.when(F.col("_l") == "N", F.lag("_s").over(w)).otherwise(F.lag("_v").over(w))
    joined = F.coalesce(near & fits & F.lag("_s").over(w), F.lit(False))
    p = p.withColumn("_new", (F.col("_s") & ~joined).cast("int")).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("_s")
    b = p.groupBy("sample_id", F.col("_k").alias("k")).agg(
        F.min_by("start", "idx").alias("onset"),
        F.greatest(F.max_by("end", "idx"), F.min_by("start", "idx")).alias("end"),
        F.min_by(F.when(F.col("_v"), F.col("_l")), F.when(F.col("_v"), F.col("idx"))).alias("vowel"),
        F.min("idx").alias("first_idx"),
        F.count("*").alias("n"),
        F.max("strength").alias("strength"),
    )
    return b


def leading_consonants(phones: DataFrame, blocks: DataFrame) -> DataFrame:
    """(sample_id, k, consonants, lead): the consonants right before each block, back to a pause, N, geminate or vowel."""
    w = Window.partitionBy("sample_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    stop = F.col("label").isin("pau", "sil", "sp", "N", "cl", "q", "Q", *VOWELS, "I", "U")
    marked = phones.withColumn("_stop", stop).withColumn("_after", F.coalesce(F.max(F.when(stop, F.col("idx"))).over(w), F.lit(-1)))
    at = blocks.select("sample_id", "k", "first_idx").join(marked.select("sample_id", F.col("idx").alias("first_idx"), "_after"), ["sample_id", "first_idx"])
    c = at.join(phones.select("sample_id", "idx", "label", "start"), "sample_id").where((F.col("idx") > F.col("_after")) & (F.col("idx") < F.col("first_idx")))
    per = c.groupBy("sample_id", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("consonants"), F.min("start").alias("lead"))
    return blocks.select("sample_id", "k").join(per, ["sample_id", "k"], "left").select("sample_id", "k", F.coalesce("consonants", F.array().cast("array<string>")).alias("consonants"), "lead")


#: Labels of geminate closures, which are silent and no pauses (fixed values).
CLOSURES = ("cl", "q", "Q", "っ")


def detect_pauses(frames: DataFrame, sensitivity: float = 1.0, hop: float = 0.01, inset: float = 0.02, phones: DataFrame | None = None) -> DataFrame:
    """(sample_id, start, end): runs of quiet frames (sample_id, k, rms), inset at both sides.

    Quiet: at most max(P85 * 0.25 * sensitivity, 1e-5). Runs last at least 0.12 s / sensitivity. With phones (sample_id, label,
    start, end) runs that a geminate's closure overlaps are none, the others are clipped to the speech from the first phone to the
    last, must still be long enough, and samples without phones have none.
    """
    limit = frames.groupBy("sample_id").agg(F.greatest(F.percentile("rms", 0.85) * 0.25 * sensitivity, F.lit(1e-5)).alias("_limit"))
    w = Window.partitionBy("sample_id").orderBy("k")
    quiet = frames.join(limit, "sample_id").where(F.col("rms") <= F.col("_limit")).withColumn("_run", F.col("k") - F.row_number().over(w))
    runs = quiet.groupBy("sample_id", "_run").agg((F.min("k") * hop).alias("a"), ((F.max("k") + 1) * hop).alias("b"))
    long_enough = F.col("b") - F.col("a") >= 0.12 / sensitivity - 1e-9
    kept = runs.where(long_enough)
    if phones is not None:
        spans = kept.select(F.col("sample_id").alias("source_id"), "_run", F.col("a").alias("start"), F.col("b").alias("end"))
        closed = phones.where(F.col("label").isin(*CLOSURES)).select(F.col("sample_id").alias("source_id"), "start", "end")
        met = overlap_join(spans, closed, eps=0.0).select(F.col("source_id").alias("sample_id"), "_run").distinct()
        speech = phones.groupBy("sample_id").agg(F.min("start").alias("_first"), F.max("end").alias("_last"))
        kept = kept.join(met, ["sample_id", "_run"], "left_anti").join(speech, "sample_id")
        kept = kept.withColumns({"a": F.greatest("a", "_first"), "b": F.least("b", "_last")}).where(long_enough)
    return kept.select("sample_id", F.round(F.col("a") + inset, 6).alias("start"), F.round(F.col("b") - inset, 6).alias("end"))


def pause_segment(blocks: DataFrame, pauses: DataFrame) -> DataFrame:
    """Blocks with pseg: the number of pauses of the sample that ended by the block's onset."""
    events = blocks.select("sample_id", F.col("onset").alias("at"), "k", F.lit(1).alias("kind")).union(pauses.select("sample_id", F.col("end").alias("at"), F.lit(None).cast("long").alias("k"), F.lit(0).alias("kind")))
    w = Window.partitionBy("sample_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = events.withColumn("pseg", F.sum(1 - F.col("kind")).over(w)).where("kind = 1").select("sample_id", "k", "pseg")
    return blocks.join(counted, ["sample_id", "k"])


def durations(blocks: DataFrame, pauses: DataFrame, ends: DataFrame) -> DataFrame:
    """(sample_id, k, dur, rest): onset to onset without the pauses between; the last block ends by its window (sample_id, w1)."""
    w = Window.partitionBy("sample_id").orderBy("k")
    b = blocks.join(ends, "sample_id").withColumn("_to", F.coalesce(F.lead("onset").over(w), F.least(F.greatest("end", F.col("onset") + 0.001), F.col("w1") - 0.001)))
    spans = b.select(F.col("sample_id").alias("source_id"), F.col("k").alias("id"), F.col("onset").alias("start"), F.col("_to").alias("end"))
    quiet = overlap_join(spans, pauses.select(F.col("sample_id").alias("source_id"), "start", "end"))
    rest = quiet.groupBy("source_id", "id").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("rest"))
    span = F.col("_to") - F.col("onset")
    out = b.join(rest, (b["sample_id"] == rest["source_id"]) & (b["k"] == rest["id"]), "left")
    r = F.greatest(F.lit(0.0), F.least(F.coalesce("rest", F.lit(0.0)), span - 0.005))
    return out.select("sample_id", "k", F.greatest(span - r, F.lit(0.005)).alias("dur"), r.alias("rest"))


def onset_strength(blocks: DataFrame) -> DataFrame:
    """Blocks (sample_id, k, rms) with strength: the share of the sentence's largest; null when all is silent."""
    top = F.max("rms").over(Window.partitionBy("sample_id"))
    return blocks.withColumn("strength", F.when(top > 0, F.col("rms") / top))


def target_pitch(frames: DataFrame, ranges: DataFrame, side: str | None = None, edge: float = 0.1) -> DataFrame:
    """(key, original, midi, error): the note that a sound is to be flattened to: its confidence-weighted lower median, snapped.

    frames: key, t, midi (null: not reliable), conf; ranges: key, start, end, the parts to process. With a side (left or right)
    only the `edge` seconds inside the first (last) part count. Fewer than three reliable frames are an error.
    """
    if side == "left":
        ranges = ranges.groupBy("key").agg(F.min("start").alias("start")).withColumn("end", F.col("start") + edge)
    elif side == "right":
        ranges = ranges.groupBy("key").agg(F.max("end").alias("end")).withColumn("start", F.col("end") - edge)
    f = frames.where("midi is not null").select(F.col("key").alias("_key"), "t", "midi", "conf")
    inside = (F.col("key") == F.col("_key")) & (F.col("t") >= F.col("start") - 1e-9) & (F.col("t") < F.col("end") - 1e-9)
    met = spread(ranges.select("key", "start", "end"), "key").join(spread(f, "_key"), inside, "left").select("key", "midi", "t", "conf")
    # one sort of a key's frames serves all windows: equal frames count once, and a key without frames keeps its row
    once, rising, whole = Window.partitionBy("key", "midi", "t", "conf").orderBy("key"), Window.partitionBy("key").orderBy("midi"), Window.partitionBy("key")
    met = met.withColumn("_n", (F.col("midi").isNotNull() & (F.row_number().over(once) == 1)).cast("long"))
    met = met.withColumn("_w", F.when(F.col("_n") == 1, F.greatest(F.col("conf").cast("double"), F.lit(1e-6))).otherwise(0.0))
    met = met.select("key", "midi", F.sum("_w").over(rising).alias("_run"), F.row_number().over(rising).alias("_place"), F.sum("_w").over(whole).alias("_whole"), F.sum("_n").over(whole).alias("_all"))
    reached = (F.col("_all") >= 3) & (F.col("_run") >= F.col("_whole") / 2 - 1e-9)
    out = met.select("key", "_place", F.min(F.when(reached, F.col("midi"))).over(whole).alias("value")).where("_place = 1")
    return out.select("key", F.col("value").alias("original"), F.floor(F.col("value") + 0.5).cast("double").alias("midi"), F.when(F.col("value").isNull(), "flatten-edge-insufficient" if side else "flatten-f0-insufficient").alias("error"))


def target_beats(plan: DataFrame, density: float) -> DataFrame:
    """Plan rows (sample_id, k, cells, rest_cells) with beat: where each block begins on the grid."""
    w = Window.partitionBy("sample_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return plan.withColumn("beat", F.coalesce(F.sum((F.col("cells") + F.col("rest_cells")) / density).over(w), F.lit(0.0)))


#: Edges of the low, middle and high band in hertz; power below the first counts nowhere (fixed values).
BANDS = (20.0, 200.0, 4000.0)


def spectral_shape(spectrum: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(asset_id, region, low, mid, high, centroid, flatness) from power spectra (asset_id, t, freq, power), summed over time.

    The region `whole` is all of it. regions: asset_id, peak, tail: seconds at which the attack and the body end.
    """
    heard = spectrum.where(F.col("freq") >= BANDS[0])
    rows = heard.select("asset_id", F.lit("whole").alias("region"), "freq", "power")
    if regions is not None:
        part = F.when(F.col("t") < F.col("peak"), "attack").when(F.col("t") < F.col("tail"), "body").otherwise("tail")
        rows = rows.unionByName(heard.join(regions, "asset_id").select("asset_id", part.alias("region"), "freq", "power"))
    bins = rows.groupBy("asset_id", "region", "freq").agg(F.sum("power").alias("power"))
    total = F.sum("power")
    share = lambda test: F.sum(F.when(test, F.col("power")).otherwise(0.0)) / total
    low, mid = F.col("freq") < BANDS[1], F.col("freq") < BANDS[2]
    flat = F.exp(F.avg(F.log(F.greatest("power", F.lit(1e-30))))) / F.avg(F.greatest("power", F.lit(1e-30)))
    return bins.groupBy("asset_id", "region").agg(share(low).alias("low"), share(~low & mid).alias("mid"), share(~mid).alias("high"), (F.sum(F.col("freq") * F.col("power")) / total).alias("centroid"), flat.alias("flatness"))


def pitch_metrics(frames: DataFrame) -> DataFrame:
    """(asset_id, pitch, wobble, voiced): median pitch and the 90th less the 10th percentile of reliable frames, in semitones, from
    three frames on; seconds of reliable frames. frames: asset_id, midi (null: not reliable)."""
    enough = F.count("midi") >= 3
    return frames.groupBy("asset_id").agg(F.when(enough, F.median("midi")).alias("pitch"), F.when(enough, F.percentile("midi", 0.9) - F.percentile("midi", 0.1)).alias("wobble"), (F.count("midi") * 0.01).alias("voiced"))
