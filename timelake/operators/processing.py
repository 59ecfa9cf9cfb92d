"""Which parts of a sound are processed, the pitch that each frame is given, and how rendered samples are spliced in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelake.operators.planning import SOUNDING

#: Seconds of a transition, of the least plateau and of a fade.
TRANSITION, PLATEAU, FADE = 0.05, 0.03, 0.003
INTERVALS = "array<struct<start:double,end:double>>"


def smoothstep(x: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return c * c * (3.0 - 2.0 * c)


def inner_weight(t: Column, start: Column, end: Column, left: Column, right: Column) -> Column:
    """The target's weight at a time: 0 outside [start, end), 1 on the plateau, smooth over both transitions."""
    up = F.when(left <= 0, 1.0).otherwise(smoothstep((t - start) / left))
    down = F.when(right <= 0, 1.0).otherwise(smoothstep((end - t) / right))
    return F.when((t < start - 1e-12) | (t >= end - 1e-12), 0.0).otherwise(F.least(up, down))


def processing_intervals(jobs: DataFrame, vowels: DataFrame | None = None) -> DataFrame:
    """(key, intervals, error) of jobs (key, mode, duration, inner_start, inner_end, left, right).

    Modes: whole; vowels (each sounding phone, cut to the sound); first (from the first of them to the end); inner (from
    min(0.1, d/4) to max(d - 0.1, 3d/4) unless given, with a plateau between its transitions). vowels: key, label, start,
    end. Errors: no-alignment, no-vowel, out-of-bounds, plateau, not-an-option.
    """
    d = F.col("duration")
    one = lambda a, b: F.array(F.struct(a.cast("double").alias("start"), b.cast("double").alias("end")))
    rows = jobs
    if vowels is not None:
        cut = vowels.join(jobs.select("key", "duration"), "key").withColumns({"start": F.greatest("start", F.lit(0.0)), "end": F.least("end", d)})
        sounding = F.col("label").isin(*SOUNDING) & (F.col("end") - F.col("start") > 1e-9)
        per = cut.groupBy("key").agg(F.array_sort(F.collect_list(F.when(sounding, F.struct("start", "end")))).alias("_v"))
        rows = rows.join(per, "key", "left")
    else:
        rows = rows.withColumn("_v", F.lit(None).cast(INTERVALS))
    a = F.coalesce("inner_start", F.least(F.lit(0.1), d / 4))
    b = F.coalesce("inner_end", F.greatest(d - 0.1, 0.75 * d))
    left, right = F.coalesce("left", F.lit(TRANSITION)), F.coalesce("right", F.lit(TRANSITION))
    mode, spoken = F.col("mode"), F.col("mode").isin("vowels", "first")
    error = (
        F.when(~mode.isin("whole", "vowels", "first", "inner"), "not-an-option")
        .when(spoken & F.col("_v").isNull(), "no-alignment")
        .when(spoken & (F.size("_v") == 0), "no-vowel")
        .when((mode == "inner") & ((a < -1e-9) | (b > d + 1e-9) | (a >= b)), "out-of-bounds")
        .when((mode == "inner") & (b - a - left - right < PLATEAU - 1e-9), "plateau")
    )
    found = F.when(mode == "whole", one(F.lit(0.0), d)).when(mode == "vowels", F.col("_v")).when(mode == "first", one(F.get("_v", F.lit(0))["start"], d)).otherwise(one(F.greatest(a, F.lit(0.0)), F.least(b, d)))
    return rows.select("key", F.when(error.isNull(), found.cast(INTERVALS)).alias("intervals"), error.alias("error"))


def assign_pitch(times: DataFrame, frames: DataFrame, jobs: DataFrame) -> DataFrame:
    """(key, t, hz): the pitch of each rendered frame (key, t): 0 where the sound has none, the target inside the intervals
    (blended with the sound's own pitch by the inner weight, in semitones), else the sound's own.

    frames: key, frame, f0, conf, energy on the 10 ms grid, of which the nearest counts; jobs: key, intervals, midi, inner
    (blend or not), left, right.
    """
    ends = frames.groupBy("key").agg(F.max("frame").alias("_last"))
    j = times.join(jobs, "key").join(ends, "key")
    j = j.withColumn("frame", F.greatest(F.lit(0), F.least(F.col("_last"), F.floor((F.col("t") - 0.005) / 0.01 + 0.5))).cast("long"))
    met = j.join(frames.withColumn("frame", F.col("frame").cast("long")), ["key", "frame"], "left")
    voiced = F.coalesce((F.col("conf") > 0.05) & (F.col("energy") > 1e-10) & (F.col("f0") > 0) & ~F.isnan("f0"), F.lit(False))
    t = F.col("t")
    inside = F.exists("intervals", lambda s: (t >= s["start"] - 1e-9) & (t < s["end"] - 1e-9))
    own = 69 + 12 * F.log2(F.col("f0") / 440.0)
    first = F.get("intervals", F.lit(0))
    w = F.when(F.col("inner"), inner_weight(t, first["start"], first["end"], F.coalesce("left", F.lit(TRANSITION)), F.coalesce("right", F.lit(TRANSITION)))).otherwise(1.0)
    blended = 440.0 * F.pow(F.lit(2.0), ((1 - w) * own + w * F.col("midi") - 69) / 12)
    return met.select("key", "t", F.when(~voiced, 0.0).when(inside, blended).otherwise(F.col("f0").cast("double")).alias("hz"))


def splice_mask(samples: DataFrame, intervals: DataFrame, rate: int, fade: bool = True) -> DataFrame:
    """Samples (key, i) with mask: 1 inside an interval (key, start, end), 0 outside; with `fade` the ends rise and fall inside it.

    A fade lasts 3 ms, a quarter of the interval at most. Intervals meet samples by an equi-join on blocks of samples.
    """
    size = 1 << 14
    span = intervals.select("key", F.greatest(F.lit(0), F.round(F.col("start") * rate).cast("long")).alias("a"), F.round(F.col("end") * rate).cast("long").alias("b")).where("b > a")
    blocks = span.withColumn("_block", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    met = samples.select("key", "i", F.floor(F.col("i") / size).alias("_block")).join(blocks, ["key", "_block"]).where((F.col("i") >= F.col("a")) & (F.col("i") < F.col("b")))
    f = F.least(F.lit(round(FADE * rate)).cast("long"), F.floor((F.col("b") - F.col("a")) / 4)) if fade else F.lit(0)
    ramp = F.least((F.col("i") - F.col("a")) / f, (F.col("b") - 1 - F.col("i")) / f, F.lit(1.0))
    per = met.groupBy("key", "i").agg(F.max(F.when(f > 0, ramp).otherwise(1.0)).alias("mask"))
    return samples.join(per, ["key", "i"], "left").withColumn("mask", F.coalesce("mask", F.lit(0.0)))


def splice(original: DataFrame, rendered: DataFrame, mask: DataFrame) -> DataFrame:
    """(key, i, x): samples (key, i, x) of the original outside the mask, blended with the rendered ones inside.

    A sound whose rendering differs in length or is not finite has a row with error instead of its samples.
    """
    both = original.select("key", "i", "x").join(rendered.select("key", "i", F.col("x").alias("y")), ["key", "i"], "full")
    bad = F.when(F.max(F.col("x").isNull() | F.col("y").isNull()), "length").when(F.max(F.isnan("y") | (F.abs("y") == float("inf"))), "non-finite")
    errors = both.groupBy("key").agg(bad.alias("error")).where("error is not null")
    good = both.join(errors.select("key"), "key", "left_anti").join(mask.select("key", "i", "mask"), ["key", "i"], "left")
    m = F.coalesce("mask", F.lit(0.0))
    out = good.select("key", "i", F.when(m > 0, F.col("x") * (1 - m) + F.col("y") * m).otherwise(F.col("x")).cast("float").alias("x"), F.lit(None).cast("string").alias("error"))
    return out.unionByName(errors, allowMissingColumns=True)

