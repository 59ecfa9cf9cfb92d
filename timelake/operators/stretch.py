"""Plans of sentences and phrases brought onto a beat: arrays for each plan, their maps, speeds and candidate densities."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelake.functions import mapbatch, timemap
from timelake.operators.rhythm import MOST_BLOCKS

NAMES = ("near_fast", "near_slow", "double")


def _block() -> tuple[Column, Column]:
    """A block as an entry of its plan, and whether all of a sentence's blocks have cells and a duration."""
    shape = F.struct("k", *(F.col(c).cast("double").alias(c) for c in ("onset", "end")), F.col("cells").cast("long").alias("cells"), *(F.col(c).cast("double").alias(c) for c in ("dur", "rest")))
    return shape, F.min((F.coalesce("cells", F.lit(0)) > 0) & (F.coalesce("dur", F.lit(0.0)) > 0))


def plans(blocks: DataFrame, pauses: DataFrame, cuts: DataFrame, windows: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, blocks, pauses, cuts, w0, w1, rate, error): one row a sentence of windows (key, w0, w1, rate).

    blocks: key, k, onset, end, cells, dur, rest; pauses: key, start, end; cuts: key, k, merged (phrases, without merged ones).
    A sentence of more than MOST_BLOCKS blocks, without blocks, or with a block that has no cells or no duration has an error
    instead of arrays, which bounds a row.
    """
    shape, whole = _block()
    sizes = blocks.groupBy(key).agg(F.count("*").alias("n"), whole.alias("whole"))
    error = F.when(F.col("n").isNull(), "rhythm-no-blocks").when(F.col("n") > MOST_BLOCKS, "rhythm-too-many-blocks").when(~F.col("whole"), "rhythm-no-duration")
    judged = windows.select(key, *(F.col(c).cast("double").alias(c) for c in ("w0", "w1", "rate"))).join(sizes, key, "left").select(key, "w0", "w1", "rate", error.alias("error"))
    sound = judged.where("error is null").select(key)
    listed = lambda df, what, name: df.join(sound, key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(what)).alias(name))
    out = judged.join(listed(blocks, shape, "blocks"), key, "left")
    out = out.join(listed(pauses, F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")), "pauses"), key, "left")
    out = out.join(listed(cuts.where(~F.col("merged")), F.col("k").cast("int"), "cuts"), key, "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(key, "blocks", empty("pauses", "array<struct<start:double,end:double>>"), empty("cuts", "array<int>"), "w0", "w1", "rate", "error")


def gathered_plans(blocks: DataFrame, windows: dict[str, Column], key: str = "sample_id") -> DataFrame:
    """`plans` of sentences whose blocks bring along what lies behind them: one grouping, without a join.

    blocks: key, k, onset, end, cells, dur, rest, n (how many its sentence has), pause (start, end; or null), cut (the block
    before which a phrase is cut, or null). windows: w0, w1 and rate as aggregates of a sentence's blocks.
    """
    shape, whole = _block()
    pause = F.col("pause").cast("struct<start:double,end:double>")
    # a list holds nothing of a sentence of more than MOST_BLOCKS blocks, which bounds a row
    listed = lambda c, name: F.array_sort(F.collect_list(F.when(F.col("n") <= MOST_BLOCKS, c))).alias(name)
    ends = (windows[c].cast("double").alias(c) for c in ("w0", "w1", "rate"))
    made = blocks.groupBy(key).agg(listed(shape, "blocks"), listed(pause, "pauses"), listed(F.col("cut").cast("int"), "cuts"), *ends, F.max("n").alias("n"), whole.alias("whole"))
    error = F.when(F.col(key).isNull(), "rhythm-no-blocks").when(F.col("n") > MOST_BLOCKS, "rhythm-too-many-blocks").when(~F.col("whole"), "rhythm-no-duration")
    sound = lambda c: F.when(F.col("error").isNull(), F.col(c))
    empty = lambda c, kind: F.coalesce(sound(c), F.array().cast(kind)).alias(c)
    return made.withColumn("error", error).select(key, sound("blocks").alias("blocks"), empty("pauses", "array<struct<start:double,end:double>>"), empty("cuts", "array<int>"), "w0", "w1", "rate", "error")


def _columns() -> dict[str, Column]:
    return {c: F.col(c) for c in ("blocks", "pauses", "cuts", "w0", "w1", "rate")}


def mapped(rows: DataFrame, density: Column, bpm: Column) -> DataFrame:
    """Plans with `scheme`, their map at a density and a tempo; null where the plan has an error."""
    # through a generator, so that no later projection copies the whole map for each field that it takes of it
    made = F.when(F.col("error").isNull(), timemap.scheme(_columns(), density, bpm))
    return rows.select(*(c for c in rows.columns if c != "scheme"), F.explode(F.array(made)).alias("scheme"))


def points(rows: DataFrame, density: Column, bpm: Column, key: str = "sample_id") -> DataFrame:
    """(key, i, point) of the control points of plans at a density and a tempo, without their maps."""
    c = _columns()
    made = timemap.let(timemap.beats(c["blocks"], density), lambda beat: timemap.control_points(c["blocks"], c["pauses"], c["cuts"], c["w1"], density, beat))
    return rows.where("error is null").select(key, F.posexplode(made).alias("i", "point"))


def _power(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def _batched(rows: DataFrame, key: str, given: dict[str, Column], made: str, f: Callable) -> DataFrame:
    """(key, made): what `f(plans, given)` makes of plans in Arrow batches, as columns by name; null but the error on rows with one."""
    asked = rows.select(key, "blocks", "pauses", "cuts", "w0", "w1", "rate", "error", *(c.alias(n) for n, c in given.items()))
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {made}, error string"
    names, arrow = list(given), {x.split()[0]: x.split()[1] for x in made.split(", ")}

    def run(batches):
        for batch in batches:
            error = np.array(batch.column("error").to_pylist(), object)
            out = {n: np.full(len(error), None, object) for n in arrow}
            for at, plans in mapbatch.Plans.parts(batch):
                values, bad = f(plans, *(batch.column(n).take(pa.array(at)).to_numpy(zero_copy_only=False) for n in names))
                error[at] = mapbatch.ERRORS[bad]
                for n, v in values.items():
                    out[n][at] = [x if ok else None for x, ok in zip(v, bad == 0, strict=True)]
            types = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "array<struct<s:bigint,t:bigint>>": pa.list_(pa.struct([("s", pa.int64()), ("t", pa.int64())]))}
            columns = [batch.column(key), *(pa.array(out[n].tolist(), types[k]) for n, k in arrow.items()), pa.array(error.tolist(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, *arrow, "error"])

    return asked.mapInArrow(run, schema)


def speeds(rows: DataFrame, density: Column, bpm: Column, key: str = "sample_id") -> DataFrame:
    """(key, density, bpm, speed, error): the speed of speech on each plan's map, without the map; null where there is an error."""
    return _batched(rows, key, {"density": density.cast("double"), "bpm": bpm.cast("double")}, "density double, bpm double, speed double", _speeds)


def _speeds(plans, density, bpm):
    bad, speed = plans.judged(density, bpm)[:2]
    return {"density": density, "bpm": bpm, "speed": speed}, bad


def map_knots(rows: DataFrame, density: Column, bpm: Column, key: str = "sample_id") -> DataFrame:
    """(key, knots, error): the knots of each plan's map."""
    return _batched(rows, key, {"density": density.cast("double"), "bpm": bpm.cast("double")}, "knots array<struct<s:bigint,t:bigint>>", _knots)


def _knots(plans, density, bpm):
    bad, _, s, t, n = plans.judged(density, bpm)
    knots, end = [{"s": x, "t": y} for x, y in zip(s.tolist(), t.tolist())], np.cumsum(n).tolist()
    return {"knots": [knots[e - c : e] for e, c in zip(end, n.tolist())]}, bad


def _fitting(bpm: float) -> Column:
    """The exponent of the density at which a plan's cells fit its time."""
    blocks = F.col("blocks")
    cells, seconds = timemap.total(F.transform(blocks, lambda b: b["cells"].cast("double"))), timemap.total(F.transform(blocks, lambda b: b["dur"]))
    most = timemap.EXPONENT
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.ceil(F.log2(cells * (60.0 / bpm) / seconds)))).cast("int")


def near_fast(rows: DataFrame, bpm: float, key: str = "sample_id") -> DataFrame:
    """(key, k, error): the exponent of the least density that is not slower than speech, for plans without an error.

    The search begins where the cells fit the time and goes down while it is fast, else up until it is. The plans of a batch
    try their first power of two together; then only those that are undecided try the next one, each on its own map.
    """
    def run(plans, k):
        k, bad = plans.near_fast(k, np.full(len(k), float(bpm)))
        return {"k": k}, bad

    return _batched(rows.where("error is null"), key, {"k0": _fitting(bpm)}, "k int", run)


def original_tempo(rows: DataFrame, density: Column, key: str = "sample_id") -> DataFrame:
    """(key, bpm, error): the tempo at which a density leaves speech at its own speed, by halving [20, 400] 32 times at most."""
    def run(plans, density):
        bpm, off, bad = plans.original_tempo(density)
        return {"bpm": bpm, "off": off}, bad

    found = _batched(rows.where("error is null"), key, {"density": density.cast("double")}, "bpm double, off double", run)
    return found.select(key, "bpm", F.coalesce("error", F.when(F.col("off") > timemap.SPEED_OFF, "rhythm-original-speed-impossible")).alias("error"))


def candidates(rows: DataFrame, bpm: float | None, which: tuple[str, ...] = NAMES, key: str = "sample_id", maps: bool = True) -> DataFrame:
    """(key, plan, error, scheme, w0, rate, blocks): near_fast, near_slow (a step below) and double (one above) of each plan.

    Without a tempo it is the one at which the near-fast density (sought at 120) leaves speech at its own speed. A plan with
    an error has one row with it, plan being null. Without `maps` the scheme has no more than density, bpm and speed.
    """
    low, high = timemap.TEMPI
    if bpm is not None and not low <= bpm <= high:
        raise ValueError("the tempo lies between 20 and 400")
    steps = {"near_fast": 0, "near_slow": -1, "double": 1}
    if not maps:
        return _speeds_of(rows, bpm, {n: steps[n] for n in which}, key)
    fast = near_fast(rows, bpm if bpm is not None else timemap.PROBE, key)
    found = rows.join(fast.select(key, "k", F.col("error").alias("_fast")), key, "left").withColumn("error", F.coalesce("error", "_fast")).drop("_fast")
    if bpm is None:
        tempo = original_tempo(found.where("error is null"), _power(F.col("k")), key)
        found = found.join(tempo.select(key, "bpm", F.col("error").alias("_tempo")), key, "left").withColumn("error", F.coalesce("error", "_tempo")).drop("_tempo")
    else:
        found = found.withColumn("bpm", F.lit(float(bpm)))
    each = F.array(*(F.struct(F.lit(n).alias("plan"), F.lit(steps[n]).alias("by")) for n in which))
    none = F.array(F.struct(F.lit(None).cast("string").alias("plan"), F.lit(0).alias("by")))
    asked = found.select("*", F.inline(F.when(F.col("error").isNull(), each).otherwise(none)))
    made = mapped(asked, _power(F.col("k") + F.col("by")), F.col("bpm"))
    return made.select(key, "plan", F.coalesce("error", "scheme.error").alias("error"), F.when(F.col("scheme.error").isNull(), F.col("scheme")).alias("scheme"), "w0", "rate", "blocks")


def _speeds_of(rows: DataFrame, bpm: float | None, steps: dict[str, int], key: str) -> DataFrame:
    """Candidates without maps: densities and tempo are sought and speeds judged in one pass over the plans, without a join."""
    probe, by, fields = timemap.PROBE, tuple(steps.values()), range(len(steps))

    def run(plans, k):
        tempo, found, bad = plans.candidates(k, bpm, probe, by)
        made = {"bpm": tempo}
        for i, (density, speed, error) in enumerate(found):
            made |= {f"density{i}": density, f"speed{i}": np.where(error == 0, speed, np.nan), f"error{i}": mapbatch.ERRORS[error]}
        return made, bad

    made = ", ".join(("bpm double", *(f"density{i} double, speed{i} double, error{i} string" for i in fields)))
    found = _batched(rows, key, {"k0": F.when(F.col("error").isNull(), _fitting(probe if bpm is None else bpm))}, made, run)
    scheme = lambda i: F.when(F.col(f"error{i}").isNull(), F.struct(F.col(f"density{i}").alias("density"), "bpm", F.col(f"speed{i}").alias("speed"))).alias("scheme")
    each = F.array(*(F.struct(F.lit(n).alias("plan"), F.col(f"error{i}").alias("error"), scheme(i)) for i, n in enumerate(steps)))
    kind = "array<struct<plan:string,error:string,scheme:struct<density:double,bpm:double,speed:double>>>"
    none = F.array(F.struct(F.lit(None).alias("plan"), F.col("error"), F.lit(None).alias("scheme")))
    return found.select(key, F.inline(F.when(F.col("error").isNull(), each.cast(kind)).otherwise(none.cast(kind))))


def evidence_schemes(found: DataFrame, key: str = "sample_id") -> DataFrame:
    """The rows that rhythm evidence reads (`evidence.beat_evidence`), from candidates of whole sentences."""
    s = F.col("scheme")
    point = lambda src, beat: F.struct(src.alias("src"), beat.alias("beat"))
    # the map in full: knots in source seconds and target beats, the first control point at its own beat
    beat_frames = 60.0 / s["bpm"] * F.col("rate")
    first = F.rint((s["points"][0]["src"] - F.col("w0")) * F.col("rate"))
    exact = F.transform(s["knots"], lambda k: point(F.col("w0") + k["s"] / F.col("rate"), s["points"][0]["beat"] + (k["t"] - timemap.to_target(s["knots"], first)) / beat_frames))
    ok = found.where("scheme is not null")
    return ok.select(
        key, F.lit(-1).alias("scope"), "plan", F.lit(0).alias("start"), F.size("blocks").alias("stop"), s["density"].alias("density"), s["speed"].alias("speed"), s["ratio"].alias("ratio"), (60.0 / s["bpm"]).alias("beat_seconds"),
        F.transform("blocks", lambda b: b["cells"].cast("int")).alias("cells"), s["beats"].alias("onsets"), F.transform(s["points"], lambda p: point(p["src"], p["beat"])).alias("points"), exact.alias("exact"),
    )


def knots(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, i, s, t, error): the knots of each scheme in order, or its error."""
    error = F.coalesce("error", "scheme.error")
    listed = F.when(error.isNull(), F.col("scheme.knots"))
    return rows.select(key, error.alias("error"), F.posexplode_outer(listed).alias("i", "knot")).select(key, "i", F.col("knot.s").alias("s"), F.col("knot.t").alias("t"), "error")
