"""Evidence that windows of blocks carry a rhythm: mora cells, beat and shape evidence, rests at joints, and the choice.

A window is a row with arrays over its blocks (at most 64), so that every step is a column expression; windows meet
plans by an equi-join on the sample, and only the combinations of rests (at most COMBOS a window and plan) become rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.timemap import let
from timelake.operators.sequences import WindowQuery, search_blocks

#: Cells of a block, labels of pauses, the least tick and rate of long vowels, and the weights of a cost.
MOST_CELLS = 64
PAUSES = ("pau", "sil", "sp", "SP", "AP")
LONG_TICK, LONG_RATE = 0.04, 0.035
DEFORM_WEIGHT, REST_WEIGHT = 0.03, 0.003
LEAST_REST_RANGE, COMBOS = 32, 128


def mora_cells(phones: DataFrame, blocks: DataFrame, windows: DataFrame, strict: bool = True) -> DataFrame:
    """(sample_id, k, cells): how many morae each block holds, up to the next block's first one; null where unknown.

    phones: sample_id, idx, label, start, end, mora, k (its block, or null); windows: sample_id, w0, w1. Morae are counted
    from the first phone whose middle lies in the window. A phone without a mora leaves the window unknown if `strict`, else
    its block alone; morae that go back leave it unknown.
    """
    middle = (F.col("start") + F.col("end")) / 2
    spoken = phones.where(~F.col("label").isin(*PAUSES)).join(windows, "sample_id").where((middle >= F.col("w0") - 1e-9) & (middle < F.col("w1") + 1e-9))
    spoken = spoken if strict else spoken.where(F.col("mora").isNotNull())
    before = F.lag("mora").over(Window.partitionBy("sample_id").orderBy("idx"))
    spoken = spoken.withColumn("odd", F.coalesce(F.col("mora") < before, F.lit(False)) | F.col("mora").isNull())
    span = spoken.groupBy("sample_id").agg(F.min_by("mora", "idx").alias("base"), F.max_by("mora", "idx").alias("last"), F.max("odd").alias("odd")).where("not odd")
    members = phones.where(F.col("k").isNotNull()).groupBy("sample_id", "k").agg(F.min("mora").alias("m"), F.max(F.col("mora").isNull()).alias("gap"))
    rows = blocks.select("sample_id", "k").join(members, ["sample_id", "k"], "left").join(span, "sample_id", "left")
    own = F.when(~F.col("gap"), F.col("m") - F.col("base"))
    w = Window.partitionBy("sample_id").orderBy("k")
    after = F.when(F.lead("k").over(w).isNull(), F.col("last") - F.col("base") + 1).otherwise(F.lead(own).over(w))
    return rows.withColumn("n", after - own).select("sample_id", "k", F.when(F.col("n").between(1, MOST_CELLS), F.col("n")).cast("long").alias("cells"))


def quantize_mora(cells: DataFrame, durations: DataFrame, manual: DataFrame | None = None, long_vowel: bool = False) -> DataFrame:
    """(sample_id, cells, missing): the cell counts of a sentence in order, or null with the blocks that have none.

    cells: sample_id, k, cells; manual: sample_id, k, cells (set by hand, first). durations: sample_id, k, dur, vowel (seconds
    of vowels), paused. With `long_vowel` a block whose vowels last more than half a cell too long gets as many cells as
    they fill at the sentence's median seconds a cell; blocks set by hand or with a pause keep theirs.
    """
    rows = cells.join(durations, ["sample_id", "k"], "left")
    rows = rows.join(manual.select("sample_id", "k", F.col("cells").cast("long").alias("hand")), ["sample_id", "k"], "left") if manual is not None else rows.withColumn("hand", F.lit(None).cast("long"))
    rows = rows.withColumn("n", F.coalesce("hand", "cells"))
    if long_vowel:
        rate = F.col("dur") / F.col("n")
        tick = F.greatest(F.lit(LONG_TICK), F.coalesce(F.median(F.when(rate > LONG_RATE, rate)).over(Window.partitionBy("sample_id")), F.lit(LONG_TICK)))
        rows = rows.withColumn("tick", tick)
        long = F.col("hand").isNull() & ~F.coalesce("paused", F.lit(False)) & (F.col("vowel") > (F.col("n") + 0.5) * F.col("tick"))
        rows = rows.withColumn("n", F.when(long, F.least(F.lit(MOST_CELLS), F.greatest("n", F.bround(F.col("vowel") / F.col("tick")).cast("long")))).otherwise(F.col("n")))
    g = rows.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("b"))
    missing = F.transform(F.filter("b", lambda s: s["n"].isNull()), lambda s: s["k"])
    return g.select("sample_id", F.when(F.size(missing) == 0, F.transform("b", lambda s: s["n"])).alias("cells"), missing.alias("missing"))


@dataclass(frozen=True)
class RhythmQuery:
    """Notes [start, end) in beats, one a block, and how windows are judged against them."""

    notes: tuple[tuple[float, float], ...]
    tolerance: float = 0.25  # beats
    strict: bool = False
    sustain: tuple[int, ...] = ()  # places whose sound must last to the note's end
    beats: dict[int, tuple[float | None, float | None]] = field(default_factory=dict)  # bounds of lengths by place
    speed_weight: float = 0.0
    speeds: tuple[float, float] | None = None
    adjust_rests: bool = False
    scope: str = "both"  # sentence, segment or both

    def note_array(self) -> Column:
        return F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in self.notes))


def interpolate(points: Column, t: Column) -> Column:
    """The beat at a source time: linear between points (src, beat), on beyond both ends with the outer slopes."""
    n = F.size(points)
    i = F.greatest(F.lit(1), F.least(n - 1, F.size(F.filter(points, lambda p: p["src"] <= t))))
    a, b = F.get(points, i - 1), F.get(points, i)
    return F.when(n == 1, points[0]["beat"]).otherwise(a["beat"] + (t - a["src"]) * (b["beat"] - a["beat"]) / (b["src"] - a["src"]))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def _median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def shift_fit(x: Column, others: Column, notes: Column, tolerance: float, lower: Column | None = None) -> Column:
    """(mean, worst, size, shift) of the best shift of onsets `x` onto the notes, or null if none is allowed.

    A shift is allowed if every onset comes within the tolerance of its note, no other onset falls into a note, and it is
    at least `lower`. The best has the least mean error, then the least worst one, then the least size. Errors are linear
    between the candidates: the bounds, zero, the single deviations and their middles, and the edges of what is excluded.
    """
    def bounded(gaps):
        least = F.array_max(gaps) - tolerance
        least = least if lower is None else F.greatest(least, F.coalesce(lower, F.lit(float("-inf"))))
        most = F.array_min(gaps) + tolerance
        return let(F.struct(least.alias("least"), most.alias("most")), lambda b: F.when(b["least"] <= b["most"] + 1e-12, excluding(gaps, b["least"], b["most"])))

    def excluding(gaps, least, most):
        banned = F.flatten(F.transform(others, lambda y: F.transform(notes, lambda n: F.struct((n["a"] - y).alias("a"), (n["b"] - y).alias("b")))))
        # only what is banned between the bounds matters
        return let(F.filter(banned, lambda e: (e["a"] <= most + 1e-9) & (e["b"] >= least - 1e-9)), lambda e: best(gaps, least, most, e))

    def best(gaps, least, most, banned):
        middles = F.flatten(F.transform(gaps, lambda g: F.transform(gaps, lambda h: (g + h) / 2)))
        tried = F.concat(F.array(least, most, F.lit(0.0)), middles, F.transform(banned, lambda s: s["b"]), F.transform(banned, lambda s: s["a"] - 1e-9))
        allowed = F.filter(F.array_distinct(tried), lambda s: (s >= least - 1e-12) & (s <= most + 1e-12) & ~F.exists(banned, lambda e: (s >= e["a"] - 1e-12) & (s < e["b"])))
        judged = lambda s: let(F.transform(gaps, lambda g: F.abs(s - g)), lambda off: F.struct(_mean(off).alias("mean"), F.array_max(off).alias("worst"), F.abs(s).alias("size"), s.alias("shift")))
        return F.array_min(F.transform(allowed, judged))

    # what the lambdas read is bound by `let`: an expression inside them would be computed for every element anew
    return let(F.zip_with(notes, x, lambda n, v: n["a"] - v), bounded)


def _ranked(x: Column, others: Column, sustains: Column, notes: Column, tolerance) -> Column:
    """(err, conflicts, deviation, deficit, shift, strict) at the median shift; sustains are null where nothing is asked."""
    def at(shift):
        off = F.zip_with(notes, x, lambda n, v: F.abs(v + shift - n["a"]))
        short = F.zip_with(notes, sustains, lambda n, s: F.coalesce(F.greatest(F.lit(0.0), n["b"] - (s + shift)), F.lit(0.0)))
        inside = F.aggregate(others, F.lit(0), lambda a, y: a + F.size(F.filter(notes, lambda n: (y + shift >= n["a"] - 1e-9) & (y + shift < n["b"] - 1e-9))))
        return let(F.struct(off.alias("off"), short.alias("short"), inside.alias("inside")), lambda m: judged(shift, m))

    def judged(shift, m):
        worst = F.zip_with(m["off"], m["short"], lambda a, b: F.greatest(a, b))
        return let(worst, lambda w: F.struct(_mean(w).alias("err"), m["inside"].alias("conflicts"), _mean(m["off"]).alias("deviation"), _mean(m["short"]).alias("deficit"), shift.alias("shift"), ((F.array_max(w) <= tolerance + 1e-9) & (m["inside"] == 0)).alias("strict")))

    # the shift is bound by `let`: inside the lambdas it would be sought again for every onset and note
    return let(F.zip_with(notes, x, lambda n, v: n["a"] - v), lambda gaps: let(_median(gaps), at))


def window_rows(hits: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """Hits (sample_id, first) with the arrays onset, end, sustain and seg of their n blocks."""
    own = blocks.select("sample_id", "k", "onset", "end", "sustain", "seg")
    met = hits.select("sample_id", "first").join(own, "sample_id").where((F.col("k") >= F.col("first")) & (F.col("k") < F.col("first") + n))
    g = met.groupBy("sample_id", "first").agg(F.array_sort(F.collect_list(F.struct("k", "onset", "end", "sustain", "seg"))).alias("b"))
    part = lambda c: F.transform("b", lambda s: s[c]).alias(c)
    return g.select("sample_id", "first", *map(part, ("onset", "end", "sustain", "seg")))


#: What windows bring along from the search itself (`search_blocks`): one sort finds the hits and their arrays.
WINDOW = {"onset": "onset", "ends": "end", "sustain": "sustain", "seg": "seg"}


def search_windows(blocks: DataFrame, query: WindowQuery) -> DataFrame:
    """The windows of a block search, as `window_rows` gives them, without meeting the blocks again. blocks also have seg."""
    found = search_blocks(blocks, query, WINDOW)
    return found.select("sample_id", "first", "onset", F.col("ends").alias("end"), "sustain", "seg")


def _within(windows: DataFrame, plans: DataFrame, q: RhythmQuery) -> DataFrame:
    """Windows with each plan (start, stop, scope) of their sample that holds them and is of the query's scope."""
    n = len(q.notes)
    met = windows.join(plans, "sample_id").where((F.col("start") <= F.col("first")) & (F.col("first") + n <= F.col("stop")))
    met = met.where("scope < 0") if q.scope == "sentence" else met.where("scope >= 0") if q.scope == "segment" else met
    return met.withColumn("at", (F.col("first") - F.col("start")).cast("int"))


def _lengths_fit(q: RhythmQuery, length) -> Column:
    tests = [F.lit(True)]
    for j, (low, high) in q.beats.items():
        tests += [length(j) >= low - 1e-9] if low is not None else []
        tests += [length(j) <= high + 1e-9] if high is not None else []
    return reduce(lambda a, b: a & b, tests)


def shape_evidence(windows: DataFrame, plans: DataFrame, q: RhythmQuery) -> DataFrame:
    """Evidence without a tempo. plans: sample_id, scope, start, stop, onsets (seconds of all its blocks).

    Times are scaled to [0, 1] from the first onset to the last end, notes likewise, the tolerance with them.
    """
    n, span = len(q.notes), q.notes[-1][1] - q.notes[0][0]
    t0, t1 = F.col("onset")[0], F.get("end", F.lit(n - 1))
    rows = _within(windows, plans, q).where(t1 > t0)
    scale = lambda t: (t - t0) / (t1 - t0)
    notes = F.array(*(F.struct(F.lit((a - q.notes[0][0]) / span).alias("a"), F.lit((b - q.notes[0][0]) / span).alias("b")) for a, b in q.notes))
    others = F.transform(F.concat(F.slice("onsets", 1, F.col("at")), F.slice("onsets", F.col("at") + n + 1, F.greatest(F.size("onsets"), F.lit(1)))), scale)
    known = reduce(lambda a, b: a & b, [F.get("sustain", F.lit(j)).isNotNull() for j in q.sustain], F.lit(True))
    rows = rows.where(known & _lengths_fit(q, lambda j: (F.get("end", F.lit(j)) - F.get("onset", F.lit(j))) / (t1 - t0) * span))
    sustains = F.transform("sustain", lambda s, j: F.when(j.isin(*q.sustain) if q.sustain else F.lit(False), scale(s)))
    e = rows.withColumn("e", _ranked(F.transform("onset", scale), others, sustains, notes, q.tolerance / span))
    none = F.lit(None)
    return e.select("sample_id", "first", "scope", none.cast("string").alias("plan"), "e.strict", (F.col("e.err") + F.col("e.conflicts")).alias("cost"), (F.col("e.deviation") * span).alias("error"), "e.conflicts", (F.col("e.deficit") * span).alias("deficit"), none.cast("double").alias("speed"), (F.col("e.shift") * span).alias("shift"), F.lit(0.0).alias("deform"), F.array().cast("array<int>").alias("rests"), F.lit(0).alias("changed"))


def _rests(q: RhythmQuery, x: Column, notes: Column) -> Column:
    """Combinations (rests, changed, xs) of rest cells at the window's joints, the plan's own first."""
    n = len(q.notes)
    plain = F.array(F.struct(F.array().cast("array<int>").alias("rests"), F.lit(0).alias("changed"), x.alias("xs")))
    if not q.adjust_rests or n == 1:
        return plain
    density, seg = F.col("density"), F.col("seg")
    joints = F.filter(F.sequence(F.lit(1), F.lit(n - 1)), lambda j: ~F.get(seg, j).eqNullSafe(F.get(seg, j - 1)))
    step = lambda j: F.get(x, j) - F.get(x, j - 1)
    own = lambda j: F.greatest(F.lit(1), F.bround((step(j) - F.get("cells", F.col("at") + j - 1) / density) * density).cast("int"))

    def values(j):
        d = own(j)
        top = F.greatest(F.lit(LEAST_REST_RANGE), d)
        need = d + F.bround((F.get(notes, j)["a"] - F.get(notes, j - 1)["a"] - step(j)) * density).cast("int")
        near = F.transform(F.array(need, need - 1, need + 1, d - 1, d + 1, d - 2, d + 2), lambda v: F.greatest(F.lit(1), F.least(top, v)))
        return F.array_distinct(F.concat(F.array(d), F.when(F.size(joints) == 1, F.sequence(F.lit(1), top)).otherwise(near)))

    empty = F.array(F.array().cast("array<int>"))
    combos = F.aggregate(F.transform(joints, values), empty, lambda acc, vals: F.slice(F.flatten(F.transform(acc, lambda c: F.transform(vals, lambda v: F.concat(c, F.array(v))))), 1, COMBOS))
    usual = F.transform(joints, own)
    by = lambda c: F.zip_with(c, usual, lambda a, b: a - b)
    moved = lambda c: F.transform(x, lambda v, j: v + F.aggregate(F.zip_with(by(c), joints, lambda m, at: F.when(at <= j, m / density).otherwise(0.0)), F.lit(0.0), lambda a, m: a + m))
    made = F.transform(combos, lambda c: F.struct(c.alias("rests"), F.aggregate(by(c), F.lit(0), lambda a, m: a + F.abs(m)).alias("changed"), moved(c).alias("xs")))
    return F.when((F.col("scope") < 0) & (F.size(joints) > 0), made).otherwise(plain)


def beat_evidence(windows: DataFrame, schemes: DataFrame, q: RhythmQuery) -> DataFrame:
    """Evidence on each plan's beats: the best combination of rests for each window and plan.

    schemes: sample_id, scope (-1: whole sentence), plan, start, stop, density, speed, ratio, beat_seconds, cells and onsets
    (beats) of its blocks, points (src, beat) at its control points, exact (the same map in full). Strict windows are judged on
    the exact map with a fitted shift, others between control points with the median shift.
    """
    n, notes = len(q.notes), q.note_array()
    rows = _within(windows, schemes, q)
    if q.speeds:
        rows = rows.where(F.col("speed").between(q.speeds[0] - 1e-9, q.speeds[1] + 1e-9))
    to_beat = lambda t: interpolate(F.col("exact") if q.strict else F.col("points"), t)
    rows = rows.withColumn("x", F.slice("onsets", F.col("at") + 1, n))
    began = lambda j: F.get("x", F.lit(j)) if q.strict else to_beat(F.get("onset", F.lit(j)))
    known = reduce(lambda a, b: a & b, [F.get("sustain", F.lit(j)).isNotNull() for j in q.sustain], F.lit(True))
    rows = rows.where(known & _lengths_fit(q, lambda j: to_beat(F.get("end", F.lit(j))) - began(j)))
    held = F.transform("sustain", lambda s, j: F.when(j.isin(*q.sustain) if q.sustain else F.lit(False), to_beat(s)))
    # how much the window's stretches differ from the plan's own ratio
    reached = F.size(F.filter("points", lambda p: p["src"] <= F.get("onset", F.lit(n - 1)) + 1e-9))
    skipped = F.size(F.filter("points", lambda p: p["src"] < F.col("onset")[0] - 1e-9))
    slices = lambda near: F.zip_with(F.slice(near, 1, F.greatest(F.size(near) - 1, F.lit(0))), F.slice(near, 2, F.greatest(F.size(near) - 1, F.lit(0))), lambda a, b: F.named_struct(F.lit("s"), b["src"] - a["src"], F.lit("t"), (b["beat"] - a["beat"]) * F.col("beat_seconds")))
    near = let(skipped, lambda s: F.slice("points", s + 1, F.greatest(reached - s + 1, F.lit(0))))
    bent = F.transform(F.filter(let(near, slices), lambda p: (p["s"] > 0) & (p["t"] > 0)), lambda p: F.abs(F.log(p["t"] / p["s"] / F.col("ratio"))))
    deform = let(bent, lambda b: F.when(F.size(b) > 0, _mean(b)).otherwise(0.0))
    rows = rows.withColumns({"held": held, "deform": deform, "combo": F.explode(_rests(q, F.col("x"), notes))})
    xs, shift_of = F.col("combo.xs"), F.zip_with("combo.xs", "x", lambda a, b: a - b)
    tail = F.get("combo.xs", F.lit(n - 1)) - F.get("x", F.lit(n - 1))
    others = F.concat(F.slice("onsets", 1, F.col("at")), F.transform(F.slice("onsets", F.col("at") + n + 1, F.greatest(F.size("onsets"), F.lit(1))), lambda y: y + tail))
    lasting = F.zip_with("held", shift_of, lambda s, m: s + m)
    extra = REST_WEIGHT * F.col("combo.changed") + (q.speed_weight * F.abs(F.log2("speed")) if q.speed_weight else F.lit(0.0))
    if q.strict:
        lower = F.array_max(F.zip_with(notes, lasting, lambda m, s: m["b"] - s))
        # through a generator, so that the test for null does not fit the shift once more
        rows = rows.withColumn("e", F.explode(F.array(shift_fit(xs, others, notes, q.tolerance, lower)))).where("e is not null")
        zero = F.lit(0.0)
        judged = F.struct(F.col("e.mean").alias("order"), F.col("combo.changed").alias("changed"), (F.col("e.mean") + DEFORM_WEIGHT * F.col("deform") + extra).alias("cost"), F.lit(True).alias("strict"), F.col("e.mean").alias("error"), F.lit(0).alias("conflicts"), zero.alias("deficit"), F.col("e.shift").alias("shift"), F.col("combo.rests").alias("rests"))
    else:
        rows = rows.withColumn("e", _ranked(xs, others, lasting, notes, q.tolerance))
        whole = F.col("e.err") + F.col("e.conflicts")
        judged = F.struct(whole.alias("order"), F.col("combo.changed").alias("changed"), (whole + extra).alias("cost"), F.col("e.strict").alias("strict"), F.col("e.deviation").alias("error"), F.col("e.conflicts").alias("conflicts"), F.col("e.deficit").alias("deficit"), F.col("e.shift").alias("shift"), F.col("combo.rests").alias("rests"))
    best = rows.groupBy("sample_id", "first", "scope", "plan").agg(F.min(judged).alias("b"), F.first("speed").alias("speed"), F.first("deform").alias("deform"))
    rests = F.when(F.col("b.changed") > 0, F.col("b.rests")).otherwise(F.array().cast("array<int>"))
    return best.select("sample_id", "first", "scope", "plan", "b.strict", "b.cost", "b.error", "b.conflicts", "b.deficit", "speed", "b.shift", "deform", rests.alias("rests"), "b.changed")


def choose_evidence(windows: DataFrame, evidence: DataFrame, q: RhythmQuery) -> tuple[DataFrame, DataFrame]:
    """(one row a window: its best evidence, how many windows of each sample have none).

    The best has the least cost to 1e-10, plans that are not slower than speech first.
    """
    fit = evidence.where("strict") if q.strict else evidence
    order = F.struct(F.round("cost", 10), F.coalesce(F.col("speed") < 1, F.lit(False)), F.col("scope"), F.col("plan"))
    rest = [c for c in fit.columns if c not in ("sample_id", "first")]
    best = fit.groupBy("sample_id", "first").agg(F.min_by(F.struct(*rest), order).alias("_b")).select("sample_id", "first", *(F.col(f"_b.{c}").alias(c) for c in rest)).select(*fit.columns)
    without = windows.select("sample_id", "first").join(best.select("sample_id", "first"), ["sample_id", "first"], "left_anti").groupBy("sample_id").agg(F.count("*").alias("without"))
    return best, without
