"""Time maps that bring a sentence onto a beat: control points, integer-frame knots, the map and its inverse, speeds, densities.

All are column expressions over one row's arrays, so they need no shuffle, and a row with another density or tempo is one
more row. blocks: array<(onset, end, cells, dur, rest)> in order (seconds, whole cells); pauses: array<(start, end)>, disjoint,
in order; cuts: array<int>, the blocks before which a phrase is cut (merged cuts are not among them). Frames are samples of the
source, rounded half to even.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a protected core on each side, the part of a bridge that pauses keep, the longest output, and the
#: bounds of tempo, of the exponent of a density and of how far it is sought.
CORE, RESERVE, LONGEST = 0.008, 0.02, 600.0
TEMPI, PROBE, EXPONENT, STEPS = (20.0, 400.0), 120.0, 40, 24
HALVINGS, SPEED_EPS, SPEED_OFF = 32, 1e-5, 1e-3
LAST = 0.001


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _last(values: Column) -> Column:
    return F.element_at(values, -1)


def beats(blocks: Column, density: Column) -> Column:
    """(onsets, rests, cells): target beats of each block's onset and of the sentence's end, whole rest cells, all cells."""
    seconds, cells = total(F.transform(blocks, lambda b: b["dur"])), total(F.transform(blocks, lambda b: b["cells"].cast("double")))

    def with_tick(tick):
        rests = F.transform(blocks, lambda b: F.greatest(F.lit(0.0), F.rint(b["rest"] / tick)))
        steps = lambda r: F.zip_with(blocks, r, lambda b, x: (b["cells"] + x) / density)
        onsets = lambda r: F.aggregate(steps(r), F.array(F.lit(0.0)), lambda a, s: F.concat(a, F.array(_last(a) + s)))
        return let(rests, lambda r: F.struct(onsets(r).alias("onsets"), r.alias("rests"), cells.alias("cells"), seconds.alias("seconds")))

    return let(seconds / cells, with_tick)


def control_points(blocks: Column, pauses: Column, cuts: Column, w1: Column, density: Column, beat: Column) -> Column:
    """array<(src, beat, kind, k)> by source time: block onsets, the ends of phrases, and the sentence's end.

    A phrase's end is that of its last block, or the first pause inside its space if that is sooner; phrases whose next onset
    falls on the same beat have none. beat: what `beats` gave.
    """
    point = lambda s, b, kind, k: F.struct(s.cast("double").alias("src"), b.cast("double").alias("beat"), F.lit(kind).alias("kind"), k.cast("int").alias("k"))
    onsets = F.transform(blocks, lambda b, i: point(b["onset"], F.get(beat["onsets"], i), "onset", i))

    def tail(k):
        b, after = F.get(blocks, k - 1), F.get(blocks, k)
        quiet = F.transform(F.filter(pauses, lambda p: (p["start"] > b["onset"]) & (p["start"] < after["onset"])), lambda p: p["start"])
        return F.least(b["end"], F.array_min(quiet)), F.get(beat["onsets"], k - 1) + b["cells"] / density

    inside = F.filter(cuts, lambda k: (F.get(beat["rests"], k - 1) >= 1) & (tail(k)[0] > F.get(blocks, k - 1)["onset"]) & (tail(k)[0] < F.get(blocks, k)["onset"]))
    tails = F.transform(inside, lambda k: point(*tail(k), "phrase-tail", k - 1))
    end = F.least(F.greatest(_last(blocks)["end"], _last(blocks)["onset"] + LAST), w1 - LAST)
    return F.array_sort(F.concat(onsets, tails, F.array(point(end, _last(beat["onsets"]), "tail", F.size(blocks) - 1))))


def _rising(points: Column, *names: str) -> Column:
    """Whether each entry lies above the one before it in all the fields."""
    def above(i):
        a, b = F.get(points, i - 1), F.get(points, i)
        ok = F.lit(True)
        for n in names:
            ok = ok & (b[n] > a[n])
        return ok

    return (F.size(points) < 2) | F.forall(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), above)


def _piece(sa, sb, ta, tb, kind: str | Column, bridge) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(sa.cast("long").alias("sa"), sb.cast("long").alias("sb"), ta.cast("long").alias("ta"), tb.cast("long").alias("tb"), kind.alias("kind"), bridge.cast("int").alias("bridge"))


def _bridge(sa, sb, ta, tb, i, pauses: Column, frame: Callable[[Column], Column], ratio: Column) -> Column:
    """Pieces between two cores: speech stretches by at most the whole ratio, pauses take the rest and keep a part of the length."""
    length = tb - ta
    met = F.filter(F.transform(pauses, lambda p: F.struct(F.greatest(sa, frame(p["start"])).alias("a"), F.least(sb, frame(p["end"])).alias("b"))), lambda p: p["b"] > p["a"])

    def parts(quiet):
        silence = F.aggregate(quiet, F.lit(0).cast("long"), lambda a, p: a + (p["b"] - p["a"]))
        speech = (sb - sa) - silence
        spoken = F.least(speech * ratio, length - F.least(silence.cast("double"), RESERVE * length))
        part = lambda a, b, quiet: F.struct(a.alias("a"), b.alias("b"), F.lit(quiet).alias("quiet"))
        before = lambda n: F.when(n == 0, sa).otherwise(F.get(quiet, n - 1)["b"])
        cut = F.flatten(F.transform(quiet, lambda p, n: F.array(part(before(n), p["a"], False), part(p["a"], p["b"], True))))
        cut = F.filter(F.concat(cut, F.array(part(_last(quiet)["b"], sb, False))), lambda s: s["b"] > s["a"])
        start = F.struct(F.lit(0.0).alias("gone"), ta.cast("double").alias("at"), F.array().cast("array<struct<sa:bigint,sb:bigint,ta:bigint,tb:bigint,kind:string,bridge:int>>").alias("out"))

        def lay(segments):
            def step(a, n):
                s = F.get(segments, n)
                # lengths are added up before they meet the bridge's start, as in SQL: at a half the order decides
                gone = a["gone"] + (s["b"] - s["a"]) * F.when(s["quiet"], (length - spoken) / silence).otherwise(spoken / speech)
                end = F.when(n == F.size(segments) - 1, tb.cast("double")).otherwise(ta + gone)
                made = _piece(s["a"], s["b"], F.rint(a["at"]), F.rint(end), F.when(s["quiet"], "pause").otherwise("bridge"), i)
                return F.struct(gone.alias("gone"), end.alias("at"), F.concat(a["out"], F.array(made)).alias("out"))

            laid = F.aggregate(F.sequence(F.lit(0), F.size(segments) - 1), start, step, lambda a: a["out"])
            return F.filter(laid, lambda p: (p["tb"] > p["ta"]) & (p["sb"] > p["sa"]))

        plain = F.array(_piece(sa, sb, ta, tb, F.when(silence == 0, "bridge").otherwise("pause"), i))
        return F.when((silence == 0) | (speech <= 0), plain).otherwise(let(cut, lay))

    return let(F.array_sort(met), parts)


def time_map(points: Column, pauses: Column, w0: Column, w1: Column, ratio: Column, beat_seconds: Column, rate: Column) -> Column:
    """(error, knots array<(s, t)>, pieces array<(sa, sb, ta, tb, kind, bridge)>, targets, frames): the map in whole frames.

    Around each control point a core of at most 8 ms (a quarter of the spaces beside it, at source and target) is kept as it is;
    a point at the window's edge keeps its inner side alone. Before the first and after the last core the whole ratio holds,
    between them bridges do. Errors: rhythm-map-not-monotonic, rhythm-output-too-long; then the rest is null.
    """
    frame = lambda t: F.rint((t - w0) * rate).cast("long")
    floor = lambda x: F.floor(x / 4).cast("long")
    whole = F.when(~_rising(points, "src", "beat"), "rhythm-map-not-monotonic")
    n, cap, size = F.size(points), F.rint(CORE * rate).cast("long"), frame(w1)

    def with_frames(g):
        src, rel = g["src"], g["rel"]

        def core(i):
            first, last = i == 0, i == n - 1
            here = F.get(src, i)
            sl, sr = here - F.when(first, F.lit(0)).otherwise(F.get(src, i - 1)), F.when(last, size).otherwise(F.get(src, i + 1)) - here
            tl = F.when(first, (F.get(src, F.lit(0)) * ratio).cast("long")).otherwise(F.get(rel, i) - F.get(rel, i - 1))
            tr = F.when(last, ((size - here) * ratio).cast("long")).otherwise(F.get(rel, i + 1) - F.get(rel, i))
            left_edge, right_edge = first & ((sl == 0) | (tl == 0)), last & ((sr == 0) | (tr == 0))
            left, right = F.greatest(F.lit(0), F.least(cap, floor(sl), floor(tl))), F.greatest(F.lit(0), F.least(cap, floor(sr), floor(tr)))
            apart, both = left_edge | right_edge, F.least(left, right)
            return F.struct(F.when(left_edge, F.lit(0)).when(apart, left).otherwise(both).cast("long").alias("l"), F.when(right_edge, F.lit(0)).when(apart, right).otherwise(both).cast("long").alias("r"))

        def with_cores(cores):
            offset = F.rint((F.get(src, F.lit(0)) - cores[0]["l"]) * ratio).cast("long") + cores[0]["l"]
            return let(F.transform(rel, lambda r: r + offset), lambda tgt: with_targets(cores, tgt))

        def with_targets(cores, tgt):
            tail = size - _last(src) - _last(cores)["r"]
            out = _last(tgt) + _last(cores)["r"] + F.rint(tail * ratio).cast("long")

            def around(i):
                c, s, t = F.get(cores, i), F.get(src, i), F.get(tgt, i)
                own = F.array(_piece(s - c["l"], s + c["r"], t - c["l"], t + c["r"], "core", F.lit(-1)))
                after = F.get(cores, i + 1)
                return F.when(i == n - 1, own).otherwise(F.concat(own, _bridge(s + c["r"], F.get(src, i + 1) - after["l"], t + c["r"], F.get(tgt, i + 1) - after["l"], i, pauses, frame, ratio)))

            edge = F.array(_piece(F.lit(0), F.get(src, F.lit(0)) - cores[0]["l"], F.lit(0), F.get(tgt, F.lit(0)) - cores[0]["l"], "edge", F.lit(-1)))
            last = F.array(_piece(size - tail, size, _last(tgt) + _last(cores)["r"], out, "edge", F.lit(-1)))
            pieces = F.filter(F.concat(edge, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), around)), last), lambda p: (p["sb"] > p["sa"]) | (p["tb"] > p["ta"]))

            def with_pieces(p):
                knot = lambda s, t: F.struct(s.alias("s"), t.alias("t"))
                ends = F.concat(F.array(knot(F.lit(0).cast("long"), F.lit(0).cast("long"))), F.transform(p, lambda x: knot(x["sb"], x["tb"])))
                knots = let(ends, lambda e: F.filter(e, lambda k, i: (i == 0) | (k != F.get(e, i - 1))))
                error = lambda k: F.when(out / rate > LONGEST, "rhythm-output-too-long").when(~_rising(k, "s", "t"), "rhythm-map-not-monotonic")
                return let(knots, lambda k: F.struct(error(k).alias("error"), k.alias("knots"), p.alias("pieces"), tgt.alias("targets"), out.alias("frames")))

            return let(pieces, with_pieces)

        return let(F.transform(F.sequence(F.lit(0), n - 1), core), with_cores)

    frames = F.struct(F.transform(points, lambda p: frame(p["src"])).alias("src"), F.transform(points, lambda p: F.rint((p["beat"] - points[0]["beat"]) * beat_seconds * rate).cast("long")).alias("rel"))
    made = let(frames, with_frames)
    kinds = "struct<error:string,knots:array<struct<s:bigint,t:bigint>>,pieces:array<struct<sa:bigint,sb:bigint,ta:bigint,tb:bigint,kind:string,bridge:int>>,targets:array<bigint>,frames:bigint>"
    failed = lambda e: F.struct(e.alias("error"), *(F.lit(None).alias(x) for x in ("knots", "pieces", "targets", "frames"))).cast(kinds)
    return F.when(whole.isNotNull(), failed(whole)).otherwise(let(made, lambda m: F.when(m["error"].isNull(), m.cast(kinds)).otherwise(failed(m["error"]))))


def _through(knots: Column, x: Column, a: str, b: str) -> Column:
    i = F.size(F.filter(knots, lambda k: k[a] < x))
    left, right = F.get(knots, i - 1), F.get(knots, i)
    inner = left[b] + (x - left[a]) * (right[b] - left[b]) / (right[a] - left[a])
    return F.when(i == 0, knots[0][b].cast("double")).when(i == F.size(knots), _last(knots)[b].cast("double")).otherwise(inner)


def to_target(knots: Column, frame: Column) -> Column:
    """The target frame of a source frame; frames beyond the ends go to them."""
    return _through(knots, frame, "s", "t")


def to_source(knots: Column, frame: Column) -> Column:
    """The source frame of a target frame."""
    return _through(knots, frame, "t", "s")


def speech_speed(knots: Column, points: Column, pauses: Column, w0: Column, rate: Column) -> Column:
    """Seconds of speech (from the first onset to the end, without pauses) over what the map makes of them."""
    a, b = (points[0]["src"] - w0) * rate, (_last(points)["src"] - w0) * rate
    at = lambda t: (t - w0) * rate
    met = F.filter(pauses, lambda p: (at(p["end"]) > a) & (at(p["start"]) < b))
    quiet = F.transform(met, lambda p: F.struct(F.greatest(a, at(p["start"])).alias("a"), F.least(b, at(p["end"])).alias("b")))

    def ratio(q):
        source = (b - a) - total(F.transform(q, lambda p: p["b"] - p["a"]))
        target = to_target(knots, b) - to_target(knots, a) - total(F.transform(q, lambda p: to_target(knots, p["b"]) - to_target(knots, p["a"])))
        return let(target, lambda t: F.when(t > 0, source / t).otherwise(F.lit(float("inf"))))

    return let(quiet, ratio)


def scheme(plan: dict[str, Column], density: Column, bpm: Column) -> Column:
    """(error, density, bpm, speed, ratio, beats, tail, points, knots, pieces, frames) of a plan at a density and a tempo.

    plan: blocks, pauses, cuts, w0, w1 and rate.
    """
    blocks, pauses, w0, w1, rate = (plan[c] for c in ("blocks", "pauses", "w0", "w1", "rate"))

    def with_beats(beat):
        ratio = beat["cells"] / density * (60.0 / bpm) / beat["seconds"]

        def with_points(points):
            return let(time_map(points, pauses, w0, w1, ratio, 60.0 / bpm, rate), lambda m: with_map(points, m))

        def with_map(points, m):
            speed = F.when(m["error"].isNull(), speech_speed(m["knots"], points, pauses, w0, rate))
            onsets = F.slice(beat["onsets"], 1, F.size(blocks))
            return F.struct(m["error"].alias("error"), density.cast("double").alias("density"), bpm.cast("double").alias("bpm"), speed.alias("speed"), ratio.alias("ratio"), onsets.alias("beats"), _last(beat["onsets"]).alias("tail"), points.alias("points"), m["knots"].alias("knots"), m["pieces"].alias("pieces"), m["frames"].alias("frames"))

        return let(control_points(blocks, pauses, plan["cuts"], w1, density, beat), with_points)

    return let(beats(blocks, density), with_beats)
