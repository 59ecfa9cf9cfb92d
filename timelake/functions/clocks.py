"""Piecewise-linear clocks: a mapping is an array of (local, source) knots, strictly increasing in both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
#: Full tracks may differ from their source by this many seconds.
FULL_TRACK = 0.02


def overlaps(a0, a1, b0, b1, eps: float = EPS) -> Column:
    """Whether two half-open intervals share a positive length; touching ends do not count."""
    return (a0 < b1 - eps) & (a1 > b0 + eps)


def contains(a0, a1, b0, b1, eps: float = EPS) -> Column:
    return (a0 <= b0 + eps) & (a1 >= b1 - eps)


def _interpolate(mapping: Column, t: Column, x: str, y: str) -> Column:
    n = F.size(mapping)
    inside = (n >= 2) & (t >= mapping[0][x] - EPS) & (t <= F.element_at(mapping, -1)[x] + EPS)
    # the last knot at or before t, but never the last of all
    i = F.greatest(F.least(F.size(F.filter(mapping, lambda k: k[x] <= t)), n - 1), F.lit(1))
    a, b = F.element_at(mapping, i), F.element_at(mapping, i + 1)
    clamped = F.least(F.greatest(t, mapping[0][x]), F.element_at(mapping, -1)[x])
    return F.when(inside, a[y] + (clamped - a[x]) * (b[y] - a[y]) / (b[x] - a[x]))


def to_source(mapping: Column, t: Column) -> Column:
    """Local seconds to source seconds; null outside the mapping."""
    return _interpolate(mapping, t, "local", "source")


def to_local(mapping: Column, s: Column) -> Column:
    """Source seconds to local seconds; null outside the mapping."""
    return _interpolate(mapping, s, "source", "local")


def _knot(local: Column, source: Column) -> Column:
    return F.struct(local.cast("double").alias("local"), source.cast("double").alias("source"))


def crop_mapping(mapping: Column, a: Column, b: Column) -> Column:
    """The mapping of the part [a, b) on its own clock from 0: ends interpolated, inner knots shifted."""
    inner = F.transform(F.filter(mapping, lambda k: (k["local"] > a + EPS) & (k["local"] < b - EPS)), lambda k: _knot(k["local"] - a, k["source"]))
    return F.concat(F.array(_knot(F.lit(0.0), to_source(mapping, a))), inner, F.array(_knot(b - a, to_source(mapping, b))))


def compose_mapping(outer: Column, inner: Column) -> Column:
    """Local time of `inner` to the source of `outer`, whose local clock is inner's source: the union of both's knots."""
    from_outer = F.transform(outer, lambda k: to_local(inner, k["local"]))
    times = F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(F.transform(inner, lambda k: k["local"]), from_outer), lambda x: x.isNotNull()), lambda x: F.round(x, 9))))
    apart = F.filter(times, lambda x, i: (i == 0) | (x - F.element_at(times, F.greatest(i, F.lit(1))) > EPS))
    return F.transform(apart, lambda x: _knot(x, to_source(outer, to_source(inner, x))))


def reimport_mapping(mapping: Column, duration: Column, frame: Column) -> Column:
    """The start stays; the end comes from the new file when it differs by more than a frame."""
    end = F.element_at(mapping, -1)["local"]
    return F.when(F.abs(end - duration) <= frame, mapping).otherwise(crop_mapping(mapping, F.lit(0.0), F.least(duration, end)))


def is_full_track(mapping: Column, duration: Column) -> Column:
    """Whether every knot lies on the source clock and the end reaches the source's duration, within 20 ms."""
    same = F.forall(mapping, lambda k: F.abs(k["source"] - k["local"]) <= FULL_TRACK)
    return same & (F.abs(F.element_at(mapping, -1)["local"] - duration) <= FULL_TRACK)


def check_range(start: Column, end: Column, duration: Column, frame: Column) -> Column:
    """(start, end, error): ends within a frame outside [0, duration] snap to it; else an error names what is wrong."""
    s = F.when((start < 0) & (start >= -frame), F.lit(0.0)).otherwise(start)
    e = F.when((end > duration) & (end <= duration + frame), duration).otherwise(end)
    error = F.when(s < 0, "negative-start").when(e > duration, "beyond-end").when(e <= s, "empty")
    return F.struct(s.alias("start"), e.alias("end"), error.alias("error"))


def frame_of(t: Column) -> Column:
    """The 10 ms frame whose centre is nearest to a time."""
    return F.floor((t - 0.005) / 0.01 + 0.5).cast("long")


def clock_label(t: Column) -> Column:
    """M:SS.mmm, from an hour on H:MM:SS.mmm, with milliseconds rounded half to even; negative times count as zero."""
    ms = F.bround(F.greatest(t, F.lit(0.0)) * 1000).cast("long")
    hours, minutes, seconds = F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d.%03d", hours, minutes, seconds, ms % 1000)).otherwise(F.format_string("%d:%02d.%03d", minutes, seconds, ms % 1000))


def file_clock_label(t: Column) -> Column:
    """HH-MM-SS.mmm."""
    ms = F.bround(t * 1000).cast("long")
    return F.format_string("%02d-%02d-%02d.%03d", F.floor(ms / 3600000).cast("long"), F.floor(ms / 60000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def picture_time(mode: Column, source_t: Column, local_t: Column, offset: Column, duration: Column) -> Column:
    """The time inside a picture's file: sync follows the source with an offset (null where the source's time is unknown), an image
    stands at 0, a loop takes the local time modulo its duration."""
    around = F.when(F.coalesce(duration, F.lit(0.0)) > 0, F.pmod(local_t, duration)).otherwise(0.0)
    return F.when(mode == "image", 0.0).when(mode == "loop", around).otherwise(source_t + F.coalesce(offset, F.lit(0.0)))
