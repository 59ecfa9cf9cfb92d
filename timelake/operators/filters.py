"""Filters of samples: nature, marks, text, metrics, facets and expressions; the search of the text layer."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelake.functions.text import hiragana_needle, nfc, norm_needle, norm_text
from timelake.operators.intervals import overlap_join
from timelake.operators.tags import tag_expr

#: The natures of samples, the facets, and the tag prefixes of those that have one.
NATURES = ("speech", "pitched", "unpitched", "unclassified")
FACETS = ("work", "type", "person", "pitch", "other")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PREFIX = {"work": "work:", "type": "type:", "pitch": "pitch:"}


@dataclass(frozen=True)
class FacetChoice:
    """Any of the values of one facet; `single` leaves persons who speak among others out."""

    facet: str
    values: tuple[str, ...]
    single: bool = False

    def __post_init__(self):
        if self.facet not in FACETS or not self.values or not all(0 < len(v) <= 500 for v in self.values):
            raise ValueError("a facet has a known name and 1 or more values of at most 500 characters")

    def tags(self) -> list[str]:
        """The tags that fulfil the choice; values of `other` are whole tags."""
        if self.facet == "person":
            spaces = ["character:"] if self.single else ["character:", "participants:"]
        else:
            spaces = [_PREFIX.get(self.facet, "")]
        return [s + v for v in dict.fromkeys(self.values) for s in spaces]


@dataclass(frozen=True)
class MetricRange:
    """A metric within bounds; an open range asks nothing."""

    metric: str
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        if self.low is not None and self.high is not None and self.low > self.high:
            raise ValueError("a range's low bound is at most its high one")


@dataclass(frozen=True)
class SampleFilter:
    """What samples must satisfy, all together; empty parts ask nothing."""

    natures: tuple[str, ...] = ()
    starred: bool = False
    project_tag: str = ""
    languages: tuple[str, ...] = ()
    source_id: object = None
    session: object = None
    text: str = ""
    metrics: tuple[MetricRange, ...] = ()
    facets: tuple[FacetChoice, ...] = ()
    scope_expr: str = ""
    expr: str = ""

    def __post_init__(self):
        if not set(self.natures) <= set(NATURES):
            raise ValueError(f"natures are {NATURES}")


def tag_predicate(spec: SampleFilter, tags: Column) -> Column:
    """Facets and both expressions over one array of tags; a null array counts as no tags."""
    have = F.coalesce(tags, F.array().cast("array<string>"))
    tests = [F.arrays_overlap(have, F.array(*map(F.lit, c.tags()))) for c in spec.facets] + [tag_expr(e, have) for e in (spec.scope_expr, spec.expr) if e.strip()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_metrics(samples: DataFrame, metrics: DataFrame, ranges: tuple[MetricRange, ...], algo: str, signatures: DataFrame) -> DataFrame:
    """Samples with a valid metric row (same asset, interval, algorithm and storage signature) and every metric in its range.

    metrics: sample_id, asset_id, start, end, algo, signature, values (map); signatures: asset_id, signature. A metric that
    is null or absent is in no range.
    """
    asked = [r for r in ranges if r.low is not None or r.high is not None]
    if not asked:
        return samples
    tests = [F.col("algo") == algo]
    for r in asked:
        v = F.try_element_at("values", F.lit(r.metric))
        tests += [v >= r.low] if r.low is not None else []
        tests += [v <= r.high] if r.high is not None else []
    valid = metrics.where(reduce(lambda a, b: a & b, tests)).join(signatures, ["asset_id", "signature"], "left_semi")
    return samples.join(valid.select(F.col("sample_id").alias("id"), "asset_id", "start", "end"), ["id", "asset_id", "start", "end"], "left_semi").select(*samples.columns)


def _holds(column: Column, needle: str) -> Column:
    """Substring test that tells no case of ASCII letters, after canonical composition."""
    plain = F.translate(nfc(column), _UPPER, _LOWER)
    wanted = unicodedata.normalize("NFC", needle).translate(str.maketrans(_UPPER, _LOWER))
    return F.coalesce(F.contains(plain, F.lit(wanted)), F.lit(False))


def text_match(samples: DataFrame, segments: DataFrame, needle: str, reading: str | None = None) -> DataFrame:
    """Samples whose name or note holds the needle, or that read a segment whose normalised text or reading holds it.

    samples: id, source_id, name, note, judge_start, judge_end. segments: source_id, start, end, norm, reading, with rows
    for current texts alone. The reading of the needle defaults to its kana as hiragana. Blank needles ask nothing.
    """
    needle = needle.strip()
    if not needle:
        return samples
    wanted, read = norm_needle(needle), norm_needle(hiragana_needle(needle if reading is None else reading))
    tests = [F.contains(F.col(c), F.lit(x)) for c, x in (("norm", wanted), ("reading", read)) if x]
    spoken = segments.where(reduce(lambda a, b: a | b, tests, F.lit(False)))
    windows = samples.select("id", "source_id", F.col("judge_start").alias("start"), F.col("judge_end").alias("end"))
    heard = overlap_join(windows, spoken.select("source_id", "start", "end"), eps=0.0).select("id").distinct().withColumn("_heard", F.lit(True))
    found = samples.join(heard, "id", "left")
    return found.where(_holds(F.col("name"), needle) | _holds(F.col("note"), needle) | F.coalesce("_heard", F.lit(False))).select(*samples.columns)


def filter_samples(samples: DataFrame, spec: SampleFilter, local: DataFrame | None = None, etags: DataFrame | None = None, segments: DataFrame | None = None, metrics: DataFrame | None = None, algo: str = "", signatures: DataFrame | None = None) -> DataFrame:
    """Samples that satisfy all parts of the filter, each a plain condition or a semi-join.

    samples: id, asset_id, source_id, start, end, judge_start, judge_end, name, note, nature, starred, language, session;
    local: sample_id, tag (the sample's own); etags: sample_id, tag (effective). A part needs its tables only when asked.
    """
    plain = [(spec.natures, lambda: F.col("nature").isin(*spec.natures)), (spec.starred, lambda: F.col("starred")), (spec.languages, lambda: F.col("language").isin(*spec.languages)), (spec.source_id is not None, lambda: F.col("source_id") == spec.source_id), (spec.session is not None, lambda: F.col("session") == spec.session)]
    out = samples
    for asked, test in plain:
        out = out.where(test()) if asked else out
    keyed = lambda df: df.select(F.col("sample_id").alias("id"))
    if spec.project_tag:
        out = out.join(keyed(local.where(F.col("tag") == spec.project_tag)), "id", "left_semi")
    out = text_match(out, segments, spec.text) if spec.text.strip() else out
    out = filter_metrics(out, metrics, spec.metrics, algo, signatures) if spec.metrics else out
    for choice in spec.facets:  # one semi-join a facet: the sets of tags are not gathered
        out = out.join(keyed(etags.where(F.col("tag").isin(choice.tags()))), "id", "left_semi")
    exprs = [e for e in (spec.scope_expr, spec.expr) if e.strip()]
    if exprs:
        sets = etags.groupBy(F.col("sample_id").alias("id")).agg(F.collect_set("tag").alias("_tags"))
        out = out.join(sets, "id", "left").where(reduce(lambda a, b: a & b, [tag_expr(e, F.col("_tags")) for e in exprs]))
    return out.select(*samples.columns)


def text_stream(segments: DataFrame, hints: DataFrame) -> DataFrame:
    """Segments and hints as one stream of texts: kind, id, source_id, start, end, text, speakers, norm, reading."""
    none = lambda t: F.lit(None).cast(t)
    own = segments.select(F.lit("segment").alias("kind"), "id", "source_id", "start", "end", "text", "speakers", "norm", "reading")
    return own.unionByName(hints.select(F.lit("hint").alias("kind"), "id", "source_id", "start", "end", "text", F.array().cast("array<string>").alias("speakers"), none("string").alias("norm"), none("string").alias("reading")))


def highlight(text: Column, needle: Column) -> Column:
    """(start, end) of each place of the original text whose normalised characters spell the needle, from the left, none overlapping."""
    units = F.split(text, "")
    chars = F.transform(units, lambda c: F.lower(F.regexp_replace(F.translate(c, _UPPER, _LOWER), r"[\p{P}\p{Z}\p{C}\s]", "")))
    origin = F.flatten(F.transform(chars, lambda c, i: F.array_repeat(i, F.length(c))))
    flat, n = F.array_join(chars, ""), F.length(needle)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a, _):
        hit = F.call_function("locate", needle, flat, a["at"])
        span = F.struct(F.element_at(origin, hit).alias("start"), (F.element_at(origin, hit + n - 1) + 1).alias("end"))
        return F.when((a["at"] > 0) & (hit > 0), F.struct((hit + n).alias("at"), F.concat(a["out"], F.array(span)).alias("out"))).otherwise(F.struct(F.lit(0).alias("at"), a["out"].alias("out")))

    rounds = F.sequence(F.lit(0), F.floor(F.length(flat) / F.greatest(n, F.lit(1))).cast("int"))
    return F.when((n > 0) & (F.length(flat) >= n), F.aggregate(rounds, start, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def search_text(stream: DataFrame, needle: str, speakers: tuple[str, ...] = (), reading: str | None = None) -> DataFrame:
    """Hits (kind, id, source_id, start, end, text, speakers, match, spans) of a text stream, and n_source: hits of the same source.

    A text matches by its normalised form (`norm`, made here where it is null), a segment also by its reading (match is
    `reading`, without spans). With `speakers` a hit has one of them, and hints are left out. Readings are null where stale.
    """
    wanted, read = norm_needle(needle), norm_needle(hiragana_needle(needle if reading is None else reading))
    rows = stream
    if speakers:
        rows = rows.where((F.col("kind") == "segment") & F.arrays_overlap("speakers", F.array(*map(F.lit, speakers))))
    ready, bare = rows.where(F.col("norm").isNotNull()), rows.where(F.col("norm").isNull())
    # only texts without a stored form pass through Python
    whole = ready.unionByName(bare.withColumn("norm", norm_text(F.col("text"))))
    by_text, by_reading = F.contains("norm", F.lit(wanted)), F.coalesce(F.contains("reading", F.lit(read)), F.lit(False)) if read else F.lit(False)
    hits = whole.where((by_text | by_reading) if wanted else F.lit(False)).withColumn("match", F.when(by_text, "text").otherwise("reading"))
    hits = hits.withColumn("spans", F.when(by_text, highlight(F.col("text"), F.lit(wanted))).otherwise(F.array().cast("array<struct<start:int,end:int>>")))
    counts = hits.groupBy("source_id").agg(F.count("*").alias("n_source"))
    return hits.join(counts, "source_id").select("kind", "id", "source_id", "start", "end", "text", "speakers", "match", "spans", "n_source")


def stale_readings(segments: DataFrame, search: DataFrame, version: str) -> DataFrame:
    """Segments (id, text) without a stored form of their current text and dictionary version. search: segment_id, text, version."""
    current = search.where(F.col("version") == version).select(F.col("segment_id").alias("id"), "text")
    return segments.join(current, ["id", "text"], "left_anti")
