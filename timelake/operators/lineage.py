"""Where sounds come from: chains of inputs, the track to return to, inherited facts; phones on a reader's clock, and their merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.clocks import is_full_track, to_local
from timelake.operators.intervals import overlap_join

#: Steps of a chain; five doublings reach them all.
STEPS = 32
EPS = 1e-6
PAUSE = "pau"


def _paths(assets: DataFrame, stop: Column) -> DataFrame:
    """(id, path, ended): each asset and the inputs before it, at most STEPS, up to the first that `stop` holds for.

    Paths double their length in each of five self-joins, so that no loop waits for a result. A path ends at an asset
    that is not in the table, and before an asset that it holds already.
    """
    at = assets.select("id", F.array("id").alias("path"), F.when(~stop, F.col("input_id")).alias("next"), stop.alias("ended"))
    for _ in range(STEPS.bit_length() - 1):
        more = at.select(F.col("id").alias("next"), F.col("path").alias("p"), F.col("next").alias("n"), F.col("ended").alias("e"))
        met = at.join(more, "next", "left")
        at = met.select("id", F.coalesce(F.concat("path", "p"), "path").alias("path"), F.col("n").alias("next"), F.when(F.col("p").isNotNull(), F.col("e")).otherwise(F.col("ended")).alias("ended"))
    return at.select("id", F.array_distinct("path").alias("path"), "ended")


def asset_chain(assets: DataFrame) -> DataFrame:
    """(id, depth, ancestor, complete) along inputs, the asset itself first: at most STEPS, cycles end where they close.

    assets: id, input_id, origin. A chain is complete if its last asset is a stream, or a separation without an input.
    """
    origin = (F.col("origin") == "stream") | ((F.col("origin") == "separation") & F.col("input_id").isNull())
    return _paths(assets, origin).select("id", F.posexplode("path").alias("depth", "ancestor"), F.col("ended").alias("complete"))


def analysis_track(sources: DataFrame, streams: DataFrame) -> DataFrame:
    """(source_id, analysis): of an available source its default vocal track, else its default stream, else its first one.

    sources: source_id, available, default_vocal, default_stream; streams: source_id, asset_id, ordinal.
    """
    own = streams.join(sources.select("source_id", "default_stream"), "source_id")
    other = ~F.coalesce(F.col("ordinal") == F.col("default_stream"), F.lit(False))
    first = own.groupBy("source_id").agg(F.min_by("asset_id", F.struct(other, F.col("ordinal"))).alias("stream"))
    return sources.where("available").join(first, "source_id", "left").select("source_id", F.coalesce("default_vocal", "stream").alias("analysis"))


def back_track(assets: DataFrame, sources: DataFrame, streams: DataFrame) -> DataFrame:
    """(id, track): the first full track up the chain, else the analysis track of the last asset's source, else its first stream.

    assets: id, source_id, input_id, mapping; sources also have a duration.
    """
    full = assets.join(sources.select("source_id", "duration"), "source_id", "left").select("id", "source_id", F.coalesce(is_full_track(F.col("mapping"), F.col("duration")), F.lit(False)).alias("full"))
    steps = _paths(assets, F.lit(False)).select("id", F.posexplode("path").alias("depth", "at"))
    met = steps.join(full.withColumnRenamed("id", "at"), "at")
    per = met.groupBy("id").agg(F.min_by("at", F.when(F.col("full"), F.col("depth"))).alias("found"), F.max_by("source_id", "depth").alias("source_id"))
    first = streams.groupBy("source_id").agg(F.min_by("asset_id", "ordinal").alias("first"))
    rest = per.join(analysis_track(sources, streams), "source_id", "left").join(first, "source_id", "left")
    return rest.select("id", F.coalesce("found", "analysis", "first").alias("track"))


def inherited_facts(assets: DataFrame) -> DataFrame:
    """(id, reimport_id, from_separation): the nearest re-import up the chain (the asset itself first), and whether a separation is in it."""
    steps = _paths(assets, F.lit(False)).select("id", F.posexplode("path").alias("depth", "at"))
    met = steps.join(assets.select(F.col("id").alias("at"), "origin"), "at")
    near = F.min_by("at", F.when(F.col("origin") == "reimport", F.col("depth")))
    return met.groupBy("id").agg(near.alias("reimport_id"), F.max(F.col("origin") == "separation").alias("from_separation"))


def phones_to_reader(phones: DataFrame, readers: DataFrame) -> DataFrame:
    """Phones (reader_id, idx, label, start, end, eff_start, eff_end; source time) on the clock of their reader (reader_id, mapping).

    Those outside what the reader covers go (pauses of no length inside stay), edges are cut, and a cut phone that is no
    pause is marked as clipped; an effective range that lies outside becomes null.
    """
    j = phones.join(readers, "reader_id")
    mapping = F.col("mapping")
    low, high = mapping[0]["source"], F.element_at(mapping, -1)["source"]
    a, b = F.greatest("start", low), F.least("end", high)
    meets = (F.col("end") > low + EPS) & (F.col("start") < high - EPS)
    point = (F.col("end") - F.col("start") <= EPS) & (F.col("start") >= low - EPS) & (F.col("start") <= high + EPS)
    here = lambda t: F.round(to_local(mapping, t), 6)
    e0, e1 = F.greatest("eff_start", low), F.least("eff_end", high)
    cut = (F.col("label") != PAUSE) & ((a > F.col("start") + EPS) | (b < F.col("end") - EPS))
    some = F.col("eff_start").isNotNull() & (e1 > e0)
    new = {"clipped": cut, "start": here(a), "end": here(b), "eff_start": F.when(some, here(e0)), "eff_end": F.when(some, here(e1))}
    return j.where(meets | point).withColumns(new).drop("mapping")


def _clipped(phones: DataFrame) -> DataFrame:
    """Phones cut to their sample's [w0, w1)."""
    a, b = F.greatest("start", "w0"), F.least("end", "w1")
    cut = (F.col("label") != PAUSE) & ((a > F.col("start") + EPS) | (b < F.col("end") - EPS))
    return phones.where((F.col("end") > F.col("w0")) & (F.col("start") < F.col("w1"))).withColumns({"clipped": F.coalesce("clipped", F.lit(False)) | cut, "start": a, "end": b})


def merge_units(phones: DataFrame, units: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(phones, conflicts) of the segments that a sample reads, merged.

    phones: sample_id, unit, idx, label, start, end, mora, word, clipped; units: sample_id, unit, ordinal, n_morae, n_words;
    samples: sample_id, w0, w1. Units follow each other by their first and last speech; their outer pauses go, but for the
    sample's first and last one, and a space between two becomes a pause; ordinals of morae and words run on. Result:
    sample_id, unit, idx (null: a pause put in), label, start, end, mora, word, clipped. Samples in which speech of two
    units overlaps have no phones but one conflict: sample_id, a, b (ordinals), start, end.
    """
    speech = phones.where(F.col("label") != PAUSE)
    span = speech.groupBy("sample_id", "unit").agg(F.min("idx").alias("i0"), F.max("idx").alias("i1"), F.min_by("start", "idx").alias("sp0"), F.max_by("end", "idx").alias("sp1"))
    # all tables here grow with the phones: none is sent whole to the driver, however small its estimate
    w = Window.partitionBy("sample_id").orderBy("sp0", "sp1", "unit")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    placed = units.join(span.hint("merge"), ["sample_id", "unit"]).withColumns(
        {"place": F.row_number().over(w), "morae": F.coalesce(F.sum("n_morae").over(before), F.lit(0)), "words": F.coalesce(F.sum("n_words").over(before), F.lit(0)), "gap_from": F.lag("sp1").over(w), "last": F.lead("unit").over(w).isNull()}
    )
    rows = phones.join(placed.hint("merge"), ["sample_id", "unit"]).join(samples.hint("merge"), "sample_id")
    own = _clipped(rows.where(F.col("label") != PAUSE)).select("sample_id", "unit", "ordinal", "place", "idx", "start", "end")
    pairs = overlap_join(own, own, "sample_id", 10.0, EPS).where(F.col("place") < F.col("r_place"))
    first = F.min(F.struct("place", "r_place", "idx", "r_idx", F.least("ordinal", "r_ordinal").alias("a"), F.greatest("ordinal", "r_ordinal").alias("b"), F.round(F.greatest("start", "r_start"), 6).alias("s"), F.round(F.least("end", "r_end"), 6).alias("e")))
    conflicts = pairs.groupBy("sample_id").agg(first.alias("c")).select("sample_id", "c.a", "c.b", F.col("c.s").alias("start"), F.col("c.e").alias("end"))
    kept = rows.where(((F.col("idx") >= F.col("i0")) | (F.col("place") == 1)) & ((F.col("idx") <= F.col("i1")) | F.col("last")))
    kept = kept.withColumns({"mora": F.col("mora") + F.col("morae"), "word": F.col("word") + F.col("words")})
    names = ["sample_id", "unit", "idx", "label", "start", "end", "mora", "word", "clipped", "w0", "w1"]
    none = lambda c: F.lit(None).cast(kept.schema[c].dataType).alias(c)
    spaces = placed.where(F.col("sp0") > F.col("gap_from") + EPS).join(samples.hint("merge"), "sample_id")
    pauses = spaces.select("sample_id", "unit", none("idx"), F.lit(PAUSE).alias("label"), F.col("gap_from").alias("start"), F.col("sp0").alias("end"), none("mora"), none("word"), F.lit(False).alias("clipped"), "w0", "w1")
    merged = _clipped(kept.select(*names).union(pauses)).drop("w0", "w1").join(conflicts.select("sample_id").hint("merge"), "sample_id", "left_anti")
    return merged, conflicts
