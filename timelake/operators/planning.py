"""Plans and states over catalogue tables: tracks, roles, analysis, samples to make, pictures, storage, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.operators.intervals import overlap_join

#: Labels of phones that are silent, and of those that can sound by themselves (fixed values).
SILENT = ("pau", "sil", "sp", "SP", "AP", "cl", "q", "Q", "っ")
SOUNDING = ("a", "i", "u", "e", "o", "I", "U", "N")


def locate_storage(ranges: DataFrame, storage: DataFrame) -> DataFrame:
    """(id, storage_id, file_start): the storage window that covers each range (id, asset_id, start, end): primary before others.

    storage: storage_id, asset_id, kind, w_start, w_end.
    """
    pairs = ranges.join(storage, "asset_id").where((F.col("w_start") <= F.col("start") + 1e-9) & (F.col("w_end") >= F.col("end") - 1e-9))
    best = F.min_by(F.struct("storage_id", (F.col("start") - F.col("w_start")).alias("file_start")), F.struct(F.col("kind") != "primary", F.col("storage_id")))
    got = pairs.groupBy("id").agg(best.alias("b"))
    return ranges.select("id").join(got, "id", "left").select("id", "b.storage_id", "b.file_start")


def voiced(assets: DataFrame, roles: DataFrame) -> DataFrame:
    """(id, voiced): a vocal role is on, or no role at all and the track does not come from a separation."""
    r = roles.where("state = 'on'").groupBy("asset_id").agg(F.max(F.col("role") == "vocal").alias("vocal"))
    return assets.join(r, assets["id"] == r["asset_id"], "left").select("id", F.coalesce("vocal", ~F.col("separated")).alias("voiced"))


def list_tracks(assets: DataFrame, roles: DataFrame, wanted: list[str]) -> DataFrame:
    """Tracks with one of the wanted roles on; `mix` stands for tracks without any role."""
    on = roles.where("state = 'on'").groupBy("asset_id").agg(F.collect_set("role").alias("roles"))
    t = assets.join(on, assets["id"] == on["asset_id"], "left")
    named = F.arrays_overlap(F.coalesce("roles", F.array().cast("array<string>")), F.array(*map(F.lit, wanted)))
    return t.where(named | (F.col("roles").isNull() & F.lit("mix" in wanted))).drop("asset_id", "roles")


def nature_for_roles(roles: Column) -> Column:
    """The nature of a sample from its track's roles: voice alone is speech, effects alone are unpitched, else it is open."""
    r = F.array_distinct(roles)
    return F.when(r == F.array(F.lit("vocal")), "speech").when(r == F.array(F.lit("sfx")), "unpitched").otherwise("unclassified")


def prefill_roles(stems: DataFrame, aliases: DataFrame, roles: DataFrame) -> DataFrame:
    """(asset_id, role) to add: the alias's role of a stem, whatever the case, unless the role exists or was taken off."""
    named = stems.join(aliases.select(F.lower("alias").alias("_a"), "role"), F.lower("stem") == F.col("_a")).select("asset_id", "role")
    return named.distinct().join(roles, ["asset_id", "role"], "left_anti")


def unused(items: DataFrame, *users: DataFrame, key: str = "id") -> DataFrame:
    """Items that none of the users (tables with a column of the key's name) refers to."""
    for u in users:
        items = items.join(u.select(key), key, "left_anti")
    return items


def result_state(members: DataFrame, samples: DataFrame) -> DataFrame:
    """(id, state) of the members of a fixed result (id, binding, signature): deleted, changed, stale or ok."""
    s = samples.select("id", F.col("binding").alias("_b"), F.col("signature").alias("_s"), "deleted")
    state = F.when(F.coalesce("deleted", F.lit(True)), "deleted").when(~F.col("_b").eqNullSafe(F.col("binding")), "changed").when(~F.col("_s").eqNullSafe(F.col("signature")), "stale").otherwise("ok")
    return members.join(s, "id", "left").select("id", state.alias("state"))


def effective_picture(samples: DataFrame, own: DataFrame, of_source: DataFrame, streams: DataFrame) -> DataFrame:
    """(id, picture, origin): the sample's picture, else its source's, else the source's first video stream that is no cover."""
    first = streams.where("kind = 'video' and not cover").groupBy("source_id").agg(F.min_by("stream", F.struct("ordinal", "stream")).alias("p3"))
    j = samples.join(own.select("id", F.col("picture").alias("p1")), "id", "left").join(of_source.select("source_id", F.col("picture").alias("p2")), "source_id", "left").join(first, "source_id", "left")
    return j.select("id", F.coalesce("p1", "p2", "p3").alias("picture"), F.when(F.col("p1").isNotNull(), "sample").when(F.col("p2").isNotNull(), "source").when(F.col("p3").isNotNull(), "stream").alias("origin"))


def distinct_tracks(assets: DataFrame) -> DataFrame:
    """One track for each content of a source (the default one, else the smallest id) with how many more there are."""
    w = Window.partitionBy("source_id", "content")
    return assets.withColumn("_r", F.row_number().over(w.orderBy(F.desc("is_default"), "id"))).withColumn("duplicates", F.count("*").over(w) - 1).where("_r = 1").drop("_r")


def analysis_state(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, state) of samples (id, source_id, start, end, voiced) by the segments they read.

    segments: id, source_id, start, end, usable, manual, has_ok, failed. Tests in order: novoice, none, stale, then with
    all usable: partial, manual or ok; with some: incomplete; failed; none.
    """
    read = overlap_join(samples.select("id", "source_id", "start", "end"), segments)
    cover = (F.col("r_start") >= F.col("start") - 1e-6) & (F.col("r_end") <= F.col("end") + 1e-6)
    b = lambda c: c.cast("int")
    g = read.groupBy("id").agg(
        F.count("*").alias("n"),
        F.sum(b(F.col("r_usable"))).alias("usable"),
        F.max(b(F.col("r_has_ok") & ~F.col("r_usable"))).alias("stale"),
        F.min(b(cover)).alias("covers"),
        F.max(b(F.col("r_usable") & F.col("r_manual"))).alias("manual"),
        F.max(b(F.col("r_failed"))).alias("failed"),
    )
    state = (
        F.when(~F.col("voiced"), "novoice")
        .when(F.col("n").isNull(), "none")
        .when(F.col("stale") == 1, "stale")
        .when((F.col("usable") == F.col("n")) & (F.col("covers") == 0), "partial")
        .when((F.col("usable") == F.col("n")) & (F.col("manual") == 1), "manual")
        .when(F.col("usable") == F.col("n"), "ok")
        .when(F.col("usable") > 0, "incomplete")
        .when(F.col("failed") == 1, "failed")
        .otherwise("none")
    )
    return samples.join(g, "id", "left").select("id", state.alias("state"))


def source_counts(sources: DataFrame, segments: DataFrame, ranges: DataFrame, samples: DataFrame) -> DataFrame:
    """(source_id, lines, marked, samples): lines outside marked ranges, marked ranges, samples; 0 included."""
    from timelake.operators.intervals import outside_marked

    n = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    out = sources.select("source_id")
    for df, name in ((outside_marked(segments, ranges), "lines"), (ranges, "marked"), (samples, "samples")):
        out = out.join(n(df, name), "source_id", "left")
    return out.select("source_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("lines", "marked", "samples")))


def import_summary(plan: DataFrame) -> DataFrame:
    """(kind, n_<status>): how many lines of each class have each status."""
    statuses = ["new", "replace", "skip", "unchanged", "invalid"]
    return plan.groupBy("kind").agg(*(F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}") for s in statuses))


def phrase_cuts(blocks: DataFrame, pauses: DataFrame, phones: DataFrame | None = None, manual: DataFrame | None = None, merges: DataFrame | None = None, least: float = 0.28, slack: float = 0.05) -> DataFrame:
    """(sample_id, k, kind, left_end, right_start, merged, error): where a sentence is cut before block k.

    A pause of `least` seconds cuts before the first block that begins after its end, if the block before ends by its start
    (both within `slack`) and no voiced phone (sample_id, label, start, end) holds its middle; of several pauses before one
    block the last counts. merges (sample_id, k) mark such cuts as merged. Cuts by hand (sample_id, k) replace them: they run
    from the end of the block before to the leading consonants of block k; k outside the sentence is an error.
    """
    w = Window.partitionBy("sample_id").orderBy("k")
    b = blocks.select("sample_id", "k", "onset", "end", "lead").withColumns({"_before": F.lag("end").over(w), "_n": F.count("*").over(Window.partitionBy("sample_id"))})
    p = pauses.where(F.col("end") - F.col("start") >= least - 1e-9).select("sample_id", F.col("start").alias("p0"), F.col("end").alias("p1"))
    p = p.withColumn("middle", (F.col("p0") + F.col("p1")) / 2)
    if phones is not None:
        v = phones.where(~F.col("label").isin(*SILENT)).select(F.col("sample_id").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
        p = p.join(v, (p["sample_id"] == v["_s"]) & (v["_a"] < p["middle"] - 1e-9) & (p["middle"] < v["_b"] - 1e-9), "left_anti")
    hit = b.join(p, "sample_id").where((F.col("_before") <= F.col("p0") + slack + 1e-9) & (F.col("onset") >= F.col("p1") - slack - 1e-9))
    first = hit.groupBy("sample_id", "p0", "p1").agg(F.min("k").alias("k"), F.first("middle").alias("middle"))
    at = F.round(F.max_by("middle", F.struct("p0", "p1")), 6)
    auto = first.groupBy("sample_id", "k").agg(at.alias("left_end")).withColumns({"kind": F.lit("auto"), "right_start": F.col("left_end")})
    marks = merges.select("sample_id", "k", F.lit(True).alias("merged")).distinct() if merges is not None else None
    auto = auto.join(marks, ["sample_id", "k"], "left") if marks is not None else auto.withColumn("merged", F.lit(False))
    names = ["sample_id", "k", "kind", "left_end", "right_start", F.coalesce("merged", F.lit(False)).alias("merged")]
    auto = auto.select(*names, F.lit(None).cast("string").alias("error"))
    if manual is None:
        return auto
    asked = manual.select("sample_id", "k").distinct()
    own = asked.join(b, ["sample_id", "k"], "left")
    bad = F.col("_before").isNull()
    hand = own.select("sample_id", "k", F.lit("manual").alias("kind"), F.col("_before").alias("left_end"), F.when(~bad, F.coalesce("lead", "onset")).alias("right_start"), F.lit(False).alias("merged"), F.when(bad, "rhythm-cut-invalid").alias("error"))
    return auto.join(asked, ["sample_id", "k"], "left_anti").unionByName(hand)


def phrases(blocks: DataFrame, cuts: DataFrame) -> DataFrame:
    """Blocks with phrase: the number of cuts up to them; samples without a cut have none."""
    live = cuts.where("not merged and error is null").select("sample_id", "k", F.lit(1).alias("_c"))
    c = blocks.select("sample_id", "k").join(live, ["sample_id", "k"], "left")
    return c.withColumn("phrase", F.sum(F.coalesce("_c", F.lit(0))).over(Window.partitionBy("sample_id").orderBy("k"))).drop("_c")


def control_points(plan: DataFrame) -> DataFrame:
    """Control points (sample_id, k, at, target) and whether they rise: source and target time of each block's onset."""
    w = Window.partitionBy("sample_id").orderBy("k")
    rising = (F.col("at") > F.lag("at").over(w)) & (F.col("target") > F.lag("target").over(w))
    return plan.withColumn("rising", F.coalesce(rising, F.lit(True)))


def bridge_targets(bridges: DataFrame, reserve: float = 0.02) -> DataFrame:
    """Bridges (id, speech, pause, length, ratio) with the target lengths of speech and pauses: pauses stretch first, 2 % stays theirs."""
    r = F.least("pause", F.col("length") * reserve)
    speech = F.when(F.col("pause") <= 0, F.col("length")).otherwise(F.least(F.col("speech") * F.col("ratio"), F.col("length") - r))
    return bridges.withColumn("speech_to", speech).withColumn("pause_to", F.col("length") - speech)


def least_fast_density(plans: DataFrame, bpm: float) -> DataFrame:
    """(id, k0): the least power of two of the density at which the beats fit the time: ceil(log2(cells * 60/bpm / seconds)), within 40."""
    raw = F.ceil(F.log2(F.col("cells") * (60.0 / bpm) / F.col("seconds")))
    return plans.select("id", F.greatest(F.lit(-40), F.least(F.lit(40), raw)).cast("int").alias("k0"))


def plan_samples(segments: DataFrame, tracks: DataFrame, ranges: DataFrame, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """(id, status, start, end, judge_start, judge_end) of samples to make from segments (id, source_id, start, end, text).

    tracks: source_id, cover_start, cover_end. Status: no-track, no-name, oped, out-of-track or pending; pending ones have
    the padded selection inside the track and the part of the segment in it.
    """
    marked = overlap_join(segments.select("id", "source_id", "start", "end"), ranges.select("source_id", "start", "end")).select("id").distinct().withColumn("_o", F.lit(True))
    j = segments.join(tracks, "source_id", "left").join(marked, "id", "left")
    a = F.greatest(F.col("start") - before, F.col("cover_start"), F.lit(0.0))
    b = F.least(F.col("end") + after, F.col("cover_end"))
    inside = (F.col("start") < F.col("cover_end") - 1e-9) & (F.col("end") > F.col("cover_start") + 1e-9)
    status = F.when(F.col("cover_start").isNull(), "no-track").when(F.trim(F.coalesce("text", F.lit(""))) == "", "no-name").when(F.col("_o"), "oped").when(~inside, "out-of-track").otherwise("pending")
    ok = status == "pending"
    return j.select("id", status.alias("status"), F.when(ok, a).alias("start"), F.when(ok, b).alias("end"), F.when(ok, F.greatest("start", a)).alias("judge_start"), F.when(ok, F.least("end", b)).alias("judge_end"))


def clear_plan(segments: DataFrame, force: bool = False) -> DataFrame:
    """(id, action): imported segments go; protected ones stay unless forced."""
    return segments.where("imported").select("id", F.when(F.col("protected") & F.lit(not force), "keep").otherwise("delete").alias("action"))


def delete_preview(items: DataFrame, dependants: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, n_<name>...): how many rows of each dependent table refer to each item."""
    out = items.select(key)
    for name, df in dependants.items():
        out = out.join(df.groupBy(key).agg(F.count("*").alias(f"n_{name}")), key, "left")
    return out.select(key, *(F.coalesce(f"n_{n}", F.lit(0)).alias(f"n_{n}") for n in dependants))


def match_pictures(media: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, others): the picture of the same folder and stem: video, then animation, then image; the rest are listed as others."""
    rank = F.when(F.col("kind") == "video", 0).when(F.col("kind") == "animation", 1).otherwise(2)
    g = media.join(files, ["dir", "stem"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "path"))).alias("f"))
    return g.select("id", F.col("f")[0]["path"].alias("path"), (F.size("f") - 1).alias("others"))


def effective_range(phones: DataFrame, frames: DataFrame) -> DataFrame:
    """(phone_id, eff_start, eff_end): where a vowel or syllabic nasal sounds; null for other phones.

    phones: phone_id, label, start, end; frames: phone_id, k, energy of its whole 10 ms frames. Active frames lie above 0.0064
    of the 85th percentile and above 1e-10. The whole span stays with fewer than 4 frames or 3 active ones, or if less than
    30 ms would be left. An edge moves in only past 30 ms of quiet, and then keeps 10 ms of it.
    """
    limit = frames.groupBy("phone_id").agg(F.greatest(F.percentile("energy", 0.85) * 0.0064, F.lit(1e-10)).alias("_limit"), F.count("*").alias("_n"))
    active = frames.join(limit, "phone_id").where(F.col("energy") > F.col("_limit")).groupBy("phone_id").agg(F.min("k").alias("_i"), F.max("k").alias("_j"), F.count("*").alias("_a"))
    j = phones.join(limit.select("phone_id", "_n"), "phone_id", "left").join(active, "phone_id", "left")
    first, last = F.col("start") + F.col("_i") * 0.01, F.col("start") + (F.col("_j") + 1) * 0.01
    a = F.greatest("start", F.when(first - F.col("start") >= 0.03 - 1e-9, first - 0.01).otherwise(F.col("start")))
    b = F.least("end", F.when(F.col("end") - last >= 0.03 - 1e-9, last + 0.01).otherwise(F.col("end")))
    fit = F.coalesce((F.col("_n") >= 4) & (F.col("_a") >= 3) & (b - a >= 0.03 - 1e-9), F.lit(False))
    sounding = F.col("label").isin(*SOUNDING)
    return j.select("phone_id", F.when(sounding, F.when(fit, F.round(a, 6)).otherwise(F.col("start"))).alias("eff_start"), F.when(sounding, F.when(fit, F.round(b, 6)).otherwise(F.col("end"))).alias("eff_end"))


def sustain_end(blocks: DataFrame, pauses: DataFrame, frames: DataFrame) -> DataFrame:
    """(id, sustain): where a block's sound ends: its first inner pause or 5 ms after its last active frame, whichever is first; null if neither."""
    p = overlap_join(blocks.select("id", "source_id", "start", "end"), pauses.select("source_id", "start", "end")).where(F.col("r_start") > F.col("start")).groupBy("id").agg(F.min("r_start").alias("p"))
    f = frames.where("active").groupBy("id").agg((F.max("t") + 0.005).alias("f"))
    return blocks.select("id").join(p, "id", "left").join(f, "id", "left").select("id", F.least("p", "f").alias("sustain"))


def segment_state(segments: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, state) of segments (id, start, end, text, voiced) by their runs on a track: ok, stale, failed or none; null without voice.

    runs: segment_id, status, seg_start, seg_end, seg_text. A run that went well is usable while the segment is unchanged.
    """
    same = (F.col("seg_text") == F.col("text")) & (F.abs(F.col("seg_start") - F.col("start")) < 1e-6) & (F.abs(F.col("seg_end") - F.col("end")) < 1e-6)
    ok = F.col("status") == "ok"
    met = segments.join(runs.withColumnRenamed("segment_id", "id"), "id", "left")
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    g = met.groupBy("id").agg(F.first("voiced").alias("voiced"), flag(ok & same).alias("usable"), flag(ok).alias("ok"), F.count("status").alias("runs"))
    return g.select("id", F.when(~F.col("voiced"), None).when(F.col("usable"), "ok").when(F.col("ok"), "stale").when(F.col("runs") > 0, "failed").otherwise("none").alias("state"))


def analyzed_counts(samples: DataFrame, states: DataFrame) -> DataFrame:
    """(source_id, speech, analyzed): samples of speech, and those whose segments all have a usable run. samples: id, source_id, nature."""
    done = F.col("state").isin("ok", "manual", "partial")
    met = samples.where("nature = 'speech'").join(states, "id", "left")
    return met.groupBy("source_id").agg(F.count("*").alias("speech"), F.sum(F.coalesce(done, F.lit(False)).cast("long")).alias("analyzed"))


def unit_counts(segments: DataFrame, usable: DataFrame, runs: DataFrame, unreadable: tuple[str, ...]) -> DataFrame:
    """(source_id, speech, analyzed, unreadable) of segments (id, source_id, start, end, text).

    usable: segment_id; runs: segment_id, status, seg_start, seg_end, seg_text, reason, created_at. A segment is unreadable if its
    last run failed on its present text for one of the reasons.
    """
    last = runs.groupBy("segment_id").agg(F.max_by(F.struct("status", "seg_start", "seg_end", "seg_text", "reason"), "created_at").alias("r"))
    met = segments.join(usable.select(F.col("segment_id").alias("id"), F.lit(True).alias("usable")).distinct(), "id", "left").join(last.withColumnRenamed("segment_id", "id"), "id", "left")
    same = (F.col("r.seg_text") == F.col("text")) & (F.abs(F.col("r.seg_start") - F.col("start")) < 1e-6) & (F.abs(F.col("r.seg_end") - F.col("end")) < 1e-6)
    stuck = F.col("usable").isNull() & (F.col("r.status") == "failed") & same & F.col("r.reason").isin(*unreadable)
    return met.groupBy("source_id").agg(F.count("*").alias("speech"), F.count("usable").alias("analyzed"), F.sum(F.coalesce(stuck, F.lit(False)).cast("long")).alias("unreadable"))


def plan_analysis(requests: DataFrame, usable: DataFrame, rerun_fresh: bool = False) -> DataFrame:
    """(unit_id, action, reason, was_fresh): each unit once: run, fresh (its usable run has the same inputs) or blocked.

    requests: unit_id, segment_deleted, track, covered, fingerprint; usable: unit_id, fingerprint. The first reason counts.
    """
    once = requests.groupBy("unit_id").agg(*(F.min_by(c, F.struct(*(F.col(x).isNull() for x in ("track", "fingerprint")), "track", "fingerprint")).alias(c) for c in ("segment_deleted", "track", "covered", "fingerprint")))
    met = once.join(usable.select("unit_id", F.col("fingerprint").alias("_f")), "unit_id", "left")
    reason = F.when(F.col("segment_deleted"), "segment-deleted").when(F.col("track").isNull(), "no-track").when(~F.col("covered"), "not-covered")
    fresh = F.col("fingerprint").eqNullSafe(F.col("_f")) & F.col("_f").isNotNull()
    action = F.when(reason.isNotNull(), "blocked").when(fresh & F.lit(not rerun_fresh), "fresh").otherwise("run")
    return met.select("unit_id", action.alias("action"), reason.alias("reason"), (reason.isNull() & fresh).alias("was_fresh"))
