"""Plans of samples to make, whatever they come from: selections, stems, whole tracks and text segments under one token.

assets: id, source_id, duration, frame (seconds of one), mapping, roles (array), origin, stream, model, stem; sources: id, work,
episode, path, default_stream. An item is a row of ITEM; what cannot be planned has an error and no times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelake.functions.clocks import check_range, to_local, to_source
from timelake.functions.digests import multiset_digest
from timelake.functions.naming import NAME_MAX, suggest_name
from timelake.functions.text import nfc
from timelake.operators.intervals import overlap_join
from timelake.operators.planning import nature_for_roles, plan_samples

ITEM = ["key", "kind", "asset_id", "start", "end", "judge_start", "judge_end", "name", "nature", "via", "status", "error"]


def file_stem(path: Column) -> Column:
    """The file's name without its extension; a leading dot is no extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def source_name(work: Column, episode: Column, path: Column) -> Column:
    """Work and episode, the one of them that is there, or the file's name."""
    w, e = F.coalesce(work, F.lit("")), F.coalesce(episode, F.lit(""))
    return F.when((w != "") & (e != ""), F.concat(w, F.lit(" "), e)).when(w != "", w).when(e != "", e).otherwise(file_stem(path))


def _item(df: DataFrame, kind: str, **columns) -> DataFrame:
    none = F.lit(None)
    kinds = {"key": "string", "asset_id": "string", "start": "double", "end": "double", "judge_start": "double", "judge_end": "double", "name": "string", "nature": "string", "via": "string", "status": "string", "error": "string"}
    return df.select(*(F.lit(kind).alias(c) if c == "kind" else columns.get(c, none).cast(kinds[c]).alias(c) for c in ITEM))


def _judge(mapping: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """The part of the source that an item is judged by, to a millionth."""
    return F.round(to_source(mapping, a), 6), F.round(to_source(mapping, b), 6)


def _assets(assets: DataFrame) -> DataFrame:
    return assets.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "source_id", "duration", "frame", "mapping", "roles", "origin", "stream", "model", "stem")))


def plan_selections(asked: DataFrame, assets: DataFrame, sources: DataFrame, texts: DataFrame) -> DataFrame:
    """Items for selections (key, asset_id, start, end, via) of assets: ends a frame off snap to the asset, the judge range is the
    selection, and the name is that of the texts (source_id, start, end, text) under it, else of the source with its times."""
    j = asked.join(_assets(assets), F.col("asset_id") == F.col("a_id"), "left").join(sources.select(F.col("id").alias("s_id"), source_name(F.col("work"), F.col("episode"), F.col("path")).alias("s_name")), F.col("a_source_id") == F.col("s_id"), "left")
    j = j.withColumn("r", check_range(F.col("start"), F.col("end"), F.col("a_duration"), F.col("a_frame")))
    error = F.when(F.col("a_id").isNull(), "asset-not-found").when(~F.col("via").isin("manual", "hit"), "sample-plan-invalid").otherwise(F.col("r.error"))
    a, b = to_source(F.col("a_mapping"), F.col("r.start")), to_source(F.col("a_mapping"), F.col("r.end"))
    j = j.withColumns({"_error": error, "_a": a, "_b": b})
    span = j.where("_error is null and _a is not null").select("key", F.col("a_source_id").alias("source_id"), F.col("_a").alias("start"), F.col("_b").alias("end"))
    under = overlap_join(span, texts.select("source_id", "start", "end", "text"), eps=1e-9)
    lines = under.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("r_start", "r_end", F.regexp_replace("r_text", "\n", " ").alias("t")))).alias("t"))
    j = j.join(lines.select("key", F.transform("t", lambda x: x["t"]).alias("_lines")), "key", "left")
    none = F.lit(None).cast("string")
    mapped = F.col("_a").isNotNull()
    name = suggest_name(none, none, F.col("_lines"), F.col("s_name"), F.coalesce(F.col("_a"), F.col("r.start")), F.coalesce(F.col("_b"), F.col("r.end")), mapped, F.lit("local "))
    ok = F.col("_error").isNull()
    judge = _judge(F.col("a_mapping"), F.col("r.start"), F.col("r.end"))
    when = lambda c: F.when(ok, c)
    return _item(j, "selection", key=F.col("key"), asset_id=F.col("asset_id"), start=when(F.col("r.start")), end=when(F.col("r.end")), judge_start=when(judge[0]), judge_end=when(judge[1]), name=when(F.substring(name, 1, NAME_MAX)), nature=when(nature_for_roles(F.col("a_roles"))), via=F.col("via"), status=when(F.lit("pending")), error=F.col("_error"))


def plan_stems(asked: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Items for whole separated stems (key, asset_id): named by their source, model and stem."""
    j = asked.join(_assets(assets), F.col("asset_id") == F.col("a_id"), "left").join(sources.select(F.col("id").alias("s_id"), source_name(F.col("work"), F.col("episode"), F.col("path")).alias("s_name")), F.col("a_source_id") == F.col("s_id"), "left")
    parts = F.filter(F.array("s_name", "a_model", "a_stem"), lambda x: F.coalesce(x, F.lit("")) != "")
    return _whole_items(j, "stem", F.array_join(parts, " · "), F.when(F.col("a_id").isNull(), "asset-not-found"))


def plan_whole_tracks(asked: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Items for the default audio stream of each source (source_id), once a source, named by the file."""
    once = asked.select("source_id").distinct()
    j = once.join(sources.select(F.col("id").alias("s_id"), "path", "default_stream"), F.col("source_id") == F.col("s_id"), "left")
    track = _assets(assets).where("a_origin = 'stream'")
    j = j.join(track, (F.col("s_id") == F.col("a_source_id")) & (F.col("default_stream") == F.col("a_stream")), "left")
    error = F.when(F.col("s_id").isNull(), "source-not-found").when(F.col("a_id").isNull(), "source-no-audio")
    return _whole_items(j.withColumns({"key": F.col("source_id"), "asset_id": F.col("a_id")}), "whole", nfc(file_stem(F.col("path"))), error)


def _whole_items(j: DataFrame, kind: str, name: Column, error: Column) -> DataFrame:
    ok = error.isNull()
    when = lambda c: F.when(ok, c)
    judge = _judge(F.col("a_mapping"), F.lit(0.0), F.col("a_duration"))
    return _item(j, kind, key=F.col("key"), asset_id=F.col("asset_id"), start=when(F.lit(0.0)), end=when(F.col("a_duration")), judge_start=when(judge[0]), judge_end=when(judge[1]), name=when(F.substring(name, 1, NAME_MAX)), nature=when(nature_for_roles(F.col("a_roles"))), via=F.lit("manual"), status=when(F.lit("pending")), error=error)


def plan_segments(segments: DataFrame, assets: DataFrame, marked: DataFrame, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """Items for text segments (id, source_id, asset_id, start, end, text) on their track, by the rules of `plan_samples`."""
    track = _assets(assets)
    j = segments.join(track, F.col("asset_id") == F.col("a_id"), "left")
    cover = j.where("a_id is not null").groupBy("source_id").agg(F.first(F.element_at("a_mapping", 1)["source"]).alias("cover_start"), F.first(F.element_at("a_mapping", -1)["source"]).alias("cover_end"))
    plan = plan_samples(segments.select("id", "source_id", "start", "end", "text"), cover, marked, before, after)
    met = plan.select(F.col("id").alias("p_id"), "status", F.col("start").alias("p0"), F.col("end").alias("p1"), F.col("judge_start").alias("j0"), F.col("judge_end").alias("j1")).join(j.withColumnsRenamed({"start": "s0", "end": "s1"}), F.col("p_id") == F.col("id"))
    local = lambda t: to_local(F.col("a_mapping"), t)
    return _item(met, "segment", key=F.col("id"), asset_id=F.col("asset_id"), start=local(F.col("p0")), end=local(F.col("p1")), judge_start=F.col("j0"), judge_end=F.col("j1"), name=F.regexp_replace(F.trim("text"), "\n", " "), nature=F.lit("speech"), via=F.lit("segment"), status=F.col("status"))


def united(*plans: DataFrame) -> DataFrame:
    """The items of several plans as one."""
    return reduce(DataFrame.unionByName, plans)


def token(plan: DataFrame) -> DataFrame:
    """One row: the digest of a plan; any other item, name, time or error gives another one."""
    return multiset_digest(plan, *ITEM).withColumnRenamed("digest", "token")


def create(plan: DataFrame, seen: str, keys: DataFrame | None = None) -> DataFrame:
    """(error, ITEM): the chosen pending items (keys: key) of the plan as it is now, if it still has the token that was seen.

    All or nothing: one row with sample-plan-stale if the plan has changed, one with sample-plan-invalid if a chosen item has an
    error, is not pending or is unknown.
    """
    chosen = plan if keys is None else plan.join(keys.select("key").distinct(), "key", "left_semi")
    unknown = plan.where(F.lit(False)).select("key") if keys is None else keys.select("key").distinct().join(plan.select("key"), "key", "left_anti")
    bad = chosen.where(F.col("error").isNotNull() | ~F.col("status").eqNullSafe(F.lit("pending"))).select("key").unionByName(unknown).agg((F.count("*") > 0).alias("bad"))
    verdict = token(plan).join(bad, F.lit(True)).select(F.when(F.col("token") != seen, "sample-plan-stale").when(F.col("bad"), "sample-plan-invalid").alias("_verdict"))
    refused = verdict.where("_verdict is not null").select(F.col("_verdict").alias("error"))
    made = chosen.drop("error").join(F.broadcast(verdict), F.lit(True)).where("_verdict is null").drop("_verdict")
    return made.withColumn("error", F.lit(None).cast("string")).unionByName(refused, allowMissingColumns=True).select("error", *[c for c in ITEM if c != "error"])
