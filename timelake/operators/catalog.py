"""Inventories, matches by name, signatures, states and reports over catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.digests import multiset_digest


def inventory_diff(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, state): each current file (path, size, sig) against the known ones: known, moved or new; known files that are gone: missing.

    A file has moved when an unseen path has the size and signature of exactly the first known path that is gone.
    """
    same = files.join(known.select("path"), "path", "left_semi").select("path", F.lit("known").alias("state"))
    fresh = files.join(known.select("path"), "path", "left_anti")
    gone = known.join(files.select("path"), "path", "left_anti")
    from_ = gone.groupBy("size", "sig").agg(F.min("path").alias("old"))
    told = fresh.join(from_, ["size", "sig"], "left")
    first = F.row_number().over(Window.partitionBy("size", "sig").orderBy("path")) == 1
    told = told.withColumn("_moved", F.col("old").isNotNull() & first)
    used = told.where("_moved").select(F.col("old").alias("path"))
    return same.union(told.select("path", F.when(F.col("_moved"), "moved").otherwise("new"))).union(gone.join(used, "path", "left_anti").select("path", F.lit("missing")))


def match_sidecars(media: DataFrame, files: DataFrame, tag_rank: dict[str, int], kind_rank: dict[str, int]) -> DataFrame:
    """(id, path): the best side file (dir, stem, tag, ext, path) of each medium (id, dir, stem): untagged first, then by tag, then by kind."""
    rank = lambda col, table: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), col), F.lit(99))
    pairs = media.join(files, ["dir", "stem"])
    order = F.struct((F.col("tag") != "").cast("int"), rank(F.col("tag"), tag_rank), rank(F.col("ext"), kind_rank), "path")
    return pairs.groupBy("id").agg(F.min_by("path", order).alias("path"))


def relocate(sources: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, state): sources (id, rel, name) among files (rel, name, path): by relative path, else by a unique name."""
    by_rel = files.groupBy("rel").agg(F.min("path").alias("p1"))
    by_name = files.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("p2"))
    j = sources.join(by_rel, "rel", "left").join(by_name, "name", "left")
    state = F.when(F.col("p1").isNotNull(), "found").when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return j.select("id", F.when(F.col("p1").isNotNull(), F.col("p1")).when(F.col("n") == 1, F.col("p2")).alias("path"), state.alias("state"))


def rewrite_prefix(path: Column, old: str, new: str) -> Column:
    return F.when(path.startswith(old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def fingerprint(content: Column) -> Column:
    """SHA-256 of a text without a byte-order mark, with line breaks as \\n."""
    return F.sha2(F.regexp_replace(F.regexp_replace(content, "^﻿", ""), "\r\n?", "\n").cast("binary"), 256)


def checked_texts(files: DataFrame) -> DataFrame:
    """(path, text, fingerprint, error) of files (path, content as bytes): UTF-8 without a byte-order mark, line breaks as \\n.

    A file that is no valid UTF-8 has the error subtitle-encoding and no text.
    """
    ok = F.is_valid_utf8(F.col("content"))
    plain = F.regexp_replace(F.regexp_replace(F.when(ok, F.col("content").cast("string")), "^\ufeff", ""), "\r\n?", "\n")
    return files.select("path", plain.alias("text"), F.sha2(plain.cast("binary"), 256).alias("fingerprint"), F.when(~ok, "subtitle-encoding").alias("error"))


def signature_keys(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, signature): a digest of a group's ordered rows, which changes only with the given columns."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns))
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n").cast("binary"), 256).alias("signature"))


def content_signature(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, signature): a digest of a group's rows that changes exactly when the given columns of some row do, nulls included.

    Unlike `signature_keys` no value can be taken for another one, and no group meets in one array.
    """
    return multiset_digest(rows, *columns, by=(key,)).withColumnRenamed("digest", "signature")


def index_status(keys: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """(key, state): ready when the index has the current signature, stale when another, missing when none."""
    i = index.select(key, F.col("signature").alias("have"))
    return keys.join(i, key, "left").select(key, F.when(F.col("have").isNull(), "missing").when(F.col("have") == F.col("signature"), "ready").otherwise("stale").alias("state"))


def metric_status(ids: DataFrame, metrics: DataFrame, names: list[str], key: str = "id") -> DataFrame:
    """(metric, total, ready, stale, missing) of a scope of ids: how many have a valid row of metrics, and how many lack each one.

    metrics: key, valid, values (map). A row that is not valid counts for nothing; an unknown value is missing.
    """
    own = ids.select(key).distinct().join(metrics.where("valid").select(key, F.col("values").alias("_v")), key, "left")
    lacks = lambda n: F.sum(F.try_element_at(F.coalesce("_v", F.create_map().cast("map<string,double>")), F.lit(n)).isNull().cast("long"))
    counted = own.agg(F.count("*").alias("total"), F.count("_v").alias("ready"), *(F.coalesce(lacks(n), F.lit(0)).alias(f"m{i}") for i, n in enumerate(names)))
    each = F.array(*(F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("missing")) for i, n in enumerate(names)))
    return counted.select("total", "ready", F.inline(each)).select("metric", "total", "ready", (F.col("total") - F.col("ready")).alias("stale"), "missing")


def adopt(rows: DataFrame, keys: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """The index after taking the computed rows whose signature is still current; other entries stay."""
    current = rows.join(keys, [key, "signature"], "left_semi")
    return index.join(current.select(key), key, "left_anti").unionByName(current)


def storage_report(files: DataFrame, now: Column, recent: float) -> DataFrame:
    """(category, files, bytes, cleanable): cleanable bytes are those not touched for `recent` seconds."""
    old = now - F.col("touched") >= recent
    return files.groupBy("category").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum(F.when(old, F.col("bytes")).otherwise(0)).alias("cleanable"))


def job_stats(items: DataFrame) -> DataFrame:
    """(job_id, total, ok, failed) from items (job_id, status)."""
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return items.groupBy("job_id").agg(F.count("*").alias("total"), count("ok").alias("ok"), count("failed").alias("failed"))


def queue_ahead(jobs: DataFrame) -> DataFrame:
    """(job_id, ahead): queued jobs of the channel before each: promoted ones (last first), then foreground, then by age."""
    w = Window.partitionBy("channel").orderBy(F.col("promoted").isNull(), F.desc("promoted"), "background", "created_at", "job_id")
    return jobs.select("job_id", (F.row_number().over(w) - 1).alias("ahead"))


def usable_runs(segments: DataFrame, runs: DataFrame, heads: DataFrame) -> DataFrame:
    """(segment_id, run_id): the run to use: status ok and the segment unchanged; the head, then manual ones, then the newest."""
    same = (F.abs(F.col("seg_start") - F.col("start")) <= 1e-6) & (F.abs(F.col("seg_end") - F.col("end")) <= 1e-6) & (F.col("seg_text") == F.col("text"))
    r = runs.where("status = 'ok'").join(segments.select(F.col("id").alias("segment_id"), "start", "end", "text"), "segment_id").where(same)
    r = r.join(heads.select("segment_id", F.col("run_id").alias("_head")), "segment_id", "left")
    w = Window.partitionBy("segment_id").orderBy(F.desc(F.coalesce(F.col("run_id") == F.col("_head"), F.lit(False))), F.desc("manual"), F.desc("created_at"), F.desc("run_id"))
    return r.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("segment_id", "run_id")


def plan_exports(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """(key, state): requests (prefix, label, params) by a stable key: reuse when the manifest has it unchanged, modified or new."""
    key = F.sha2(F.to_json(F.struct("prefix", "label", "params")).cast("binary"), 256)
    r = requests.withColumn("key", key)
    m = manifest.select("key", F.col("size").alias("_s"), F.col("now_size").alias("_n"))
    return r.join(m, "key", "left").select("key", F.when(F.col("_s").isNull(), "new").when(F.col("_s") == F.col("_n"), "reuse").otherwise("modified").alias("state"))
