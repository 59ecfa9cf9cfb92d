"""Versioned batch edits over a table of objects (id, version, fields): preview, apply, replay, undo, reimport plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions.digests import multiset_digest
from timelake.functions.text import classify_cue
from timelake.operators.intervals import overlap_join


def preview_edits(batch: DataFrame, current: DataFrame) -> DataFrame:
    """(idx, id, op, error, changed): batch (idx, id, op, version, fields) against current (id, version, fields).

    Errors: duplicate (an id twice), exists, not-found, conflict (another version). changed holds the fields that differ;
    an update that changes nothing is a no-op.
    """
    twice = F.count("*").over(Window.partitionBy("id")) > 1
    now = current.select("id", F.col("version").alias("_v"), F.col("fields").alias("_f"))
    j = batch.withColumn("_twice", twice).join(now, "id", "left")
    there = F.col("_v").isNotNull()
    error = F.when(F.col("_twice"), "duplicate").when((F.col("op") == "create") & there, "exists").when((F.col("op") != "create") & ~there, "not-found").when((F.col("op") != "create") & (F.col("_v") != F.col("version")), "conflict")
    changed = F.map_filter("fields", lambda k, v: F.col("_f").isNull() | ~F.element_at("_f", k).eqNullSafe(v))
    return j.select("idx", "id", "op", error.alias("error"), changed.alias("changed"), F.col("_v").alias("version"), F.col("_f").alias("before"))


def apply_edits(batch: DataFrame, current: DataFrame, edit_id: int, seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """(new state, changes): all or nothing: with any error the state stays and there are no changes.

    Deletes set the field deleted. Every changed object goes up by one version.
    """
    p = preview_edits(batch, current)
    errors = p.where("error is not null").agg(F.count("*").alias("_errors"))
    p = p.join(F.broadcast(errors), F.lit(True)).where("_errors = 0").drop("_errors")  # one row
    fields = F.when(F.col("op") == "delete", F.create_map(F.lit("deleted"), F.lit("1"))).otherwise(F.col("changed"))
    p = p.withColumn("after", fields).where(F.size("after") > 0)
    old = F.coalesce("before", F.create_map().cast("map<string,string>"))
    before = F.map_filter(old, lambda k, v: F.map_contains_key("after", k))
    changes = p.select(F.lit(edit_id).alias("edit_id"), (F.col("idx") + seq).alias("seq"), "id", "op", before.alias("before"), "after", F.coalesce("version", F.lit(0)).alias("version_before"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key("after", k)), F.col("after"))
    new = p.select("id", (F.coalesce("version", F.lit(0)) + 1).alias("version"), merged.alias("fields"))
    return current.join(new.select("id"), "id", "left_anti").unionByName(new), changes


def replay(changes: DataFrame) -> DataFrame:
    """(id, field, value): the state that a change log (seq, id, after) leads to: the newest value of each field."""
    rows = changes.select("id", "seq", F.explode("after").alias("field", "value"))
    return rows.groupBy("id", "field").agg(F.max_by("value", "seq").alias("value"))


def undoable(changes: DataFrame, barrier: int = -1) -> DataFrame:
    """(edit_id, undoable): whether every field that an edit changed still has its value, and the edit follows the barrier."""
    now = replay(changes).select("id", "field", F.col("value").alias("now"))
    rows = changes.select("edit_id", "seq", "id", F.explode("after").alias("field", "value"))
    rows = rows.withColumn("_last", F.row_number().over(Window.partitionBy("edit_id", "id", "field").orderBy(F.desc("seq"))) == 1)
    held = rows.where("_last").join(now, ["id", "field"]).groupBy("edit_id").agg(F.min(F.col("value").eqNullSafe(F.col("now"))).alias("_held"), F.min("seq").alias("_first"))
    return held.select("edit_id", (F.col("_held") & (F.col("_first") > barrier)).alias("undoable"))


def undo(changes: DataFrame, edit_id: int) -> DataFrame:
    """(id, op, fields): the batch that takes an edit back; an undone create becomes a soft delete."""
    c = changes.where(F.col("edit_id") == edit_id)
    first = c.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("seq"))).where("_r = 1")
    fields = F.when(F.col("op") == "create", F.create_map(F.lit("deleted"), F.lit("1"))).when(F.col("op") == "delete", F.create_map(F.lit("deleted"), F.lit("0"))).otherwise(F.col("before"))
    return first.select("id", F.when(F.col("op") == "create", "delete").otherwise("update").alias("op"), fields.alias("fields"))


def plan_reimport(rows: DataFrame, existing: DataFrame, mode: str = "replace", force: bool = False, longest: float = 120.0) -> DataFrame:
    """(idx, status, reason) of each new line (idx, source_id, start, end, text, duration) against existing ones (id, ..., protected).

    Lines that equal an existing one to 0.5 ms and in text are unchanged, one for one in order. The rest: new without
    overlap, skip when a protected line overlaps (or any, in mode keep), else replace; invalid ones name what is wrong.
    """
    s, e = F.col("start"), F.col("end")
    bad = F.when(s < 0, "negative-start").when(e <= s, "empty").when(e > F.col("duration") + 1e-6, "beyond-end").when(e - s > longest, "too-long").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no-text")
    r = rows.withColumn("_bad", bad)
    ms = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    key = [F.col("source_id"), ms(s).alias("_a"), ms(e).alias("_b"), F.col("text")]
    nth = lambda order: F.row_number().over(Window.partitionBy("source_id", "_a", "_b", "text").orderBy(order)).alias("_n")
    new = r.where("_bad is null").select("idx", *key).select("*", nth("idx"))
    old = existing.select("id", *key).select("*", nth("id"))
    same = new.join(old, ["source_id", "_a", "_b", "text", "_n"]).select("idx", "id")
    open_new = r.where("_bad is null").join(same, "idx", "left_anti").select(F.col("idx").alias("id"), "source_id", "start", "end")
    open_old = existing.join(same.select("id"), "id", "left_anti").select("id", "source_id", "start", "end", "protected")
    hit = overlap_join(open_new, open_old).groupBy("id").agg(F.max("r_protected").alias("p")).withColumnRenamed("id", "idx")
    j = r.join(same.select("idx", F.lit(True).alias("_same")), "idx", "left").join(hit, "idx", "left")
    status = F.when(F.col("_bad").isNotNull(), "invalid").when(F.col("_same"), "unchanged").when(F.col("p").isNull(), "new")
    reason = F.col("_bad")
    if not force:
        status = status.when(F.col("p"), "skip")
        reason = F.when(F.col("_bad").isNotNull(), F.col("_bad")).when(F.col("_same").isNull() & F.col("p"), "protected")
        if mode == "keep":
            status = status.when(F.lit(True), "skip")
            reason = reason.when(F.col("_same").isNull() & F.col("p").isNotNull(), "keep")
    return j.select("idx", status.otherwise("replace").alias("status"), reason.alias("reason"))


def split_segments(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Two rows (id, part, start, end) for each segment that a cut (id, at) lies inside of."""
    j = segments.join(cuts, "id").where((F.col("at") > F.col("start")) & (F.col("at") < F.col("end")))
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("start").alias("a"), F.col("at").alias("b")), F.struct(F.lit(1).alias("part"), F.col("at").alias("a"), F.col("end").alias("b")))
    return j.select("id", F.explode(parts).alias("p")).select("id", "p.part", F.col("p.a").alias("start"), F.col("p.b").alias("end"))


def merge_segments(segments: DataFrame, by: str) -> DataFrame:
    """One row a group: its span, its texts in order, and its speakers once each in order."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "end", "id", "text", "speakers")))
    g = segments.groupBy(by).agg(F.min("start").alias("start"), F.max("end").alias("end"), ordered.alias("_rows"))
    return g.select(by, "start", "end", F.array_join(F.transform("_rows", lambda r: r["text"]), " ").alias("text"), F.array_distinct(F.flatten(F.transform("_rows", lambda r: r["speakers"]))).alias("speakers"))


def plan_token(plan: DataFrame, *columns: str) -> DataFrame:
    """One row: a digest of a plan, the same for the same rows in any order and another one for any other rows."""
    return multiset_digest(plan, *columns).withColumnRenamed("digest", "token")


def plan_speakers(segments: DataFrame) -> DataFrame:
    """(id, version, speakers, withheld): segments whose speakers follow anew from their raw text and differ from what they have.

    segments: id, version, origin, speaker_edited, protected, deleted, raw, speakers, withheld. Only subtitle lines that are neither
    protected nor edited by hand, and whose raw text is known, are looked at; texts that are no speech have no speakers.
    """
    open_ = segments.where("origin = 'subtitle' and not speaker_edited and not protected and not deleted and raw is not null").withColumn("_c", classify_cue(F.col("raw")))
    speech = F.col("_c.kind") == "line"
    names = F.when(speech, F.col("_c.speakers")).otherwise(F.array().cast("array<string>"))
    held = speech & F.col("_c.withheld")
    changed = ~names.eqNullSafe(F.coalesce("speakers", F.array().cast("array<string>"))) | (held != F.coalesce("withheld", F.lit(False)))
    return open_.where(changed).select("id", "version", names.alias("speakers"), held.alias("withheld"))
