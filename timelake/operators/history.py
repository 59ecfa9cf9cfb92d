"""The history of edits and what of it can be taken back.

edits: edit_id, seq, label, actor, session, undo_of (the edit that it takes back, or null); changes: edit_id, idx, id, op
(create, update or delete), before and after (maps of fields); current: id, version, fields (null fields: the object is gone).
An edit labelled `barrier` ends what can be undone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelake.sources.shared import saved, spread

BARRIER = "barrier"
#: Actors whose sessions can be taken back as a whole.
AUTOMATIC = ("agent", "script")
DELETED = "deleted"


def _values(changes: DataFrame) -> DataFrame:
    """(edit_id, idx, id, op, field, after, before): one row a changed field."""
    return changes.select("edit_id", "idx", "id", "op", F.explode("after").alias("field", "after"), "before").withColumn("before", F.try_element_at("before", F.col("field")))


def _now(current: DataFrame) -> DataFrame:
    """(id, field, now) of all fields that objects have."""
    return current.where("fields is not null").select("id", F.explode("fields").alias("field", "now"))


def still_after(changes: DataFrame, current: DataFrame) -> DataFrame:
    """(edit_id, held): whether every field that an edit changed has the value that it gave, on objects that are there."""
    there = current.where("fields is not null").select("id", F.lit(True).alias("there"))
    met = _values(changes).join(_now(current), ["id", "field"], "left").join(there, "id", "left")
    ok = F.coalesce(F.col("there"), F.lit(False)) & F.col("after").eqNullSafe(F.col("now"))
    return met.groupBy("edit_id").agg(F.min(ok).alias("held"))


def _last_barrier(edits: DataFrame) -> DataFrame:
    """One row: the seq of the last barrier, or -1."""
    return edits.where(F.col("label") == BARRIER).agg(F.coalesce(F.max("seq"), F.lit(-1)).cast("long").alias("_barrier"))


def history(edits: DataFrame, changes: DataFrame, current: DataFrame, actor: str | None = None, session: str | None = None) -> DataFrame:
    """(edit_id, seq, label, actor, session, undo_of, undone_by, changes, undoable, reason), of one actor or session if asked.

    reason names why an edit cannot be undone: is-undo, already-undone, before-barrier or changed-later.
    """
    undone = edits.where("undo_of is not null").groupBy(F.col("undo_of").alias("edit_id")).agg(F.min("edit_id").alias("undone_by"))
    sizes = changes.groupBy("edit_id").agg(F.count("*").alias("changes"))
    asked = edits if actor is None else edits.where(F.col("actor") == actor)
    asked = asked if session is None else asked.where(F.col("session") == session)
    # without a filter there is nothing to leave out, and all changes needn't meet all edits
    mine = changes if actor is None and session is None else changes.join(asked.select("edit_id"), "edit_id", "left_semi")
    held = still_after(mine, current)
    all_ = asked.join(undone, "edit_id", "left").join(sizes, "edit_id", "left").join(held, "edit_id", "left").join(F.broadcast(_last_barrier(edits)), F.lit(True))
    reason = F.when(F.col("undo_of").isNotNull(), "is-undo").when(F.col("undone_by").isNotNull(), "already-undone").when((F.col("label") == BARRIER) | (F.col("seq") <= F.col("_barrier")), "before-barrier").when(~F.coalesce("held", F.lit(True)), "changed-later")
    return all_.select("edit_id", "seq", "label", "actor", "session", "undo_of", "undone_by", F.coalesce("changes", F.lit(0)).cast("long").alias("changes"), reason.isNull().alias("undoable"), reason.alias("reason"))


def undo_plan(changes: DataFrame, current: DataFrame, chosen: DataFrame) -> DataFrame:
    """(edit_id, id, version, fields): the updates that take the chosen edits (edit_id) back, on the versions that objects have now.

    A create is taken back by a soft delete, all else by the values before.
    """
    mine = changes.join(chosen.select("edit_id"), "edit_id", "left_semi")
    fields = F.when(F.col("op") == "create", F.create_map(F.lit(DELETED), F.lit("1"))).otherwise(F.map_from_entries(F.transform(F.map_keys("after"), lambda k: F.struct(k, F.try_element_at("before", k)))))
    return mine.join(current.select("id", "version"), "id").select("edit_id", "idx", "id", "version", fields.alias("fields"))


def undo_latest(edits: DataFrame, changes: DataFrame, current: DataFrame) -> DataFrame:
    """The plan (see `undo_plan`) for the newest edit that can be undone, passing over those that cannot; no rows if there is none."""
    newest = history(edits, changes, current).where("undoable").agg(F.max_by("edit_id", "seq").alias("edit_id")).where("edit_id is not null")
    return undo_plan(changes, current, F.broadcast(newest))


def undo_one(edits: DataFrame, changes: DataFrame, current: DataFrame, edit_id) -> DataFrame:
    """(error, edit_id, idx, id, version, fields): the plan for one edit, or one row with why it cannot be undone."""
    known = history(edits, changes, current).where(F.col("edit_id") == edit_id).select("edit_id", "reason", "undoable")
    plan = undo_plan(changes, current, known.where("undoable"))
    unknown = edits.where(F.col("edit_id") == edit_id).agg(F.count("*").alias("n")).where("n = 0").select(F.lit("unknown").alias("error"))
    return plan.select(F.lit(None).cast("string").alias("error"), "*").unionByName(known.where("not undoable").select(F.col("reason").alias("error")).unionByName(unknown), allowMissingColumns=True)


def undo_session(edits: DataFrame, changes: DataFrame, current: DataFrame, session: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(undone edits, one row (undone, blocked, remaining), the objects' fields afterwards) of taking a session back.

    Its edits go from the newest to the oldest, until one is met that a later edit outside the session has touched: that one
    blocks, and it and all older ones remain. What an edit finds in a field is what the next newer edit of the session had found
    before it, or the present value; so all edits are judged at once, along the chain of each field.
    """
    undone = edits.where("undo_of is not null").select(F.col("undo_of").alias("edit_id"))
    mine = edits.where((F.col("session") == session) & F.col("actor").isin(*AUTOMATIC) & F.col("undo_of").isNull()).join(undone, "edit_id", "left_anti")
    mine = mine.join(F.broadcast(_last_barrier(edits)), F.col("seq") > F.col("_barrier")).select("edit_id", "seq")
    fields = spread(_values(changes).join(mine, "edit_id"), "id", "field")  # one shuffle for what follows on a field
    # one entry for each field of an edit; two values of one edit on a field never both hold
    per = fields.groupBy("edit_id", "seq", "id", "field").agg(F.min("after").alias("after"), F.min(F.struct("after")).eqNullSafe(F.max(F.struct("after"))).alias("one"), F.max_by(F.struct("before"), "idx").alias("b"), F.min_by("op", "idx").alias("op"))
    there = current.where("fields is not null").select("id", F.lit(True).alias("there"))
    met = per.join(_now(current), ["id", "field"], "left").join(there, "id", "left")
    later = Window.partitionBy("id", "field").orderBy("seq")
    newer = F.lead(F.struct("b.before")).over(later)
    found = F.when(newer.isNotNull(), newer["before"]).otherwise(F.col("now"))
    # an object that the session made is deleted when that is taken back, so nothing older of the session can stand on it
    met = met.withColumns({"found": found, "ok": F.col("one") & F.coalesce("there", F.lit(False)) & F.col("after").eqNullSafe(found)})
    judged = mine.join(met.groupBy("edit_id").agg(F.min("ok").alias("held")), "edit_id", "left").withColumn("held", F.coalesce("held", F.lit(True)))
    judged = saved(judged, "judged")  # one row an edit, read four times
    stop = judged.where("not held").agg(F.max("seq").alias("_stop"), F.max_by("edit_id", "seq").alias("blocked"))  # one row
    gone = judged.join(F.broadcast(stop), F.col("_stop").isNull() | (F.col("seq") > F.col("_stop"))).select("edit_id", "seq")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    summary = count(gone, "undone").join(stop.select("blocked"), F.lit(True)).join(count(judged, "all"), F.lit(True)).select("undone", "blocked", (F.col("all") - F.col("undone")).alias("remaining"))
    back = met.join(gone.select("edit_id"), "edit_id", "left_semi")
    value = F.min_by(F.struct("b.before"), "seq")["before"]
    plain = back.groupBy("id", "field").agg(value.alias("value"), F.min_by("op", "seq").alias("op")).where("op <> 'create'").select("id", "field", "value")
    made = back.where("op = 'create'").select("id", F.lit(DELETED).alias("field"), F.lit("1").alias("value")).distinct()
    return gone, summary, plain.unionByName(made)
