"""Structured Streaming forms: affected samples of changes, debounced sessions, job progress and islands of events."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelake.operators.catalog import index_status
from timelake.operators.frames import frame_coverage
from timelake.operators.intervals import overlap_join
from timelake.operators.planning import plan_analysis
from timelake.sources.shared import drop, hadoop_path, saved


def affected_samples(changes: DataFrame, samples: DataFrame) -> DataFrame:
    """(id) of samples that changed ranges (source_id, start, end) reach; works on a stream of changes as well."""
    ranges = changes.select("source_id", "start", "end")
    return overlap_join(ranges, samples.select("id", "source_id", "start", "end")).select(F.col("r_id").alias("id"))


def affected_ids(changes: DataFrame, samples: DataFrame) -> DataFrame:
    """(id), each once: samples that the new or the old extent of a changed range reaches, and samples that changed themselves.

    changes: source_id, start, end, and where it has them old_source_id, old_start, old_end (where a range was before) and
    sample_id (a sample that was made, moved or deleted, which need not be in `samples` any more).
    """
    found = [affected_samples(changes.where("start is not null"), samples)]
    if "old_start" in changes.columns:
        old = changes.where("old_start is not null").select(F.col("old_source_id").alias("source_id"), F.col("old_start").alias("start"), F.col("old_end").alias("end"))
        found.append(affected_samples(old, samples))
    if "sample_id" in changes.columns:
        found.append(changes.where("sample_id is not null").select(F.col("sample_id").alias("id")))
    return reduce(DataFrame.unionAll, found).distinct()


def refresh_stream(changes: DataFrame, samples: DataFrame | Callable[[], DataFrame], rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, key: str = "sample_id", compact_every: int = 0):
    """Start a query that rebuilds the rows of the affected samples (see `affected_ids`) for each batch of changes.

    Each batch is written below `path` by its number, so that a repeated batch overwrites itself: the new rows, and a marker
    (gone) for every affected sample, so that one which is left without rows loses those it had. `current` reads the newest
    state of each sample. `samples` may be a function that gives the table as it is now. Every `compact_every` batches the
    history is written as one table (see `compact`).
    """

    def batch(df: DataFrame, number: int) -> None:
        now = samples() if callable(samples) else samples
        df.persist()
        ids = affected_ids(df, now)
        rows = rebuild(now.join(ids, "id", "left_semi")).withColumn("gone", F.lit(False))
        marks = ids.select(F.col("id").cast(rows.schema[key].dataType).alias(key), F.lit(True).alias("gone"))
        rows.unionByName(marks, allowMissingColumns=True).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        df.unpersist()
        if compact_every and number % compact_every == compact_every - 1:
            compact(df.sparkSession, path, number, key)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """The rows of each sample's newest batch; samples that this batch left without rows have none."""
    last = rows.groupBy(key).agg(F.max("batch").alias("_last"))
    newest = rows.join(last, key).where(F.col("batch") == F.col("_last")).drop("_last")
    return newest.where(~F.coalesce("gone", F.lit(False))).drop("gone") if "gone" in rows.columns else newest


def _bases(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished compactions, smallest first."""
    fs, p = hadoop_path(spark, f"{path}/_base")
    if not fs.exists(p):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(p) if fs.exists(hadoop_path(spark, f"{path}/_base/{s.getPath().getName()}/_SUCCESS")[1])]
    return sorted(int(x.removeprefix("to=")) for x in done)


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, p = hadoop_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch="))


def refreshed(spark: SparkSession, path: str, key: str = "sample_id", upto: int | None = None) -> DataFrame:
    """The present rows of a refreshed table: its last compaction and the batches after it."""
    bases = [b for b in _bases(spark, path) if upto is None or b < upto]
    after = [n for n in _batches(spark, path) if (not bases or n > bases[-1]) and (upto is None or n <= upto)]
    parts = [spark.read.parquet(f"{path}/_base/to={bases[-1]}").withColumn("batch", F.lit(bases[-1]))] if bases else []
    parts += [spark.read.option("basePath", path).parquet(*(f"{path}/batch={n}" for n in after))] if after else []
    return current(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), key)


def compact(spark: SparkSession, path: str, upto: int, key: str = "sample_id") -> None:
    """Write the state after batch `upto` as one table, then delete what it replaces; a run that breaks off changes nothing."""
    refreshed(spark, path, key, upto).drop("batch").write.mode("overwrite").parquet(f"{path}/_base/to={upto}")
    for name in [f"batch={n}" for n in _batches(spark, path) if n < upto] + [f"_base/to={b}" for b in _bases(spark, path) if b < upto]:
        fs, p = hadoop_path(spark, f"{path}/{name}")
        fs.delete(p, True)


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n): bursts of events with spaces below `gap`; rows later than `late` are dropped."""
    w = F.session_window(F.col(time), gap)
    out = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def islands(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, start, end, n, members): islands of events on a stream: a space of `gap` ends one, late rows beyond `late` are dropped.

    On a stream in append mode an island comes out once no event can join it any more.
    """
    w = F.session_window(F.col(time), gap)
    members = F.array_sort(F.collect_list(F.struct(F.col(time).alias("at"), F.col("id").alias("id"))))
    out = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), members.alias("members"))
    return out.select(key, F.col("w.start").alias("start"), F.element_at("members", -1)["at"].alias("end"), "n", "members")


def preparation(changes: DataFrame, gap: str, late: str) -> DataFrame:
    """(entity, id, start, n): each object that a burst of changes (entity, id, ts) touched, once a burst: what is to be prepared anew.

    Changes closer than `gap` are one burst; repeated ones are dropped by the watermark and not planned twice.
    """
    once = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["entity", "id", "ts"])
    w = F.session_window(F.col("ts"), gap)
    return once.groupBy("entity", "id", w.alias("w")).agg(F.count("*").alias("n")).select("entity", "id", F.col("w.start").alias("start"), "n")


def due_objects(changes: DataFrame, delay_seconds: float, late: str) -> DataFrame:
    """(entity, id, first, last, n) on a stream of changes (entity, id, ts): the bursts whose preparation is due.

    A change closer than the delay to a burst joins it, and bursts that meet become one. A burst is due a delay after its last
    change, on the clock of events, when nothing can join it any more. The same change twice is one change, and one that comes
    later than `late` behind the newest is dropped. Times are microseconds since 1970.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    once = changes.select("entity", "id", "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(["entity", "id", "ts"])
    # session windows join those that only touch: a microsecond less, and a change at the full delay begins a new burst
    w = F.session_window(F.col("ts"), f"{round(delay_seconds * 1_000_000) - 1} microseconds")
    at = F.unix_micros("ts")
    out = once.groupBy("entity", "id", w.alias("w")).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))
    return out.select("entity", "id", "first", "last", "n")


def claim_stream(due: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that plans what is missing for due objects and claims each piece once.

    `plan` gives the pieces (kind, id, piece) that a batch's objects (entity, id) lack now. Those that an earlier batch has claimed
    are left out; the rest is written below `path` by the batch's number, so that a repeated batch claims the same again.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        due_ = saved(df.select("entity", "id").distinct(), "due")  # a plan reads it many times, and the stream's state once
        pieces = plan(due_).select("kind", F.col("id").cast("string").alias("id"), "piece").distinct()
        earlier = [n for n in _batches(spark, path) if n < number]
        if earlier:
            taken = spark.read.parquet(*(f"{path}/batch={n}" for n in earlier))
            pieces = pieces.join(taken.select("kind", "id", "piece"), ["kind", "id", "piece"], "left_anti")
        pieces.write.mode("overwrite").parquet(f"{path}/batch={number}")
        drop(due_)

    return due.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def missing_pieces(due: DataFrame, keys: DataFrame, index: DataFrame, spans: DataFrame, chunks: DataFrame, requests: DataFrame, usable: DataFrame) -> DataFrame:
    """(kind, id, piece) that due objects (entity, id) lack: index rows, frame chunks and analyses.

    A sample's index row is missing or stale (`index_status` of keys (id, signature) and index); its span (id, sound, f_start,
    f_end) needs 60 s chunks that are not there (`frame_coverage`); a segment's unit (`plan_analysis` of requests with id) is
    to be run. A piece names what would be made, so that a later change of the same object is a new piece.
    """
    sample = due.where("entity = 'sample'").select("id").distinct()
    own = keys.join(sample, "id", "left_semi")
    stale = index_status(own, index, "id").where("state <> 'ready'").join(own, "id")
    rows = stale.select(F.lit("index").alias("kind"), F.col("id").cast("string").alias("id"), F.col("signature").cast("string").alias("piece"))
    gaps = frame_coverage(spans.join(sample, "id", "left_semi"), chunks).where("not ready").select("id", F.explode("missing").alias("chunk")).join(spans.select("id", "sound"), "id")
    frames = gaps.select(F.lit("frames").alias("kind"), F.col("sound").cast("string").alias("id"), F.col("chunk").cast("string").alias("piece"))
    segment = due.where("entity = 'segment'").select("id").distinct()
    asked = requests.join(segment, "id", "left_semi")
    units = plan_analysis(asked, usable).where("action = 'run'").select("unit_id").join(asked.groupBy("unit_id").agg(F.min("fingerprint").alias("fingerprint")), "unit_id")
    runs = units.select(F.lit("analysis").alias("kind"), F.col("unit_id").cast("string").alias("id"), F.col("fingerprint").cast("string").alias("piece"))
    return rows.unionByName(frames).unionByName(runs).distinct()


def progress(items: DataFrame) -> DataFrame:
    """(job_id, total, ok, failed) so far; on a stream in update or complete mode."""
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    return items.groupBy("job_id").agg(F.count("*").alias("total"), count("ok").alias("ok"), count("failed").alias("failed"))


def finished(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run a stream over what its source holds now, and return its rows."""
    spark = stream.sparkSession
    path = f"{checkpoint}/out"

    def batch(df: DataFrame, number: int) -> None:
        df.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/_b={number}")

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{checkpoint}/log").queryName(name).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("basePath", path).parquet(path).drop("_b")
    if mode == "complete":
        return rows.join(rows.agg(F.max("_batch").alias("_batch")), "_batch").drop("_batch")
    return rows.drop("_batch")
