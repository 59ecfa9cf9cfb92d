"""Refresh with markers and compaction, and preparation with state: under repeated, late and restarted input."""

import random

from pyspark.sql import functions as F

from timelake.operators import tags
from timelake.streaming import streams

CHANGES = "source_id string, start double, end double, old_source_id string, old_start double, old_end double, sample_id int"


def test_samples_left_without_rows_lose_them(spark, tmp_path):
    samples = spark.createDataFrame([(1, "s", 0.0, 5.0), (2, "s", 2.0, 7.0)], "id int, source_id string, start double, end double")
    state = {"rows": [(1, "x"), (2, "y")]}
    rebuild = lambda df: df.join(spark.createDataFrame(state["rows"], "id int, tag string"), "id").select(F.col("id").alias("sample_id"), "tag")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def change():
        spark.createDataFrame([("s", 0.0, 9.0)], "source_id string, start double, end double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("source_id string, start double, end double").parquet(src)
        streams.refresh_stream(stream, samples, rebuild, out, str(tmp_path / "log")).awaitTermination()
        return sorted((r.sample_id, r.tag) for r in streams.current(spark.read.parquet(out)).collect())

    assert change() == [(1, "x"), (2, "y")]
    state["rows"] = [(1, "x")]
    assert change() == [(1, "x")]


def test_random_edits_equal_a_full_rebuild(spark, tmp_path):
    """Ranges and samples are made, moved and deleted; after each batch the stream's table is what a rebuild gives."""
    r = random.Random(5)
    ranges = {i: (f"s{i % 3}", float(r.randint(0, 80)), r.randint(1, 15), f"mood:m{i % 4}") for i in range(12)}
    samples = {i: (f"s{i % 3}", float(r.randint(0, 80)), 6.0) for i in range(15)}
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    table = lambda: spark.createDataFrame([(i, s, a, a + n) for i, (s, a, n) in samples.items()], "id int, source_id string, start double, end double")
    marked = lambda: spark.createDataFrame([(s, a, a + n, t) for s, a, n, t in ranges.values()], "source_id string, start double, end double, tag string")
    rebuild = lambda df: streams.overlap_join(df.select("id", "source_id", "start", "end"), marked()).select(F.col("id").alias("sample_id"), F.col("r_tag").alias("tag")).distinct()
    first = [(s, a, a + n, None, None, None, None) for s, a, n, _ in ranges.values()]
    for turn in range(5):
        rows = first if turn == 0 else []
        for _ in range(4 if turn else 0):
            kind = r.choice(["move", "delete", "make", "sample", "gone"])
            if kind in ("move", "delete") and ranges:
                i = r.choice(list(ranges))
                s, a, n, t = ranges.pop(i)
                if kind == "move":
                    ranges[i] = (f"s{r.randint(0, 2)}", float(r.randint(0, 80)), n, t)
                    rows.append((ranges[i][0], ranges[i][1], ranges[i][1] + n, s, a, a + n, None))
                else:
                    rows.append((None, None, None, s, a, a + n, None))
            elif kind == "make":
                i = 100 + turn * 10 + len(rows)
                ranges[i] = (f"s{r.randint(0, 2)}", float(r.randint(0, 80)), 9, "mood:new")
                rows.append((ranges[i][0], ranges[i][1], ranges[i][1] + 9.0, None, None, None, None))
            elif samples:
                i = r.choice(list(samples))
                s, a, n = samples.pop(i)
                if kind == "sample":
                    samples[i] = (s, float(r.randint(0, 80)), n)
                rows.append((None, None, None, None, None, None, i))
        spark.createDataFrame(rows * 2, CHANGES).coalesce(1).write.mode("append").parquet(src)  # every change twice
        stream = spark.readStream.schema(CHANGES).parquet(src)
        streams.refresh_stream(stream, table, rebuild, out, log, compact_every=2).awaitTermination()
        got = {(x.sample_id, x.tag) for x in streams.refreshed(spark, out).collect()}
        assert got == {(x.sample_id, x.tag) for x in rebuild(table()).collect()}, turn
    assert streams._bases(spark, out) == [3] and min(streams._batches(spark, out)) == 3


def bursts_of(events, delay, until):
    out = set()
    for key in {e[:2] for e in events}:
        times, burst = sorted({t for *k, t in events if tuple(k) == key}), []
        for t in times + [None]:
            if burst and (t is None or t - burst[-1] >= delay):
                if burst[-1] + delay <= until:
                    out.add((*key, burst[0], burst[-1], len(burst)))
                burst = []
            burst.append(t)
    return out


def test_bursts_with_state_over_restarts(spark, tmp_path):
    src, log, out = (str(tmp_path / x) for x in ("in", "log", "out"))
    base = 1_700_000_000
    batches = [[("sample", "a", 0), ("sample", "b", 1), ("sample", "a", 3), ("segment", "a", 2)], [("sample", "a", 5), ("sample", "a", 3), ("sample", "b", 30)], [("sample", "a", 34), ("sample", "a", 28), ("sample", "c", 60), ("sample", "b", 5)], [("sample", "z", 200)]]
    seen, late = [], 20
    top = 0
    for rows in batches:
        seen += [e for e in rows if e[2] > top - late or not top]  # what is not too late
        spark.createDataFrame(rows, "entity string, id string, s int").select("entity", "id", F.timestamp_seconds(F.col("s") + base).alias("ts")).coalesce(1).write.mode("append").parquet(src)
        stream = streams.due_objects(spark.readStream.schema("entity string, id string, ts timestamp").parquet(src), 10.0, f"{late} seconds")
        write = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        top = max(top, *(e[2] for e in rows))
    got = [(r.entity, r.id, r.first // 1_000_000 - base, r["last"] // 1_000_000 - base, r.n) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == bursts_of(seen, 10, top - late)


def test_pieces_are_claimed_once(spark, tmp_path):
    keys = spark.createDataFrame([("a", "k1"), ("b", "k2"), ("c", "k3")], "id string, signature string")
    index = spark.createDataFrame([("a", "k1"), ("b", "old")], "id string, signature string")
    spans = spark.createDataFrame([("a", "x", 0, 7000), ("b", "x", 5000, 6500), ("c", "y", 0, 100)], "id string, sound string, f_start int, f_end int")
    chunks = spark.createDataFrame([("x", 0)], "sound string, chunk int")
    requests = spark.createDataFrame([("g", "u1", False, "t", True, "f1"), ("g", "u2", True, "t", True, "f2"), ("h", "u3", False, "t", True, "f3")], "id string, unit_id string, segment_deleted boolean, track string, covered boolean, fingerprint string")
    usable = spark.createDataFrame([("u3", "f3")], "unit_id string, fingerprint string")
    plan = lambda due: streams.missing_pieces(due, keys, index, spans, chunks, requests, usable)
    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    claimed = []
    for rows in ([("sample", "a"), ("segment", "g")], [("sample", "b"), ("sample", "a"), ("segment", "h")], [("sample", "c"), ("sample", "b")], [("sample", "c")]):
        spark.createDataFrame(rows, "entity string, id string").coalesce(1).write.mode("append").parquet(src)
        streams.claim_stream(spark.readStream.schema("entity string, id string").parquet(src), plan, out, log).awaitTermination()
        new = [tuple(r) for r in spark.read.parquet(f"{out}/batch={len(claimed)}").select("kind", "id", "piece").collect()]
        claimed.append(sorted(new))
    assert claimed == [[("analysis", "u1", "f1"), ("frames", "x", "1")], [("index", "b", "k2")], [("frames", "y", "0"), ("index", "c", "k3")], []]


def test_due_objects_are_computed_once_a_batch(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    src, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    spark.createDataFrame([("sample", str(i)) for i in range(20)], "entity string, id string").coalesce(1).write.parquet(src)
    due = spark.readStream.schema("entity string, id string").parquet(src).select("entity", counted("id").alias("id"))
    piece = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", F.lit("p").alias("piece"))
    streams.claim_stream(due, lambda df: piece(df, "x").unionByName(piece(df.join(df.select("id"), "id"), "y")), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 40 and seen.value == 20


def test_a_change_at_the_full_delay_begins_a_burst(spark, tmp_path):
    src, log, out = (str(tmp_path / x) for x in ("in", "log", "out"))
    base = 1_700_000_000_000_000
    rows = [("sample", "a", t) for t in (0, 9_999_999, 19_999_999, 19_999_999, 100_000_000)]
    spark.createDataFrame(rows, "entity string, id string, t long").select("entity", "id", F.timestamp_micros(F.col("t") + base).alias("ts")).coalesce(1).write.parquet(src)
    stream = streams.due_objects(spark.readStream.schema("entity string, id string, ts timestamp").parquet(src), 10.0, "5 seconds")
    stream.writeStream.foreachBatch(lambda df, n: df.write.parquet(f"{out}/batch={n}")).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.first - base, r["last"] - base, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, 9_999_999, 2), (19_999_999, 19_999_999, 1)]
