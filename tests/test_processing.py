"""Processing, listing, catalogue scans, folds and streaming islands against figures worked by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from timelake.functions import text
from timelake.operators import edits, listing, processing, vectors
from timelake.sources import catalog, subtitles
from timelake.streaming import streams


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_processing_intervals(spark):
    jobs = spark.createDataFrame([("w", "whole", 1.0, None, None), ("i", "inner", 1.0, None, None), ("o", "inner", 1.0, 0.5, 1.5), ("p", "inner", 1.0, 0.4, 0.5), ("v", "vowels", 1.0, None, None), ("f", "first", 1.0, None, None), ("n", "first", 1.0, None, None), ("x", "odd", 1.0, None, None), ("q", "vowels", 1.0, None, None)], "key string, mode string, duration double, inner_start double, inner_end double").withColumns({"left": F.lit(None).cast("double"), "right": F.lit(None).cast("double")})
    phones = spark.createDataFrame([("v", "a", -0.1, 0.2), ("v", "k", 0.2, 0.3), ("v", "N", 0.3, 0.4), ("f", "i", 0.25, 0.4), ("n", "k", 0.0, 0.4)], "key string, label string, start double, end double")
    got = {r.key: (None if r.intervals is None else [(s.start, s.end) for s in r.intervals], r.error) for r in processing.processing_intervals(jobs, phones).collect()}
    assert got == {"w": ([(0.0, 1.0)], None), "i": ([(0.1, 0.9)], None), "o": (None, "out-of-bounds"), "p": (None, "plateau"), "v": ([(0.0, 0.2), (0.3, 0.4)], None), "f": ([(0.25, 1.0)], None), "n": (None, "no-vowel"), "x": (None, "not-an-option"), "q": (None, "no-alignment")}


def test_assigned_pitch(spark):
    frames = spark.createDataFrame([("s", i, f, 0.9, e) for i, (f, e) in enumerate([(220.0, 1e-3), (220.0, 1e-12), (220.0, 1e-3), (220.0, 1e-3)])], "key string, frame int, f0 double, conf double, energy double")
    times = spark.createDataFrame([("s", 0.005), ("s", 0.016), ("s", 0.025), ("s", 0.9)], "key string, t double")
    jobs = spark.createDataFrame([("s", [{"start": 0.0, "end": 0.03}], 69.0, False)], "key string, intervals array<struct<start:double,end:double>>, midi double, inner boolean").withColumns({"left": F.lit(0.01), "right": F.lit(0.01)})
    assert [round(r.hz, 6) for r in processing.assign_pitch(times, frames, jobs).orderBy("t").collect()] == [440.0, 0.0, 440.0, 220.0]
    blend = processing.assign_pitch(times, frames, jobs.withColumn("inner", F.lit(True))).orderBy("t").collect()
    # half a transition in, the weight is one half: the pitch lies half an octave up
    assert abs(blend[0].hz - 220 * math.sqrt(2)) < 1e-6 and abs(blend[2].hz - 220 * math.sqrt(2)) < 1e-6


def test_splicing(spark):
    n, rate = 40, 1000
    samples = spark.createDataFrame([("s", i) for i in range(n)], "key string, i long")
    parts = spark.createDataFrame([("s", 0.010, 0.030)], "key string, start double, end double")
    mask = processing.splice_mask(samples, parts, rate)
    got = {r.i: r["mask"] for r in mask.collect()}
    ramp = [0.0, 1 / 3, 2 / 3] + [1.0] * 14 + [2 / 3, 1 / 3, 0.0]
    assert all(abs(got[10 + j] - v) < 1e-9 for j, v in enumerate(ramp)) and got[9] == got[30] == 0
    assert {r["mask"] for r in processing.splice_mask(samples, parts, rate, fade=False).where("i between 10 and 29").collect()} == {1.0}
    a, b = samples.withColumn("x", F.lit(1.0)), samples.withColumn("x", F.lit(3.0))
    out = {r.i: r.x for r in processing.splice(a, b, mask).collect()}
    assert out[0] == 1.0 and out[20] == 3.0 and abs(out[11] - (1 + 2 / 3)) < 1e-6
    assert [r.error for r in processing.splice(a, b.where("i > 0"), mask).collect()] == ["length"]
    assert [r.error for r in processing.splice(a, b.withColumn("x", F.lit(float("nan"))), mask).collect()] == ["non-finite"]


def test_pages(spark):
    rows = [(i, "b" if i % 2 else "A", i % 3, 0.0, float(i % 4)) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, name string, created_at int, start double, end double").withColumn("row_id", F.col("id"))
    first = listing.page(df, "name", 13, 4).collect()
    assert [r.id for r in first] == [26, 28, 1, 3] and {r.total for r in first} == {30}
    assert [r.id for r in listing.page(df, "created", 0, 2).collect()] == [29, 26] and listing.page(df, "duration", 0, 9999).count() == 30
    assert [r.id for r in listing.all_ids(df, "name").collect()] == sorted(range(30), key=lambda i: (rows[i][1].lower(), i))
    with pytest.raises(ValueError):
        listing.page(df, "colour")


def test_typed_scans(spark, tmp_path):
    spark.createDataFrame([("s1", '["ann", "bob"]', 3)], "id string, speakers string, start int").write.parquet(str(tmp_path / "segments"))
    spark.createDataFrame([("m", '{"a": 1.5}')], "sample_id string, values string").write.parquet(str(tmp_path / "metrics"))
    got = catalog.read_catalog(spark, str(tmp_path), "segments", "metrics")
    r = got["segments"].first()
    assert r.speakers == ["ann", "bob"] and r.start == 3.0 and r.end is None and got["metrics"].first()["values"] == {"a": 1.5}


def test_exploded_frames(spark):
    nan = float("nan")
    chunks = spark.createDataFrame([("a", 0, [1.0, nan], [0.5, 0.5], [0.1, 0.1]), ("a", 2, [9.0], [0.9], [0.2])], "asset_id string, chunk int, f0 array<float>, conf array<float>, energy array<float>")
    rows = catalog.explode_frames(chunks, spark.createDataFrame([("a", 12_001), ("b", 2), ("c", 0)], "asset_id string, n_frames long"))
    assert rows.count() == 12_003
    known = {(r.asset_id, r.frame): r.f0 for r in rows.where("conf is not null").collect()}
    assert known == {("a", 0): 1.0, ("a", 1): None, ("a", 12_000): 9.0}


def test_sidecar_updates(spark):
    linked = spark.createDataFrame([(1, "/a/x.mkv", None), (2, "/a/y.mkv", "/a/Y.ass"), (3, "/a/z.mkv", "/b/z.ass"), (4, "/a/w.mkv", "/a/gone.srt"), (5, "/a/v.mkv", None), (6, "/a/u.mkv", "/a/other.srt"), (7, "/a/t.mkv", "/a/t.ass")], "id int, path string, subtitle_path string")
    files = spark.createDataFrame([("/a/Y.ass",), ("/b/z.ass",), ("/a/other.srt",), ("/a/t.ass",)], "path string")
    matches = spark.createDataFrame([(i, f"/a/{n}.srt") for i, n in enumerate("xyzwvu", 1)] + [(7, "/a/t.ass")], "id int, found string")
    chosen = spark.createDataFrame([(5,)], "id int")
    assert rows_of(catalog.sidecar_updates(linked, files, matches, chosen)) == [(1, "/a/x.srt"), (2, "/a/y.srt"), (4, "/a/w.srt")]


def test_ass_problems(spark):
    ass = "[Script Info]\nDialogue: no\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.50,{b}Hi, you\\Nthere\nDialogue: 0:00:01.00\nDialogue: x,0:00:02.50,t\nComment: 0:00:01.00,0:00:02.00,c\n[Events]\nDialogue: 0,0:00:03.00,0:00:04.00,S,N,0,0,0,,plain"
    cues, problems = subtitles.parse_ass(spark.createDataFrame([("p", ass)], "path string, content string"))
    assert [(r.order, r.ref, r.start, r.end, r.text, r.line) for r in cues.orderBy("order").collect()] == [(1, "1", 1.0, 2.5, "Hi, you\nthere", 5), (2, "4", 3.0, 4.0, "plain", 10)]
    assert rows_of(problems) == [("p", 6, "bad-dialogue"), ("p", 7, "no-timing")]


def test_spoken_text(spark):
    got = spark.createDataFrame([("あ〜「い」。 ♪x",), ("",)], "t string").select(text.spoken_text(F.col("t")).alias("s")).collect()
    assert (got[0].s.text, got[0].s.origin) == ("あーい、、x", [0, 1, 3, 5, 6, 8]) and (got[1].s.text, got[1].s.origin) == ("", [])


def test_speakers_are_planned_anew(spark):
    rows = [(1, "subtitle", False, False, "(ann) hello", []), (2, "subtitle", True, False, "(ann) hello", []), (3, "manual", False, False, "(ann) x", []), (4, "subtitle", False, False, None, []), (5, "subtitle", False, False, "(ann) hello", ["ann"]), (6, "subtitle", False, True, "(ann) hello", [])]
    df = spark.createDataFrame([(i, 1, o, e, p, False, raw, s, False) for i, o, e, p, raw, s in rows], "id int, version int, origin string, speaker_edited boolean, protected boolean, deleted boolean, raw string, speakers array<string>, withheld boolean")
    assert rows_of(edits.plan_speakers(df)) == [(1, 1, ["ann"], False)]


def test_folds_and_relaxed_margins(spark):
    r = random.Random(3)
    rows = spark.createDataFrame([(i, i % 2, [1.0 if i % 2 else -1.0, r.gauss(0, 0.3)]) for i in range(60)], "id long, label int, v array<double>").withColumn("v", vectors.normalized(F.col("v")))
    judged = vectors.predict_by_folds(rows)
    assert judged.count() == 60 and judged.where("label = truth").count() >= 58
    assert vectors.calibrate_margin(judged, 0.95).first().margin is not None
    refs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, v array<double>")
    lines = spark.createDataFrame([(1, "s", 0.0, 1.0, [0.73, 0.69]), (2, "s", 500.0, 501.0, [0.73, 0.69])], "id int, source_id string, start double, end double, v array<double>")
    settled = spark.createDataFrame([("s", 40.0, 41.0, 0), ("s", 470.0, 471.0, 1)], "source_id string, start double, end double, label int")
    assert {r.id: r.label for r in vectors.assign_by_means(lines, refs, 0.08, settled).collect()} == {1: 0, 2: None}


def test_islands_and_preparation_on_a_stream(spark, tmp_path):
    rows = [("k", i, t) for i, t in enumerate((0, 5, 8, 40, 41, 300))] + [("j", 9, 3), ("k", 1, 5)]
    df = spark.createDataFrame(rows, "key string, id int, s int").select("key", "id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = {(r.key, r.n) for r in streams.islands(df, "key", "ts", "10 seconds", "20 seconds").collect()}
    assert batch == {("k", 4), ("k", 2), ("k", 1), ("j", 1)}
    live = streams.finished(streams.islands(source, "key", "ts", "10 seconds", "20 seconds"), "islands", "append", str(tmp_path / "c1")).collect()
    assert {(r.key, r.n) for r in live} <= batch and ("k", 4) in {(r.key, r.n) for r in live}
    plan = streams.preparation(source.withColumn("entity", F.lit("sample")), "10 seconds", "20 seconds")
    done = streams.finished(plan, "prepare", "append", str(tmp_path / "c2")).collect()
    assert {(r.id, r.n) for r in done} >= {(0, 1), (1, 1), (2, 1)}
