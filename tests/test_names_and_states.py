"""Exported names, picture times, checked texts, metrics that are missing, and pairs that are registered."""

import hashlib

from pyspark.sql import functions as F

from timelake.functions import clocks, naming
from timelake.operators import catalog, sequences


def test_export_names(spark):
    row = lambda **x: {"content": "song", "processing": "", "track": "voice", "source": "Work 01", "source_id": "abcdef123456", "start": 61.5, "end": 3723.0005, "local": None, "key": "0123456789abcdef", "ext": "wav"} | x
    cases = [row(), row(content='a/b:c*"d" . ', processing="flat-C4", local="local-"), row(content="con.x", track="NUL"), row(content="歌" * 200, track="声" * 60), row(track="t" * 150), row(key="12"), row(start=-1.0), row(content="e\u0301" * 40, source="ß" * 30), row(track="声" * 200, processing="p" * 99)]
    df = spark.createDataFrame([{**c, "n": i} for i, c in enumerate(cases)], "n int, content string, processing string, track string, source string, source_id string, start double, end double, local string, key string, ext string")
    got = {r.n: (r.export.name, r.export.error) for r in naming.with_export_name(df).collect()}
    tail = "__Work 01__abcdef12_00-01-01.500-01-02-03.000__0123456789ab.wav"
    assert got[0] == ("song__voice" + tail, None)
    assert got[1][0] == "a_b_c__d___flat-C4__voice".replace("d___", "d__") + tail.replace("_00-01", "_local-00-01") or got[1][0].startswith("a_b_c__d_")
    assert got[2] == ("_con.x___NUL" + tail, None)
    assert all(len(name.encode()) <= 255 for name, _ in got.values() if name)
    assert got[3][0].startswith("歌") and "__声" in got[3][0] and got[3][0].endswith(tail)
    assert got[4][0] == "song__" + "t" * 150 + tail
    assert got[5] == (None, "export-key-invalid") and got[6] == (None, "time-out-of-range")
    assert got[7][0].split("__")[0] == "é" * 36 and got[7][0].split("__")[2] == "ß" * 17
    assert got[8][0].split("__")[1] == "p" * 45 and set(got[8][0].split("__")[2]) == {"声"} and len(got[8][0].encode()) > 250


def test_picture_times(spark):
    rows = [("image", 5.0, 3.0, 1.0, 2.0, 0.0), ("loop", 5.0, 7.5, 1.0, 2.0, 1.5), ("loop", 5.0, 7.5, None, None, 0.0), ("sync", 5.0, 3.0, -0.5, 2.0, 4.5), ("sync", None, 3.0, 1.0, 2.0, None), ("sync", 5.0, 3.0, None, None, 5.0)]
    df = spark.createDataFrame(rows, "mode string, s double, l double, o double, d double, want double")
    assert all(r.got == r.want for r in df.withColumn("got", clocks.picture_time(F.col("mode"), F.col("s"), F.col("l"), F.col("o"), F.col("d"))).collect())


def test_texts_are_checked(spark):
    files = spark.createDataFrame([("a", bytearray("\ufeffé\r\nx\ry".encode())), ("b", bytearray(b"\xff\xfea")), ("c", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.text, r.fingerprint, r.error) for r in catalog.checked_texts(files).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {"a": ("é\nx\ny", digest("é\nx\ny"), None), "b": (None, None, "subtitle-encoding"), "c": ("", digest(""), None)}


def test_missing_metrics(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,), (3,), (4,)], "id int")
    rows = spark.createDataFrame([(1, True, {"a": 1.0, "b": None}), (2, False, {"a": 1.0, "b": 2.0}), (4, True, {"b": 1.0}), (9, True, {"a": 1.0})], "id int, valid boolean, values map<string,double>")
    got = {r.metric: (r.total, r.ready, r.stale, r.missing) for r in catalog.metric_status(ids, rows, ["a", "b"]).collect()}
    assert got == {"a": (4, 2, 2, 3), "b": (4, 2, 2, 3)}
    assert {r.metric: r.missing for r in catalog.metric_status(ids.limit(0), rows, ["a"]).collect()} == {"a": 0}


def test_pairs_are_registered(spark):
    pairs = spark.createDataFrame([(1, 0.0, 90.0, None), (1, 1200.0, 1290.0, None), (2, 0.0, 90.0, None), (2, 500.0, None, "start-without-end")], "source_id int, start double, end double, error string")
    ends = spark.createDataFrame([(1, 1400.0), (2, 1400.0)], "source_id int, duration double")
    old = spark.createDataFrame([(1, 1280.0, 1300.0), (2, 700.0, 800.0)], "source_id int, start double, end double")
    got = sorted((r.source_id, r.start, r.kind, r.state) for r in sequences.register_pairs(pairs, ends, old).collect())
    assert got == [(1, 0.0, "op", "register"), (1, 1200.0, "ed", "overlap"), (2, 0.0, None, "error")]
