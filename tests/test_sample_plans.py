import pytest
from pyspark.sql import functions as F

from timelake.operators import sample_plans as sp

ASSETS = "id string, source_id string, duration double, frame double, mapping array<struct<local:double,source:double>>, roles array<string>, origin string, stream int, model string, stem string"


@pytest.fixture(scope="module")
def tables(spark):
    k = lambda a, b, c, d: [(a, b), (c, d)]
    assets = spark.createDataFrame(
        [("t1", "s1", 100.0, 0.01, k(0.0, 0.0, 100.0, 100.0), ["mix"], "stream", 1, None, None), ("v1", "s1", 50.0, 0.01, k(0.0, 20.0, 50.0, 70.0), ["vocal"], "separation", None, "big", "vocals"), ("x2", "s2", 9.0, 0.01, None, ["sfx"], "cut", None, None, None)], ASSETS
    )
    sources = spark.createDataFrame([("s1", "Work", "01", "/m/a.b.mkv", 1), ("s2", "", "", "/m/.hidden", 4)], "id string, work string, episode string, path string, default_stream int")
    texts = spark.createDataFrame([("s1", 25.0, 26.0, "one\ntwo"), ("s1", 26.0, 27.0, "one two"), ("s1", 26.5, 28.0, "three"), ("s1", 90.0, 91.0, " ")], "source_id string, start double, end double, text string")
    return assets, sources, texts


def test_selections(spark, tables):
    asked = spark.createDataFrame([("a", "v1", 5.0, 7.0, "manual"), ("b", "v1", -0.005, 50.004, "hit"), ("c", "v1", 40.0, 60.0, "manual"), ("d", "zz", 0.0, 1.0, "manual"), ("e", "x2", 1.0, 2.0, "manual"), ("f", "t1", 40.0, 41.5, "odd")], "key string, asset_id string, start double, end double, via string")
    got = {r.key: r for r in sp.plan_selections(asked, *tables).collect()}
    assert (got["a"].name, got["a"].judge_start, got["a"].judge_end, got["a"].nature, got["a"].status) == ("one two / three", 25.0, 27.0, "speech", "pending")
    assert (got["b"].start, got["b"].end, got["b"].via) == (0.0, 50.0, "hit")
    assert {k: got[k].error for k in "cdf"} == {"c": "beyond-end", "d": "asset-not-found", "f": "sample-plan-invalid"} and got["c"].start is None
    assert (got["e"].name, got["e"].judge_start, got["e"].nature) == (".hidden · local 0:01.000–0:02.000", None, "unpitched")


def test_stems_and_whole_tracks(spark, tables):
    assets, sources, _ = tables
    stem = sp.plan_stems(spark.createDataFrame([("k", "v1")], "key string, asset_id string"), assets, sources).first()
    assert (stem.name, stem.start, stem.end, stem.judge_start, stem.judge_end, stem.nature) == ("Work 01 · big · vocals", 0.0, 50.0, 20.0, 70.0, "speech")
    whole = {r.key: r for r in sp.plan_whole_tracks(spark.createDataFrame([("s1",), ("s1",), ("s2",), ("s3",)], "source_id string"), assets, sources).collect()}
    assert (whole["s1"].asset_id, whole["s1"].name, whole["s1"].end, whole["s1"].nature) == ("t1", "a.b", 100.0, "unclassified")
    assert whole["s2"].error == "source-no-audio" and whole["s3"].error == "source-not-found" and len(whole) == 3


def test_one_token_and_one_stale_check(spark, tables):
    assets, sources, texts = tables
    asked = spark.createDataFrame([("a", "v1", 5.0, 7.0, "manual")], "key string, asset_id string, start double, end double, via string")
    segments = spark.createDataFrame([("g1", "s1", "v1", 22.0, 24.0, "hi"), ("g2", "s1", "v1", 10.0, 12.0, "early"), ("g3", "s1", "v1", 69.0, 75.0, "late"), ("g4", "s1", "v1", 40.0, 41.0, "")], "id string, source_id string, asset_id string, start double, end double, text string")
    marked = spark.createDataFrame([("s1", 1000.0, 1001.0)], "source_id string, start double, end double")
    make = lambda t: sp.united(sp.plan_selections(asked, assets, sources, t), sp.plan_stems(spark.createDataFrame([("k", "v1")], "key string, asset_id string"), assets, sources), sp.plan_segments(segments, assets, marked, 1.0, 1.0))
    plan = make(texts)
    rows = {r.key: r for r in plan.collect()}
    assert (rows["g1"].start, rows["g1"].end, rows["g1"].judge_start, rows["g1"].judge_end) == (1.0, 5.0, 22.0, 24.0)
    assert [rows[k].status for k in ("g2", "g3", "g4")] == ["out-of-track", "pending", "no-name"] and rows["g3"].end == 50.0 and rows["g3"].judge_end == 70.0
    seen = sp.token(plan).first().token
    keys = spark.createDataFrame([("a",), ("g1",), ("k",), ("a",)], "key string")
    made = sp.create(plan, seen, keys).collect()
    assert sorted(r.key for r in made) == ["a", "g1", "k"] and all(r.error is None for r in made)
    assert [r.error for r in sp.create(plan, seen, keys.union(spark.createDataFrame([("g2",)], "key string"))).collect()] == ["sample-plan-invalid"]
    assert [r.error for r in sp.create(plan, seen, keys.union(spark.createDataFrame([("no",)], "key string"))).collect()] == ["sample-plan-invalid"]
    later = make(texts.withColumn("text", F.when(F.col("text") == "three", "four").otherwise(F.col("text"))))
    assert [r.error for r in sp.create(later, seen, keys).collect()] == ["sample-plan-stale"]
