"""Time maps as properties of random plans, their errors, and densities against trying every power of two."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__
from timelake.functions import timemap
from timelake.operators import stretch
from timelake.plans.stretch import BPM, hundredths, sentences

RATE = 8000.0


def tables(spark, n=60, seed=1):
    r, blocks, pauses, cuts, windows = random.Random(seed), [], [], [], []
    for i in range(n):
        t, k_all = r.choice([0.0, 0.0, 0.05, 0.4]), r.randint(1, 9)
        for k in range(k_all):
            step, gap = r.uniform(0.08, 0.5), r.choice([0.0, 0.0, 0.3, 0.6]) if k < k_all - 1 else 0.0
            blocks.append((i, k, t, t + step * 0.9, r.randint(1, 4), step + (0.02 if gap else 0.0), max(gap - 0.02, 0.0)))
            if gap:
                pauses.append((i, t + step + 0.01, t + step + gap - 0.01))
                cuts.append((i, k + 1, r.random() < 0.3))
            t += step + gap
        windows.append((i, 0.0, t + r.choice([0.0, 0.1, 0.5]), RATE))
    return (
        spark.createDataFrame(blocks, "sample_id int, k int, onset double, end double, cells int, dur double, rest double"),
        spark.createDataFrame(pauses, "sample_id int, start double, end double"),
        spark.createDataFrame(cuts, "sample_id int, k int, merged boolean"),
        spark.createDataFrame(windows, "sample_id int, w0 double, w1 double, rate double"),
    )


@pytest.fixture(scope="module")
def plans(spark):
    return stretch.plans(*tables(spark)).cache()


@pytest.mark.parametrize("bpm, density", [(60.0, 1.0), (150.0, 4.0), (240.0, 2.0)])
def test_maps_rise_and_keep_their_cores(plans, bpm, density):
    rows = stretch.mapped(plans, F.lit(density), F.lit(bpm)).select("sample_id", "scheme", "w1", F.transform("scheme.points", lambda p: timemap.to_target(F.col("scheme.knots"), F.rint(p["src"] * RATE))).alias("at"), timemap.to_source(F.col("scheme.knots"), timemap.to_target(F.col("scheme.knots"), F.lit(777.0))).alias("back")).collect()
    good = [r for r in rows if r.scheme.error is None]
    assert len(good) > 50 and {r.scheme.error for r in rows} <= {None, "rhythm-map-not-monotonic"}
    for r in good:
        s = r.scheme
        assert all(b.s > a.s and b.t > a.t for a, b in zip(s.knots, s.knots[1:]))
        assert (s.knots[0].s, s.knots[0].t) == (0, 0) and (s.knots[-1].s, s.knots[-1].t) == (round(r.w1 * RATE), s.frames)
        assert all((p.sa, p.ta) == (q.sb, q.tb) for q, p in zip(s.pieces, s.pieces[1:]))
        cores = [p for p in s.pieces if p.kind == "core"]
        assert all(p.sb - p.sa == p.tb - p.ta <= 2 * round(0.008 * RATE) for p in cores)
        # control points lie on their beats, to a frame
        beat = 60 / bpm * RATE
        assert all(abs((at - r.at[0]) - (p.beat - s.points[0].beat) * beat) <= 1 for at, p in zip(r.at, s.points))
        # speech between cores never stretches more than the whole does where a pause can give way
        for p in s.pieces:
            with_pause = any(q.bridge == p.bridge and q.kind == "pause" for q in s.pieces)
            assert p.kind != "bridge" or not with_pause or (p.tb - p.ta) <= (p.sb - p.sa) * s.ratio + 1
        assert abs(r.back - min(777.0, s.knots[-1].s)) < 1e-6


def test_densities_against_every_power(plans):
    got = {(r.sample_id, r.plan): r for r in stretch.candidates(plans, 170.0).collect()}
    every = plans.select("*", F.explode(F.sequence(F.lit(-6), F.lit(9))).alias("x"))
    speeds = {}
    for r in stretch.mapped(every, F.pow(F.lit(2.0), F.col("x")), F.lit(170.0)).select("sample_id", "x", "scheme.speed", "scheme.error", "blocks").collect():
        speeds.setdefault(r.sample_id, ({}, r.blocks))[0][r.x] = (r.speed, r.error)
    for i, (tried, blocks) in speeds.items():
        k = math.ceil(math.log2(sum(b.cells for b in blocks) * (60 / 170.0) / sum(b.dur for b in blocks)))
        bad = None
        fast = lambda x: tried[x][0] >= 1 - 1e-5  # noqa: B023, E731
        if tried[k][1]:
            bad = tried[k][1]
        elif fast(k):
            while not bad and tried[k - 1][1] is None and fast(k - 1):
                k -= 1
            bad = tried[k - 1][1]
        else:
            while not bad:
                k += 1
                bad = tried[k][1]
                if not bad and fast(k):
                    break
        if bad:
            assert got[i, None].error == bad
            continue
        for name, by in (("near_fast", 0), ("near_slow", -1), ("double", 1)):
            row = got[i, name]
            assert row.error == tried[k + by][1] and (row.error or (row.scheme.density == 2.0 ** (k + by) and abs(row.scheme.speed - tried[k + by][0]) < 1e-12))


def test_original_tempo(plans):
    rows = stretch.candidates(plans, None, ("near_fast",)).collect()
    ok = [r for r in rows if r.error is None]
    assert len(ok) > 40 and all(abs(r.scheme.speed - 1) <= 1e-3 and 20 <= r.scheme.bpm <= 400 for r in ok)
    assert {r.error for r in rows} <= {None, "rhythm-original-speed-impossible", "rhythm-map-not-monotonic"}
    with pytest.raises(ValueError):
        stretch.candidates(plans, 500.0)


def test_errors_and_schemes(spark):
    blocks, pauses, cuts, windows = tables(spark, 4, 7)
    many = spark.createDataFrame([(9, k, k * 0.1, k * 0.1 + 0.05, 1, 0.1, 0.0) for k in range(129)] + [(8, 0, 0.0, 0.1, None, 0.1, 0.0), (7, 0, 0.5, 0.6, 1, 0.1, 0.0), (7, 1, 0.5, 0.7, 1, 0.2, 0.0), (6, 0, 0.0, 0.5, 64, 0.5, 0.0)], blocks.schema)
    more = spark.createDataFrame([(i, 0.0, 20.0, RATE) for i in (5, 6, 7, 8, 9)], windows.schema)
    rows = stretch.plans(blocks.union(many), pauses, cuts, windows.union(more))
    assert {r.sample_id: r.error for r in rows.collect() if r.sample_id > 4} == {5: "rhythm-no-blocks", 6: None, 7: None, 8: "rhythm-no-duration", 9: "rhythm-too-many-blocks"}
    slow = {r.sample_id: r.error for r in stretch.knots(stretch.mapped(rows, F.lit(2.0**-4), F.lit(60.0))).select("sample_id", "error").distinct().collect()}
    assert slow[6] == "rhythm-output-too-long" and slow[7] == "rhythm-map-not-monotonic" and slow[9] == "rhythm-too-many-blocks"
    schemes = stretch.evidence_schemes(stretch.candidates(rows, 120.0)).collect()
    assert schemes and all(s.stop == len(s.onsets) == len(s.cells) and abs(s.exact[0].src) < 1e-9 and s.points[0].beat == 0 for s in schemes)


def test_scores_are_rounded_as_sql_rounds_doubles(spark):
    duckdb = pytest.importorskip("duckdb")
    scores = [76.445, 1.005, 0.125, 2.675, 1.015, 33.335, 0.0, 99.9949, 8.575]
    got = [r.x for r in spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").orderBy("i").select(hundredths(F.col("s")).alias("x")).collect()]
    assert got == [duckdb.connect().execute(f"SELECT round({s}::DOUBLE, 2)").fetchone()[0] for s in scores]


def test_points_need_no_map(spark):
    blocks, pauses, cuts, windows = tables(spark, 40, 5)
    rows = stretch.plans(blocks, pauses, cuts, windows)
    found = stretch.points(rows, F.lit(2.0), F.lit(150.0))
    whole = stretch.mapped(rows, F.lit(2.0), F.lit(150.0)).select("sample_id", F.posexplode("scheme.points").alias("i", "point"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect()))
    assert "pieces" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_maps_are_those_of_columns(spark, plans):
    many = spark.createDataFrame([(101, 0, 0.0, 0.5, 64, 0.5, 0.0), (102, 0, 0.5, 0.6, 1, 0.1, 0.0), (102, 1, 0.5, 0.7, 1, 0.2, 0.0), *[(103, k, k * 0.3, k * 0.3 + 0.1, 1 + k % 3, 0.2, 0.1) for k in range(100)]], "sample_id int, k int, onset double, end double, cells int, dur double, rest double")
    pauses = spark.createDataFrame([(103, k * 0.3 + 0.15, k * 0.3 + 0.25) for k in range(0, 99, 2)], "sample_id int, start double, end double")
    cuts = spark.createDataFrame([(103, k + 1, k % 4 == 0) for k in range(0, 99, 2)], "sample_id int, k int, merged boolean")
    windows = spark.createDataFrame([(i, 0.0, w, RATE) for i, w in ((101, 20.0), (102, 20.0), (103, 40.0), (104, 1.0))], "sample_id int, w0 double, w1 double, rate double")
    rows = plans.unionByName(stretch.plans(many, pauses, cuts, windows)).select("*", F.explode(F.sequence(F.lit(-4), F.lit(6))).alias("x"))
    rows = rows.withColumns({"sample_id": F.col("sample_id") * 100 + F.col("x"), "d": F.pow(F.lit(2.0), F.col("x"))}).cache()
    columns = {r.sample_id: (r.error, r.speed, r.knots) for r in stretch.mapped(rows, F.col("d"), F.lit(97.0)).select("sample_id", F.coalesce("error", "scheme.error").alias("error"), "scheme.speed", "scheme.knots").collect()}
    fast = {r.sample_id: (r.error, r.speed) for r in stretch.speeds(rows, F.col("d"), F.lit(97.0)).collect()}
    knots = {r.sample_id: (r.error, r.knots) for r in stretch.map_knots(rows, F.col("d"), F.lit(97.0)).collect()}
    # a map that failed has no speed and no knots
    columns = {i: (e, None, None) if e else (e, s, k) for i, (e, s, k) in columns.items()}
    assert fast == {i: (e, s) for i, (e, s, _) in columns.items()} and knots == {i: (e, k) for i, (e, _, k) in columns.items()}
    assert {e for e, _ in fast.values()} == {None, "rhythm-map-not-monotonic", "rhythm-output-too-long", "rhythm-no-blocks"}


def test_candidates_without_maps(plans):
    pick = lambda found: {(r.sample_id, r.plan): (r.error, r.density, r.speed, r.bpm) for r in found.select("sample_id", "plan", "error", "scheme.density", "scheme.speed", "scheme.bpm").collect()}
    for bpm in (170.0, None):
        assert pick(stretch.candidates(plans, bpm, maps=False)) == pick(stretch.candidates(plans, bpm))


def test_pause_ends_on_half_a_frame_are_rounded_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    lines = {
        1: [(2940, 24, 2, 50.0), (17514, 994, 3, 33.0), (19643, 606, 5, 42.0), (1417, 717, 6, 31.0)],
        2: [(10111, 731, 3, 35.0), (10857, 385, 4, 2.0), (3995, 33, 5, 26.0), (8692, 743, 6, 40.0), (15716, 913, 7, 33.0)],
        3: [(12990, 363, 2, 41.0), (7581, 70, 6, 8.0), (10483, 367, 6, 30.0), (4843, 375, 7, 20.0), (14933, 751, 7, 33.0)],
    }
    rows = [(k, *x, 1.0) for k, v in lines.items() for x in v]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    table.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["w11_time_map"]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()["w11_time_map"](spark, str(tmp_path)).collect())) == sorted(want)
    columns = stretch.knots(stretch.mapped(sentences(spark, str(tmp_path))[1], F.lit(2.0), F.lit(BPM)))
    assert sorted((r.sample_id, r.i, r.s, r.t) for r in columns.collect()) == sorted(want)


def test_original_tempo_is_sought_in_one_pass_after_one_shuffle(spark):
    plan = __spark_entry__.queries()["w13_original_tempo"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Scan parquet") == 1 and "Join" not in plan


def test_gathered_plans_are_plans(spark):
    blocks, pauses, cuts, windows = tables(spark, 50, 3)
    odd = [(None, 0, 0.1, 0.2, 1, 0.1, 0.0), (70, 0, 0.0, 0.1, None, 0.1, 0.0), (71, 0, 0.0, 0.1, 1, 0.0, 0.0)]
    odd += [(72, k, k * 0.1, k * 0.1 + 0.05, 1, 0.1, 0.0) for k in range(129)] + [(73, k, k * 0.1, k * 0.1 + 0.05, 1, 0.1, 0.0) for k in range(128)]
    blocks = blocks.unionByName(spark.createDataFrame(odd, blocks.schema)).cache()
    windows = windows.unionByName(spark.createDataFrame([(i, 0.0, 20.0, RATE) for i in (None, 70, 71, 72, 73)], windows.schema))
    # a pause starts behind the block after which it lies, and its cut is before the next one
    behind = blocks.select("sample_id", "k", "end", F.lead("onset").over(Window.partitionBy("sample_id").orderBy("k")).alias("next"))
    pause = behind.join(pauses.withColumnRenamed("end", "stop"), "sample_id").where("start > end and start < next").select("sample_id", "k", F.struct("start", F.col("stop").alias("end")).alias("pause"))
    cut = cuts.where("not merged").select("sample_id", (F.col("k") - 1).alias("k"), F.col("k").alias("cut"))
    rich = blocks.join(pause, ["sample_id", "k"], "left").join(cut, ["sample_id", "k"], "left").withColumn("n", F.count("*").over(Window.partitionBy("sample_id")))
    rich = rich.join(windows.withColumnRenamed("sample_id", "id"), F.expr("sample_id <=> id")).drop("id")
    got = stretch.gathered_plans(rich, {c: F.max(c) for c in ("w0", "w1", "rate")})
    want = stretch.plans(blocks, pauses, cuts, windows)
    assert got.schema.simpleString() == want.schema.simpleString()
    found, by_key = got.collect(), lambda r: (r.sample_id is None, r.sample_id)
    assert sorted(found, key=by_key) == sorted(want.collect(), key=by_key) and sum(len(r.pauses) for r in found) > 20
    assert {r.sample_id: r.error for r in found if r.error} == {None: "rhythm-no-blocks", 70: "rhythm-no-duration", 71: "rhythm-no-duration", 72: "rhythm-too-many-blocks"}
