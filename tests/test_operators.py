import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timelake.functions import clocks, text
from timelake.operators import edits, frames, intervals, rhythm, sequences, tags, vectors
from timelake.sources import subtitles
from timelake.streaming import streams


def test_tag_expression_errors(spark):
    col = F.array(F.lit("a"))
    for expr, reason, at in [("a AND", "expect-term", 6), ("(a", "unclosed-group", 3), ("()", "empty-group", 2), ('"a', "unclosed-quote", 1), ("a b", "expect-operator", 3), ("a)", "unexpected-close", 2), ('""', "empty-tag", 1), ("x" * 9000, "expr-too-long", 8193)]:
        with pytest.raises(tags.TagExprError) as e:
            tags.tag_expr(expr, col)
        assert (e.value.reason, e.value.position) == (reason, at), expr


@pytest.fixture(scope="module")
def tag_rows(spark):
    names = ["a", "b", "ns:x", "ns:y", "with space"]
    rows = [(k, [n for i, n in enumerate(names) if k >> i & 1]) for k in range(32)] + [(99, None)]
    return rows, spark.createDataFrame(rows, "id int, tags array<string>").cache()


def test_tag_expressions_equal_direct_evaluation(tag_rows):
    rows, df = tag_rows
    cases = {
        "a OR b AND NOT ns:*": lambda t: "a" in t or ("b" in t and not any(x.startswith("ns:") for x in t)),
        'not "with space" and (ns:x or a)': lambda t: "with space" not in t and ("ns:x" in t or "a" in t),
        "NOT NOT a": lambda t: "a" in t,
        "": lambda t: True,
    }
    for expr, f in cases.items():
        got = {r.id for r in df.where(tags.tag_expr(expr, F.col("tags"))).collect()}
        assert got == {k for k, t in rows if f(t or [])}, expr


knots = st.lists(st.tuples(st.integers(1, 50), st.integers(1, 50)), min_size=1, max_size=6).map(lambda d: [(float(sum(x for x, _ in d[:i])), float(sum(y for _, y in d[:i])) + 3.0) for i in range(len(d) + 1)])


@settings(max_examples=12, deadline=None)
@given(st.lists(knots, min_size=3, max_size=6), st.floats(0, 1))
def test_clock_round_trip_and_crop(spark, maps, share):
    df = spark.createDataFrame([(i, m, m[-1][0] * share) for i, m in enumerate(maps)], "id int, m array<struct<local:double,source:double>>, t double")
    there = clocks.to_source(F.col("m"), F.col("t"))
    half = F.element_at("m", -1)["local"] / 2
    crop = clocks.crop_mapping(F.col("m"), half / 2, half)
    for r in df.select("t", clocks.to_local(F.col("m"), there).alias("back"), clocks.to_source(crop, half / 4).alias("a"), clocks.to_source(F.col("m"), half / 2 + half / 4).alias("b"), clocks.to_source(F.col("m"), F.lit(-1.0)).alias("out")).collect():
        assert abs(r.t - r.back) < 1e-6 and abs(r.a - r.b) < 1e-6 and r.out is None


def test_composition(spark):
    df = spark.createDataFrame([([(0.0, 5.0), (10.0, 25.0)], [(0.0, 1.0), (4.0, 9.0)])], "o array<struct<local:double,source:double>>, i array<struct<local:double,source:double>>")
    c = clocks.compose_mapping(F.col("o"), F.col("i"))
    r = df.select(clocks.to_source(c, F.lit(2.0)).alias("x"), clocks.is_full_track(F.col("o"), F.lit(10.0)).alias("full"), clocks.reimport_mapping(F.col("o"), F.lit(8.0), F.lit(0.1)).alias("re")).first()
    assert abs(r.x - (5 + 2 * 5)) < 1e-9 and not r.full and r.re[-1].local == 8.0


def test_overlap_join_against_brute_force(spark):
    r = random.Random(8)
    rows = [(i, r.choice("ab"), s := r.uniform(-50, 500), s + r.choice([0.0, 1.0, 130.0, 400.0])) for i in range(120)] + [(500, "a", 10.0, 20.0), (501, "a", 20.0, 30.0)]
    df = spark.createDataFrame(rows, "id int, source_id string, start double, end double")
    got = sorted((x.id, x.r_id) for x in intervals.overlap_join(df, df).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] < a[3] and b[2] < b[3] and a[2] < b[3] - 1e-9 and a[3] > b[2] + 1e-9)
    assert got == want


def test_frame_search_against_pointwise(spark):
    r = random.Random(6)
    rows, sounds = [], {}
    for s in range(3):
        m, own = 60.0, []
        for k in range(160):
            if k % 25 == 0:
                m = r.choice([60.0, 62.0, 64.0])
            own.append(None if r.random() < 0.12 else m + r.uniform(-0.6, 0.6))
        sounds[s] = own
        rows += [(s, k, x is not None, x) for k, x in enumerate(own)]
    df = spark.createDataFrame(rows, "sound int, frame int, ok boolean, midi double")
    q = frames.PitchQuery((frames.PitchBlock(12, 60.0), frames.PitchBlock(10, 62.0)), tolerance=70, coverage=0.5, max_gap=0.03, octave_free=True, elastic=(0.9, 1.1))
    want = {}
    for s, own in sounds.items():
        for start in range(160):
            best = None
            for _, sizes in frames.elastic_lengths(q):
                total = sum(sizes)
                if start + total > 160:
                    continue
                win = own[start : start + total]
                run = longest = 0
                for x in win:
                    run = run + 1 if x is None else 0
                    longest = max(longest, run)
                if longest > 3:
                    continue
                for octave in range(-5, 6):
                    at, dists = 0, []
                    for b, size in zip(q.blocks, sizes, strict=True):
                        d = [abs(x - b.midi - 12 * octave) * 100 for x in win[at : at + size] if x is not None]
                        at += size
                        if not d or sum(v <= 70 + 1e-6 for v in d) < 0.5 * size - 1e-9:
                            break
                        dists.append(sum(d) / len(d))
                    else:
                        score = sum(dists) / 2
                        best = min(best, score) if best is not None else score
            if best is not None:
                want[s, start] = best
    got = {(x.sound, x.start): x.score for x in frames.search_pitch(df, q).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got) and got


def test_glides(spark):
    rows = [(0, k, True, 60 + 4 * (k - 19.5) / 20 if 20 <= k < 40 else 50.0) for k in range(60)]
    df = spark.createDataFrame(rows, "sound int, frame int, ok boolean, midi double")
    got = frames.search_pitch(df, frames.PitchQuery((frames.PitchBlock(20, 60.0, 64.0),), tolerance=40, coverage=0.9)).collect()
    assert 20 in {r.start for r in got} and min(got, key=lambda r: r.score).start == 20


def test_window_search_edges(spark):
    b = subtitles.synth_blocks(spark, 60)
    any_ = sequences.BlockCondition()
    n = b.count()
    assert sequences.search_blocks(b, sequences.WindowQuery((any_,))).count() == n
    assert sequences.search_blocks(b, sequences.WindowQuery((any_, any_), cross_pauses=True, head=True)).count() == 60
    assert sequences.search_blocks(b, sequences.WindowQuery((any_, any_), cross_pauses=True, tail=True)).count() == 60
    assert sequences.search_blocks(b, sequences.WindowQuery((sequences.BlockCondition(character="x"),))).count() == 0


def test_subtitles(spark):
    srt = "﻿1\r\n00:00:01,500 --> 00:00:02,000\r\nhello\r\nthere\r\n\r\nno time here\r\n\r\n-0:00:01.0 --> 00:00:03,25\r\nx"
    ass = "[Script Info]\nDialogue: no\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.50,0:00:02.00,{\\i1}a, b\\Nc\\hd\nComment: 0,0:00:01.50,0:00:02.00,x"
    cues, problems = subtitles.parse_srt(spark.createDataFrame([("p", srt)], "path string, content string"))
    assert [(r.order, r.ref, r.start, r.end, r.text) for r in cues.orderBy("order").collect()] == [(0, "1", 1.5, 2.0, "hello\nthere"), (1, None, -1.0, 3.25, "x")]
    assert [(r.line, r.reason) for r in problems.collect()] == [(6, "no-timing")]
    r = subtitles.parse_ass(spark.createDataFrame([("p", ass)], "path string, content string"))[0].collect()
    assert [(x.start, x.end, x.text) for x in r] == [(1.5, 2.0, "a, b\nc d")]


def test_cues_and_names(spark):
    cases = [("(door)", "sfx", [], "", "door", False), ("（花子）こんにちは", "line", ["花子"], "こんにちは", "", False), ("(bang)\nwho is it", "line", [], "who is it", "bang", True), ("(a、b) hi\n(c) yo", "line", ["a", "b", "c"], "hi\nyo", "", False), ("(a) hi\nyo", "line", [], "hi\nyo", "", True), ("", "empty", [], "", "", False)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", text.classify_cue(F.col("t")).alias("c")).orderBy("i").collect()
    assert [(r.c.kind, r.c.speakers, r.c.body, r.c.sounds, r.c.withheld) for r in df] == [c[1:] for c in cases]
    r = spark.range(1).select(
        text.to_hiragana(F.lit("カタカナ")).alias("h"), text.norm_text(F.lit("Ａ-b　Ｃ!")).alias("n"), text.morae(F.lit("きょうカー")).alias("m"), text.note_name(F.lit(69.4)).alias("a"), text.midi_of_note(F.lit("Bb2")).alias("b"),
        text.cut_bytes(F.lit("aéx"), 3).alias("c"), text.file_part(F.lit('a/b: "c" . ')).alias("f"), clocks.clock_label(F.lit(61.0005)).alias("l"),
    ).first()
    assert (r.h, r.n, r.m, r.a, r.b, r.c, r.f, r.l) == ("かたかな", "abc", ["きょ", "う", "カ", "ー"], "A4", 46, "a", "a_b_ _c_", "1:01.000")


def test_undo_restores(spark):
    now = spark.createDataFrame([("a", 1, {"x": "1"}), ("b", 1, {"x": "2"})], "id string, version int, fields map<string,string>")
    batch = spark.createDataFrame([(0, "a", "update", 1, {"x": "9"}), (1, "c", "create", 0, {"x": "5"})], "idx int, id string, op string, version int, fields map<string,string>")
    new, changes = edits.apply_edits(batch, now, 1)
    assert {(r.id, r.version, r.fields["x"]) for r in new.collect()} == {("a", 2, "9"), ("b", 1, "2"), ("c", 1, "5")}
    back = {(r.id, r.op, tuple(sorted(r.fields.items()))) for r in edits.undo(changes, 1).collect()}
    assert back == {("a", "update", (("x", "1"),)), ("c", "delete", (("deleted", "1"),))}
    bad = batch.union(spark.createDataFrame([(2, "b", "update", 7, {"x": "0"})], batch.schema))
    same, none = edits.apply_edits(bad, now, 2)
    assert none.count() == 0 and {(r.id, r.fields["x"]) for r in same.collect()} == {("a", "1"), ("b", "2")}


def test_incremental_refresh_equals_full(spark, tmp_path):
    samples = spark.createDataFrame([(i, "s%d" % (i % 3), float(i), i + 5.0) for i in range(30)], "id int, source_id string, start double, end double")
    src = str(tmp_path / "changes")
    spark.createDataFrame([("s0", 0.0, 8.0), ("s1", 20.0, 21.0)], "source_id string, start double, end double").write.parquet(src)
    stream = spark.readStream.schema("source_id string, start double, end double").parquet(src)
    rebuild = lambda df: df.select(F.col("id").alias("sample_id"), (F.col("start") * 2).alias("v"))
    out = str(tmp_path / "out")
    streams.refresh_stream(stream, samples, rebuild, out, str(tmp_path / "log")).awaitTermination()
    got = {(r.sample_id, r.v) for r in streams.current(spark.read.parquet(out)).collect()}
    want = {(i, i * 2.0) for i in range(30) if (i % 3 == 0 and i < 8) or (i % 3 == 1 and i < 21 and i + 5 > 20)}
    assert got == want


def test_overlong_sentences_are_reported(spark):
    rows = [(s, k, 0.2, 0, 0.0) for s, n in ((1, 4), (2, 128), (3, 129)) for k in range(n)]
    got = rhythm.quantize(spark.createDataFrame(rows, "sample_id long, k long, dur double, pseg long, rest double")).collect()
    assert {r.sample_id for r in got if r.error is None and r.cells} == {1, 2}
    assert [(r.sample_id, r.choice, r.cells, r.error, r.n_blocks) for r in got if r.error] == [(3, None, None, "rhythm-too-many-blocks", 129)]


def test_references_beyond_the_broadcast_bound(spark, monkeypatch):
    r = random.Random(4)
    rows = [(i, i % 3, [r.gauss(i % 3, 1) for _ in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>").withColumn("v", vectors.normalized(F.col("v")))
    run = lambda: sorted(map(tuple, vectors.assign_by_neighbours(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), 5, 0.02).collect()))
    small = run()
    monkeypatch.setattr(vectors, "MAX_BROADCAST", 20)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    large = run()
    assert len(large) == 90 and [x[:2] for x in large] == [x[:2] for x in small]
    assert all(abs(a - b) < 1e-12 for x, y in zip(large, small) for a, b in zip(x[2:], y[2:]))


def test_neighbours_by_products_of_matrices(spark, monkeypatch):
    r = random.Random(9)
    vecs = [[r.gauss(0, 1) for _ in range(5)] for _ in range(40)]
    rows = [(i, i % 4 % 3, vecs[r.randrange(40)]) for i in range(200)] + [(200, 0, None), (201, 1, [1.0, None, 0.0, 0.0, 0.0]), (202, 2, [1.0, 2.0]), (204, 0, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    monkeypatch.setattr(vectors, "ROWS", 7)
    found = vectors.assign_by_neighbours(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), 3, 0.0)
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()

    def product(a, b):
        return None if a is None or b is None or len(a) != len(b) or None in a or None in b else sum(x * y for x, y in zip(a, b))

    got = {x.id: x for x in found.collect()}
    assert set(got) == {i for i, _, _ in rows if i % 4}
    for i, _, v in rows:
        if i % 4 == 0:
            continue
        scores = []
        for label in range(3):
            best = sorted((product(v, w) for j, x, w in rows if j % 4 == 0 and x == label), key=lambda p: (p is None, -(p or 0)))[:3]
            if best:
                scores.append((None if None in best else sum(best) / len(best), label))
        whole = sorted((s for s in scores if s[0] is not None), key=lambda s: (-s[0], s[1]))
        if not whole:
            assert got[i].top is None
            continue
        assert abs(got[i].top - whole[0][0]) < 1e-9 and (got[i].label is None or got[i].label == whole[0][1])
