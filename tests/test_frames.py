"""The one-pass frame search: pieces with what windows reach beyond them, holes, and plans that shuffle once."""

import random

import pytest

from timelake.operators import frames


def sounds(spark, n=700, seed=4, hole=None):
    r, rows, m = random.Random(seed), [], 60.0
    for s in range(3):
        for k in range(n if s == 0 else 150):
            if k % 20 == 0:
                m = r.choice([60.0, 62.0, 74.0, 48.0])
            x = None if r.random() < 0.1 else m + r.uniform(-0.5, 0.5)
            if (s, k) != hole:
                rows.append((f"s{s}", k, x is not None, x))
    r.shuffle(rows)
    return spark.createDataFrame(rows, "sound string, frame int, ok boolean, midi double").repartition(5)


B = frames.PitchBlock
QUERIES = [
    frames.PitchQuery((B(12, 60.0), B(10, 62.0)), tolerance=70, coverage=0.5, max_gap=0.03),
    frames.PitchQuery((B(12, 60.0), B(10, 62.0)), tolerance=70, coverage=0.5, octave_free=True, elastic=(0.85, 1.2)),
    frames.PitchQuery((B(14, 60.0, 62.0), B(10, 62.0)), tolerance=150, coverage=0.5, elastic=(0.9, 1.1)),
]


@pytest.mark.parametrize("query", QUERIES)
def test_pieces_of_any_size_find_the_same(spark, monkeypatch, query):
    df = sounds(spark).cache()
    run = lambda: sorted(map(tuple, frames.search_pitch(df, query).collect()))
    whole = run()
    assert len(whole) > 10
    for size in (37, 200):
        monkeypatch.setattr(frames, "PIECE", size)
        assert run() == whole


def test_windows_have_no_holes(spark):
    query = QUERIES[0]
    hits = {r.start for r in frames.search_pitch(sounds(spark), query).collect() if r.sound == "s0"}
    at = min(s for s in hits if s > 50) + 5
    cut = {r.start for r in frames.search_pitch(sounds(spark, hole=(0, at)), query).collect() if r.sound == "s0"}
    assert cut == {s for s in hits if not s <= at < s + 22} != hits


def test_one_shuffle_whatever_the_variants(spark):
    plan = frames.search_pitch(sounds(spark), QUERIES[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("hashpartitioning(sound") == 1 and "Window" not in plan


def test_lengths_are_in_proportion_to_the_whole():
    query = frames.PitchQuery((B(10, 60.0), B(13, 62.0)), elastic=(0.8, 1.25))
    sizes = [s for _, s in frames.elastic_lengths(query)]
    totals = [sum(s) for s in sizes]
    assert totals == list(range(18, 30)) and all(s[0] == int(10 * t / 23 + 0.5) for s, t in zip(sizes, totals, strict=True))


def test_nothing_to_find(spark):
    empty = sounds(spark).limit(0)
    assert frames.search_pitch(empty, QUERIES[1]).count() == 0
    silent = spark.createDataFrame([("s", k, False, None) for k in range(60)], "sound string, frame int, ok boolean, midi double")
    assert frames.search_pitch(silent, QUERIES[1]).count() == 0


def test_hits_inside_spans_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(frames, "PIECE", 50)
    hits = spark.createDataFrame([("a", s, 20) for s in range(0, 300, 7)] + [("b", 5, 20)], "sound string, start int, frames int")
    spans = spark.createDataFrame([("a", 30, 140), ("a", 200, 230), ("c", 0, 99)], "sound string, f_start int, f_end int")
    got = {(r.sound, r.start) for r in frames.allowed_starts(hits, spans).collect()}
    assert got == {("a", s) for s in range(0, 300, 7) if 30 <= s <= 120 or 200 <= s <= 210}
