"""Undo and history against a step-by-step simulation, interval differences, digests, fixed results, cue lines, pauses."""

import random

import pytest
from pyspark.sql import functions as F

from timelake.functions import text
from timelake.operators import catalog, edits, history, intervals, measures
from timelake.sources import subtitles


def frames(spark, log, state):
    e = spark.createDataFrame([(x["id"], x["seq"], x["label"], x["actor"], x["session"], x["undo_of"]) for x in log], "edit_id long, seq long, label string, actor string, session string, undo_of long")
    c = spark.createDataFrame([(x["id"], i, o, op, b, a) for x in log for i, (o, op, b, a) in enumerate(x["changes"])], "edit_id long, idx int, id string, op string, before map<string,string>, after map<string,string>")
    now = spark.createDataFrame([(o, v, f) for o, (v, f) in state.items()], "id string, version int, fields map<string,string>")
    return e, c, now


def play(seed, n=40):
    """A random history over a few objects, and the state it leaves."""
    r, log, state = random.Random(seed), [], {f"o{i}": (1, {"x": "0", "y": "0"}) for i in range(6)}
    for seq in range(n):
        kind = r.random()
        entry = {"id": 1000 + seq, "seq": seq, "label": "barrier" if kind < 0.05 else "set", "actor": r.choice(["user", "agent", "script"]), "session": r.choice("ab"), "undo_of": None, "changes": []}
        for _ in range(0 if kind < 0.05 else r.randint(1, 3)):
            if r.random() < 0.15:
                o = f"n{seq}-{len(entry['changes'])}"
                entry["changes"].append((o, "create", {}, {"x": "1", "deleted": "0"}))
                state[o] = (1, {"x": "1", "deleted": "0"})
                continue
            o, f = r.choice(list(state)), r.choice("xy")
            v, fields = state[o]
            new = str(r.randint(0, 2))
            entry["changes"].append((o, "update", {f: fields.get(f)}, {f: new}))
            state[o] = (v + 1, {**fields, f: new})
        if r.random() < 0.1 and log and log[-1]["undo_of"] is None and log[-1]["label"] != "barrier" and not any(x["undo_of"] == log[-1]["id"] for x in log):
            entry["undo_of"], entry["changes"] = log[-1]["id"], []
        log.append(entry)
    return log, state


def holds(entry, state):
    return all(o in state and all(state[o][1].get(k) == v for k, v in after.items()) for o, _, _, after in entry["changes"])


def take_back(entry, state):
    for o, op, before, _ in entry["changes"]:
        v, fields = state[o]
        state[o] = (v + 1, {**fields, **({"deleted": "1"} if op == "create" else before)})


def barrier_of(log):
    return max([x["seq"] for x in log if x["label"] == "barrier"], default=-1)


def reasons(log, state):
    undone = {x["undo_of"] for x in log}
    out = {}
    for x in log:
        out[x["id"]] = "is-undo" if x["undo_of"] is not None else "already-undone" if x["id"] in undone else "before-barrier" if x["seq"] <= barrier_of(log) else None if holds(x, state) else "changed-later"
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_history_and_undo_against_a_simulation(spark, seed):
    log, state = play(seed)
    e, c, now = frames(spark, log, state)
    want = reasons(log, state)
    assert {r.edit_id: r.reason for r in history.history(e, c, now).collect()} == want
    assert {r.edit_id for r in history.history(e, c, now, actor="agent", session="a").collect()} == {x["id"] for x in log if x["actor"] == "agent" and x["session"] == "a"}
    able = [x for x in log if want[x["id"]] is None]
    plan = history.undo_latest(e, c, now).collect()
    assert {r.edit_id for r in plan} == ({able[-1]["id"]} if able and able[-1]["changes"] else set())
    if plan:
        assert {(r.id, r.version, tuple(sorted(r.fields.items(), key=str))) for r in plan} == {(o, state[o][0], tuple(sorted(({"deleted": "1"} if op == "create" else b).items(), key=str))) for o, op, b, _ in able[-1]["changes"]}
    for x in (log[0], next((x for x in log if want[x["id"]] == "changed-later"), log[-1])):
        assert {r.error for r in history.undo_one(e, c, now, x["id"]).collect()} <= {want[x["id"]]}
    assert [r.error for r in history.undo_one(e, c, now, 5).collect()] == ["unknown"]


@pytest.mark.parametrize("seed", range(4, 10))
def test_session_undo_against_a_simulation(spark, seed):
    log, state = play(seed, 24)
    if seed % 2:  # a last stretch of the session alone, so that several edits go
        more, _ = play(seed + 100, 6)
        for x in more:
            x.update(id=x["id"] + 5000, seq=x["seq"] + 100, actor="agent", session="a", label="set", undo_of=None)
            x["changes"] = [(o, "update", {"x": state[o][1].get("x")}, {"x": str(i)}) for i, o in enumerate(random.Random(x["seq"]).sample(sorted(state), 2))]
            for o, _, _, after in x["changes"]:
                state[o] = (state[o][0] + 1, {**state[o][1], **after})
            log.append(x)
    e, c, now = frames(spark, log, state)
    undone_before = {x["undo_of"] for x in log}
    mine = [x for x in log if x["session"] == "a" and x["actor"] in history.AUTOMATIC and x["undo_of"] is None and x["id"] not in undone_before and x["seq"] > barrier_of(log)]
    then, gone, blocked = dict(state), [], None
    for x in reversed(mine):
        if not holds(x, then):
            blocked = x["id"]
            break
        take_back(x, then)
        gone.append(x["id"])
    got, summary, values = history.undo_session(e, c, now, "a")
    assert {r.edit_id for r in got.collect()} == set(gone)
    s = summary.first()
    assert (s.undone, s.blocked, s.remaining) == (len(gone), blocked, len(mine) - len(gone))
    after = {o: dict(f) for o, (_, f) in state.items()}
    for r in values.collect():
        after[r.id][r.field] = r.value
    for o, (_, fields) in then.items():
        if fields.get("deleted") != "1":  # what is deleted anyway keeps no other fields to compare
            assert {k: v for k, v in after[o].items() if v is not None} == {k: v for k, v in fields.items() if v is not None}, o
        else:
            assert after[o]["deleted"] == "1"


def test_difference_against_points(spark):
    r = random.Random(3)
    own = [(i, f"s{i % 2}", r.randint(0, 300), r.randint(1, 60)) for i in range(40)]
    cut = [(f"s{r.randint(0, 1)}", r.randint(0, 300), r.randint(1, 30)) for _ in range(20)]
    df = spark.createDataFrame([(i, s, float(a), float(a + n)) for i, s, a, n in own], "id int, source_id string, start double, end double")
    ranges = spark.createDataFrame([(s, float(a), float(a + n)) for s, a, n in cut], "source_id string, start double, end double")
    got = {}
    for x in intervals.difference(df, ranges).orderBy("id", "piece").collect():
        got.setdefault(x.id, []).append((x.start, x.end, x.cut))
    for i, s, a, n in own:
        left = [t for t in range(a, a + n) if not any(s == z and b <= t < b + m for z, b, m in cut)]
        pieces = []
        for t in left:
            if pieces and pieces[-1][1] == t:
                pieces[-1][1] = t + 1
            else:
                pieces.append([t, t + 1])
        name = lambda x, y, a=a, n=n: {(False, False): "none", (True, False): "left", (False, True): "right", (True, True): "both"}[x > a, y < a + n]
        assert got.get(i, []) == [(float(x), float(y), name(x, y)) for x, y in pieces]


def test_adding_a_segment(spark):
    old = spark.createDataFrame([(1, "s", 0.0, 4.0, 3), (2, "s", 6.0, 9.0, 1), (3, "s", 20.0, 30.0, 1), (4, "s", 40.0, 41.0, 2)], "id long, source_id string, start double, end double, version int")
    new = spark.createDataFrame([(10, "s", 3.0, 7.0), (11, "s", 22.0, 25.0), (12, "s", 50.0, 51.0), (13, "s", 39.0, 42.0), (14, "s", 4.0, 6.0)], "id long, source_id string, start double, end double")
    run = lambda how: sorted(((r.new_id, r.op or "", r.id or 0, r.version, r.start, r.end, r.deleted, r.error) for r in intervals.plan_add(new, old, how).collect()), key=str)
    cut = run("cut")
    assert (10, "update", 1, 3, None, 3.0, False, None) in cut and (10, "update", 2, 1, 7.0, None, False, None) in cut and (10, "create", 0, None, 3.0, 7.0, False, None) in cut
    assert [x for x in cut if x[0] in (11, 13)] == [(11, "", 0, None, None, None, False, "segment-overlap"), (13, "", 0, None, None, None, False, "segment-overlap")]
    assert {x[0] for x in cut if x[1] == "create"} == {10, 12, 14}
    assert {(x[0], x[2]) for x in run("replace") if x[6]} == {(10, 1), (10, 2), (11, 3), (13, 4)}
    assert {x[0]: x[7] for x in run(None)} == {10: "segment-overlap", 11: "segment-overlap", 12: None, 13: "segment-overlap", 14: None}


def test_digests_differ_exactly_when_the_rows_do(spark):
    schema = "g int, a string, b string, c double"
    pools = [[("x", None, 1.0)], [(None, "x", 1.0)], [("a|b", "c", 1.0)], [("a", "b|c", 1.0)], [("~", None, 1.0)], [(None, None, 1.0)], [("1:a", "", 1.0)], [("", "1:a", 1.0)], [("x", None, 1.0)] * 2, [("x", None, 1.0), (None, "x", 1.0)], [(None, "x", 1.0), ("x", None, 1.0)], [("x", None, None)], [("x", None, float("nan"))], [("-", "-", 0.0)], [("é", "1", 1.5)]]
    rows = [(g, *r) for g, p in enumerate(pools) for r in p]
    got = {r.g: r.signature for r in catalog.content_signature(spark.createDataFrame(rows, schema).repartition(3), "g", "a", "b", "c").collect()}
    keys = [sorted(map(repr, p)) for p in pools]
    for i in range(len(pools)):
        for j in range(i):
            assert (got[i] == got[j]) == (keys[i] == keys[j]), (pools[i], pools[j])
    token = lambda df: edits.plan_token(df, "a", "b", "c").first().token
    df = spark.createDataFrame(rows, schema)
    assert token(df) == token(df.orderBy(F.desc("g")).repartition(5)) != token(df.where("g > 0"))
    odd = spark.createDataFrame([({"k": None, "j": "1"}, [1, None], b"\x01", 1)], "m map<string,string>, l array<int>, b binary, i int")
    assert len({catalog.content_signature(odd.withColumn(c, F.lit(None).cast(odd.schema[c].dataType)), "i", "m", "l", "b").first().signature for c in "mlb"}) == 3
    empty = df.limit(0)
    assert token(empty) == token(empty) and len(token(empty)) == 64


def test_fixed_results_are_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    hits = spark.createDataFrame([(1, r, 0.0, 1.0, 0.5) for r in range(2500)] + [(2, 2500, 0.0, 1.0, 0.6)], "sample_id int, rank int, start double, end double, score double")
    subtitles.write_result(hits, "r1", path)
    subtitles.write_result(hits.where("sample_id = 2"), "r2", path)
    subtitles.write_result(hits, "r1", path)  # again
    rows = subtitles.read_result(spark, "r1", path).collect()
    assert sorted((r.sample_id, r.part, len(r.hits)) for r in rows) == [(1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 2, 1)]
    broken = hits.withColumn("score", F.when(F.col("rank") == 7, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        subtitles.write_result(broken, "r1", path)
    assert subtitles.read_result(spark, "r1", path).count() == 4 and spark.read.parquet(path).count() == 5
    with pytest.raises(FileNotFoundError):
        subtitles.read_result(spark, "r3", path)


def test_cue_lines_at_any_depth_and_length(spark):
    deep = "(" * 40 + "a\nb" + ")" * 40
    cases = {"a\nb": ["a", "b"], f"{deep}\nc": [deep.replace("\n", " "), "c"], "(" + "x" * 500 + "\n" + "y" * 500 + ")z\nw": ["(" + "x" * 500 + " " + "y" * 500 + ")z", "w"], "a)\n(b\n(c)\nd)\ne": ["a)", "(b (c) d)", "e"], "（a\nb)\nc": ["（a b)", "c"], "(a\nb": ["(a b"], "": [], "\n \n": []}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.l for r in df.select("t", text.cue_lines(F.col("t")).alias("l")).collect()} == cases


def test_pauses_leave_closures_and_silence_around_out(spark):
    quiet = {1: [(0, 30), (60, 80), (100, 115), (140, 160)], 2: [(0, 50)]}
    rows = [(s, k, 0.0 if any(a <= k < b for a, b in q) else 1.0) for s, q in quiet.items() for k in range(160)]
    f = spark.createDataFrame(rows, "sample_id int, k int, rms double")
    phones = spark.createDataFrame([(1, "a", 0.15, 0.6), (1, "cl", 0.65, 0.7), (1, "o", 0.8, 1.5)], "sample_id int, label string, start double, end double")
    plain = {(r.sample_id, r.start, r.end) for r in measures.detect_pauses(f).collect()}
    assert (1, 0.62, 0.78) in plain and (1, 0.02, 0.28) in plain and (2, 0.02, 0.48) in plain
    assert {(r.sample_id, r.start, r.end) for r in measures.detect_pauses(f, phones=phones).collect()} == {(1, 0.17, 0.28), (1, 1.02, 1.13)}


def test_names_are_trimmed_of_spaces_alone(spark):
    df = spark.createDataFrame([(" 0a , 1b,2c2 ,,0a",)], "n string")
    assert df.select(text.split_names(F.col("n"))).first()[0] == ["0a", "1b", "2c2"]


def test_a_session_is_judged_once(spark):
    e = spark.createDataFrame([(1, 1, "set", "agent", "s", None), (2, 2, "set", "agent", "s", None)], "edit_id int, seq int, label string, actor string, session string, undo_of int")
    c = spark.createDataFrame([(1, 0, "a", "update", {"f": "0"}, {"f": "1"}), (2, 0, "a", "update", {"f": "1"}, {"f": "2"}), (2, 1, "a", "update", {"f": "1"}, {"f": None}), (1, 1, "b", "update", {"f": "0"}, {"f": None})], "edit_id int, idx int, id string, op string, before map<string,string>, after map<string,string>")
    now = spark.createDataFrame([("a", 2, {"f": "2"}), ("b", 2, {"f": None})], "id string, version int, fields map<string,string>")
    summary = history.undo_session(e, c, now, "s")[1]
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "edit_id" in plan and "Generate" not in plan
    assert tuple(summary.first()) == (0, 2, 2)  # one edit that sets a field twice, to a value and to none, doesn't hold
    plan = history.history(e, c, now)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan
    assert [r.reason for r in history.history(e, c, now).orderBy("seq").collect()] == ["changed-later", "changed-later"]
