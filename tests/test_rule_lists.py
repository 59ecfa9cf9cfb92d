import pytest
from pyspark.sql import functions as F

from timelake.functions import rules


def test_rule_lists_are_checked(spark):
    good = [r"^(?P<work>.+?) - (?P<episode>[0-9]+)", r"(?<episode>S[0-9]+)"]
    assert rules.checked(good, ("work", "episode"), spark=spark) == tuple(good)
    for bad, reason in (([""], "not-text"), ([5], "not-text"), (["("], "syntax"), (["(?P<x>a)"], "missing-group"), (["a" * 3000], "too-long"), (["(?P<work>(?&work)a)"], "syntax"), ([r"(?P<work>(a|aa)+)$"], "timeout")):
        with pytest.raises(rules.RuleError) as e:
            rules.checked([good[0], *bad], ("work", "episode"), spark=spark)
        assert (e.value.reason, e.value.place) == (reason, 2)
    with pytest.raises(rules.RuleError, match="too-many"):
        rules.checked(good * 20, ("work",))
    with pytest.raises(rules.RuleError, match="missing-group"):
        rules.checked([good[1]], ("episode",), required=("work",))


def test_names_by_the_default_layouts(spark):
    kept = rules.checked([r"^(?:\[[^\[\]]+\]\s*)?(?P<work>[^\[\]\s][^\[\]]*?)\s*\[(?P<episode>(?!(?:19|20)[0-9]{2}\])[0-9]{1,4}(?:v[0-9]+)?)\]", r"^(?:\[[^\[\]]+\]\s*)?(?P<work>[^\[\]\s][^\[\]]*?)\s+-\s+(?P<episode>[0-9]{1,4}(?:v[0-9]+)?)(?=$|[^A-Za-z0-9])"], ("work", "episode"), spark=spark)
    names = {"[VCB] Some Name [01v2][1080p]": ("Some Name", "01v2", 0), "[Er] FX Kun - 04 [1080p CR]": ("FX Kun", "04", 1), "Name [2019]": (None, "Name [2019]", None), "plain": (None, "plain", None), "": (None, "", None)}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: (r.r.work, r.r.episode, r.r.rule) for r in df.select("n", rules.work_and_episode(F.col("n"), kept).alias("r")).collect()} == names
    assert df.select(rules.first_match(F.col("n"), (), ("work",)).alias("m")).where("m is not null").count() == 0


CUES = {
    "（ドア（重い））（足音）": ("sfx", [], "", "ドア（重い） / 足音", False),
    "（京子）こんにちは": ("line", ["京子"], "こんにちは", "", False),
    "台詞（結衣）続き": ("line", [], "台詞続き", "", False),
    "（京子(きょうこ)たち）アッカリ": ("line", ["京子たち"], "アッカリ", "", False),
    "（a）（b、c）words": ("line", ["a", "b", "c"], "words", "", False),
    "（ドア）\nウワーッ": ("line", [], "ウワーッ", "", True),
    "（ドア）\n（a）ウワーッ": ("line", ["a"], "ウワーッ", "ドア", False),
    "（a）x\ny": ("line", [], "x\ny", "", True),
    "（a）x\n（b）y\n（a）z": ("line", ["a", "b"], "x\ny\nz", "", False),
    "♪～": ("sfx", [], "", "♪～", False),
    "": ("empty", [], "", "", False),
    "a) b": ("line", [], "a) b", "", False),
    "open （never closed (x)": ("line", [], "open （never closed (x)", "", False),
    "(" * 30 + "deep" + ")" * 30: ("sfx", [], "", "(" * 29 + "deep" + ")" * 29, False),
    "（長い" + "x" * 400 + "\n続き）言う": ("line", ["長い" + "x" * 400 + " 続き"], "言う", "", False),
}


def test_cues_of_any_depth(spark):
    df = spark.createDataFrame([(c,) for c in CUES], "t string")
    got = {r.t: (r.c.kind, r.c.speakers, r.c.body, r.c.sounds, r.c.withheld) for r in df.select("t", rules.classify_text(F.col("t")).alias("c")).collect()}
    for cue, want in CUES.items():
        assert got[cue] == want, cue
    own = rules.CueRules(separators=";", music="", joiner="+")
    r = df.limit(1).select(rules.classify_text(F.lit("（a;b、c）x"), own).alias("a"), rules.classify_text(F.lit("♪ la"), own).alias("b"), rules.classify_text(F.lit("（a）（b）"), own).alias("c")).first()
    assert r.a.speakers == ["a", "b、c"] and r.b.kind == "line" and r.c.sounds == "a+b"
