import math
import random
import re

import pytest

from timelake.llm import mixing, queries

WORDS = {"a": ["the", "and", "of"], "b": ["der", "und", "die"], "c": ["le", "et", "des"]}


def corpus(n=240, seed=2):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        d = r.choices("abc", [6, 3, 1])[0]
        w = [r.choice(WORDS[d]) if r.random() < 0.6 else "x%d" % r.randint(0, 50) for _ in range(r.randint(1, 60))]
        rows.append((k, " ".join(w), d))
    return rows


def test_posteriors_rates_and_totals(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame([(k, d) for k, _, d in rows if k % 3 == 0] + [(None, "a"), (3, None)], "doc_id long, domain string")
    model = mixing.learn(docs, labelled)
    got = {r.doc_id: r for r in mixing.mix(docs, model, {"a": 1, "b": 1, "c": 1}).collect()}
    right = sum(max(range(3), key=lambda i: got[k].p[i]) == "abc".index(d) for k, _, d in rows)
    assert right >= 0.95 * len(rows) and all(abs(sum(r.p) - 1) < 0.01 for r in got.values())
    table = {r[0]: r[1:] for r in model.table}
    for k, t, _ in rows[:40]:  # brute force
        words = [w for w in re.split(r"[\s.,]+", t.lower()) if w]
        z = [sum(table[w][i] - table[w][0] for w in words if w in table) * mixing.TEMPER + model.prior[i] for i in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert got[k].tokens == len(words) and all(abs(x / sum(e) - p) < 0.002 for x, p in zip(e, got[k].p, strict=True))
    total = sum(r.tokens for r in got.values())
    for i in range(3):
        assert abs(sum(r.rate * r.tokens * r.p[i] for r in got.values()) - total / 3) < 0.01 * total
    assert all(0 <= r.rate and abs(r.n_copies - r.rate) < 1 and r.unmet <= 1e-4 for r in got.values())


def test_small_domains_reach_their_targets_and_bounds_are_told(spark):
    # one domain has 200 times the tokens of another, and both are asked for half
    rows = [(k, k % 50 + 1, [1.0, 0.0] if k % 20 else [0.0, 1.0]) for k in range(400)] + [(1000 + k, 5000, [0.9, 0.1]) for k in range(8)]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rates, fit = mixing.fit_rates(members, [0.5, 0.5])
    assert fit.met and fit.rounds < 60 and fit.unmet <= 1e-4 and rates.count() == len(rows)
    total = sum(r[1] for r in rows)
    for i in range(2):
        assert abs(sum(r.rate * r.tokens * r.p[i] for r in rates.collect()) - total / 2) < 0.001 * total
    best, tight = mixing.fit_rates(members, [0.5, 0.5], high=2.0)
    assert not tight.met and tight.unmet > 0.01 and max(r.rate for r in best.collect()) == 2.0
    # brute force over the two rates that matter: no step improves the weighted distance
    assert {tuple(r.p): r.rate for r in best.collect()}[0.0, 1.0] == 2.0


def test_bounds_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the of"), (2, "der und"), (3, None), (4, ""), (5, "the " * 50000), (5, "the " * 50000), (None, "the")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, domain string")
    model = mixing.learn(docs, labelled)
    got = {r.doc_id: r for r in mixing.mix(docs, model, {"a": 0.5, "b": 0.5}, low=1.0, high=3.0).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[3].tokens == got[4].tokens == 0 and all(1 <= r.rate <= 3 for r in got.values()) and got[2].rate == 3
    assert got[5].tokens == 100_000 and got[1].unmet > 0.4
    assert mixing.mix(docs.limit(0), model, {"a": 1.0}).count() == 0
    with pytest.raises(ValueError, match="no labelled rows"):
        mixing.mix(docs, model, {"z": 1.0})
    plan = mixing.posteriors(docs, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables_and_labels_without_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the of", "en", 0.5), (2, "der und", "de", 0.5), (3, " .", "fr", 0.5)], "doc_id long, text string, lang string, rate double")
    none = mixing.learn(docs, spark.createDataFrame([], "doc_id long, domain string"))
    assert none.domains == ()
    got = mixing.mix(docs, none, {"en": 1.0}).collect()
    assert {(r.doc_id, r.tokens, tuple(r.p), r.rate, r.unmet) for r in got} == {(1, 2, (), 1.0, 1.0), (2, 2, (), 1.0, 1.0), (3, 0, (), 1.0, 1.0)}
    # labelled texts without words: the prior alone
    prior = mixing.learn(docs, spark.createDataFrame([(3, "fr"), (3, "fr"), (4, "en")], "doc_id long, domain string"))
    assert {tuple(r.p) for r in mixing.posteriors(docs, prior).collect()} == {(0.5, 0.5)}
    # a wanted domain without labels is told, the others are fitted
    model = mixing.learn(docs, spark.createDataFrame([(1, "en"), (2, "de")], "doc_id long, domain string"))
    assert {r.unmet for r in mixing.mix(docs, model, {"en": 0.3, "de": 0.3, "es": 0.4}, strict=False).collect()} == {0.4}
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    empty = queries.op9_mixing(spark, str(tmp_path))
    assert empty.count() == 0 and {"doc_id", "rate", "p_de", "p_en", "p_es", "p_fr"} <= set(empty.columns)
