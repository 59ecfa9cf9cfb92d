import random

import pytest

from timelake.llm import jaccard


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows):
    sets = {k: grams(t) for k, t in rows}
    label = {k: k for k in sets}
    edges = []
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                edges.append((a, b))
    while True:
        old = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if old == label:
            return label, edges


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randint(0, 400)
    rows, k = [], 0
    for group in range(12):
        base = [word() for _ in range(r.choice([3, 8, 60, 200]))]
        for copy in range(r.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                w[r.randrange(len(w))] = word()
            rows.append((k, " ".join(w)))
            k += r.randint(1, 3)
    return rows + [(900, None), (901, ""), (902, " \n"), (903, rows[0][1].upper()), (904, "x"), (905, "x"), (906, "y")]


@pytest.mark.parametrize(("small", "block"), [(1, 4), (8, 128), (1000, 16)])
def test_classes_and_links_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed=block)
    got = {r.doc_id: r for r in jaccard.jaccard_classes(spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, id int").repartition(3)).collect()}
    label, edges = brute(rows)
    assert {k: r.class_id for k, r in got.items()} == label
    assert {k: r.n_links for k, r in got.items()} == {k: sum(k in e for e in edges) for k in label}
    kept = jaccard.keep_one(spark.createDataFrame(rows + [(None, "q"), (904, "x")], "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(k for k, c in label.items() if k == c)
    assert sum(r.doc_id is None for r in kept) == 1


@pytest.mark.parametrize(("block", "most"), [(2, 1 << 20), (128, 1 << 20), (128, 500)])
def test_every_link_of_large_groups_is_counted(spark, monkeypatch, block, most):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "GRAMS", most)
    r = random.Random(block)
    base = ["b%d" % i for i in range(120)]
    rows = corpus(seed=7)
    for k in range(60):  # near copies of growing length, some equal
        w = base[: 90 + k // 2]
        if k % 3:
            w[r.randrange(len(w))] = "x%d" % k
        rows.append((1000 + k, " ".join(w)))
    _, edges = brute(rows)
    got = {r.doc_id: r.n_links for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {k: sum(k in e for e in edges) for k, _ in rows}


def test_a_key_with_several_texts(spark):
    one, two = " ".join("a%d" % i for i in range(40)), " ".join("b%d" % i for i in range(40))
    rows = [(7, one), (7, two), (3, two), (9, one), (9, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_copies, r.n_links) for r in jaccard.jaccard_classes(df).collect()}
    assert got == {7: (3, 2, 1), 3: (3, 2, 1), 9: (7, 2, 1)}
    assert sorted((r.doc_id, r.text[:2]) for r in jaccard.keep_one(df.withColumn("_key", df["doc_id"])).collect()) == [(3, "b0"), (7, "a0")]


def test_empty(spark):
    assert jaccard.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bands():
    bands, rows = jaccard.bands_for(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 110
