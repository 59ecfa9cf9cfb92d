import random

from pyspark.sql import functions as F

from timelake.llm import quality


def corpus(n=400, seed=9):
    r = random.Random(seed)
    words = ["".join(r.choice(["the", "an", "re", "on", "ti", "er"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    rows = []
    for k in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 80))]
        label = 0 if k % 4 == 0 else 1
        if label == 0:
            w = r.choice([[x + " |" for x in w], [x + "$$$" for x in w], [x for y in w for x in [y] * 9]])
        rows.append((k, " ".join(w), label))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 5] + [(1, None), (2, 7), (None, 1), (3, rows[3][2])], "doc_id long, label int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(got[k] >= quality.THRESHOLD) == (y == 1) for k, _, y in rows if k % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    again = {r.doc_id: r.score for r in quality.score(docs.orderBy(F.desc("doc_id")), model).collect()}
    assert all(abs(got[k] - again[k]) < 1e-6 for k in got)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, None, 9.0), (2, "", 1.0), (3, " \n", 1.0), (4, "ab " * 300000, 1.0), (4, "é", 2.0)], "doc_id long, text string, score double")
    model = quality.fit([b"good text here", b"bad | bad |"], [1, 0])
    got = [(r.doc_id, r.score) for r in quality.score(docs, model).orderBy("doc_id").collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for _, s in got) and got[0][1] == got[1][1] == got[2][1]
    assert quality.score(docs.limit(0), model).count() == 0
    one = quality.train(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    assert [r.score for r in quality.score(docs, one).collect()] == [0.5] * 5


def test_held_out_rows_of_the_tables(spark):
    from timelake.llm import queries

    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, r.score, truth[r.doc_id]) for r in queries.op4_quality(spark, sf).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 50 and sum(p == y for p, _, y in held) >= 0.95 * len(held)
    good, bad = [s for _, s, y in held if y == 1], [s for _, s, y in held if y == 0]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = corpus(120)
    docs = spark.createDataFrame([(k, t if k != 7 else t + " word" * 20_000) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, label int")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append(sum(map(len, texts))) or quality.Model(quality.np.zeros(1 << quality.BITS), 0.0))
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "BYTES", 20_000)
    quality.train(docs, labels)
    assert seen[0] > 100_000 and 10_000 < seen[1] <= 20_000
