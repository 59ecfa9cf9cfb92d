import re

import numpy as np
import pytest

from timelake.llm import licenses, queries


def brute(text):
    """(n_words, sorted base starts, base labels) by the contract's words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(i for i, _ in places), sorted({x for _, x in places})


def noisy(words, every):
    """A notice with a word put in at every so many words."""
    out = []
    for i, w in enumerate(words):
        out += [w] + ["extra"] * (i % every == every - 1)
    return " ".join(out)


TEXTS = [
    None,
    "",
    "MIT License. mit-license! The MIT\n\nLICENSE",
    "mit licenses, émit license, mit été license",
    "GNU General Public License, Apache License",
    "general general public license public license",
    "Licensed under CC BY-NC 4.0.",
    "word " * 70_000 + "Apache License " + "wört " * 70_000 + "MIT license",
    "before it " + licenses.NOTICES["isc"].upper() + " after it",
    noisy(licenses.NOTICES["bsd"].split(), 9),
    " ".join(licenses.NOTICES["mit"].split()[:20]),
    "public license of the general mit",
    "MIT License " * 300,
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, score string, k1 int").repartition(3)


@pytest.mark.parametrize("most", [0, 50_000])
def test_places_and_labels(spark, monkeypatch, most):
    monkeypatch.setattr(licenses, "BROADCAST", most)
    rows = [*enumerate(TEXTS), (2, TEXTS[2]), (2, TEXTS[4]), (None, TEXTS[4]), (None, TEXTS[4]), (None, None)]
    got = licenses.scan(frame(spark, rows)).collect()
    plain = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words, sorted(s.start for s in r.spans if s.base), sorted({s.label for s in r.spans if s.base}))
    assert sorted(map(plain, got)) == sorted((i is None, i or 0, *brute(t)) for i, t in rows)
    assert all(r.k1 == 1 and 0 <= r.score <= 1 for r in got)
    labels = {r.doc_id: {s.label for s in r.spans} for r in got if r.doc_id is not None and r.doc_id > 5}
    assert labels[6] == {"cc-by-nc"} and labels[8] == {"isc"} and labels[9] == {"bsd"} and labels[10] == labels[11] == set()
    span = next(s for r in got if r.doc_id == 8 for s in r.spans)
    assert (span.start, span.end, span.score) == (2, 2 + len(licenses.words_of(licenses.NOTICES["isc"])), 1.0)
    assert {s.label: s.score for r in got if r.doc_id == 9 for s in r.spans}["bsd"] >= 0.9


def test_verify_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(200):
        words, t = r.integers(0, 3, r.integers(1, 12)), r.integers(0, 3, r.integers(1, 8))
        low, high = sorted(r.integers(-9, 13, 2))
        met = {i for d in range(low, high + 1) for i in range(len(t)) if 0 <= i + d < len(words) and words[i + d] == t[i]}
        at = [i + d for d in range(low, high + 1) for i in range(len(t)) if 0 <= i + d < len(words) and words[i + d] == t[i]]
        share, first, end = licenses.verify(words, t, int(low), int(high))
        assert share == len(met) / len(t) and (not at or (first, end) == (min(at), max(at) + 1))


def test_empty_table(spark):
    assert licenses.scan(frame(spark, [])).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op12_licenses(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        n, starts, labels = brute(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 and (r.score == 1) >= bool(starts)
