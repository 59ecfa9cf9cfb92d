import hashlib
import os

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from timelake.llm import bpe
from timelake.llm.queries import vocab_path

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.quality_stage(spark, docs, SF)
    assert good.columns == cp.COLUMNS and 0 < good.count() < docs.count()
    one = cp.near_duplicate_stage(spark, good, SF)
    sets = {}
    for r in one.collect():
        w = r.text.lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids = sorted(sets)
    assert not [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    clean = cp.pii_stage(spark, one, SF)
    assert clean.count() == one.count() and clean.where(F.col("text").rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[a-z]")).count() == 0
    mixed = cp.mixing_stage(spark, clean, SF)
    assert mixed.columns == cp.COLUMNS and mixed.select("doc_id").distinct().count() == clean.count()
    for r in cp.bpe_stage(spark, mixed, SF).join(mixed.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").limit(50).collect():
        assert r.ids == bpe.codec(vocab_path()).encode_batch([r.text])[0].tolist() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_run(spark):
    if os.path.isdir(SF):
        assert cp.run(spark, SF).count() > 0


NAMES = "doc_id long, text string, lang string, source string, n_chars long, _score double, _spans string, _id long, _key long, _copy int"


def odd(spark):
    """Nulls in every column, empty, long and repeated texts, several texts of a key, and columns with the stages' own names."""
    long = " ".join(f"word{i}" for i in range(30_000)) + " joe@site.com"
    texts = [(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"), (1, "another text of the same key altogether here"), (2, None), (3, ""), (4, long), (5, long), (None, "no key, mail a@b.de"), (None, None), (6, "x")]
    rows = [(k, t, None if k is None else "en", None if k == 3 else "src0", None if t is None else len(t), 1.0, "s", 7, 8, 9) for k, t in texts]
    return spark.createDataFrame(rows, NAMES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_on_odd_rows(spark):
    docs = odd(spark)
    known = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    good = cp.quality_stage(spark, docs, SF)  # no labelled rows among them: every score is one half, and all stay
    assert good.columns == cp.COLUMNS and good.count() == docs.count()
    one = cp.near_duplicate_stage(spark, docs, SF)
    kept = sorted(((r.doc_id, None if r.text is None else r.text[:11]) for r in one.collect()), key=str)
    assert kept == sorted([(1, "the quick b"), (1, "another tex"), (2, None), (3, ""), (4, "word0 word1"), (None, "no key, mai"), (None, None), (6, "x")], key=str)
    clean = {(r.doc_id, r.text if r.text is None else r.text[-7:]): r.n_chars for r in cp.pii_stage(spark, docs, SF).collect()}
    assert clean[4, "[EMAIL]"] == len(docs.where("doc_id = 4").first().text) - len("joe@site.com") + 7 and clean[2, None] is None and (None, "[EMAIL]") in clean
    both = docs.select(*cp.COLUMNS).union(known)
    mixed = cp.mixing_stage(spark, both, SF)
    assert mixed.columns == cp.COLUMNS and mixed.count() >= both.count() and mixed.where("doc_id is null").count() == 2
    ids = {r.doc_id: r.n_tokens for r in cp.bpe_stage(spark, docs, SF).collect()}
    assert ids[2] == ids[3] == 0 and ids[4] > 30_000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_stages_on_an_empty_table(spark):
    none = odd(spark).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0
