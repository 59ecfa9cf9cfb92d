"""The functions called from SQL give what the column functions give."""

import pytest
from pyspark.sql import functions as F

from timelake.functions import clocks, sql, text
from timelake.operators import tags


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def test_clocks(session):
    k = "array(named_struct('local', 0D, 'source', 10D), named_struct('local', 100D, 'source', 130D), named_struct('local', 250D, 'source', 255D))"
    knots = F.expr(k)
    times = session.createDataFrame([(float(t),) for t in (-1, -1e-10, 0, 0.5, 99.9, 100, 130, 249.999, 250, 250.1, 255, 256)], "t double")
    rows = times.selectExpr("t", f"to_source({k}, t) AS a", f"to_local({k}, t) AS b", "clock_label(t * 61) AS c", "frame_of(t) AS f", "spans_overlap(0D, 1D, t, t + 1) AS o")
    want = times.select("t", clocks.to_source(knots, F.col("t")).alias("a"), clocks.to_local(knots, F.col("t")).alias("b"), clocks.clock_label(F.col("t") * 61).alias("c"), clocks.frame_of(F.col("t")).alias("f"), clocks.overlaps(F.lit(0.0), F.lit(1.0), F.col("t"), F.col("t") + 1).alias("o"))
    for x, y in zip(rows.collect(), want.collect(), strict=True):
        assert (x.c, x.f, x.o) == (y.c, y.f, y.o)
        assert all((p is None) == (q is None) and (p is None or abs(p - q) < 1e-9) for p, q in ((x.a, y.a), (x.b, y.b)))


def test_texts_and_notes(session):
    df = session.createDataFrame([("Ｔake-1 カナ", 440.0, "mood:x"), ("", 0.0, "x"), (None, None, ":y")], "s string, hz double, tag string")
    got = df.selectExpr("norm_text(s) AS n", "to_hiragana(s) AS h", "note_name(midi_of_hz(hz)) AS m", "facet_of(tag) AS f").collect()
    want = df.select(text.norm_text(F.col("s")).alias("n"), text.to_hiragana(F.col("s")).alias("h"), text.note_name(text.midi_of_hz(F.col("hz"))).alias("m"), tags.facet_of(F.col("tag")).alias("f")).collect()
    assert got == want and got[0].n == "take1カナ" and got[0].m == "A4"


def test_tag_filter_as_a_table_function(session):
    df = session.createDataFrame([(1, ["a", "mood:x"]), (2, ["b"]), (3, None), (4, ["mood:y", "b"])], "id int, tags array<string>")
    df.createOrReplaceTempView("tagged")
    for e in ("", "a OR b", "NOT b", "mood:* AND NOT a", '"b" AND (mood:y OR a)'):
        got = sorted(r.id for r in session.sql(f"SELECT id FROM tag_filter(TABLE(tagged), '{e}')").collect())
        assert got == sorted(r.id for r in df.where(tags.tag_expr(e, F.col("tags"))).collect()), e
    with pytest.raises(Exception, match="expect-term"):
        session.sql("SELECT * FROM tag_filter(TABLE(tagged), 'a AND')").collect()
