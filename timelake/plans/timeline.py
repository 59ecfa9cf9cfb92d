"""Queries over intervals, clocks, tags and sequences, on the driver's tables, with the SQL that each is compared with.

Events are intervals of a user (the source): start in units of ten minutes, length `value`. Parts, orders and customers
carry tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelake.functions import clocks
from timelake.operators import intervals, sequences, tags

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SECONDS = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


def spans(spark: SparkSession, d: str, *kinds: str) -> DataFrame:
    e = table(spark, d, "events")
    e = e.where(F.col("event_type").isin(*kinds)) if kinds else e
    start = F.expr(SECONDS).cast("double") / 600
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("source_id"), F.col("event_type").alias("kind"), start.alias("start"), (start + F.greatest(F.lit(0.01), F.col("value"))).alias("end"), "value")


SP = "sp AS (SELECT event_id AS id, user_id AS source_id, event_type AS kind, CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 600 AS s, CAST(epoch_us(ts) // 1000000 AS DOUBLE) / 600 + greatest(0.01, value) AS e, value FROM events)"
ON = "a.source_id = b.source_id AND a.s < b.e - 1e-9 AND a.e > b.s + 1e-9"


@query(f"WITH {SP} SELECT a.id, b.id AS other, round(least(a.e, b.e) - greatest(a.s, b.s), 6) AS shared FROM sp a JOIN sp b ON {ON} WHERE a.kind = 'click' AND b.kind = 'error'")
def j1_overlap_join(spark, d):
    j = intervals.overlap_join(spans(spark, d, "click"), spans(spark, d, "error"))
    return j.select("id", F.col("r_id").alias("other"), F.round(F.least("end", "r_end") - F.greatest("start", "r_start"), 6).alias("shared"))


@query(f"WITH {SP} SELECT b.id AS segment_id, count(a.id) AS used_by FROM (SELECT * FROM sp WHERE kind = 'error') b LEFT JOIN (SELECT * FROM sp WHERE kind = 'click') a ON {ON} GROUP BY b.id")
def j4_used_by(spark, d):
    return intervals.used_by(spans(spark, d, "click"), spans(spark, d, "error"))


@query(f"WITH {SP}, h AS (SELECT a.id, b.kind, row_number() OVER (PARTITION BY a.id ORDER BY b.kind, b.s) AS r FROM sp a JOIN sp b ON {ON} WHERE a.kind = 'click' AND b.kind IN ('purchase', 'signup')) SELECT a.id, h.kind AS mark FROM sp a LEFT JOIN h ON h.id = a.id AND h.r = 1 WHERE a.kind = 'click'")
def j5_with_marked(spark, d):
    return intervals.with_marked(spans(spark, d, "click"), spans(spark, d, "purchase", "signup")).select("id", "mark")


@query(f"WITH {SP} SELECT a.id FROM sp a WHERE a.kind = 'click' AND NOT EXISTS (SELECT 1 FROM sp b WHERE {ON} AND b.kind = 'purchase')")
def j5_outside_marked(spark, d):
    return intervals.outside_marked(spans(spark, d, "click"), spans(spark, d, "purchase")).select("id")


@query(f"WITH {SP}, h AS (SELECT a.id, b.id AS other, round(least(a.e, b.e) - greatest(a.s, b.s), 6) AS shared, row_number() OVER (PARTITION BY a.id ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.id) AS r, count(*) OVER (PARTITION BY a.id) AS total FROM sp a JOIN sp b ON a.source_id = b.source_id AND a.s < b.e - 1e-6 AND a.e > b.s + 1e-6 AND a.id <> b.id WHERE a.kind = 'view' AND b.kind = 'view') SELECT id, other, shared, CAST(r AS INTEGER) AS rank, total FROM h WHERE r <= 3")
def j7_related(spark, d):
    return intervals.related(spans(spark, d, "view"), 3).withColumn("shared", F.round("shared", 6))


@query(f"WITH {SP}, m AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT source_id, round(min(s), 6) AS start, round(max(e), 6) AS \"end\", count(*) AS members FROM g GROUP BY source_id, i")
def w_islands(spark, d):
    return intervals.islands(spans(spark, d), gap=5.0).select("source_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "members")


@query(f"WITH {SP}, m AS (SELECT *, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp WHERE kind = 'error'), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM m), b AS (SELECT source_id, min(s) AS s, max(e) AS e FROM g GROUP BY source_id, i) SELECT a.id, round(coalesce(sum(CASE WHEN b.s IS NOT NULL THEN least(a.e, b.e) - greatest(a.s, b.s) END), 0), 6) AS covered FROM (SELECT * FROM sp WHERE kind = 'click') a LEFT JOIN b ON {ON} GROUP BY a.id")
def w12_covered_length(spark, d):
    return intervals.covered_length(spans(spark, d, "click"), spans(spark, d, "error")).select("id", F.round("covered", 6).alias("covered"))


@query(f"WITH {SP} SELECT a.id, count(b.id) AS conflicts, coalesce(max(CASE WHEN (b.s > a.s + 1e-9 AND b.e < a.e - 1e-9) OR (b.s <= a.s + 1e-9 AND b.e >= a.e - 1e-9) THEN 1 ELSE 0 END) FILTER (b.id IS NOT NULL) = 0, false) AS can_cut FROM (SELECT * FROM sp WHERE kind = 'signup') a LEFT JOIN (SELECT * FROM sp WHERE kind = 'view') b ON {ON} GROUP BY a.id")
def j16_conflicts(spark, d):
    return intervals.conflicts_with_cut(spans(spark, d, "signup"), spans(spark, d, "view"))


@query(f"WITH {SP} SELECT id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, e, id) AS INTEGER) AS ordinal FROM sp")
def w16_ordinal(spark, d):
    return intervals.with_ordinal(spans(spark, d)).select("id", "ordinal")


@query(f"WITH {SP} SELECT id, round(coalesce(sum(e - s + 2.0) OVER (PARTITION BY source_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS at FROM sp WHERE kind = 'click'")
def w17_lay_out(spark, d):
    return intervals.lay_out(spans(spark, d, "click"), 0.5).select("id", F.round("at", 4).alias("at"))


def knots():
    return F.array(*(F.struct(F.lit(float(a)).alias("local"), F.lit(float(b)).alias("source")) for a, b in ((0, 10), (100, 130), (250, 255), (500, 505.5))))


def prices(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.pmod(F.floor("o_totalprice"), F.lit(600)).cast("double") - 20).alias("t"))


PRICES = "o AS (SELECT o_orderkey, CAST(floor(o_totalprice) % 600 AS DOUBLE) - 20 AS t FROM orders)"
TO_SOURCE = "CASE WHEN {0} < -1e-9 OR {0} > 500 + 1e-9 THEN NULL WHEN {0} < 100 THEN 10 + {0} * 1.2 WHEN {0} < 250 THEN 130 + ({0} - 100) * (125.0 / 150) ELSE 255 + ({0} - 250) * (250.5 / 250) END"
TO_LOCAL = "CASE WHEN {0} < 10 - 1e-9 OR {0} > 505.5 + 1e-9 THEN NULL WHEN {0} < 130 THEN ({0} - 10) / 1.2 WHEN {0} < 255 THEN 100 + ({0} - 130) * (150 / 125.0) ELSE 250 + ({0} - 255) * (250 / 250.5) END"


@query(f"WITH {PRICES} SELECT o_orderkey, round({TO_SOURCE.format('t')}, 6) AS source, round({TO_LOCAL.format('t')}, 6) AS local FROM o")
def p1_p2_clocks(spark, d):
    return prices(spark, d).select("o_orderkey", F.round(clocks.to_source(knots(), F.col("t")), 6).alias("source"), F.round(clocks.to_local(knots(), F.col("t")), 6).alias("local"))


@query(f"WITH {PRICES}, c AS (SELECT o_orderkey, t AS a, t + 180 AS b FROM o WHERE t >= 0 AND t <= 320), k AS (SELECT o_orderkey, 0.0 AS local, {TO_SOURCE.format('a')} AS source FROM c UNION ALL SELECT o_orderkey, 180.0, {TO_SOURCE.format('b')} FROM c UNION ALL SELECT o_orderkey, x.l - a, x.s FROM c, (VALUES (0.0, 10.0), (100.0, 130.0), (250.0, 255.0), (500.0, 505.5)) x(l, s) WHERE x.l > a + 1e-9 AND x.l < b - 1e-9) SELECT o_orderkey, round(local, 6) AS local, round(source, 6) AS source FROM k")
def p3_crop_mapping(spark, d):
    c = prices(spark, d).where("t >= 0 and t <= 320").select("o_orderkey", F.explode(clocks.crop_mapping(knots(), F.col("t"), F.col("t") + 180)).alias("k"))
    return c.select("o_orderkey", F.round("k.local", 6).alias("local"), F.round("k.source", 6).alias("source"))


@query(f"WITH {PRICES}, r AS (SELECT o_orderkey, t AS s, t + 60 AS e FROM o), q AS (SELECT o_orderkey, CASE WHEN s < 0 AND s >= -10 THEN 0 ELSE s END AS s, CASE WHEN e > 500 AND e <= 510 THEN 500 ELSE e END AS e FROM r) SELECT o_orderkey, round(s, 3) AS start, round(e, 3) AS \"end\", CASE WHEN s < 0 THEN 'negative-start' WHEN e > 500 THEN 'beyond-end' WHEN e <= s THEN 'empty' END AS error FROM q")
def p7_check_range(spark, d):
    r = prices(spark, d).select("o_orderkey", clocks.check_range(F.col("t"), F.col("t") + 60, F.lit(500.0), F.lit(10.0)).alias("r"))
    return r.select("o_orderkey", F.round("r.start", 3).alias("start"), F.round("r.end", 3).alias("end"), "r.error")


@query("WITH m AS (SELECT o_orderkey, CAST(o_orderkey % 7000000 AS BIGINT) * 937 AS ms FROM orders) SELECT o_orderkey, CASE WHEN ms >= 3600000 THEN printf('%d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) ELSE printf('%d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) END AS label, printf('%02d-%02d-%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS file_label FROM m")
def x9_clock_labels(spark, d):
    t = (F.col("o_orderkey") % 7000000 * 937) / 1000.0
    return table(spark, d, "orders").select("o_orderkey", clocks.clock_label(t).alias("label"), clocks.file_clock_label(t).alias("file_label"))


def part_tags(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("brand:"), "p_brand"), F.concat(F.lit("type:"), "p_type"), F.concat(F.lit("size:"), F.col("p_size").cast("string"))).alias("tags"), "p_brand", "p_type", "p_size")


EXPR = '(type:* AND NOT "size:7") AND (brand:Brand#11 OR brand:Brand#2* OR size:1 OR size:10)'


@query("SELECT p_partkey AS id FROM part WHERE p_size <> 7 AND (p_brand = 'Brand#11' OR p_brand = 'Brand#2*' OR p_size IN (1, 10))")
def p10_tag_expr(spark, d):
    return part_tags(spark, d).where(tags.tag_expr(EXPR, F.col("tags"))).select("id")


def etags(spark, d):
    return part_tags(spark, d).select(F.col("id").alias("sample_id"), F.explode("tags").alias("tag"))


@query("SELECT p_partkey AS id FROM part WHERE p_size IN (1, 2, 3, 4) AND p_brand IN (SELECT max(p_brand) FROM part UNION SELECT min(p_brand) FROM part)")
def p11_filter_facets(spark, d):
    p = part_tags(spark, d)
    ends = p.agg(F.min("p_brand"), F.max("p_brand")).first()
    return tags.filter_facets(p, etags(spark, d), {"size": ["1", "2", "3", "4"], "brand": list(ends)}).select("id")


def library(spark, d):
    """Samples, sources, local tags, range tags and speaker segments from events and orders."""
    s = spans(spark, d, "click").withColumn("voiced", F.col("id") % 3 != 0)
    sources = table(spark, d, "events").select(F.col("user_id").alias("source_id")).distinct().select("source_id", F.concat(F.lit("w"), (F.col("source_id") % 5).cast("string")).alias("work"), F.when(F.col("source_id") % 4 == 0, "").otherwise("film").alias("source_type"))
    local = s.where("id % 4 = 0").select(F.col("id").alias("sample_id"), F.concat(F.lit("mood:m"), (F.col("id") % 6).cast("string")).alias("tag"))
    ranges = spans(spark, d, "error").select("id", "source_id", "start", "end", F.array(F.concat(F.lit("mood:m"), (F.col("id") % 7).cast("string")), F.lit("kind:range")).alias("tags"))
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("ann"))).when(F.col("id") % 3 == 1, F.array(F.lit("ann"), F.lit("bob"))).otherwise(F.array().cast("array<string>"))
    segments = spans(spark, d, "view").select("id", "source_id", "start", "end", names.alias("speakers"))
    return s, sources, local, ranges, segments


ETAGS = f"""WITH {SP}, c AS (SELECT * FROM sp WHERE kind = 'click'),
t AS (SELECT id, 'mood:m' || (id % 6) AS tag, 0 AS p FROM c WHERE id % 4 = 0
UNION ALL SELECT id, 'work:w' || (source_id % 5), 1 FROM c UNION ALL SELECT id, 'type:film', 1 FROM c WHERE source_id % 4 <> 0
UNION ALL SELECT a.id, unnest(['mood:m' || (b.id % 7), 'kind:range']), 2 FROM c a JOIN sp b ON {ON} WHERE b.kind = 'error'
UNION ALL SELECT a.id, unnest(CASE WHEN b.id % 3 = 0 THEN ['character:ann'] WHEN b.id % 3 = 1 THEN ['participants:ann', 'participants:bob', '{tags.SEVERAL}'] ELSE [] END), 2 FROM c a JOIN sp b ON {ON} WHERE b.kind = 'view' AND a.id % 3 <> 0),
et AS (SELECT id AS sample_id, tag, split_part(tag, ':', 1) AS facet, ['local', 'source', 'segment', 'auto'][min(p) + 1] AS provenance FROM t GROUP BY id, tag)"""


def effective(spark, d):
    return tags.effective_tags(*library(spark, d))


@query(f"{ETAGS} SELECT * FROM et")
def j2_effective_tags(spark, d):
    return effective(spark, d)


@query(f"{ETAGS} SELECT CASE WHEN facet IN ('character', 'participants') THEN 'person' ELSE facet END AS facet, substr(tag, instr(tag, ':') + 1) AS value, count(DISTINCT sample_id) AS n, count(DISTINCT CASE WHEN facet <> 'participants' THEN sample_id END) AS n_single FROM et GROUP BY 1, 2")
def a1_facet_counts(spark, d):
    return tags.facet_counts(effective(spark, d))


@query(f"{ETAGS} SELECT tag, count(DISTINCT CASE WHEN provenance = 'local' THEN sample_id END) AS n_local, count(DISTINCT CASE WHEN provenance <> 'local' THEN sample_id END) AS n_inherited FROM et WHERE sample_id % 2 = 0 GROUP BY tag")
def a3_tags_of(spark, d):
    return tags.tags_of(effective(spark, d), spans(spark, d, "click").where("id % 2 = 0"))


@query("SELECT tag, CAST(sum(CASE WHEN h = 'part' THEN 1 ELSE 0 END) AS BIGINT) AS n_part, CAST(sum(CASE WHEN h = 'customer' THEN 1 ELSE 0 END) AS BIGINT) AS n_customer, CAST(sum(CASE WHEN h = 'nation' THEN 1 ELSE 0 END) AS BIGINT) AS n_nation FROM (SELECT 'k:' || (p_size % 10) AS tag, 'part' AS h FROM part UNION ALL SELECT 'k:' || (c_nationkey % 10), 'customer' FROM customer UNION ALL SELECT 'k:' || (n_regionkey + 7), 'nation' FROM nation) GROUP BY tag")
def a2_tag_usage(spark, d):
    k = lambda c: F.concat(F.lit("k:"), c.cast("string")).alias("tag")
    return tags.tag_usage({"part": table(spark, d, "part").select(k(F.col("p_size") % 10)), "customer": table(spark, d, "customer").select(k(F.col("c_nationkey") % 10)), "nation": table(spark, d, "nation").select(k(F.col("n_regionkey") + 7))})


@query("SELECT p_partkey AS id, array_to_string(list_distinct_ordered, '|') AS new_tags FROM (SELECT p_partkey, CASE WHEN p_size = 5 THEN ['brand:' || p_brand, 'size:5', 'new:x'] ELSE ['brand:' || p_brand, 'size:' || p_size, 'new:x', 'size:5'] END AS list_distinct_ordered FROM part)")
def e9_edit_tags(spark, d):
    p = part_tags(spark, d)
    types = [r.p_type for r in p.select("p_type").distinct().collect()]
    changed = tags.edit_tags(p, ["new:x", "size:5"], [f"type:{t}" for t in types])
    one = F.when(F.col("p_size") == 5, F.array(F.col("new_tags")[0], F.lit("size:5"), F.lit("new:x"))).otherwise(F.col("new_tags"))
    return changed.select("id", F.array_join(one, "|").alias("new_tags"))


@query("SELECT p_partkey AS id, 'brand:' || p_brand || '|type:' || p_type || '|size:five' AS new_tags FROM part WHERE p_size = 5")
def e10_rename_tag(spark, d):
    return tags.rename_tag(part_tags(spark, d), "size:5", "size:five").select("id", F.array_join("new_tags", "|").alias("new_tags"))


@query(f"WITH {SP}, t AS (SELECT a.id, 'character:c' || (b.id % 3) AS tag FROM sp a JOIN sp b ON {ON} WHERE a.kind = 'click' AND b.kind = 'error' UNION SELECT a.id, CASE WHEN a.id % 7 = 0 THEN 'participants:x' ELSE 'character:c1' END FROM sp a WHERE a.kind = 'click' AND a.id % 5 < 3), c AS (SELECT id, count(*) AS n, min(tag) AS k FROM t GROUP BY 1) SELECT sp.id, CASE WHEN c.n = 1 AND k LIKE 'character:%' THEN substr(k, 11) END AS character FROM sp LEFT JOIN c ON c.id = sp.id WHERE sp.kind = 'click'")
def j8_solo_character(spark, d):
    c = spans(spark, d, "click")
    ranges = spans(spark, d, "error").select("source_id", "start", "end", F.concat(F.lit("character:c"), (F.col("id") % 3).cast("string")).alias("tag"))
    return tags.solo_character(c, ranges, c.where("id % 5 < 3").select("id", F.when(F.col("id") % 7 == 0, "participants:x").otherwise("character:c1").alias("tag")))


def blocks(spark, d):
    """A user's events in order as blocks: the type as vowel, a pitch from the value, a new pause segment after a long space."""
    w = Window.partitionBy("source_id").orderBy("start", "id")
    b = spans(spark, d).withColumn("k", F.row_number().over(w) - 1).withColumn("_p", F.coalesce((F.col("start") - F.lag("start").over(w) > 100).cast("int"), F.lit(0)))
    return b.select(F.col("source_id").alias("sample_id"), "k", F.col("start").alias("onset"), (F.col("start") + 0.01).alias("end"), F.col("start").alias("lead"), F.col("kind").alias("vowel"), F.array().cast("array<string>").alias("consonants"), (40 + F.floor(F.col("value")) % 48).cast("double").alias("midi"), (F.floor(F.col("value") * 7) % 60).cast("double").alias("spread"), F.lit(0.9).alias("coverage"), F.lit(0.0).alias("trend"), F.col("value").alias("strength"), F.lit(None).cast("double").alias("sustain"), F.lit(None).cast("string").alias("character"), F.sum("_p").over(w).alias("pseg"), "id")


BL = f"{SP}, b0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY s, id) - 1 AS INTEGER) AS k, CASE WHEN s - lag(s) OVER (PARTITION BY source_id ORDER BY s, id) > 100 THEN 1 ELSE 0 END AS p FROM sp), bl AS (SELECT source_id AS sample_id, k, s, s + 0.01 AS e, kind AS vowel, CAST(40 + CAST(floor(value) AS BIGINT) % 48 AS DOUBLE) AS midi, CAST(CAST(floor(value * 7) AS BIGINT) % 60 AS DOUBLE) AS spread, sum(p) OVER (PARTITION BY source_id ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS pseg, value FROM b0)"
PC = "abs(((({m} - {p} + 6) % 12 + 12) % 12) - 6) * 100"
THREE = sequences.WindowQuery(tuple(sequences.BlockCondition(pitch_class=p, tolerance=200, max_spread=50) for p in (0, 4, 7)), max_space=400.0)
_m = [PC.format(m="midi", p=p) for p in (0, 4, 7)]
Q3_SQL = f"""WITH {BL}, m AS (SELECT *, {_m[0]} AS d0, {_m[1]} AS d1, {_m[2]} AS d2, spread <= 50 AS ok FROM bl),
x AS (SELECT *, lead(d1, 1) OVER w AS e1, lead(d2, 2) OVER w AS e2, lead(ok, 1) OVER w AS ok1, lead(ok, 2) OVER w AS ok2, lead(pseg, 2) OVER w AS pg, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(e, 1) OVER w AS en1, lead(e, 2) OVER w AS en2, lead(spread, 1) OVER w AS sp1, lead(spread, 2) OVER w AS sp2 FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY k)),
h AS (SELECT sample_id, k AS first, s AS start, en2 AS fin, (d0 + e1 + e2) / 200 + (spread + sp1 + sp2) / 50 AS score FROM x WHERE ok AND ok1 AND ok2 AND d0 <= 200 AND e1 <= 200 AND e2 <= 200 AND pg = pseg AND s1 - e <= 400 AND s2 - en1 <= 400)"""


@query(f'{Q3_SQL} SELECT sample_id, first, round(start, 6) AS start, round(fin, 6) AS "end", round(score, 6) AS score FROM h')
def q3_search_blocks(spark, d):
    return sequences.search_blocks(blocks(spark, d), THREE).select("sample_id", "first", *(F.round(c, 6).alias(c) for c in ("start", "end", "score")))


@query(f"{Q3_SQL}, g AS (SELECT *, min(round(score, 10)) OVER (PARTITION BY sample_id) AS best FROM h) SELECT sample_id, first, CAST(row_number() OVER (ORDER BY best, sample_id, round(score, 10), start, first) - 1 AS BIGINT) AS rank FROM g")
def q9_order_hits(spark, d):
    return sequences.order_hits(sequences.search_blocks(blocks(spark, d), THREE)).select("sample_id", "first", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {SP}, n AS (SELECT *, CASE WHEN lag(s) OVER w IS NULL OR s - lag(s) OVER w > 60 OR lag(kind) OVER w <> kind THEN 1 ELSE 0 END AS new FROM sp WINDOW w AS (PARTITION BY source_id ORDER BY s, id)) SELECT id, CAST(sum(new) OVER (PARTITION BY source_id ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n")
def t5_event_islands(spark, d):
    return sequences.event_islands(spans(spark, d), "source_id", ["start", "id"], "start", 60.0, "kind").select("id", "island")


def markers(spark, d):
    e = spans(spark, d, "click", "error")
    return e.select("source_id", F.when(F.col("kind") == "click", "start").otherwise("end").alias("mark"), F.col("start").alias("at"), F.col("id").alias("order"), F.lit(2860000.0).alias("duration"))


W14 = f"""WITH {SP}, m AS (SELECT source_id, CASE WHEN kind = 'click' THEN 'start' ELSE 'end' END AS mark, s AS t0, lag(kind) OVER w AS p, lead(kind) OVER w AS n, lead(s) OVER w AS nx FROM sp WHERE kind IN ('click', 'error') WINDOW w AS (PARTITION BY source_id ORDER BY s, id)),
r AS (SELECT source_id, mark, t0, CASE WHEN mark = 'start' AND n = 'error' THEN nx END AS fin, CASE WHEN mark = 'start' AND n = 'click' THEN 'duplicate-start' WHEN mark = 'start' AND n IS NULL THEN 'start-without-end' WHEN mark = 'end' AND (p IS NULL OR p = 'error') THEN 'end-without-start' WHEN mark = 'start' AND (t0 < 0 OR nx > 2860000 + 1e-6 OR nx <= t0) THEN 'out-of-range' END AS error FROM m)"""


@query(f'{W14} SELECT source_id, round(t0, 6) AS start, round(fin, 6) AS "end", error FROM r WHERE mark = \'start\' OR error IS NOT NULL')
def w14_pair_markers(spark, d):
    return sequences.pair_markers(markers(spark, d)).select("source_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "error")
