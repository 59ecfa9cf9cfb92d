"""Queries over filters, window tags, rhythm evidence, lineage, analysis states, pitch search and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timelake.functions import clocks, naming, text
from timelake.operators import evidence, filters, frames, lineage, measures, planning, sequences, tags, vectors
from timelake.plans.measures import F3_SQL, PITCH, sound_frames
from timelake.plans.timeline import BL, ETAGS, SP, blocks, effective, spans, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


# ---- samples with everything that filters ask for: clicks, each on one of two assets of its user


def off(asset):
    return (asset % 7 * 10).cast("double")


def clicks(spark, d):
    i = F.col("id")
    s = spans(spark, d, "click").withColumn("asset_id", F.col("source_id") * 2 + i % 2)
    own = {"judge_start": F.when(i % 5 != 0, F.col("start") - 1), "judge_end": F.when(i % 5 != 0, F.col("end") + 1), "start": F.col("start") - off(F.col("asset_id")), "end": F.col("end") - off(F.col("asset_id"))}
    more = {"name": F.concat(F.lit("Take "), (i % 40).cast("string")), "note": F.when(i % 11 == 0, "Second TRY"), "nature": F.element_at(F.array(*map(F.lit, filters.NATURES)), (i % 4 + 1).cast("int")), "starred": i % 3 == 0, "language": F.when(i % 2 == 0, "ja").otherwise("en"), "session": i % 13}
    return s.withColumns(own).withColumns(more)


CL = f"""{SP}, cl AS (SELECT id, source_id, source_id * 2 + id % 2 AS asset_id, CAST((source_id * 2 + id % 2) % 7 * 10 AS DOUBLE) AS o, s - 1 AS j0, e + 1 AS j1, s, e, 'Take ' || (id % 40) AS name, CASE WHEN id % 11 = 0 THEN 'Second TRY' END AS note, ['speech', 'pitched', 'unpitched', 'unclassified'][id % 4 + 1] AS nature, id % 3 = 0 AS starred, CASE WHEN id % 2 = 0 THEN 'ja' ELSE 'en' END AS language, id % 13 AS session FROM sp WHERE kind = 'click')"""


def spoken(spark, d):
    """Views as segments with a normalised text and a reading."""
    i = F.col("id")
    return spans(spark, d, "view").select("id", "source_id", "start", "end", F.concat(F.lit("Line, no. "), (i % 17).cast("string")).alias("text"), F.concat(F.lit("lineno"), (i % 17).cast("string")).alias("norm"), F.when(i % 2 == 0, F.concat(F.lit("よみ"), (i % 17).cast("string"))).alias("reading"), F.when(i % 3 == 0, F.array(F.lit("ann"))).otherwise(F.array(F.lit("ann"), F.lit("bob"))).alias("speakers"))


SG = "sg AS (SELECT *, 'Line, no. ' || (id % 17) AS text, 'lineno' || (id % 17) AS norm, CASE WHEN id % 2 = 0 THEN 'よみ' || (id % 17) END AS reading FROM sp WHERE kind = 'view')"


@query(f"""{ETAGS}, c2 AS (SELECT id FROM c WHERE id % 4 IN (0, 1) AND id % 3 = 0 AND id % 13 < 9 AND id % 13 = 4)
SELECT id FROM c2 WHERE id IN (SELECT sample_id FROM et WHERE tag IN ('character:ann', 'participants:ann')) AND id IN (SELECT sample_id FROM et WHERE tag IN ('work:w1', 'work:w2', 'work:w3'))
AND NOT EXISTS (SELECT 1 FROM et WHERE sample_id = id AND tag LIKE 'mood:%' AND tag = 'mood:m2') AND EXISTS (SELECT 1 FROM et WHERE sample_id = id AND tag LIKE 'kind:%') UNION ALL SELECT -1 WHERE FALSE""")
def p12_filter_samples(spark, d):
    spec = filters.SampleFilter(natures=("speech", "pitched"), starred=True, session=4, facets=(filters.FacetChoice("person", ("ann",)), filters.FacetChoice("work", ("w1", "w2", "w3"))), scope_expr="NOT mood:m2", expr="kind:*")
    return filters.filter_samples(clicks(spark, d), spec, etags=effective(spark, d)).select("id")


@query(f"WITH {CL}, {SG} SELECT id FROM cl WHERE lower(name) LIKE '%take 1%' OR lower(note) LIKE '%take 1%' OR EXISTS (SELECT 1 FROM sg b WHERE b.source_id = cl.source_id AND id % 5 <> 0 AND b.s < j1 AND b.e > j0 AND b.norm LIKE '%take1%')")
def p13_text_name(spark, d):
    return filters.text_match(clicks(spark, d), spoken(spark, d), " tAKE 1").select("id")


@query(f"WITH {CL}, {SG} SELECT id FROM cl WHERE lower(name) LIKE '%no1%' OR EXISTS (SELECT 1 FROM sg b WHERE b.source_id = cl.source_id AND cl.id % 5 <> 0 AND b.s < j1 AND b.e > j0 AND (b.norm LIKE '%no1%' OR b.reading LIKE '%no1%'))")
def p13_text_segments(spark, d):
    return filters.text_match(clicks(spark, d), spoken(spark, d), "No.1").select("id")


@query(f"WITH {CL} SELECT id FROM cl WHERE id % 6 <> 0 AND asset_id % 4 <> 3 AND value_ BETWEEN 20 AND 60 AND id % 9 <> 0".replace("value_", "v").replace("FROM cl WHERE", "FROM (SELECT cl.*, sp.value AS v FROM cl JOIN sp USING (id)) WHERE"))
def p14_metrics(spark, d):
    c = clicks(spark, d)
    i = F.col("id")
    values = F.create_map(F.lit("pitch"), F.when(i % 9 != 0, F.col("value")), F.lit("rms"), F.lit(-3.0))
    rows = c.select(i.alias("sample_id"), "asset_id", "start", "end", F.when(i % 6 == 0, "old").otherwise("now").alias("algo"), F.lit("s").alias("signature"), values.alias("values"))
    signatures = c.select("asset_id").distinct().select("asset_id", F.when(F.col("asset_id") % 4 == 3, "t").otherwise("s").alias("signature"))
    return filters.filter_metrics(c, rows, (filters.MetricRange("pitch", 20.0, 60.0), filters.MetricRange("rms", high=0.0), filters.MetricRange("none")), "now", signatures).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_size IN (1, 2, 3, 4, 5, 6) AND NOT (p_brand = 'Brand#11')")
def p15_tag_predicate(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.concat(F.lit("type:"), F.col("p_size").cast("string")), F.concat(F.lit("brand:"), "p_brand")).alias("tags"))
    spec = filters.SampleFilter(facets=(filters.FacetChoice("type", ("1", "2", "3", "4", "5", "6")),), expr='NOT "brand:Brand#11"')
    return p.where(filters.tag_predicate(spec, F.col("tags"))).select("id")


def tag_tables(spark, d):
    c = clicks(spark, d)
    a = F.col("asset_id")
    knot = lambda x, y: F.struct(F.lit(x).alias("local"), (F.lit(y) + off(a)).alias("source"))
    assets = c.select("asset_id", "source_id").distinct().select("asset_id", "source_id", F.array(knot(0.0, 0.0), knot(4e6, 4e6)).alias("mapping"), F.when(a % 5 == 0, "flatten").otherwise("stream").alias("origin"), F.when(a % 10 == 0, "A4").alias("target"))
    roles = assets.where(a % 3 != 0).select("asset_id", F.lit("vocal").alias("role"))
    sources = assets.select("source_id").distinct().select("source_id", F.concat(F.lit("w"), (F.col("source_id") % 5).cast("string")).alias("work"), F.lit("").alias("source_type"))
    i = F.col("id")
    e = spans(spark, d, "error").withColumn("scope", F.element_at(F.array(F.lit("source"), F.lit("role"), F.lit("asset")), (i % 3 + 1).cast("int"))).withColumn("scope_asset_id", F.col("source_id") * 2 + F.floor(i / 3) % 2)
    own = F.when(F.col("scope") == "asset", off(F.col("scope_asset_id"))).otherwise(0.0)
    ranges = e.select("id", "source_id", "scope", F.when(i % 2 == 0, "vocal").otherwise("sfx").alias("scope_role"), "scope_asset_id", (F.col("start") - own).alias("start"), (F.col("end") - own).alias("end"), F.array(F.concat(F.lit("mood:m"), (i % 7).cast("string"))).alias("tags"))
    return c, assets, roles, sources, ranges, spoken(spark, d)


J3 = f"""WITH {CL}, a AS (SELECT *, CASE WHEN id % 5 <> 0 THEN j0 ELSE s END AS s0, CASE WHEN id % 5 <> 0 THEN j1 ELSE e END AS s1 FROM cl),
rg AS (SELECT id, source_id, s, e, ['source', 'role', 'asset'][id % 3 + 1] AS scope, CASE WHEN id % 2 = 0 THEN 'vocal' ELSE 'sfx' END AS role, source_id * 2 + (id // 3) % 2 AS own, 'mood:m' || (id % 7) AS tag FROM sp WHERE kind = 'error'),
t AS (SELECT a.id, 'work:w' || (source_id % 5) AS tag, 1 AS p FROM a UNION ALL SELECT a.id, 'pitch:A4', 3 FROM a WHERE asset_id % 10 = 0
UNION ALL SELECT a.id, r.tag, 2 FROM a JOIN rg r ON r.source_id = a.source_id AND a.s0 < r.e - 1e-9 AND a.s1 > r.s + 1e-9 WHERE r.scope = 'source' OR (r.scope = 'role' AND r.role = 'vocal' AND a.asset_id % 3 <> 0)
UNION ALL SELECT a.id, r.tag, 2 FROM a JOIN rg r ON r.own = a.asset_id AND r.source_id = a.source_id AND a.s0 < r.e - 1e-9 AND a.s1 > r.s + 1e-9 WHERE r.scope = 'asset'
UNION ALL SELECT a.id, unnest(CASE WHEN b.id % 3 = 0 THEN ['character:ann'] ELSE ['participants:ann', 'participants:bob', '{tags.SEVERAL}'] END), 2 FROM a JOIN sp b ON b.kind = 'view' AND b.source_id = a.source_id AND a.s0 < b.e AND a.s1 > b.s WHERE a.asset_id % 3 <> 0)"""


@query(f"{J3} SELECT id, tag, split_part(tag, ':', 1) AS facet, ['local', 'source', 'segment', 'auto'][min(p) + 1] AS provenance FROM t GROUP BY id, tag")
def j3_window_tags(spark, d):
    c, *rest = tag_tables(spark, d)
    return tags.window_tags(c.select("id", "asset_id", "start", "end", "judge_start", "judge_end"), *rest).select("id", "tag", "facet", "provenance")


@query(f"WITH {SP}, {SG} SELECT 'segment' AS kind, id, text FROM sg UNION ALL SELECT 'hint', id, 'Bang ' || (id % 5) FROM sp WHERE kind = 'error'")
def u1_text_stream(spark, d):
    return stream(spark, d).select("kind", "id", "text")


def stream(spark, d):
    hints = spans(spark, d, "error").select("id", "source_id", "start", "end", F.concat(F.lit("Bang "), (F.col("id") % 5).cast("string")).alias("text"))
    return filters.text_stream(spoken(spark, d), hints)


@query(f"WITH {SP}, {SG}, h AS (SELECT 'segment' AS kind, id, source_id, CASE WHEN norm LIKE '%o1%' THEN 'text' ELSE 'reading' END AS match, CASE WHEN id % 17 IN (1, 10, 11, 12, 13, 14, 15, 16) THEN '[6,7][10,11]' END AS x FROM sg WHERE norm LIKE '%o1%' OR reading LIKE '%o1%') SELECT kind, id, match, '7-11' AS spans, count(*) OVER (PARTITION BY source_id) AS n_source FROM h")
def f13_search_layer(spark, d):
    hits = filters.search_text(stream(spark, d), "o. 1")
    spots = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return hits.select("kind", "id", "match", spots.alias("spans"), "n_source")


# ---- rhythm


@query(f"WITH {BL}, m AS (SELECT sample_id, k, k * 2 - CASE WHEN k % 13 = 0 AND k > 0 THEN 1 ELSE 0 END AS mora, sample_id % 9 = 0 AS odd FROM bl), q AS (SELECT *, lead(mora) OVER (PARTITION BY sample_id ORDER BY k) AS nx FROM m) SELECT sample_id, k, CAST(CASE WHEN odd THEN NULL ELSE coalesce(nx, mora + 1) - mora END AS BIGINT) AS cells FROM q")
def w7_mora_cells(spark, d):
    b = blocks(spark, d)
    mora = F.col("k") * 2 - F.when((F.col("k") % 13 == 0) & (F.col("k") > 0), 1).otherwise(0)
    phones = b.select("sample_id", F.col("k").alias("idx"), F.lit("a").alias("label"), F.col("onset").alias("start"), "end", F.when(~((F.col("sample_id") % 9 == 0) & (F.col("k") == 0)), mora).alias("mora"), "k")
    return evidence.mora_cells(phones, b, b.select("sample_id").distinct().select("sample_id", F.lit(0.0).alias("w0"), F.lit(1e9).alias("w1")))


NOTES = ((0.0, 1.0), (1.0, 2.0), (2.0, 3.0))


def runs(spark, d, n=3, every=4):
    """Every few blocks a window of n, with the plan of its whole sample: beats are seconds over 40."""
    b = blocks(spark, d).select("sample_id", "k", "onset", "end", F.when(F.col("k") % 6 != 0, F.col("end") + 20).alias("sustain"), F.col("pseg").alias("seg"))
    last = b.groupBy("sample_id").agg(F.max("k").alias("top"), F.array_sort(F.collect_list(F.struct("k", "onset"))).alias("o"))
    hits = b.where(F.col("k") % every == 0).join(last, "sample_id").where(F.col("k") + n - 1 <= F.col("top")).select("sample_id", F.col("k").alias("first"))
    plans = last.select("sample_id", F.lit(-1).alias("scope"), F.lit(0).alias("start"), (F.col("top") + 1).alias("stop"), F.transform("o", lambda s: s["onset"]).alias("onsets"))
    return evidence.window_rows(hits, b, n), plans


Q_BASE = f"""WITH {BL}, wn AS (SELECT a.sample_id, a.k AS first, b.k - a.k AS j, b.s, b.e FROM bl a JOIN bl b ON a.sample_id = b.sample_id AND b.k BETWEEN a.k AND a.k + 2 WHERE a.k % 4 = 0),
ok AS (SELECT sample_id, first, min(s) AS t0, max(e) AS t1, max(s) AS lo FROM wn GROUP BY 1, 2 HAVING count(*) = 3)"""
Q4_SQL = Q_BASE + """, x AS (SELECT wn.sample_id, wn.first, j, (s - t0) / (t1 - t0) AS x, j / 3.0::DOUBLE AS a, (j + 1) / 3.0::DOUBLE AS b FROM wn JOIN ok USING (sample_id, first)), g AS (SELECT sample_id, first, median(a - x) AS m FROM x GROUP BY 1, 2),
y AS (SELECT ok.sample_id, ok.first, (bl.s - t0) / (t1 - t0) AS y FROM ok JOIN bl ON bl.sample_id = ok.sample_id AND (bl.k < ok.first OR bl.k > ok.first + 2)),
cf AS (SELECT y.sample_id, y.first, count(*) AS c FROM y JOIN g USING (sample_id, first) JOIN (VALUES (0), (1), (2)) n(j) ON y + m >= j / 3.0::DOUBLE - 1e-9 AND y + m < (j + 1) / 3.0::DOUBLE - 1e-9 GROUP BY 1, 2)
SELECT x.sample_id, x.first, round(avg(abs(x + m - a)) + coalesce(max(c), 0), 5) AS cost, round(avg(abs(x + m - a)) * 3, 5) AS error, CAST(coalesce(max(c), 0) AS INTEGER) AS conflicts FROM x JOIN g USING (sample_id, first) LEFT JOIN cf USING (sample_id, first) GROUP BY 1, 2"""


@query(Q4_SQL)
def q4_shape_evidence(spark, d):
    e = evidence.shape_evidence(*runs(spark, d), evidence.RhythmQuery(NOTES))
    return e.select("sample_id", "first", F.round("cost", 5).alias("cost"), F.round("error", 5).alias("error"), "conflicts")


def schemes(spark, d):
    """Two plans of each sample: beats of 40 and of 25 seconds."""
    plans = runs(spark, d)[1]
    each = plans.withColumn("plan", F.explode(F.array(F.lit("near_fast"), F.lit("near_slow")))).withColumn("beat_seconds", F.when(F.col("plan") == "near_fast", 40.0).otherwise(25.0))
    points = F.transform("onsets", lambda o: F.struct(o.alias("src"), (o / F.col("beat_seconds")).alias("beat")))
    return each.select("sample_id", "scope", "plan", "start", "stop", F.lit(1.0).alias("density"), F.when(F.col("plan") == "near_fast", 1.25).otherwise(0.8).alias("speed"), F.lit(1.0).alias("ratio"), "beat_seconds", F.transform("onsets", lambda o: F.lit(1)).alias("cells"), F.transform("onsets", lambda o: o / F.col("beat_seconds")).alias("onsets"), points.alias("points"), points.alias("exact"))


Q5_SQL = Q_BASE + """, pl(plan, bs, sp) AS (VALUES ('near_fast', 40.0::DOUBLE, 1.25::DOUBLE), ('near_slow', 25.0::DOUBLE, 0.8::DOUBLE)), x AS (SELECT wn.sample_id, wn.first, plan, sp, bs, j, s / bs AS x FROM wn JOIN ok USING (sample_id, first) CROSS JOIN pl), g AS (SELECT sample_id, first, plan, median(j - x) AS m FROM x GROUP BY 1, 2, 3),
y AS (SELECT ok.sample_id, ok.first, plan, bl.s / bs AS y FROM ok JOIN bl ON bl.sample_id = ok.sample_id AND (bl.k < ok.first OR bl.k > ok.first + 2) CROSS JOIN pl),
cf AS (SELECT y.sample_id, y.first, y.plan, count(*) AS c FROM y JOIN g USING (sample_id, first, plan) JOIN (VALUES (0), (1), (2)) n(j) ON y + m >= j - 1e-9 AND y + m < j + 1 - 1e-9 GROUP BY 1, 2, 3),
ev AS (SELECT x.sample_id, x.first, x.plan, max(sp) AS speed, avg(abs(x + m - j)) + coalesce(max(c), 0) + 0.1 * abs(log2(max(sp))) AS cost, coalesce(max(c), 0) AS conflicts FROM x JOIN g USING (sample_id, first, plan) LEFT JOIN cf USING (sample_id, first, plan) GROUP BY 1, 2, 3)"""


@query(f"{Q5_SQL} SELECT sample_id, first, plan, round(cost, 5) AS cost, CAST(conflicts AS INTEGER) AS conflicts FROM ev")
def q5_beat_evidence(spark, d):
    e = evidence.beat_evidence(runs(spark, d)[0], schemes(spark, d), evidence.RhythmQuery(NOTES, speed_weight=0.1))
    return e.select("sample_id", "first", "plan", F.round("cost", 5).alias("cost"), "conflicts")


@query(f"{Q5_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, first ORDER BY round(cost, 10), speed < 1, plan) AS n FROM ev) SELECT sample_id, first, round(cost, 5) AS cost FROM r WHERE n = 1")
def q8_choose_evidence(spark, d):
    q = evidence.RhythmQuery(NOTES, speed_weight=0.1)
    w = runs(spark, d)[0]
    return evidence.choose_evidence(w, evidence.beat_evidence(w, schemes(spark, d), q), q)[0].select("sample_id", "first", F.round("cost", 5).alias("cost"))


@query("WITH g AS (SELECT l_orderkey AS id, l_discount AS x, l_tax AS a FROM lineitem), d AS (SELECT id, x, a, a - x AS g FROM g), lim AS (SELECT id, max(g) - 0.05 AS lo, min(g) + 0.05 AS hi FROM d GROUP BY 1), c AS (SELECT p.id, (p.g + q.g) / 2 AS s FROM d p JOIN d q ON p.id = q.id UNION SELECT id, lo FROM lim UNION SELECT id, hi FROM lim UNION SELECT id, 0 FROM lim), f AS (SELECT DISTINCT c.id, s FROM c JOIN lim USING (id) WHERE s >= lo - 1e-12 AND s <= hi + 1e-12), e AS (SELECT f.id, s, avg(abs(s - g)) AS err FROM f JOIN d USING (id) GROUP BY 1, 2) SELECT id, round(min(err), 9) AS err FROM e GROUP BY 1")
def q6_shift_fit(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("a"), (F.col("l_tax") + 0.01).alias("b"))).alias("n"))
    fit = evidence.shift_fit(F.transform("n", lambda s: s["x"]), F.array().cast("array<double>"), F.transform("n", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))), 0.05)
    return g.select("id", F.explode(F.array(fit)).alias("f")).where("f is not null").select("id", F.round("f.mean", 9).alias("err"))


# ---- lineage and analysis


def inputs(spark, d):
    c = F.col("c_custkey")
    origin = F.when(c % 50 == 0, "stream").when(c % 11 == 3, "separation").when(c % 13 == 5, "reimport").otherwise("cut")
    return table(spark, d, "customer").select(c.alias("id"), (c - c % 7 - 1).alias("input_id"), origin.alias("origin"))


IN = "a AS (SELECT c_custkey AS id, c_custkey - c_custkey % 7 - 1 AS p, CASE WHEN c_custkey % 50 = 0 THEN 'stream' WHEN c_custkey % 11 = 3 THEN 'separation' WHEN c_custkey % 13 = 5 THEN 'reimport' ELSE 'cut' END AS o FROM customer)"
UP = f"WITH RECURSIVE {IN}, up AS (SELECT id, id AS anc, 0 AS depth FROM a UNION ALL SELECT up.id, a.p, up.depth + 1 FROM up JOIN a ON a.id = up.anc JOIN a b ON b.id = a.p WHERE up.depth < 31 AND {{stop}})"


@query(f"{UP.format(stop=chr(97) + '.o <> ' + chr(39) + 'stream' + chr(39))}, l AS (SELECT up.*, max(depth) OVER (PARTITION BY up.id) AS top FROM up) SELECT l.id, l.depth, l.anc AS ancestor, max(CASE WHEN l.depth = top AND o = 'stream' THEN 1 ELSE 0 END) OVER (PARTITION BY l.id) = 1 AS complete FROM l JOIN a ON a.id = l.anc")
def j9_asset_chain(spark, d):
    return lineage.asset_chain(inputs(spark, d))


@query(f"{UP.format(stop='TRUE')}, r AS (SELECT up.id, min(CASE WHEN o = 'reimport' THEN depth END) AS dr, max(CASE WHEN o = 'separation' THEN 1 ELSE 0 END) AS sep FROM up JOIN a ON a.id = up.anc GROUP BY 1) SELECT r.id, coalesce(up.anc, -1) AS reimport_id, sep = 1 AS from_separation FROM r LEFT JOIN up ON up.id = r.id AND up.depth = dr")
def j11_inherited_facts(spark, d):
    return lineage.inherited_facts(inputs(spark, d)).withColumn("reimport_id", F.coalesce("reimport_id", F.lit(-1)))


@query(f"{UP.format(stop='TRUE')}, f AS (SELECT up.id, min(CASE WHEN anc % 6 = 0 THEN depth END) AS df, max(depth) AS top FROM up GROUP BY 1), s AS (SELECT f.id, u.anc AS found, (t.anc % 20) AS src FROM f LEFT JOIN up u ON u.id = f.id AND u.depth = f.df JOIN up t ON t.id = f.id AND t.depth = f.top) SELECT id, CASE WHEN found IS NOT NULL THEN found WHEN src % 3 = 0 THEN 1000000 + src WHEN src % 4 <> 0 THEN 2000000 + src * 10 + src % 2 ELSE 2000000 + src * 10 END AS track FROM s")
def j10_back_track(spark, d):
    k = lambda x, y: F.struct(F.lit(x).alias("local"), y.alias("source"))
    shift = F.when(F.col("id") % 6 == 0, 0.0).otherwise(5.0)
    a = inputs(spark, d).withColumns({"source_id": F.col("id") % 20, "mapping": F.array(k(0.0, shift), k(100.0, shift + 100))})
    s = a.select("source_id").distinct().withColumns({"available": F.col("source_id") % 4 != 0, "default_vocal": F.when(F.col("source_id") % 3 == 0, 1000000 + F.col("source_id")), "default_stream": F.col("source_id") % 2, "duration": F.lit(100.0)})
    s = s.withColumn("available", F.col("available") | F.col("default_vocal").isNotNull())
    streams = s.select("source_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ordinal")).withColumn("asset_id", 2000000 + F.col("source_id") * 10 + F.col("ordinal"))
    return lineage.back_track(a, s, streams)


@query("WITH p AS (SELECT l_orderkey AS id, l_linenumber AS i, CASE WHEN l_partkey % 5 = 0 THEN 'pau' ELSE 'a' END AS label, CAST(l_linenumber * 10 AS DOUBLE) AS s, CAST(l_linenumber * 10 + 8 AS DOUBLE) AS e FROM lineitem), q AS (SELECT *, greatest(s, 14.0) AS a, least(e, 55.0) AS b FROM p WHERE e > 14 + 1e-6 AND s < 55 - 1e-6) SELECT id, CAST(i AS INTEGER) AS idx, label, round((a - 14.0) * 100 / 41.0, 4) AS start, round((b - 14.0) * 100 / 41.0, 4) AS \"end\", label <> 'pau' AND (a > s + 1e-6 OR b < e - 1e-6) AS clipped FROM q")
def j12_phones_to_reader(spark, d):
    none = F.lit(None).cast("double")
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("reader_id"), F.col("l_linenumber").cast("int").alias("idx"), F.when(F.col("l_partkey") % 5 == 0, "pau").otherwise("a").alias("label"), (F.col("l_linenumber") * 10).cast("double").alias("start"), (F.col("l_linenumber") * 10 + 8).cast("double").alias("end"), none.alias("eff_start"), none.alias("eff_end"))
    k = lambda x, y: F.struct(F.lit(x).alias("local"), F.lit(y).alias("source"))
    readers = table(spark, d, "orders").select(F.col("o_orderkey").alias("reader_id"), F.array(k(0.0, 14.0), k(100.0, 55.0)).alias("mapping"))
    return lineage.phones_to_reader(p, readers).select(F.col("reader_id").alias("id"), "idx", "label", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "clipped")


@query("""WITH li AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS l_linenumber FROM lineitem), p AS (SELECT l_orderkey AS id, l_linenumber AS u, unnest([0, 1, 2]) AS i, l_linenumber * 10.0::DOUBLE AS b0, CASE WHEN l_orderkey % 10 = 0 THEN 12.0::DOUBLE ELSE 7.0::DOUBLE END AS len FROM li),
ph AS (SELECT id, u, i, CASE WHEN i = 2 THEN 'pau' ELSE 'a' END AS label, b0 + CASE i WHEN 0 THEN 0 WHEN 1 THEN len / 2 ELSE len END AS s, b0 + CASE i WHEN 0 THEN len / 2 WHEN 1 THEN len ELSE len + 1 END AS e, i AS mora FROM p),
o AS (SELECT id, u, row_number() OVER (PARTITION BY id ORDER BY u) AS pl, lead(u) OVER (PARTITION BY id ORDER BY u) AS nx, lag(u) OVER (PARTITION BY id ORDER BY u) AS pv FROM (SELECT DISTINCT id, u FROM ph)),
bad AS (SELECT id FROM (SELECT id, u, min(greatest(s, 15)) AS s, max(least(e, 75)) AS e FROM ph WHERE label <> 'pau' AND e > 15 AND s < 75 GROUP BY 1, 2) WHERE id % 10 = 0 GROUP BY id HAVING max(CASE WHEN FALSE THEN 1 ELSE 0 END) = 0 AND count(*) > 1),
k AS (SELECT ph.id, ph.u, ph.label, ph.s, ph.e, CASE WHEN i < 2 THEN mora + (pl - 1) * 2 END AS mora FROM ph JOIN o USING (id, u) WHERE i < 2 OR nx IS NULL UNION ALL SELECT o.id, o.u, 'pau', pv * 10.0 + 7, o.u * 10.0, NULL FROM o WHERE pv IS NOT NULL AND id % 10 <> 0)
SELECT id, CAST(u AS INTEGER) AS unit, label, round(greatest(s, 15), 4) AS start, round(least(e, 75), 4) AS "end", CAST(mora AS BIGINT) AS mora FROM k WHERE e > 15 AND s < 75 AND id NOT IN (SELECT id FROM bad)""")
def j13_merge_units(spark, d):
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id"), place.alias("unit"))  # noqa: E741
    size = F.when(F.col("sample_id") % 10 == 0, 12.0).otherwise(7.0)
    at = lambda x: F.col("unit") * 10.0 + x
    phone = lambda i, label, a, b, m: F.struct(F.lit(i).alias("idx"), F.lit(label).alias("label"), at(a).alias("start"), at(b).alias("end"), F.lit(m).cast("long").alias("mora"))
    p = l.select("*", F.inline(F.array(phone(0, "a", F.lit(0.0), size / 2, 0), phone(1, "a", size / 2, size, 1), phone(2, "pau", size, size + 1, None)))).withColumns({"word": F.lit(None).cast("long"), "clipped": F.lit(False)})
    units = l.select("sample_id", "unit", F.col("unit").alias("ordinal"), F.lit(2).alias("n_morae"), F.lit(0).alias("n_words"))
    merged, _ = lineage.merge_units(p, units, l.select("sample_id").distinct().select("sample_id", F.lit(15.0).alias("w0"), F.lit(75.0).alias("w1")))
    return merged.select(F.col("sample_id").alias("id"), "unit", "label", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "mora")


def run_rows(spark, d):
    l = F.col  # noqa: E741
    segments = table(spark, d, "orders").select(l("o_orderkey").alias("id"), (l("o_custkey") % 50).alias("source_id"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("t").alias("text"), (l("o_orderkey") % 8 != 0).alias("voiced"))
    # runs of one number were made in the order of their rows in the files
    created = F.struct(l("l_linenumber"), l("_metadata.file_path"), l("_metadata.row_index"))
    runs_ = table(spark, d, "lineitem").where("l_quantity < 25").select(l("l_orderkey").alias("segment_id"), F.when(l("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), F.lit(0.0).alias("seg_start"), F.when(l("l_partkey") % 3 == 0, 1.0).otherwise(2.0).alias("seg_end"), F.lit("t").alias("seg_text"), F.when(l("l_suppkey") % 2 == 0, "symbols").otherwise("crash").alias("reason"), created.alias("created_at"))
    return segments, runs_


A7 = "rn AS (SELECT l_orderkey AS id, l_returnflag <> 'R' AS ok, l_partkey % 3 = 0 AS same, l_suppkey % 2 = 0 AS sym, l_linenumber AS n FROM lineitem WHERE l_quantity < 25), st AS (SELECT o_orderkey AS id, o_custkey % 50 AS source_id, o_orderkey % 8 <> 0 AS voiced, coalesce(bool_or(ok AND same), false) AS u, coalesce(bool_or(ok), false) AS k, count(ok) AS c, max_by(NOT ok AND same AND sym, n) AS stuck FROM orders LEFT JOIN rn ON rn.id = o_orderkey GROUP BY 1, 2, 3)"


@query(f"WITH {A7} SELECT id, CASE WHEN NOT voiced THEN NULL WHEN u THEN 'ok' WHEN k THEN 'stale' WHEN c > 0 THEN 'failed' ELSE 'none' END AS state FROM st")
def a7_segment_state(spark, d):
    return planning.segment_state(*run_rows(spark, d))


@query(f"WITH {A7} SELECT source_id, count(*) AS speech, CAST(sum(CASE WHEN u THEN 1 ELSE 0 END) AS BIGINT) AS analyzed, CAST(sum(CASE WHEN NOT u AND stuck THEN 1 ELSE 0 END) AS BIGINT) AS unreadable FROM st GROUP BY 1")
def a6_unit_counts(spark, d):
    segments, runs_ = run_rows(spark, d)
    usable = planning.segment_state(segments.withColumn("voiced", F.lit(True)), runs_).where("state = 'ok'").select(F.col("id").alias("segment_id"))
    return planning.unit_counts(segments, usable, runs_, ("symbols",))


@query("WITH r AS (SELECT o_orderkey AS u, o_orderkey % 10 = 0 AS del, o_orderkey % 7 <> 0 AS track, o_orderkey % 5 <> 0 AS cov, o_custkey % 4 AS f FROM orders), v AS (SELECT o_orderkey AS u, o_orderkey % 4 AS g FROM orders WHERE o_orderstatus <> 'O') SELECT r.u AS unit_id, CASE WHEN del THEN 'blocked' WHEN NOT track THEN 'blocked' WHEN NOT cov THEN 'blocked' WHEN f = g THEN 'fresh' ELSE 'run' END AS action, CASE WHEN del THEN 'segment-deleted' WHEN NOT track THEN 'no-track' WHEN NOT cov THEN 'not-covered' END AS reason, NOT del AND track AND cov AND coalesce(f = g, false) AS was_fresh FROM r LEFT JOIN v ON v.u = r.u")
def j22_plan_analysis(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    asked = o.select(k.alias("unit_id"), (k % 10 == 0).alias("segment_deleted"), F.when(k % 7 != 0, "t").alias("track"), (k % 5 != 0).alias("covered"), (F.col("o_custkey") % 4).alias("fingerprint"))
    usable = o.where("o_orderstatus <> 'O'").select(k.alias("unit_id"), (k % 4).alias("fingerprint"))
    return planning.plan_analysis(asked.union(asked.where("unit_id % 3 = 0")), usable)


# ---- pitch


@query(f"{F3_SQL}, ht AS (SELECT h.sound, h.start FROM h JOIN gap USING (sound, start) WHERE longest <= 4), sp2 AS (SELECT ht.sound, ht.start, b.frame - ht.start AS off, CASE WHEN b.ok THEN b.midi END AS midi FROM ht JOIN fr b ON b.sound = ht.sound AND b.frame >= ht.start AND b.frame < ht.start + 20), q AS (SELECT sound, start, off // 10 AS blk, quantile_cont(midi, 0.9) - quantile_cont(midi, 0.1) AS w FROM sp2 GROUP BY 1, 2, 3) SELECT sound, start FROM q GROUP BY 1, 2 HAVING max(w) * 100 <= 130 + 1e-9")
def f8_steady_hits(spark, d):
    f = sound_frames(spark, d)
    return frames.steady_hits(frames.search_pitch(f, PITCH), f, PITCH, spread=130.0).select("sound", "start")


@query(f"{F3_SQL}, ht AS (SELECT h.sound, h.start FROM h JOIN gap USING (sound, start) WHERE longest <= 4) SELECT sound, start FROM ht WHERE start % 50 <= 30 AND start % 50 <= 5")
def f4_allowed_starts(spark, d):
    f = sound_frames(spark, d)
    last = f.groupBy("sound").agg(F.max("frame").alias("m"))
    at = last.select("sound", F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 50))).alias("i"))
    areas = at.select("sound", (F.col("i") * 50).alias("f_start"), (F.col("i") * 50 + 50).alias("f_end"))
    lines = at.select("sound", (F.col("i") * 0.5).alias("start"), (F.col("i") * 0.5 + 0.5).alias("end"))
    hits = frames.allowed_starts(frames.search_pitch(f, PITCH), areas, lines, head=0.05)
    return hits.select("sound", "start")


@query("WITH f AS (SELECT l_suppkey AS asset_id, CASE WHEN l_tax > 0.02 THEN l_quantity END AS m FROM lineitem) SELECT asset_id, round(CASE WHEN count(m) >= 3 THEN median(m) END, 6) AS pitch, round(CASE WHEN count(m) >= 3 THEN quantile_cont(m, 0.9) - quantile_cont(m, 0.1) END, 6) AS wobble, round(count(m) * 0.01::DOUBLE, 6) AS voiced FROM f GROUP BY 1")
def a21_pitch_metrics(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset_id"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("midi"))
    return measures.pitch_metrics(f).select("asset_id", *(F.round(c, 6).alias(c) for c in ("pitch", "wobble", "voiced")))


# ---- names


@query("WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS m, o_orderkey % 120 AS n FROM orders) SELECT id, CASE m WHEN 0 THEN ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][n % 12 + 1] || (n // 12 - 1) WHEN 1 THEN 'A4' END AS name, CASE m WHEN 2 THEN 'bare-number' WHEN 3 THEN 'target-empty' WHEN 4 THEN 'target-unparsable' END AS error FROM o")
def x7_manual_target(spark, d):
    n = F.col("o_orderkey") % 120
    note = F.concat(F.element_at(F.array(*map(F.lit, ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"))), (n % 12 + 1).cast("int")), (F.floor(n / 12) - 1).cast("string"))
    m = F.col("o_orderkey") % 5
    text = F.when(m == 0, note).when(m == 1, "440 Hz").when(m == 2, n.cast("string")).when(m == 3, " ").otherwise("H9")
    t = naming.manual_target(text)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), t["name"].alias("name"), t["error"].alias("error"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'said — yomi' WHEN o_orderkey % 4 = 1 THEN 'one / two' WHEN o_orderkey % 4 = 2 THEN 'src 0:01.500–1:00:00.000' ELSE 'src · local 0:01.500–1:00:00.000' END AS name FROM orders")
def x12_suggest_name(spark, d):
    m = F.col("o_orderkey") % 4
    texts = F.when(m == 1, F.array(F.lit(" one"), F.lit(""), F.lit("two"), F.lit("one ")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), naming.suggest_name(F.when(m == 0, "said "), F.lit("yomi"), texts, F.lit("src"), F.lit(1.5), F.lit(3600.0), m == 2, F.lit("local ")).alias("name"))


@query("WITH l AS (SELECT l_orderkey AS g, l_linenumber AS i, l_linenumber // 3 AS w, l_linenumber // 2 AS m FROM lineitem), p AS (SELECT g, i, w, m, i <= 4 AS hit FROM l), wd AS (SELECT g, w, count(*) = count(*) FILTER (hit) AS whole, count(*) FILTER (hit) AS hits, min(i) AS i0 FROM p GROUP BY 1, 2), mo AS (SELECT p.g, p.w, p.m, min(i) AS i0, count(*) = count(*) FILTER (hit) AS whole, count(*) FILTER (hit) AS got FROM p GROUP BY 1, 2, 3), pc AS (SELECT mo.g, mo.w, string_agg(CASE WHEN got = 0 THEN '' WHEN mo.whole THEN 'k' || m ELSE repeat('a', CAST(got AS INTEGER)) END, '' ORDER BY mo.i0) AS s FROM mo GROUP BY 1, 2), f AS (SELECT wd.g, string_agg(CASE WHEN wd.whole THEN 'W' || wd.w ELSE s END, '' ORDER BY i0) AS frag, bool_and(wd.whole) AS whole, max(hits) AS hits FROM wd JOIN pc ON pc.g = wd.g AND pc.w = wd.w GROUP BY 1) SELECT g AS id, CASE WHEN whole THEN '' ELSE frag END AS fragment, whole FROM f WHERE hits > 0")
def w18_partial_fragments(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("idx"))  # noqa: E741
    p = l.withColumns({"label": F.lit("a"), "start": F.col("idx").cast("double"), "end": (F.col("idx") + 1).cast("double"), "mora": F.floor(F.col("idx") / 2), "word": F.floor(F.col("idx") / 3)})
    words = p.select("segment_id", "word", F.concat(F.lit("W"), F.col("word").cast("string")).alias("text")).distinct()
    morae = p.select("segment_id", "mora", F.concat(F.lit("k"), F.col("mora").cast("string")).alias("kana")).distinct()
    sel = l.select(F.col("segment_id").alias("id"), "segment_id").distinct().withColumns({"start": F.lit(0.0), "end": F.lit(5.0)})
    return naming.partial_fragments(sel, p, words, morae).select("id", "fragment", "whole")


@query(f"{F3_SQL}, k AS (SELECT h.*, h.start - row_number() OVER (PARTITION BY h.sound ORDER BY h.start) AS i FROM h JOIN gap USING (sound, start) WHERE longest <= 4), r AS (SELECT *, row_number() OVER (PARTITION BY sound, i ORDER BY score, start) AS r FROM k) SELECT sound, start, round(start * 0.01::DOUBLE + 5, 6) AS source_start, round(start * 0.01::DOUBLE + 5.2, 6) AS source_end FROM r WHERE r = 1 AND sound % 2 = 0")
def f12_search_tracks(spark, d):
    f = sound_frames(spark, d)
    k = lambda x, y: F.struct(F.lit(x).alias("local"), F.lit(y).alias("source"))
    tracks = f.groupBy("sound").agg((F.max("frame") + 1).alias("f_end")).select("sound", F.col("sound").alias("id"), F.lit(0).cast("long").alias("f_start"), "f_end", F.array(k(0.0, 5.0), k(1e6, 1e6 + 5)).alias("mapping"))
    chunks = tracks.where("sound % 2 = 0").select("sound", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("f_end") - 1) / 6000))).alias("chunk"))
    hits = frames.search_tracks(f, tracks, chunks, PITCH)
    return hits.select("sound", "start", F.round("source_start", 6).alias("source_start"), F.round("source_end", 6).alias("source_end"))


# ---- clocks, texts and small rules


def knots_to(end):
    k = lambda x, y: F.struct(x.cast("double").alias("local"), y.cast("double").alias("source"))
    return F.array(k(F.lit(0.0), F.lit(0.0)), k(F.lit(50.0), F.lit(50.01)), k(end, end))


@query("SELECT o_orderkey AS id, abs(100.0 - (90 + o_orderkey % 20)) <= 0.02 AS whole FROM orders")
def p6_full_track(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), clocks.is_full_track(knots_to(F.lit(100.0)), (90 + F.col("o_orderkey") % 20).cast("double")).alias("whole"))


@query("WITH o AS (SELECT o_orderkey AS id, CAST(80 + o_orderkey % 40 AS DOUBLE) AS dur FROM orders) SELECT id, CASE WHEN abs(100 - dur) <= 0.04 THEN 100.0::DOUBLE ELSE least(dur, 100) END AS local_end, round(CASE WHEN abs(100 - dur) <= 0.04 OR dur >= 100 THEN 100.0::DOUBLE ELSE 50.01 + (dur - 50) * (49.99 / 50) END, 6) AS source_end FROM o")
def p5_reimport_mapping(spark, d):
    dur = (80 + F.col("o_orderkey") % 40).cast("double")
    m = F.element_at(clocks.reimport_mapping(knots_to(F.lit(100.0)), dur, F.lit(0.04)), -1)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), m["local"].alias("local_end"), F.round(m["source"], 6).alias("source_end"))


@query("SELECT o_orderkey AS id, CAST(floor((o_orderkey * 0.0037::DOUBLE - 0.005::DOUBLE) / 0.01::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS frame FROM orders")
def j14_frame_of(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), clocks.frame_of(F.col("o_orderkey") * F.lit(0.0037)).alias("frame"))


@query("SELECT p_partkey AS id, 'かヵ' || p_name AS hira, nfc_normalize('e' || chr(769) || p_name) AS composed FROM part".replace("かヵ", "か" + chr(0x3095)))
def x2_x3_kana_and_nfc(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), text.to_hiragana(F.concat(F.lit("カヵ"), "p_name")).alias("hira"), text.nfc(F.concat(F.lit("e" + chr(769)), "p_name")).alias("composed"))


@query("WITH n AS (SELECT p_partkey AS id, p_partkey % 128 AS n FROM part) SELECT id, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][n % 12 + 1] || (n // 12 - 1) || '+20c' AS name, n AS back FROM n")
def x6_note_names(spark, d):
    n = (F.col("p_partkey") % 128).cast("double")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), naming.cents_name(n + 0.2).alias("name"), text.midi_of_note(text.note_name(n)).cast("long").alias("back"))


@query("SELECT o_orderkey AS id, 'a_b_c ' || (o_orderkey % 9) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' END AS part, CASE WHEN o_orderkey % 2 = 0 THEN 'éé' ELSE 'ééz' END AS cut FROM orders")
def x10_file_parts(spark, d):
    i = F.col("o_orderkey")
    name = F.concat(F.lit("a/b:c   "), (i % 9).cast("string"), F.when(i % 2 == 0, ". .").otherwise("x"))
    return table(spark, d, "orders").select(i.alias("id"), text.file_part(name).alias("part"), text.cut_bytes(F.when(i % 2 == 0, "ééé").otherwise("ééz"), 5).alias("cut"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'きゃ|ら|め|る' ELSE 'シュ|ー|ト' END AS morae FROM orders")
def x16_morae(spark, d):
    kana = F.when(F.col("o_orderkey") % 2 == 0, "きゃらめる").otherwise("シュート")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(text.morae(kana), "|").alias("morae"))


@query(f"WITH {BL} SELECT sample_id, k, coalesce(s > lag(s) OVER w AND value > lag(value) OVER w, true) AS rising FROM bl WINDOW w AS (PARTITION BY sample_id ORDER BY k)")
def w10_control_points(spark, d):
    plan = blocks(spark, d).select("sample_id", "k", F.col("onset").alias("at"), F.col("strength").alias("target"))
    return planning.control_points(plan).select("sample_id", "k", "rising")


@query("WITH p AS (SELECT o_custkey AS source_id, CAST(o_orderkey % 1000 AS DOUBLE) AS s, o_orderkey % 9 = 0 AS bad, o_orderkey FROM orders WHERE o_orderkey % 7 < 4), c AS (SELECT * FROM p WHERE source_id NOT IN (SELECT source_id FROM p WHERE bad)), r AS (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY s) AS i FROM c) SELECT source_id, s AS start, CASE WHEN n = 2 THEN CASE WHEN i = 1 THEN 'op' ELSE 'ed' END WHEN s + 45 < 500 THEN 'op' ELSE 'ed' END AS kind FROM r")
def w15_name_pairs(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 7 < 4")
    s = (F.col("o_orderkey") % 1000).cast("double")
    pairs = o.select(F.col("o_custkey").alias("source_id"), s.alias("start"), (s + 90).alias("end"), F.when(F.col("o_orderkey") % 9 == 0, "out-of-range").alias("error"))
    return sequences.name_pairs(pairs, o.select(F.col("o_custkey").alias("source_id"), F.lit(1000.0).alias("duration")).distinct()).select("source_id", "start", "kind")


@query("WITH v AS (SELECT vec_id AS id, label AS key, vec_id * 0.5::DOUBLE AS s, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), j AS (SELECT id, key, CASE WHEN s - (lag(s) OVER w + 0.3) <= 5 AND list_dot_product(v, lag(v) OVER w) >= 0 THEN 0 ELSE 1 END AS new FROM v WINDOW w AS (PARTITION BY key ORDER BY s, id)) SELECT id, CAST(sum(new) OVER (PARTITION BY key ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chain FROM j")
def w19_chain_neighbours(spark, d):
    at = F.col("vec_id") * 0.5
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("key"), at.alias("start"), (at + 0.3).alias("end"), F.col("embedding").alias("v"))
    return vectors.chain_neighbours(rows, 5.0, 0.0).select("id", "chain")


@query(f"WITH {SP} SELECT id, source_id, round(s, 6) AS start, 'mood:m2' AS tag FROM sp WHERE kind = 'click' AND id % 4 = 0 AND id % 6 = 2")
def e11_promote(spark, d):
    local = spans(spark, d, "click").where("id % 4 = 0").select(F.col("id").alias("sample_id"), F.concat(F.lit("mood:m"), (F.col("id") % 6).cast("string")).alias("tag"))
    return tags.promote(spans(spark, d, "click"), local, "mood:m2").select("id", "source_id", F.round("start", 6).alias("start"), F.col("tags")[0].alias("tag"))


@query("WITH f AS (SELECT DISTINCT l_orderkey AS key, l_linenumber * 0.01::DOUBLE AS t, l_quantity AS m, greatest(l_tax, 1e-6) AS w FROM lineitem WHERE l_linenumber < 6 AND l_discount > 0.01), n AS (SELECT key FROM f GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT key, m, sum(w) OVER (PARTITION BY key ORDER BY m ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY key) AS tot FROM (SELECT key, m, sum(w) AS w FROM f JOIN n USING (key) GROUP BY 1, 2)), v AS (SELECT key, min(m) AS m FROM c WHERE cum >= tot / 2 - 1e-12 * tot GROUP BY 1) SELECT o_orderkey AS key, floor(m + 0.5) AS midi, CASE WHEN m IS NULL THEN 'flatten-f0-insufficient' END AS error FROM orders LEFT JOIN v ON v.key = o_orderkey")
def a25_target_pitch(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 0.01).alias("t"), F.when(F.col("l_discount") > 0.01, F.col("l_quantity")).alias("midi"), F.col("l_tax").alias("conf"))
    parts = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.lit(0.0).alias("start"), F.lit(0.055).alias("end"))
    return measures.target_pitch(f, parts).select("key", "midi", "error")
