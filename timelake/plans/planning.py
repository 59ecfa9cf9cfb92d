"""Queries over plans and states, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from timelake.operators import planning
from timelake.plans.timeline import ON, SP, blocks, spans, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS a, CAST(o_orderkey % 100 AS DOUBLE) AS s, CAST(o_orderkey % 100 + 5 AS DOUBLE) AS e FROM orders), st AS (SELECT c_custkey AS sid, c_custkey - c_custkey % 3 AS a, CASE WHEN c_custkey % 2 = 0 THEN 'primary' ELSE 'cache' END AS kind, CAST((c_custkey % 4) * 20 AS DOUBLE) AS w0, CAST((c_custkey % 4) * 20 + 60 AS DOUBLE) AS w1 FROM customer), r AS (SELECT o.id, sid, s - w0 AS f, row_number() OVER (PARTITION BY o.id ORDER BY kind <> 'primary', sid) AS n FROM o JOIN st ON st.a = o.a AND w0 <= s AND w1 >= e) SELECT o.id, coalesce(sid, -1) AS storage_id, f AS file_start FROM o LEFT JOIN r ON r.id = o.id AND n = 1")
def p8_locate_storage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("asset_id"), (F.col("o_orderkey") % 100).cast("double").alias("start"), (F.col("o_orderkey") % 100 + 5).cast("double").alias("end"))
    w0 = (F.col("c_custkey") % 4 * 20).cast("double")
    st = table(spark, d, "customer").select(F.col("c_custkey").alias("storage_id"), (F.col("c_custkey") - F.col("c_custkey") % 3).alias("asset_id"), F.when(F.col("c_custkey") % 2 == 0, "primary").otherwise("cache").alias("kind"), w0.alias("w_start"), (w0 + 60).alias("w_end"))
    return planning.locate_storage(o, st).withColumn("storage_id", F.coalesce("storage_id", F.lit(-1)))


def roles(spark, d):
    role = F.element_at(F.array(F.lit("vocal"), F.lit("drums"), F.lit("bass")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("asset_id"), role.alias("role"), F.when(F.col("l_quantity") > 10, "on").otherwise("off").alias("state"))


ROLES = "ro AS (SELECT l_orderkey AS asset_id, ['vocal', 'drums', 'bass'][l_linenumber % 3 + 1] AS role, CASE WHEN l_quantity > 10 THEN 'on' ELSE 'off' END AS state FROM lineitem WHERE l_orderkey % 3 <> 0)"


@query(f"WITH {ROLES}, r AS (SELECT asset_id, bool_or(role = 'vocal') AS v FROM ro WHERE state = 'on' GROUP BY 1) SELECT o_orderkey AS id, coalesce(v, o_orderkey % 5 <> 0) AS voiced FROM orders LEFT JOIN r ON asset_id = o_orderkey")
def p17_voiced(spark, d):
    return planning.voiced(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 5 == 0).alias("separated")), roles(spark, d))


@query(f"WITH {ROLES}, r AS (SELECT DISTINCT asset_id, role FROM ro WHERE state = 'on') SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT asset_id FROM r WHERE role = 'bass') OR o_orderkey NOT IN (SELECT asset_id FROM r)")
def p16_list_tracks(spark, d):
    return planning.list_tracks(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), roles(spark, d), ["bass", "mix"])


@query(f"WITH {ROLES}, st AS (SELECT o_orderkey AS asset_id, upper(o_orderstatus) AS stem FROM orders), al(alias, role) AS (VALUES ('o', 'vocal'), ('F', 'drums')) SELECT DISTINCT asset_id, al.role FROM st JOIN al ON lower(stem) = lower(alias) WHERE NOT EXISTS (SELECT 1 FROM ro WHERE ro.asset_id = st.asset_id AND ro.role = al.role)")
def p18_prefill_roles(spark, d):
    stems = table(spark, d, "orders").select(F.col("o_orderkey").alias("asset_id"), F.upper("o_orderstatus").alias("stem"))
    return planning.prefill_roles(stems, spark.createDataFrame([("o", "vocal"), ("F", "drums")], "alias string, role string"), roles(spark, d))


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j17_unused(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("id"))
    return planning.unused(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), o, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 7 = 0 THEN 'deleted' WHEN o_orderkey % 5 = 0 THEN 'changed' WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE 'ok' END AS state FROM orders")
def j18_result_state(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("binding"), F.col("o_orderpriority").alias("signature"))
    now = o.where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, "x").otherwise(F.col("binding")).alias("binding"), F.when(F.col("id") % 3 == 0, "y").otherwise(F.col("signature")).alias("signature"), (F.col("id") % 7 == 0).alias("deleted"))
    return planning.result_state(o, now)


@query("WITH st AS (SELECT l_orderkey AS o, (min({'n': l_linenumber, 'p': 'v' || l_partkey})).p AS p FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus <> 'F' GROUP BY 1) SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'own' WHEN o_orderkey % 7 = 0 THEN 'src' ELSE p END AS picture, CASE WHEN o_orderkey % 5 = 0 THEN 'sample' WHEN o_orderkey % 7 = 0 THEN 'source' WHEN p IS NOT NULL THEN 'stream' END AS origin FROM orders LEFT JOIN st ON st.o = o_orderkey")
def j19_effective_picture(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("source_id"))
    st = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.concat(F.lit("v"), F.col("l_partkey").cast("string")).alias("stream"), F.col("l_linenumber").alias("ordinal"), F.when(F.col("l_returnflag") == "N", "video").otherwise("audio").alias("kind"), (F.col("l_linestatus") == "F").alias("cover"))
    return planning.effective_picture(s, s.where("id % 5 = 0").select("id", F.lit("own").alias("picture")), s.where("id % 7 = 0").select("source_id", F.lit("src").alias("picture")), st)


@query("WITH r AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey % 4 = 0 DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) - 1 AS duplicates FROM orders) SELECT id, duplicates FROM r WHERE n = 1")
def j20_distinct_tracks(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("content"), (F.col("o_orderkey") % 4 == 0).alias("is_default"))
    return planning.distinct_tracks(a).select("id", "duplicates")


@query(f"""WITH {SP}, g AS (SELECT a.id, count(b.id) AS n, sum(CASE WHEN b.id % 3 <> 0 THEN 1 ELSE 0 END) AS u, max(CASE WHEN b.id % 6 = 0 THEN 1 ELSE 0 END) AS st, min(CASE WHEN b.s >= a.s - 1e-6 AND b.e <= a.e + 1e-6 THEN 1 ELSE 0 END) AS c, max(CASE WHEN b.id % 3 <> 0 AND b.id % 5 = 0 THEN 1 ELSE 0 END) AS m, max(CASE WHEN b.id % 4 = 0 THEN 1 ELSE 0 END) AS f FROM sp a JOIN sp b ON {ON} WHERE a.kind = 'click' AND b.kind = 'view' GROUP BY 1)
SELECT sp.id, CASE WHEN sp.id % 9 = 0 THEN 'novoice' WHEN n IS NULL THEN 'none' WHEN st = 1 THEN 'stale' WHEN u = n AND c = 0 THEN 'partial' WHEN u = n AND m = 1 THEN 'manual' WHEN u = n THEN 'ok' WHEN u > 0 THEN 'incomplete' WHEN f = 1 THEN 'failed' ELSE 'none' END AS state FROM sp LEFT JOIN g ON g.id = sp.id WHERE kind = 'click'""")
def a5_analysis_state(spark, d):
    i = F.col("id")
    seg = spans(spark, d, "view").select("id", "source_id", "start", "end", (i % 3 != 0).alias("usable"), (i % 5 == 0).alias("manual"), (i % 6 == 0).alias("has_ok"), (i % 4 == 0).alias("failed"))
    return planning.analysis_state(spans(spark, d, "click").withColumn("voiced", i % 9 != 0), seg)


@query(f"WITH {SP}, so AS (SELECT DISTINCT source_id FROM sp), l AS (SELECT a.source_id, count(*) AS n FROM sp a WHERE a.kind = 'view' AND NOT EXISTS (SELECT 1 FROM sp b WHERE {ON} AND b.kind = 'error') GROUP BY 1), m AS (SELECT source_id, count(*) AS n FROM sp WHERE kind = 'error' GROUP BY 1), s AS (SELECT source_id, count(*) AS n FROM sp WHERE kind = 'click' GROUP BY 1) SELECT so.source_id, coalesce(l.n, 0) AS lines, coalesce(m.n, 0) AS marked, coalesce(s.n, 0) AS samples FROM so LEFT JOIN l USING (source_id) LEFT JOIN m USING (source_id) LEFT JOIN s USING (source_id)")
def a4_source_counts(spark, d):
    return planning.source_counts(spans(spark, d).select("source_id").distinct(), spans(spark, d, "view"), spans(spark, d, "error"), spans(spark, d, "click"))


@query("SELECT l_returnflag AS kind, CAST(sum(CASE WHEN s = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_new, CAST(sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_replace, CAST(sum(CASE WHEN s = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_skip, CAST(0 AS BIGINT) AS n_unchanged, CAST(0 AS BIGINT) AS n_invalid FROM (SELECT l_returnflag, l_partkey % 3 AS s FROM lineitem) GROUP BY 1")
def a11_import_summary(spark, d):
    status = F.element_at(F.array(F.lit("new"), F.lit("replace"), F.lit("skip")), (F.col("l_partkey") % 3 + 1).cast("int"))
    return planning.import_summary(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("kind"), status.alias("status")))


@query(f"""WITH {SP}, b AS (SELECT source_id AS sample_id, CAST(row_number() OVER w - 1 AS INTEGER) AS k, s, lag(s + 0.01) OVER w AS pe, count(*) OVER (PARTITION BY source_id) AS n FROM sp WINDOW w AS (PARTITION BY source_id ORDER BY s, id)),
p AS (SELECT source_id, s + 1 AS p0, s + 21 AS p1, (s + 1 + (s + 21)) / 2 AS mid FROM sp a WHERE kind = 'error' AND NOT EXISTS (SELECT 1 FROM sp v WHERE v.kind = 'view' AND v.id % 5 <> 0 AND v.source_id = a.source_id AND v.s < (a.s + 1 + (a.s + 21)) / 2 - 1e-9 AND (a.s + 1 + (a.s + 21)) / 2 < v.e - 1e-9)),
c AS (SELECT b.sample_id, p0, p1, min(k) AS k, max(mid) AS mid FROM b JOIN p ON p.source_id = b.sample_id WHERE pe <= p0 + 0.05 + 1e-9 AND b.s >= p1 - 0.05 - 1e-9 GROUP BY 1, 2, 3), au AS (SELECT sample_id, k, max_by(mid, p0) AS mid FROM c GROUP BY 1, 2), hm AS (SELECT DISTINCT sample_id, unnest([7, 400]) AS k FROM b WHERE sample_id % 3 = 0)
SELECT sample_id, k, 'auto' AS kind, round(mid, 4) AS left_end, round(mid, 4) AS right_start, k % 4 = 0 AS merged, NULL AS error FROM au WHERE NOT (sample_id % 3 = 0 AND k IN (7, 400))
UNION ALL SELECT hm.sample_id, hm.k, 'manual', round(b.pe, 4), round(CASE WHEN b.pe IS NOT NULL THEN b.s END, 4), false, CASE WHEN b.pe IS NULL THEN 'rhythm-cut-invalid' END FROM hm LEFT JOIN b ON b.sample_id = hm.sample_id AND b.k = hm.k""")
def w5_phrase_cuts(spark, d):
    user = F.col("source_id").alias("sample_id")
    p = spans(spark, d, "error").select(user, (F.col("start") + 1).alias("start"), (F.col("start") + 21).alias("end"))
    phones = spans(spark, d, "view").select(user, F.when(F.col("id") % 5 == 0, "pau").otherwise("a").alias("label"), "start", "end")
    b = blocks(spark, d)
    hand = b.where("sample_id % 3 = 0").select("sample_id").distinct().select("sample_id", F.explode(F.array(F.lit(7), F.lit(400))).alias("k"))
    cuts = planning.phrase_cuts(b, p, phones, hand, b.where("k % 4 = 0").select("sample_id", "k"))
    return cuts.withColumns({"left_end": F.round("left_end", 4), "right_start": F.round("right_start", 4)})


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(CASE WHEN l_tax <= 0 THEN l_quantity ELSE least(l_extendedprice / 1000 * l_discount * 10, l_quantity - least(l_tax * 20, l_quantity * 0.02)) END, 6) AS speech_to, round(l_quantity - CASE WHEN l_tax <= 0 THEN l_quantity ELSE least(l_extendedprice / 1000 * l_discount * 10, l_quantity - least(l_tax * 20, l_quantity * 0.02)) END, 6) AS pause_to FROM lineitem")
def w11_bridge_targets(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_extendedprice") / 1000).alias("speech"), (F.col("l_tax") * 20).alias("pause"), F.col("l_quantity").alias("length"), (F.col("l_discount") * 10).alias("ratio"))
    return planning.bridge_targets(b).select("id", "line", F.round("speech_to", 6).alias("speech_to"), F.round("pause_to", 6).alias("pause_to"))


@query("SELECT o_orderkey AS id, CAST(greatest(-40, least(40, ceil(log2((o_orderkey % 30 + 1) * (60.0::DOUBLE / 175) / (o_totalprice / 30000))))) AS INTEGER) AS k0 FROM orders")
def w13_least_fast_density(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 30 + 1).alias("cells"), (F.col("o_totalprice") / 30000).alias("seconds"))
    return planning.least_fast_density(p, 175.0)


@query(f'WITH {SP}, t AS (SELECT source_id, min(s) + 500 AS c0, max(e) - 500 AS c1 FROM sp WHERE source_id % 4 <> 0 GROUP BY 1), g AS (SELECT a.*, t.c0, t.c1, EXISTS (SELECT 1 FROM sp b WHERE {ON} AND b.kind = \'purchase\') AS o FROM sp a LEFT JOIN t USING (source_id) WHERE a.kind = \'view\'), q AS (SELECT *, CASE WHEN c0 IS NULL THEN \'no-track\' WHEN id % 10 = 0 THEN \'no-name\' WHEN o THEN \'oped\' WHEN NOT (s < c1 - 1e-9 AND e > c0 + 1e-9) THEN \'out-of-track\' ELSE \'pending\' END AS status, greatest(s - 2, c0, 0) AS x, least(e + 3, c1) AS y FROM g) SELECT id, status, round(CASE WHEN status = \'pending\' THEN x END, 6) AS start, round(CASE WHEN status = \'pending\' THEN y END, 6) AS "end", round(CASE WHEN status = \'pending\' THEN greatest(s, x) END, 6) AS judge_start, round(CASE WHEN status = \'pending\' THEN least(e, y) END, 6) AS judge_end FROM q')
def e1_plan_samples(spark, d):
    tracks = spans(spark, d).where("source_id % 4 <> 0").groupBy("source_id").agg((F.min("start") + 500).alias("cover_start"), (F.max("end") - 500).alias("cover_end"))
    seg = spans(spark, d, "view").withColumn("text", F.when(F.col("id") % 10 == 0, " ").otherwise("t"))
    p = planning.plan_samples(seg, tracks, spans(spark, d, "purchase"), 2.0, 3.0)
    return p.select("id", "status", *(F.round(c, 6).alias(c) for c in ("start", "end", "judge_start", "judge_end")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'keep' ELSE 'delete' END AS action FROM orders WHERE o_orderstatus = 'F'")
def e14_clear_plan(spark, d):
    return planning.clear_plan(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("imported"), (F.col("o_orderkey") % 4 == 0).alias("protected")))


@query("SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(s.n, 0) AS n_suppliers FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1) o USING (c_custkey) LEFT JOIN (SELECT s_suppkey AS c_custkey, count(*) AS n FROM supplier GROUP BY 1) s USING (c_custkey)")
def e15_delete_preview(spark, d):
    return planning.delete_preview(table(spark, d, "customer"), {"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "suppliers": table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"))}, "c_custkey")


@query("WITH f AS (SELECT page_id // 4 AS stem, url AS path, page_id % 3 AS r FROM pages), x AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY r, path) AS n, count(*) OVER (PARTITION BY stem) - 1 AS others FROM f) SELECT stem AS id, path, CAST(others AS INTEGER) AS others FROM x WHERE n = 1")
def s9_match_pictures(spark, d):
    kind = F.element_at(F.array(F.lit("video"), F.lit("animation"), F.lit("image")), (F.col("page_id") % 3 + 1).cast("int"))
    f = table(spark, d, "pages").select(F.lit("d").alias("dir"), F.floor(F.col("page_id") / 4).alias("stem"), kind.alias("kind"), F.col("url").alias("path"))
    return planning.match_pictures(f.select("dir", "stem").distinct().withColumn("id", F.col("stem")), f)


@query("WITH f AS (SELECT l_orderkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS k, CASE WHEN l_partkey % 5 < 3 THEN l_quantity / 1e6 ELSE l_quantity END AS e FROM lineitem), l AS (SELECT p, greatest(quantile_cont(e, 0.85) * 0.0064, 1e-10) AS lim, count(*) AS n FROM f GROUP BY 1), a AS (SELECT p, min(k) AS i, max(k) AS j, count(*) AS c FROM f JOIN l USING (p) WHERE e > lim GROUP BY 1), o AS (SELECT o_orderkey AS p, CASE WHEN o_orderkey % 6 = 0 THEN 'k' ELSE 'a' END AS lb, 2.0::DOUBLE AS s, 2.0::DOUBLE + coalesce(n, 0) * 0.01 AS e, n, i, j, c FROM orders LEFT JOIN l ON l.p = o_orderkey LEFT JOIN a ON a.p = o_orderkey), r AS (SELECT *, greatest(s, CASE WHEN i * 0.01 >= 0.03 - 1e-9 THEN s + i * 0.01 - 0.01 ELSE s END) AS x, least(e, CASE WHEN e - (s + (j + 1) * 0.01) >= 0.03 - 1e-9 THEN s + (j + 1) * 0.01 + 0.01 ELSE e END) AS y FROM o) SELECT p AS phone_id, round(CASE WHEN lb = 'a' THEN CASE WHEN n >= 4 AND c >= 3 AND y - x >= 0.03 - 1e-9 THEN x ELSE s END END, 5) AS eff_start, round(CASE WHEN lb = 'a' THEN CASE WHEN n >= 4 AND c >= 3 AND y - x >= 0.03 - 1e-9 THEN y ELSE e END END, 5) AS eff_end FROM r")
def a22_effective_range(spark, d):
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) - 1
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("phone_id"), k.alias("k"), F.when(F.col("l_partkey") % 5 < 3, F.col("l_quantity") / 1e6).otherwise(F.col("l_quantity")).alias("energy"))
    sizes = f.groupBy("phone_id").agg(F.count("*").alias("n"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("phone_id")).join(sizes, "phone_id", "left")
    phones = o.select("phone_id", F.when(F.col("phone_id") % 6 == 0, "k").otherwise("a").alias("label"), F.lit(2.0).alias("start"), (2.0 + F.coalesce("n", F.lit(0)) * 0.01).alias("end"))
    return planning.effective_range(phones, f).select("phone_id", F.round("eff_start", 5).alias("eff_start"), F.round("eff_end", 5).alias("eff_end"))


@query(f"WITH {SP}, p AS (SELECT a.id, min(b.s) AS p FROM sp a JOIN sp b ON {ON} WHERE a.kind = 'click' AND b.kind = 'error' AND b.s > a.s GROUP BY 1) SELECT sp.id, round(CASE WHEN p IS NULL AND sp.id % 3 = 0 THEN NULL ELSE least(p, CASE WHEN sp.id % 3 <> 0 THEN s + sp.id % 20 + 0.005 END) END, 6) AS sustain FROM sp LEFT JOIN p ON p.id = sp.id WHERE kind = 'click'")
def a24_sustain_end(spark, d):
    b = spans(spark, d, "click")
    f = b.select("id", (F.col("start") + F.col("id") % 20).alias("t"), (F.col("id") % 3 != 0).alias("active"))
    return planning.sustain_end(b, spans(spark, d, "error"), f).withColumn("sustain", F.round("sustain", 6))
