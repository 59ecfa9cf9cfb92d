"""Queries over measurements, frames, catalogue tables, edits, texts, vectors and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timelake.functions import text
from timelake.operators import catalog, edits, frames, measures, rhythm, vectors
from timelake.plans.timeline import BL, SP, blocks, spans, table
from timelake.sources import subtitles
from timelake.sources.shared import fresh_path
from timelake.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def pcm(spark, d) -> DataFrame:
    """Line items of a supplier as samples of a sound in [-1, 1], eighths, so that sums are exact."""
    i = F.row_number().over(Window.partitionBy("asset_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    x = (F.round(F.col("l_discount") * 100).cast("int") - 5) / 8.0
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", x.alias("x")).withColumn("i", i).select("asset_id", "i", "x")


PCM = "pcm AS (SELECT l_suppkey AS asset_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, (CAST(round(l_discount * 100) AS INTEGER) - 5) / 8.0::DOUBLE AS x FROM lineitem)"


@query(f"WITH {PCM}, g AS (SELECT asset_id, i // 256 AS bucket, min(x) AS a, max(x) AS b FROM pcm GROUP BY 1, 2) SELECT asset_id, bucket, CAST(greatest(-128, least(127, floor(a * 127))) AS INTEGER) AS low, CAST(greatest(-128, least(127, ceil(b * 127))) AS INTEGER) AS high FROM g")
def a14_peaks(spark, d):
    return measures.peaks(pcm(spark, d))


@query(f"WITH {PCM}, g AS (SELECT asset_id, i // 16 AS bucket, min(x) AS a, max(x) AS b FROM pcm GROUP BY 1, 2), p AS (SELECT asset_id, bucket, CAST(greatest(-128, least(127, floor(a * 127))) AS INTEGER) AS low, CAST(greatest(-128, least(127, ceil(b * 127))) AS INTEGER) AS high FROM g WHERE bucket >= 3 AND bucket < 60) SELECT asset_id, (bucket - 3) // 6 AS point, min(low) AS low, max(high) AS high FROM p GROUP BY 1, 2")
def a14_requery(spark, d):
    return measures.requery_peaks(measures.peaks(pcm(spark, d), 16), 3, 60, 10)


@query(f"WITH {PCM} SELECT asset_id, i // 80 AS frame, round(sqrt(avg(x * x)), 6) AS rms FROM pcm GROUP BY 1, 2 HAVING count(DISTINCT i) = 80")
def a15_rms_frames(spark, d):
    return measures.rms_frames(pcm(spark, d), 8000).withColumn("rms", F.round("rms", 6))


@query(f"WITH {PCM}, n AS (SELECT *, count(*) OVER (PARTITION BY asset_id) AS n FROM pcm) SELECT asset_id AS id, CAST(floor(CAST(i * 32 AS DOUBLE) / n) AS BIGINT) AS cell, round(median(x), 6) AS value FROM n GROUP BY 1, 2")
def a16_glyph(spark, d):
    s = pcm(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("asset_id"))).withColumnRenamed("asset_id", "id")
    return measures.glyph(s, 32).withColumn("value", F.round("value", 6))


@query("WITH p AS (SELECT l_suppkey AS k, round(l_extendedprice, 2) AS v, sum(greatest(l_quantity, 1e-6)) AS w FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) AS run, sum(w) OVER (PARTITION BY k) AS total FROM p) SELECT k AS l_suppkey, min(v) AS value FROM r WHERE run >= total / 2 - 1e-9 GROUP BY k")
def a17_weighted_median(spark, d):
    l = table(spark, d, "lineitem").withColumn("price", F.round("l_extendedprice", 2))  # noqa: E741
    return measures.weighted_median(l, "l_suppkey", "price", "l_quantity")


def block_frames(spark, d):
    t = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")) * 0.02
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("block_id"), t.alias("t"), F.when(F.col("l_discount") > 0.01, 40 + F.col("l_quantity")).alias("midi"), F.col("l_tax").alias("energy"))


@query("""WITH f AS (SELECT l_orderkey AS block_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) * 0.02::DOUBLE AS t, CASE WHEN l_discount > 0.01 THEN 40 + l_quantity END AS midi, l_tax AS energy FROM lineitem),
w AS (SELECT *, min(CASE WHEN midi IS NOT NULL THEN t END) OVER (PARTITION BY block_id) AS t0, max(CASE WHEN midi IS NOT NULL THEN t END) OVER (PARTITION BY block_id) AS t1 FROM f),
a AS (SELECT block_id, count(midi) AS n, count(*) AS total, median(midi) AS m, quantile_cont(midi, 0.1) AS p1, quantile_cont(midi, 0.9) AS p9, median(CASE WHEN t >= t1 - (t1 - t0) / 3 THEN midi END) - median(CASE WHEN t <= t0 + (t1 - t0) / 3 THEN midi END) AS tr, max(t1) - max(t0) AS span, avg(energy) AS e FROM w GROUP BY block_id)
SELECT block_id, round(CASE WHEN n >= 3 THEN m END, 6) AS midi, round(CASE WHEN n >= 3 THEN (p9 - p1) * 100 END, 4) AS spread, round(n::DOUBLE / total, 6) AS coverage, round(CASE WHEN n >= 5 AND span >= 0.06 - 1e-9 THEN tr END, 6) AS trend, round(CASE WHEN e > 0 THEN 10 * log10(e) END, 6) AS loudness FROM a""")
def a18_block_attributes(spark, d):
    a = measures.block_attributes(block_frames(spark, d))
    return a.select("block_id", *(F.round(c, 4 if c == "spread" else 6).alias(c) for c in ("midi", "spread", "coverage", "trend", "loudness")))


LABELS = ["k", "a", "i", "N", "pau", "s", "u", "I", "o"]


def phones(spark, d):
    w = Window.partitionBy("source_id").orderBy("start", "id")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("id") % 9 + 1).cast("int"))
    p = spans(spark, d).withColumn("idx", F.row_number().over(w) - 1).withColumn("label", label)
    start = F.col("idx") * 0.1 + F.when(F.col("id") % 5 == 0, 0.05).otherwise(0.0)
    return p.select(F.col("source_id").alias("sample_id"), "idx", "label", start.alias("start"), ((F.col("idx") + 1) * 0.1).alias("end"), "value").withColumn("strength", F.col("value")).drop("value")


PH = f"{SP}, ph AS (SELECT source_id AS sample_id, row_number() OVER (PARTITION BY source_id ORDER BY s, id) - 1 AS idx, {LABELS}[id % 9 + 1] AS label, value AS strength, id FROM sp), pt AS (SELECT *, idx * 0.1::DOUBLE + CASE WHEN id % 5 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS a, (idx + 1) * 0.1::DOUBLE AS b, CASE WHEN label IN ('I', 'U') THEN lower(label) ELSE label END AS l FROM ph)"
W1_SQL = f"""WITH {PH}, v AS (SELECT *, l IN ('a', 'i', 'u', 'e', 'o') AS v, l IN ('a', 'i', 'u', 'e', 'o', 'N') AS sy FROM pt),
g AS (SELECT *, a - lag(b) OVER w AS gap, lag(v) OVER w AS pv, lag(sy) OVER w AS ps FROM v WINDOW w AS (PARTITION BY sample_id ORDER BY idx)),
n AS (SELECT *, CASE WHEN sy AND NOT coalesce(gap >= -0.001 - 1e-9 AND gap <= 0.035 + 1e-9 AND (CASE WHEN l = 'N' THEN ps ELSE pv END) AND ps, false) THEN 1 ELSE 0 END AS new FROM g),
k AS (SELECT *, sum(new) OVER (PARTITION BY sample_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS k FROM n),
bl AS (SELECT sample_id, CAST(k AS BIGINT) AS k, arg_min(a, idx) AS onset, greatest(arg_max(b, idx), arg_min(a, idx)) AS e, arg_min(CASE WHEN v THEN l END, idx) FILTER (v) AS vowel, min(idx) AS first_idx, count(*) AS n, max(strength) AS strength FROM k WHERE sy GROUP BY 1, 2)"""


@query(f'{W1_SQL} SELECT sample_id, k, round(onset, 6) AS onset, round(e, 6) AS "end", vowel, first_idx, n, strength FROM bl')
def w1_group_blocks(spark, d):
    b = measures.group_blocks(phones(spark, d))
    return b.select("sample_id", "k", F.round("onset", 6).alias("onset"), F.round("end", 6).alias("end"), "vowel", F.col("first_idx").cast("long").alias("first_idx"), "n", "strength")


@query(f"""{W1_SQL}, st AS (SELECT *, max(CASE WHEN label IN ('pau', 'N', 'a', 'i', 'u', 'e', 'o', 'I', 'U') THEN idx END) OVER (PARTITION BY sample_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM pt)
SELECT b.sample_id, b.k, coalesce(string_agg(c.label, ',' ORDER BY c.idx), '') AS consonants, round(min(c.a), 6) AS lead FROM bl b JOIN st f ON f.sample_id = b.sample_id AND f.idx = b.first_idx LEFT JOIN pt c ON c.sample_id = b.sample_id AND c.idx > coalesce(f.after, -1) AND c.idx < b.first_idx GROUP BY 1, 2""")
def w2_leading_consonants(spark, d):
    p = phones(spark, d)
    return measures.leading_consonants(p, measures.group_blocks(p)).select("sample_id", "k", F.array_join("consonants", ",").alias("consonants"), F.round("lead", 6).alias("lead"))


def quiet_frames(spark, d):
    k = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample_id"), k.alias("k"), F.when(F.floor(F.col("l_orderkey") / 200) % 3 == 0, F.col("l_quantity") / 100).otherwise(F.col("l_quantity")).alias("rms"))


QF = "qf AS (SELECT l_suppkey AS sample_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS k, CASE WHEN (l_orderkey // 200) % 3 = 0 THEN l_quantity / 100 ELSE l_quantity END AS rms FROM lineitem), ql AS (SELECT sample_id, greatest(quantile_cont(rms, 0.85) * 0.25 * 2.0, 1e-5) AS lim FROM qf GROUP BY 1), qr AS (SELECT sample_id, k, k - row_number() OVER (PARTITION BY sample_id ORDER BY k) AS run FROM qf JOIN ql USING (sample_id) WHERE rms <= lim), pa AS (SELECT sample_id, min(k) * 0.01::DOUBLE AS a, (max(k) + 1) * 0.01::DOUBLE AS b FROM qr GROUP BY sample_id, run), pz AS (SELECT sample_id, round(a + 0.02, 6) AS s, round(b - 0.02, 6) AS e FROM pa WHERE b - a >= 0.06 - 1e-9)"


@query(f'WITH {QF} SELECT sample_id, s AS start, e AS "end" FROM pz')
def w3_detect_pauses(spark, d):
    return measures.detect_pauses(quiet_frames(spark, d), 2.0)


@query(f"WITH {BL}, p AS (SELECT source_id AS sample_id, e FROM sp WHERE kind = 'error') SELECT b.sample_id, b.k, (SELECT count(*) FROM p WHERE p.sample_id = b.sample_id AND p.e <= b.s) AS pseg FROM bl b")
def w4_pause_segment(spark, d):
    pauses = spans(spark, d, "error").select(F.col("source_id").alias("sample_id"), "start", "end")
    return measures.pause_segment(blocks(spark, d).drop("pseg"), pauses).select("sample_id", "k", "pseg")


@query(f"""WITH {BL}, nx AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY sample_id ORDER BY k), least(greatest(e, s + 0.001), 1e9 - 0.001)) AS n FROM bl),
er AS (SELECT source_id, s, e, max(e) OVER (PARTITION BY source_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp WHERE kind = 'error'), ei AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM er), p AS (SELECT source_id, min(s) AS s, max(e) AS e FROM ei GROUP BY source_id, i),
r AS (SELECT x.sample_id, x.k, x.n - x.s AS span, coalesce(sum(CASE WHEN p.s < x.n - 1e-9 AND p.e > x.s + 1e-9 THEN least(p.e, x.n) - greatest(p.s, x.s) END), 0) AS q FROM nx x LEFT JOIN p ON p.source_id = x.sample_id AND p.s < x.n - 1e-9 AND p.e > x.s + 1e-9 GROUP BY x.sample_id, x.k, x.n, x.s)
SELECT sample_id, k, round(greatest(span - greatest(0, least(q, span - 0.005)), 0.005), 5) AS dur, round(greatest(0, least(q, span - 0.005)), 5) AS rest FROM r""")
def w6_durations(spark, d):
    from timelake.operators.intervals import islands

    b = blocks(spark, d)
    pauses = islands(spans(spark, d, "error")).select(F.col("source_id").alias("sample_id"), "start", "end")
    ends = b.select("sample_id").distinct().withColumn("w1", F.lit(1e9))
    return measures.durations(b, pauses, ends).select("sample_id", "k", F.round("dur", 5).alias("dur"), F.round("rest", 5).alias("rest"))


@query(f"WITH {BL} SELECT sample_id, k, round(value / max(value) OVER (PARTITION BY sample_id), 6) AS strength FROM bl")
def a23_onset_strength(spark, d):
    return measures.onset_strength(blocks(spark, d).withColumn("rms", F.col("strength"))).select("sample_id", "k", F.round("strength", 6).alias("strength"))


@query(f"WITH {BL} SELECT sample_id, k, round(coalesce(sum((CAST(midi AS BIGINT) % 5 + CAST(spread AS BIGINT) % 2) / 4.0) OVER (PARTITION BY sample_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS beat FROM bl")
def w9_target_beats(spark, d):
    plan = blocks(spark, d).select("sample_id", "k", (F.col("midi").cast("long") % 5).alias("cells"), (F.col("spread").cast("long") % 2).alias("rest_cells"))
    return measures.target_beats(plan, 4.0).select("sample_id", "k", F.round("beat", 6).alias("beat"))


A20 = "SELECT l_suppkey AS asset_id, {0} AS region, l_partkey AS freq, l_quantity AS power FROM lineitem WHERE l_partkey >= 20"


@query(f"WITH r AS ({A20.format(chr(39) + 'whole' + chr(39))} UNION ALL {A20.format('CASE WHEN l_tax < 0.02 THEN ' + chr(39) + 'attack' + chr(39) + ' WHEN l_tax < 0.05 THEN ' + chr(39) + 'body' + chr(39) + ' ELSE ' + chr(39) + 'tail' + chr(39) + ' END')}), b AS (SELECT asset_id, region, freq, sum(power) AS power FROM r GROUP BY 1, 2, 3) SELECT asset_id, region, round(sum(CASE WHEN freq < 200 THEN power ELSE 0 END) / sum(power), 6) AS low, round(sum(CASE WHEN freq >= 200 AND freq < 4000 THEN power ELSE 0 END) / sum(power), 6) AS mid, round(sum(CASE WHEN freq >= 4000 THEN power ELSE 0 END) / sum(power), 6) AS high, round(sum(freq * power) / sum(power), 4) AS centroid, round(exp(avg(ln(power))) / avg(power), 6) AS flatness FROM b GROUP BY 1, 2")
def a20_spectral_shape(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    s = l.select(F.col("l_suppkey").alias("asset_id"), F.col("l_tax").alias("t"), F.col("l_partkey").alias("freq"), F.col("l_quantity").alias("power"))
    regions = l.select(F.col("l_suppkey").alias("asset_id")).distinct().withColumns({"peak": F.lit(0.02), "tail": F.lit(0.05)})
    return measures.spectral_shape(s, regions).select("asset_id", "region", *(F.round(c, 4 if c == "centroid" else 6).alias(c) for c in ("low", "mid", "high", "centroid", "flatness")))


def sound_frames(spark, d):
    """A user's events in order as frames of a sound; a steady pitch by hour, signups unmeasured."""
    w = Window.partitionBy("source_id").orderBy("start", "id")
    f = spans(spark, d).select(F.col("source_id").alias("sound"), (F.row_number().over(w) - 1).alias("frame"), "kind", (57 + F.floor(F.col("start") / 50) % 4).cast("double").alias("m"), F.pmod(F.col("id"), F.lit(7)).alias("j"))
    f0 = F.when(F.col("kind") != "signup", 440 * F.pow(F.lit(2.0), (F.col("m") + F.col("j") * 0.1 - 69) / 12))
    return frames.with_pitch(f.select("sound", "frame", f0.alias("f0"), F.lit(0.9).alias("conf"), F.lit(1e-3).alias("energy")))


PITCH = frames.PitchQuery((frames.PitchBlock(10, 57.3), frames.PitchBlock(10, 58.3)), tolerance=120, coverage=0.4, max_gap=0.04)
F3_SQL = f"""WITH {SP}, fr AS (SELECT source_id AS sound, row_number() OVER (PARTITION BY source_id ORDER BY s, id) - 1 AS frame, kind <> 'signup' AS ok, CAST(57 + CAST(floor(s / 50) AS BIGINT) % 4 + (id % 7) * 0.1 AS DOUBLE) AS midi FROM sp),
w AS (SELECT a.sound, a.frame AS start, b.frame - a.frame AS off, b.ok, b.midi FROM fr a JOIN fr b ON a.sound = b.sound AND b.frame >= a.frame AND b.frame < a.frame + 20),
g AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY sound, start ORDER BY off) AS run FROM w),
gap AS (SELECT sound, start, max(c) AS longest FROM (SELECT sound, start, run, count(*) FILTER (NOT ok) AS c FROM g GROUP BY 1, 2, 3) GROUP BY 1, 2),
bl AS (SELECT sound, start, off // 10 AS b, count(*) AS n, count(*) FILTER (ok) AS r, count(*) FILTER (ok AND abs(midi - 57.3 - off // 10) * 100 <= 120 + 1e-6) AS hit, avg(CASE WHEN ok THEN abs(midi - 57.3 - off // 10) * 100 END) AS dist FROM w GROUP BY 1, 2, 3),
h AS (SELECT sound, start, floor(avg(dist) * 10000 + 0.5) / 10000 AS score FROM bl WHERE n = 10 AND r >= 1 AND hit >= 4 - 1e-9 GROUP BY 1, 2 HAVING count(*) = 2)"""


@query(f"{F3_SQL} SELECT h.sound, h.start, 20 AS frames, 0 AS octave, round(score, 3) AS score FROM h JOIN gap USING (sound, start) WHERE longest <= 4")
def f3_search_pitch(spark, d):
    return frames.search_pitch(sound_frames(spark, d), PITCH).withColumn("score", F.round("score", 3))


@query(f"{F3_SQL}, k AS (SELECT h.*, h.start - row_number() OVER (PARTITION BY h.sound ORDER BY h.start) AS i FROM h JOIN gap USING (sound, start) WHERE longest <= 4), r AS (SELECT *, row_number() OVER (PARTITION BY sound, i ORDER BY score, start) AS r FROM k) SELECT sound, start, 20 AS frames, 0 AS octave, round(score, 3) AS score FROM r WHERE r = 1")
def f9_group_hits(spark, d):
    return frames.group_hits(frames.search_pitch(sound_frames(spark, d), PITCH)).withColumn("score", F.round("score", 3))


@query(f"{F3_SQL} SELECT sound, frame // 5 AS cell, round(avg(CASE WHEN ok THEN midi END), 6) AS midi, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS share FROM fr GROUP BY 1, 2 HAVING count(*) = 5")
def f11_coarse(spark, d):
    return frames.coarse(sound_frames(spark, d)).select("sound", "cell", F.round("midi", 6).alias("midi"), F.round("share", 6).alias("share"))


@query("SELECT o_orderkey AS id, bool_and(c % 3 <> 1) AS ready, coalesce(string_agg(CASE WHEN c % 3 = 1 THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS missing FROM (SELECT o_orderkey, unnest(range(o_orderkey % 5, (o_orderkey % 5 + o_orderkey % 4) + 1)) AS c FROM orders) GROUP BY 1")
def j21_frame_coverage(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("sound"), (F.col("o_orderkey") % 5 * 6000).alias("f_start"), ((F.col("o_orderkey") % 5 + F.col("o_orderkey") % 4) * 6000 + 10).alias("f_end"))
    chunks = o.select((F.col("id") % 40).alias("chunk")).distinct().where("chunk % 3 <> 1").select(F.lit(1).alias("sound"), "chunk")
    return frames.frame_coverage(o, chunks).select("id", "ready", F.array_join("missing", ",").alias("missing"))


def files(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", F.length("html").alias("size"))
    return p.select("page_id", F.col("url").alias("path"), "size", (F.col("page_id") % 50).alias("sig"))


@query("""WITH k AS (SELECT page_id, url AS path, length(html) AS size, page_id % 50 AS sig FROM pages), known AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'old/' || path ELSE path END AS path, size, sig FROM k WHERE page_id % 7 <> 0), f AS (SELECT * FROM k WHERE page_id % 11 <> 0),
gone AS (SELECT * FROM known WHERE path NOT IN (SELECT path FROM f)), fresh AS (SELECT * FROM f WHERE path NOT IN (SELECT path FROM known)), o AS (SELECT size, sig, min(path) AS old FROM gone GROUP BY 1, 2),
t AS (SELECT fresh.path, o.old, o.old IS NOT NULL AND row_number() OVER (PARTITION BY fresh.size, fresh.sig ORDER BY fresh.path) = 1 AS moved FROM fresh LEFT JOIN o ON o.size = fresh.size AND o.sig = fresh.sig)
SELECT path, 'known' AS state FROM f WHERE path IN (SELECT path FROM known) UNION ALL SELECT path, CASE WHEN moved THEN 'moved' ELSE 'new' END FROM t UNION ALL SELECT path, 'missing' FROM gone WHERE path NOT IN (SELECT old FROM t WHERE moved)""")
def s6_inventory_diff(spark, d):
    f = files(spark, d)
    known = f.where("page_id % 7 <> 0").withColumn("path", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")))
    return catalog.inventory_diff(f.where("page_id % 11 <> 0").drop("page_id"), known.drop("page_id"))


@query("WITH f AS (SELECT page_id, page_id // 3 AS stem, ['ja', '', 'en'][page_id % 3 + 1] AS tag, ['srt', 'ass'][page_id % 2 + 1] AS ext, url AS path FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY CASE WHEN tag <> '' THEN 1 ELSE 0 END, CASE tag WHEN 'ja' THEN 0 ELSE 99 END, CASE ext WHEN 'srt' THEN 0 WHEN 'ass' THEN 1 END, path) AS n FROM f) SELECT stem AS id, path FROM r WHERE n = 1")
def s7_match_sidecars(spark, d):
    f = files(spark, d).select(F.lit("d").alias("dir"), F.floor(F.col("page_id") / 3).alias("stem"), F.element_at(F.array(F.lit("ja"), F.lit(""), F.lit("en")), (F.col("page_id") % 3 + 1).cast("int")).alias("tag"), F.element_at(F.array(F.lit("srt"), F.lit("ass")), (F.col("page_id") % 2 + 1).cast("int")).alias("ext"), "path")
    media = f.select("dir", "stem").distinct().withColumn("id", F.col("stem"))
    return catalog.match_sidecars(media, f, {"ja": 0}, {"srt": 0, "ass": 1})


@query("WITH f AS (SELECT page_id, url AS rel, 'n' || (page_id % 150) AS name, 'root/' || url AS path FROM pages WHERE page_id % 4 <> 0), s AS (SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN url ELSE 'gone' || url END AS rel, 'n' || (page_id % 150) AS name FROM pages), a AS (SELECT rel, min(path) AS p1 FROM f GROUP BY 1), b AS (SELECT name, count(*) AS n, min(path) AS p2 FROM f GROUP BY 1) SELECT id, CASE WHEN p1 IS NOT NULL THEN p1 WHEN n = 1 THEN p2 END AS path, CASE WHEN p1 IS NOT NULL OR n = 1 THEN 'found' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM s LEFT JOIN a USING (rel) LEFT JOIN b USING (name)")
def s10_relocate(spark, d):
    p = table(spark, d, "pages")
    name = F.concat(F.lit("n"), (F.col("page_id") % 150).cast("string"))
    f = p.where("page_id % 4 <> 0").select(F.col("url").alias("rel"), name.alias("name"), F.concat(F.lit("root/"), "url").alias("path"))
    s = p.select(F.col("page_id").alias("id"), F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.concat(F.lit("gone"), "url")).alias("rel"), name.alias("name"))
    return catalog.relocate(s, f)


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://www.') THEN 'new://' || substr(url, 13) ELSE url END AS path FROM pages")
def s11_rewrite_prefix(spark, d):
    return table(spark, d, "pages").select("page_id", catalog.rewrite_prefix(F.col("url"), "https://www.", "new://").alias("path"))


@query("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS fingerprint FROM documents")
def s4_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", catalog.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT l_orderkey, sha256(string_agg(r, chr(10) ORDER BY r)) AS signature FROM (SELECT l_orderkey, l_linenumber || '|' || l_partkey || '|' || l_returnflag AS r FROM lineitem) GROUP BY 1")
def a8_signature_keys(spark, d):
    return catalog.signature_keys(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'stale' ELSE 'ready' END AS state FROM orders")
def a9_index_status(spark, d):
    keys = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("signature"))
    index = keys.where("o_orderkey % 5 <> 0").withColumn("signature", F.when(F.col("o_orderkey") % 7 == 0, "old").otherwise(F.col("signature")))
    return catalog.index_status(keys, index, "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 <> 0 THEN 'new' ELSE 'old' END AS value FROM orders")
def a10_adopt(spark, d):
    o = table(spark, d, "orders")
    keys = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, "b").otherwise("a").alias("signature"))
    rows = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("a").alias("signature"), F.lit("new").alias("value"))
    index = o.select("o_orderkey", F.lit("z").alias("signature"), F.lit("old").alias("value"))
    return catalog.adopt(rows, keys, index, "o_orderkey").select("o_orderkey", "value")


@query("SELECT event_type AS category, count(*) AS files, CAST(sum(user_id) AS BIGINT) AS bytes, CAST(sum(CASE WHEN 500 - value >= 300 THEN user_id ELSE 0 END) AS BIGINT) AS cleanable FROM events GROUP BY 1")
def a12_storage_report(spark, d):
    f = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("user_id").alias("bytes"), F.col("value").alias("touched"))
    return catalog.storage_report(f, F.lit(500.0), 300.0)


@query("SELECT l_orderkey AS job_id, count(*) AS total, CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM lineitem GROUP BY 1")
def a13_job_stats(spark, d):
    status = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "failed").otherwise("queued")
    return catalog.job_stats(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), status.alias("status")))


@query("SELECT o_orderkey AS job_id, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY CASE WHEN o_orderkey % 9 <> 0 THEN 1 ELSE 0 END, CASE WHEN o_orderkey % 9 = 0 THEN o_custkey END DESC, o_orderkey % 2 = 0, o_orderdate, o_orderkey) - 1 AS INTEGER) AS ahead FROM orders")
def a13_queue_ahead(spark, d):
    j = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("channel"), F.when(F.col("o_orderkey") % 9 == 0, F.col("o_custkey")).alias("promoted"), (F.col("o_orderkey") % 2 == 0).alias("background"), F.col("o_orderdate").alias("created_at"))
    return catalog.queue_ahead(j)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber = 2 DESC, l_tax > 0.05 DESC, l_shipdate DESC, l_linenumber DESC) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity < 40) SELECT l_orderkey AS segment_id, CAST(l_linenumber AS INTEGER) AS run_id FROM r WHERE n = 1")
def j6_usable_runs(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    segments = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end"), F.lit("t").alias("text"))
    runs = l.select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("run_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("ok").alias("status"), (F.col("l_tax") > 0.05).alias("manual"), F.col("l_shipdate").alias("created_at"), F.lit(0.0).alias("seg_start"), F.when(F.col("l_quantity") < 40, 1.0).otherwise(1.5).alias("seg_end"), F.lit("t").alias("seg_text"))
    heads = l.where("l_linenumber = 2").select(F.col("l_orderkey").alias("segment_id"), F.col("l_linenumber").alias("run_id"))
    return catalog.usable_runs(segments, runs, heads)


def batch(spark, d):
    o = table(spark, d, "orders")
    current = o.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 3 + 1).alias("version"), F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("prio"), F.col("o_orderpriority")).alias("fields"), "o_orderkey")
    change = current.where("o_orderkey % 4 = 0").select((F.col("o_orderkey") % 1000003).alias("idx"), "id", F.when(F.col("o_orderkey") % 12 == 0, "delete").otherwise("update").alias("op"), F.when(F.col("o_orderkey") % 20 == 0, 9).otherwise(F.col("version")).alias("version"), F.create_map(F.lit("status"), F.lit("F"), F.lit("note"), F.lit("n")).alias("fields"))
    return current.drop("o_orderkey"), change


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 12 = 0 THEN 'delete' ELSE 'update' END AS op, CASE WHEN o_orderkey % 20 = 0 THEN 'conflict' END AS error, CASE WHEN o_orderstatus = 'F' THEN 'note' ELSE 'note,status' END AS changed FROM orders WHERE o_orderkey % 4 = 0")
def e5_preview_edits(spark, d):
    current, change = batch(spark, d)
    return edits.preview_edits(change, current).select("id", "op", "error", F.array_join(F.array_sort(F.map_keys("changed")), ",").alias("changed"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 3 + 1 + CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0 THEN 1 ELSE 0 END AS version, CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 20 <> 0 AND o_orderkey % 12 <> 0 THEN 'F' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 12 = 0 AND o_orderkey % 20 <> 0 THEN '1' END AS deleted FROM orders")
def e6_apply_edits(spark, d):
    current, change = batch(spark, d)
    new, _ = edits.apply_edits(change.where("version <> 9"), current, 1)
    return new.select("id", "version", F.col("fields")["status"].alias("status"), F.col("fields")["deleted"].alias("deleted"))


def log(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select(F.floor(F.col("l_orderkey") / 40).alias("edit_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 700).alias("id"), F.lit("update").alias("op"), F.create_map(F.lit("flag"), F.lit("-")).alias("before"), F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("flag"), F.col("l_returnflag"))).otherwise(F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("stat"), F.col("l_linestatus"))).alias("after"))


LOG = "lg AS (SELECT l_orderkey // 40 AS edit_id, l_orderkey * 10 + l_linenumber AS seq, l_partkey % 700 AS id, 'flag' AS field, l_returnflag AS value FROM lineitem UNION ALL SELECT l_orderkey // 40, l_orderkey * 10 + l_linenumber, l_partkey % 700, 'stat', l_linestatus FROM lineitem WHERE l_linenumber % 2 <> 0), now AS (SELECT id, field, arg_max(value, seq) AS value FROM lg GROUP BY 1, 2)"


@query(f"WITH {LOG} SELECT * FROM now")
def e7_replay(spark, d):
    return edits.replay(log(spark, d))


@query(f"WITH {LOG}, last AS (SELECT edit_id, id, field, arg_max(value, seq) AS value, min(seq) AS a FROM lg GROUP BY 1, 2, 3), f AS (SELECT edit_id, min(seq) AS first FROM lg GROUP BY 1) SELECT l.edit_id, bool_and(l.value = n.value) AND min(arg_first) > 100000 AS undoable FROM last l JOIN now n USING (id, field) JOIN (SELECT edit_id, min(m) AS arg_first FROM (SELECT edit_id, max(seq) AS m FROM lg GROUP BY edit_id, id, field) GROUP BY 1) x ON x.edit_id = l.edit_id GROUP BY l.edit_id")
def e8_undoable(spark, d):
    return edits.undoable(log(spark, d), 100000)


@query(f"WITH {SP}, o AS (SELECT id, source_id, s, e, id % 4 = 0 AS protected FROM sp WHERE kind = 'view'), n AS (SELECT id AS idx, source_id, s, e FROM sp WHERE kind = 'view' AND id % 3 = 0 UNION ALL SELECT id, source_id, CASE WHEN id % 17 = 0 THEN -s ELSE s END, e FROM sp WHERE kind = 'error'), u AS (SELECT id FROM sp WHERE kind = 'view' AND id % 3 = 0 AND e - s <= 120), h AS (SELECT n.idx, bool_or(o.protected) AS p FROM n JOIN o ON n.source_id = o.source_id AND n.s < o.e - 1e-9 AND n.e > o.s + 1e-9 WHERE n.s < n.e AND n.s >= 0 AND n.e - n.s <= 120 AND o.id NOT IN (SELECT id FROM u) AND n.idx NOT IN (SELECT id FROM u) GROUP BY 1), b AS (SELECT n.*, CASE WHEN s < 0 THEN 'negative-start' WHEN e <= s THEN 'empty' WHEN e - s > 120 THEN 'too-long' END AS bad FROM n) SELECT idx, CASE WHEN bad IS NOT NULL THEN 'invalid' WHEN idx IN (SELECT id FROM u) THEN 'unchanged' WHEN p IS NULL THEN 'new' WHEN p THEN 'skip' ELSE 'replace' END AS status, CASE WHEN bad IS NOT NULL THEN bad WHEN idx NOT IN (SELECT id FROM u) AND p THEN 'protected' END AS reason FROM b LEFT JOIN h USING (idx)")
def j15_plan_reimport(spark, d):
    old = spans(spark, d, "view").select("id", "source_id", "start", "end", F.lit("t").alias("text"), (F.col("id") % 4 == 0).alias("protected"))
    same = spans(spark, d, "view").where("id % 3 = 0").select(F.col("id").alias("idx"), "source_id", "start", "end")
    err = spans(spark, d, "error").select(F.col("id").alias("idx"), "source_id", F.when(F.col("id") % 17 == 0, -F.col("start")).otherwise(F.col("start")).alias("start"), "end")
    rows = same.union(err).select("*", F.lit("t").alias("text"), F.lit(1e9).alias("duration"))
    return edits.plan_reimport(rows, old)


@query("SELECT o_custkey, min(o_orderkey) AS first, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS text FROM orders GROUP BY 1")
def e12_merge_segments(spark, d):
    s = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("double").alias("start"), (F.col("o_orderkey") + 1.0).alias("end"), F.col("o_orderpriority").alias("text"), F.array("o_orderstatus").alias("speakers"))
    return edits.merge_segments(s, "o_custkey").select("o_custkey", F.col("start").cast("long").alias("first"), "text")


@query(f'WITH {SP}, c AS (SELECT id, s, e, s + (id % 10) * 3.0 AS cut FROM sp WHERE kind = \'view\'), k AS (SELECT * FROM c WHERE cut > s AND cut < e) SELECT id, 0 AS part, round(s, 6) AS start, round(cut, 6) AS "end" FROM k UNION ALL SELECT id, 1, round(cut, 6), round(e, 6) FROM k')
def e12_split_segments(spark, d):
    s = spans(spark, d, "view")
    cuts = s.select("id", (F.col("start") + F.col("id") % 10 * 3.0).alias("at"))
    return edits.split_segments(s.select("id", "start", "end"), cuts).select("id", "part", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("SELECT doc_id FROM documents WHERE contains(regexp_replace(lower(nfc_normalize(text)), '[\\p{P}\\p{Z}\\p{C}\\s]', '', 'g'), 'thethe')")
def f13_search_text(spark, d):
    return table(spark, d, "documents").where(text.norm_text(F.col("text")).contains("thethe")).select("doc_id")


@query("SELECT conv_id, turn, kind, body FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'sfx' ELSE 'line' END AS kind, CASE WHEN turn % 3 = 0 THEN '' ELSE 'hello there' END AS body FROM conversations)")
def x14_classify_cue(spark, d):
    cue = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("("), "role", F.lit(")"))).otherwise(F.concat(F.lit("("), "role", F.lit(") hello there")))
    return table(spark, d, "conversations").select("conv_id", "turn", text.classify_cue(cue).alias("c")).select("conv_id", "turn", "c.kind", "c.body")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS \"order\", CAST(turn + 1 AS VARCHAR) AS ref, round(turn * 2.5, 3) AS start, round(turn * 2.5 + 2, 3) AS \"end\", 'line of ' || role AS text FROM conversations")
def s2_parse_srt(spark, d):
    c = table(spark, d, "conversations")
    stamp = lambda t: F.concat(F.lpad(F.floor(t / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(t / 60) % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(t) % 60).cast("string"), 2, "0"), F.lit(","), F.lpad((F.bround(t * 1000) % 1000).cast("long").cast("string"), 3, "0"))
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\r\n"), stamp(F.col("turn") * 2.5), F.lit(" --> "), stamp(F.col("turn") * 2.5 + 2), F.lit("\r\nline of "), "role", F.lit("\r\n"))
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\r\n").alias("content"))
    cues, _ = subtitles.parse_srt(whole.select(F.col("conv_id").alias("path"), "content"))
    return cues.select(F.col("path").alias("conv_id"), "order", "ref", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


@query("SELECT vec_id AS id, round(sqrt(list_dot_product(e, e)), 6) AS norm, CAST(len(e) AS INTEGER) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def v4_normalize(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    n = v.select("id", vectors.normalized(F.col("v")).alias("u"), F.col("v"))
    return n.select("id", F.round(F.sqrt(vectors.dot(F.col("v"), F.col("v"))) * vectors.dot(F.col("u"), F.col("u")), 6).alias("norm"), F.size("u").alias("n"))


def vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", vectors.normalized(F.col("embedding")).alias("v"))


V = "v AS (SELECT vec_id AS id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
V1_SQL = f"WITH {V}, s AS (SELECT a.id, b.label, list_dot_product(a.v, b.v) AS c FROM v a JOIN v b ON b.id % 4 = 0 WHERE a.id % 4 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY c DESC) AS n FROM s), m AS (SELECT id, label, avg(c) AS score FROM r WHERE n <= 5 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS k, score - lead(score) OVER (PARTITION BY id ORDER BY score DESC) AS lead FROM m)"


@query(f"{V1_SQL} SELECT id, CASE WHEN lead >= 0.02 THEN label ELSE -1 END AS label, round(score, 6) AS top, round(lead, 6) AS lead FROM w WHERE k = 1")
def v1_assign_by_neighbours(spark, d):
    v = vecs(spark, d)
    return vectors.assign_by_neighbours(v.where("id % 4 <> 0"), v.where("id % 4 = 0"), 5, 0.02).select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.round("top", 6).alias("top"), F.round("lead", 6).alias("lead"))


@query(f"WITH {V}, p AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), c AS (SELECT label, i, avg(x) AS x FROM p GROUP BY 1, 2), m AS (SELECT label, list(x ORDER BY i) AS m FROM c GROUP BY 1), s AS (SELECT id, m.label, list_dot_product(v.v, m.m) / sqrt(list_dot_product(m.m, m.m)) AS score FROM v, m), w AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC) AS k, score - lead(score) OVER (PARTITION BY id ORDER BY score DESC) AS lead FROM s) SELECT id, CASE WHEN lead >= 0.01 THEN label ELSE -1 END AS label, round(score, 6) AS top, round(lead, 6) AS lead FROM w WHERE k = 1")
def v3_assign_by_means(spark, d):
    v = vecs(spark, d)
    return vectors.assign_by_means(v, v, 0.01).select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.round("top", 6).alias("top"), F.round("lead", 6).alias("lead"))


@query(f"{V1_SQL}, q AS (SELECT round(w.lead, 4) AS lead, count(*) AS n, sum(CASE WHEN w.label = v.label THEN 1 ELSE 0 END) AS ok FROM w JOIN v USING (id) WHERE k = 1 GROUP BY 1), rr AS (SELECT lead, sum(ok) OVER (ORDER BY lead DESC) / sum(n) OVER (ORDER BY lead DESC) AS p FROM q) SELECT min(lead) AS margin FROM rr WHERE p >= 0.2")
def v2_calibrate_margin(spark, d):
    v = vecs(spark, d)
    a = vectors.assign_by_neighbours(v.where("id % 4 <> 0"), v.where("id % 4 = 0"), 5, 0.0)
    return vectors.calibrate_margin(a.join(v.select("id", F.col("label").alias("truth")), "id"), 0.2)


@query(f"WITH {SP} SELECT DISTINCT b.id FROM sp a JOIN sp b ON a.source_id = b.source_id AND a.s < b.e - 1e-9 AND a.e > b.s + 1e-9 WHERE a.kind = 'error' AND b.kind = 'click'")
def t1_affected_samples(spark, d):
    return streams.affected_samples(spans(spark, d, "error"), spans(spark, d, "click")).distinct()


def _folder(spark) -> str:
    return fresh_path(spark, "stream")


@query("SELECT event_type AS job_id, count(*) AS total, CAST(sum(CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ok, CAST(sum(CASE WHEN user_id % 3 = 1 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY 1")
def t4_progress_stream(spark, d):
    schema = table(spark, d, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(_stream_source(d))
    items = source.select(F.col("event_type").alias("job_id"), F.when(F.col("user_id") % 3 == 0, "ok").when(F.col("user_id") % 3 == 1, "failed").otherwise("queued").alias("status"))
    return streams.finished(streams.progress(items), "progress", "complete", _folder(spark))


def _stream_source(d: str) -> str:
    """The events table as a streaming folder: a glob, as the table may be one file."""
    return f"{d}/events.parquet*"


@query("WITH n AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM n) SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM i GROUP BY user_id, i")
def t3_sessions(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = streams.sessions(e, "user_id", "at", "6 hours", "1 hour")
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return s.select("user_id", F.timestamp_diff("SECOND", origin, F.col("start").cast("timestamp_ntz")).alias("start"), "n")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY lower(o_orderpriority), o_orderkey) AS INTEGER) AS place FROM orders ORDER BY lower(o_orderpriority), o_orderkey LIMIT 100 OFFSET 200")
def o2_page(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("p")).orderBy("p", "o_orderkey").limit(300)
    return o.withColumn("place", F.row_number().over(Window.orderBy("p", "o_orderkey"))).where("place > 200").select("o_orderkey", "place")


@query()
def w8_quantize(spark, d):
    b = blocks(spark, d).select("sample_id", "k", (0.05 + F.col("strength") / 1000).alias("dur"), "pseg", F.lit(0.0).alias("rest"))
    return rhythm.quantize(b).withColumn("cells", F.array_join(F.col("cells").cast("array<string>"), ","))


@query(f"WITH {PCM}, cl AS (SELECT asset_id, i // 4 AS b, sqrt(avg(x * x)) AS lv, sum(x * x) AS e, max(abs(x)) AS top FROM pcm GROUP BY 1, 2 HAVING count(*) = 4), pk AS (SELECT asset_id, max(lv) AS p FROM cl GROUP BY 1), c AS (SELECT cl.*, lv / p AS sh, p FROM cl JOIN pk USING (asset_id) WHERE p > 0), ed AS (SELECT asset_id, min(CASE WHEN lv = p THEN b END) AS t, min(CASE WHEN sh >= 0.01 THEN b END) AS f, max(CASE WHEN sh >= 0.01 THEN b END) + 1 AS g FROM c GROUP BY 1), q AS (SELECT c.*, t, f, g FROM c JOIN ed USING (asset_id) WHERE b >= f AND b < g), r AS (SELECT asset_id, max(t) AS t, max(f) AS f, max(g) AS g, sqrt(sum(e) / (4 * count(*))) AS rms, max(top) AS top, min(CASE WHEN b <= t AND sh >= 0.1 THEN b END) AS u1, min(CASE WHEN b <= t AND sh >= 0.9 THEN b END) AS u9, min(CASE WHEN b >= t AND sh < 0.9 THEN b END) AS d9, min(CASE WHEN b >= t AND sh < 0.1 THEN b END) AS d1 FROM q GROUP BY 1) SELECT asset_id, round((g - f) * 0.005::DOUBLE, 6) AS effective, round(greatest(coalesce(u9, t) - coalesce(u1, t), 0) * 5.0::DOUBLE, 6) AS attack, round(greatest(coalesce(d1, g) - coalesce(d9, g), 0) * 5.0::DOUBLE, 6) AS decay, round(20 * log10(top / rms), 6) AS crest_db, round(20 * log10(rms), 6) AS rms_db FROM r")
def a19_envelope_metrics(spark, d):
    return rhythm.envelope_metrics(pcm(spark, d), 800).select("asset_id", *(F.round(c, 6).alias(c) for c in ("effective", "attack", "decay", "crest_db", "rms_db")))


@query("WITH h AS (SELECT s_suppkey AS asset_id, 100.0::DOUBLE + s_suppkey % 60 AS f0, unnest(range(1, 9)) AS k FROM supplier), n AS (SELECT l.l_suppkey, h.k, l_quantity AS power FROM lineitem l JOIN h ON h.asset_id = l.l_suppkey AND abs(l_partkey * 1.0 - h.k * h.f0) <= greatest(20.0, 0.03::DOUBLE * h.k * h.f0)) SELECT l_suppkey AS asset_id, round(sum(CASE WHEN k < 5 THEN power ELSE 0 END) / sum(power), 6) AS low, round(sum(CASE WHEN k >= 5 THEN power ELSE 0 END) / sum(power), 6) AS high FROM n GROUP BY 1")
def a21_harmonic_shares(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("asset_id"), F.col("l_partkey").cast("double").alias("freq"), F.col("l_quantity").alias("power"))
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("asset_id"), (100.0 + F.col("s_suppkey") % 60).alias("f0"))
    return rhythm.harmonic_shares(s, p, 10.0).select("asset_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
