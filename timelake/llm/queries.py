"""The registered queries of the training-data operators: thin wrappers that derive the contract's columns."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hilbert, htmltext, jaccard, licenses, mixing, multiindex, pii, pivots, quality, substring, warc, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers; TOKENIZER_DIR names another folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def hex_sha256(col):
    return F.sha2(col.cast("binary"), 256)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocab_path(), decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        hex_sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        hex_sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.dedup_substrings(docs, 13).select("doc_id", "n_words", "n_removed", hex_sha256(F.col("kept_text")).alias("kept_sha256"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), 5, 0.8)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    learnable = labels.where(~held_out())
    return quality.score(docs, quality.train(docs, learnable)).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def held_out():
    """Rows that no label is learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op6_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The weights that op9 mixes the languages to.
TARGETS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labelled = docs.select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", F.col("lang").alias("domain"))
    texts = docs.select("doc_id", "text")
    model = mixing.learn(texts, labelled)
    mixed = mixing.mix(texts, model, TARGETS, strict=False)
    at = {d: i for i, d in enumerate(model.domains)}
    share = [(F.get("p", F.lit(at[d])) if d in at else F.lit(0.0)).alias(f"p_{d}") for d in sorted(at.keys() | TARGETS.keys())]
    return mixed.select("doc_id", F.col("tokens").alias("n_tokens"), "rate", "n_copies", "unmet", *share)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(docs)
    base = F.filter("spans", lambda s: s["base"])
    # a filter of two arguments would get the place in the array as its second
    of_kind = lambda i: F.filter("spans", lambda s: s["base"] & (s["kind"] == i))
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS[: pii.RULED])]
    return found.select("doc_id", *counts, hex_sha256(pii.notation(base)).alias("base_sha256"), pii.notation(F.col("spans")).alias("spans"))


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multiindex.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), 5, 5, 80, 100, 100)


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.col("spans")).alias("labels"), "score")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whiten(table(spark, sf_dir, "embeddings"), 32)
    return done.withColumn("deviation", F.col("deviation").cast("long"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""


#: SHA-1 of the payload in base32: 160 bits, five at a time.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages WHERE page_id IS NOT NULL),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', hex[i])]), 'string_agg', '') AS bits FROM h),
d AS (SELECT page_id, n, hex, list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * CAST(bits[5 * i + 1] AS INTEGER) + 8 * CAST(bits[5 * i + 2] AS INTEGER) + 4 * CAST(bits[5 * i + 3] AS INTEGER) + 2 * CAST(bits[5 * i + 4] AS INTEGER) + CAST(bits[5 * i + 5] AS INTEGER)]), 'string_agg', '') AS digest FROM b),
l AS (SELECT hex, n, max(page_id) AS last FROM d GROUP BY 1, 2)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM d JOIN l USING (hex, n)
"""
WORDS_SQL = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS m FROM x GROUP BY 1),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT x.doc_id, x.i, unnest(range(0, 13)) AS j FROM x JOIN f USING (win) WHERE m < x.doc_id)),
r AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END, ' ')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""
#: Every pair that shares an n-gram is judged on its full sets; classes are what links reach.
JACCARD_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.format("lower(coalesce(text, ''))")} AS ws FROM documents),
gr AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || ' *'] ELSE [] END) AS g FROM w),
gs AS (SELECT doc_id, list(g ORDER BY g) AS s FROM gr GROUP BY 1),
cl AS (SELECT s, min(doc_id) AS rep, count(*) AS copies FROM gs GROUP BY 1),
rg AS (SELECT rep, copies, len(s) AS n, unnest(s) AS g FROM cl),
cm AS (SELECT a.rep AS a, b.rep AS b, max(a.n) AS na, max(b.n) AS nb, count(*) AS c FROM rg a JOIN rg b ON a.g = b.g AND a.rep <> b.rep GROUP BY 1, 2),
ln AS (SELECT a, b FROM cm WHERE c >= 0.8 * (na + nb - c)),
re(a, b) AS (SELECT rep, rep FROM cl UNION SELECT re.a, ln.b FROM re JOIN ln ON ln.a = re.b),
lb AS (SELECT a, min(b) AS class_id FROM re GROUP BY 1),
pt AS (SELECT ln.a, sum(copies) AS p FROM ln JOIN cl ON cl.rep = ln.b GROUP BY 1)
SELECT w.doc_id, coalesce(lb.class_id, w.doc_id) AS class_id, CAST(coalesce(cl.copies, 1) AS BIGINT) AS n_copies, CAST(coalesce(cl.copies - 1 + coalesce(p, 0), 0) AS BIGINT) AS n_links
FROM w LEFT JOIN gs USING (doc_id) LEFT JOIN cl ON cl.s = gs.s LEFT JOIN lb ON lb.a = cl.rep LEFT JOIN pt ON pt.a = cl.rep
"""


def queries() -> dict:
    return {"op1_html": op1_html, "op2_bpe": op2_bpe, "op3_warc": op3_warc, "op4_quality": op4_quality, "op5_substring": op5_substring, "op6_hilbert": op6_hilbert, "op7_jaccard": op7_jaccard, "op8_pivots": op8_pivots, "op9_mixing": op9_mixing, "op10_pii": op10_pii, "op11_negatives": op11_negatives, "op12_licenses": op12_licenses, "op13_whitening": op13_whitening}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": WARC_SQL, "op5_substring": SUBSTRING_SQL, "op7_jaccard": JACCARD_SQL, "op8_pivots": TOP_K_SQL, "op11_negatives": NEGATIVES_SQL}
