"""The corpus pipeline: quality filter, near-duplicate removal, redaction, mixing and tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of documents, and none looks at further ones. Null texts count as empty; rows with
a null doc_id stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelake.llm import bpe, jaccard, mixing, pii, quality
from timelake.llm.common import saved
from timelake.llm.queries import held_out, hex_sha256, vocab_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The power that flattens the languages' shares of tokens, and the bounds of a document's rate: none is dropped.
FLATTEN, LOW, HIGH = 0.7, 1.0, 3.0


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label")).where(~held_out())
    docs = docs.select(*COLUMNS)
    return quality.score(docs, quality.train(docs, labels), out="_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: that with the smallest doc_id."""
    return jaccard.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    found = pii.detect(docs.select(*COLUMNS), out="_spans")
    return found.withColumn("text", pii.redacted(F.col("text"), F.col("_spans"))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and again as its rate asks, so that the languages' shares come nearer to each other."""
    docs = docs.select(*COLUMNS)
    known = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id").distinct()
    labelled = docs.select("doc_id", F.col("lang").alias("domain")).join(known, "doc_id")
    if labelled.where("domain is not null").limit(1).count() == 0:
        return docs.select(*COLUMNS)
    model = mixing.learn(docs, labelled)
    members = saved(mixing.posteriors(docs, model), "members")
    targets = mixing.tempered(members, model, FLATTEN)
    mass = members.agg(F.sum("tokens").alias("t"), *(F.sum(F.col("tokens") * F.col("p")[i]).alias(f"t{i}") for i in range(len(model.domains)))).first()
    # the budget at which no domain needs a rate below 1
    budget = max([float(mass[f"t{i}"] or 0) / targets[d] for i, d in enumerate(model.domains) if targets[d] > 0], default=0.0)
    rates, _ = mixing.fit_rates(members, [targets[d] for d in model.domains], budget=budget or None, low=LOW, high=HIGH)
    times = rates.select(F.col("doc_id").alias("_id"), mixing.copies(F.col("rate"), F.col("doc_id")).alias("_times"))
    mixed = docs.join(times, docs["doc_id"] == times["_id"], "left")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_times", F.lit(1).cast("long"))))).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocab_path(), decoded="decoded")
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", hex_sha256(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("PII", pii_stage),
    ("mixing", mixing_stage),
    ("BPE", bpe_stage),
]
#: SQL cannot express the trained stages; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return docs
