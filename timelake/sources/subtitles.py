"""Bulk readers of subtitle files, and a generator of a synthetic library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timelake.sources.shared import hadoop_path

_TIME = r"(-?\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
_ARROW = rf"^\s*{_TIME}\s*-->\s*{_TIME}"


def _seconds(line, first: int, pattern: str = _ARROW):
    part = lambda i: F.regexp_extract(line, pattern, first + i)
    hours = part(0).try_cast("double")
    rest = part(1).try_cast("double") * 60 + part(2).try_cast("double") + F.rpad(part(3), 3, "0").try_cast("double") / 1000
    return F.when(part(0).startswith("-"), -(F.abs(hours) * 3600 + rest)).otherwise(hours * 3600 + rest)


def parse_srt(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (path, content) to cues (path, order, ref, start, end, text, line) and problems (path, line, reason).

    Blocks are parted by blank lines. A block's first line with an arrow holds its times, the line before it is its
    reference, those after it its text. Blocks without such a line are problems.
    """
    clean = F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n")
    blocks = files.select("path", F.split(clean, "\n").alias("lines"))
    numbered = blocks.select("path", F.posexplode("lines").alias("n", "text"))
    w = Window.partitionBy("path").orderBy("n")
    blank = F.trim("text") == ""
    marked = numbered.withColumn("_b", F.sum(blank.cast("int")).over(w)).where(~blank)
    arrow = F.col("text").rlike(_ARROW)
    g = marked.groupBy("path", "_b").agg(F.min("n").alias("first"), F.min(F.when(arrow, F.col("n"))).alias("at"), F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows"))
    head = F.filter("rows", lambda r: r["n"] == F.col("at"))[0]["text"]
    before = F.filter("rows", lambda r: r["n"] == F.col("at") - 1)
    body = F.array_join(F.transform(F.filter("rows", lambda r: r["n"] > F.col("at")), lambda r: r["text"]), "\n")
    good = g.where("at is not null").select("path", F.when(F.size(before) > 0, F.trim(F.get(before, F.lit(0))["text"])).alias("ref"), _seconds(head, 1).alias("start"), _seconds(head, 5).alias("end"), body.alias("text"), (F.col("at") + 1).alias("line"))
    cues = good.withColumn("order", F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1)
    return cues, g.where("at is null").select("path", (F.col("first") + 1).alias("line"), F.lit("no-timing").alias("reason"))


#: Columns of a section without a Format line.
ASS_FORMAT = "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def parse_ass(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cues, problems) of ASS/SSA files: dialogue lines of the [Events] section, by the columns that its Format line names.

    cues: path, order (from 1), ref (the dialogue's number), start, end, text, line; problems: path, line, reason (bad-dialogue
    for too few columns, no-timing for times that cannot be read).
    """
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace(F.regexp_replace("content", "^﻿", ""), "\r\n?", "\n"), "\n")).alias("n", "l"))
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("l").rlike(r"^\s*\["), F.lower(F.trim("l"))), ignorenulls=True).over(w)
    # a Format line holds until the next section
    named = F.last(F.when(F.col("l").rlike(r"(?i)^\s*Format\s*:"), F.col("l")).when(F.col("l").rlike(r"^\s*\["), ASS_FORMAT), ignorenulls=True).over(w)
    d = lines.withColumn("_s", section).withColumn("_f", named).where((F.col("_s") == "[events]") & F.col("l").rlike(r"(?i)^\s*Dialogue\s*:"))
    d = d.withColumn("ref", F.row_number().over(Window.partitionBy("path").orderBy("n")).cast("string"))
    names = F.transform(F.split(F.regexp_replace("_f", r"(?i)^\s*Format\s*:", ""), ","), lambda x: F.lower(F.trim(x)))
    d = d.withColumn("_n", names).withColumn("_c", F.split(F.regexp_replace("l", r"(?i)^\s*Dialogue\s*:\s*", ""), ","))
    value = lambda name: F.get(F.col("_c"), F.array_position("_n", name).cast("int") - 1)
    at = F.array_position("_n", "text").cast("int")
    whole = F.array_join(F.slice("_c", at, F.greatest(F.size("_c") - at + 1, F.lit(0))), ",")
    whole = F.regexp_replace(F.regexp_replace(F.regexp_replace(whole, r"\{[^}]*\}|<[^>]*>", ""), r"\\N", "\n"), r"\\[nh]", " ")
    clock = r"^\s*(-?\d+):(\d{1,2}):(\d{1,2})[.,](\d{1,3})\s*$"
    named_all = (at > 0) & F.array_contains("_n", "start") & F.array_contains("_n", "end") & (F.size("_c") >= F.size("_n"))
    d = d.withColumns({"_ok": named_all, "start": _seconds(value("start"), 1, clock), "end": _seconds(value("end"), 1, clock), "line": F.col("n") + 1})
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    good = d.where(F.col("_ok") & timed).select("path", "ref", "line", "start", "end", F.trim(F.when(at > 0, whole)).alias("text"))
    problems = d.where(~F.col("_ok") | ~timed).select("path", "line", F.when(~F.col("_ok"), "bad-dialogue").otherwise("no-timing").alias("reason"))
    return good.withColumn("order", F.row_number().over(Window.partitionBy("path").orderBy("line"))), problems


def read_texts(spark: SparkSession, glob: str) -> DataFrame:
    """(path, content) of whole files."""
    return spark.read.option("wholetext", True).text(glob).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


#: Hits of a member in one row at most, and the file that tells how many rows a result has.
HITS, _MANIFEST = 1000, "_manifest"


def write_result(hits: DataFrame, result_id: str, path: str) -> None:
    """Write a fixed result below `path`, partitioned by result: members by rank with their hits, at most HITS ranks in a row (part).

    The rows go to a staging folder, get a manifest with their number, and only then take the place of the result's own partition.
    So a job that fails leaves what was there, and one that runs again leaves one whole result; others are not touched.
    """
    spark = hits.sparkSession
    part = F.floor(F.col("rank") / HITS).cast("long").alias("part")
    found = F.array_sort(F.collect_list(F.struct("rank", "start", "end", "score")))
    members = hits.groupBy("sample_id", part).agg(F.min("rank").alias("rank"), found.alias("hits"))
    staging = f"{path}/_staging/{result_id}-{uuid.uuid4().hex}"
    members.write.parquet(staging)
    fs, staged = hadoop_path(spark, staging)
    out = fs.create(hadoop_path(spark, f"{staging}/{_MANIFEST}")[1], True)
    out.write(bytearray(str(spark.read.parquet(staging).count()), "utf-8"))
    out.close()
    _, final = hadoop_path(spark, f"{path}/result_id={result_id}")
    fs.delete(final, True)
    if not fs.rename(staged, final):
        raise OSError(f"result {result_id} could not be moved into place")


def read_result(spark: SparkSession, result_id: str, path: str) -> DataFrame:
    """(sample_id, part, rank, hits) of a fixed result; an error if it is not there or not whole."""
    folder = f"{path}/result_id={result_id}"
    fs, manifest = hadoop_path(spark, f"{folder}/{_MANIFEST}")
    if not fs.exists(manifest):
        raise FileNotFoundError(f"no result {result_id}")
    source = fs.open(manifest)
    wanted = int(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
    source.close()
    rows = spark.read.parquet(folder)
    if rows.count() != wanted:
        raise OSError(f"result {result_id} is not whole")
    return rows


def synth_blocks(spark: SparkSession, samples: int, seed: int = 7, per_asset: int = 300) -> DataFrame:
    """Blocks of a made-up library: 8 to 12 syllables a sample of 3 s, MIDI 52 to 76, a pause after 6 % of them."""
    r = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    s = spark.range(samples).select(F.col("id").alias("sample_id"), F.floor(F.col("id") / per_asset).alias("asset_id"), (F.floor(r(F.col("id")) * 5) + 8).cast("int").alias("n"))
    b = s.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    step = F.lit(3.0) / F.col("n")
    w = Window.partitionBy("sample_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    pause = (r(F.col("sample_id"), F.col("k"), F.lit("p")) < 0.06).cast("int")
    vowel = F.element_at(F.array(*map(F.lit, ("a", "i", "u", "e", "o"))), (F.floor(r(F.col("sample_id"), F.col("k"), F.lit("v")) * 5) + 1).cast("int"))
    b = b.withColumn("_p", pause)
    return b.select(
        "sample_id",
        "asset_id",
        "k",
        (F.col("k") * step).alias("onset"),
        ((F.col("k") + 0.9) * step).alias("end"),
        (F.col("k") * step).alias("lead"),
        vowel.alias("vowel"),
        F.array().cast("array<string>").alias("consonants"),
        (52 + 24 * r(F.col("sample_id"), F.col("k"), F.lit("m"))).alias("midi"),
        (40 * r(F.col("sample_id"), F.col("k"), F.lit("s"))).alias("spread"),
        F.lit(0.9).alias("coverage"),
        F.lit(0.0).alias("trend"),
        r(F.col("sample_id"), F.col("k"), F.lit("t")).alias("strength"),
        ((F.col("k") + 0.8) * step).alias("sustain"),
        F.lit(None).cast("string").alias("character"),
        F.coalesce(F.sum("_p").over(w), F.lit(0)).alias("pseg"),
    )
