"""Typed scans of catalogue tables, frame tables from chunks of arrays, and which linked subtitles to change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KNOTS = "array<struct<local:double,source:double>>"
#: The catalogue's tables and their columns; nested columns may be stored as JSON text.
SCHEMAS = {
    "sources": "id string, path string, work string, episode string, source_type string, duration double, subtitle_path string, default_stream int",
    "assets": f"id string, source_id string, origin string, input_id string, mapping {_KNOTS}, production map<string,string>, duration double",
    "asset_roles": "asset_id string, role string, state string",
    "segments": "id string, source_id string, start double, end double, text string, speakers array<string>, origin string, edited boolean, speaker_edited boolean, deleted boolean, version long",
    "hints": "id string, source_id string, start double, end double, text string, origin string, edited boolean, deleted boolean, version long",
    "range_tags": "id string, source_id string, scope string, scope_role string, scope_asset_id string, start double, end double, tags array<string>, deleted boolean",
    "samples": "id string, asset_id string, start double, end double, judge_start double, judge_end double, name string, note string, nature string, starred boolean, language string, created_at timestamp",
    "sample_tags": "sample_id string, tag string",
    "runs": "id string, segment_id string, status string, manual boolean, seg_start double, seg_end double, seg_text string, created_at timestamp",
    "metrics": "sample_id string, asset_id string, start double, end double, algo string, signature string, values map<string,double>",
    "changes": "edit_id string, seq long, entity string, id string, op string, before map<string,string>, after map<string,string>",
    "jobs": "id string, kind string, status string, created_at timestamp",
}
#: Frames of a chunk: 60 seconds.
CHUNK = 6000


def read_catalog(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """Each table (all by default) with the types above, from Parquet below `folder`.

    Columns that a file lacks are null; nested columns that it stores as text are read as JSON; others are cast.
    """
    out = {}
    for name in names or SCHEMAS:
        raw = spark.read.parquet(f"{folder}/{name}")
        have = {f.name: f.dataType for f in raw.schema.fields}
        cols = []
        for f in spark.createDataFrame([], SCHEMAS[name]).schema.fields:
            nested = f.dataType.typeName() in ("array", "map", "struct")
            if f.name not in have:
                cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            elif nested and have[f.name].typeName() == "string":
                cols.append(F.from_json(F.col(f.name), f.dataType.simpleString()).alias(f.name))
            else:
                cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        out[name] = raw.select(*cols)
    return out


def explode_frames(chunks: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, frame, f0, conf, energy): one row a 10 ms frame of each asset (asset_id, n_frames).

    chunks: asset_id, chunk, f0, conf, energy (arrays of up to CHUNK floats). Frames of chunks that are not there, and NaN,
    are null: not measured. A chunk after an asset's end is left out.
    """
    zipped = chunks.select("asset_id", "chunk", F.posexplode(F.arrays_zip("f0", "conf", "energy")).alias("pos", "z"))
    number = lambda c: F.when(~F.isnan(F.col("z")[c]), F.col("z")[c]).alias(c)
    rows = zipped.select("asset_id", (F.col("chunk") * CHUNK + F.col("pos")).cast("long").alias("frame"), number("f0"), number("conf"), number("energy"))
    whole = assets.where("n_frames > 0").select("asset_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames").cast("long") - 1)).alias("frame"))
    return whole.join(rows, ["asset_id", "frame"], "left")


def sidecar_updates(linked: DataFrame, files: DataFrame, matches: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, subtitle_path): the subtitles that linked media (id, path, subtitle_path) are to change to.

    files: path, those that exist; matches: id, found (the best file beside the medium); chosen: id, media whose subtitles
    were chosen by hand. A medium without a link, or whose linked file is gone, takes what is found; a linked .ass of the
    medium's own name and folder gives way to a better match; others keep theirs.
    """
    folder = lambda c: F.regexp_extract(c, r"^(.*?)[^/\\]*$", 1)
    stem = lambda c: F.lower(F.regexp_replace(F.regexp_extract(c, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    there = files.select(F.col("path").alias("subtitle_path"), F.lit(True).alias("_there"))
    rows = linked.join(chosen, "id", "left_anti").join(there, "subtitle_path", "left").join(matches, "id")
    current, medium = F.col("subtitle_path"), F.col("path")
    replaceable = F.lower(current).endswith(".ass") & (stem(current) == stem(medium)) & (folder(current) == folder(medium))
    free = current.isNull() | F.col("_there").isNull() | replaceable
    return rows.where(free & ~F.col("found").eqNullSafe(current) & F.col("found").isNotNull()).select("id", F.col("found").alias("subtitle_path"))
