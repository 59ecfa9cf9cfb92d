"""Orders and pages of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most rows that a page holds.
MOST = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sort_keys(mode: str) -> list[Column]:
    """The order of samples: created (newest first), name, source (work, episode, place) or duration; then the row number."""
    plain = lambda c: F.translate(F.col(c), _UPPER, _LOWER)
    keys = {"created": [F.desc("created_at"), F.desc("row_id")], "name": [plain("name"), F.col("row_id")], "source": [plain("work"), plain("episode"), F.col("src_start"), F.col("row_id")], "duration": [F.col("end") - F.col("start"), F.col("row_id")]}
    if mode not in keys:
        raise ValueError(f"lists are sorted by one of {sorted(keys)}")
    return keys[mode]


def page(df: DataFrame, mode: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of a list with `total`: at most MOST rows. Spark keeps the first offset + limit rows of each task alone."""
    limit, offset = max(1, min(limit, MOST)), max(0, offset)
    total = df.agg(F.count("*").alias("total"))  # one row
    rows = df.orderBy(*sort_keys(mode)).offset(offset).limit(limit)
    return rows.join(F.broadcast(total), F.lit(True))


def all_ids(df: DataFrame, mode: str) -> DataFrame:
    """The ids of a whole list in its order, as a range-partitioned table."""
    return df.orderBy(*sort_keys(mode)).select("id")
