"""Digests of rows and of sets of rows that change exactly when the rows do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hexadecimal digits of a row's digest that place it in the tree: at most 65,536 branches, whatever the number of rows.
BRANCH = 4


def _marked(text: Column) -> Column:
    """A text with its length before it, or the mark of null: no two sequences of values are written alike."""
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def canonical(df: DataFrame, *columns: str) -> Column:
    """The columns of a row as one text, different for different values and for null. Maps are written by sorted key."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType
        value = F.col(c)
        if isinstance(kind, T.BinaryType):
            value = F.hex(value)
        elif isinstance(kind, T.MapType):
            value = F.to_json(F.array_sort(F.map_entries(value)), {"ignoreNullFields": "false"})
        elif isinstance(kind, (T.ArrayType, T.StructType)):
            value = F.to_json(value, {"ignoreNullFields": "false"})
        parts.append(_marked(value.cast("string")))
    return F.concat(*parts)


def multiset_digest(df: DataFrame, *columns: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, digest): SHA-256 of a multiset of rows, in any order: a hash tree over the rows' own digests.

    Equal rows become one leaf with their number; leaves are sorted in branches by the first digits of their digest, and the
    branches in the root. So neither a large group nor a repeated row meets in one array.
    """
    h = F.sha2(canonical(df, *columns).cast("binary"), 256)
    leaves = df.select(*by, h.alias("h")).groupBy(*by, "h").agg(F.count("*").alias("n"))
    branch = F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "h", "n"))), ",")
    branches = leaves.groupBy(*by, F.substring("h", 1, BRANCH).alias("b")).agg(F.sha2(branch.cast("binary"), 256).alias("h"))
    root = F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "b", "h"))), ",")
    return (branches.groupBy(*by) if by else branches).agg(F.sha2(root.cast("binary"), 256).alias("digest"))
