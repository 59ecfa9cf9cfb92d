"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: bounds what a Python worker holds when texts are very long. All operators use the
#: same bounds, as plans are lazy and the session has one value.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a master on this machine gets a temporary folder; on a cluster that is an error, as each executor
    would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that `saved` returned and that no later plan reads, through Hadoop's file system."""
    for df in tables:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Saved tables of one run, which go once its result is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def saved(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(saved(df, name))
        return self.tables[-1]

    def end(self, result: DataFrame, name: str) -> DataFrame:
        """The result as a saved table; all others are deleted."""
        out = saved(result, name)
        drop(*self.tables)
        self.tables = []
        return out


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, as one document may be very long, and let local workers import this package."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, environment.get("PYTHONPATH", "")]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(df: DataFrame, col: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
