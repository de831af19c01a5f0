"""What iterative and ordered operators share: cut lineage, and positions in a global order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own where that is unset and all run on one machine."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="placelake-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it stands in the shared folder: later rounds don't work earlier ones out again, and a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over the cluster, for rows that are short to read and long to work on: few tasks read them all."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def _ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` sorted in ranges, one per partition, as written; ``_part`` and ``_place`` tell where each row lies."""
    seen = df.withColumn("_seen", F.monotonically_increasing_id())
    ranged = seen.repartitionByRange(*order, "_seen").sortWithinPartitions(*order, "_seen").drop("_seen")
    return cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))


def _starts(ranged: DataFrame, total: Column) -> DataFrame:
    """(_part, _start, _first) with the sum of ``total`` over all earlier partitions: a row per partition comes to the driver."""
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_part").agg(total.alias("n"), F.min("_place").alias("first")).collect()):
        starts.append((r["_part"], before, r["first"]))
        before += r["n"]
    return F.broadcast(ranged.sparkSession.createDataFrame(starts, "_part int, _start long, _first long"))


def numbered(df: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """``df`` with positions 0, 1, ... in the order of ``order``; rows that are equal there get some order of their own. No task has all rows."""
    ranged = _ranges(df, *order)
    out = ranged.join(_starts(ranged, F.count("*")), "_part").withColumn(name, F.col("_place") - F.col("_first") + F.col("_start"))
    return out.drop("_part", "_place", "_start", "_first")


def running(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each in the order of a column without ties."""
    ranged = _ranges(df, order)
    before = F.sum(value).over(Window.partitionBy("_part").orderBy("_place")) - F.col(value)
    out = ranged.withColumn("_own", before).join(_starts(ranged, F.sum(value)), "_part").withColumn(name, F.col("_own") + F.col("_start"))
    return out.drop("_part", "_place", "_start", "_first", "_own")
