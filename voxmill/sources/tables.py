"""Readers of the driver's tables and of the voxel view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines that a partition of the voxel view gets on average.
LINES = 1 << 17


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long voxel table ``(case_id, x, y, z, gt, pred)`` on a 7 x 8 x 8 grid; cells that are absent are background.

    Lines are dealt out by case, to so many partitions that none grows with the table. A case has 448 cells at most however many lines it has, and
    what is later grouped or joined by case and cell needs no further shuffle.
    """
    line = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_partkey", "l_quantity", "l_orderkey")
    # counted from the files' footers
    parts = max(-(-line.count() // LINES), min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return line.repartition(parts, "l_suppkey").groupBy(
        F.col("l_suppkey").alias("case_id"),
        (F.col("l_linenumber") - 1).alias("x"),
        (F.col("l_partkey") % 8).alias("y"),
        (F.floor("l_quantity") % 8).alias("z"),
    ).agg(
        F.max(F.col("l_orderkey") % 4).alias("gt"),
        F.min((F.col("l_orderkey") + F.col("l_linenumber")) % 4).alias("pred"),
    )
