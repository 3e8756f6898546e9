"""Tables that several later steps read, kept in the folder that driver and executors share; and components of graphs whose edges are in many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a session of this machine alone gets a folder of its own where that isn't set, a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='voxmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint: computed once, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def connected(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, node, top)`` of the undirected ``edges(*by, a, b)``: the smallest node that can be reached, for all nodes but those.

    Rounds of large and small stars: every node hangs its larger neighbours on the smallest of them all, then its smaller ones, until nothing changes; the number of rounds
    follows the logarithm of the longest path. Groups must not be null.
    """
    key = [*by, "a"]
    now = edges.filter("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(now), None
    while (mark := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*by, "a", "b").cast("decimal(38,0)"))).first())) != before:
        before = mark
        both = now.unionByName(now.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*key).agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.join(low, key).filter("b > a").select(*by, F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy(*key).agg(F.min("b").alias("low"))
        small = large.join(low, key).filter("b <> low").select(*by, F.col("b").alias("a"), F.col("low").alias("b"))
        now = cut(small.unionByName(low.select(*by, "a", F.col("low").alias("b"))).distinct())
    return now.select(*by, F.col("a").alias("node"), F.col("b").alias("top"))
