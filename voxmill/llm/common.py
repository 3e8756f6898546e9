"""What several of the operators here share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word, and what separates words: ASCII white space only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows up to which a lookup table is broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent, a session of this machine alone gets a folder of its own; a cluster gets an error, as no local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='voxmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder: computed once, with its lineage cut.

    For narrow tables that several later steps read. Spark's cleaner drops the files once the result is
    unreferenced (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def aside(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its own columns of these names out of the way, as ``_own_<name>``; see :func:`back`."""
    return df.withColumnsRenamed({c: f"_own_{c}" for c in names if c in df.columns})


def back(name: str, *names: str) -> Column:
    """The column ``name`` of a table that :func:`aside` was applied to."""
    return F.col(f"_own_{name}").alias(name) if name in names else F.col(name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a Parquet table of this application."""
    return f"{shared_dir(spark)}/tables/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, in a folder for each value of the columns ``by``, and read again; ``name`` may be a path of :func:`scratch_path`.

    For tables that several later steps read: smaller than a checkpoint, and read by column. The shuffle files of the steps before it are
    removed once it is written, as nothing reads them again.
    """
    spark, tidy = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = name if "/" in name else scratch_path(spark, name), spark.conf.get(tidy, "false")
    spark.conf.set(tidy, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(tidy, before)
    return df.sparkSession.read.schema(T.StructType([f for f in df.schema if f.name not in by] + [f for f in df.schema if f.name in by])).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of :func:`stored`, or a part of it, that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lookup(df: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` joined with a table that is usually small: a broadcast after its rows were counted, else a shuffle join.

    ``small`` must be cheap to count (checkpointed or a few rows), or ``rows`` tells how many it has.
    """
    known = small.limit(limit + 1).count() if rows is None else rows
    return df.join(F.broadcast(small) if known <= limit else small, on, how)
