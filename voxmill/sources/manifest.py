"""Manifests of predictions, click files and metrics files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_IMAGE = "struct<name:string,pk:string>"
#: Both dialects of a manifest entry: a job with primary keys, or a list of files.
MANIFEST = (
    f"pk string, inputs array<struct<image:{_IMAGE},type:string,filename:string>>, outputs array<struct<image:{_IMAGE},type:string,filename:string>>, error_messages array<string>"
)
CLICKS = "version struct<major:int,minor:int>, type string, points array<struct<point:array<int>,name:string>>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, pk, inputs, outputs)`` of a JSON list of entries."""
    return parse_manifest(spark.read.text(path, wholetext=True), "value")


def parse_manifest(table: DataFrame, column: str) -> DataFrame:
    """Entries of manifests held as text, a row for each, in their order."""
    schema = T.ArrayType(T.StructType.fromDDL(MANIFEST))
    return table.select(F.posexplode(F.from_json(column, schema)).alias("ord", "e")).select("ord", "e.*")


def is_results(entries: DataFrame) -> bool:
    """Whether a manifest lists files rather than jobs: the first entry decides."""
    first = entries.orderBy("ord").limit(1).filter("pk IS NULL AND outputs IS NOT NULL AND inputs IS NOT NULL")
    return first.count() == 1


def mapping(entries: DataFrame, results: bool, pred: str = "{pk}/output/{name}", truth: Column | None = None) -> DataFrame:
    """``(ord, prediction, input)`` of the entries; those without inputs or outputs are skipped.

    A job's prediction lies under its primary key, by the template ``pred``.
    """
    kept = entries.filter((F.size("inputs") > 0) & (F.size("outputs") > 0))
    first = lambda c: F.get(c, F.lit(0))
    if results:
        return kept.select("ord", first("outputs")["filename"].alias("prediction"), first("inputs")["filename"].alias("input"))
    before, _, after = pred.partition("{pk}")
    middle, _, end = after.partition("{name}")
    path = F.concat(F.lit(before), F.col("pk"), F.lit(middle), first("outputs")["image"]["pk"], F.lit(end))
    return kept.select("ord", path.alias("prediction"), first("inputs")["image"]["name"].alias("input"))


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    """``(file, name, ord, x, y, z)`` of click files; ``ord`` counts the clicks of a name."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", CLICKS).alias("c"))
    return number_clicks(rows.select("file", F.posexplode("c.points").alias("at", "p")).select("file", "at", "p.name", "p.point"))


def number_clicks(points: DataFrame) -> DataFrame:
    """``points(file, at, name, point)`` with each name's clicks numbered from 0."""
    from pyspark.sql import Window as W

    ord_ = F.row_number().over(W.partitionBy("file", "name").orderBy("at")) - 1
    return points.select("file", "name", ord_.alias("ord"), *[F.col("point")[k].alias(c) for k, c in enumerate("xyz")])


def clicks_json(clicks: DataFrame, by: str) -> DataFrame:
    """``(by, json)``: a click file for each group of ``clicks(by, name, ord, x, y, z)``."""
    point = F.struct("name", "ord", F.struct(F.array("x", "y", "z").alias("point"), "name").alias("p"))
    points = F.transform(F.array_sort(F.collect_list(point)), lambda s: s["p"])
    version = F.struct(F.lit(1).alias("major"), F.lit(0).alias("minor"))
    rows = clicks.groupBy(by).agg(points.alias("points"))
    return rows.select(by, F.to_json(F.struct(version.alias("version"), F.lit("Multiple points").alias("type"), "points")).alias("json"))


def case_reports(scores: DataFrame, case: str, metrics: list[str]) -> DataFrame:
    """``(case, json)``: a line of JSON for each case's scores, which scales with the table; :func:`metrics_json` is the single report."""
    return scores.select(case, F.to_json(F.struct(F.col(case).alias("case"), F.struct(*metrics).alias("scores"))).alias("json"))


def metrics_json(scores: DataFrame, aggregates: DataFrame, case: str, metrics: list[str]) -> DataFrame:
    """One row ``json``: the scores of every case by metric, and the aggregates ``(column, stat, value)`` by column.

    A report of one value for each case and metric; it is one text and so is as large as the score table.
    """
    cells = F.map_from_entries(F.array_sort(F.collect_list(F.struct(case, F.struct(*metrics)))))
    stats = aggregates.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stat", "value")))).alias("stats"))
    stats = stats.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("column", "stats")))).alias("aggregates"))
    return scores.agg(cells.alias("case")).crossJoin(stats).select(F.to_json(F.struct("case", "aggregates")).alias("json"))


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, length)`` of the files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines of text files, empty ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def read_csv(spark: SparkSession, path: str, schema: str, rename: dict[str, str] | None = None, distinct: bool = False) -> DataFrame:
    """A CSV table with a header under a fixed schema, columns renamed, repeated rows dropped if asked for."""
    table = spark.read.csv(path, schema=schema, header=True, enforceSchema=False).withColumnsRenamed(rename or {})
    return table.dropDuplicates() if distinct else table
