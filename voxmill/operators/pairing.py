"""Matching predictions with truths, and set operations on lists of files and keyed stores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_existing(names: DataFrame, files: DataFrame, name: str, candidates: Sequence[Column], default: Column | None = None, path: str = "path", out: str = "found") -> DataFrame:
    """``names`` with the first of ``candidates`` that is in ``files``, else ``default``."""
    tried = F.explode(F.array(*[F.struct(F.lit(k).alias("priority"), c.alias(path)) for k, c in enumerate(candidates)]))
    hits = names.select(name, tried.alias("_t")).select(name, "_t.*").join(files.select(path).distinct(), path, "left_semi")
    best = hits.groupBy(name).agg(F.min_by(path, "priority").alias(out))
    return names.join(best, name, "left").withColumn(out, F.coalesce(out, default) if default is not None else F.col(out))


def paired(predictions: DataFrame, references: DataFrame, file: str = "file") -> DataFrame:
    """Each prediction with its reference of the same file name; an error, when it runs, for a prediction without one. References without a prediction are left out."""
    found = predictions.join(references.withColumn("_there", F.lit(True)), file, "left")
    lacks = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no reference for "), F.col(file)))).otherwise(F.lit(True))
    return found.filter(lacks).drop("_there")


def click_file(cases: DataFrame, files: DataFrame, case: str = "case", path: str = "path") -> DataFrame:
    """``cases`` with the click file ``found``: ``<case>_clicks.json``, else ``<case>.json``, else the only file of the case's folder with clicks in its name.

    ``files`` has the columns ``case`` (the folder) and ``path``.
    """
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    rank = F.when(name == F.concat(F.col(case), F.lit("_clicks.json")), 0).when(name == F.concat(F.col(case), F.lit(".json")), 1).when(name.contains("clicks"), 2)
    some = files.select(case, path, rank.alias("_rank")).filter("_rank IS NOT NULL").groupBy(case).agg(F.min(F.struct("_rank", path)).alias("_b"), F.count(F.when(F.col("_rank") == 2, 1)).alias("_n"))
    best = some.filter("_b._rank < 2 OR _n = 1").select(case, F.col(f"_b.{path}").alias("found"))
    return cases.join(best, case, "left")


def missing(expected: DataFrame, there: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` whose key ``there`` lacks: absent predictions, cases still to do."""
    return expected.join(there.select(*key), list(key), "left_anti")


def missing_by_model(expected: DataFrame, models: DataFrame, there: DataFrame, file: str = "file", model: str = "model") -> DataFrame:
    """Files that each model lacks: every expected file against every model. The result's candidates are the product, so models should be few."""
    return expected.select(file).crossJoin(models.select(model)).join(there.select(file, model), [file, model], "left_anti")


def restricted(rows: DataFrame, wanted: DataFrame, broken: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted and not broken."""
    return rows.join(wanted.select(*key), list(key), "left_semi").join(broken.select(*key), list(key), "left_anti")


def in_several(assigned: DataFrame, key: str, fold: str) -> DataFrame:
    """Keys in more than one fold, with how many."""
    return assigned.groupBy(key).agg(F.countDistinct(fold).alias("folds")).filter("folds > 1")


def paths_by_file(listing: DataFrame, file: str, path: str) -> DataFrame:
    """Each file with its paths over all models, in order."""
    return listing.groupBy(file).agg(F.sort_array(F.collect_list(path)).alias("paths"))


def grid(*lists: DataFrame) -> DataFrame:
    """All combinations of short lists (trainers, configurations, plans): the product is the result."""
    out = lists[0]
    for more in lists[1:]:
        out = out.crossJoin(more)
    return out


def merged_store(stores: Sequence[DataFrame], key: str = "key", value: str = "value") -> DataFrame:
    """Keyed values of all stores; the last store that has a key wins."""
    rows = None
    for k, s in enumerate(stores):
        part = s.select(key, value, F.lit(k).alias("_src"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.max_by(value, "_src").alias(value))


def merged_lines(files: Sequence[DataFrame], line: str = "line") -> DataFrame:
    """Distinct lines of several text tables."""
    rows = files[0].select(line)
    for f in files[1:]:
        rows = rows.unionByName(f.select(line))
    return rows.distinct()


def merged_rows(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows of several tables; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def channels_of_case(images: DataFrame, name: str = "name") -> DataFrame:
    """``(case, images)`` of files ``<case>_<dddd>.<suffix>``, channels in order."""
    pattern = r"^(.*)_(\d{4})\.[^/]*$"
    rows = images.select(F.regexp_extract(name, pattern, 1).alias("case"), F.regexp_extract(name, pattern, 2).alias("channel"), name).filter("channel <> ''")
    return rows.groupBy("case").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", name))), lambda s: s[name]).alias("images"))


def nearest_value(asked: DataFrame, there: DataFrame, by: Sequence[str], at: str, value: str, out: str = "near") -> DataFrame:
    """``asked`` with the nearest ``value`` of its group; the lower one of equally near ones."""
    near = asked.select(*by, at).distinct().join(there.select(*by, value), list(by))
    best = near.groupBy(*by, at).agg(F.min(F.struct(F.abs(F.col(value) - F.col(at)).alias("d"), F.col(value).alias("v"))).alias("b")).select(*by, at, F.col("b.v").alias(out))
    return asked.join(best, [*by, at], "left")


def unique_match(what: str) -> Column:
    """The only value of a group; an error if there are several or none."""
    return F.when(F.countDistinct(what) == 1, F.min(what)).otherwise(F.raise_error(F.lit(f"not exactly one {what}")))
