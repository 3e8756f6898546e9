"""Scores along an ordered sequence: interaction curves, moving averages, durations, shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.operators.selection import numbered


def area_and_final(scores: DataFrame, by: Sequence[str], order: str, value: str, tie: str | None = None) -> DataFrame:
    """``(*by, auc, final)``: the trapezoid area at unit steps of the rows in order, and the last value.

    The steps count rows, not values of ``order``. A single row has area 0; nulls are left out.
    """
    keys = [order] if tie is None else [order, tie]
    w = W.partitionBy(*by).orderBy(*keys)
    rows = scores.filter(F.col(value).isNotNull()).withColumn("_before", F.lag(value).over(w))
    area = F.coalesce(F.sum((F.col(value) + F.col("_before")) / 2.0), F.lit(0.0))
    return rows.groupBy(*by).agg(area.alias("auc"), F.max_by(value, F.struct(*keys)).alias("final"))


def moving_average(scores: DataFrame, by: Sequence[str], order: str, value: str, keep: float = 0.9) -> DataFrame:
    """``(*by, ema)``: ``keep`` times the average so far and the rest of each value in order; the first value starts it.

    A series is folded in one row, so it should fit in a task (one value for each epoch).
    """
    series = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda r: r[value].cast("double"))
    fold = F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.get("_s", F.lit(0)), lambda a, v: F.lit(keep) * a + F.lit(1 - keep) * v)
    return scores.groupBy(*by).agg(series.alias("_s")).select(*by, fold.alias("ema"))


def epoch_times(log: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """``(*by, fastest, mean)``: seconds of the fastest epoch and of an epoch on average."""
    seconds = F.col(end).cast("double") - F.col(start).cast("double")
    return log.groupBy(*by).agg(F.min(seconds).alias("fastest"), F.avg(seconds).alias("mean"))


def best_so_far(scores: DataFrame, by: Sequence[str], order: str, value: str, out: str = "best") -> DataFrame:
    """``scores`` with the highest value up to each row."""
    return scores.withColumn(out, F.max(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def shard(files: DataFrame, order: str, parts: int, part: int, by: Sequence[str] = ()) -> DataFrame:
    """Every ``parts``-th row of each group in order from row ``part`` on."""
    return numbered(files, [F.col(order)], by).filter((F.col("_rank") - 1) % parts == part).drop("_rank", "_total")


def click_prefixes(clicks: DataFrame, by: Sequence[str], ordinal: str = "ord", most: int = 5) -> DataFrame:
    """For each ``n`` from 0 to ``most``, the first ``n`` clicks of each list: a row for each, and one of nulls for 0."""
    base = clicks.select(*by).distinct().withColumn("n_clicks", F.explode(F.sequence(F.lit(0), F.lit(most))))
    return base.join(clicks, list(by)).filter(F.col(ordinal) < F.col("n_clicks")).select("n_clicks", *clicks.columns).unionByName(
        base.filter("n_clicks = 0").select("n_clicks", *by), allowMissingColumns=True
    )


def upsert_log(log: DataFrame, updates: DataFrame, key: Sequence[str] = ("key", "epoch"), value: str = "value") -> DataFrame:
    """``log`` with the values of ``updates``, which win where both have a key."""
    both = log.select(*key, value, F.lit(0).alias("_src")).unionByName(updates.select(*key, value, F.lit(1).alias("_src")))
    return both.groupBy(*key).agg(F.max_by(value, "_src").alias(value))
