"""Summaries of score tables: descriptions, fold tables, cross tables, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(table: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], bins: int = 4096) -> DataFrame:
    """``(*by, fraction, value)``: exact percentiles of each group, linear between neighbours; nulls are left out.

    A histogram of ``bins`` equal parts of each group's range tells in which parts the needed ranks are, and only their values are put in
    order. So no task holds a whole group. The table is read three times.
    """
    rows = table.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    keys = [f"_by{k}" for k in range(len(by))]
    facts = rows.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count(F.lit(1)).alias("_n"))
    same = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys] or [F.lit(True)]
    renamed = lambda t, other: t.withColumnsRenamed({k: f"{other}{k}" for k in keys})
    part = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    placed = rows.join(renamed(facts, "f"), same("f")).select(*keys, "_v", part.alias("_part"))
    upto = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    hist = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_m")).withColumn("_through", F.sum("_m").over(upto))
    wanted = facts.select(*keys, F.explode(F.lit([float(q) for q in fractions])).alias("fraction"), (F.col("_n") - 1).alias("_last")).withColumn("_at", F.col("fraction") * F.col("_last"))
    ranks = wanted.select(*keys, "fraction", "_at", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    found = ranks.join(renamed(hist, "h"), same("h")).filter((F.col("_rank") < F.col("_through")) & (F.col("_rank") >= F.col("_through") - F.col("_m")))
    found = found.select(*keys, "fraction", "_at", "_part", "_rank", (F.col("_through") - F.col("_m")).alias("_before"))
    near = placed.join(renamed(found.select(*keys, "_part").distinct(), "n").withColumnRenamed("_part", "_np"), [*same("n"), F.col("_part") == F.col("_np")], "left_semi")
    near = near.groupBy(*keys, "_part", "_v").agg(F.count(F.lit(1)).alias("_m")).withColumn("_upto", F.sum("_m").over(W.partitionBy(*keys, "_part").orderBy("_v")))
    hit = found.join(renamed(near, "v").withColumnRenamed("_part", "_vp"), [*same("v"), F.col("_part") == F.col("_vp")])
    hit = hit.filter((F.col("_rank") - F.col("_before") < F.col("_upto")) & (F.col("_rank") - F.col("_before") >= F.col("_upto") - F.col("_m")))
    low, high = F.min("_v"), F.max("_v")
    out = hit.groupBy(*keys, "fraction", "_at").agg((low + (F.col("_at") - F.floor("_at")) * (high - low)).alias("value"))
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], "fraction", "value")


def _wide(table: DataFrame, by: Sequence[str], value: str, named: dict[str, float]) -> DataFrame:
    """Percentiles as columns: ``(*by, *named)``."""
    long = percentiles(table, by, value, list(named.values()))
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("fraction") == q, F.col("value"))).alias(n) for n, q in named.items()])


def _joined(facts: DataFrame, more: DataFrame, by: Sequence[str]) -> DataFrame:
    """``facts`` with the columns of ``more`` of the same group, null keys included."""
    other = more.withColumnsRenamed({c: f"_m_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in by] or [F.lit(True)]
    return facts.join(other, same, "left").drop(*[f"_m_{c}" for c in by])


def describe(table: DataFrame, columns: Sequence[str], by: Sequence[str] = (), spread: bool = False) -> DataFrame:
    """Long table ``(*by, column, count, mean, std, min, pc25, pc50, pc75, max)``: the sample deviation, linear percentiles.

    The percentiles of a group are taken in one pass whose state holds its distinct values, which suits a row for each case; for groups of
    cells or events, ``spread`` takes :func:`percentiles`, of the same result, which no task holds whole.
    """
    long = unpivot(table, columns, by)
    facts = [F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")]
    if spread:
        out = _joined(long.groupBy(*by, "column").agg(*facts), _wide(long, [*by, "column"], "value", {"pc25": 0.25, "pc50": 0.5, "pc75": 0.75}), [*by, "column"])
    else:
        out = long.groupBy(*by, "column").agg(*facts, F.percentile("value", F.lit([0.25, 0.5, 0.75])).alias("_pc")).withColumns({f"pc{q}": F.get("_pc", F.lit(k)) for k, q in enumerate((25, 50, 75))})
    return out.select(*by, "column", "count", "mean", "std", "min", "pc25", "pc50", "pc75", "max")


def describe_text(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, count, freq)`` of text columns: how many values there are and how often the most frequent one occurs."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = table.select(pairs.alias("p")).select("p.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column").agg(F.sum("n").alias("count"), F.max("n").alias("freq"))


def unpivot(table: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(*by, column, value)`` of numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return table.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.column", "_p.value")


def fold_table(scores: DataFrame, by: Sequence[str], fold: str, value: str, folds: Sequence[int]) -> DataFrame:
    """A column for each fold (null where it is missing) and the mean over those that are there."""
    cells = [F.max(F.when(F.col(fold) == k, F.col(value))).alias(f"fold{k}") for k in folds]
    return scores.groupBy(*by).agg(*cells, F.avg(F.when(F.col(fold).isin(*folds), F.col(value))).alias("mean"))


def cross_table(scores: DataFrame, rows: str, columns: str, fold: str, value: str, column_values: Sequence[str], n_folds: int) -> DataFrame:
    """Rows against columns of fold means; a cell that misses a fold is null, and so is the mean of a row with such a cell."""
    cell = scores.groupBy(rows, columns).agg(F.when(F.count(value) == n_folds, F.avg(value)).alias("cell"))
    cells = [F.max(F.when(F.col(columns) == c, F.col("cell"))).alias(c) for c in column_values]
    full = F.when(F.count("cell") == len(column_values), F.avg("cell"))
    return cell.filter(F.col(columns).isin(*column_values)).groupBy(rows).agg(*cells, full.alias("mean"))


def benchmark_table(runs: DataFrame, by: Sequence[str], device: str, value: str, devices: Sequence[str], missing: str = "MISSING") -> DataFrame:
    """Best value of each run by device, two decimals, ``missing`` where there is none."""
    best = lambda d: F.min(F.when(F.col(device) == d, F.col(value)))
    return runs.groupBy(*by).agg(*[F.when(F.count(F.when(F.col(device) == d, F.col(value))) > 0, F.format_string("%.2f", F.round(best(d), 2))).otherwise(F.lit(missing)).alias(d) for d in devices])


def fingerprint(voxels: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Intensity statistics of a dataset: the population deviation, and the percentiles 0.5 and 99.5."""
    v = F.col(value).cast("double")
    facts = voxels.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = _joined(facts, _wide(voxels, by, value, {"median": 0.5, "percentile_99_5": 0.995, "percentile_00_5": 0.005}), by)
    return out.select(*by, "mean", "median", "std", "min", "max", "percentile_99_5", "percentile_00_5")


def vector_percentile(table: DataFrame, vector: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, axis, value)``: the percentile of each component over the rows."""
    return percentiles(table.select(*by, F.posexplode(vector).alias("axis", "_x")), [*by, "axis"], "_x", [q]).drop("fraction")


def target_spacing(spacings: DataFrame, sizes: str = "size", spacing: str = "spacing", threshold: float = 3.0) -> DataFrame:
    """``(axis, value)``: the median spacing, but the tenth percentile on an axis that is much coarser than the others and has few slices.

    ``spacings`` has arrays of spacing and size, a row for each case. The coarse axis never gets finer than the next coarsest one.
    """
    at = spacings.select(F.posexplode(F.arrays_zip(F.col(spacing).alias("s"), F.col(sizes).alias("n"))).alias("axis", "p")).select("axis", "p.s", "p.n")
    stats = at.groupBy("axis").agg(F.percentile("s", F.lit(0.5)).alias("s"), F.percentile("n", F.lit(0.5)).alias("n"), F.percentile("s", F.lit(0.1)).alias("p10"))
    rows = F.sort_array(F.collect_list(F.struct("axis", "s", "n", "p10")))
    table = stats.agg(rows.alias("t")).select("t", F.explode("t").alias("r"))
    worst = F.array_max(F.transform("t", lambda x: F.struct(x["s"], -x["axis"])))
    others = F.filter("t", lambda x: x["axis"] != F.col("r.axis"))
    top_s, top_n = F.array_max(F.transform(others, lambda x: x["s"])), F.array_min(F.transform(others, lambda x: x["n"]))
    coarse = (F.col("r.s") == worst["s"]) & (F.col("r.axis") == -worst["col2"]) & (F.col("r.s") > threshold * top_s) & (F.col("r.n") * threshold < top_n)
    return table.select(F.col("r.axis").alias("axis"), F.when(coarse, F.greatest("r.p10", top_s + 1e-5)).otherwise(F.col("r.s")).alias("value"))


def safe_mean(value: Column) -> Column:
    """Mean of a group, 0 when it is empty."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def median_shape(cases: DataFrame, size: str = "size") -> DataFrame:
    """One row: the median of each axis over the cases' sizes, as text, and the number of cells of that shape."""
    axes = vector_percentile(cases, size, 0.5).agg(F.transform(F.array_sort(F.collect_list(F.struct("axis", "value"))), lambda a: a["value"]).alias("shape"))  # a row an axis
    return axes.select(F.array_join(F.transform("shape", lambda n: n.cast("string")), "x").alias("shape"), F.aggregate("shape", F.lit(1.0), lambda a, n: a * n).alias("cells"))


def summary_json(scores: DataFrame, labels: str, metrics: Sequence[str]) -> DataFrame:
    """One row ``json``: class means by label or region, whose keys (arrays of labels) become text. A row for each class goes in."""
    from voxmill.operators.paths import label_key

    rows = scores.select(label_key(F.col(labels)).alias("key"), F.struct(*metrics).alias("v"))
    return rows.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "v"))))).alias("json"))
