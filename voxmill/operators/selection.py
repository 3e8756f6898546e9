"""Choosing rows: best configurations, reliable cases, splits, samples, clicks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.operators import shared


def hash_order(*columns: str, seed: int) -> Column:
    """A pseudo-random order that every run repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def best_configuration(scores: DataFrame, score: str, order: Sequence[str]) -> DataFrame:
    """The row of the highest score; of equal ones the first in ``order``."""
    return scores.orderBy(F.desc(score), *order).limit(1)


def model_pairs(models: DataFrame, name: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Each unordered pair of models (of a group) once, the earlier first. The result is all pairs, so lists should be short."""
    a, b = models.select(*by, F.col(name).alias("a"), F.col(order).alias("_a")), models.select(*by, F.col(name).alias("b"), F.col(order).alias("_b"))
    return (a.join(b, list(by)).filter(F.col("_a") < F.col("_b")) if by else a.join(b, F.col("_a") < F.col("_b"))).select(*by, "a", "b")


def numbered(rows: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_rank``, counted from 1 in ``order`` within each group of ``by``, and ``_total``, the group's rows.

    Rows are dealt to ranges of (group, order), as many as there are shuffle partitions, and sorted within; a row's number is its place in its range and the rows of the ranges before it,
    so no task holds a group. The sorted rows are checkpointed once. Rows of equal order are numbered arbitrarily.
    """
    parts, keys = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*[F.col(c) for c in by], *order]
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = shared.cut(ranged).withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_m"))
    before = counts.select("_range", (F.sum("_m").over(W.orderBy("_range")) - F.col("_m")).alias("_before"))  # a row for each range
    placed = ranged.join(F.broadcast(before), "_range").withColumn("_at", F.col("_at") + F.col("_before"))
    facts = placed.groupBy(*by).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_total"))
    if not by:  # one row
        return placed.join(F.broadcast(facts)).select(*rows.columns, (F.col("_at") - F.col("_first") + 1).alias("_rank"), "_total")
    return _joined(placed, facts, by).select(*rows.columns, (F.col("_at") - F.col("_first") + 1).alias("_rank"), "_total")


def _joined(rows: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with the facts of their groups, null keys included."""
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return rows.join(facts.withColumnsRenamed({c: f"_by_{c}" for c in by}), same).drop(*[f"_by_{c}" for c in by])


def first_of_each(rows: DataFrame, by: Sequence[str], order: Column, ties: Sequence[Column], keep: Column) -> DataFrame:
    """``rows`` with ``_kept``: whether a row is among the first ``keep`` of its group by ``order``, a text of hexadecimal digits that are spread evenly; ``keep`` may use the group's size ``_total``.

    A histogram of the first digits tells for each group which bin the cut falls into: what comes before it stays, what comes behind goes, and only the rows of that bin, one of 4,096, are ranked.
    """
    binned = rows.withColumn("_order", order).withColumn("_bin", F.substring("_order", 1, 3))
    counts = binned.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_m"))
    w = W.partitionBy(*by)  # a row for each bin
    counts = counts.withColumns({"_upto": F.sum("_m").over(w.orderBy("_bin")), "_total": F.sum("_m").over(w)}).withColumn("_left", keep - (F.col("_upto") - F.col("_m")))
    placed = _joined(binned, counts, [*by, "_bin"])
    cut = (F.col("_left") > 0) & (F.col("_left") < F.col("_m"))
    rank = F.row_number().over(W.partitionBy(*by, "_bin").orderBy("_order", *ties))
    ranked = placed.filter(cut).withColumn("_kept", rank <= F.col("_left"))
    return placed.filter(~cut).withColumn("_kept", F.col("_left") > 0).unionByName(ranked).select(*rows.columns, "_kept")


def reliable(scores: DataFrame, case: str, score: str, components: str, at_least: float, expected: int, most: int) -> DataFrame:
    """The ``most`` best cases above ``at_least`` with exactly ``expected`` components; ties by case."""
    return scores.filter((F.col(score) > at_least) & (F.col(components) == expected)).orderBy(F.desc(score), case).limit(most)


def complement(cases: DataFrame, chosen: DataFrame, case: str) -> DataFrame:
    """The cases that weren't chosen."""
    return cases.join(chosen.select(case), case, "left_anti")


def split(rows: DataFrame, key: Sequence[str], share: float, seed: int) -> DataFrame:
    """``rows`` with ``part``: ``train`` for the first ``share`` (rounded down) in hash order, else ``valid``."""
    ranked = numbered(rows, [hash_order(*key, seed=seed), *[F.col(c) for c in key]])
    return ranked.withColumn("part", F.when(F.col("_rank") <= F.floor(F.col("_total") * share), "train").otherwise("valid")).drop("_rank", "_total")


def three_way(rows: DataFrame, key: Sequence[str], valid: float, test: float, seed: int) -> DataFrame:
    """``rows`` with ``part``: in hash order ``test`` for a first share, ``valid`` for the next (both rounded up), else ``train``."""
    ranked = numbered(rows, [hash_order(*key, seed=seed), *[F.col(c) for c in key]])
    first, second = F.ceil(F.col("_total") * test), F.ceil(F.col("_total") * valid)
    return ranked.withColumn("part", F.when(F.col("_rank") <= first, "test").when(F.col("_rank") <= first + second, "valid").otherwise("train")).drop("_rank", "_total")


def folds(rows: DataFrame, key: Sequence[str], k: int, seed: int | None = None) -> DataFrame:
    """``rows`` with ``fold`` from 0 to ``k - 1``: of equal size (the first ones may have a row more), in hash order, or in the keys' order without a seed."""
    order = [F.col(c) for c in key]
    ranked = numbered(rows, order if seed is None else [hash_order(*key, seed=seed), *order])
    at, size, more = F.col("_rank") - 1, F.floor(F.col("_total") / k), F.col("_total") % k
    fold = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("fold", fold.cast("int")).drop("_rank", "_total")


def sampled_to(rows: DataFrame, key: Sequence[str], n: int, seed: int) -> DataFrame:
    """``n`` rows drawn with replacement, each draw ``_draw`` a hash of its number: the same in every run."""
    ranked = numbered(rows, [F.col(c) for c in key])
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("_draw").cast("string"))), 1, 13), 16, 10).cast("long")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    draws = rows.sparkSession.range(n).select(F.col("id").alias("_draw")).withColumn("_rank", F.pmod(bits, F.greatest(total, F.lit(1))) + 1)
    return draws.join(ranked, "_rank").drop("_rank", "_total")


def fixed_sample(rows: DataFrame, by: Sequence[str], order: Sequence[str], n: int, seed: int) -> DataFrame:
    """Of each group ``n`` rows drawn with replacement, told apart by ``_draw``; an empty group has none."""
    ranked = numbered(rows, [F.col(c) for c in order], by)
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.col("_draw").cast("string"))), 1, 13), 16, 10).cast("long")
    return groups.withColumn("_rank", F.pmod(bits, "_n") + 1).join(ranked, [*by, "_rank"]).drop("_rank", "_total", "_n")


def hash_folds(rows: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """``rows`` with a ``fold`` that depends on the row alone: sizes differ a little, nothing is shuffled."""
    bits = F.conv(F.substring(hash_order(*key, seed=seed), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", F.pmod(bits, F.lit(k)).cast("int"))


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """``rows`` with ``part``: ``valid`` for ``n`` rows of each stratum in hash order, else ``train``."""
    chosen = first_of_each(rows, [stratum], hash_order(key, seed=seed), [F.col(key)], F.lit(n))
    return chosen.withColumn("part", F.when(F.col("_kept"), "valid").otherwise("train")).drop("_kept")


def class_locations(voxels: DataFrame, by: Sequence[str], least: int, share: float, seed: int) -> DataFrame:
    """Of each group ``min(n, least)`` voxels, but at least ``share`` of them, in hash order."""
    keep = F.greatest(F.least("_total", F.lit(least)), F.ceil(F.col("_total") * share))
    return first_of_each(voxels, by, hash_order(*by, "x", "y", "z", seed=seed), [F.col(c) for c in "xyz"], keep).filter("_kept").drop("_kept")


def fullest_slice(cells: DataFrame, axis: str, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """The slice of each group with the most cells; the lowest of equal ones."""
    counts = cells.groupBy(*by, axis).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max(F.struct("n", (-F.col(axis)).alias("m"))).alias("b")).select(*by, (-F.col("b.m")).alias(axis), F.col("b.n").alias("n"))


def even_clicks(cells: DataFrame, k: int, by: Sequence[str] = ("case_id",), jitter: int = 0, seed: int = 0) -> DataFrame:
    """``(*by, ord, x, y, z)``: a click in each of ``k`` slices spread evenly along x.

    Each of the even places, moved by up to ``jitter`` slices either way (a hash of the group and the click), takes the nearest slice that has cells (the lower of equal ones) and clicks
    its middle: the median of y, rounded down, and of z. Empty masks give no clicks.
    """
    span = cells.groupBy(*by).agg(F.min("x").alias("_a"), F.max("x").alias("_b"))
    place = F.floor(F.col("_a") + F.col("ord") * (F.col("_b") - F.col("_a")) / F.lit(float(max(k - 1, 1))) + 0.5)
    if jitter:
        bits = F.conv(F.substring(hash_order(*by, "ord", seed=seed), 1, 8), 16, 10).cast("long")
        place = F.least(F.greatest(place + F.pmod(bits, F.lit(2 * jitter + 1)) - jitter, F.col("_a")), F.col("_b"))
    places = span.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("_at", place)
    slices = cells.groupBy(*by, "x").agg(F.floor(F.percentile("y", F.lit(0.5))).alias("y"), F.floor(F.percentile("z", F.lit(0.5))).alias("z"))
    near = places.join(slices, list(by)).groupBy(*by, "ord").agg(F.min(F.struct(F.abs(F.col("x") - F.col("_at")).alias("d"), "x", "y", "z")).alias("b"))
    return near.select(*by, "ord", "b.x", "b.y", "b.z")


def sparsify(voxels: DataFrame, axis: str, share: float, ignore: int, seed: int, label: str = "gt", case: str = "case_id") -> DataFrame:
    """``label`` kept on a ``share`` of the slices of each case in hash order, ``ignore`` elsewhere."""
    slices = voxels.select(case, axis).distinct()
    w = W.partitionBy(case)
    kept = slices.withColumns({"_r": F.row_number().over(w.orderBy(hash_order(case, axis, seed=seed))), "_n": F.count(F.lit(1)).over(w)})
    kept = kept.filter(F.col("_r") <= F.ceil(F.col("_n") * share)).select(case, axis, F.lit(True).alias("_kept"))
    return voxels.join(kept, [case, axis], "left").withColumn(label, F.when(F.col("_kept"), F.col(label)).otherwise(F.lit(ignore))).drop("_kept")
