"""Confusion counts and overlap scores of label maps held as long voxel tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What Dice is where both maps lack the class, or only the truth does, by the habits of different tools.
DICE_POLICIES: dict[str, dict[str, float | None]] = {
    "challenge": {"both_empty": 1.0, "gt_empty": 0.0},
    "skip_empty": {"both_empty": None, "gt_empty": 0.0},
    "zero_empty": {"both_empty": 0.0, "gt_empty": 0.0},
    "skip_absent": {"both_empty": None, "gt_empty": None},
}


def _count(hit: Column, n: Column) -> Column:
    return F.coalesce(F.sum(F.when(hit, n)), F.lit(0).cast("long"))


def joint_counts(voxels: DataFrame, case: str = "case_id", gt: str = "gt", pred: str = "pred", ignore: int | None = None) -> DataFrame:
    """Voxels of each (case, true label, predicted label): one pass that every count below derives from.

    Voxels whose true label is ``ignore`` are left out.
    """
    kept = voxels if ignore is None else voxels.filter(F.col(gt) != ignore)
    return kept.groupBy(case, gt, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion(voxels: DataFrame, labels: Sequence[int], case: str = "case_id", gt: str = "gt", pred: str = "pred", ignore: int | None = None) -> DataFrame:
    """``tp, fp, fn, tn`` of every case and every label of ``labels``, labels absent from the case included."""
    return region_confusion(voxels, {str(x): [x] for x in labels}, case, gt, pred, ignore).withColumn("label", F.col("region").cast("long")).drop("region").select(case, "label", "tp", "fp", "fn", "tn")


def region_confusion(voxels: DataFrame, regions: Mapping[str, Sequence[int]], case: str = "case_id", gt: str = "gt", pred: str = "pred", ignore: int | None = None) -> DataFrame:
    """``tp, fp, fn, tn`` of every case and region; a region is a set of labels taken as one class, and regions may overlap."""
    joint = joint_counts(voxels, case, gt, pred, ignore)
    table = F.array(*[F.struct(F.lit(name).alias("region"), F.array(*[F.lit(int(x)) for x in ls]).alias("labels")) for name, ls in regions.items()])
    rows = joint.withColumn("_r", F.explode(table)).select("*", "_r.region", "_r.labels")
    t, p, n = F.array_contains("labels", F.col(gt).cast("int")), F.array_contains("labels", F.col(pred).cast("int")), F.col("n")
    return rows.groupBy(case, "region").agg(_count(t & p, n).alias("tp"), _count(~t & p, n).alias("fp"), _count(t & ~p, n).alias("fn"), _count(~t & ~p, n).alias("tn"))


def aligned(gt: DataFrame, pred: DataFrame, key: Sequence[str] = ("case_id", "x", "y", "z"), label: str = "label") -> DataFrame:
    """Voxels of two sparse label maps side by side; a cell that either lacks is background there."""
    both = gt.select(*key, F.col(label).alias("gt")).join(pred.select(*key, F.col(label).alias("pred")), list(key), "full_outer")
    return both.select(*key, F.coalesce("gt", F.lit(0)).alias("gt"), F.coalesce("pred", F.lit(0)).alias("pred"))


def dice(policy: str = "challenge", eps: float = 0.0) -> Column:
    """Dice of ``tp, fp, fn`` under one of ``DICE_POLICIES``; with ``eps`` the smoothed form, in which an empty class scores 1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    if eps:
        return (2.0 * tp + eps) / (2 * tp + fp + fn + eps)
    rule = DICE_POLICIES[policy]
    return F.when(tp + fp + fn == 0, F.lit(rule["both_empty"])).when(tp + fn == 0, F.lit(rule["gt_empty"])).otherwise(2.0 * tp / (2 * tp + fp + fn))


def iou() -> Column:
    """Intersection over union; null where both maps lack the class."""
    return F.when(F.col("tp") + F.col("fp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn")).cast("double"))


def with_metrics(counts: DataFrame) -> DataFrame:
    """``counts`` with Dice and IoU (null for empty classes) and the voxels that either map has of the class."""
    return counts.withColumns({"dice": dice("skip_empty"), "iou": iou(), "n_pred": F.col("tp") + F.col("fp"), "n_ref": F.col("tp") + F.col("fn")})


def class_means(scores: DataFrame, by: str = "label", metrics: Sequence[str] = ("dice", "iou")) -> DataFrame:
    """Mean of each metric over the cases of a class; nulls are skipped."""
    return scores.groupBy(by).agg(*[F.avg(m).alias(m) for m in metrics])


def foreground_mean(means: DataFrame, by: str = "label", background: int = 0, metrics: Sequence[str] = ("dice", "iou")) -> DataFrame:
    """Unweighted mean of the class means without the background; null if any class has none."""
    kept = means.filter(F.col(by) != background)
    return kept.agg(*[F.when(F.count(m) == F.count(F.lit(1)), F.avg(m)).alias(m) for m in metrics])


def global_scores(counts: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """Scores of the summed counts: the ratio of sums, unlike the mean of ratios that :func:`class_means` takes."""
    summed = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])
    return summed.withColumns({"dice": dice("skip_empty"), "iou": iou()})


def case_average(scores: DataFrame, case: str = "case_id", metric: str = "dice") -> DataFrame:
    """Each case's mean over its classes, 0 if it has none with a score."""
    return scores.groupBy(case).agg(F.coalesce(F.avg(metric), F.lit(0.0)).alias(metric))


def consistency(model_labels: DataFrame, final: str, earlier: Sequence[str], labels: Sequence[int], case: str = "case_id") -> DataFrame:
    """Mean Dice of the ``final`` model's map against each earlier model's; 1 for cases with two models or fewer.

    ``model_labels`` has a column of labels for each model.
    """
    if len(earlier) <= 1:
        return model_labels.select(case).distinct().withColumn("m_dice", F.lit(1.0))
    each = [confusion(model_labels, labels, case, final, other).select(case, dice("challenge").alias("d")) for other in earlier]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(case).agg(F.avg("d").alias("m_dice"))
