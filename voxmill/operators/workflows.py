"""Multi-stage workflows: folder evaluation, model selection, post-processing, integrity checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import components, losses, overlap, resampling, shared, summary, surface, tiling, values


def evaluate(voxels: DataFrame, labels: Sequence[int], case: str = "case_id", policy: str = "challenge") -> tuple[DataFrame, DataFrame]:
    """Scores of each case (a column of Dice for each label, and their mean), and the description of those columns."""
    scores = overlap.confusion(voxels, labels, case).select(case, "label", overlap.dice(policy).alias("dice"))
    wide = scores.groupBy(case).agg(*[F.max(F.when(F.col("label") == x, F.col("dice"))).alias(f"dice_{x}") for x in labels], F.avg("dice").alias("dice_average"))
    return wide, summary.describe(wide, [*[f"dice_{x}" for x in labels], "dice_average"])


def evaluate_surfaces(voxels: DataFrame, labels: Sequence[int], shape: Sequence[int], case: str = "case_id", spacing: Sequence[float] = (1, 1, 1)) -> tuple[DataFrame, DataFrame]:
    """As :func:`evaluate`, with ``hd95_<label>`` and ``hd95_average`` besides: the challenges' score table, a row for each case.

    Labels that neither map has score 1 and 0; a label that one of them lacks scores 0 and the grid's diagonal.
    """
    wide, _ = evaluate(voxels, labels, case)
    far = surface.surface_distances(voxels, labels, shape, case, spacing)
    far = far.groupBy(case).agg(*[F.max(F.when(F.col("label") == x, F.col("hd95"))).alias(f"hd95_{x}") for x in labels], F.avg("hd95").alias("hd95_average"))
    table = wide.join(far, case)
    return table, summary.describe(table, [f"{m}_{x}" for m in ("dice", "hd95") for x in (*labels, "average")])


def folder_metrics(voxels: DataFrame, labels: Sequence[int], case: str = "case_id", ignore: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Metrics of each case and class, their class means, and the foreground mean."""
    scores = overlap.with_metrics(overlap.confusion(voxels, labels, case, ignore=ignore))
    means = overlap.class_means(scores)
    return scores, means, overlap.foreground_mean(means)


def accumulate_folds(parts: Sequence[DataFrame], case: str = "case_id") -> DataFrame:
    """The union of the folds' voxels with ``fold``; an error, when it runs, for a case in more than one fold."""
    rows = None
    for k, p in enumerate(parts):
        part = p.withColumn("fold", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    several = rows.select(case, "fold").distinct().groupBy(case).agg(F.count(F.lit(1)).alias("_folds"))
    checked = several.select(case, F.when(F.col("_folds") > 1, F.raise_error(F.concat(F.lit("case in several folds: "), F.col(case).cast("string")))).otherwise(F.lit(True)).alias("_ok"))
    return rows.join(checked, case).filter("_ok").drop("_ok")


def model_scores(candidates: DataFrame, labels: Sequence[int], model: str = "model", case: str = "case_id") -> DataFrame:
    """``(model, score)``: the foreground mean of each model's class means over ``candidates(model, case, gt, pred, ...)``, all in one pass."""
    keyed = candidates.withColumn("_case", F.struct(model, case))
    scores = overlap.with_metrics(overlap.confusion(keyed, labels, "_case")).select(F.col("_case")[model].alias(model), "label", "dice")
    means = scores.groupBy(model, "label").agg(F.avg("dice").alias("dice"))
    return means.groupBy(model).agg(F.when(F.count("dice") == F.count(F.lit(1)), F.avg("dice")).alias("score"))


def best_model(candidates: DataFrame, order: DataFrame, labels: Sequence[int], model: str = "model", case: str = "case_id") -> DataFrame:
    """The best model and its score; of equal ones the first of ``order(model, ord)``. Scores are equal if they differ only by the order in which a mean was summed: 12 digits count."""
    scores = model_scores(candidates, labels, model, case).join(order, model)
    return scores.orderBy(F.desc_nulls_last(F.round("score", 12)), "ord").limit(1).select(model, "score")


def determine_postprocessing(voxels: DataFrame, labels: Sequence[int], case: str = "case_id", connectivity: int = 26) -> list[tuple[int, ...]]:
    """The sets of labels of which only the largest component should stay, to be applied in order.

    First all labels as one mask: accepted if the mean Dice rises and no class falls. Then each label by itself, accepted if its
    Dice rises. A label's own trial changes no other label, so all of them are scored in one pass; the driver holds one number for each label.
    """
    accepted: list[tuple[int, ...]] = []
    now = _class_dice(voxels, labels, case)
    if len(labels) > 1:
        trial = keep_largest(voxels, tuple(labels), case, connectivity)
        new = _class_dice(trial, labels, case)
        if _mean(new) > _mean(now) and all(new[x] >= now[x] for x in labels if new[x] is not None and now[x] is not None):
            accepted.append(tuple(labels))
            voxels, now = trial, new
    new = _class_dice(keep_largest_each(voxels, labels, case, connectivity), labels, case)
    return accepted + [(x,) for x in labels if (new[x] or 0.0) > (now[x] or 0.0)]


def keep_largest_each(voxels: DataFrame, labels: Sequence[int], case: str = "case_id", connectivity: int = 26, pred: str = "pred") -> DataFrame:
    """``voxels`` where each of the labels keeps its largest component only; the rest of its predictions become background."""
    cells = voxels.filter(F.col(pred).isin(*labels)).select(case, pred, "x", "y", "z")
    kept = components.keep_largest(components.label_components(cells, [case, pred], connectivity)).select(case, "x", "y", "z", F.lit(True).alias("_kept"))
    gone = F.col(pred).isin(*labels) & F.col("_kept").isNull()
    return voxels.join(kept, [case, "x", "y", "z"], "left").withColumn(pred, F.when(gone, F.lit(0).cast(dict(voxels.dtypes)[pred])).otherwise(F.col(pred))).drop("_kept")


def _mean(scores: dict[int, float | None]) -> float:
    found = [s for s in scores.values() if s is not None]
    return sum(found) / len(found) if found else 0.0


def _class_dice(voxels: DataFrame, labels: Sequence[int], case: str) -> dict[int, float | None]:
    scores = overlap.with_metrics(overlap.confusion(voxels, labels, case))
    return {int(r["label"]): r["dice"] for r in overlap.class_means(scores, metrics=["dice"]).collect()}


def keep_largest(voxels: DataFrame, labels: tuple[int, ...], case: str = "case_id", connectivity: int = 26, pred: str = "pred") -> DataFrame:
    """``voxels`` where predictions of the labels outside of their largest common component become background."""
    cells = voxels.filter(F.col(pred).isin(*labels)).select(case, "x", "y", "z")
    kept = components.keep_largest(components.label_components(cells, [case], connectivity), by=[case]).select(case, "x", "y", "z", F.lit(True).alias("_kept"))
    gone = F.col(pred).isin(*labels) & F.col("_kept").isNull()
    return voxels.join(kept, [case, "x", "y", "z"], "left").withColumn(pred, F.when(gone, F.lit(0).cast(dict(voxels.dtypes)[pred])).otherwise(F.col(pred))).drop("_kept")


def apply_all(table: DataFrame, steps: Sequence[tuple[Callable[..., DataFrame], dict]]) -> DataFrame:
    """``table`` through stored steps in order, each with its own arguments."""
    for step, arguments in steps:
        table = table.transform(step, **arguments)
    return table


def unexpected_labels(voxels: DataFrame, expected: Sequence[int], label: str = "gt", case: str = "case_id") -> DataFrame:
    """``(case, labels, unexpected)``: the labels of each case in order, and those that aren't expected."""
    found = voxels.groupBy(case).agg(F.array_sort(F.collect_set(F.col(label).cast("int"))).alias("labels"))
    return found.withColumn("unexpected", F.array_except("labels", F.lit(list(expected)).cast("array<int>")))


def integrity(cases: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``cases`` with ``violations``: the names of the checks that don't hold for a row, or can't be told."""
    codes = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return cases.withColumn("violations", F.filter(codes, lambda c: c.isNotNull()))


def pseudo_labels(scores: DataFrame, case: str, score: str, component_count: str, at_least: float, expected: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The cases whose predictions are reliable enough to train on, and the rest."""
    from voxmill.operators import selection

    chosen = selection.reliable(scores, case, score, component_count, at_least, expected, most)
    return chosen, selection.complement(scores, chosen, case)


def ensemble_folder(predictions: DataFrame, models: int, by: Sequence[str] = ("case_id",), value: str = "p") -> DataFrame:
    """``(*by, x, y, z, label)`` of ``predictions(model, *by, x, y, z, p array)``: mean probabilities, then the first largest; an error, when it runs, for a case that some model lacks."""
    cover = predictions.select("model", *by).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    lacks = F.when(F.col("_m") != models, F.raise_error(F.concat(F.lit("not all models have "), F.concat_ws(" ", *[F.col(c).cast("string") for c in by])))).otherwise(F.lit(True))
    mean = tiling.mean_vectors(predictions, [*by, "x", "y", "z"], value)
    return mean.join(cover.filter(lacks).select(*by), list(by), "left_semi").select(*by, "x", "y", "z", values.argmax(F.col(value)).alias("label"))


def ensemble_crossvalidation(predictions: DataFrame, models: int, by: Sequence[str] = ("case_id",), value: str = "p") -> DataFrame:
    """As :func:`ensemble_folder`, over the validation cases of every model's folds: an error, too, for a case that is in two folds of a model."""
    folds = predictions.select("model", "fold", *by).distinct().groupBy("model", *by).agg(F.count(F.lit(1)).alias("_f"))
    once = F.when(F.col("_f") > 1, F.raise_error(F.concat(F.lit("in several folds: "), F.concat_ws(" ", *[F.col(c).cast("string") for c in by])))).otherwise(F.lit(True))
    fine = folds.filter(once).select("model", *by)
    return ensemble_folder(predictions.join(fine, ["model", *by], "left_semi"), models, by, value)


def find_best_configuration(candidates: DataFrame, truth: DataFrame, order: DataFrame, labels: Sequence[int], case: str = "case_id", value: str = "p") -> DataFrame:
    """``(model, score)`` of the best of all models and of all ensembles of two; of equal ones the first model of ``order(model, ord)``, single ones before pairs.

    ``candidates(model, case, x, y, z, p array)`` are cross-validated probabilities, ``truth(case, x, y, z, gt)`` the labels. Models and pairs are scored in one pass.
    """
    named = candidates.join(order, "model")
    key = [case, "x", "y", "z"]
    left = named.select(*key, F.col("model").alias("_a"), F.col("ord").alias("_i"), F.col(value).alias("_p"))
    right = named.select(*key, F.col("model").alias("_b"), F.col("ord").alias("_j"), F.col(value).alias("_q"))
    pairs = left.join(right, key).filter("_i <= _j")  # a few models for each cell
    mean = F.zip_with("_p", "_q", lambda a, b: F.round((a + b) / 2, 9))  # equal means stay equal
    each = pairs.select(*key, F.when(F.col("_i") == F.col("_j"), F.col("_a")).otherwise(F.concat_ws("+", "_a", "_b")).alias("model"), F.struct((F.col("_i") != F.col("_j")).alias("pair"), "_i", "_j").alias("ord"), values.argmax(mean).alias("pred"))
    scored = each.join(truth.select(*key, "gt"), key)
    one, two = order.select(F.col("model").alias("_a"), F.col("ord").alias("_i")), order.select(F.col("model").alias("_b"), F.col("ord").alias("_j"))
    places = one.join(two, F.col("_i") <= F.col("_j"))  # a few models
    places = places.select(F.when(F.col("_i") == F.col("_j"), F.col("_a")).otherwise(F.concat_ws("+", "_a", "_b")).alias("model"), F.struct((F.col("_i") != F.col("_j")).alias("pair"), "_i", "_j").alias("ord"))
    return best_model(scored, places, labels, case=case)


def multi_channel_components(masks: DataFrame, least: int, connectivity: int = 26, by: Sequence[str] = ("case_id",), k: int = 1) -> DataFrame:
    """``(*by, x, y, z, label)`` of ``masks(*by, x, y, z, channel)``: of each channel the ``k`` largest components of at least ``least`` cells; the last channel wins a cell."""
    kept = components.keep_largest(components.label_components(masks, [*by, "channel"], connectivity), k, least - 1)
    return components.merge_channels(kept, 0, by)


def clean_and_remap(voxels: DataFrame, remap: dict[int, int], k: int = 2, connectivity: int = 6, by: Sequence[str] = ("case_id",), label: str = "label") -> DataFrame:
    """The ``k`` largest components of each label, and then the labels' new numbers; labels without one stay."""
    kept = components.keep_largest(components.label_components(voxels.filter(F.col(label) > 0).select(*by, label, "x", "y", "z"), [*by, label], connectivity), k)
    return kept.select(*by, "x", "y", "z", values.relabel(F.col(label), remap).alias(label))


def thresholded(cells: DataFrame, threshold: float | None, least: int, by: Sequence[str] = ("case_id",), value: str = "p", connectivity: int = 26) -> DataFrame:
    """Cells above a threshold, or above that of :func:`voxmill.operators.losses.otsu`, in components of at least ``least`` cells."""
    if threshold is None:
        above = cells.join(losses.otsu(cells, by, value), list(by)).filter(F.col(value) > F.col("threshold"))
    else:
        above = cells.filter(F.col(value) > threshold)
    return components.drop_small(components.label_components(above.select(*by, "x", "y", "z"), by, connectivity), least, inclusive=False).select(*by, "x", "y", "z")


def preprocess(voxels: DataFrame, shape: Sequence[int], spacing: Sequence[float], target: Sequence[float], case: str = "case_id", order: int = 3) -> tuple[DataFrame, DataFrame]:
    """``voxels(case, x, y, z, value, label)`` transposed so that the coarsest axis comes first, cropped to the nonzero box, z-scored and resampled to ``target`` spacing.

    Returns the resampled values and labels of a dense grid. All cases have the one ``shape`` and ``spacing``; cells outside of a case's box are 0.
    """
    worst = max(range(3), key=lambda a: spacing[a])
    axes = [worst, *[a for a in range(3) if a != worst]]
    names = "".join("xyz"[a] for a in axes)
    turned = resampling.reorient(voxels, dict(zip("xyz", shape, strict=True)), names)
    old, s, t = ([v[a] for a in axes] for v in (shape, spacing, target))
    new = [round(n * a / b) for n, a, b in zip(old, s, t, strict=True)]
    cropped = turned.join(surface.bounding_box(turned.filter("value <> 0"), [case]), case)
    inside = cropped.filter(" AND ".join(f"{c} >= low_{c} AND {c} < high_{c}" for c in "xyz")).select(*voxels.columns)
    scored = values.z_score(inside, "value", [case], "value")
    dense = turned.select(case, "x", "y", "z", F.lit(0).alias("_v")).join(scored.select(case, "x", "y", "z", "value", "label"), [case, "x", "y", "z"], "left").fillna(0, ["value", "label"]).drop("_v")
    orders = resampling.coarse_axis_orders(s, order)
    image = resampling.resample(dense.drop("label"), old, new, orders, [case])
    return image, resampling.resample_labels(dense.drop("value"), old, new, tuple(min(o, 1) for o in orders), [case])


@dataclass(frozen=True)
class Prepared:
    """Cases prepared for training: the plan (``target`` spacing and the old ``axes`` in their new order), the cases' new ``shapes(case, old, new)``, and cells of ``image`` and ``labels``."""

    target: tuple[float, ...]
    axes: str
    shapes: DataFrame
    image: DataFrame
    labels: DataFrame


def plan_and_preprocess(voxels: DataFrame, geometry: DataFrame, case: str = "case_id", order: int = 3, target: Sequence[float] | None = None) -> Prepared:
    """From dense ``voxels(case, x, y, z, value, label)`` and ``geometry(case, spacing)`` of differing cases to cases of one spacing.

    Every case is cropped to the box of its nonzero values; the spacings and sizes of all of them give the target spacing (:func:`voxmill.operators.summary.target_spacing`), whose coarsest axis comes first.
    Values are z-scored within the case and resampled from its own shape to its own new one, labels by their shares. The three numbers of the target are all that reaches the driver.
    """
    box = shared.cut(surface.bounding_box(voxels.filter("value <> 0"), [case]))
    sizes = box.join(geometry, case).select(case, F.array(*[(F.col(f"high_{c}") - F.col(f"low_{c}")).cast("int") for c in "xyz"]).alias("size"), "spacing")
    if target is None:
        target = [r["value"] for r in summary.target_spacing(sizes).orderBy("axis").collect()]
    worst = max(range(3), key=lambda a: target[a])
    places = [worst, *[a for a in range(3) if a != worst]]
    turned = lambda c: F.array(*[F.col(c)[a] for a in places])
    new = F.array(*[F.greatest(F.bround(F.col("size")[a] * F.col("spacing")[a] / F.lit(float(target[a])), 0), F.lit(1.0)).cast("int") for a in places])
    shapes = shared.cut(sizes.select(case, turned("size").alias("old"), new.alias("new")))
    inside = surface.crop_to_box(voxels.select(case, "x", "y", "z", "value", "label"), box, [case])
    inside = inside.withColumns({n: F.col("xyz"[a]).cast("long") for n, a in zip("xyz", places, strict=True)})
    scored = shared.cut(values.z_score(inside, "value", [case], "value"))
    image = resampling.resample_each(scored.select(case, "x", "y", "z", "value"), shapes, (order,) * 3, [case], "value", case)
    shares = resampling.resample_each(scored.select(case, "label", "x", "y", "z", F.lit(1.0).alias("_share")), shapes, (min(order, 1),) * 3, [case, "label"], "_share", case)
    return Prepared(tuple(target), "".join("xyz"[a] for a in places), shapes, image, resampling.winning_labels(shares, [case]))


def parse_cases(volume: DataFrame, sparse: DataFrame, dense: DataFrame, old: Sequence[int], new: Sequence[int], case: str = "case_id", steps: int = 3) -> DataFrame:
    """``(case, x, y, z, value, sparse, dense)`` of raw cases on another grid: ``volume(case, x, y, z, value)`` is dense, the masks ``sparse`` and ``dense`` have their cells only.

    Sparse masks are dilated by ``steps`` first. All are resampled linearly; a mask holds where its share exceeds a half. ``dense`` is null in cases that have no dense mask.
    """
    key, one = [case, "x", "y", "z"], F.lit(1.0)
    out = resampling.resample(volume, old, new, (1, 1, 1), [case])
    for name, mask in (("sparse", surface.dilate(sparse, old, steps, [case])), ("dense", dense)):
        share = resampling.resample(mask.select(*key, one.alias("_m")), old, new, (1, 1, 1), [case], "_m")
        out = out.join(share.filter("_m > 0.5 + 1e-9").select(*key, F.lit(1).alias(name)), key, "left")
    known = dense.select(case).distinct().withColumn("_known", F.lit(True))
    return out.join(known, case, "left").select(*key, "value", F.coalesce("sparse", F.lit(0)).alias("sparse"), F.when(F.col("_known"), F.coalesce("dense", F.lit(0))).alias("dense"))


def training_sample(cells: DataFrame, low: float, high: float, case: str = "case_id", value: str = "value") -> DataFrame:
    """``cells`` with ``value`` clipped to a window, mapped to it and then to [0, 1] within each case."""
    return values.min_max(cells.withColumn(value, values.rescale(F.col(value), low, high)), value, [case], value)


def with_previous_stage(cells: DataFrame, stage: DataFrame, old: Sequence[int], new: Sequence[int], case: str = "case_id", label: str = "label") -> DataFrame:
    """``cells(case, x, y, z, ...)`` with ``previous``, the label that a coarser stage ``stage(case, x, y, z, label)`` (dense, of shape ``old``) gave to the cell, 0 where it has none."""
    finer = resampling.resample_labels(stage.select(case, "x", "y", "z", label), old, new, (1, 1, 1), [case], label).withColumnRenamed(label, "previous")
    return cells.join(finer, [case, "x", "y", "z"], "left").fillna(0, ["previous"])


def export_prediction(logits: DataFrame, old: Sequence[int], new: Sequence[int], box: Sequence[int], classes: int, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """``(*by, x, y, z, label)``: logits ``(*by, x, y, z, channel, value)`` resampled linearly from ``old`` to ``new``, softmax, argmax, and moved to ``box``'s corner."""
    back = resampling.resample(logits, old, new, (1, 1, 1), [*by, "channel"])
    probs = back.groupBy(*by, "x", "y", "z").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "value"))), lambda s: s["value"]).alias("_p"))  # a few channels
    moved = probs.withColumns({c: F.col(c) + b for c, b in zip("xyz", box, strict=True)})
    return moved.select(*by, "x", "y", "z", F.when(F.size("_p") == classes, values.argmax(values.softmax(F.col("_p")))).otherwise(F.raise_error(F.lit("a cell lacks a class"))).alias("label"))


def training_patch(voxels: DataFrame, corners: DataFrame, size: Sequence[int], by: Sequence[str] = ("case_id",), value: str = "value", label: str = "label") -> DataFrame:
    """``(*by, pid, x, y, z, value, label)``: all cells of patches at ``corners(*by, pid, x0, y0, z0)``; outside of a volume values are 0 and labels -1."""
    cells = corners
    for c, n in zip("xyz", size, strict=True):
        cells = cells.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = cells.select(*by, "pid", *[(F.col(f"{c}0") + F.col(f"_{c}")).alias(c) for c in "xyz"], "_x", "_y", "_z")
    found = cells.join(voxels.select(*by, "x", "y", "z", value, label), [*by, "x", "y", "z"], "left")
    return found.select(*by, "pid", *[F.col(f"_{c}").alias(c) for c in "xyz"], F.coalesce(value, F.lit(0)).alias(value), F.coalesce(label, F.lit(-1)).alias(label))


def run_evaluation(voxels: DataFrame, wanted: DataFrame, shape: Sequence[int], case: str = "case_id", spacing: Sequence[float] = (1, 1, 1), connectivity: int = 26) -> DataFrame:
    """``(case, dice, hd, hd95, components)`` of one mask (``gt`` and ``pred`` are 0 or 1) for the ``wanted`` cases; a case without a prediction has 0 components."""
    kept = voxels.join(wanted.select(case), case, "left_semi")
    scores = overlap.confusion(kept, [1], case).select(case, overlap.dice().alias("dice"))
    far = surface.surface_distances(kept, [1], shape, case, spacing).select(case, "hd", "hd95")
    counts = components.component_count(components.label_components(kept.filter("pred = 1").select(case, "x", "y", "z"), [case], connectivity), [case]).select(case, "components")
    return scores.join(far, case).join(counts, case, "left").fillna(0, ["components"])


def catalogue_of_cases(files: DataFrame, path: str = "path") -> DataFrame:
    """``(case, image, sparse, dense)`` of files ``<case>/data.npy``, ``<case>/gt_sparse.npy`` and, where there is one, ``<case>/gt_alpha.npy``; cases without an image are left out."""
    part = F.struct(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("case"), F.regexp_extract(path, r"([^/]+)[.][^./]+$", 1).alias("kind"), F.col(path).alias("path"))
    rows = files.select(part.alias("_p")).select("_p.*")
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("path")))
    return rows.groupBy("case").agg(pick("data").alias("image"), pick("gt_sparse").alias("sparse"), pick("gt_alpha").alias("dense")).filter("image IS NOT NULL")
