"""Queries over voxels: components, topology, morphology, grids, tiles, losses and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import components, losses, overlap, pairing, resampling, selection, shapes, surface, tiling, values, workflows
from voxmill.plans.base import VOX, confusion_sql, rounded
from voxmill.sources import tables

SHAPE = (7, 8, 8)


def _mask(spark, d, where="gt = 1"):
    return tables.voxels(spark, d).filter(where).select("case_id", "x", "y", "z")


def _per_case(cells):
    return cells.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 64 + F.col("y") * 8 + F.col("z")).cast("long").alias("places"))


def dense(spark, d):
    """Every cell of the grid of every case, with ``value`` (a price by cell) and ``label``; cells without a voxel are 0."""
    v = tables.voxels(spark, d).select("case_id", "x", "y", "z", F.col("gt").alias("label"), ((F.col("gt") * 7 + F.col("pred") * 3 + F.col("x")) * 1.0).alias("value"))
    cells = v.select("case_id").distinct()
    for c, n in zip("xyz", SHAPE, strict=True):
        cells = cells.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.select("case_id", *[F.col(c).cast("long").alias(c) for c in "xyz"]).join(v, ["case_id", "x", "y", "z"], "left").fillna(0, ["label", "value"])


# -- components and topology


def components_26(spark, d):
    return components.component_count(components.label_components(_mask(spark, d, "gt = 1 AND (x + y + z) % 2 = 0")))


def two_largest(spark, d):
    return _per_case(components.keep_largest(components.label_components(_mask(spark, d), connectivity=6), 2)).drop("places")


def cleaned_by_label(spark, d):
    cells = tables.voxels(spark, d).filter("gt > 0").select("case_id", F.col("gt").cast("int").alias("label"), "x", "y", "z")
    kept = components.clean_by_label(components.label_components(cells, ["case_id", "label"], 6), {1: 3, 2: 5}, 2, (3,))
    return kept.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def cleaned_up(spark, d):
    return components.clean_up(components.label_components(_mask(spark, d), connectivity=6), 20, 3).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def component_table(spark, d):
    sizes = components.component_sizes(components.label_components(_mask(spark, d), connectivity=6))
    return rounded(sizes.groupBy("case_id").agg(F.count(F.lit(1)).alias("components"), F.avg("size").alias("mean_size"), F.sum(F.col("x") * F.col("size")).alias("moment")))


def betti(spark, d):
    return components.betti_numbers(_mask(spark, d))


def betti_errors(spark, d):
    return components.betti_errors(components.betti_numbers(_mask(spark, d)), components.betti_numbers(_mask(spark, d, "pred = 1")))


def merged_channels(spark, d):
    masks = tables.voxels(spark, d).select("case_id", "x", "y", "z", F.explode(F.array("gt", "pred")).alias("channel")).distinct()
    return components.merge_channels(masks, 100).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def channel_components(spark, d):
    masks = tables.voxels(spark, d).filter("gt > 0").select("case_id", F.col("gt").alias("channel"), "x", "y", "z")
    return workflows.multi_channel_components(masks, 4, 6).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def cleaned_and_remapped(spark, d):
    v = tables.voxels(spark, d).select("case_id", F.col("pred").alias("label"), "x", "y", "z")
    return workflows.clean_and_remap(v, {1: 3, 2: 3}).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def otsu_mask(spark, d):
    line = tables.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("case_id"), F.floor(F.col("l_extendedprice") / 100).cast("double").alias("p"))
    return rounded(losses.otsu(line, ["case_id"], "p"), 4)


# -- morphology and grids


def dilated_three(spark, d):
    return _per_case(surface.dilate(_mask(spark, d), SHAPE, 3))


def closed(spark, d):
    return _per_case(surface.close(_mask(spark, d, "gt > 0"), SHAPE))


def holes_filled(spark, d):
    return _per_case(shapes.fill_holes(_mask(spark, d, "gt > 0")))


def nonzero_crop(spark, d):
    v = tables.voxels(spark, d).select("case_id", "x", "y", "z", (F.col("pred") * F.when(F.col("x").between(1, 5) & F.col("y").between(2, 6), 1).otherwise(0)).alias("value"), F.col("gt").alias("label"))
    cropped = shapes.crop_to_nonzero(v, "value", "label")
    return cropped.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("xs"))


def pasted_back(spark, d):
    cells = tables.voxels(spark, d).select("case_id", "x", "y", "z")
    box = surface.bounding_box(_mask(spark, d, "gt = 1 AND y > 2"))
    return _per_case(surface.paste_back(surface.crop_to_box(cells, box), box))


def nearest_points(spark, d):
    v = tables.voxels(spark, d)
    points = v.filter("gt = 1 AND x < 2").select("case_id", (F.col("x") * 64 + F.col("y") * 8 + F.col("z")).alias("pid"), "x", "y", "z")
    targets = v.filter("pred = 2 AND x > 3").select("case_id", (F.col("x") * 64 + F.col("y") * 8 + F.col("z")).alias("tid"), "x", "y", "z")
    return rounded(surface.nearest_point(points, targets, ["case_id"], 2).select("case_id", "pid", "tid", "dist"))


def heat_map(spark, d):
    points = _mask(spark, d, "gt = 1 AND (x * 64 + y * 8 + z) % 97 = 5")
    return rounded(tiling.heat(points, 2, 1.5, SHAPE).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("heat").alias("heat"), F.max("heat").alias("top")))


def tile_weights(spark, d):
    cells = dense(spark, d).select("x", "y", "z").distinct()
    return rounded(cells.select("x", "y", "z", tiling.gaussian_weight([F.col("x"), F.col("y"), F.col("z")], SHAPE).alias("w")), 9)


def mirror_mean(spark, d):
    v = tables.voxels(spark, d)
    flips = v.select("case_id", "x", "y", "z", (F.col("pred") * 1.0).alias("p"), F.explode(F.lit(["", "x", "xz"])).alias("flip"))
    return rounded(tiling.mirror_average(flips, ["x", "z"], {"x": 7, "z": 8}).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("p") * (F.col("x") + 1)).alias("p")))


def turned(spark, d):
    v = tables.voxels(spark, d).select("case_id", "x", "y", "z", "gt")
    out = resampling.reorient(tiling.flipped(v, ["z"], {"z": 8}), {"x": 7, "y": 8, "z": 8}, "zxy", "x")
    return out.groupBy("case_id").agg(F.sum(F.col("x") * F.col("gt")).alias("xs"), F.sum(F.col("y") * F.col("gt")).alias("ys"), F.sum(F.col("z") * F.col("gt")).alias("zs"))


def resampled_linear(spark, d):
    return rounded(resampling.resample(dense(spark, d).drop("label"), SHAPE, (10, 8, 5), (1, 1, 1)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("x") * (F.col("z") + 1)).alias("moment")), 4)


def resampled_labels(spark, d):
    out = resampling.resample_labels(dense(spark, d).drop("value"), SHAPE, (10, 8, 5))
    return out.groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def resampled_coarse(spark, d):
    orders = resampling.coarse_axis_orders((5.0, 1.0, 1.0), 1)
    return rounded(resampling.resample(dense(spark, d).drop("label"), SHAPE, (14, 8, 5), orders).groupBy("case_id").agg(F.sum(F.col("value") * (F.col("x") + 1)).alias("moment")), 4)


def smoothed(spark, d):
    out = resampling.smooth(_mask(spark, d).withColumn("value", F.lit(1.0)), SHAPE, 1.0)
    return rounded(out.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("z") + 1)).alias("moment")), 4)


def sampled_features(spark, d):
    v = tables.voxels(spark, d).filter("gt = 3 AND z < 4")
    points = v.select("case_id", (F.col("x") * 64 + F.col("y") * 8 + F.col("z")).alias("pid"), (F.col("x") + 0.25).alias("x"), (F.col("y") - 0.5).alias("y"), (F.col("z") + 0.75).alias("z"))
    return rounded(resampling.sample_points(points, dense(spark, d), SHAPE).select("case_id", "pid", "value"))


def patches(spark, d):
    v = dense(spark, d).withColumn("value", F.col("value").cast("long"))
    corners = spark.createDataFrame([(1, -1, 0, 5), (2, 4, 6, 2)], "pid int, x0 int, y0 int, z0 int").join(v.select("case_id").distinct())
    out = workflows.training_patch(v, corners, (4, 3, 4))
    return out.groupBy("case_id", "pid", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def canal_clicks(spark, d):
    """Clicks on two masks of a map, one with jitter."""
    v = tables.voxels(spark, d).filter("gt IN (1, 2)").select("case_id", F.col("gt").cast("int").alias("canal"), "x", "y", "z")
    return selection.even_clicks(v, 5, ["case_id", "canal"], jitter=2, seed=4).select("case_id", "canal", "ord", "x", F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"))


def mask_steps(spark, d):
    """A stored list of steps applied in order."""
    steps = [(surface.dilate, {"shape": SHAPE}), (surface.erode, {}), (components.label_components, {"connectivity": 6}), (components.drop_small, {"threshold": 2})]
    return _per_case(workflows.apply_all(_mask(spark, d), steps).select("case_id", "x", "y", "z"))


# -- scores, losses, ensembles


def score_table(spark, d):
    """Dice and HD95 of every class, and their means, in a row for each case."""
    return rounded(workflows.evaluate_surfaces(tables.voxels(spark, d), (1, 2, 3, 4), SHAPE)[0])


def score_summary(spark, d):
    return rounded(workflows.evaluate_surfaces(tables.voxels(spark, d), (1, 2), SHAPE)[1], 5)


def _soft(spark, d):
    v = tables.voxels(spark, d).select("case_id", "x", "y", "z", "gt", "pred", F.explode(F.lit([0, 1, 2, 3])).alias("label"))
    p = F.when(F.col("pred") == F.col("label"), 0.55).otherwise(0.15)
    return v.select("case_id", "x", "y", "z", "label", p.alias("p"), (F.col("gt") == F.col("label")).cast("int").alias("y01"))


def soft_dice_losses(spark, d):
    cells = _soft(spark, d).withColumnRenamed("y01", "y2").drop("y").withColumnRenamed("y2", "y")
    one = losses.soft_dice_loss(cells, "case_id", "label")
    return rounded(one)


def soft_dice_batch(spark, d):
    cells = _soft(spark, d).withColumnRenamed("y01", "y2").drop("y").withColumnRenamed("y2", "y")
    return rounded(losses.soft_dice_loss(cells, "case_id", "label", None, batch=True))


def thresholded_dice(spark, d):
    cells = _soft(spark, d).withColumnRenamed("y01", "y2").drop("y").withColumnRenamed("y2", "y")
    return rounded(losses.binary_dice(cells, ["case_id", "label"]))


def cell_losses(spark, d):
    true = _soft(spark, d).filter("y01 = 1")
    ce = losses.mean_cross_entropy(true, "case_id").withColumnRenamed("loss", "ce")
    top = losses.top_k_loss(true, "case_id", ["x", "y", "z"]).withColumnRenamed("loss", "top_k")
    focal = true.groupBy("case_id").agg(F.avg(losses.focal(F.col("p"))).alias("focal"))
    return rounded(ce.join(top, "case_id").join(focal, "case_id"))


def mean_dice(spark, d):
    """Mean Dice of each case over its classes without the background; classes that neither map has don't count."""
    counts = overlap.with_metrics(overlap.confusion(tables.voxels(spark, d), (0, 1, 2, 3)))
    return rounded(counts.filter("label <> 0").groupBy("case_id").agg(F.avg("dice").alias("dice")))


def _probabilities(spark, d, models=3):
    v = tables.voxels(spark, d)
    shift = F.array(*[F.struct(F.lit(f"m{m}").alias("model"), F.lit(m).alias("ord")) for m in range(models)])
    rows = v.select("case_id", "x", "y", "z", "gt", "pred", F.explode(shift).alias("_m")).select("case_id", "x", "y", "z", "gt", "pred", "_m.*")
    p = F.array(*[(F.when(F.when((F.col("x") + F.col("ord")) % 2 == 0, F.col("gt")).otherwise(F.col("pred")) == k, 40).otherwise(10) + (F.col("y") + F.col("ord") + k) % 3) / 100.0 for k in range(4)])
    return rows.select("model", "ord", "case_id", "x", "y", "z", "gt", p.alias("p"))


def folder_ensemble(spark, d):
    return workflows.ensemble_folder(_probabilities(spark, d), 3).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def crossvalidation_ensemble(spark, d):
    rows = _probabilities(spark, d).withColumn("fold", F.col("case_id") % 5)
    return workflows.ensemble_crossvalidation(rows, 3).groupBy("case_id", "label").agg(F.count(F.lit(1)).alias("n"))


def best_of_ensembles(spark, d):
    rows = _probabilities(spark, d)
    order = spark.createDataFrame([(f"m{m}", m) for m in range(3)], "model string, ord int")
    return rounded(workflows.find_best_configuration(rows.drop("ord", "gt"), tables.voxels(spark, d), order, (1, 2, 3)))


def best_single_model(spark, d):
    rows = _probabilities(spark, d).select("model", "case_id", "gt", values.argmax(F.col("p")).alias("pred"))
    order = spark.createDataFrame([(f"m{m}", m) for m in range(3)], "model string, ord int")
    return rounded(workflows.best_model(rows, order, (1, 2, 3)))


def paired_folder_metrics(spark, d):
    """Predictions drive the pairing by file name: each must have a reference, and references without one are left out."""
    v = tables.voxels(spark, d).withColumn("file", F.concat(F.lit("P"), F.col("case_id").cast("string"), F.lit(".mha")))
    made = v.filter("case_id % 3 <> 0").select("file", "x", "y", "z", "pred")
    pairs = pairing.paired(made.select("file").distinct(), v.select("file", "case_id").distinct())
    both = made.join(v.select("file", "x", "y", "z", "gt"), ["file", "x", "y", "z"]).join(pairs, "file")
    return rounded(workflows.folder_metrics(both, (1, 2, 3))[2])


def largest_kept_each(spark, d):
    out = workflows.keep_largest_each(tables.voxels(spark, d), (1, 2), connectivity=6)
    return out.groupBy("case_id", "pred").agg(F.count(F.lit(1)).alias("n"))


def case_evaluation(spark, d):
    v = tables.voxels(spark, d).withColumns({c: (F.col(c) == 1).cast("int") for c in ("gt", "pred")})
    wanted = tables.read(spark, d, "supplier").filter("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("case_id"))
    return rounded(workflows.run_evaluation(v, wanted, SHAPE))


def case_catalogue(spark, d):
    kind = F.when(F.col("l_linenumber") % 3 == 0, "data").when(F.col("l_linenumber") % 3 == 1, "gt_sparse").otherwise("gt_alpha")
    path = F.concat(F.lit("set/P"), F.col("l_orderkey").cast("string"), F.lit("/"), kind, F.lit(".npy"))
    return workflows.catalogue_of_cases(tables.read(spark, d, "lineitem").select(path.alias("path")).distinct())


# -- samples and splits


def location_sample(spark, d):
    cells = tables.voxels(spark, d).filter("gt > 0").select("case_id", "gt", "x", "y", "z")
    return selection.class_locations(cells, ["case_id", "gt"], 10, 0.3, 7).groupBy("case_id", "gt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * 64 + F.col("y") * 8 + F.col("z")).cast("long").alias("places"))


def stratified_split(spark, d):
    rows = tables.read(spark, d, "customer").select("c_nationkey", "c_custkey")
    return selection.stratified(rows, "c_nationkey", "c_custkey", 3, 5)


def shuffled_split(spark, d):
    return selection.split(tables.read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.9, 1234)


def three_way_split(spark, d):
    return selection.three_way(tables.read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.05, 0.05, 48)


def equal_folds(spark, d):
    return selection.folds(tables.read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5, 12345)


def ordered_folds(spark, d):
    return selection.folds(tables.read(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 7)


def whole_shard(spark, d):
    from voxmill.operators import curves

    return curves.shard(tables.read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4, 1)


def sparsified(spark, d):
    return selection.sparsify(tables.voxels(spark, d), "z", 0.4, 9, 3).groupBy("case_id", "gt").agg(F.count(F.lit(1)).alias("n"))


def drawn_rows(spark, d):
    return selection.sampled_to(tables.read(spark, d, "customer").select("c_custkey"), ["c_custkey"], 500, 11).groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


def foreground_sample(spark, d):
    cells = tables.voxels(spark, d).filter("gt > 0").select("case_id", (F.col("x") * 64 + F.col("y") * 8 + F.col("z")).alias("place"), F.col("pred").alias("value"))
    return selection.fixed_sample(cells, ["case_id"], ["place"], 50, 1234).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("place").cast("long").alias("places"))


QUERIES = {
    f.__name__: f
    for f in (
        components_26, two_largest, cleaned_by_label, cleaned_up, component_table, betti, betti_errors, merged_channels, channel_components, cleaned_and_remapped, otsu_mask, dilated_three, closed, holes_filled,
        nonzero_crop, pasted_back, nearest_points, heat_map, tile_weights, mirror_mean, turned, resampled_linear, resampled_labels, resampled_coarse, smoothed, sampled_features, patches, score_table, score_summary,
        soft_dice_losses, soft_dice_batch, thresholded_dice, cell_losses, mean_dice, folder_ensemble, crossvalidation_ensemble, best_of_ensembles, best_single_model, paired_folder_metrics, largest_kept_each, case_evaluation, case_catalogue, canal_clicks, mask_steps,
        location_sample, stratified_split, shuffled_split, three_way_split, equal_folds, ordered_folds, whole_shard, sparsified, drawn_rows, foreground_sample,
    )
}

_COUNT = "count(*) AS n, sum(x * 64 + y * 8 + z)::BIGINT AS places"


def _components(mask: str, near: str, by: str = "case_id") -> str:
    """CTEs ``c(by, id, root)`` and ``s(by, root, n)`` of ``mask(by, x, y, z)``; ``near`` tells neighbours of ``a`` and ``b``."""
    same = " AND ".join(f"a.{k} = b.{k}" for k in by.split(", "))
    back = " AND ".join(f"r.{k} = e.{k}" for k in by.split(", "))
    a = ", ".join(f"a.{k}" for k in by.split(", "))
    r = ", ".join(f"r.{k}" for k in by.split(", "))
    return f"""
m AS ({mask}), i AS (SELECT *, x * 64 + y * 8 + z AS id FROM m),
e AS (SELECT {a}, a.id AS a, b.id AS b FROM i a JOIN i b ON {same} AND a.id <> b.id AND {near}),
r AS (SELECT {by}, id AS a, id AS b FROM i UNION SELECT {r}, r.a, e.b FROM r JOIN e ON {back} AND r.b = e.a),
c AS (SELECT {by}, a AS id, min(b) AS root FROM r GROUP BY ALL),
s AS (SELECT {by}, root, count(*) AS n FROM c GROUP BY ALL)"""


_N6 = "abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1"
_N26 = "greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.z - b.z)) = 1"
_FACES = "o(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
_DENSE = f"""{VOX},
g AS (SELECT case_id, a.i AS x, b.i AS y, c.i AS z FROM (SELECT DISTINCT case_id FROM vox), range(7) a(i), range(8) b(i), range(8) c(i)),
dense AS (SELECT g.*, coalesce(gt, 0) AS label, coalesce(gt * 7 + pred * 3 + vox.x, 0)::DOUBLE AS value FROM g LEFT JOIN vox USING (case_id, x, y, z))"""


def _betti(where: str, name: str) -> str:
    """CTE ``name(case_id, b0, b1, b2)``: Euler's count of corners, edges, faces and cells; cavities are what a flood from outside doesn't reach."""
    comp = _components(f"SELECT case_id, x, y, z FROM vox WHERE {where}", _N26)
    for k in ("m", "i", "e", "r", "c", "s"):
        for pattern in (f"\n{k} AS", f", {k} AS", f",\n{k} AS"):
            comp = comp.replace(pattern, pattern.replace(k + " AS", f"{name}_{k} AS"))
        for pattern in ("FROM ", "JOIN "):
            for end in ("\n", " ", ")"):
                comp = comp.replace(f"{pattern}{k}{end}", f"{pattern}{name}_{k}{end if end != ' ' else f' {k} ' if k in 're' else ' '}")
    n = name
    cells = f"{n}_m"
    kinds = []
    for sign, axes in ((1, ()), (-1, ("x",)), (-1, ("y",)), (-1, ("z",)), (1, ("x", "y")), (1, ("x", "z")), (1, ("y", "z")), (-1, ("x", "y", "z"))):
        shifts = "".join(f", (VALUES (0), (1)) d{c}(d{c})" for c in "xyz" if c not in axes)
        at = ", ".join(f"{c}{f' + d{c}' if c not in axes else ''} AS {c}" for c in "xyz")
        kinds.append(f"SELECT case_id, {sign} * count(*) AS n FROM (SELECT DISTINCT case_id, {at} FROM {cells}{shifts}) GROUP BY 1")
    return f"""{comp},
{n}_w AS (SELECT case_id, a.i AS x, b.i AS y, c.i AS z FROM (SELECT DISTINCT case_id FROM {cells}), range(-1, 8) a(i), range(-1, 9) b(i), range(-1, 9) c(i)),
{n}_bg AS (SELECT * FROM {n}_w ANTI JOIN {cells} USING (case_id, x, y, z)),
{n}_out AS (SELECT case_id, x, y, z FROM {n}_bg WHERE x = -1 AND y = -1 AND z = -1
  UNION SELECT b.case_id, b.x, b.y, b.z FROM {n}_out a JOIN {n}_bg b ON a.case_id = b.case_id AND {_N6}),
{n}_in AS (SELECT *, x * 64 + y * 8 + z AS id FROM {n}_bg ANTI JOIN {n}_out USING (case_id, x, y, z)),
{n}_ie AS (SELECT a.case_id, a.id AS a, b.id AS b FROM {n}_in a JOIN {n}_in b ON a.case_id = b.case_id AND {_N6}),
{n}_ir AS (SELECT case_id, id AS a, id AS b FROM {n}_in UNION SELECT r.case_id, r.a, e.b FROM {n}_ir r JOIN {n}_ie e ON r.case_id = e.case_id AND r.b = e.a),
{n}_b2 AS (SELECT case_id, count(DISTINCT root) AS b2 FROM (SELECT case_id, a, min(b) AS root FROM {n}_ir GROUP BY 1, 2) GROUP BY 1),
{n}_x AS (SELECT case_id, sum(n)::BIGINT AS chi FROM ({" UNION ALL ".join(kinds)}) GROUP BY 1),
{n} AS (SELECT case_id, b0, b0 + coalesce(b2, 0) - chi AS b1, coalesce(b2, 0) AS b2 FROM (SELECT case_id, count(*) AS b0 FROM {n}_s GROUP BY 1) JOIN {n}_x USING (case_id) LEFT JOIN {n}_b2 USING (case_id))"""


def _axis(table: str, axis: str, old: int, new: int, order: int = 1, value: str = "value", by: str = "case_id") -> str:
    """A table with one axis interpolated: shares of a linear axis, or the nearest cell."""
    rest = ", ".join(c for c in "xyz" if c != axis)
    at = f"least(greatest((i + 0.5::DOUBLE) * {old} / {new} - 0.5, 0), {old - 1})"
    if order == 0:
        weights = f"SELECT i, least(floor((i + 0.5::DOUBLE) * {old} / {new} - 0.5 + 0.5), {old - 1})::BIGINT AS j, 1.0::DOUBLE AS w FROM range({new}) t(i)"
    else:
        weights = f"SELECT i, floor({at})::BIGINT AS j, 1 - ({at} - floor({at})) AS w FROM range({new}) t(i) UNION ALL SELECT i, floor({at})::BIGINT + 1, {at} - floor({at}) FROM range({new}) t(i)"
    return f"SELECT {by}, {rest}, w.i AS {axis}, sum({value} * w) AS {value} FROM {table} JOIN ({weights}) w ON {axis} = w.j WHERE w.w <> 0 GROUP BY ALL"


def _smooth(table: str, axis: str, size: int) -> str:
    rest = ", ".join(c for c in "xyz" if c != axis)
    fold = f"CASE WHEN ((i + k) % {2 * size} + {2 * size}) % {2 * size} < {size} THEN ((i + k) % {2 * size} + {2 * size}) % {2 * size} ELSE {2 * size - 1} - ((i + k) % {2 * size} + {2 * size}) % {2 * size} END"
    weights = f"SELECT i, {fold} AS j, exp(-0.5::DOUBLE * k * k) / (SELECT sum(exp(-0.5::DOUBLE * q * q)) FROM range(-4, 5) u(q)) AS w FROM range({size}) t(i), range(-4, 5) s(k)"
    return f"SELECT case_id, {rest}, w.i AS {axis}, sum(value * w) AS value FROM {table} JOIN ({weights}) w ON {axis} = w.j GROUP BY ALL"


_CM4 = confusion_sql((1, 2, 3, 4))
_DICE = "CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"
_SKIP = "CASE WHEN tp + fp + fn = 0 THEN NULL WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"


def _surfaces(labels: str) -> str:
    return f""",
{_FACES}, k(label) AS (VALUES {labels}),
ms AS (SELECT 'g' AS s, case_id, label, x, y, z FROM vox JOIN k ON gt = label UNION ALL SELECT 'p', case_id, label, x, y, z FROM vox JOIN k ON pred = label),
ns AS (SELECT a.s, a.case_id, a.label, a.x, a.y, a.z, count(b.x) AS c FROM ms a CROSS JOIN o LEFT JOIN ms b ON a.s = b.s AND a.case_id = b.case_id AND a.label = b.label AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4, 5, 6),
bs AS (SELECT * FROM ns WHERE c < 6),
ds AS (SELECT p.case_id, p.label, sqrt(min((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS d FROM bs p JOIN bs q ON p.case_id = q.case_id AND p.label = q.label AND p.s <> q.s GROUP BY p.s, p.case_id, p.label, p.x, p.y, p.z),
hs AS (SELECT case_id, label, quantile_cont(d, 0.95) AS hd95 FROM ds GROUP BY 1, 2),
es AS (SELECT c.case_id, k.label, CASE WHEN count(ms.s) > 0 THEN sqrt(177.0) ELSE 0.0 END AS other FROM (SELECT DISTINCT case_id FROM vox) c CROSS JOIN k LEFT JOIN ms ON ms.case_id = c.case_id AND ms.label = k.label GROUP BY 1, 2),
far AS (SELECT case_id, label, coalesce(hd95, other) AS hd95 FROM es LEFT JOIN hs USING (case_id, label)),
near AS (SELECT case_id, label, {_DICE} AS dice FROM cm)"""


def _score_table() -> str:
    cells = ", ".join(f"round(max({m}) FILTER (WHERE label = {x}), 6) AS {m}_{x}" for m in ("dice", "hd95") for x in (1, 2, 3, 4))
    return _CM4 + _surfaces("(1), (2), (3), (4)") + f" SELECT case_id, {cells}, round(avg(dice), 6) AS dice_average, round(avg(hd95), 6) AS hd95_average FROM near JOIN far USING (case_id, label) GROUP BY 1"


_STATS = """count(v) AS count, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS min, round(quantile_cont(v, 0.25), 5) AS pc25,
       round(quantile_cont(v, 0.5), 5) AS pc50, round(quantile_cont(v, 0.75), 5) AS pc75, round(max(v), 5) AS max"""
_SOFT = f"WITH {VOX}, c AS (SELECT case_id, x, y, z, label, CASE WHEN pred = label THEN 0.55::DOUBLE ELSE 0.15::DOUBLE END AS p, (gt = label)::INT AS t FROM vox, range(4) l(label))"
_PROB = f"""WITH {VOX},
pr AS (SELECT 'm' || m AS model, m AS ord, case_id, x, y, z, gt, k, ((CASE WHEN (CASE WHEN (x + m) % 2 = 0 THEN gt ELSE pred END) = k THEN 40 ELSE 10 END) + (y + m + k) % 3) / 100.0::DOUBLE AS p FROM vox, range(3) a(m), range(4) b(k))"""
_ENSEMBLE = _PROB + """, me AS (SELECT case_id, x, y, z, k, avg(p) AS p FROM pr GROUP BY ALL), l AS (SELECT case_id, x, y, z, arg_min(k, (-round(p, 9), k))::INTEGER AS label FROM me GROUP BY ALL)
SELECT case_id, label, count(*) AS n FROM l GROUP BY ALL"""


def _models(pairs: bool) -> str:
    rows = "SELECT a.model AS model, a.ord AS i, a.ord AS j, a.case_id, a.x, a.y, a.z, a.gt, a.k, a.p FROM pr a"
    if pairs:
        rows += " UNION ALL SELECT a.model || '+' || b.model, a.ord, b.ord, a.case_id, a.x, a.y, a.z, a.gt, a.k, (a.p + b.p) / 2 FROM pr a JOIN pr b USING (case_id, x, y, z, k) WHERE a.ord < b.ord"
    return _PROB + f""", ca AS ({rows}),
lb AS (SELECT model, i, j, case_id, x, y, z, gt, arg_min(k, (-round(p, 9), k)) AS pred FROM ca GROUP BY ALL),
co AS (SELECT model, i, j, case_id, label, count(*) FILTER (WHERE gt = label AND pred = label) AS tp, count(*) FILTER (WHERE gt <> label AND pred = label) AS fp, count(*) FILTER (WHERE gt = label AND pred <> label) AS fn
  FROM lb, range(1, 4) q(label) GROUP BY ALL),
me AS (SELECT model, i, j, label, avg({_SKIP}) AS dice FROM co GROUP BY ALL),
sc AS (SELECT model, i, j, avg(dice) AS score FROM me GROUP BY ALL)
SELECT model, round(score, 6) AS score FROM sc ORDER BY score DESC, i <> j, i, j LIMIT 1"""


def _ranks(table: str, key: str, seed: int | None, by: str = "") -> str:
    order = f"md5('{seed}|' || {key}), {key}" if seed is not None else key
    return f"SELECT *, row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order}) AS r, count(*) OVER ({f'PARTITION BY {by}' if by else ''}) AS n FROM {table}"


def _folds(k: int, seed: int | None) -> str:
    return f"WITH q AS ({_ranks('orders', 'o_orderkey', seed)}) SELECT o_orderkey, (CASE WHEN r - 1 < (n % {k}) * (n // {k} + 1) THEN (r - 1) // (n // {k} + 1) ELSE n % {k} + (r - 1 - (n % {k}) * (n // {k} + 1)) // (n // {k}) END)::INTEGER AS fold FROM q"


_LABEL3 = "SELECT case_id, gt::INTEGER AS label, x, y, z FROM vox WHERE gt > 0"

SQL = {
    "components_26": f"WITH RECURSIVE {VOX}, {_components('SELECT case_id, x, y, z FROM vox WHERE gt = 1 AND (x + y + z) % 2 = 0', _N26)} SELECT case_id, count(*) AS components, max(n) AS largest FROM s GROUP BY 1",
    "two_largest": f"WITH RECURSIVE {VOX}, {_components('SELECT case_id, x, y, z FROM vox WHERE gt = 1', _N6)} SELECT case_id, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, root) AS k FROM s) WHERE k <= 2 GROUP BY 1",
    "cleaned_by_label": f"WITH RECURSIVE {VOX}, {_components(_LABEL3, _N6, 'case_id, label')} SELECT case_id, label, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY n DESC, root) AS k FROM s) WHERE CASE WHEN label = 3 THEN k = 1 ELSE n > CASE label WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 2 END END GROUP BY ALL",
    "cleaned_up": f"WITH RECURSIVE {VOX}, {_components('SELECT case_id, x, y, z FROM vox WHERE gt = 1', _N6)} SELECT case_id, sum(n)::BIGINT AS n FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS k FROM s) WHERE k = 20 OR n > 3 GROUP BY 1",
    "component_table": f"WITH RECURSIVE {VOX}, {_components('SELECT case_id, x, y, z FROM vox WHERE gt = 1', _N6)}, t AS (SELECT case_id, root, count(*) AS n, avg(id // 64) AS x FROM c GROUP BY ALL) SELECT case_id, count(*) AS components, round(avg(n), 6) AS mean_size, round(sum(x * n), 6) AS moment FROM t GROUP BY 1",
    "betti": f"WITH RECURSIVE {VOX}, {_betti('gt = 1', 'bg')} SELECT * FROM bg",
    "betti_errors": f"WITH RECURSIVE {VOX}, {_betti('gt = 1', 'bg')}, {_betti('pred = 1', 'bp')} SELECT case_id, abs(coalesce(bg.b0, 0) - coalesce(bp.b0, 0)) AS b0_error, abs(coalesce(bg.b1, 0) - coalesce(bp.b1, 0)) AS b1_error FROM bg FULL JOIN bp USING (case_id)",
    "merged_channels": f"WITH {VOX}, m AS (SELECT case_id, x, y, z, gt AS channel FROM vox UNION SELECT case_id, x, y, z, pred FROM vox), n AS (SELECT *, count(*) OVER (PARTITION BY case_id, channel) AS k FROM m), l AS (SELECT case_id, x, y, z, max(channel) + 1 AS label FROM n WHERE k >= 100 GROUP BY ALL) SELECT case_id, label, count(*) AS n FROM l GROUP BY ALL",
    "channel_components": f"WITH RECURSIVE {VOX}, {_components(_LABEL3, _N6, 'case_id, label')} SELECT case_id, label::BIGINT + 1 AS label, max(n) AS n FROM s WHERE n >= 4 GROUP BY ALL",
    "cleaned_and_remapped": f"WITH RECURSIVE {VOX}, {_components('SELECT case_id, pred AS label, x, y, z FROM vox WHERE pred > 0', _N6, 'case_id, label')} SELECT case_id, 3::BIGINT AS label, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY n DESC, root) AS k FROM s) WHERE k <= 2 GROUP BY 1",
    "otsu_mask": """
WITH v AS (SELECT l_returnflag AS case_id, floor(l_extendedprice / 100)::DOUBLE AS p FROM lineitem), f AS (SELECT case_id, min(p) AS lo, max(p) AS hi FROM v GROUP BY 1),
h AS (SELECT case_id, lo, (hi - lo) / 256 AS w, least(floor((p - lo) / ((hi - lo) / 256)), 255) AS k, count(*) AS n FROM v JOIN f USING (case_id) GROUP BY ALL),
c AS (SELECT *, lo + (k + 0.5::DOUBLE) * w AS c FROM h),
u AS (SELECT *, sum(n) OVER o AS a, sum(n * c) OVER o AS s, sum(n) OVER e AS al, sum(n * c) OVER e AS su FROM c WINDOW o AS (PARTITION BY case_id ORDER BY k), e AS (PARTITION BY case_id)),
b AS (SELECT case_id, c, k, CASE WHEN al > a THEN a::DOUBLE * (al - a)::DOUBLE * pow(s / a - (su - s) / (al - a), 2) ELSE 0 END AS v FROM u)
SELECT case_id, round(arg_max(c, v), 4) AS threshold FROM b GROUP BY 1""",
    "dilated_three": f"WITH {VOX}, g AS (SELECT a.i AS x, b.i AS y, c.i AS z FROM range(7) a(i), range(8) b(i), range(8) c(i)), dl AS (SELECT DISTINCT case_id, g.x, g.y, g.z FROM vox v JOIN g ON abs(v.x - g.x) <= 3 AND abs(v.y - g.y) <= 3 AND abs(v.z - g.z) <= 3 WHERE gt = 1) SELECT case_id, {_COUNT} FROM dl GROUP BY 1",
    "closed": f"""WITH {VOX}, o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
dl AS (SELECT DISTINCT case_id, x + dx AS x, y + dy AS y, z + dz AS z FROM vox, o WHERE gt > 0), er AS (SELECT case_id, x + dx AS x, y + dy AS y, z + dz AS z FROM dl, o GROUP BY ALL HAVING count(*) = 27)
SELECT case_id, {_COUNT} FROM er WHERE x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 7 GROUP BY 1""",
    "holes_filled": f"""WITH RECURSIVE {VOX}, m AS (SELECT case_id, x, y, z FROM vox WHERE gt > 0),
w AS (SELECT case_id, a.i AS x, b.i AS y, c.i AS z FROM (SELECT DISTINCT case_id FROM m), range(-1, 8) a(i), range(-1, 9) b(i), range(-1, 9) c(i)), bg AS (SELECT * FROM w ANTI JOIN m USING (case_id, x, y, z)),
ou AS (SELECT case_id, x, y, z FROM bg WHERE x = -1 AND y = -1 AND z = -1 UNION SELECT b.case_id, b.x, b.y, b.z FROM ou a JOIN bg b ON a.case_id = b.case_id AND {_N6})
SELECT case_id, {_COUNT} FROM (SELECT * FROM w ANTI JOIN ou USING (case_id, x, y, z)) GROUP BY 1""",
    "nonzero_crop": f"""WITH RECURSIVE {VOX}, v AS (SELECT case_id, x, y, z, gt AS label, CASE WHEN x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 6 THEN pred ELSE 0 END AS value FROM vox), m AS (SELECT case_id, x, y, z FROM v WHERE value <> 0),
w AS (SELECT case_id, a.i AS x, b.i AS y, c.i AS z FROM (SELECT DISTINCT case_id FROM m), range(-1, 8) a(i), range(-1, 9) b(i), range(-1, 9) c(i)), bg AS (SELECT * FROM w ANTI JOIN m USING (case_id, x, y, z)),
ou AS (SELECT case_id, x, y, z FROM bg WHERE x = -1 AND y = -1 AND z = -1 UNION SELECT b.case_id, b.x, b.y, b.z FROM ou a JOIN bg b ON a.case_id = b.case_id AND {_N6}),
f AS (SELECT case_id, x, y, z, true AS hit FROM w ANTI JOIN ou USING (case_id, x, y, z)), b AS (SELECT case_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS g FROM f GROUP BY 1),
t AS (SELECT case_id, x - a AS x, CASE WHEN hit IS NULL AND label = 0 THEN -1 ELSE label END AS label FROM v JOIN b USING (case_id) LEFT JOIN f USING (case_id, x, y, z) WHERE x BETWEEN a AND b.b AND y BETWEEN c AND d AND z BETWEEN e AND g)
SELECT case_id, label::BIGINT AS label, count(*) AS n, sum(x)::BIGINT AS xs FROM t GROUP BY ALL""",
    "pasted_back": f"WITH {VOX}, b AS (SELECT case_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM vox WHERE gt = 1 AND y > 2 GROUP BY 1) SELECT case_id, {_COUNT} FROM vox JOIN b USING (case_id) WHERE x BETWEEN a AND b.b AND y BETWEEN c AND d AND z BETWEEN e AND f GROUP BY 1",
    "nearest_points": f"""WITH {VOX}, p AS (SELECT *, x * 64 + y * 8 + z AS pid FROM vox WHERE gt = 1 AND x < 2), t AS (SELECT *, x * 64 + y * 8 + z AS tid FROM vox WHERE pred = 2 AND x > 3),
b AS (SELECT p.case_id, pid, arg_min(tid, ((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2) * 1000 + tid) AS tid, sqrt(min((p.x - t.x) ** 2 + (p.y - t.y) ** 2 + (p.z - t.z) ** 2)) AS dist FROM p JOIN t ON p.case_id = t.case_id GROUP BY ALL)
SELECT p.case_id, p.pid, tid, round(dist, 6) AS dist FROM p LEFT JOIN b ON p.case_id = b.case_id AND p.pid = b.pid""",
    "heat_map": f"""WITH {VOX}, p AS (SELECT case_id, x, y, z FROM vox WHERE gt = 1 AND (x * 64 + y * 8 + z) % 97 = 5), o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-2, 3) a(i), range(-2, 3) b(i), range(-2, 3) c(i)),
c AS (SELECT case_id, x + dx AS x, y + dy AS y, z + dz AS z, min(sqrt(dx * dx + dy * dy + dz * dz)) AS d FROM p, o GROUP BY ALL), h AS (SELECT case_id, 200 * exp(-d / 4.5::DOUBLE) AS heat FROM c WHERE x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 7)
SELECT case_id, count(*) AS n, round(sum(heat), 6) AS heat, round(max(heat), 6) AS top FROM h GROUP BY 1""",
    "tile_weights": "SELECT a.i AS x, b.i AS y, c.i AS z, round(exp(-0.5::DOUBLE * (pow((a.i - 3) / 0.875::DOUBLE, 2) + pow((b.i - 4) / 1.0::DOUBLE, 2) + pow((c.i - 4) / 1.0::DOUBLE, 2))), 9) AS w FROM range(7) a(i), range(8) b(i), range(8) c(i)",
    "mirror_mean": f"""WITH {VOX}, f AS (SELECT case_id, x, y, z, pred FROM vox UNION ALL SELECT case_id, 6 - x, y, z, pred FROM vox UNION ALL SELECT case_id, 6 - x, y, 7 - z, pred FROM vox), m AS (SELECT case_id, x, y, z, avg(pred) AS p FROM f GROUP BY ALL)
SELECT case_id, count(*) AS n, round(sum(p * (x + 1)), 6) AS p FROM m GROUP BY 1""",
    "turned": f"WITH {VOX} SELECT case_id, sum((7 - z) * gt)::BIGINT AS xs, sum((6 - x) * gt)::BIGINT AS ys, sum(y * gt)::BIGINT AS zs FROM vox GROUP BY 1",
    "resampled_linear": f"WITH {_DENSE}, a AS ({_axis('dense', 'x', 7, 10)}), b AS ({_axis('a', 'z', 8, 5)}) SELECT case_id, count(*) AS n, round(sum(value), 4) AS total, round(sum(value * x * (z + 1)), 4) AS moment FROM b GROUP BY 1",
    "resampled_labels": f"""WITH {_DENSE}, q AS (SELECT case_id, label, x, y, z, 1.0::DOUBLE AS share FROM dense), a AS ({_axis('q', 'x', 7, 10, value='share', by='case_id, label')}), b AS ({_axis('a', 'z', 8, 5, value='share', by='case_id, label')}),
l AS (SELECT case_id, x, y, z, coalesce(max(label) FILTER (WHERE share >= 0.5 - 1e-9), 0) AS label FROM b GROUP BY ALL) SELECT case_id, label, count(*) AS n FROM l GROUP BY ALL""",
    "resampled_coarse": f"WITH {_DENSE}, a AS ({_axis('dense', 'x', 7, 14, 0)}), b AS ({_axis('a', 'z', 8, 5)}) SELECT case_id, round(sum(value * (x + 1)), 4) AS moment FROM b GROUP BY 1",
    "smoothed": f"WITH {VOX}, q AS (SELECT case_id, x, y, z, 1.0::DOUBLE AS value FROM vox WHERE gt = 1), a AS ({_smooth('q', 'x', 7)}), b AS ({_smooth('a', 'y', 8)}), c AS ({_smooth('b', 'z', 8)}) SELECT case_id, count(*) AS n, round(sum(value * (z + 1)), 4) AS moment FROM c GROUP BY 1",
    "sampled_features": f"""WITH {_DENSE}, p AS (SELECT case_id, x * 64 + y * 8 + z AS pid, least(greatest(x + 0.25::DOUBLE, 0), 6) AS px, least(greatest(y - 0.5::DOUBLE, 0), 7) AS py, least(greatest(z + 0.75::DOUBLE, 0), 7) AS pz FROM vox WHERE gt = 3 AND z < 4)
SELECT p.case_id, pid, round(sum(value * greatest(0, 1 - abs(px - x)) * greatest(0, 1 - abs(py - y)) * greatest(0, 1 - abs(pz - z))), 6) AS value FROM p JOIN dense d ON p.case_id = d.case_id AND abs(px - x) < 1 AND abs(py - y) < 1 AND abs(pz - z) < 1 GROUP BY ALL""",
    "patches": f"""WITH {_DENSE}, k(pid, x0, y0, z0) AS (VALUES (1, -1, 0, 5), (2, 4, 6, 2)), c AS (SELECT case_id, pid, x0 + a.i AS x, y0 + b.i AS y, z0 + c.i AS z FROM (SELECT DISTINCT case_id FROM vox), k, range(4) a(i), range(3) b(i), range(4) c(i))
SELECT case_id, pid, coalesce(label, -1)::BIGINT AS label, count(*) AS n, sum(coalesce(value, 0))::BIGINT AS total FROM c LEFT JOIN dense USING (case_id, x, y, z) GROUP BY ALL""",
    "score_table": _score_table(),
    "score_summary": confusion_sql((1, 2))
    + _surfaces("(1), (2)")
    + f""", l AS (SELECT 'dice_' || label AS "column", dice AS v FROM near UNION ALL SELECT 'hd95_' || label, hd95 FROM far UNION ALL SELECT 'dice_average', avg(dice) FROM near GROUP BY case_id UNION ALL SELECT 'hd95_average', avg(hd95) FROM far GROUP BY case_id)
SELECT "column", {_STATS} FROM l GROUP BY 1""",
    "soft_dice_losses": _SOFT + ", s AS (SELECT case_id, label, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM c WHERE label <> 0 GROUP BY ALL) SELECT case_id, round(-avg((2 * tp + 1) / (2 * tp + fp + fn + 1)), 6) AS loss FROM s GROUP BY 1",
    "soft_dice_batch": _SOFT + ", s AS (SELECT label, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM c GROUP BY ALL) SELECT round(-avg((2 * tp + 1) / (2 * tp + fp + fn + 1)), 6) AS loss FROM s",
    "thresholded_dice": _SOFT + " SELECT case_id, label::INTEGER AS label, round((2 * sum((p >= 0.5)::INT * t) + 1e-5) / (sum((p >= 0.5)::INT) + sum(t) + 1e-5), 6) AS dice FROM c GROUP BY ALL",
    "cell_losses": _SOFT
    + """, e AS (SELECT *, -ln(p) AS ce, row_number() OVER (PARTITION BY case_id ORDER BY -ln(p) DESC, x, y, z) AS r, count(*) OVER (PARTITION BY case_id) AS n FROM c WHERE t = 1)
SELECT case_id, round(avg(ce), 6) AS ce, round(avg(ce) FILTER (WHERE r <= greatest(floor(n / 10.0), 1)), 6) AS top_k, round(avg(0.25::DOUBLE * (1 - p) ** 2 * ce), 6) AS focal FROM e GROUP BY 1""",
    "mean_dice": confusion_sql((1, 2, 3)) + f"SELECT case_id, round(avg({_SKIP}), 6) AS dice FROM cm GROUP BY 1",
    "folder_ensemble": _ENSEMBLE,
    "crossvalidation_ensemble": _ENSEMBLE,
    "best_of_ensembles": _models(True),
    "best_single_model": _models(False),
    "paired_folder_metrics": confusion_sql(where="case_id % 3 <> 0") + f", m AS (SELECT label, avg({_SKIP}) AS dice, avg(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END) AS iou FROM cm GROUP BY 1) SELECT round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou FROM m",
    "largest_kept_each": f"""WITH RECURSIVE {VOX}, {_components('SELECT case_id, pred AS label, x, y, z FROM vox WHERE pred IN (1, 2)', _N6, 'case_id, label')},
b AS (SELECT case_id, label, root FROM (SELECT *, row_number() OVER (PARTITION BY case_id, label ORDER BY n DESC, root) AS k FROM s) WHERE k = 1), kept AS (SELECT case_id, id FROM c SEMI JOIN b USING (case_id, label, root))
SELECT case_id, CASE WHEN pred IN (1, 2) AND kept.id IS NULL THEN 0 ELSE pred END AS pred, count(*) AS n FROM vox LEFT JOIN kept ON vox.case_id = kept.case_id AND kept.id = x * 64 + y * 8 + z GROUP BY ALL""".replace("SELECT case_id, CASE WHEN pred IN", "SELECT vox.case_id, CASE WHEN pred IN"),
    "case_evaluation": f"""WITH RECURSIVE {VOX.replace("max(l_orderkey % 4) AS gt, min((l_orderkey + l_linenumber) % 4) AS pred", "(max(l_orderkey % 4) = 1)::INT AS gt, (min((l_orderkey + l_linenumber) % 4) = 1)::INT AS pred")},
cm AS (SELECT case_id, 1 AS label, sum(gt * pred)::BIGINT AS tp, sum((1 - gt) * pred)::BIGINT AS fp, sum(gt * (1 - pred))::BIGINT AS fn FROM vox GROUP BY 1){_surfaces("(1)").replace("quantile_cont(d, 0.95) AS hd95", "quantile_cont(d, 0.95) AS hd95, max(d) AS hd").replace("coalesce(hd95, other) AS hd95", "coalesce(hd95, other) AS hd95, coalesce(hd, other) AS hd")},
{_components("SELECT case_id, x, y, z FROM vox WHERE pred = 1", _N26)}, cc AS (SELECT case_id, count(*) AS components FROM s GROUP BY 1)
SELECT case_id, round(dice, 6) AS dice, round(hd, 6) AS hd, round(hd95, 6) AS hd95, coalesce(components, 0) AS components FROM near JOIN far USING (case_id, label) LEFT JOIN cc USING (case_id) WHERE case_id IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0)""",
    "canal_clicks": f"""WITH {VOX}, m AS (SELECT case_id, gt::INTEGER AS canal, x, y, z FROM vox WHERE gt IN (1, 2)), s AS (SELECT case_id, canal, min(x) AS a, max(x) AS b FROM m GROUP BY ALL),
p AS (SELECT case_id, canal, i AS ord, least(greatest(floor(a + i * (b - a) / 4.0::DOUBLE + 0.5)::BIGINT + ('0x' || substr(md5(concat_ws('|', '4', case_id, canal, i)), 1, 8))::BIGINT % 5 - 2, a), b) AS place FROM s, range(0, 5) t(i)),
l AS (SELECT case_id, canal, x, floor(quantile_cont(y, 0.5))::BIGINT AS y, floor(quantile_cont(z, 0.5))::BIGINT AS z FROM m GROUP BY ALL),
b AS (SELECT p.case_id, p.canal, ord::INTEGER AS ord, arg_min(l, abs(x - place) * 100 + x) AS l FROM p JOIN l ON p.case_id = l.case_id AND p.canal = l.canal GROUP BY ALL) SELECT case_id, canal, ord, l.x AS x, l.y AS y, l.z AS z FROM b""",
    "mask_steps": f"""WITH RECURSIVE {VOX}, o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
dl AS (SELECT DISTINCT case_id, x + dx AS x, y + dy AS y, z + dz AS z FROM vox, o WHERE gt = 1), dc AS (SELECT * FROM dl WHERE x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 7),
er AS (SELECT case_id, x + dx AS x, y + dy AS y, z + dz AS z FROM dc, o GROUP BY ALL HAVING count(*) = 27), {_components("SELECT * FROM er", _N6)}
SELECT case_id, count(*) AS n, sum(id)::BIGINT AS places FROM c JOIN s USING (case_id, root) WHERE n > 2 GROUP BY 1""",
    "case_catalogue": """
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS k FROM lineitem)
SELECT 'P' || l_orderkey AS "case", 'set/P' || l_orderkey || '/data.npy' AS image, CASE WHEN bool_or(k = 1) THEN 'set/P' || l_orderkey || '/gt_sparse.npy' END AS sparse, CASE WHEN bool_or(k = 2) THEN 'set/P' || l_orderkey || '/gt_alpha.npy' END AS dense
FROM p GROUP BY l_orderkey HAVING bool_or(k = 0)""",
    "location_sample": f"""WITH {VOX}, q AS (SELECT *, row_number() OVER (PARTITION BY case_id, gt ORDER BY md5(concat_ws('|', '7', case_id, gt, x, y, z))) AS r, count(*) OVER (PARTITION BY case_id, gt) AS n FROM vox WHERE gt > 0)
SELECT case_id, gt, {_COUNT} FROM q WHERE r <= greatest(least(n, 10), ceil(n * 0.3::DOUBLE)) GROUP BY ALL""",
    "stratified_split": f"WITH q AS ({_ranks('customer', 'c_custkey', 5, 'c_nationkey')}) SELECT c_nationkey, c_custkey, CASE WHEN r <= 3 THEN 'valid' ELSE 'train' END AS part FROM q",
    "shuffled_split": f"WITH q AS ({_ranks('orders', 'o_orderkey', 1234)}) SELECT o_orderkey, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'valid' END AS part FROM q",
    "three_way_split": f"WITH q AS ({_ranks('orders', 'o_orderkey', 48)}) SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.05::DOUBLE) THEN 'test' WHEN r <= 2 * ceil(n * 0.05::DOUBLE) THEN 'valid' ELSE 'train' END AS part FROM q",
    "equal_folds": _folds(5, 12345),
    "ordered_folds": _folds(7, None),
    "whole_shard": f"WITH q AS ({_ranks('orders', 'o_orderkey', None)}) SELECT o_orderkey FROM q WHERE (r - 1) % 4 = 1",
    "sparsified": f"""WITH {VOX}, s AS (SELECT DISTINCT case_id, z FROM vox), q AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY md5(concat_ws('|', '3', case_id, z))) AS r, count(*) OVER (PARTITION BY case_id) AS n FROM s)
SELECT case_id, CASE WHEN r <= ceil(n * 0.4::DOUBLE) THEN gt ELSE 9 END AS gt, count(*) AS n FROM vox JOIN q USING (case_id, z) GROUP BY ALL""",
    "drawn_rows": f"WITH q AS ({_ranks('customer', 'c_custkey', None)}), dr AS (SELECT ('0x' || substr(md5('11|' || i), 1, 13))::BIGINT % (SELECT count(*) FROM customer) + 1 AS r FROM range(500) t(i)) SELECT c_custkey, count(*) AS n FROM dr JOIN q USING (r) GROUP BY 1",
    "foreground_sample": f"""WITH {VOX}, v AS (SELECT case_id, x * 64 + y * 8 + z AS place, pred AS value FROM vox WHERE gt > 0), q AS ({_ranks('v', 'place', None, 'case_id')}), g AS (SELECT DISTINCT case_id, n FROM q),
dr AS (SELECT case_id, ('0x' || substr(md5('1234|' || case_id || '|' || i), 1, 13))::BIGINT % n + 1 AS r FROM g, range(50) t(i)) SELECT case_id, count(*) AS n, sum(value)::BIGINT AS total, sum(place)::BIGINT AS places FROM dr JOIN q USING (case_id, r) GROUP BY 1""",
}
