"""Operators on grids small enough to check by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import topology
from voxmill.operators import catalogue, components, curves, losses, overlap, pairing, paths, resampling, selection, shapes, summary, surface, tiling, values, workflows
from voxmill.sources import manifest, volumes
from voxmill.streaming import scores


def grid(spark, gt, pred):
    """Voxels of case 1: two binary masks as sets of coordinates."""
    rows = [("1", *c, int(c in gt), int(c in pred)) for c in sorted(gt | pred | {(0, 0, 0)})]
    return spark.createDataFrame(rows, "case_id string, x int, y int, z int, gt int, pred int")


def cube(n, at=0):
    return {(x, y, z) for x in range(at, at + n) for y in range(at, at + n) for z in range(at, at + n)}


def dice(spark, gt, pred, policy):
    return overlap.confusion(grid(spark, gt, pred), [1]).select(overlap.dice(policy).alias("d")).first().d


@pytest.mark.parametrize(("policy", "both", "one"), [("challenge", 1.0, 0.0), ("skip_empty", None, 0.0), ("zero_empty", 0.0, 0.0), ("skip_absent", None, None)])
def test_dice_of_empty_masks(spark, policy, both, one):
    assert dice(spark, set(), set(), policy) == both
    assert dice(spark, set(), {(1, 1, 1)}, policy) == one
    assert dice(spark, {(1, 1, 1)}, set(), policy) == 0.0


def test_half_overlap(spark):
    row = overlap.with_metrics(overlap.confusion(grid(spark, {(0, 0, k) for k in range(4)}, {(0, 0, k) for k in range(2, 6)}), [1])).first()
    assert row.dice == 0.5 and row.iou == pytest.approx(1 / 3) and (row.tp, row.fp, row.fn) == (2, 2, 2)


def test_ignored_voxels_count_nowhere(spark):
    rows = spark.createDataFrame([("1", 0, 0, 0, 3, 1), ("1", 0, 0, 1, 1, 1)], "case_id string, x int, y int, z int, gt int, pred int")
    row = overlap.confusion(rows, [1], ignore=3).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (1, 0, 0, 0)


@pytest.mark.parametrize(
    ("gt", "pred", "hd", "hd95"),
    [(set(), set(), 0.0, 0.0), ({(1, 1, 1)}, set(), math.sqrt(27), math.sqrt(27)), (cube(3, 1), cube(3, 1), 0.0, 0.0), ({(0, 0, 0)}, {(3, 0, 0)}, 3.0, 3.0)],
)
def test_surface_distances(spark, gt, pred, hd, hd95):
    row = surface.surface_distances(grid(spark, gt, pred), [1], (3, 3, 3)).first()
    assert (row.hd, row.hd95) == (pytest.approx(hd), pytest.approx(hd95))


def test_border_of_a_cube(spark):
    assert surface.border(grid(spark, cube(3), set()).filter("gt = 1").select("case_id", "x", "y", "z")).count() == 26


RING = {(x, y, 0) for x in range(3) for y in range(3)} - {(1, 1, 0)}


@pytest.mark.parametrize(("cells", "betti"), [(cube(3), (1, 0, 0)), (RING, (1, 1, 0)), (cube(3) - {(1, 1, 1)}, (1, 0, 1)), ({(0, 0, 0), (1, 1, 1)}, (1, 0, 0)), ({(0, 0, 0), (2, 2, 2)}, (2, 0, 0))])
def test_betti_numbers(spark, cells, betti):
    table = spark.createDataFrame([("1", *c) for c in cells], "case_id string, x int, y int, z int")
    row = components.betti_numbers(table).first()
    assert (row.b0, row.b1, row.b2) == betti


def test_corner_neighbours(spark):
    table = spark.createDataFrame([("1", 0, 0, 0), ("1", 1, 1, 1)], "case_id string, x int, y int, z int")
    count = lambda c: components.component_count(components.label_components(table, connectivity=c)).first().components
    assert (count(6), count(26)) == (2, 1)


def test_components_kept_and_dropped(spark):
    cells = [("1", 0, 0, k) for k in range(3)] + [("1", 4, 0, k) for k in range(2)] + [("1", 8, 0, 0)]
    labelled = components.label_components(spark.createDataFrame(cells, "case_id string, x int, y int, z int"))
    assert components.keep_largest(labelled).count() == 3 and components.keep_largest(labelled, 2).count() == 5
    assert components.drop_small(labelled, 1).count() == 5 and components.drop_small(labelled, 2, inclusive=False).count() == 5
    assert components.clean_up(labelled, 3, 2).count() == 6 and components.clean_up(labelled, 2, 2).count() == 3
    assert components.triage(labelled, 3).first().verdict == "good"


def test_postprocessing_is_accepted_only_if_it_helps(spark):
    gt = {(0, 0, k) for k in range(4)}
    assert workflows.determine_postprocessing(grid(spark, gt, gt | {(2, 2, 2)}), [1]) == [(1,)]
    assert workflows.determine_postprocessing(grid(spark, gt | {(2, 2, 2)}, gt | {(2, 2, 2)}), [1]) == []


def test_case_in_two_folds_is_an_error(spark):
    part = grid(spark, cube(2), cube(2))
    with pytest.raises(Exception, match="several folds"):
        workflows.accumulate_folds([part, part]).count()


def test_curves(spark):
    table = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.5), ("a", 2, 1.0), ("b", 0, 0.7)], "k string, i int, v double")
    got = {r.k: (r.auc, r.final) for r in curves.area_and_final(table, ["k"], "i", "v").collect()}
    assert got == {"a": (1.0, 1.0), "b": (0.0, 0.7)}
    ema = {r.k: r.ema for r in curves.moving_average(table, ["k"], "i", "v").collect()}
    assert ema["a"] == pytest.approx(0.9 * (0.9 * 0 + 0.1 * 0.5) + 0.1) and ema["b"] == 0.7


def test_tied_best_takes_the_first(spark):
    table = spark.createDataFrame([("single", 0, 0.9), ("pair", 1, 0.9)], "m string, ord int, s double")
    assert selection.best_configuration(table, "s", ["ord"]).first().m == "single"


def test_splits_are_exact_and_repeat(spark):
    rows = spark.range(103).repartition(7)
    split = lambda t: sorted((r.id, r.part) for r in selection.split(t, ["id"], 0.9, 1234).collect())
    assert split(rows) == split(rows.repartition(3)) and sum(p == "train" for _, p in split(rows)) == 92
    sizes = [r["count"] for r in selection.folds(rows, ["id"], 5, 12345).groupBy("fold").count().collect()]
    assert sorted(sizes) == [20, 20, 21, 21, 21]


def test_names(spark):
    t = spark.createDataFrame([("P1_0000.mha",), ("P1.mha",), ("P1_0000.nii.gz",)], "n string")
    assert [r[0] for r in t.select(paths.ground_truth_name(F.col("n"))).collect()] == ["P1.mha"] * 3
    assert [r[0] for r in t.select(paths.case_and_index(F.col("n"))["idx"]).collect()] == [0, -1, 0]
    with pytest.raises(Exception, match="bad file name"):
        spark.createDataFrame([("a.png",)], "n string").select(paths.with_mha(F.col("n"))).collect()
    keys = spark.createDataFrame([([1],), ([1, 2],)], "l array<int>").select(paths.label_key(F.col("l")).alias("k"))
    assert [(r.k, r.b) for r in keys.select("k", paths.labels_of_key(F.col("k")).alias("b")).collect()] == [("1", [1]), ("(1, 2)", [1, 2])]


def test_values(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(values.argmax(F.lit([1.0, 3.0, 3.0]))) == 1
    assert sum(get(values.softmax(F.lit([1.0, 2.0, 3.0])))) == pytest.approx(1)
    assert get(values.region_decode(F.lit([0.9, 0.6]), [2, 1])) == 1 and get(values.region_decode(F.lit([0.5, 0.5]), [2, 1])) == 0
    assert get(tiling.tile_starts(F.lit(100), 32, 0.5)) == [0, 14, 27, 41, 54, 68]
    assert get(tiling.tile_starts(F.lit(20), 32, 0.5)) == [0]
    with pytest.raises(Exception, match="out of range"):
        get(values.rescale_checked(F.lit(300.0)))


def test_first_existing_path(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "n string")
    files = spark.createDataFrame([("a.mha",), ("a",), ("b.mha",)], "path string")
    got = pairing.first_existing(names, files, "n", [F.col("n"), F.concat("n", F.lit(".mha"))], F.lit("none"))
    assert {r.n: r.found for r in got.collect()} == {"a": "a", "b": "b.mha", "c": "none"}


def test_volumes_round_trip(spark, tmp_path):
    array = np.zeros((3, 4, 5), np.uint8)
    array[1, 2, 3] = 7
    (tmp_path / "a.mha").write_bytes(volumes.meta_bytes(array, (0.3, 0.3, 0.5)))
    np.save(tmp_path / "b.npy", array)
    got = {r.path[-5:]: r for r in volumes.read_volumes(spark, str(tmp_path)).collect()}
    assert got["a.mha"].shape == [3, 4, 5] and got["a.mha"].spacing == [0.3, 0.3, 0.5]
    cells = volumes.read_voxels(spark, str(tmp_path)).collect()
    assert [(r.x, r.y, r.z, r.value) for r in cells] == [(1, 2, 3, 7.0)] * 2
    table = spark.createDataFrame([("c", 1, 2, 3, 7)], "case_id string, x int, y int, z int, label int")
    back, _ = volumes.parse_meta(bytes(volumes.volume_files(table, "case_id", (3, 4, 5)).first().content))
    assert (back == array).all()


def test_manifests_and_clicks(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"inputs": [{"type": "x", "filename": "in"}], "outputs": [{"type": "x", "filename": "out"}], "error_messages": []}, {"inputs": [], "outputs": []}]))
    entries = manifest.read_manifest(spark, f"{tmp_path}/m.json")
    assert manifest.is_results(entries)
    assert [(r.prediction, r.input) for r in manifest.mapping(entries, True).collect()] == [("out", "in")]
    clicks = spark.createDataFrame([("c", "Left", 0, 1, 2, 3), ("c", "Left", 1, 4, 5, 6)], "case string, name string, ord int, x int, y int, z int")
    (tmp_path / "clicks.json").write_text(manifest.clicks_json(clicks, "case").first().json)
    assert [(r.name, r.ord, r.x, r.z) for r in manifest.read_clicks(spark, f"{tmp_path}/clicks.json").orderBy("ord").collect()] == [("Left", 0, 1, 3), ("Left", 1, 4, 6)]


def test_stream_of_scores(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:00:10", "a", 1.0), ("2026-01-01 00:00:50", "a", 3.0), ("2026-01-01 00:01:10", "a", 5.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    query = scores.windowed_summary(stream, "t", ["k"], "v", "1 minute", "1 minute").writeStream.format("memory").queryName("summaries").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    query.awaitTermination(120)
    assert sorted((r["count"], r["mean"]) for r in spark.table("summaries").collect()) == [(1, 5.0), (2, 2.0)]


# -- resampling, skeletons, plans


def test_cubic_axis_passes_through_a_cubic():
    weights = resampling.axis_weights(40, 80, 3)
    at = (np.arange(80) + 0.5) / 2 - 0.5
    f = lambda x: 0.01 * x**3 - 0.3 * x**2 + 2 * x
    assert np.allclose((weights @ f(np.arange(40.0)))[20:60], f(at)[20:60], atol=1e-4)
    assert np.allclose(weights.sum(1), 1) and np.allclose(resampling.axis_weights(7, 7, 3), np.eye(7), atol=1e-6)
    assert np.allclose(resampling.axis_weights(8, 4, 1).sum(1), 1) and resampling.axis_weights(4, 2, 0).sum() == 2


def test_separable_resampling_is_a_product_of_axes(spark):
    draw = np.random.default_rng(0).normal(size=(5, 4, 3))
    rows = [("1", x, y, z, float(draw[x, y, z])) for x, y, z in np.ndindex(draw.shape)]
    got = np.zeros((7, 4, 6))
    for r in resampling.resample(spark.createDataFrame(rows, "case_id string, x int, y int, z int, value double"), (5, 4, 3), (7, 4, 6), (3, 3, 0)).collect():
        got[r.x, r.y, r.z] = r.value
    want = np.einsum("ax,xyz,cz->ayc", resampling.axis_weights(5, 7, 3), draw, resampling.axis_weights(3, 6, 0))
    assert np.allclose(got, want, atol=1e-6)
    assert resampling.coarse_axis_orders((1.0, 1.0, 5.0), 3) == (3, 3, 0) and resampling.coarse_axis_orders((1.0, 1.0, 2.0), 3) == (3, 3, 3)


def test_skeleton_keeps_topology():
    bar = np.zeros((5, 5, 12), bool)
    bar[1:4, 1:4, 1:11] = True
    line = shapes.thinned(bar)
    assert 6 <= line.sum() <= 12 and set(zip(*np.nonzero(line)[:2], strict=True)) == {(2, 2)}
    ring = np.zeros((9, 9, 5), bool)
    ring[1:8, 1:8, 1:4] = True
    ring[3:6, 3:6, :] = False
    thin = shapes.thinned(ring)
    assert thin.sum() < 40 and topology.betti(np.argwhere(thin))[:2] == (1, 1)


def test_centre_line_dice(spark):
    cells = lambda where: spark.createDataFrame([("1", *c) for c in where], "case_id string, x int, y int, z int")
    bar = {(x, y, z) for x in range(3) for y in range(3) for z in range(12)}
    half = {c for c in bar if c[2] < 6}
    same = shapes.centre_line_dice(cells(bar), cells(bar)).first()
    assert (same.precision, same.recall, same.cldice) == (1, 1, 1)
    part = shapes.centre_line_dice(cells(bar), cells(half)).first()
    assert part.precision == 1 and 0.3 < part.recall < 0.7
    assert shapes.centre_line_dice(cells(bar), cells([(50, 50, 50)])).first().cldice == 0


def test_holes_are_filled(spark):
    shell = cube(5) - {(2, 2, 2)}
    rows = spark.createDataFrame([("1", *c) for c in shell], "case_id string, x int, y int, z int")
    assert shapes.fill_holes(rows).count() == 125
    rows = spark.createDataFrame([("1", *c) for c in shell - {(2, 2, 1), (2, 2, 0)}], "case_id string, x int, y int, z int")
    assert shapes.fill_holes(rows).count() == 122


def test_topology_over_block_borders(spark):
    """Many random masks, a null group among them, in blocks much smaller than they are."""
    rng = np.random.default_rng(7)
    masks = {g: {tuple(map(int, c)) for c in np.argwhere(rng.random((11, 9, 10)) < share) - 5} for g, share in (("a", 0.15), ("b", 0.5), ("c", 0.8), (None, 0.9))}
    masks["shell"] = cube(9) - {(x, y, z) for x in range(1, 8) for y in range(1, 8) for z in range(1, 8)}
    masks["lone"] = {(700, -700, 3)}
    rows = spark.createDataFrame([(g, *c, "extra") for g, cells in masks.items() for c in cells], "g string, x int, y int, z int, size string")
    got = {r.g: (r.b0, r.b1, r.b2) for r in components.betti_numbers(rows, ["g"], block=4).collect()}
    assert got == {g: topology.betti(cells) for g, cells in masks.items()}
    filled = {}
    for r in shapes.fill_holes(rows, ["g"]).collect():
        filled.setdefault(r.g, []).append((r.x, r.y, r.z))
    assert {g: sorted(c) for g, c in filled.items()} == {g: sorted(cells.union(*topology.holes(cells))) for g, cells in masks.items()}
    assert components.betti_numbers(rows.limit(0), ["g"]).count() == 0 and shapes.fill_holes(rows.limit(0), ["g"]).count() == 0


def test_small_boxes_have_the_betti_numbers_of_blocks(spark, monkeypatch):
    draw = np.random.default_rng(6)
    masks = {k: draw.random(tuple(draw.integers(2, 9, 3))) < draw.choice([0.3, 0.6, 0.9]) for k in range(40)}
    masks[40] = np.ones((5, 5, 5), bool)
    masks[40][2, 2, 2] = False
    rows = spark.createDataFrame([(k, *(int(c) - 4 for c in at)) for k, m in masks.items() for at in np.argwhere(m)] + [(None, 0, 0, 0)], "g long, x int, y int, z int")
    blocks, real = [], components.label_components
    monkeypatch.setattr(components, "label_components", lambda *a: blocks.append(1) or real(*a))
    made = []
    for small in (1 << 15, 400, 0):
        blocks.clear()
        made.append({r.g: (r.b0, r.b1, r.b2) for r in components.betti_numbers(rows, ["g"], 4, small).collect()})
        assert bool(blocks) == (small < 1 << 15)
    assert made[0] == made[1] == made[2] and len(made[0]) == 42 and made[0][40] == (1, 0, 1) and made[0][None] == (1, 0, 0)


def test_every_point_finds_its_nearest(spark):
    points = spark.createDataFrame([("a", 1, 0, 0, 0), ("a", 2, 100, 0, 0), ("b", 3, 0, 0, 0), ("a", 4, None, 0, 0)], "case_id string, pid int, x int, y int, z int")
    targets = spark.createDataFrame([("a", 7, 1, 0, 0), ("a", 8, 5, 0, 0)], "case_id string, tid int, x int, y int, z int")
    got = {r.pid: (r.tid, r.dist) for r in surface.nearest_point(points, targets, ["case_id"], 2).collect()}
    assert got == {1: (7, 1.0), 2: (8, 95.0), 3: (None, None), 4: (None, None)}


def test_small_groups_find_their_nearest_in_one_join(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = lambda sizes: [(g, k, *map(int, draw.integers(0, 40, 3))) for g, n in sizes.items() for k in range(n)]
    asked, there = rows({"a": 9, "b": 9, "c": 2}), rows({"a": 5, "b": 30})
    points, targets = (spark.createDataFrame(r, f"case_id string, {i} int, x int, y int, z int") for r, i in ((asked, "pid"), (there, "tid")))
    near = lambda p: min(((sum((u - v) ** 2 for u, v in zip(p[2:], t[2:], strict=True)) ** 0.5, t[1]) for t in there if t[0] == p[0]), default=(None, None))
    want, cuts, real = {p[:2]: near(p) for p in asked}, [], surface.shared.cut
    monkeypatch.setattr(surface.shared, "cut", lambda df: cuts.append(1) or real(df))
    for limit in (256, 10):
        monkeypatch.setattr(surface, "FEW_TARGETS", limit)
        cuts.clear()
        assert {(r.case_id, r.pid): (r.dist, r.tid) for r in surface.nearest_point(points, targets, ["case_id"], 2).collect()} == want
        assert (len(cuts) == 1) == (limit == 256)


def test_exact_percentiles(spark):
    draw = np.random.default_rng(3)
    rows = [("a", float(v)) for v in np.append(draw.normal(size=500), [5.0] * 300)] + [("b", 2.0)] * 7 + [("c", None), (None, 1.0), (None, 4.0)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {(r.g, r.fraction): r.value for r in summary.percentiles(table, ["g"], "v", [0.005, 0.5, 0.95], bins=16).collect()}
    for g in ("a", "b", None):
        values_ = [v for k, v in rows if k == g and v is not None]
        assert [got[g, q] for q in (0.005, 0.5, 0.95)] == pytest.approx([np.percentile(values_, 100 * q) for q in (0.005, 0.5, 0.95)])
    assert len(got) == 9


def test_ranks_over_ranges(spark):
    rows = spark.range(5000).selectExpr("id * 7919 % 5003 AS k", "id % 3 AS g")
    got = selection.numbered(rows, [F.col("k")], ["g"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("k")
        assert part["_rank"].tolist() == list(range(1, len(part) + 1)) and set(part["_total"]) == {len(part)}
    assert selection.folds(spark.range(11), ["id"], 3, 1).groupBy("fold").count().orderBy("fold").toPandas()["count"].tolist() == [4, 4, 3]
    assert selection.numbered(spark.range(0), [F.col("id")]).count() == 0


def test_inheritance_finds_circles_and_gaps(spark):
    kind = "name string, inherits_from string, values map<string,string>"
    fine = spark.createDataFrame([("a", None, {"x": "1", "y": "1"}), ("b", "a", {"y": "2"}), ("c", "b", {})], kind)
    assert {r.name: r["values"] for r in catalogue.inherited(fine).collect()}["c"] == {"x": "1", "y": "2"}
    with pytest.raises(ValueError, match="circle"):
        catalogue.inherited(spark.createDataFrame([("a", "b", {}), ("b", "a", {})], kind))
    with pytest.raises(Exception, match="no configuration"):
        catalogue.inherited(spark.createDataFrame([("a", "zz", {"k": "v"})], kind)).collect()


def test_tables_go_to_files_and_back(spark, tmp_path):
    table = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "name string, n int")
    catalogue.write_csv(table, f"{tmp_path}/csv")
    catalogue.write_csv(table.limit(1), f"{tmp_path}/csv", append=True)
    assert manifest.read_csv(spark, f"{tmp_path}/csv", "name string, n int").count() == 3
    catalogue.write_json(table, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 3
    catalogue.write_lines(table.withColumnRenamed("name", "line"), f"{tmp_path}/text")
    assert sorted(r.line for r in manifest.lines(spark, f"{tmp_path}/text").collect()) == ["a", "b"]


def test_logs_have_no_gaps(spark):
    log = spark.createDataFrame([("k", 0, 1.0, 1), ("k", 0, 2.0, 2), ("k", 1, 3.0, 3)], "key string, epoch int, value double, ord int")
    assert sorted((r.epoch, r.value) for r in catalogue.logged(log).collect()) == [(0, 2.0), (1, 3.0)]
    with pytest.raises(Exception, match="epochs missing"):
        catalogue.logged(log.filter("epoch = 1")).collect()


def test_preprocess_and_export(spark):
    rows = [("1", x, y, z, float(x + y) if 1 <= x <= 4 else 0.0, int(x > 2)) for x in range(6) for y in range(4) for z in range(3)]
    table = spark.createDataFrame(rows, "case_id string, x int, y int, z int, value double, label int")
    image, labels = workflows.preprocess(table, (6, 4, 3), (1.0, 1.0, 4.0), (1.0, 1.0, 2.0))
    assert image.count() == labels.count() == 6 * 4 * 6  # the coarse axis comes first and is doubled
    assert labels.agg(F.max("x"), F.max("y"), F.max("z")).first() == (5, 5, 3) and {r.label for r in labels.select("label").distinct().collect()} == {0, 1}
    logits = spark.createDataFrame([("1", x, 0, 0, c, float(c == (x > 1))) for x in range(4) for c in range(2)], "case_id string, x int, y int, z int, channel int, value double")
    out = workflows.export_prediction(logits, (4, 1, 1), (8, 1, 1), (10, 0, 0), 2)
    assert sorted((r.x, r.label) for r in out.collect()) == [(10 + k, int(k >= 4)) for k in range(8)]


def test_postprocessing_is_determined_in_one_pass(spark):
    rows = [("1", k, 0, 0, 1 if k < 5 else 0, 1 if k < 5 or k == 9 else 0) for k in range(12)] + [("1", k, 3, 0, 2, 2 if k != 4 else 0) for k in range(8)]
    table = spark.createDataFrame(rows, "case_id string, x int, y int, z int, gt int, pred int")
    assert workflows.determine_postprocessing(table, [1, 2]) == [(1,)]
    done = workflows.keep_largest(table, (1,))
    assert done.filter("pred = 1").count() == 5


def test_ensembles_need_every_model(spark):
    rows = [("m0", "a", 0, 0, 0, [0.2, 0.8]), ("m1", "a", 0, 0, 0, [0.9, 0.1]), ("m0", "b", 0, 0, 0, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "model string, case_id string, x int, y int, z int, p array<double>")
    assert workflows.ensemble_folder(table.filter("case_id = 'a'"), 2).first().label == 0
    with pytest.raises(Exception, match="not all models"):
        workflows.ensemble_folder(table, 2).collect()
    with pytest.raises(Exception, match="in several folds"):
        workflows.ensemble_crossvalidation(table.filter("case_id = 'a'").withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))), 2).collect()


def test_otsu_parts_two_heaps(spark):
    rows = [("1", k, 0, 0, 0.1 + 0.01 * (k % 3)) for k in range(60)] + [("1", k, 1, 0, 0.8 + 0.01 * (k % 4)) for k in range(60)]
    table = spark.createDataFrame(rows, "case_id string, x int, y int, z int, p double")
    assert 0.11 < losses.otsu(table, ["case_id"], "p").first().threshold < 0.8
    assert workflows.thresholded(table, None, 50).count() == 60
    assert workflows.thresholded(table, 0.5, 61).count() == 0


def test_nrrd_and_orientation(spark, tmp_path):
    import gzip

    array = np.arange(24, dtype="<i2").reshape((2, 3, 4), order="F")
    head = b"NRRD0004\ntype: short\ndimension: 3\nsizes: 2 3 4\nencoding: gzip\nendian: little\nspace directions: (0,2,0) (-1,0,0) (0,0,3)\nspace origin: (5,0,1)\n\n"
    (tmp_path / "a.nrrd").write_bytes(head + gzip.compress(array.tobytes(order="F")))
    found, geometry = volumes.parse_nrrd((tmp_path / "a.nrrd").read_bytes())
    assert (found == array).all() and geometry["spacing"] == [2, 1, 3] and geometry["origin"] == [5, 0, 1]
    turned, new = volumes.to_ras(found, geometry)
    assert turned.shape == (3, 2, 4) and new["spacing"] == [1, 2, 3] and new["origin"] == [3, 0, 1] and np.allclose(np.reshape(new["direction"], (3, 3)), np.eye(3))
    assert (turned == np.flip(array.transpose(1, 0, 2), 0)).all()
    rows = volumes.read_voxels(spark, str(tmp_path), pattern="*.nrrd", ras=True)
    assert rows.filter("x = 2 AND y = 0 AND z = 1").first().value == array[0, 0, 1]


def test_images_archives_and_case_processing(spark, tmp_path):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    pixels = b"".join(b"\0" + bytes(row) for row in ([10, 20, 30], [40, 50, 60]))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(pixels)) + chunk(b"IEND", b"")
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.png").write_bytes(png)
    assert {(r.x, r.y): r.value for r in volumes.read_images(spark, str(tmp_path / "images")).collect()} == {(0, 0): 10, (1, 0): 20, (2, 0): 30, (0, 1): 40, (1, 1): 50, (2, 1): 60}
    (tmp_path / "npz").mkdir()
    np.savez(tmp_path / "npz" / "c.npz", data=np.ones((2, 2, 2)))
    first = volumes.unpack(spark, str(tmp_path / "npz"), str(tmp_path / "out"))
    assert first.count() == volumes.unpack(spark, str(tmp_path / "npz"), str(tmp_path / "out")).count() == 8
    np.save(tmp_path / "v.npy", np.arange(8.0).reshape(2, 2, 2))
    (row,) = volumes.process_cases(spark, str(tmp_path), lambda a: a > 3, "v.npy").collect()
    assert volumes.parse_meta(bytes(row.content))[0].sum() == 4


# -- ties, and the layout of the voxel view


def test_equal_scores_tie_whatever_the_order_of_sums(spark, monkeypatch):
    noisy = spark.createDataFrame([("a", 0.6), ("b", 0.6000000000000001)], "model string, score double")
    monkeypatch.setattr(workflows, "model_scores", lambda *_: noisy)
    order = spark.createDataFrame([("a", 0), ("b", 1)], "model string, ord int")
    assert workflows.best_model(None, order, (1,)).first().model == "a"


def test_equal_means_of_a_pair_go_to_the_first_class(spark):
    # 0.1 + 0.7 is less than 0.8 in doubles, 0.4 + 0.4 is not
    one, two = [0.2, 0.1, 0.4], [0.0, 0.7, 0.4]
    assert sum(x for x in (one[1], two[1])) < one[2] + two[2]
    made = spark.createDataFrame([(m, 1, 0, 0, 0, p) for m, p in (("a", one), ("b", two))], "model string, case_id int, x int, y int, z int, p array<double>")
    truth = spark.createDataFrame([(1, 0, 0, 0, 1)], "case_id int, x int, y int, z int, gt int")
    order = spark.createDataFrame([("b", 1), ("a", 0)], "model string, ord int")
    seen = []
    real, workflows.best_model = workflows.best_model, lambda c, *_, **__: seen.append(c)
    try:
        workflows.find_best_configuration(made, truth, order, (1, 2))
    finally:
        workflows.best_model = real
    assert {r.model: r.pred for r in seen[0].collect()}["a+b"] == 1


def test_voxels_are_dealt_by_case_and_stay_there(spark, monkeypatch):
    from tests.conftest import SMALL
    from voxmill.sources import tables

    monkeypatch.setattr(tables, "LINES", 500)
    cells = tables.voxels(spark, SMALL)
    assert cells.rdd.getNumPartitions() >= tables.read(spark, SMALL, "lineitem").count() / 500
    grown = surface.close(cells.filter("gt > 0").select("case_id", "x", "y", "z"), (7, 8, 8)).groupBy("case_id").count()
    assert grown._jdf.queryExecution().simpleString().count("Exchange") == 1
