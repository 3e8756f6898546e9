"""Labelling across blocks, distances, skeletons, samples and resampling, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import topology
from voxmill.operators import components, distance, losses, resampling, selection, shapes, surface, values

_CELLS = "case_id long, x long, y long, z long"


def _first_of_component(cells, connectivity):
    """The first cell of each cell's component."""
    left, out = set(cells), {}
    steps = components.offsets(connectivity)
    steps = [*steps, *[tuple(-c for c in o) for o in steps]]
    for start in sorted(cells):
        if start in left:
            todo = [start]
            left.remove(start)
            while todo:
                at = todo.pop()
                out[at] = start
                for o in steps:
                    near = tuple(a + b for a, b in zip(at, o, strict=True))
                    if near in left:
                        left.remove(near)
                        todo.append(near)
    return out


@pytest.mark.parametrize(("connectivity", "block"), [(6, 3), (26, 3), (26, 64)])
def test_labels_do_not_depend_on_blocks(spark, connectivity, block):
    draw = random.Random(1)
    rows = [(case, x, y, z) for case in (1, 2, None) for x in range(-6, 8) for y in range(-3, 7) for z in range(7) if draw.random() < (0.3 if case == 2 else 0.12)]
    got = components.label_components(spark.createDataFrame(rows, _CELLS), connectivity=connectivity, block=block).collect()
    assert len(got) == len(rows)
    for case in (1, 2, None):
        want = _first_of_component([r[1:] for r in rows if r[0] == case], connectivity)
        size, tops = Counter(want.values()), sorted(set(want.values()))
        place = {t: k for k, t in enumerate(sorted(tops, key=lambda t: (-size[t], t)), 1)}
        found = {(r.x, r.y, r.z): (r.component, r.size, r.place, r.components) for r in got if r.case_id == case}
        assert found == {c: (tops.index(t), size[t], place[t], len(tops)) for c, t in want.items()}


def test_one_component_through_all_blocks(spark):
    """A line that turns through 40 blocks, and a cell apart."""
    line = [(x, 0, 0) for x in range(60)] + [(59, y, 0) for y in range(1, 60)] + [(x, 59, 0) for x in range(59)] + [(0, 59, z) for z in range(1, 40)]
    table = spark.createDataFrame([(1, *c) for c in [*line, (0, 0, 39)]], _CELLS)
    got = components.component_count(components.label_components(table, connectivity=6, block=5)).first()
    assert (got.components, got.largest) == (2, len(line))


def test_lower_envelope():
    rng = np.random.default_rng(0)
    for n, lines, step in ((1, 3, 1), (7, 50, 1), (40, 200, 2.5), (5, 4, 0.5)):
        heights = np.where(rng.random((n, lines)) < 0.5, np.inf, rng.integers(0, 60, (n, lines)).astype(float))
        heights[:, 0] = np.inf
        at = np.arange(-3, n + 4)
        want = (heights[None] + (((np.arange(n)[None] - at[:, None]) * step) ** 2)[:, :, None]).min(1)
        assert np.allclose(np.nan_to_num(distance.lower_envelope(heights, step, at), posinf=-1), np.nan_to_num(want, posinf=-1))


@pytest.mark.parametrize(("spacing", "tile", "few"), [((1, 1, 1), 8, 0), ((2.0, 0.5, 1.5), 32, 1 << 13)])
def test_distances_are_exact(spark, monkeypatch, spacing, tile, few):
    monkeypatch.setattr(distance, "FEW", few)
    draw = random.Random(2)
    sites = [(c, draw.randint(-5, 60), draw.randint(0, 50), draw.randint(3, 40)) for c in (1, 2) for _ in range(60)]
    queries = [(c, draw.randint(-20, 50), draw.randint(-10, 70), draw.randint(0, 60)) for c in (1, 2, 3) for _ in range(200)]
    queries += queries[:3]
    got = distance.squared_distances(spark.createDataFrame(queries, _CELLS), spark.createDataFrame(sites, _CELLS), spacing=spacing, tile=tile).collect()
    assert len(got) == len(queries)
    for r in got:
        want = min((sum(((a - b) * s) ** 2 for a, b, s in zip((r.x, r.y, r.z), t[1:], spacing, strict=True)) for t in sites if t[0] == r.case_id), default=None)
        assert r.d2 is None if want is None else r.d2 == pytest.approx(want)


def test_surfaces_respect_spacing(spark):
    table = spark.createDataFrame([(1, 0, 0, 0, 1, 0), (1, 0, 3, 0, 0, 1), (2, 0, 0, 0, 1, 0)], "case_id long, x long, y long, z long, gt int, pred int")
    got = {(r.case_id, r.label): (r.hd, r.hd95, r.msd) for r in surface.surface_distances(table, [1, 2], (3, 4, 12), spacing=(1, 0.5, 1)).collect()}
    assert got == {(1, 1): (1.5, 1.5, 1.5), (1, 2): (0, 0, 0), (2, 1): (13, 13, 13), (2, 2): (0, 0, 0)}


def test_thinning_keeps_the_topology():
    rng = np.random.default_rng(1)
    for density in (0.05, 0.3, 0.6, 0.9) * 4:
        grid = np.zeros((12, 13, 11), bool)
        grid[1:-1, 1:-1, 1:-1] = rng.random((10, 11, 9)) < density
        thin = shapes.thinned(grid)
        assert topology.betti(np.argwhere(thin)) == topology.betti(np.argwhere(grid)) and not (thin & ~grid).any()


def test_centre_lines_of_empty_masks(spark):
    some, none = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1)], _CELLS), spark.createDataFrame([], _CELLS)
    assert [tuple(r) for r in shapes.centre_line_dice(some, none).collect()] == [(1, 1.0, 0.0, 0.0)]
    assert [tuple(r) for r in shapes.centre_line_dice(none, some).collect()] == [(1, 0.0, 1.0, 0.0)]
    assert shapes.centre_line_dice(none, none).count() == 0


def test_soft_skeletons_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(5)
    grid = rng.random((9, 8, 7))
    grid[rng.random(grid.shape) < 0.1] = np.nan
    rows = [(1, *map(int, at), float(v)) for at, v in np.ndenumerate(grid) if not np.isnan(v)]
    got = losses.soft_skeleton(spark.createDataFrame(rows, _CELLS + ", value double"), ["case_id"], iterations=2, block=4).collect()
    want = losses.soft_skeleton_of(grid, 2)
    assert len(got) == len(rows) and all(r.skeleton == pytest.approx(want[r.x, r.y, r.z]) for r in got)


def test_losses_of_perfect_and_empty_predictions(spark):
    cells = [(1, 1, x, y, 0, float(x < 2), int(x < 2)) for x in range(5) for y in range(4)] + [(2, 1, x, 0, 0, 0.0, 0) for x in range(3)]
    table = spark.createDataFrame(cells, "case_id long, label int, x long, y long, z long, p double, y01 int")
    assert {r.case_id: r.loss for r in losses.hausdorff_loss(table, "case_id", "label").collect()} == {1: 0.0, 2: 0.0}
    assert all(r.loss == pytest.approx(-0.5) for r in losses.soft_centre_line_loss(table, "case_id", "label", iterations=1).collect())


def test_local_contrast_of_flat_slices(spark):
    flat = [(1, 0, y, z, 3.0) for y in range(8) for z in range(8)] + [(1, 1, y, z, float(y + z)) for y in range(8) for z in range(8)]
    got = values.equalize_locally(spark.createDataFrame(flat, _CELLS + ", value double"), ["case_id", "x"], (8, 8), (2, 2), 16, 0.5).collect()
    assert len(got) == 128 and all(r.value == 3.0 for r in got if r.x == 0)
    ramp = {(r.y, r.z): r.value for r in got if r.x == 1}
    assert 0 <= min(ramp.values()) and max(ramp.values()) <= 1 + 1e-9
    # cells before the middles of the first tiles follow that tile alone
    assert ramp[0, 0] < ramp[0, 1] == ramp[1, 0] < ramp[1, 1]


def test_local_contrast_of_small_slices_is_that_of_tables(spark):
    draw = np.random.default_rng(12)
    rows = [(c, x, y, z, None if draw.random() < 0.03 else float(draw.integers(0, 30)), f"{y}") for c in (2**60 + 1, None) for x in range(3) for y in range(9) for z in range(7) if draw.random() < 0.5 and (x or y < 5)]
    table = spark.createDataFrame(rows, _CELLS + ", value double, note string").na.fill(0, ["case_id"])
    made = []
    for small in (1 << 15, 0):
        out = values.equalize_locally(table, ["case_id", "x"], (9, 7), (3, 2), 8, 0.2, small=small)
        assert ("FlatMapGroupsInArrow" in out._jdf.queryExecution().simpleString()) == (small > 0)
        made.append({(r.case_id, r.x, r.y, r.z, r.note): r.value for r in out.collect()})
    assert made[0].keys() == made[1].keys() and len(made[0]) == len(rows)
    assert all(made[0][k] == (v if v is None else pytest.approx(v, abs=1e-9)) for k, v in made[1].items())


def test_first_rows_of_groups_are_those_of_the_order(spark):
    rows = [(k % 3 if k % 10 else None, k) for k in range(20_000)]
    table = spark.createDataFrame(rows, "g int, k long")
    order = selection.hash_order("k", seed=1)
    got = selection.first_of_each(table, ["g"], order, [F.col("k")], F.floor(F.col("_total") * 0.37))
    ranked = got.withColumn("_o", order).toPandas()
    for g in (0, 1, 2, None):
        part = ranked[ranked["g"].isna() if g is None else ranked["g"] == g].sort_values(["_o", "k"])
        n = int(len(part) * 0.37)
        assert part["_kept"].tolist() == [True] * n + [False] * (len(part) - n)
    assert selection.first_of_each(table.limit(0), ["g"], order, [F.col("k")], F.lit(5)).count() == 0


def test_cases_of_their_own_shapes(spark):
    rng = np.random.default_rng(2)
    volumes = {1: rng.random((4, 5, 6)), 2: rng.random((3, 5, 7)), 3: rng.random((4, 5, 6))}
    shapes_ = {1: (8, 5, 3), 2: (2, 6, 7), 3: (4, 5, 9)}
    rows = [(c, *map(int, at), float(v)) for c, v0 in volumes.items() for at, v in np.ndenumerate(v0)]
    table = spark.createDataFrame(rows, _CELLS + ", value double")
    known = spark.createDataFrame([(c, list(v.shape), list(shapes_[c])) for c, v in volumes.items()], "case_id long, old array<int>, new array<int>")
    got = {k: np.full(s, np.nan) for k, s in shapes_.items()}
    for r in resampling.resample_each(table, known, (3, 1, 0)).collect():
        got[r.case_id][r.x, r.y, r.z] = r.value
    for c, v in volumes.items():
        axes = [np.eye(a) if a == b else resampling.axis_weights(a, b, order) for a, b, order in zip(v.shape, shapes_[c], (3, 1, 0), strict=True)]
        assert np.allclose(got[c], np.einsum("ax,by,cz,xyz->abc", *axes, v))


def test_small_cases_are_resampled_whole_as_by_axes(spark, monkeypatch):
    draw = np.random.default_rng(7)
    sizes = {2**60 + k: (tuple(map(int, draw.integers(2, 7, 3))), tuple(map(int, draw.integers(1, 9, 3)))) for k in range(12)}
    rows = [(c, *map(int, at), float(draw.random())) for c, (old, _) in sizes.items() for at in np.ndindex(*old) if draw.random() < 0.4] + [(None, 0, 0, 0, 1.0)]
    rows += [rows[0], (2**60, 50, 0, 0, 1.0)]
    table = spark.createDataFrame(rows, _CELLS + ", value double")
    known = spark.createDataFrame([(c, list(a), list(b)) for c, (a, b) in sizes.items()], "case_id long, old array<int>, new array<int>")
    sent, real = [], resampling._multiplied
    monkeypatch.setattr(resampling, "_multiplied", lambda *a: sent.append(1) or real(*a))
    made = []
    for small in (1 << 15, 120, 0):
        sent.clear()
        made.append({(r.case_id, r.x, r.y, r.z): r.value for r in resampling.resample_each(table, known, (3, 1, 0), small=small).collect()})
        assert bool(sent) == (small < 1 << 15)
    assert made[0].keys() == made[1].keys() == made[2].keys() and all(made[k][c] == pytest.approx(v, abs=1e-9) for k in (1, 2) for c, v in made[0].items())


def test_small_masks_are_thinned_side_by_side(spark, monkeypatch):
    draw = np.random.default_rng(5)
    grids = {k: draw.random(tuple(draw.integers(3, 9, 3))) < 0.7 for k in range(12)}
    rows = [(k, *map(int, at)) for k, g in grids.items() for at in np.argwhere(g)]
    real = shapes.thinned
    acc = spark.sparkContext.accumulator(0)

    def counted(grid):
        acc.add(1)
        return real(grid)

    cells = spark.createDataFrame(rows, _CELLS)
    got = shapes._per_group(cells.coalesce(1), ["case_id"], counted).collect()
    want = {(k, *map(int, at + g0 - 1)) for k, g in grids.items() for g0 in [np.argwhere(g).min(0)] for at in np.argwhere(real(np.pad(g[tuple(slice(a, b + 1) for a, b in zip(np.argwhere(g).min(0), np.argwhere(g).max(0), strict=True))], 1)))}
    assert {tuple(r) for r in got} == want and acc.value < len(grids)


def test_soft_skeletons_send_nothing_beyond_the_cells(spark):
    rows = [(1, x, y, z, 0.5, 1.0) for x in range(3) for y in range(3) for z in range(3)]
    cells = spark.createDataFrame(rows, "case_id long, x long, y long, z long, p double, y01 double")
    sent = losses.soft_skeletons(cells, ["case_id"], ["p", "y01"], 2)
    assert sent.count() == 27 and "FlatMapGroupsInPandas" in sent._jdf.queryExecution().simpleString()
    both = {(r.x, r.y, r.z): r.skeleton for r in losses.soft_skeleton(cells, ["case_id"], "p", 2).collect()}
    assert both == {(r.x, r.y, r.z): r.skeleton_p for r in sent.collect()}


def test_small_boxes_are_solved_whole_and_agree_with_planes(spark, monkeypatch):
    draw = random.Random(8)
    far = {1: 9, 2: 7, 3: 90}
    cells = lambda n: [(g, *(draw.randrange(w) - 3 for _ in "xyz")) for g, w in far.items() for _ in range(n)]
    asked, sites = cells(30) + [(4, 0, 0, 0)], cells(12)
    asked, sites = asked + asked[:3], sites
    frames = [spark.createDataFrame(rows, _CELLS) for rows in (asked, sites)]
    real, planes = distance._of_planes, []
    monkeypatch.setattr(distance, "_of_planes", lambda *a: planes.append(a[2]) or real(*a))
    got = distance.squared_distances(*frames, ["case_id"], (1, 2, 3)).collect()
    assert len(got) == len(asked) and planes[0].count() == 1
    for r in got:
        near = [(r.x - x) ** 2 + 4 * (r.y - y) ** 2 + 9 * (r.z - z) ** 2 for g, x, y, z in sites if g == r.case_id]
        assert r.d2 == (min(near) if near else None)


def _hausdorff_by_hand(cells, spacing, alpha, most):
    """The loss of each case of ``(case, label, x, y, z, p, y)``, a pair of cells at a time."""
    near = lambda a, others: min((sum(((s - t) * w) ** 2 for s, t, w in zip(a[2:5], b[2:5], spacing, strict=True)) for b in others), default=0) ** 0.5
    weights = {}
    for a in cells:
        same = [b for b in cells if b[:2] == a[:2] and None not in b[2:5]]
        fg = bg = 0.0
        for m, on in ((5, True), (6, False)):
            if None in a[2:5] or a[m] is None:
                continue
            inside = a[m] > 0.5
            w = min(near(a, [b for b in same if b[m] is not None and (b[m] > 0.5) != inside]), most) ** alpha
            fg, bg = (fg + w, bg) if inside == on else (fg, bg + w)
        weights.setdefault(a[0], []).append((None if a[5] is None or a[6] is None else (a[5] - a[6]) ** 2, fg, bg))
    out = {}
    for case, rows in weights.items():
        means = [sum(e * r[k] for e, *r in rows if e is not None and r[k]) / n if (n := sum(e is not None and r[k] != 0 for e, *r in rows)) else None for k in (0, 1)]
        out[case] = 0.0 if None in means else 0.5 * sum(means)
    return out


@pytest.mark.parametrize(("edge", "batch"), [(32, 7), (6, 7), (6, 10_000), (2, 10_000)])
def test_hausdorff_losses_of_small_and_large_boxes(spark, monkeypatch, edge, batch):
    monkeypatch.setattr(distance, "EDGE", edge)
    draw = random.Random(4)
    cells = []
    for case in ("a", "b", None, "c"):
        for label, wide in ((1, 4), (2, 7), (3, 5)):
            at = {tuple(draw.randrange(wide) - 2 for _ in "xyz") for _ in range(25)} | ({(-40, 30, 9)} if (case, label) == ("c", 3) else set())
            cells += [(case, label, *c, draw.choice([0.1, 0.3, 0.7, 0.9, None]), draw.choice([0, 1, 1, None] if label == 1 else [0, 1])) for c in sorted(at)]
    cells += [("d", 1, None, 0, 0, 0.5, 1), ("e", 1, 0, 0, 0, 0.9, 1)]
    table = spark.createDataFrame(cells, "case_id string, label int, x long, y long, z long, p double, y01 int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.case_id: r.loss for r in losses.hausdorff_loss(table, "case_id", "label", most=3.0, spacing=(1, 2, 0.5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _hausdorff_by_hand(cells, (1, 2, 0.5), 2.0, 3.0)
    assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)


def test_hausdorff_losses_send_each_line_once(spark):
    from tests.conftest import SMALL
    from voxmill.plans import fields

    store = spark.sparkContext._jsc.sc().statusStore()

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = sent()
    assert fields.hausdorff_losses(spark, SMALL).collect()
    assert 0 < sent() - before < 25 * spark.read.parquet(f"{SMALL}/lineitem.parquet").count()
