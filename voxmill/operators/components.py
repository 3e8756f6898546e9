"""Connected components and topology of label maps.

Blocks of a volume are labelled by themselves, in Arrow-fed tasks of many blocks; what touches across their borders is joined, and the pieces that belong together are found by
star rounds. So no task holds a volume. Everything after it is joins, aggregates and windows.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.operators import shared


def offsets(connectivity: int) -> list[tuple[int, int, int]]:
    """Half of the neighbourhood of 6 or 26 cells: each pair of neighbours once."""
    steps = [o for o in itertools.product((-1, 0, 1), repeat=3) if o > (0, 0, 0)]
    return [o for o in steps if sum(map(abs, o)) == 1] if connectivity == 6 else steps


def label_cells(cells: np.ndarray, connectivity: int) -> np.ndarray:
    """For each row of integer coordinates, the row of the first cell (in coordinate order) of its component."""
    if not len(cells):
        return np.zeros(0, np.int64)
    low = cells.min(0) - 1
    shape = cells.max(0) - low + 2
    code = np.ravel_multi_index((cells - low).T, shape)
    order = np.argsort(code, kind="stable")
    ranked = code[order]
    pairs = []
    for o in offsets(connectivity):
        near = ranked + int(np.dot(o, [shape[1] * shape[2], shape[2], 1]))
        at = np.minimum(np.searchsorted(ranked, near), len(ranked) - 1)
        hit = np.flatnonzero(ranked[at] == near)
        pairs.append(np.stack([hit, at[hit]], 1))
    a, b = np.concatenate(pairs).T
    root = np.arange(len(ranked))
    while True:  # hook the larger root to the smaller, then shorten the paths
        low_ab = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low_ab)
        np.minimum.at(new, root[b], low_ab)
        new = new[new]
        if (new == root).all():
            break
        root = new
    out = np.empty(len(cells), np.int64)
    out[order] = order[root]
    return out


_FACTS = ("component", "size", "place", "components")
#: Cells along an edge of a block; coordinates must be smaller than REACH in size, so that three of them fit in a long that keeps their order.
BLOCK, REACH = 64, 1 << 20


def _code(x: Column, y: Column, z: Column) -> Column:
    """A cell's coordinates in one long, in coordinate order."""
    place = lambda c: F.when(F.abs(c) < REACH, c + REACH).otherwise(F.raise_error(F.lit(f"coordinates must be smaller than {REACH}"))).cast("long")
    return F.shiftleft(place(x), 42) + F.shiftleft(place(y), 21) + place(z)


def _pieces(cells: pd.DataFrame, connectivity: int, block: int) -> pd.DataFrame:
    """``cells`` with ``piece``: the code of the first cell of their piece within their block; ``cells`` hold whole blocks, told apart by ``_group`` and ``_b``."""
    at = cells[["x", "y", "z"]].to_numpy(np.int64)
    number = np.unique(cells[["_group", "_b"]].to_numpy(np.int64), axis=0, return_inverse=True)[1]
    # blocks side by side along x, with a gap between them
    inside = at - np.floor_divide(at, block) * block
    inside[:, 0] += number.ravel() * (block + 1)
    root = label_cells(inside, connectivity)
    first = at[root] + REACH
    return cells.assign(piece=(first[:, 0] << 42) + (first[:, 1] << 21) + first[:, 2])


def label_components(voxels: DataFrame, by: Sequence[str] = ("case_id",), connectivity: int = 26, block: int = BLOCK) -> DataFrame:
    """``voxels(*by, x, y, z)`` of foreground cells with ``component, size, place, components``.

    ``component`` numbers a group's components from 0 by their first cells in coordinate order, ``size`` is its cells, ``place`` its rank from 1 by size (ties by
    number), and ``components`` how many the group has. All rules on components are filters over these, so a volume is labelled once.

    A group is cut into blocks of ``block`` cells along each edge. Each task labels some blocks; cells on the borders of blocks look for neighbours in the next one, which joins pieces
    (:func:`voxmill.operators.shared.connected`). Pieces, not cells, are summed and ranked. Groups of null keys are groups as well. Cells must be distinct.
    """
    code, corner = _code(F.col("x"), F.col("y"), F.col("z")), [F.floor(F.col(c) / block).cast("long") for c in "xyz"]
    rows = voxels.select(*by, "x", "y", "z", F.xxhash64(*by).alias("_group"), _code(*corner).alias("_b"))
    tasks = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = rows.withColumn("_bin", F.pmod(F.xxhash64("_group", "_b"), F.lit(8 * tasks)))
    kind = bins.drop("_bin").schema.simpleString()[7:-1] + ",piece:bigint"
    labelled = shared.cut(bins.groupBy("_bin").applyInPandas(lambda cells: _pieces(cells.drop(columns="_bin"), connectivity, block), kind))
    # cells that have a neighbour in another block: they tell those neighbours of themselves
    step = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"_d{c}") for c, d in zip("xyz", o, strict=True)]) for o in offsets(connectivity)])).alias("_o")
    edge = F.lit(False)
    for c in "xyz":
        edge = edge | (F.pmod(F.col(c), F.lit(block)) == 0) | (F.pmod(F.col(c), F.lit(block)) == block - 1)
    rim = labelled.filter(edge)
    moved = rim.select("_group", "_b", F.col("piece").alias("a"), *[F.col(c) for c in "xyz"], step).select("_group", "_b", "a", *[(F.col(c) + F.col(f"_o._d{c}")).alias(c) for c in "xyz"])
    told = moved.filter(F.col("_b") != _code(*corner)).select("_group", "a", code.alias("_at"))
    touching = told.join(rim.select("_group", F.col("piece").alias("b"), code.alias("_at")), ["_group", "_at"]).select("_group", "a", "b").distinct()
    pieces = labelled.groupBy("_group", "piece").agg(F.count(F.lit(1)).alias("_n"))
    edges = shared.cut(touching)
    if edges.limit(1).count():
        top = shared.connected(edges, ["_group"]).withColumnRenamed("node", "piece")
        pieces = pieces.join(top, ["_group", "piece"], "left").withColumn("top", F.coalesce("top", "piece"))
    else:
        pieces = pieces.withColumn("top", F.col("piece"))
    whole, every = pieces.groupBy("_group", "top").agg(F.sum("_n").alias("size")), W.partitionBy("_group")
    whole = whole.withColumns({"component": F.row_number().over(every.orderBy("top")).cast("long") - 1, "place": F.row_number().over(every.orderBy(F.desc("size"), "top")).cast("long"), "components": F.count(F.lit(1)).over(every)})
    facts = pieces.select("_group", "piece", "top").join(whole, ["_group", "top"]).select("_group", "piece", *_FACTS)
    return labelled.join(facts, ["_group", "piece"]).select(*by, "x", "y", "z", *_FACTS)


def component_sizes(labelled: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """``(*by, component, size, x, y, z)``: voxels and centroid of each component."""
    return labelled.groupBy(*by, "component").agg(F.first("size").alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def component_count(labelled: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Components of each group, and the size of the largest."""
    return labelled.groupBy(*by).agg(F.max("components").alias("components"), F.max("size").alias("largest"))


def keep_largest(labelled: DataFrame, k: int = 1, larger_than: int = 0, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Voxels of the ``k`` largest components of more than ``larger_than`` voxels; ties go to the first cell."""
    return labelled.filter((F.col("place") <= k) & (F.col("size") > larger_than))


def drop_small(labelled: DataFrame, threshold: int, by: Sequence[str] = ("case_id",), inclusive: bool = True) -> DataFrame:
    """Voxels of components above ``threshold``; of exactly that size they go too if ``inclusive``."""
    return labelled.filter(F.col("size") > threshold if inclusive else F.col("size") >= threshold)


def clean_up(labelled: DataFrame, expected: int, threshold: int, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Small components removed, except in cases that have exactly ``expected`` components."""
    return labelled.filter((F.col("components") == expected) | (F.col("size") > threshold))


def triage(labelled: DataFrame, expected: int = 2, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """``good`` for groups of exactly ``expected`` components, else ``bad``."""
    return component_count(labelled, by).select(*by, "components", F.when(F.col("components") == expected, "good").otherwise("bad").alias("verdict"))


#: Sizes that a component of each label must exceed; labels not listed have DEFAULT_LEAST.
LEAST_SIZE = {
    1: 10000, 2: 5000, 3: 500, 4: 500, 5: 1000, 6: 1000, 8: 2000, 9: 1000, 10: 500, 11: 500, 13: 1500, 14: 1500, 15: 1500, 21: 1500, 36: 1500, 37: 1500,
    42: 1500, 43: 1500, 46: 500, 47: 1500, 48: 3000,
}
DEFAULT_LEAST, ONLY_LARGEST = 1000, (7,)


def clean_by_label(labelled: DataFrame, least: Mapping[int, int] = LEAST_SIZE, default: int = DEFAULT_LEAST, only_largest: Sequence[int] = ONLY_LARGEST, by: Sequence[str] = ("case_id", "label")) -> DataFrame:
    """Components above their label's size stay; of labels in ``only_largest`` the largest alone. The last of ``by`` is the label."""
    label = F.col(by[-1])
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)) for p in least.items() for x in p]), label.cast("int")), F.lit(default))
    return labelled.filter(F.when(label.isin(*only_largest), F.col("place") == 1).otherwise(F.col("size") > limit))


def threshold_search(sizes: DataFrame, grid: Sequence[int], present: str = "present", size: str = "size") -> DataFrame:
    """``(first, last, mismatches)``: the first and last size limit with the fewest mismatches of presence.

    ``sizes`` has a row for each case: the voxels that were predicted and whether the class is really there.
    """
    at = F.explode(F.array(*[F.lit(int(t)) for t in grid])).alias("t")
    wrong = sizes.select(F.col(present).alias("p"), F.col(size).alias("s"), at).groupBy("t").agg(F.sum(((F.col("s") > F.col("t")) != F.col("p")).cast("long")).alias("n"))
    best = wrong.groupBy("n").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return best.agg(F.min(F.struct("n", "first", "last")).alias("b")).select("b.first", "b.last", F.col("b.n").alias("mismatches"))


def background(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """``(*by, x, y, z)`` of the cells of each group's box, widened by a cell, that aren't in ``cells``. Groups of null keys are groups as well.

    Boxes are written out plane by plane and line by line, so no task holds one.
    """
    ends = cells.groupBy(*by).agg(*[f(c).cast("long").alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    box = ends
    for c in "xyz":
        box = box.withColumn(c, F.explode(F.sequence(F.col(f"low_{c}") - 1, F.col(f"high_{c}") + 1)))
        if c == "x":  # few groups must not mean few tasks
            box = box.repartition(*by, "x")
    same = F.lit(True)
    for c in (*by, "x", "y", "z"):
        same = same & F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}"))
    return box.select(*by, "x", "y", "z").alias("b").join(cells.select(*by, "x", "y", "z").alias("f"), same, "left_anti")


def label_background(cells: DataFrame, by: Sequence[str] = ("case_id",), block: int = BLOCK) -> DataFrame:
    """:func:`label_components` of :func:`background` by faces: component 0 is the outside, as the first cell of the widened box is in it; all others are holes."""
    return label_components(background(cells, by), by, 6, block)


def _euler_of_blocks(cells: pd.DataFrame, block: int) -> pd.DataFrame:
    """Rows ``(_group, _euler)``: corners less edges plus faces less cells that the blocks own; ``cells`` hold whole blocks with what touches them from below."""
    out = []
    for (group, *corner), part in cells.groupby(["_group", "_bx", "_by", "_bz"], sort=False):
        at = part[["x", "y", "z"]].to_numpy(np.int64) - np.array(corner) * block + 1
        low, high = np.maximum(at.min(0) - 1, 0), np.minimum(at.max(0) + 1, block)
        grid = np.zeros(high - low + 1, bool)
        grid[tuple((at - low).T)] = True
        euler = 0
        for axes in itertools.product((0, 1), repeat=3):  # faces of each kind lie between two cells along the axes that are 0
            face = grid
            for axis, whole in enumerate(axes):
                line = np.moveaxis(face, axis, 0)
                face = np.moveaxis(line[1:] if whole else line[1:] | line[:-1], 0, axis)
            euler += (-1) ** sum(axes) * int(face.sum())
        out.append((group, euler))
    return pd.DataFrame(out, columns=["_group", "_euler"])


def euler_numbers(cells: DataFrame, by: Sequence[str] = ("case_id",), block: int = BLOCK) -> DataFrame:
    """``(_group, euler)`` of each group's cells as a union of closed cubes; ``_group`` is ``xxhash64(*by)``.

    Every corner, edge and face has one owner, the block of its place. A cell goes to its own block and, from a block's upper rim, to the blocks above, so only rims travel twice;
    a task counts some blocks, and the counts are summed.
    """
    rows = cells.select(F.xxhash64(*by).alias("_group"), *[F.col(c).cast("long").alias(c) for c in "xyz"])
    for c in "xyz":
        own, rim = F.floor(F.col(c) / block).cast("long"), F.pmod(F.col(c), F.lit(block)) == block - 1
        rows = rows.withColumn(f"_b{c}", F.explode(F.when(rim, F.array(own, own + 1)).otherwise(F.array(own))))
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = rows.withColumn("_bin", F.pmod(F.xxhash64("_group", "_bx", "_by", "_bz"), F.lit(8 * tasks)))
    counted = bins.groupBy("_bin").applyInPandas(lambda part: _euler_of_blocks(part, block), "_group bigint, _euler bigint")
    return counted.groupBy("_group").agg(F.sum("_euler").alias("euler"))


#: Cells of a widened box up to which a group is solved whole, of boxes that are solved at once, and rows that a bin of groups gets on average.
SMALL_BOX, AT_ONCE, BIN_ROWS = 1 << 15, 1 << 20, 1 << 17


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root of each of ``n`` cells of which the pairs ``a, b`` are connected."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(new := root[root], root):
            root = new
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _parts(grids: np.ndarray, steps: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """The components of each of ``grids(n, x, y, z)``."""
    at, pairs = np.arange(grids.size).reshape(grids.shape), []
    for o in steps:
        here = (slice(None), *(slice(max(-d, 0), n - max(d, 0)) for d, n in zip(o, grids.shape[1:], strict=True)))
        there = (slice(None), *(slice(max(d, 0), n - max(-d, 0)) for d, n in zip(o, grids.shape[1:], strict=True)))
        both = grids[here] & grids[there]
        pairs.append((at[here][both], at[there][both]))
    root = _joined(grids.size, *map(np.concatenate, zip(*pairs, strict=True)))
    return ((root == at.ravel()) & grids.ravel()).reshape(len(grids), -1).sum(1)


def _betti_of_boxes(grids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``b0, b2`` and the Euler number of each of ``grids(n, x, y, z)``, whose rims are empty."""
    euler = np.zeros(len(grids), np.int64)
    for axes in itertools.product((0, 1), repeat=3):  # as in :func:`_euler_of_blocks`
        face = grids
        for axis, whole in enumerate(axes, 1):
            line = np.moveaxis(face, axis, 0)
            face = np.moveaxis(line[1:] if whole else line[1:] | line[:-1], 0, axis)
        euler += (-1) ** sum(axes) * face.sum((1, 2, 3))
    return _parts(grids, offsets(26)), _parts(~grids, offsets(6)) - 1, euler


def _betti_of_bin(cells: pd.DataFrame) -> pd.DataFrame:
    """Rows ``(_group, b0, b2, euler)`` of whole groups of small boxes: those of about the same shape side by side."""
    cells = cells.sort_values("_group", kind="stable")
    groups, first = np.unique(cells["_group"].to_numpy(), return_index=True)
    at, number = cells[["x", "y", "z"]].to_numpy(np.int64), np.repeat(np.arange(len(groups)), np.diff(np.append(first, len(cells))))
    low, high = np.minimum.reduceat(at, first), np.maximum.reduceat(at, first)
    sizes = -(-(high - low + 3) // 4) * 4
    at = at - low[number] + 1
    out = []
    for size in np.unique(sizes, axis=0):
        same = np.flatnonzero((sizes == size).all(1))
        some = max(1, AT_ONCE // int(size.prod()))
        for k in range(0, len(same), some):
            few = same[k : k + some]
            place = np.full(len(groups), -1)
            place[few] = np.arange(len(few))
            hit = place[number] >= 0
            grids = np.zeros((len(few), *size), bool)
            grids[(place[number[hit]], *at[hit].T)] = True
            out.append(pd.DataFrame(dict(zip(("_group", "b0", "b2", "euler"), (groups[few], *_betti_of_boxes(grids)), strict=True))))
    return pd.concat(out)


def betti_numbers(voxels: DataFrame, by: Sequence[str] = ("case_id",), block: int = BLOCK, small: int = SMALL_BOX) -> DataFrame:
    """``(*by, b0, b1, b2)`` of the foreground cells of each group, as a union of closed unit cubes: 26-connected foreground, 6-connected background.

    Groups whose widened box has up to ``small`` cells are solved whole, many of them at once in a task. Components and cavities of all others are labelled in blocks. ``b1 = b0 + b2 - euler``.
    Cells must be distinct; groups without cells have no row, null keys are a group.
    """
    cells = shared.cut(voxels.select(*by, "x", "y", "z"))
    group = F.xxhash64(*by).alias("_group")
    box = F.lit(1.0)
    for c in "xyz":
        box = box * (F.max(c) - F.min(c) + 3)
    boxes = shared.cut(cells.groupBy(*by).agg(box.alias("_box"), F.count(F.lit(1)).alias("_n")).select(*by, group, "_box", "_n"))
    large = boxes.filter(F.col("_box") > small)
    facts = boxes.agg(F.sum("_n").alias("n"), F.max("_box").alias("box")).first()
    rows = cells.select(group, *[F.col(c).cast("long").alias(c) for c in "xyz"])
    if (facts.box or 0) > small:
        rows = rows.join(large.select("_group"), "_group", "left_anti")
    bins = max(8 * int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(facts.n or 0) // BIN_ROWS))
    solved = rows.groupBy(F.pmod("_group", F.lit(bins)).alias("_bin")).applyInPandas(_betti_of_bin, "_group long, b0 long, b2 long, euler long")
    solved = boxes.join(solved, "_group").select(*by, "b0", (F.col("b0") + F.col("b2") - F.col("euler")).alias("b1"), "b2")
    if (facts.box or 0) <= small:
        return solved
    cells = shared.cut(cells.withColumn("_group", group).join(large.select("_group"), "_group", "left_semi").select(*by, "x", "y", "z"))
    pieces = label_components(cells, by, 26, block).groupBy(group, *by).agg(F.max("components").alias("b0"))
    holes = label_background(cells, by, block).groupBy(group).agg((F.max("components") - 1).alias("b2"))
    both = pieces.join(holes, "_group").join(euler_numbers(cells, by, block), "_group")
    return solved.unionByName(both.select(*by, "b0", (F.col("b0") + F.col("b2") - F.col("euler")).alias("b1"), "b2"))


def betti_errors(gt: DataFrame, pred: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Absolute differences of b0 and b1; a side without cells counts as zeros."""
    both = gt.select(*by, F.col("b0").alias("g0"), F.col("b1").alias("g1")).join(pred.select(*by, F.col("b0").alias("p0"), F.col("b1").alias("p1")), list(by), "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(*by, F.abs(zero("g0") - zero("p0")).alias("b0_error"), F.abs(zero("g1") - zero("p1")).alias("b1_error"))


def merge_channels(masks: DataFrame, least: int, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """A label map of ``masks(*by, x, y, z, channel)``: channels of at least ``least`` voxels; the last channel wins a cell. Labels count from 1."""
    n = F.count(F.lit(1)).over(W.partitionBy(*by, "channel"))
    return masks.withColumn("_n", n).filter(F.col("_n") >= least).groupBy(*by, "x", "y", "z").agg((F.max("channel") + 1).alias("label"))


def select_label(label: str, *labels: int) -> Column:
    """Whether a voxel has one of the labels."""
    return F.col(label).isin(*labels)
