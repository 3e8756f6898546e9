"""Morphology, surfaces and the distances between them."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import distance, shared

_SIX = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def _shifted(steps: Sequence[tuple[int, int, int]]) -> Column:
    return F.explode(F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), (F.col("z") + c).alias("z")) for a, b, c in steps]))


def border(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cells with a neighbour across a face that isn't in the mask; outside of the grid nothing is.

    Each cell tells its six neighbours of itself, so one grouped count replaces six self-joins.
    """
    key = [*by, "x", "y", "z"]
    told = cells.select(*by, _shifted(_SIX).alias("_s")).select(*by, "_s.*", F.lit(1).alias("n"), F.lit(0).alias("own"))
    rows = told.unionByName(cells.select(*key, F.lit(0).alias("n"), F.lit(1).alias("own")))
    return rows.groupBy(*key).agg(F.sum("n").alias("n"), F.max("own").alias("own")).filter("own = 1 AND n < 6").select(*key)


def _inside(shape: Sequence[int]) -> Column:
    return (F.col("x") >= 0) & (F.col("x") < shape[0]) & (F.col("y") >= 0) & (F.col("y") < shape[1]) & (F.col("z") >= 0) & (F.col("z") < shape[2])


def _spread(cells: DataFrame, by: Sequence[str], reach: int) -> DataFrame:
    """Cells within ``reach`` steps along any axis or diagonal. A cube is spread axis by axis: ``2 * reach + 1`` cells for each, three times."""
    out = cells.select(*by, "x", "y", "z")
    for c in "xyz":
        out = out.withColumn(c, F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))).distinct()
    return out


def dilate(cells: DataFrame, shape: Sequence[int], iterations: int = 1, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cells within ``iterations`` steps along any axis or diagonal, inside the grid."""
    return _spread(cells, by, iterations).filter(_inside(shape))


def erode(cells: DataFrame, iterations: int = 1, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cells whose whole neighbourhood of ``iterations`` steps is in the mask, which holds along each axis in turn."""
    out = cells.select(*by, "x", "y", "z").distinct()
    for c in "xyz":
        told = out.withColumn(c, F.explode(F.sequence(F.col(c) - iterations, F.col(c) + iterations)))
        out = told.groupBy(*by, "x", "y", "z").count().filter(F.col("count") == 2 * iterations + 1).drop("count")
    return out


def close(cells: DataFrame, shape: Sequence[int], iterations: int = 1, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Dilation, then erosion, on a grid widened so that its edge doesn't erode."""
    return erode(_spread(cells, by, iterations), iterations, by).filter(_inside(shape))


def bounding_box(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Smallest box of each group, upper bounds excluded."""
    return cells.groupBy(*by).agg(*[f(c).alias(f"{n}_{c}") if n == "low" else (f(c) + 1).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))])


def centroid(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Mean coordinates of each group."""
    return cells.groupBy(*by).agg(*[F.avg(c).alias(c) for c in "xyz"])


def crop_to_box(voxels: DataFrame, boxes: DataFrame, by: Sequence[str] = ("case_id",), margin: int = 0) -> DataFrame:
    """Voxels inside their group's box widened by ``margin``, with coordinates counted from its corner."""
    hit = F.lit(True)
    for c in "xyz":
        hit = hit & (F.col(c) >= F.col(f"low_{c}") - margin) & (F.col(c) < F.col(f"high_{c}") + margin)
    found = voxels.join(boxes, list(by)).filter(hit)
    return found.withColumns({c: F.col(c) - F.greatest(F.col(f"low_{c}") - margin, F.lit(0)) for c in "xyz"}).select(*voxels.columns)


def paste_back(voxels: DataFrame, boxes: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Coordinates counted from the box's corner, put back into the whole grid."""
    return voxels.join(boxes, list(by)).withColumns({c: F.col(c) + F.col(f"low_{c}") for c in "xyz"}).select(*voxels.columns)


def surface_distances(voxels: DataFrame, labels: Sequence[int], shape: Sequence[int], case: str = "case_id", spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """``(case, label, hd, hd95, msd)`` for every case and label of ``voxels(case, x, y, z, gt, pred)``.

    ``hd`` is the largest distance from a border cell of either mask to the other's border, ``hd95`` the 95th percentile
    of all of them (linear), ``msd`` their mean. Both masks empty: 0; one empty: the length of the grid's diagonal ``shape``.
    Distances are those of :func:`voxmill.operators.distance.squared_distances`, so no task holds a volume.
    """
    table = F.explode(F.array(*[F.lit(int(x)) for x in labels])).alias("label")
    sides = voxels.select(case, "x", "y", "z", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("gt").alias("label")), F.struct(F.lit(1).alias("side"), F.col("pred").alias("label")))).alias("_s"))
    sides = sides.select(case, F.col("_s.label").cast("int").alias("label"), F.col("_s.side").alias("side"), "x", "y", "z").filter(F.col("label").isin(*[int(x) for x in labels]))
    edge = shared.cut(border(sides, [case, "label", "side"]))
    far = distance.squared_distances(edge, edge.withColumn("side", 1 - F.col("side")), [case, "label", "side"], spacing)
    d, diagonal = F.sqrt("d2"), F.lit(float(np.linalg.norm(shape)))
    one = F.max(F.col("d2").isNull())
    found = far.groupBy(case, "label").agg(*[F.when(one, diagonal).otherwise(x).alias(c) for c, x in (("hd", F.max(d)), ("hd95", F.percentile(d, F.lit(0.95))), ("msd", F.avg(d)))])
    every = voxels.select(case).distinct().select(case, table)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return every.join(found, [case, "label"], "left").select(case, "label", zero("hd"), zero("hd95"), zero("msd"))


#: Targets up to which all of a group's are compared with each of its points.
FEW_TARGETS = 256


def nearest_point(points: DataFrame, targets: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """Each of ``points(*by, pid, x, y, z)`` with its nearest target ``(tid, dist)``; ties go to the smaller tid.

    In groups of up to :data:`FEW_TARGETS` targets every point meets all of them, in one join by group. In larger ones points and targets meet in cubes of edge ``cell``: a target goes to its cube and the 26 around it, so the join is by
    key. Points that find none within ``cell`` try again with cubes twice as wide, until all have one. Those whose group has no target, or that
    have a null coordinate, have nulls.
    """
    targets = targets.dropna(subset=["x", "y", "z"])
    counts = targets.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    dist = F.sqrt(sum(F.pow(F.col(c) - F.col(f"t{c}"), F.lit(2.0)) for c in "xyz"))
    nearest = lambda pairs: pairs.groupBy(*by, "pid").agg(F.min(F.struct("dist", "tid")).alias("b")).select(*by, "pid", F.col("b.tid").alias("tid"), F.col("b.dist").alias("dist"))
    few = counts.filter(F.col("_n") <= FEW_TARGETS).select(*by)
    told = targets.join(few, list(by), "left_semi").select(*by, "tid", *[F.col(c).alias(f"t{c}") for c in "xyz"])
    found = nearest(points.dropna(subset=["x", "y", "z"]).join(told, list(by)).withColumn("dist", dist).filter(~F.isnan("dist")))
    many = shared.cut(counts.filter(F.col("_n") > FEW_TARGETS).select(*by))
    if not many.limit(1).count():
        return points.join(found, [*by, "pid"], "left")
    targets = targets.join(many, list(by), "left_semi")
    left = points.join(many, list(by), "left_semi").dropna(subset=["x", "y", "z"])
    span = lambda t: [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))]
    ends = left.select("x", "y", "z").unionByName(targets.select("x", "y", "z")).agg(*span(left)).first()
    widest = max([0.0, *(float(ends[f"b{c}"]) - float(ends[f"a{c}"]) for c in "xyz" if ends[f"a{c}"] is not None)]) * 3**0.5
    size = float(cell)
    while True:
        cube = lambda c, shift=0, edge=size: F.floor(F.col(c) / edge) + shift
        around = F.explode(F.array(*[F.struct(*[cube(c, s).alias(f"_{c}") for c, s in zip("xyz", o, strict=True)]) for o in itertools.product((-1, 0, 1), repeat=3)]))
        right = targets.select(*by, "tid", *[F.col(c).alias(f"t{c}") for c in "xyz"], around.alias("_o")).select(*by, "tid", "tx", "ty", "tz", "_o.*")
        pairs = left.withColumns({f"_{c}": cube(c) for c in "xyz"}).join(right, [*by, "_x", "_y", "_z"]).withColumn("dist", dist).filter(F.col("dist") <= size)
        best = shared.cut(nearest(pairs))
        found = found.unionByName(best)
        if size >= widest:
            return points.join(found, [*by, "pid"], "left")
        left = shared.cut(left.join(best.select(*by, "pid"), [*by, "pid"], "left_anti"))
        if not left.limit(1).count():
            return points.join(found, [*by, "pid"], "left")
        size *= 2
