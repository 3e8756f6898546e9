"""Tiles over a grid, their weighted merge, and ensembles of probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_starts(size: Column, tile: int, step: float) -> Column:
    """Starts of tiles that cover ``size`` cells, evenly spread, at most ``tile * step`` apart (halves to even)."""
    count = F.greatest(F.ceil((size - tile) / F.lit(float(tile * step))) + 1, F.lit(1)).cast("int")
    gap = F.when(count > 1, (size - tile) / (count - 1).cast("double")).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.bround(gap * k).cast("int"))


def tiles(shapes: DataFrame, tile: Sequence[int], step: float, key: str = "case_id") -> DataFrame:
    """``(key, x0, y0, z0)``: all tiles of each grid ``shapes(key, nx, ny, nz)``."""
    out = shapes
    for c, t in zip("xyz", tile, strict=True):
        out = out.withColumn(f"{c}0", F.explode(tile_starts(F.col(f"n{c}"), t, step)))
    return out.select(key, "x0", "y0", "z0")


def gaussian_weight(cell: Sequence[Column], tile: Sequence[int], scale: float = 0.125) -> Column:
    """Weight of a cell of a tile: a Gaussian around the centre with a deviation of ``scale`` tiles, 1 at the centre."""
    exponent = F.lit(0.0)
    for c, t in zip(cell, tile, strict=True):
        exponent = exponent + F.pow((c - t // 2) / F.lit(t * scale), F.lit(2.0))
    return F.exp(-0.5 * exponent)


def merge_tiles(predictions: DataFrame, by: Sequence[str] = ("case_id", "x", "y", "z"), value: str = "p", weight: str = "w") -> DataFrame:
    """Weighted mean over the tiles that cover a cell: one aggregate over their cells."""
    return predictions.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value))


def mean_vectors(rows: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """``(*by, vector)``: mean of each component over the models' rows. Averages probabilities or, of checkpoints, logits."""
    cells = rows.select(*by, F.posexplode(vector).alias("_k", "_v")).groupBy(*by, "_k").agg(F.avg("_v").alias("_v"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias(vector))


def flipped(cells: DataFrame, axes: Sequence[str], size: dict[str, int]) -> DataFrame:
    """Cells mirrored along the axes."""
    return cells.withColumns({c: F.lit(size[c] - 1) - F.col(c) for c in axes})


def mirror_average(predictions: DataFrame, axes: Sequence[str], size: dict[str, int], by: Sequence[str] = ("case_id", "x", "y", "z"), value: str = "p") -> DataFrame:
    """Mean over predictions made on each mirrored grid: ``predictions(*by, flip, value)``, ``flip`` being the mirrored axes as text."""
    back = {c: F.when(F.instr("flip", c) > 0, size[c] - 1 - F.col(c)).otherwise(F.col(c)) for c in axes}
    return predictions.withColumns(back).groupBy(*by).agg(F.avg(value).alias(value))


def resample_nearest(voxels: DataFrame, old: Sequence[int], new: Sequence[int], by: Sequence[str] = ("case_id",)) -> DataFrame:
    """A label map on another grid: each new cell takes the old cell that holds its centre.

    Runs of new cells that fall to an old one are computed, not joined: every old voxel explodes to its new cells.
    """
    out = voxels
    for c, a, b in zip("xyz", old, new, strict=True):
        ratio = a / b
        first = F.ceil(F.col(c) / F.lit(ratio) - 0.5).cast("int")
        last = (F.ceil((F.col(c) + 1) / F.lit(ratio) - 0.5) - 1).cast("int")
        out = out.filter(first <= last).withColumn(c, F.explode(F.sequence(first, last)))
    return out


def heat(points: DataFrame, radius: int, sigma: float, shape: Sequence[int], by: Sequence[str] = ("case_id",), peak: float = 200.0) -> DataFrame:
    """Heat map around points: ``peak * exp(-d / (2 sigma^2))`` with ``d`` the distance to the nearest point, within ``radius`` cells."""
    steps = [(a, b, c) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) for c in range(-radius, radius + 1)]
    around = F.explode(F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"), (F.col("z") + c).alias("z"), F.lit(float(a * a + b * b + c * c) ** 0.5).alias("d")) for a, b, c in steps]))
    cells = points.select(*by, around.alias("_c")).select(*by, "_c.*").filter((F.col("x").between(0, shape[0] - 1)) & F.col("y").between(0, shape[1] - 1) & F.col("z").between(0, shape[2] - 1))
    return cells.groupBy(*by, "x", "y", "z").agg(F.min("d").alias("d")).select(*by, "x", "y", "z", (F.lit(peak) * F.exp(-F.col("d") / (2 * sigma * sigma))).alias("heat"))
