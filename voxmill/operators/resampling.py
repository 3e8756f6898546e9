"""Resampling and smoothing of dense grids, one axis after another: lines along the axis meet in tasks that multiply many of them at once by a matrix of weights."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights below this share are left out of a cubic axis; cells by which its ends are continued.
SMALLEST, PADDED = 1e-9, 12
#: Lines that a task multiplies at a time.
LINES = 4_096
#: Cells of a box, old or new along each axis, up to which a case is resampled whole; cells of boxes that are resampled at once, and that a bin of cases gets on average.
SMALL_BOX, AT_ONCE, BIN_CELLS = 1 << 15, 1 << 20, 1 << 18


def _hat(t: np.ndarray, order: int) -> np.ndarray:
    """B-spline of order 1 or 3 at distance ``t``."""
    t = np.abs(t)
    if order == 1:
        return np.maximum(1 - t, 0)
    return np.where(t < 1, 2 / 3 - t**2 + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0))


def axis_weights(old: int, new: int, order: int) -> np.ndarray:
    """Matrix ``(new, old)`` that takes ``old`` cells along an axis to ``new`` ones: nearest (0), linear (1) or cubic spline (3).

    Cell centres are matched at the half, and the first and last cells continue beyond the ends.
    """
    at = (np.arange(new) + 0.5) * old / new - 0.5
    if order == 0:
        return (np.clip(np.floor(at + 0.5), 0, old - 1)[:, None] == np.arange(old)).astype(float)
    pad = PADDED if order == 3 else 1
    wide = old + 2 * pad
    basis = _hat(np.clip(at, -pad, old - 1 + pad)[:, None] + pad - np.arange(wide), order)
    if order == 3:  # the spline passes through the cells: solve for its coefficients, mirrored at the far ends
        knots = np.zeros((wide, wide))
        k = np.arange(wide)
        knots[k, k] = 4 / 6
        np.add.at(knots, (k, np.abs(k - 1)), 1 / 6)
        np.add.at(knots, (k, wide - 1 - np.abs(wide - 2 - k)), 1 / 6)
        basis = basis @ np.linalg.inv(knots)
    out = np.zeros((new, old))
    np.add.at(out.T, np.clip(np.arange(wide) - pad, 0, old - 1), basis.T)
    out[np.abs(out) < SMALLEST] = 0
    return out


def smoothing_weights(size: int, sigma: float, truncate: float = 4.0) -> np.ndarray:
    """Matrix of a Gaussian filter along an axis; cells are mirrored at the ends."""
    reach = int(truncate * sigma + 0.5)
    steps = np.arange(-reach, reach + 1)
    weight = np.exp(-0.5 * (steps / sigma) ** 2)
    weight /= weight.sum()
    out = np.zeros((size, size))
    for i in range(size):
        at = np.mod(i + steps, 2 * size)
        np.add.at(out[i], np.where(at < size, at, 2 * size - 1 - at), weight)
    return out


def _multiplied(cells: DataFrame, axis: str, keys: Sequence[str], value: str, old: Column, new: Column, matrix: Callable[[int, int], np.ndarray]) -> DataFrame:
    """``(*keys, axis, value)``: every line along an axis multiplied by the matrix of its lengths ``old`` and ``new``.

    Cells are sent once, to where their line meets; a task multiplies many lines at a time.
    """
    tasks = 8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cells.select(*keys, F.col(axis).cast("long").alias("_at"), F.col(value).cast("double").alias("_v"), old.cast("long").alias("_old"), new.cast("long").alias("_new"), F.xxhash64(*keys).alias("_line"))
    rows = rows.filter("_at >= 0 AND _at < _old").withColumn("_bin", F.pmod("_line", F.lit(tasks)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (a, b), some in part.groupby(["_old", "_new"]):
            weights = matrix(int(a), int(b))
            reached = (weights != 0).astype(np.float32)
            _, lead, line = np.unique(some["_line"].to_numpy(), return_index=True, return_inverse=True)
            at, v = some["_at"].to_numpy(), some["_v"].to_numpy()
            order = np.argsort(line, kind="stable")
            ends = np.searchsorted(line[order], np.arange(0, len(lead) + LINES, LINES))
            for k, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
                few = order[lo:hi]
                own, n = line[few] - k * LINES, min(LINES, len(lead) - k * LINES)
                dense, there = np.zeros((n, a)), np.zeros((n, a), np.float32)
                np.add.at(dense, (own, at[few]), v[few])
                there[own, at[few]] = 1
                i, j = np.nonzero(there @ reached.T)
                made = some[list(keys)].iloc[lead[k * LINES + i]].reset_index(drop=True)
                made[axis], made[value] = j, (dense @ weights.T)[i, j]
                out.append(made)
        return pd.concat(out)

    kinds = dict(cells.dtypes)
    return rows.groupBy("_bin").applyInPandas(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"{axis} long, `{value}` double"]))


def along(cells: DataFrame, axis: str, weights: np.ndarray, by: Sequence[str], value: str) -> DataFrame:
    """``cells(*by, x, y, z, value)`` with one axis multiplied by a matrix. Absent cells are zeros; new cells that no cell reaches are absent. Repeated cells add up."""
    keys = [*by, *[c for c in "xyz" if c != axis]]
    new, old = weights.shape
    return _multiplied(cells, axis, keys, value, F.lit(old), F.lit(new), lambda a, b: weights).select(*by, "x", "y", "z", value)


def _whole(cells: DataFrame, shapes: DataFrame, orders: Sequence[int], by: Sequence[str], value: str, case: str, size: float) -> DataFrame:
    """:func:`resample_each` of small boxes: cells meet the shapes of their cases in bins of cases; ``size`` is about the number of all cells."""
    bins = max(8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(size) // BIN_CELLS)
    told = F.xxhash64(case)
    binned = F.pmod(told, F.lit(bins)).alias("_bin")
    rows = cells.filter(F.col(case).isNotNull()).select(*by, *[F.col(c).cast("long").alias(f"_{c}") for c in "xyz"], F.col(value).cast("double").alias("_v"), told.alias("_case"), F.xxhash64(*by).alias("_group"), binned)
    known = shapes.filter(F.col(case).isNotNull()).select(told.alias("_case"), *[F.col(c)[k].cast("long").alias(f"{c}{k}") for c in ("old", "new") for k in range(3)], binned)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([*[left.schema.field(c) for c in by], *[pa.field(c, pa.int64()) for c in "xyz"], pa.field(value, pa.float64())])
        out = [schema.empty_table()]
        if not left.num_rows or not right.num_rows:
            return out[0]
        key, asked = right["_case"].to_numpy(), left["_case"].to_numpy()
        order = np.argsort(key)
        found = order[np.minimum(np.searchsorted(key[order], asked), len(key) - 1)]
        sizes = np.stack([right[f"{c}{k}"].to_numpy() for c in ("old", "new") for k in range(3)], 1)
        at, v = np.stack([left[f"_{c}"].to_numpy() for c in "xyz"], 1), left["_v"].to_numpy()
        inside = np.flatnonzero((key[found] == asked) & ((at >= 0) & (at < sizes[found][:, :3])).all(1))
        groups, at, v, found = left["_group"].to_numpy()[inside], at[inside], v[inside], found[inside]
        _, lead, group = np.unique(groups, return_index=True, return_inverse=True)
        own = sizes[found[lead]]  # of each group
        for shape in np.unique(own, axis=0):
            same = np.flatnonzero((own == shape).all(1))
            some = max(1, AT_ONCE // int(np.maximum(shape[:3], shape[3:]).prod()))
            for lo in range(0, len(same), some):
                few = same[lo : lo + some]
                place = np.full(len(lead), -1)
                place[few] = np.arange(len(few))
                hit = np.flatnonzero(place[group] >= 0)
                cell = (place[group[hit]], *at[hit].T)
                dense, there = np.zeros((len(few), *shape[:3])), np.zeros((len(few), *shape[:3]), np.float32)
                np.add.at(dense, cell, v[hit])
                there[cell] = 1
                for k, (a, b, order) in enumerate(zip(shape[:3].tolist(), shape[3:].tolist(), orders, strict=True)):
                    if a != b:
                        weights = axis_weights(a, b, order)
                        dense = np.moveaxis(np.tensordot(dense, weights, (k + 1, 1)), -1, k + 1)
                        there = (np.moveaxis(np.tensordot(there, (weights != 0).astype(np.float32), (k + 1, 1)), -1, k + 1) > 0).astype(np.float32)
                made = np.nonzero(there)
                names = left.select(list(by)).take(pa.array(inside[lead[few[made[0]]]]))
                out.append(pa.Table.from_arrays([*names.columns, *[pa.array(i) for i in made[1:]], pa.array(dense[made])], schema=schema))
        return pa.concat_tables(out)

    kinds = dict(cells.dtypes)
    done = rows.groupBy("_bin").cogroup(known.groupBy("_bin")).applyInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "x long, y long, z long", f"`{value}` double"]))
    return done.select(*by, "x", "y", "z", value)


def resample_each(cells: DataFrame, shapes: DataFrame, orders: Sequence[int] = (3, 3, 3), by: Sequence[str] = ("case_id",), value: str = "value", case: str = "case_id", small: int = SMALL_BOX) -> DataFrame:
    """As :func:`resample`, every case from its own shape to its own: ``shapes(case, old, new)`` are arrays of three.

    Cases whose box has up to ``small`` cells are resampled along all axes at once, many of them in a task, so that their cells are sent once; all others axis by axis.
    """
    box = F.lit(1.0)
    for k in range(3):
        box = box * F.greatest(F.col("old")[k], F.col("new")[k])
    facts = shapes.agg(F.max(box).alias("box"), F.sum(box).alias("cells")).first()
    if (facts.box or 0) <= small:
        return _whole(cells, shapes, orders, by, value, case, facts.cells or 0)
    few, many = shapes.filter(box <= small), shapes.filter(box > small)
    whole = _whole(cells, few, orders, by, value, case, facts.cells)
    shapes = many
    for k, (axis, order) in enumerate(zip("xyz", orders, strict=True)):
        keys = [*by, *[c for c in "xyz" if c != axis]]
        told = cells.join(shapes.select(F.col(case), F.col("old")[k].alias("_o"), F.col("new")[k].alias("_n")), case)
        cells = _multiplied(told, axis, keys, value, F.col("_o"), F.col("_n"), lambda a, b, order=order: np.eye(a) if a == b else axis_weights(a, b, order)).select(*by, "x", "y", "z", value)
    return whole.unionByName(cells)


def winning_labels(shares: DataFrame, by: Sequence[str], label: str = "label", share: str = "_share") -> DataFrame:
    """``(*by, x, y, z, label)`` of ``shares(*by, label, x, y, z, share)``: the highest label with half of a cell or more, else 0."""
    won = F.max(F.when(F.col(share) >= 0.5 - 1e-9, F.col(label)))
    return shares.groupBy(*by, "x", "y", "z").agg(F.coalesce(won, F.lit(0)).alias(label))


def resample(cells: DataFrame, old: Sequence[int], new: Sequence[int], orders: Sequence[int] = (3, 3, 3), by: Sequence[str] = ("case_id",), value: str = "value") -> DataFrame:
    """A dense grid on another one, with an order for each axis: ``(3, 3, 0)`` takes the nearest slice of a coarse third axis."""
    for axis, a, b, order in zip("xyz", old, new, orders, strict=True):
        if a != b:
            cells = along(cells, axis, axis_weights(a, b, order), by, value)
    return cells


def coarse_axis_orders(spacing: Sequence[float], order: int, limit: float = 3.0) -> tuple[int, ...]:
    """Orders for each axis: 0 on the one axis that is coarser than the others by more than ``limit`` times."""
    worst = max(spacing)
    alone = worst / min(spacing) > limit and sum(s == worst for s in spacing) == 1
    return tuple(0 if alone and s == worst else order for s in spacing)


def resample_labels(cells: DataFrame, old: Sequence[int], new: Sequence[int], orders: Sequence[int] = (1, 1, 1), by: Sequence[str] = ("case_id",), label: str = "label") -> DataFrame:
    """A dense label map on another grid: each label's share of a new cell is interpolated, and the highest label with half of it or more wins, else 0."""
    shares = resample(cells.select(*by, label, "x", "y", "z", F.lit(1.0).alias("_share")), old, new, orders, [*by, label], "_share")
    return winning_labels(shares, by, label)


def smooth(cells: DataFrame, shape: Sequence[int], sigma: float, by: Sequence[str] = ("case_id",), value: str = "value") -> DataFrame:
    """Gaussian smoothing of a grid whose absent cells are zeros."""
    for axis, size in zip("xyz", shape, strict=True):
        cells = along(cells, axis, smoothing_weights(size, sigma), by, value)
    return cells


def sample_points(points: DataFrame, cells: DataFrame, shape: Sequence[int], by: Sequence[str] = ("case_id",), value: str = "value") -> DataFrame:
    """``points(*by, pid, x, y, z)`` with the trilinear ``value`` of a dense grid there; beyond the border the border's value holds."""
    at = points
    for c, n in zip("xyz", shape, strict=True):
        p = F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(n - 1)))
        low = F.floor(p)
        near = F.array(F.struct(low.alias("i"), (1 - (p - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("i"), (p - low).alias("w")))
        at = at.withColumn(f"_{c}", F.explode(near))
    at = at.select(*by, "pid", *[F.col(f"_{c}.i").alias(c) for c in "xyz"], (F.col("_x.w") * F.col("_y.w") * F.col("_z.w")).alias("_w"))
    read = at.join(cells, [*by, "x", "y", "z"], "left").groupBy(*by, "pid").agg(F.sum(F.col("_w") * F.coalesce(F.col(value), F.lit(0.0))).alias(value))
    return points.join(read, [*by, "pid"], "left")


def reorient(cells: DataFrame, shape: dict[str, int], axes: str, flips: str = "") -> DataFrame:
    """Axes exchanged and mirrored: the new x, y, z are the old axes named in ``axes``; those in ``flips`` (old names) run backwards."""
    old = {c: F.lit(shape[c] - 1) - F.col(c) if c in flips else F.col(c) for c in "xyz"}
    return cells.withColumns({new: old[source] for new, source in zip("xyz", axes, strict=True)})
