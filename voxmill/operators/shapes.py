"""Holes, skeletons and centre lines of masks. Holes are background labelled in blocks; thinning is iterative within a volume, so there a volume is in one task, small ones many at a time. What follows is joins and aggregates."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.operators import surface
from voxmill.operators.components import label_background

#: The 26 neighbours of a cell.
_RING = [o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)]


#: Cells up to which a mask is thinned side by side with others, and cells of the grid that holds them.
SMALL, SIDE_BY_SIDE = 1 << 15, 1 << 22


def _batches(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of boxes of ``sizes[k]`` that are held at once: as many as fit, one at least."""
    order, lo = np.lexsort(sizes.T), 0
    while lo < len(order):
        wide, total, hi = np.zeros(3, np.int64), 0, lo
        while hi < len(order):
            wide, total = np.maximum(wide, sizes[order[hi]]), total + int(sizes[order[hi]][0])
            if hi > lo and total * wide[1] * wide[2] > SIDE_BY_SIDE:
                break
            hi += 1
        yield order[lo:hi]
        lo = hi


def _per_group(cells: DataFrame, by: Sequence[str], make) -> DataFrame:
    """``(*by, x, y, z)`` of the mask that ``make`` makes of each group's mask.

    ``make`` gets masks on their boxes widened by a cell, many small ones side by side in one grid: each begins at an even place, so that what goes by the parity of places finds them as
    it finds a mask alone. Masks of more than ``SMALL`` cells are a group of their own.
    """
    rows = cells.select(*by, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"))
    tasks = 8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumns({"_group": F.xxhash64(*by), "_n": F.count(F.lit(1)).over(W.partitionBy(*by))})
    named = named.withColumn("_bin", F.when(F.col("_n") <= SMALL, F.pmod("_group", F.lit(tasks))).otherwise(F.col("_group"))).drop("_n")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_group", kind="stable")
        group, at = part["_group"].to_numpy(), part[["x", "y", "z"]].to_numpy(np.int64)
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(part))))
        low = np.minimum.reduceat(at, first) - 1
        sizes = np.maximum.reduceat(at, first) - low + 2
        sizes[:, 0] += sizes[:, 0] % 2
        out = []
        for some in _batches(sizes):
            start = np.cumsum(sizes[some, 0]) - sizes[some, 0]
            shift = np.full(len(first), -1)
            shift[some] = start
            here = shift[number] >= 0
            grid = np.zeros((sizes[some, 0].sum(), *sizes[some, 1:].max(0)), bool)
            own = at[here] - low[number[here]]
            grid[own[:, 0] + shift[number[here]], own[:, 1], own[:, 2]] = True
            kept = np.argwhere(make(grid))
            which = np.searchsorted(start, kept[:, 0], "right") - 1
            kept[:, 0] -= start[which]
            kept += low[some[which]]
            found = part[list(by)].iloc[first[some[which]]].reset_index(drop=True)
            out.append(found.assign(x=kept[:, 0], y=kept[:, 1], z=kept[:, 2]))
        return pd.concat(out)

    return named.groupBy("_bin").applyInPandas(run, rows.schema)


def fill_holes(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cells of each mask and of the holes inside it: background that no path of faces connects with the outside, labelled in blocks. Cells must be distinct."""
    whole = cells.select(*by, *[F.col(c).cast("long").alias(c) for c in "xyz"])
    return whole.unionByName(label_background(whole, by).filter("component > 0").select(*by, "x", "y", "z"))


def crop_to_nonzero(voxels: DataFrame, value: str, label: str, by: Sequence[str] = ("case_id",), outside: int = -1) -> DataFrame:
    """``voxels(*by, x, y, z, value, label)`` cropped to the box of the filled mask of nonzero values; background outside of the mask becomes ``outside``."""
    mask = fill_holes(voxels.filter(F.col(value) != 0).select(*by, "x", "y", "z"), by).withColumn("_in", F.lit(True))
    kept = surface.crop_to_box(voxels.join(mask, [*by, "x", "y", "z"], "left"), surface.bounding_box(mask, by), by)
    return kept.withColumn(label, F.when(F.col("_in").isNull() & (F.col(label) == 0), F.lit(outside)).otherwise(F.col(label))).drop("_in")


def _euler(cubes: np.ndarray) -> np.ndarray:
    """Euler numbers of blocks of cells ``cubes[k]``, each as a union of closed cubes."""
    total = np.zeros(len(cubes), np.int64)
    for axes in itertools.product((0, 1), repeat=3):
        face = cubes
        for axis, whole in enumerate(axes, 1):
            if not whole:
                wide = np.pad(face, [(1, 1) if k == axis else (0, 0) for k in range(4)])
                face = np.delete(wide, 0, axis) | np.delete(wide, -1, axis)
        total += (-1) ** sum(axes) * face.sum((1, 2, 3))
    return total


#: For each of the 26 neighbours of a cell, in the order of their bits, the mask of those of them that touch it.
_TOUCH = np.array([sum(1 << j for j, p in enumerate(_RING) if p != o and max(abs(a - b) for a, b in zip(o, p, strict=True)) == 1) for o in _RING], np.int32)


def simple(codes: np.ndarray) -> np.ndarray:
    """Whether cells whose neighbours are the bits of ``codes`` can go without changing the topology: the neighbours are one piece, and the Euler number is kept."""
    reached = codes & -codes
    while True:  # the piece of the lowest neighbour grows until it stays as it is
        more = reached.copy()
        for j in range(26):
            more |= np.where(reached >> j & 1 == 1, _TOUCH[j], 0)
        more &= codes
        if (more == reached).all():
            break
        reached = more
    cubes = np.zeros((len(codes), 27), bool)
    cubes[:, [9 * (a + 1) + 3 * (b + 1) + c + 1 for a, b, c in _RING]] = codes[:, None] >> np.arange(26) & 1
    cubes = cubes.reshape(-1, 3, 3, 3)
    full = cubes.copy()
    full[:, 1, 1, 1] = True
    return (codes != 0) & (reached == codes) & (_euler(full) == _euler(cubes))


class _Known:
    """What :func:`simple` found for the neighbourhoods met so far, as a sorted table."""

    def __init__(self):
        self.codes, self.answers = np.zeros(0, np.int32), np.zeros(0, bool)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        asked, which = np.unique(codes, return_inverse=True)
        new = np.setdiff1d(asked, self.codes, assume_unique=True)
        if len(new):
            every = np.concatenate([self.codes, new])
            order = np.argsort(every)
            self.codes, self.answers = every[order], np.concatenate([self.answers, simple(new)])[order]
        return self.answers[np.searchsorted(self.codes, asked)][which]


_KNOWN = _Known()


def thinned(grid: np.ndarray) -> np.ndarray:
    """The skeleton of a mask whose rim is empty: border cells are peeled off, direction by direction, unless that changes the topology or they end a line.

    The candidates of a direction are found at once; they go in eight subfields, those of even and odd coordinates: no two cells of one touch, so all that are still simple when their
    subfield's turn comes go together. Neighbourhoods are looked up in a table.
    """
    flat = np.ascontiguousarray(grid).ravel().copy()
    strides = np.array([grid.shape[1] * grid.shape[2], grid.shape[2], 1])
    ring = np.array(_RING) @ strides

    def codes(cells: np.ndarray) -> np.ndarray:
        return (flat[cells[:, None] + ring].astype(np.int32) << np.arange(26, dtype=np.int32)).sum(1, dtype=np.int32)

    gone = 1
    while gone:
        gone = 0
        for axis, step in ((1, 1), (1, -1), (0, -1), (0, 1), (2, -1), (2, 1)):
            cells = np.flatnonzero(flat)
            rim = cells[~flat[cells + step * strides[axis]]]
            around = codes(rim)
            rim = rim[(np.bitwise_count(around) > 1) & _KNOWN(around)]
            field = sum((rim // s) % n % 2 << k for k, (s, n) in enumerate(zip(strides, grid.shape, strict=True)))
            for k in range(8):
                here = rim[field == k]
                goes = here[_KNOWN(codes(here))]
                flat[goes] = False
                gone += len(goes)
    return flat.reshape(grid.shape)


def skeleton(cells: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """Cells of each mask's skeleton."""
    return _per_group(cells, by, thinned)


def centre_line_dice(gt: DataFrame, pred: DataFrame, by: Sequence[str] = ("case_id",)) -> DataFrame:
    """``(*by, precision, recall, cldice)``: the share of the predicted skeleton inside the true mask, of the true one inside the predicted mask, and their harmonic mean.

    A mask without a skeleton has a share of 1; if one mask is empty the mean is 0. Groups that are empty on both sides have no row.
    """
    key = [*by, "x", "y", "z"]
    gt, pred = gt.select(*key).distinct(), pred.select(*key).distinct()

    def share(lines: DataFrame, mask: DataFrame, name: str) -> DataFrame:
        return lines.join(mask.withColumn("_hit", F.lit(1)), key, "left").groupBy(*by).agg((F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias(name))

    both = share(skeleton(pred, by), gt, "precision").join(share(skeleton(gt, by), pred, "recall"), list(by), "full_outer")
    p, r = F.coalesce("precision", F.lit(1.0)), F.coalesce("recall", F.lit(1.0))
    return both.select(*by, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("cldice"))
