"""Exact Euclidean distances to the nearest cell of a mask: lower envelopes of parabolas along one axis after another, plane by plane and then column by column."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.operators import shared

#: Cells along an edge and in all, up to which the box of a group is solved side by side with others, and numbers in the arrays of those.
EDGE, SMALL, SIDE_BY_SIDE = 32, 1 << 13, 1 << 17
#: Cells along an edge of the tiles into which planes are cut, and numbers in the arrays that a task holds at once.
TILE, NUMBERS = 32, 1 << 21
#: Pairs of a plane and a query up to which a tile's few pairs are compared outright.
FEW = 1 << 13


def lower_envelope(heights: np.ndarray, step: float, at: np.ndarray) -> np.ndarray:
    """``out[k, line]``: the least of ``heights[i, line] + (step * (i - at[k]))**2`` over all ``i``; ``at`` ascends.

    All lines at once: each place in turn enters a line's envelope, and parabolas that it hides leave, so the work is in proportion to places and lines. Infinite heights have no
    parabola; a line without any is infinite.
    """
    n, lines = heights.shape
    every = np.arange(lines)
    top = np.full(lines, -1)
    stack, start = np.zeros((n + 1, lines), np.int32), np.full((n + 2, lines), np.inf)
    place = np.arange(n) * step
    for q in range(n):
        new = np.flatnonzero(np.isfinite(heights[q]))
        begins, asked = np.full(lines, -np.inf), new[top[new] >= 0]
        while len(asked):
            last = stack[top[asked], asked]
            meet = (heights[q, asked] + place[q] ** 2 - heights[last, asked] - place[last] ** 2) / (2 * (place[q] - place[last]))
            hidden = meet <= start[top[asked], asked]
            begins[asked[~hidden]] = meet[~hidden]
            asked = asked[hidden]
            top[asked] -= 1
            asked = asked[top[asked] >= 0]
        top[new] += 1
        stack[top[new], new], start[top[new], new] = q, begins[new]
    start[np.minimum(top + 1, n + 1), every] = np.inf
    out, now = np.empty((len(at), lines)), np.zeros(lines, np.int64)
    known = top >= 0
    for k, p in enumerate(at):
        while (later := known & (start[now + 1, every] < p * step)).any():
            now[later] += 1
        lowest = stack[now, every]
        out[k] = np.where(known, heights[lowest, every] + (place[lowest] - p * step) ** 2, np.inf)
    return out


def _planes(cells: pd.DataFrame, spacing: Sequence[float], tile: int) -> Iterator[pd.DataFrame]:
    """Tiles of the squared distances within each plane ``z`` of the groups in ``cells``."""
    cells = cells.sort_values(["nx", "ny", "_group", "z"], kind="stable")
    group, z, x, y = (cells[c].to_numpy(np.int64) for c in ("_group", "z", "x", "y"))
    first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (z[1:] != z[:-1])))
    number = np.cumsum(np.isin(np.arange(len(cells)), first)) - 1
    nx, ny = cells["nx"].to_numpy()[first], cells["ny"].to_numpy()[first]
    lo = 0
    while lo < len(first):
        hi = lo + 1
        while hi < len(first) and (hi + 1 - lo) * nx[lo : hi + 1].max() * ny[lo : hi + 1].max() <= NUMBERS:
            hi += 1
        width, depth = int(nx[lo:hi].max()), int(ny[lo:hi].max())
        here = (number >= lo) & (number < hi)
        grid = np.full((width, hi - lo, depth), np.inf)
        grid[x[here], number[here] - lo, y[here]] = 0.0
        lines = lower_envelope(grid.reshape(width, -1), spacing[0], np.arange(width)).reshape(width, hi - lo, depth)
        flat = lower_envelope(np.moveaxis(lines, 2, 0).reshape(depth, -1), spacing[1], np.arange(depth)).reshape(depth, width, hi - lo)
        rows = []
        for k in range(lo, hi):
            at = first[k]
            for a in range(-(-nx[k] // tile)):
                for b in range(-(-ny[k] // tile)):
                    part = flat[b * tile : min((b + 1) * tile, ny[k]), a * tile : min((a + 1) * tile, nx[k]), k - lo]
                    rows.append((group[at], (a << 20) + b, z[at], part.shape[1], part.T.tobytes()))
        yield pd.DataFrame(rows, columns=["_group", "tile", "z", "width", "heights"])
        lo = hi


def _columns(rows: pd.DataFrame, step: float, tile: int) -> pd.DataFrame:
    """``d2`` of the queries in ``rows``, from the tiles of all planes that have cells."""
    rows = rows.assign(asks=rows["heights"].isna()).sort_values(["_group", "tile", "asks"], kind="stable")
    group, name, asks, z = (rows[c].to_numpy() for c in ("_group", "tile", "asks", "z"))
    x, y, width, heights = rows["x"].to_numpy(np.float64), rows["y"].to_numpy(np.float64), rows["width"].to_numpy(np.float64), rows["heights"].to_numpy()
    starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (name[1:] != name[:-1])))
    d2 = np.full(len(rows), np.nan)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        mid = lo + int((~asks[lo:hi]).sum())
        if mid == lo or mid == hi:
            continue
        stacked = np.frombuffer(b"".join(heights[lo:mid])).reshape(mid - lo, int(width[lo]), -1)
        own, left, right = z[mid:hi], x[mid:hi].astype(np.int64) % tile, y[mid:hi].astype(np.int64) % tile
        if (mid - lo) * (hi - mid) <= FEW:
            gap = (z[lo:mid, None] - own[None]) * step
            d2[mid:hi] = (stacked[:, left, right] + gap * gap).min(0)
            continue
        low = z[lo:mid].min()
        column, which = np.unique(left * tile + right, return_inverse=True)
        at, level = np.unique(own - low, return_inverse=True)
        lines = np.full((int(z[lo:mid].max() - low) + 1, len(column)), np.inf)
        lines[z[lo:mid] - low] = stacked[:, column // tile, column % tile]
        d2[mid:hi] = lower_envelope(lines, step, at)[level, which]
    return rows.assign(d2=d2)[asks][["_group", "x", "y", "z", "d2"]]


def least(grid: np.ndarray, axis: int, step: float) -> np.ndarray:
    """``out[i]``: the least of ``grid[j] + (step * (i - j))**2`` over the places ``j`` of a short axis, tried one after another."""
    lines = np.moveaxis(grid, axis, 0)
    out, at = np.full_like(lines, np.inf), np.arange(len(lines))
    for j in range(len(lines)):
        np.minimum(out, lines[j] + ((at - j) * step)[(...,) + (None,) * (lines.ndim - 1)] ** 2, out=out)
    return np.moveaxis(out, 0, axis)


def _boxes(rows: pd.DataFrame, spacing: Sequence[float]) -> pd.DataFrame:
    """``d2`` of the queries in ``rows``, which hold whole groups of small boxes; each query once."""
    rows = rows.sort_values("_group", kind="stable")
    group, at, site = rows["_group"].to_numpy(np.int64), rows[["x", "y", "z"]].to_numpy(np.int64), rows["_site"].to_numpy(bool)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    until = np.append(first[1:], len(rows))
    low = np.minimum.reduceat(at, first)
    sizes = np.maximum.reduceat(at, first) - low + 1
    number = np.repeat(np.arange(len(first)), until - first)
    local, out, lo = at - low[number], [], 0
    while lo < len(first):
        hi, wide = lo + 1, sizes[lo]
        while hi < len(first) and (hi + 1 - lo) * np.prod(np.maximum(wide, sizes[hi])) <= SIDE_BY_SIDE:
            wide, hi = np.maximum(wide, sizes[hi]), hi + 1
        here = slice(first[lo], until[hi - 1])
        place, on = np.column_stack([local[here], number[here] - lo]), site[here]
        grid = np.full((*wide, hi - lo), np.inf)
        grid[tuple(place[on].T)] = 0.0
        for axis in range(3):
            grid = least(grid, axis, spacing[axis])
        asked = np.zeros(grid.shape, bool)
        asked[tuple(place[~on].T)] = True
        found = np.argwhere(asked)
        which = found[:, 3] + lo
        cell, d2 = found[:, :3] + low[which], grid[asked]
        out.append(pd.DataFrame({"_group": group[first[which]], "x": cell[:, 0], "y": cell[:, 1], "z": cell[:, 2], "d2": np.where(np.isinf(d2), np.nan, d2)}))
        lo = hi
    return pd.concat(out)


def squared_distances(queries: DataFrame, sites: DataFrame, by: Sequence[str] = ("case_id",), spacing: Sequence[float] = (1, 1, 1), tile: int = TILE) -> DataFrame:
    """``queries(*by, x, y, z)`` with ``d2``, the exact squared distance to the nearest of ``sites(*by, x, y, z)`` of its group; null for groups without any. Both hold whole-numbered cells.

    The planes ``z`` of a group are maps of their own: distances along x, then y, by lower envelopes of parabolas. Planes are cut into tiles, those with queries sent to where all tiles of a
    place meet, and distances along z found there, a column at a time. What a task holds at once is a plane of the group's box or a tile of all its planes, never the volume; the work is in
    proportion to the cells of the box. Groups whose box has ``SMALL`` cells at most are solved whole, many side by side. Repeated queries are answered once each.
    """
    key = ["_group", "x", "y", "z"]
    queries = queries.withColumn("_group", F.xxhash64(*by))
    asked = queries.select(*[F.col(c).cast("long").alias(c) for c in key])
    sites = sites.select(F.xxhash64(*by).alias("_group"), *[F.col(c).cast("long").alias(c) for c in "xyz"])
    ends = [f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max))]
    box = asked.unionByName(sites).groupBy("_group").agg(*ends)
    size = {c: F.col(f"high{c}") - F.col(f"low{c}") + 1 for c in "xyz"}
    little = (F.greatest(*size.values()) <= EDGE) & (size["x"] * size["y"] * size["z"] <= SMALL)
    box = shared.cut(box.select("_group", "lowx", "lowy", size["x"].alias("nx"), size["y"].alias("ny"), little.alias("_little")))
    tasks = 8 * int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {r[0] for r in box.select("_little").distinct().collect()}
    rows = asked.withColumn("_site", F.lit(False)).unionByName(sites.withColumn("_site", F.lit(True))).dropna(subset=["x", "y", "z"])
    if False in kinds:
        rows = rows.join(box.filter("_little").select("_group"), "_group", "left_semi")
    solved = rows.withColumn("_bin", F.pmod("_group", F.lit(tasks))).groupBy("_bin").applyInPandas(lambda part: _boxes(part, spacing), "_group long, x long, y long, z long, d2 double")
    solved = solved.withColumn("d2", F.when(~F.isnan("d2"), F.col("d2")))
    if False in kinds:
        large = _of_planes(asked, sites, box.filter("NOT _little").drop("_little"), spacing, tile, tasks)
        solved = solved.unionByName(large) if True in kinds else large
    return queries.join(solved, key, "left").drop("_group").select(*[c for c in queries.columns if c != "_group"], "d2")


def _of_planes(asked: DataFrame, sites: DataFrame, box: DataFrame, spacing: Sequence[float], tile: int, tasks: int) -> DataFrame:
    """``asked`` with ``d2``, once each, in the groups of ``box``: plane by plane and column by column."""
    placed = asked.join(box, "_group").select("_group", (F.col("x") - F.col("lowx")).alias("x"), (F.col("y") - F.col("lowy")).alias("y"), "z", "lowx", "lowy")
    # a tile's name holds its place along x and along y
    name = F.shiftleft(F.expr(f"x div {tile}"), 20) + F.expr(f"y div {tile}")
    wanted = placed.select("_group", name.alias("tile")).distinct()
    near = sites.join(box, "_group").select("_group", (F.col("x") - F.col("lowx")).alias("x"), (F.col("y") - F.col("lowy")).alias("y"), "z", "nx", "ny", F.pmod(F.xxhash64("_group", "z"), F.lit(tasks)).alias("_bin"))

    def planes(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_planes(rows, spacing, tile))

    maps = near.groupBy("_bin").applyInPandas(planes, "_group long, tile long, z long, width long, heights binary").join(wanted, ["_group", "tile"], "left_semi")
    none = F.lit(None)
    both = maps.select("_group", "tile", none.cast("long").alias("x"), none.cast("long").alias("y"), "z", "width", "heights").unionByName(
        placed.select("_group", name.alias("tile"), "x", "y", "z", none.cast("long").alias("width"), none.cast("binary").alias("heights")).distinct()
    )
    solved = both.withColumn("_bin", F.pmod(F.xxhash64("_group", "tile"), F.lit(tasks))).groupBy("_bin").applyInPandas(lambda rows: _columns(rows, spacing[2], tile), "_group long, x long, y long, z long, d2 double")
    return solved.join(box, "_group").select("_group", (F.col("x") + F.col("lowx")).alias("x"), (F.col("y") + F.col("lowy")).alias("y"), "z", F.when(~F.isnan("d2"), F.col("d2")).alias("d2"))
