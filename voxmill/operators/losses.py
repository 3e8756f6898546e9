"""Training losses as scores: the forward values of soft overlap, cross-entropy, top-k and focal losses, and thresholds, as aggregates over long tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators import distance, shared


def soft_counts(cells: DataFrame, by: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """``(*by, tp, fp, fn, tn)`` as sums of probabilities against 0/1 truths."""
    a, b = F.col(p), F.col(y)
    return cells.groupBy(*by).agg(F.sum(a * b).alias("tp"), F.sum(a * (1 - b)).alias("fp"), F.sum((1 - a) * b).alias("fn"), F.sum((1 - a) * (1 - b)).alias("tn"))


def soft_dice(smooth: float = 1.0, clip: float = 1e-8) -> Column:
    """Soft Dice of ``tp, fp, fn``."""
    both = 2 * F.col("tp") + F.col("fp") + F.col("fn") + smooth
    return (2 * F.col("tp") + smooth) / F.greatest(both, F.lit(clip))


def soft_dice_loss(cells: DataFrame, case: str, label: str, background: int | None = 0, batch: bool = False, smooth: float = 1.0) -> DataFrame:
    """``(case, loss)``: minus the mean soft Dice over the classes of each case; with ``batch`` counts are summed over all cases first, in one row."""
    kept = cells if background is None else cells.filter(F.col(label) != background)
    counts = soft_counts(kept, [label] if batch else [case, label])
    return counts.groupBy(*([] if batch else [case])).agg((-F.avg(soft_dice(smooth))).alias("loss"))


def cross_entropy(p: Column, clip: float = 1e-7) -> Column:
    """Cross-entropy of the probability given to the true class."""
    return -F.ln(F.greatest(p, F.lit(clip)))


def mean_cross_entropy(cells: DataFrame, case: str, p: str = "p") -> DataFrame:
    """``(case, loss)``: mean cross-entropy of a row for each cell, ``p`` being the probability of its true class."""
    return cells.groupBy(case).agg(F.avg(cross_entropy(F.col(p))).alias("loss"))


def top_k_loss(cells: DataFrame, case: str, order: Sequence[str], percent: float = 10.0, p: str = "p") -> DataFrame:
    """``(case, loss)``: mean cross-entropy of the ``percent`` worst cells of each case (rounded down, one at least)."""
    from voxmill.operators.selection import numbered

    worst = numbered(cells.withColumn("_ce", cross_entropy(F.col(p))), [-F.col("_ce"), *[F.col(c) for c in order]], [case])
    kept = worst.filter(F.col("_rank") <= F.greatest(F.floor(F.col("_total") * percent / 100), F.lit(1)))
    return kept.groupBy(case).agg(F.avg("_ce").alias("loss"))


def _pooled(v: np.ndarray, least: bool) -> list[np.ndarray]:
    """The least or largest of each cell and its two neighbours along x, of y, and of z, the first three axes; absent cells (nan) don't count."""
    pick, out = (np.fmin, []) if least else (np.fmax, [])
    for axis in range(3):
        line, near = np.moveaxis(v, axis, 0), v.copy()
        to = np.moveaxis(near, axis, 0)
        pick(to[1:], line[:-1], out=to[1:])
        pick(to[:-1], line[1:], out=to[:-1])
        out.append(near)
        if not least:
            v = out[-1]
    return out


def soft_skeleton_of(v: np.ndarray, iterations: int) -> np.ndarray:
    """The soft skeleton of a block, or of blocks side by side along a fourth axis: what an opening takes away, summed over more and more eroded images."""
    absent = np.isnan(v)

    def eroded(a: np.ndarray) -> np.ndarray:
        return np.where(absent, np.nan, np.fmin.reduce(_pooled(a, True)))

    def left(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small = eroded(a)
        return np.maximum(a - _pooled(small, False)[-1], 0), small

    skeleton, small = left(v)
    for _ in range(iterations):
        more, small = left(small)
        skeleton = skeleton + np.maximum(more - skeleton * more, 0)
    return skeleton


#: Numbers in the arrays of the blocks that are solved side by side.
NUMBERS = 1 << 17


def _skeletons_of_blocks(part: pd.DataFrame, values: Sequence[str], iterations: int, block: int) -> pd.DataFrame:
    """``part``'s cells that lie in their row's own block, with their skeletons; ``part`` holds whole blocks with their rims, told apart by ``_group, _x, _y, _z``."""
    part = part.sort_values(["_group", "_x", "_y", "_z"], kind="stable")
    name, at = part[["_group", "_x", "_y", "_z"]].to_numpy(np.int64), part[["x", "y", "z"]].to_numpy(np.int64)
    own = name[:, 1:] * block
    inside = ((at >= own) & (at < own + block)).all(1)
    first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]).any(1)))
    until = np.append(first[1:], len(part))
    low = np.minimum.reduceat(at, first)
    sizes = np.maximum.reduceat(at, first) - low + 1
    number = np.repeat(np.arange(len(first)), until - first)
    local = at - low[number]
    out, lo = {f"skeleton_{v}": np.full(len(part), np.nan) for v in values}, 0
    while lo < len(first):
        hi, wide = lo + 1, sizes[lo]
        while hi < len(first) and (hi + 1 - lo) * np.prod(np.maximum(wide, sizes[hi])) <= NUMBERS:
            wide, hi = np.maximum(wide, sizes[hi]), hi + 1
        here = slice(first[lo], until[hi - 1])
        place = (*local[here].T, number[here] - lo)
        for v in values:
            grid = np.full((*wide, hi - lo), np.nan)
            grid[place] = part[v].to_numpy()[here]
            out[f"skeleton_{v}"][here] = soft_skeleton_of(grid, iterations)[place]
        lo = hi
    return part.assign(**out)[inside][["_group", "x", "y", "z", *values, *out]]


def soft_skeletons(cells: DataFrame, by: Sequence[str], values: Sequence[str], iterations: int = 10, block: int = 32) -> DataFrame:
    """``(_group, x, y, z, *values)`` of ``cells(*by, x, y, z, *values)`` with ``skeleton_<value>`` of each: iterated minima along the axes and maxima of 3 x 3 x 3 neighbours. Absent cells take no part.

    ``_group`` is ``xxhash64(*by)``. A cell's skeleton depends on cells up to ``iterations + 2`` away, so every block of the grid is sent with a rim that wide and solved by itself, small ones
    side by side: one shuffle, whatever the number of iterations. Blocks beyond the cells' ends get nothing.
    """
    rim = iterations + 2
    rows = cells.select(F.xxhash64(*by).alias("_group"), *[F.col(c).cast("long").alias(c) for c in "xyz"], *[F.col(v).cast("double").alias(v) for v in values])
    ends = rows.agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("a", F.min), ("b", F.max))]).first()
    for c in "xyz":
        least, most = (ends[f"{n}{c}"] // block if ends[f"{n}{c}"] is not None else 0 for n in "ab")
        rows = rows.withColumn(f"_{c}", F.explode(F.sequence(F.greatest(F.floor((F.col(c) - rim) / block), F.lit(least)), F.least(F.floor((F.col(c) + rim) / block), F.lit(most)))))
    tasks = 8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_bin", F.pmod(F.xxhash64("_group", "_x", "_y", "_z"), F.lit(tasks)))
    kinds = ", ".join(f"{n} double" for n in (*values, *[f"skeleton_{v}" for v in values]))
    return rows.groupBy("_bin").applyInPandas(lambda part: _skeletons_of_blocks(part, values, iterations, block), f"_group long, x long, y long, z long, {kinds}")


def soft_skeleton(cells: DataFrame, by: Sequence[str], value: str = "value", iterations: int = 10, block: int = 32) -> DataFrame:
    """``cells(*by, x, y, z, value)`` with ``skeleton``; see :func:`soft_skeletons`."""
    found = soft_skeletons(cells.select(*by, "x", "y", "z", F.col(value).alias("v")), by, ["v"], iterations, block).select("_group", "x", "y", "z", F.col("skeleton_v").alias("skeleton"))
    return cells.withColumn("_group", F.xxhash64(*by)).join(found, ["_group", "x", "y", "z"]).select(*cells.columns, "skeleton")


def soft_centre_line_loss(cells: DataFrame, case: str, label: str, p: str = "p", y: str = "y01", iterations: int = 10, smooth: float = 1.0, batch: bool = False, clip: float = 1e-8) -> DataFrame:
    """``(case, loss)``: minus the mean over the classes of each case of ``precision * recall / (precision + recall)`` of soft skeletons; with ``batch`` sums are taken over all cases first, in one row.

    ``cells(case, label, x, y, z, p, y)`` have a probability and a 0/1 truth for each class but the background.
    """
    cells = cells.select(case, label, "x", "y", "z", F.col(p).alias("p"), F.col(y).alias("y01"))
    lines = soft_skeletons(cells, [case, label], ["p", "y01"], iterations)
    hit, found = F.col("skeleton_p") * F.col("y01"), F.col("skeleton_y01") * F.col("p")
    sums = lines.groupBy("_group").agg(F.sum(hit).alias("_hit"), F.sum("skeleton_p").alias("_lines"), F.sum(found).alias("_found"), F.sum("skeleton_y01").alias("_true"))
    sums = sums.join(cells.select(case, label, F.xxhash64(case, label).alias("_group")).distinct(), "_group")
    if batch:
        sums = sums.groupBy(label).agg(*[F.sum(c).alias(c) for c in ("_hit", "_lines", "_found", "_true")])
    share = lambda a, b: (F.col(a) + smooth) / F.greatest(F.col(b) + smooth, F.lit(clip))
    precision, recall = share("_hit", "_lines"), share("_found", "_true")
    return sums.groupBy(*([] if batch else [case])).agg((-F.avg(precision * recall / F.greatest(precision + recall, F.lit(clip)))).alias("loss"))


def _weighed(at: np.ndarray, number: np.ndarray, sides: np.ndarray, alpha: float, most: float | None, spacing: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """The two weights of :func:`hausdorff_loss` of each cell in small boxes that are numbered from 0 on; ``sides`` tells of each whether it is inside and outside of the prediction and of the truth."""
    first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    local = at - np.minimum.reduceat(at, first)[number]
    grid = np.full((*(local.max(0) + 1), len(first), 4), np.inf)
    place = (*local.T, number)
    for side in range(4):  # the distance to a cell of the other side
        grid[(*(c[sides[:, side ^ 1]] for c in place), side)] = 0.0
    for axis in range(3):
        grid = distance.least(grid, axis, spacing[axis])
    d = np.sqrt(grid[place])
    d = np.where(sides & np.isfinite(d), d, 0.0)
    w = (d if most is None else np.minimum(d, most)) ** alpha
    return w[:, 0] + w[:, 3], w[:, 1] + w[:, 2]


#: What :func:`_sums_of_boxes` reads of each cell besides its case.
_CELL = ("_group", "_little", "x", "y", "z", "_inside", "_outside", "_true", "_false", "_error")


def _sums_of_boxes(batches: Iterator[pa.RecordBatch], alpha: float, most: float | None, spacing: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """For each small group its case, the sums and numbers of weighted errors; for a large one its case and ``_large``. The rows of a group follow one another."""

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group, little = (rows.column(c).to_numpy() for c in ("_group", "_little"))
        sides = np.column_stack([rows.column(c).to_numpy() for c in ("_inside", "_outside", "_true", "_false")])
        known, error = rows.column("_error").is_valid().to_numpy(), rows.column("_error").fill_null(0.0).to_numpy()
        at = np.column_stack([rows.column(c).fill_null(0).to_numpy() for c in "xyz"])
        placed = np.logical_and.reduce([little, *(rows.column(c).is_valid().to_numpy() for c in "xyz")])
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        number = np.cumsum(np.isin(np.arange(len(group)), first)) - 1
        fg, bg = np.zeros(len(group)), np.zeros(len(group))
        own = np.flatnonzero(placed)
        if len(own):
            starts = np.flatnonzero(np.append(True, number[own][1:] != number[own][:-1]))
            until = np.append(starts[1:], len(own))
            sizes = np.maximum.reduceat(at[own], starts) - np.minimum.reduceat(at[own], starts) + 1
            lo = 0
            while lo < len(starts):
                hi, wide = lo + 1, sizes[lo]
                while hi < len(starts) and 4 * (hi + 1 - lo) * np.prod(np.maximum(wide, sizes[hi])) <= distance.SIDE_BY_SIDE:
                    wide, hi = np.maximum(wide, sizes[hi]), hi + 1
                here = own[starts[lo] : until[hi - 1]]
                fg[here], bg[here] = _weighed(at[here], np.repeat(np.arange(hi - lo), (until - starts)[lo:hi]), sides[here], alpha, most, spacing)
                lo = hi
        sums = []
        for w in (fg, bg):
            counts = known & (w != 0)
            sums += [np.add.reduceat(np.where(counts, error * w, 0.0), first), np.add.reduceat(counts.astype(np.int64), first)]
        out = pa.table([rows.column("_case").take(pa.array(first)), *map(pa.array, sums), pa.array(~little[first])], names=["_case", *_SUMS, "_large"])
        yield from out.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []  # the rows of the last group so far, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        group, little = batch.column("_group").to_numpy(), batch.column("_little").to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(group[1:] != group[:-1]) + 1
        if held and held[-1].column("_group")[-1].as_py() != group[0]:
            yield from solved(pa.Table.from_batches(held))
            held = []
        if len(begins):
            yield from solved(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]))
            held = []
        rest = batch.slice(begins[-1] if len(begins) else 0)
        if little[-1] or not held:
            held.append(rest if little[-1] else rest.slice(0, 1))  # one row stands for a large group
    if held:
        yield from solved(pa.Table.from_batches(held))


#: The sum and number of errors weighted one way and the other.
_SUMS = ("_fg", "_nfg", "_bg", "_nbg")


def hausdorff_loss(cells: DataFrame, case: str, label: str, p: str = "p", y: str = "y01", alpha: float = 2.0, most: float | None = None, spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """``(case, loss)``: squared errors of the probabilities weighted by distances to the borders of both masks, over the classes of ``cells(case, label, x, y, z, p, y)``, which has a cell of a class once.

    Cells inside of one mask and outside of the other weigh by their distances to the other side, to the power ``alpha`` and ``most`` at most: half of the mean over cells that are inside of the
    prediction or outside of the truth, plus half of that over cells outside of the prediction or inside of the truth. A mask that is empty or fills all cells has distances of zero.

    Classes of a case are put together once, by no shuffle if cases are together already; those whose box is small (:data:`distance.SMALL`) are summed where they stand, many side by side. Only
    the cells of larger ones are sent on (:func:`distance.squared_distances`).
    """
    error = F.pow(F.col(p) - F.col(y).cast("double"), F.lit(2.0))
    rows = cells.select(
        F.col(case).alias("_case"), F.col(label).alias("_label"), F.xxhash64(case, label).alias("_group"), *[F.col(c).cast("long").alias(c) for c in "xyz"], error.alias("_error"),
        *[F.coalesce(m, F.lit(False)).alias(n) for n, m in (("_inside", F.col(p) > 0.5), ("_outside", F.col(p) <= 0.5), ("_true", F.col(y) > 0.5), ("_false", F.col(y) <= 0.5))],
    )
    each = W.partitionBy("_case", "_label")
    size = [F.max(c).over(each) - F.min(c).over(each) + 1 for c in "xyz"]
    rows = rows.withColumns({f"_n{c}": n for c, n in zip("xyz", size, strict=True)})
    little = (F.greatest("_nx", "_ny", "_nz") <= distance.EDGE) & (F.col("_nx") * F.col("_ny") * F.col("_nz") <= distance.SMALL)
    rows = rows.withColumn("_little", F.coalesce(little, F.lit(True))).select("_case", "_label", *_CELL)
    schema = T.StructType([rows.schema["_case"]]).add("_fg", "double").add("_nfg", "long").add("_bg", "double").add("_nbg", "long").add("_large", "boolean")
    found = rows.drop("_label").mapInArrow(lambda batches: _sums_of_boxes(batches, alpha, most, spacing), schema)
    sums = [F.sum(n).alias(n) for n in _SUMS]
    found = shared.cut(found.groupBy("_case").agg(*sums, F.max("_large").alias("_large")))
    if found.filter("_large").limit(1).count():
        found = found.unionByName(_sums_of_planes(rows.filter("NOT _little"), alpha, most, spacing).withColumn("_large", F.lit(True))).groupBy("_case").agg(*sums)
    mean = lambda n: F.when(F.col(f"_n{n}") > 0, F.col(f"_{n}") / F.col(f"_n{n}"))
    return found.select(F.col("_case").alias(case), F.coalesce(0.5 * (mean("fg") + mean("bg")), F.lit(0.0)).alias("loss"))


def _sums_of_planes(cells: DataFrame, alpha: float, most: float | None, spacing: Sequence[float]) -> DataFrame:
    """``(_case, *_SUMS)`` of the classes in ``cells``, by the distances of all cells to the other side of either mask."""
    side = lambda name, fg, on, off: F.struct(F.lit(name).alias("map"), F.when(F.col(on), True).when(F.col(off), False).alias("on"), F.lit(fg).alias("fg"))
    maps = F.array(side("p", True, "_inside", "_outside"), side("y", False, "_true", "_false"))
    rows = cells.select("_case", "_label", "x", "y", "z", "_error", F.explode(maps).alias("_m")).select("_case", "_label", "x", "y", "z", "_error", "_m.*").filter("on IS NOT NULL")
    far = distance.squared_distances(rows, rows.withColumn("on", ~F.col("on")), ["_case", "_label", "map", "on"], spacing)
    d = F.sqrt(F.coalesce("d2", F.lit(0.0)))
    weight = F.pow(d if most is None else F.least(d, F.lit(most)), F.lit(alpha))
    of = lambda fg: F.sum(F.when((F.col("fg") == F.col("on")) == fg, F.col("_w")).otherwise(0.0))
    each = far.withColumn("_w", weight).groupBy("_case", "_label", "x", "y", "z", "_error").agg(of(True).alias("_wfg"), of(False).alias("_wbg"))
    sums = [f for n in ("fg", "bg") for m in [F.when(F.col(f"_w{n}") != 0, F.col("_error") * F.col(f"_w{n}"))] for f in (F.coalesce(F.sum(m), F.lit(0.0)).alias(f"_{n}"), F.count(m).alias(f"_n{n}"))]
    return each.groupBy("_case").agg(*sums)


def focal(p: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """Focal loss of the probability given to the true class."""
    return alpha * F.pow(1 - p, F.lit(gamma)) * cross_entropy(p)


def binary_dice(cells: DataFrame, by: Sequence[str], p: str = "p", y: str = "y", t: float = 0.5, eps: float = 1e-5) -> DataFrame:
    """``(*by, dice)`` of probabilities cut at ``t``; an error for truths other than 0 and 1."""
    truth = F.when(~F.col(y).isin(0, 1), F.raise_error(F.lit("truths must be 0 or 1"))).otherwise(F.col(y))
    hit = (F.col(p) >= t).cast("long")
    return cells.groupBy(*by).agg(((2 * F.sum(hit * truth) + eps) / (F.sum(hit) + F.sum(truth) + eps)).alias("dice"))


def otsu(cells: DataFrame, by: Sequence[str], value: str = "value", bins: int = 256) -> DataFrame:
    """``(*by, threshold)``: the cut of a histogram of ``bins`` parts that sets its two sides farthest apart; the first of equal ones.

    Constant groups get their value.
    """
    from voxmill.operators.values import with_facts

    rows = with_facts(cells.select(*by, F.col(value).cast("double").alias("_v")), by, _low=F.min("_v"), _high=F.max("_v"))
    width = (F.col("_high") - F.col("_low")) / bins
    part = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    hist = rows.groupBy(*by, "_low", "_high", part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    centre = F.col("_low") + (F.col("_part") + 0.5) * width
    upto, every = W.partitionBy(*by).orderBy("_part"), W.partitionBy(*by)
    hist = hist.withColumns({"_c": centre, "_w": F.sum("_n").over(upto), "_s": F.sum(F.col("_n") * centre).over(upto), "_all": F.sum("_n").over(every), "_sum": F.sum(F.col("_n") * centre).over(every)})
    other = F.col("_all") - F.col("_w")
    apart = F.when(other > 0, F.col("_w") * other * F.pow(F.col("_s") / F.col("_w") - (F.col("_sum") - F.col("_s")) / other, F.lit(2.0))).otherwise(F.lit(0.0))
    best = hist.withColumn("_apart", apart).groupBy(*by).agg(F.max(F.struct("_apart", (-F.col("_part")).alias("_m"), "_c", "_low", "_high")).alias("b"))
    return best.select(*by, F.when(F.col("b._high") > F.col("b._low"), F.col("b._c")).otherwise(F.col("b._low")).alias("threshold"))
