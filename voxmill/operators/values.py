"""Value maps of single voxels or probability vectors, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def clip(v: Column, low: float, high: float) -> Column:
    """``v`` within [low, high]."""
    return F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))


def rescale(v: Column, low: float, high: float) -> Column:
    """``v`` clipped to [low, high] and mapped to [0, 1]."""
    return (clip(v, low, high) - low) / F.lit(float(high - low))


def to_uint8(v: Column, low: float, high: float) -> Column:
    """``v`` clipped to [low, high] and mapped to 0 to 255, rounded down."""
    return F.floor(255.0 * (clip(v, low, high) - low) / F.lit(float(high - low)))


def with_facts(table: DataFrame, by: Sequence[str], **facts: Column) -> DataFrame:
    """``table`` with aggregates of each row's group: a row a group is computed first and joined back, null keys included.

    Spark broadcasts the facts if they are small; no group has to fit in a task.
    """
    found = table.groupBy(*by).agg(*[c.alias(n) for n, c in facts.items()]).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return table.join(found, same).drop(*[f"_by_{c}" for c in by])


def min_max(table: DataFrame, value: str, by: Sequence[str], out: str) -> DataFrame:
    """``value`` mapped to [0, 1] within each group; 0 where a group is constant."""
    rows = with_facts(table, by, _low=F.min(value), _high=F.max(value))
    return rows.withColumn(out, F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(F.lit(0.0))).drop("_low", "_high")


def z_score(table: DataFrame, value: str, by: Sequence[str], out: str, inside: Column | None = None, floor: float = 1e-8) -> DataFrame:
    """``value`` less the group's mean over its population deviation, of which ``floor`` is the least.

    With ``inside`` the statistics are those of the voxels where it holds, and the others become 0.
    """
    kept = F.col(value) if inside is None else F.when(inside, F.col(value))
    score = (F.col(value) - F.col("_mean")) / F.greatest(F.col("_std"), F.lit(floor))
    rows = with_facts(table, by, _mean=F.avg(kept), _std=F.stddev_pop(kept))
    return rows.withColumn(out, score if inside is None else F.when(inside, score).otherwise(F.lit(0.0))).drop("_mean", "_std")


def clip_rescale_score(table: DataFrame, value: str, low: float, high: float, by: Sequence[str], out: str) -> DataFrame:
    """``value`` clipped to [low, high], mapped to [0, 1], then z-scored within each group."""
    return z_score(table.withColumn("_scaled", rescale(F.col(value), low, high)), "_scaled", by, out).drop("_scaled")


def ct_normalise(table: DataFrame, prints: DataFrame, value: str, by: Sequence[str], out: str, floor: float = 1e-8) -> DataFrame:
    """``value`` clipped to the dataset's percentiles 0.5 and 99.5, less its mean, over its deviation.

    ``prints`` is the fingerprint, a row for each group: Spark broadcasts it if it is small.
    """
    facts = prints.select(*by, "mean", "std", "percentile_00_5", "percentile_99_5")
    v = F.least(F.greatest(F.col(value), F.col("percentile_00_5")), F.col("percentile_99_5"))
    return table.join(facts, list(by)).withColumn(out, (v - F.col("mean")) / F.greatest("std", F.lit(floor))).drop("mean", "std", "percentile_00_5", "percentile_99_5")


def rescale_checked(v: Column, high: float = 255.0) -> Column:
    """``v / high``; an error if it isn't within [0, high]."""
    return F.when((v < 0) | (v > high), F.raise_error(F.concat(F.lit("value out of range: "), v.cast("string")))).otherwise(v / F.lit(float(high)))


#: Normalisation by the channel's name; others are z-scored.
SCHEMES = {"ct": "ct", "nonorm": "none", "zscore": "zscore", "rescale_to_0_1": "rescale", "rgb_to_0_1": "rgb"}


def scheme_of(channel: Column) -> Column:
    """The normalisation scheme that a channel's name stands for."""
    table = F.create_map(*[F.lit(x) for pair in SCHEMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(channel)), F.lit("zscore"))


def relabel(v: Column, table: Mapping[int, int], others: int | None = None) -> Column:
    """``v`` through ``table``; a label it lacks stays as it is, or becomes ``others``."""
    found = F.try_element_at(F.create_map(*[F.lit(int(x)) for pair in table.items() for x in pair]), v.cast("int")).cast("long")
    return F.coalesce(found, v.cast("long") if others is None else F.lit(others).cast("long"))


def threshold(v: Column, t: float) -> Column:
    """1 above ``t``, else 0."""
    return F.when(v > t, 1).otherwise(0)


def argmax(p: Column) -> Column:
    """Index of the largest entry of an array, the first of equal ones."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def softmax(p: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    e = F.transform(p, lambda x: F.exp(x - F.array_max(p)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def sigmoid(p: Column) -> Column:
    """Sigmoid of each entry of an array."""
    return F.transform(p, lambda x: 1.0 / (1.0 + F.exp(-x)))


def region_decode(p: Column, order: Sequence[int], t: float = 0.5) -> Column:
    """The label of the last region, in ``order``, whose probability exceeds ``t``; 0 if none does."""
    pairs = F.zip_with(p, F.lit(list(order)), lambda x, label: F.struct(x.alias("p"), label.alias("label")))
    return F.aggregate(pairs, F.lit(0), lambda a, x: F.when(x["p"] > t, x["label"]).otherwise(a))


def predict(p: Column, exclusive: bool, t: float = 0.5) -> Column:
    """A label by argmax if classes exclude each other, else a flag for each class at or above ``t``."""
    return argmax(p) if exclusive else F.transform(p, lambda x: (x >= t).cast("int"))


def one_hot(label: Column, classes: int) -> Column:
    """Array of ``classes`` zeros with a one at ``label``."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == label).cast("int"))


def region_channels(label: Column, regions: Sequence[Sequence[int]]) -> Column:
    """A flag for each region: whether the label is one of its labels."""
    return F.array(*[label.isin(*r).cast("int") for r in regions])


def voxel_to_world(index: Column, spacing: Column, origin: Column) -> Column:
    """World coordinates of a voxel."""
    return F.zip_with(F.zip_with(index, spacing, lambda i, s: i * s), origin, lambda a, o: a + o)


def world_to_voxel(point: Column, spacing: Column, origin: Column) -> Column:
    """The voxel nearest to a point (halves to even)."""
    return F.zip_with(F.zip_with(point, origin, lambda p, o: p - o), spacing, lambda d, s: F.bround(d / s).cast("long"))


def in_box(point: Sequence[str], low: Sequence[float], high: Sequence[float]) -> Column:
    """Whether a point lies in a box, the upper bounds excluded."""
    hit = F.lit(True)
    for c, a, b in zip(point, low, high, strict=True):
        hit = hit & (F.col(c) >= a) & (F.col(c) < b)
    return hit


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Whether arrays agree entry by entry within ``atol + rtol * abs(b)``."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)


def new_shape(shape: Column, spacing: Column, target: Column) -> Column:
    """Grid size after resampling: ``size * spacing / target`` rounded, halves to even."""
    ratio = F.zip_with(spacing, target, lambda s, t: s / t)
    return F.zip_with(ratio, shape, lambda r, n: F.bround(r * n).cast("int"))


def anisotropic(spacing: Column, limit: float = 3.0) -> Column:
    """Whether the coarsest axis exceeds the finest by more than ``limit`` times."""
    return F.array_max(spacing) / F.array_min(spacing) > limit


def low_resolution_axes(spacing: Column) -> Column:
    """Indices of the coarsest axes."""
    return F.filter(F.transform(spacing, lambda s, i: F.when(s == F.array_max(spacing), i)), lambda i: i.isNotNull())


def poly_rate(epoch: Column, epochs: int, start: float = 0.01, power: float = 0.9) -> Column:
    """Polynomial learning rate at an epoch."""
    return F.lit(start) * F.pow(1 - epoch / F.lit(float(epochs)), F.lit(power))


def cosine_rate(step: Column, first: int, warmup: int, high: float, low: float) -> Column:
    """Cosine learning rate with a linear warm-up, in cycles of ``first`` steps."""
    at = F.pmod(step, F.lit(first))
    rise = (high - low) * at / F.lit(float(max(warmup, 1))) + low
    fall = low + (high - low) * (1 + F.cos(F.lit(3.141592653589793) * (at - warmup) / F.lit(float(first - warmup)))) / 2
    return F.when(at < warmup, rise).otherwise(fall)


#: Cells of a slice, and entries of its histograms, up to which slices are equalised whole.
SMALL_SLICE = 1 << 15


def _equalized_slices(cells: DataFrame, by: Sequence[str], shape: Sequence[int], tiles: Sequence[int], bins: int, clip: float, across: Sequence[str], value: str) -> DataFrame:
    """:func:`equalize_locally` of small slices, which meet in bins of slices."""
    names, count = cells.columns, int(np.prod(tiles))
    rows = cells.withColumns({"_slice": F.xxhash64(*by), "_v": F.col(value).cast("double")})
    tasks = 8 * int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def solve(slices: np.ndarray, at: np.ndarray, v: np.ndarray, there: np.ndarray) -> np.ndarray:
        """New values of whole slices; NaN where the old one stays."""
        order = np.argsort(slices, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(slices[order]) != 0))
        own = np.empty(len(slices), np.int64)
        own[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(slices))))
        low = np.fmin.reduceat(v[order], first)[own]
        high = np.maximum.reduceat(np.where(there, v, -np.inf)[order], first)[own]
        varied = (high > low) | (np.isnan(high) & ~np.isnan(low))
        with np.errstate(all="ignore"):
            part = np.floor((v - low) / (high - low) * bins)
        part = np.where(there, np.minimum(np.nan_to_num(part, nan=0.0), bins - 1), bins - 1).astype(np.int64)
        tile = np.stack([at[:, k] * tiles[k] // shape[k] for k in (0, 1)], 1)
        counted = varied & ((tile >= 0) & (tile < np.array(tiles))).all(1)
        place = (own * tiles[0] + tile[:, 0]) * tiles[1] + tile[:, 1]
        hist = np.bincount((place * bins + part)[counted], minlength=len(first) * count * bins).reshape(-1, bins).astype(float)
        n = hist.sum(1, keepdims=True)
        limit = np.maximum(1.0, clip * n)
        spare = np.maximum(hist - limit, 0).sum(1, keepdims=True)
        with np.errstate(all="ignore"):
            maps = (np.cumsum(np.minimum(hist, limit), 1) + np.arange(1, bins + 1) * spare / bins) / n
        total, weight = np.zeros(len(v)), np.zeros(len(v))
        near = [(at[:, k] + 0.5) * tiles[k] / shape[k] - 0.5 for k in (0, 1)]
        for s in (0, 1):
            for t in (0, 1):
                to = [np.clip(np.floor(p) + step, 0, tiles[k] - 1).astype(np.int64) for k, (p, step) in enumerate(zip(near, (s, t), strict=True))]
                w = np.prod([1 - np.abs(p - (np.floor(p) + step)) for p, step in zip(near, (s, t), strict=True)], axis=0)
                place = (own * tiles[0] + to[0]) * tiles[1] + to[1]
                known = n[place, 0] > 0
                total += np.where(known, w * np.nan_to_num(maps[place, part]), 0)
                weight += np.where(known, w, 0)
        with np.errstate(all="ignore"):
            return np.where(varied & (weight > 0), total / weight, np.nan)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v, slices = table["_v"].to_numpy().astype(float), table["_slice"].to_numpy()
        at, there = np.stack([table[c].to_numpy() for c in across], 1).astype(np.int64), ~table["_v"].is_null().to_numpy()
        # whole slices, about a million entries of their histograms at once
        few = np.unique(slices, return_inverse=True)[1] // max(1, (1 << 20) // (count * bins))
        new = np.full(len(v), np.nan)
        for k in range(int(few.max()) + 1):
            some = np.flatnonzero(few == k)
            new[some] = solve(slices[some], at[some], v[some], there[some])
        made = pc.if_else(pa.array(np.isnan(new)), table["_v"], pa.array(new))
        return table.set_column(table.schema.get_field_index(value), value, made).select(names)

    kinds = ", ".join(f"`{c}` double" if c == value else f"`{c}` {kind}" for c, kind in cells.dtypes)
    return rows.groupBy(F.pmod("_slice", F.lit(tasks)).alias("_bin")).applyInArrow(run, kinds)


def equalize_locally(cells: DataFrame, by: Sequence[str], shape: Sequence[int], tiles: Sequence[int] = (8, 8), bins: int = 256, clip: float = 0.01, across: Sequence[str] = ("y", "z"), value: str = "value", small: int = SMALL_SLICE) -> DataFrame:
    """``cells(*by, a, b, value)`` with ``value`` equalised within each slice: contrast-limited local histograms, values from 0 to 1.

    A slice's values are scaled by their least and largest. Each of its ``tiles`` has a histogram of ``bins`` parts, of which no part counts for more than ``clip`` of the tile (one cell at least); what is above is
    shared out among all parts. A cell's value is the mean of what the sums of the four tiles around it say of its part, weighed by how near their middles are. Slices of one value stay as they are.

    Slices of shapes, and histograms, of up to ``small`` entries are solved whole, many of them in a task. Of others, tiles are groups of an aggregate and their maps a table of ``tiles * bins`` rows a slice, joined by key; a cell asks for four of them.
    """
    a, b = across
    if max(shape[0] * shape[1], tiles[0] * tiles[1] * bins) <= small:
        return _equalized_slices(cells, by, shape, tiles, bins, clip, across, value)
    facts = with_facts(cells, by, _low=F.min(value), _high=F.max(value))
    scaled = facts.filter("_high > _low").withColumn("_v", (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    scaled = scaled.withColumn("_bin", F.least(F.floor(F.col("_v") * bins), F.lit(bins - 1)))
    tile = lambda c, k: F.floor(F.col(c) * tiles[k] / shape[k])
    hist = scaled.groupBy(*by, tile(a, 0).alias("_ta"), tile(b, 1).alias("_tb"), "_bin").agg(F.count(F.lit(1)).alias("_h"))
    whole = hist.groupBy(*by, "_ta", "_tb").agg(F.sum("_h").alias("_n"))
    key = [*by, "_ta", "_tb"]
    limit = F.greatest(F.lit(1.0), clip * F.col("_n"))
    every = whole.withColumn("_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")))).join(hist, [*key, "_bin"], "left").fillna(0, ["_h"])
    w = W.partitionBy(*key)  # the parts of a tile
    kept, spare = F.least(F.col("_h").cast("double"), limit), F.sum(F.greatest(F.col("_h") - limit, F.lit(0.0))).over(w)
    upto = F.sum(kept).over(w.orderBy("_bin"))
    maps = every.select(*key, "_bin", ((upto + (F.col("_bin") + 1) * spare / bins) / F.col("_n")).alias("_map"))
    # the two tiles before and behind a cell along each axis, and how near it is to the second
    place = lambda c, k: (F.col(c) + 0.5) * tiles[k] / shape[k] - 0.5
    near = lambda c, k: F.array(*[F.struct(F.greatest(F.lit(0).cast("long"), F.least(F.floor(place(c, k)) + s, F.lit(tiles[k] - 1).cast("long"))).alias("t"), (1 - F.abs(place(c, k) - (F.floor(place(c, k)) + s))).alias("w")) for s in (0, 1)])
    asked = scaled.select(*by, a, b, "_bin", F.explode(near(a, 0)).alias("_p"), near(b, 1).alias("_qs")).select(*by, a, b, "_bin", "_p", F.explode("_qs").alias("_q"))
    asked = asked.select(*by, a, b, "_bin", F.col("_p.t").alias("_ta"), F.col("_q.t").alias("_tb"), (F.col("_p.w") * F.col("_q.w")).alias("_w"))
    # tiles at a corner of sparse slices may have no cells of their own: their weight falls to the others
    found = asked.join(maps, [*key, "_bin"]).groupBy(*by, a, b).agg((F.sum(F.col("_w") * F.col("_map")) / F.sum("_w")).alias("_new"))
    return cells.join(found, [*by, a, b], "left").withColumn(value, F.coalesce("_new", F.col(value))).drop("_new")
