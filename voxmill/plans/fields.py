"""Queries over dense grids and distances: centre lines, distance-weighted losses, local contrast, spline resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxmill.operators import losses, resampling, settings, shapes, shared, store, values, workflows
from voxmill.plans.base import VOX, rounded
from voxmill.plans.geometry import _DENSE, SHAPE, _axis, _mask, dense
from voxmill.sources import datasource, tables


def centre_line_dice(spark, d):
    """Centre-line Dice of class 1 of every case."""
    return rounded(shapes.centre_line_dice(_mask(spark, d), _mask(spark, d, "pred = 1")))


def _soft(spark, d):
    """A probability and a truth for each of three classes of every cell of the grid."""
    cells = dense(spark, d).join(tables.voxels(spark, d).select("case_id", "x", "y", "z", "pred"), ["case_id", "x", "y", "z"], "left")
    each = cells.select("case_id", "x", "y", "z", F.col("label").alias("gt"), "pred", F.explode(F.lit([1, 2, 3])).alias("label"))
    p = F.when(F.col("pred") == F.col("label"), 0.55 + F.col("x") * 0.05).otherwise(0.1 + F.col("y") * 0.05)
    return each.select("case_id", "label", "x", "y", "z", p.alias("p"), (F.col("gt") == F.col("label")).cast("int").alias("y01"))


def soft_centre_lines(spark, d):
    """The loss of soft skeletons after two erosions."""
    return rounded(losses.soft_centre_line_loss(_soft(spark, d), "case_id", "label", iterations=2))


def soft_centre_lines_batch(spark, d):
    return rounded(losses.soft_centre_line_loss(_soft(spark, d), "case_id", "label", iterations=2, batch=True))


def hausdorff_losses(spark, d):
    v = tables.voxels(spark, d).select("case_id", "x", "y", "z", "gt", "pred", F.explode(F.lit([1, 2, 3])).alias("label"))
    p = F.when(F.col("pred") == F.col("label"), 0.55 + F.col("x") * 0.05).otherwise(0.1 + F.col("y") * 0.05)
    return rounded(losses.hausdorff_loss(v.select("case_id", "label", "x", "y", "z", p.alias("p"), (F.col("gt") == F.col("label")).cast("int").alias("y01")), "case_id", "label"))


def local_contrast(spark, d):
    """Slices along x with locally equalised histograms: four tiles of 16 parts each."""
    out = values.equalize_locally(dense(spark, d).drop("label"), ["case_id", "x"], SHAPE[1:], (2, 2), 16, 0.1)
    return rounded(out.groupBy("case_id").agg(F.sum("value").alias("total"), F.sum(F.col("value") * (F.col("x") + 1) * (F.col("y") + 2 * F.col("z"))).alias("moment")), 4)


def window_scores(spark, d):
    """Values clipped to a fixed window, scaled and z-scored."""
    rows = tables.read(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice").cast("double") / 20 - 2000).alias("value"))
    out = values.clip_rescale_score(rows, "value", -1000.0, 5000.0, ["o_orderpriority"], "score")
    return rounded(out.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"), F.avg(F.pow("score", F.lit(3.0))).alias("skew")), 4)


def resampled_cubic(spark, d):
    out = resampling.resample(dense(spark, d).drop("label"), SHAPE, (10, 8, 5), (3, 3, 3))
    return rounded(out.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("x") * (F.col("z") + 1)).alias("moment")), 3)


def prepared_cases(spark, d):
    """Cases of two spacings planned and prepared as one dataset."""
    cells = dense(spark, d)
    spacing = F.array(F.lit(1.0), F.lit(1.0), F.when(F.col("case_id") % 3 == 0, 2.0).otherwise(2.5))
    made = workflows.plan_and_preprocess(cells, cells.select("case_id").distinct().select("case_id", spacing.alias("spacing")), order=1)
    image = made.image.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("x") + 1) * (F.col("y") + 1)).alias("moment"))
    return rounded(image.join(made.labels.groupBy("case_id").agg(F.sum(F.col("label") * (F.col("x") + 1)).alias("labels")), "case_id"), 4)


def parsed_cases(spark, d):
    """Raw cases on another grid; every second one has a dense mask."""
    grid = dense(spark, d).drop("label")
    out = workflows.parse_cases(grid, _mask(spark, d, "gt = 1 AND (x + y + z) % 7 = 0"), _mask(spark, d, "gt > 0 AND case_id % 2 = 0"), SHAPE, (10, 8, 5), steps=1)
    return rounded(out.groupBy("case_id").agg(F.sum("value").alias("total"), F.sum("sparse").alias("sparse"), F.sum("dense").alias("dense")), 4)


def training_samples(spark, d):
    out = workflows.training_sample(dense(spark, d), 3.0, 25.0)
    return rounded(out.groupBy("case_id").agg(F.sum("value").alias("total"), F.max("value").alias("top")))


def previous_stage(spark, d):
    """Labels of a coarse stage as a channel of the cells."""
    coarse = resampling.resample_labels(dense(spark, d).drop("value"), SHAPE, (7, 8, 4), (0, 0, 0))
    out = workflows.with_previous_stage(dense(spark, d), coarse, (7, 8, 4), SHAPE)
    return out.groupBy("case_id", "label", "previous").agg(F.count(F.lit(1)).alias("n"))


def instance_files(spark, d):
    """What the metadata files of cases hold, read back from their JSON."""
    v = tables.voxels(spark, d).select("case_id", F.col("gt").cast("int").alias("label"), "x", "y", "z")
    made = settings.instance_metadata(v, names={1: "left", 2: "right"})
    leaves = settings.flattened(made.select("name", "document"), ["name"])
    return leaves.select("name", F.array_join("path", "/").alias("path"), "value")


def merged_plans(spark, d):
    """Two layers of nested settings for every customer, merged by path."""
    c = tables.read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    text = lambda *parts: F.concat(*[F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts])
    first = c.select("c_custkey", text('{"plan": {"batch": ', "$c_nationkey", ', "net": {"depth": 5, "act": "relu"}}, "segment": "', "$c_mktsegment", '", "fold": {"k": 5}}').alias("document"))
    net = F.when(F.col("c_custkey") % 2 == 0, F.lit('{"act": "gelu", "width": [1, 2]}')).otherwise(F.lit("null"))
    second = c.filter("c_custkey % 3 <> 0").select("c_custkey", F.concat(F.lit('{"plan": {"net": '), net, F.lit('}, "fold": "all"}')).alias("document"))
    return settings.merge_documents([first, second], ["c_custkey"])


def volume_boxes(spark, d):
    """Label maps written as volumes and read back from a box of them."""
    v = tables.voxels(spark, d).filter("gt > 0").select("case_id", "x", "y", "z", F.col("gt").cast("int").alias("label"))
    path = f"{shared.folder(spark)}/volumes/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    datasource.write_volumes(v, path, "case_id", SHAPE)
    box = spark.read.format("volume").option("path", path).load().filter("z >= 2 AND z < 6 AND y > 1")
    case = F.regexp_extract("path", r"([^/]+)\.mha$", 1).cast("long")
    return box.groupBy(case.alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("x") + 1)).cast("long").alias("moment"))


def upserted_store(spark, d):
    """A store on disk after two changes: orders by key, some replaced and some deleted."""
    o = tables.read(spark, d, "orders")
    rows = lambda where, value, gone: o.filter(where).select(F.col("o_orderkey").cast("string").alias("key"), value.alias("value"), F.lit(1).cast("long").alias("ord"), gone.alias("deleted"))
    kept = store.Store(spark, f"{shared.folder(spark)}/stores/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}", 16)
    kept.upsert(rows("o_orderkey % 5 <> 0", F.col("o_orderstatus"), F.lit(False)))
    kept.upsert(rows("o_orderkey % 4 = 0", F.concat(F.lit("new "), F.col("o_orderpriority")), F.col("o_orderkey") % 3 == 0))
    return kept.read()


QUERIES = {
    f.__name__: f
    for f in (
        centre_line_dice, soft_centre_lines, soft_centre_lines_batch, hausdorff_losses, local_contrast, window_scores, resampled_cubic, prepared_cases, parsed_cases, training_samples, previous_stage,
        instance_files, merged_plans, volume_boxes, upserted_store,
    )
}


def _soft_lines(iterations: int) -> str:
    """CTEs up to ``sums(case_id, label, hit, lines, found, truth)``: pooling by windows along the axes."""
    key = "case_id, label, side"
    window = ", ".join(f"w{c} AS (PARTITION BY {key}, {', '.join(o for o in 'xyz' if o != c)} ORDER BY {c} RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)" for c in "xyz")
    kept = f"{key}, x, y, z"
    steps = ["i0 AS (SELECT case_id, label, 0 AS side, x, y, z, p AS v FROM s UNION ALL SELECT case_id, label, 1, x, y, z, t FROM s)"]
    for k in range(iterations + 1):
        steps += [
            f"i{k + 1} AS (SELECT {kept}, least(min(v) OVER wx, min(v) OVER wy, min(v) OVER wz) AS v FROM i{k} WINDOW {window})",
            f"dx{k} AS (SELECT {kept}, max(v) OVER wx AS v FROM i{k + 1} WINDOW {window})",
            f"dy{k} AS (SELECT {kept}, max(v) OVER wy AS v FROM dx{k} WINDOW {window})",
            f"dz{k} AS (SELECT {kept}, max(v) OVER wz AS v FROM dy{k} WINDOW {window})",
            f"f{k} AS (SELECT {kept}, greatest(i.v - o.v, 0) AS d FROM i{k} i JOIN dz{k} o USING ({kept}))",
            f"k{k} AS (SELECT {kept}, d AS v FROM f0)" if k == 0 else f"k{k} AS (SELECT {kept}, b.v + greatest(d - b.v * d, 0) AS v FROM k{k - 1} b JOIN f{k} USING ({kept}))",
        ]
    return (
        f"WITH {_DENSE}, "
        "s AS (SELECT case_id, k.label, x, y, z, CASE WHEN pred = k.label THEN 0.55::DOUBLE + x * 0.05::DOUBLE ELSE 0.1::DOUBLE + y * 0.05::DOUBLE END AS p, (d.label = k.label)::INT::DOUBLE AS t "
        "FROM dense d LEFT JOIN vox USING (case_id, x, y, z), (VALUES (1), (2), (3)) k(label)), "
        + ", ".join(steps)
        + f""", sums AS (SELECT case_id, label, sum(v * t) FILTER (side = 0) AS hit, sum(v) FILTER (side = 0) AS lines, sum(v * p) FILTER (side = 1) AS found, sum(v) FILTER (side = 1) AS truth
  FROM k{iterations} JOIN s USING (case_id, label, x, y, z) GROUP BY 1, 2)"""
    )


_HARMONIC = "((hit + 1) / (lines + 1)) * ((found + 1) / (truth + 1)) / ((hit + 1) / (lines + 1) + (found + 1) / (truth + 1))"
_MAP = "least(greatest(floor({c}) + {s}, 0), 1)"

SQL = {
    "soft_centre_lines": _soft_lines(2) + f" SELECT case_id, round(-avg({_HARMONIC}), 6) AS loss FROM sums GROUP BY 1",
    "soft_centre_lines_batch": _soft_lines(2) + f" SELECT round(-avg({_HARMONIC}), 6) AS loss FROM (SELECT label, sum(hit) AS hit, sum(lines) AS lines, sum(found) AS found, sum(truth) AS truth FROM sums GROUP BY 1)",
    "hausdorff_losses": f"""
WITH {VOX},
s AS (SELECT case_id, label, x, y, z, CASE WHEN pred = label THEN 0.55::DOUBLE + x * 0.05::DOUBLE ELSE 0.1::DOUBLE + y * 0.05::DOUBLE END AS p, (gt = label)::INT AS t FROM vox, (VALUES (1), (2), (3)) k(label)),
m AS (SELECT case_id, label, x, y, z, 'p' AS m, p > 0.5 AS o FROM s UNION ALL SELECT case_id, label, x, y, z, 't', t > 0 FROM s),
f AS (SELECT a.case_id, a.label, a.x, a.y, a.z, a.m, a.o, min((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d
  FROM m a JOIN m b ON a.case_id = b.case_id AND a.label = b.label AND a.m = b.m AND a.o <> b.o GROUP BY ALL),
w AS (SELECT case_id, label, x, y, z, coalesce(sum(d) FILTER (o = (m = 'p')), 0) AS fg, coalesce(sum(d) FILTER (o <> (m = 'p')), 0) AS bg FROM f GROUP BY ALL),
e AS (SELECT s.case_id, (p - t) ** 2 AS e, coalesce(fg, 0) AS fg, coalesce(bg, 0) AS bg FROM s LEFT JOIN w USING (case_id, label, x, y, z))
SELECT case_id, round(coalesce(0.5 * (avg(e * fg) FILTER (fg <> 0) + avg(e * bg) FILTER (bg <> 0)), 0), 6) AS loss FROM e GROUP BY 1""",
    "local_contrast": f"""
WITH {_DENSE}, f AS (SELECT case_id, x, min(value) AS lo, max(value) AS hi FROM dense GROUP BY 1, 2),
v AS (SELECT case_id, x, y, z, floor((y * 2) / 8)::BIGINT AS ta, floor((z * 2) / 8)::BIGINT AS tb, least(floor((value - lo) / (hi - lo) * 16), 15)::BIGINT AS b FROM dense JOIN f USING (case_id, x) WHERE hi > lo),
h AS (SELECT case_id, x, ta, tb, q.b, count(*) FILTER (v.b = q.b) AS h, count(*) AS n FROM v, range(16) q(b) GROUP BY ALL),
c AS (SELECT *, least(h, greatest(1.0, 0.1::DOUBLE * n)) AS kept, greatest(h - greatest(1.0, 0.1::DOUBLE * n), 0) AS spare FROM h),
m AS (SELECT case_id, x, ta, tb, b, (sum(kept) OVER (PARTITION BY case_id, x, ta, tb ORDER BY b) + (b + 1) * sum(spare) OVER (PARTITION BY case_id, x, ta, tb) / 16) / n AS m FROM c),
p AS (SELECT case_id, x, y, z, b, (y + 0.5::DOUBLE) * 2 / 8 - 0.5 AS py, (z + 0.5::DOUBLE) * 2 / 8 - 0.5 AS pz FROM v),
a AS (SELECT p.*, {_MAP.format(c="py", s="i")}::BIGINT AS ta, {_MAP.format(c="pz", s="j")}::BIGINT AS tb, (1 - abs(py - floor(py) - i)) * (1 - abs(pz - floor(pz) - j)) AS w FROM p, range(2) q(i), range(2) r(j)),
n AS (SELECT case_id, x, y, z, sum(w * m) / sum(w) AS new FROM a JOIN m USING (case_id, x, ta, tb, b) GROUP BY ALL),
o AS (SELECT case_id, x, y, z, coalesce(new, value) AS value FROM dense LEFT JOIN n USING (case_id, x, y, z))
SELECT case_id, round(sum(value), 4) AS total, round(sum(value * (x + 1) * (y + 2 * z)), 4) AS moment FROM o GROUP BY 1""",
    "window_scores": """
WITH v AS (SELECT o_orderpriority, (least(greatest(o_totalprice::DOUBLE / 20 - 2000, -1000), 5000) + 1000) / 6000 AS v FROM orders),
f AS (SELECT o_orderpriority, avg(v) AS m, stddev_pop(v) AS s FROM v GROUP BY 1), z AS (SELECT o_orderpriority, (v - m) / greatest(s, 1e-8) AS z FROM v JOIN f USING (o_orderpriority))
SELECT o_orderpriority, count(*) AS n, round(min(z), 4) AS low, round(max(z), 4) AS high, round(avg(z ** 3), 4) AS skew FROM z GROUP BY 1""",
}


def _spline(table: str, axis: str, old: int, new: int) -> str:
    """A table with one axis resampled by a cubic spline through cells that go on beyond the ends: the spline's coefficients are a sum over all cells that falls off by the root of its filter."""
    rest = ", ".join(c for c in "xyz" if c != axis)
    at = f"((i + 0.5::DOUBLE) * {old} / {new} - 0.5)"
    t = f"abs({at} - m)"
    hat = f"CASE WHEN {t} < 1 THEN 2 / 3.0::DOUBLE - {t} ** 2 + {t} ** 3 / 2 WHEN {t} < 2 THEN (2 - {t}) ** 3 / 6 ELSE 0 END"
    weights = f"SELECT i, least(greatest(k, 0), {old - 1}) AS j, sum({hat} * sqrt(3.0::DOUBLE) * pow(sqrt(3.0::DOUBLE) - 2, abs(m - k))) AS w FROM range({new}) a(i), range(-3, {old + 3}) b(m), range(-40, {old + 40}) c(k) GROUP BY 1, 2"
    return f"SELECT case_id, {rest}, w.i AS {axis}, sum(value * w) AS value FROM {table} JOIN ({weights}) w ON {axis} = w.j GROUP BY ALL"


SQL["resampled_cubic"] = (
    f"WITH {_DENSE}, a AS ({_spline('dense', 'x', 7, 10)}), b AS ({_spline('a', 'z', 8, 5)}) SELECT case_id, count(*) AS n, round(sum(value), 3) AS total, round(sum(value * x * (z + 1)), 3) AS moment FROM b GROUP BY 1"
)
SQL |= {
    "prepared_cases": f"""
WITH {_DENSE}, b AS (SELECT case_id, min(x) AS x0, min(y) AS y0, min(z) AS z0, max(x) AS x1, max(y) AS y1, max(z) AS z1 FROM dense WHERE value <> 0 GROUP BY 1),
s AS (SELECT *, z1 - z0 + 1 AS o, CASE WHEN case_id % 3 = 0 THEN 2.0::DOUBLE ELSE 2.5::DOUBLE END AS sp FROM b), t AS (SELECT quantile_cont(sp, 0.5) AS t FROM s),
q AS (SELECT case_id, x0, y0, z0, x1, y1, z1, o, greatest(round_even(o * sp / t, 0), 1)::BIGINT AS n FROM s, t),
c AS (SELECT case_id, x - x0 AS x, y - y0 AS y, z - z0 AS z, value, label, o, n FROM dense JOIN q USING (case_id) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND z BETWEEN z0 AND z1),
f AS (SELECT case_id, avg(value) AS m, greatest(stddev_pop(value), 1e-8) AS d FROM c GROUP BY 1),
w AS (SELECT case_id, i, z, greatest(0, 1 - abs(least(greatest((i + 0.5::DOUBLE) * o / n - 0.5, 0), o - 1) - z)) AS w FROM q, range(20) a(i), range(8) k(z) WHERE i < n AND z < o),
r AS (SELECT case_id, i, x, y, sum(w * (value - m) / d) AS v FROM c JOIN f USING (case_id) JOIN w USING (case_id, z) GROUP BY ALL),
h AS (SELECT case_id, i, x, y, label, sum(w) AS w FROM c JOIN w USING (case_id, z) GROUP BY ALL),
l AS (SELECT case_id, i, x, y, coalesce(max(label) FILTER (w >= 0.5 - 1e-9), 0) AS label FROM h GROUP BY ALL)
SELECT case_id, a.n, a.moment, b.labels FROM (SELECT case_id, count(*) AS n, round(sum(v * (i + 1) * (x + 1)), 4) AS moment FROM r GROUP BY 1) a
JOIN (SELECT case_id, sum(label * (i + 1))::BIGINT AS labels FROM l GROUP BY 1) b USING (case_id)""",
    "parsed_cases": f"""
WITH {_DENSE}, o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i)),
s AS (SELECT DISTINCT case_id, x + dx AS x, y + dy AS y, z + dz AS z, 1.0::DOUBLE AS value FROM vox, o WHERE gt = 1 AND (x + y + z) % 7 = 0 AND x + dx BETWEEN 0 AND 6 AND y + dy BETWEEN 0 AND 7 AND z + dz BETWEEN 0 AND 7),
q AS (SELECT case_id, x, y, z, 1.0::DOUBLE AS value FROM vox WHERE gt > 0 AND case_id % 2 = 0),
a1 AS ({_axis('dense', 'x', 7, 10)}), a2 AS ({_axis('a1', 'z', 8, 5)}), s1 AS ({_axis('s', 'x', 7, 10)}), s2 AS ({_axis('s1', 'z', 8, 5)}), q1 AS ({_axis('q', 'x', 7, 10)}), q2 AS ({_axis('q1', 'z', 8, 5)})
SELECT a2.case_id, round(sum(a2.value), 4) AS total, count(*) FILTER (s2.value > 0.5 + 1e-9) AS sparse, CASE WHEN a2.case_id IN (SELECT case_id FROM q) THEN count(*) FILTER (q2.value > 0.5 + 1e-9) END AS dense
FROM a2 LEFT JOIN s2 USING (case_id, x, y, z) LEFT JOIN q2 USING (case_id, x, y, z) GROUP BY a2.case_id""",
    "training_samples": f"""
WITH {_DENSE}, v AS (SELECT case_id, (least(greatest(value, 3), 25) - 3) / 22 AS v FROM dense), f AS (SELECT case_id, min(v) AS lo, max(v) AS hi FROM v GROUP BY 1)
SELECT case_id, round(sum(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END), 6) AS total, round(max(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END), 6) AS top FROM v JOIN f USING (case_id) GROUP BY 1""",
    "previous_stage": f"""
WITH {_DENSE}, c AS (SELECT case_id, label, x, y, i AS z, 1.0::DOUBLE AS share FROM dense JOIN range(4) a(i) ON z = least(floor((i + 0.5::DOUBLE) * 8 / 4 - 0.5 + 0.5), 7)), f AS ({_axis('c', 'z', 4, 8, value='share', by='case_id, label')}),
l AS (SELECT case_id, x, y, z, coalesce(max(label) FILTER (share >= 0.5 - 1e-9), 0) AS previous FROM f GROUP BY ALL)
SELECT case_id, label, previous, count(*) AS n FROM dense JOIN l USING (case_id, x, y, z) GROUP BY ALL""",
    "instance_files": f"""
WITH {VOX}, g AS (SELECT case_id, CASE gt WHEN 1 THEN 'left' WHEN 2 THEN 'right' ELSE 'label_' || gt END AS k, count(*) AS n, min(x) AS a, min(y) AS b, min(z) AS c, max(x) + 1 AS d, max(y) + 1 AS e, max(z) + 1 AS f,
  round(avg(x), 4) AS u, round(avg(y), 4) AS v, round(avg(z), 4) AS w FROM vox WHERE gt <> 0 GROUP BY case_id, gt)
SELECT case_id || '_instances.json' AS name, 'instances/' || k || '/' || m.p AS path, m.v AS value FROM (SELECT case_id, k, unnest([
  struct_pack(p := 'voxels', v := n::VARCHAR), struct_pack(p := 'low', v := '[' || a || ',' || b || ',' || c || ']'), struct_pack(p := 'high', v := '[' || d || ',' || e || ',' || f || ']'),
  struct_pack(p := 'centroid', v := '[' || regexp_replace(u::VARCHAR, '\\.0$', '') || ',' || regexp_replace(v::VARCHAR, '\\.0$', '') || ',' || regexp_replace(w::VARCHAR, '\\.0$', '') || ']')]) AS m FROM g)""",
    "merged_plans": """
SELECT c_custkey, '{"fold":' || CASE WHEN c_custkey % 3 <> 0 THEN '"all"' ELSE '{"k":5}' END || ',"plan":{"batch":' || c_nationkey || ',"net":'
  || CASE WHEN c_custkey % 3 = 0 THEN '{"act":"relu","depth":5}' WHEN c_custkey % 2 = 0 THEN '{"act":"gelu","depth":5,"width":[1,2]}' ELSE 'null' END || '},"segment":"' || c_mktsegment || '"}' AS document FROM customer""",
    "volume_boxes": f"WITH {VOX} SELECT case_id, count(*) AS n, sum(gt * (x + 1))::BIGINT AS moment FROM vox WHERE gt > 0 AND z BETWEEN 2 AND 5 AND y > 1 GROUP BY 1",
    "upserted_store": """
SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'new ' || o_orderpriority ELSE o_orderstatus END AS value FROM orders
WHERE CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 <> 0 ELSE o_orderkey % 5 <> 0 END""",
}
