"""Value maps, joins, selections, tiles, components and surfaces over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import components, curves, pairing, paths, selection, surface, tiling, values, workflows
from voxmill.plans.base import VOX, rounded
from voxmill.sources import manifest, tables

read = tables.read


def _mask(spark, d, where="gt = 1"):
    return tables.voxels(spark, d).filter(where).select("case_id", "x", "y", "z")


def _joined(array):
    return F.array_join(F.transform(array, lambda v: v.cast("string")), ",")


# -- value maps


def clip_scale(spark, d):
    v = F.col("l_extendedprice").cast("double")
    out = read(spark, d, "lineitem").select("l_returnflag", values.rescale(v, 1000, 50000).alias("a"), values.to_uint8(v, 1000, 50000).alias("b"), values.threshold(v, 30000.0).alias("c"))
    return rounded(out.groupBy("l_returnflag").agg(F.avg("a").alias("scaled"), F.sum("b").cast("long").alias("bytes"), F.sum("c").cast("long").alias("above")))


def _orders(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("v"))


def min_max(spark, d):
    return rounded(values.min_max(_orders(spark, d), "v", ["o_orderpriority"], "scaled").groupBy("o_orderpriority").agg(F.avg("scaled").alias("mean"), F.max("scaled").alias("high")))


def z_score_masked(spark, d):
    scored = values.z_score(_orders(spark, d), "v", ["o_orderpriority"], "z", inside=F.col("o_orderkey") % 2 == 0)
    return rounded(scored.groupBy("o_orderpriority").agg(F.max("z").alias("high"), F.min("z").alias("low"), F.avg(F.abs("z")).alias("spread")), 4)


def ct_norm(spark, d):
    from voxmill.operators import summary

    orders = _orders(spark, d)
    prints = summary.fingerprint(orders, ["o_orderpriority"], "v")
    scored = values.ct_normalise(orders, prints, "v", ["o_orderpriority"], "z")
    return rounded(scored.groupBy("o_orderpriority").agg(F.max("z").alias("high"), F.min("z").alias("low"), F.avg("z").alias("mean")), 4)


def relabel(spark, d):
    v = tables.voxels(spark, d)
    mapped = v.select(values.relabel(F.col("gt"), {1: 10, 2: 20}).alias("kept"), values.relabel(F.col("gt"), {1: 10, 2: 20}, others=0).alias("dropped"))
    return mapped.groupBy("kept", "dropped").agg(F.count(F.lit(1)).alias("n"))


def encodings(spark, d):
    gt = F.col("gt").cast("int")
    rows = tables.voxels(spark, d).select(_joined(values.one_hot(gt, 4)).alias("one_hot"), _joined(values.region_channels(gt, [(1, 2), (1,)])).alias("regions"))
    return rows.groupBy("one_hot", "regions").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("p"))


def argmax_label(spark, d):
    return _vectors(spark, d).select("vec_id", values.argmax(F.col("p")).alias("top"))


def softmax_sigmoid(spark, d):
    text = lambda p: F.array_join(F.transform(p, lambda x: F.format_string("%.4f", x)), ",")
    return _vectors(spark, d).select("vec_id", text(values.softmax(F.col("p"))).alias("softmax"), text(values.sigmoid(F.col("p"))).alias("sigmoid"))


def region_decode(spark, d):
    return _vectors(spark, d).select("vec_id", values.region_decode(F.col("p"), [(7 * k) % 64 + 1 for k in range(64)], 0.2).alias("label"))


def ensemble_mean(spark, d):
    means = tiling.mean_vectors(_vectors(spark, d), ["label"], "p")
    return rounded(means.select("label", values.argmax(F.col("p")).alias("top"), F.posexplode("p").alias("axis", "mean")))


def learning_rates(spark, d):
    """Rates at the epochs that a log of steps names, and its steps."""
    epochs = read(spark, d, "orders").groupBy((F.col("o_orderkey") % 101).alias("epoch")).agg(F.count(F.lit(1)).alias("steps"))
    return rounded(epochs.select("epoch", "steps", values.poly_rate(F.col("epoch"), 100).alias("poly"), values.cosine_rate(F.col("epoch"), 20, 5, 0.1, 0.001).alias("cosine")))


def new_shapes(spark, d):
    part = read(spark, d, "part").select("p_partkey", F.array((F.col("p_partkey") % 90 + 10).cast("int"), F.lit(64)).alias("shape"), F.array(F.col("p_size").cast("double"), F.lit(4.0)).alias("spacing"))
    shape = values.new_shape(F.col("shape"), F.col("spacing"), F.lit([2.0, 3.0]))
    return part.select("p_partkey", shape[0].alias("nx"), shape[1].alias("ny"), values.anisotropic(F.col("spacing")).alias("anisotropic"), _joined(values.low_resolution_axes(F.col("spacing"))).alias("coarse"))


# -- names and manifests


def file_names(spark, d):
    key = F.lpad(F.col("p_partkey").cast("string"), 4, "0")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("in/P_"), key, F.lit("_0000.mha"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("in/P_"), key, F.lit(".nii.gz"))).otherwise(F.concat(F.lit("in/P_"), key, F.lit("_3.mha")))
    rows = read(spark, d, "part").select("p_partkey", paths.base_name(name).alias("name"))
    split = rows.select("*", paths.split_suffix(F.col("name")).alias("s"), paths.case_and_index(F.col("name")).alias("c"))
    return split.select("p_partkey", "s.stem", "s.suffix", "c.base", "c.idx", paths.ground_truth_name(F.col("name")).alias("truth"), paths.drop_last_token(F.col("s.stem")).alias("dropped"))


def experiment_names(spark, d):
    made = paths.experiment_id(F.lit("trainer"), F.col("p_brand"), F.concat(F.lit("cfg"), F.col("p_size").cast("string")))
    rows = read(spark, d, "part").select("p_partkey", made.alias("name"))
    path = F.concat(paths.dataset_prefix(F.col("p_partkey") % 1000), F.lit("_X/"), F.col("name"), F.lit("/fold_1"))
    parsed = rows.select("p_partkey", paths.parse_experiment_id(F.col("name")).alias("e"), paths.parse_experiment_path(path).alias("p"), paths.ensemble_name(F.lit("a"), F.col("name"), F.lit("0_1")).alias("ensemble"))
    return parsed.select("p_partkey", "e.plans", "e.config", "p.dataset", "p.fold", paths.dataset_id(F.col("p.dataset")).alias("number"), "ensemble", paths.parse_ensemble_name(F.col("ensemble"))["folds"].alias("folds"))


def manifest_mapping(spark, d):
    """Manifests of one job each, built from supplier rows; entries without outputs are skipped."""
    k = F.col("s_suppkey").cast("string")
    out = F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit('{"image":{"pk":"o'), k, F.lit('"}}')))
    text = F.concat(F.lit('[{"pk":"j'), k, F.lit('","inputs":[{"image":{"name":"P'), k, F.lit('_0000.mha"}}],"outputs":['), out, F.lit("]}]"))
    entries = manifest.parse_manifest(read(spark, d, "supplier").select(text.alias("json")), "json")
    return manifest.mapping(entries, results=False).select("prediction", "input")


# -- joins and sets


def path_fallback(spark, d):
    names = read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"))
    exact = read(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("path"))
    mha = read(spark, d, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(".mha")).alias("path"))
    return pairing.first_existing(names, exact.unionByName(mha), "name", [F.col("name"), F.concat("name", F.lit(".mha"))], F.concat(F.lit("none/"), F.col("name")))


def missing_predictions(spark, d):
    late = read(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return pairing.missing(read(spark, d, "orders").select("o_orderkey"), late, ["o_orderkey"]).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


def fold_overlap(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", F.col("l_linenumber").alias("fold"))
    return pairing.in_several(rows, "l_partkey", "fold")


def missing_by_model(spark, d):
    nations, regions = read(spark, d, "nation").select(F.col("n_name").alias("file")), read(spark, d, "region").select(F.col("r_name").alias("model"))
    there = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("file"), F.col("r_name").alias("model"))
    return pairing.missing_by_model(nations, regions, there)


def restricted(spark, d):
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    wanted, broken = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return pairing.restricted(orders, wanted, broken, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def nearest_slice(spark, d):
    v = tables.voxels(spark, d)
    asked = spark.range(0, 7).select(F.col("id").alias("at")).crossJoin(v.select("case_id").distinct())
    there = v.filter("gt = 1 AND x % 3 <> 1").select("case_id", "x").distinct()
    return pairing.nearest_value(asked, there, ["case_id"], "at", "x")


def merged_store(spark, d):
    a = read(spark, d, "nation").select(F.col("n_regionkey").alias("key"), F.lit("old").alias("value")).distinct()
    b = read(spark, d, "region").filter("r_regionkey <> 2").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return pairing.merged_store([a, b])


def channels(spark, d):
    names = read(spark, d, "lineitem").select(F.concat(F.lit("case"), F.col("l_suppkey").cast("string"), F.lit("_"), F.lpad((F.col("l_linenumber") - 1).cast("string"), 4, "0"), F.lit(".nii.gz")).alias("name")).distinct()
    return pairing.channels_of_case(names).select("case", F.array_join("images", "|").alias("images"))


# -- choosing rows


def _chosen(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 3).alias("parts"))
    return workflows.pseudo_labels(c, "c_custkey", "c_acctbal", "parts", 1000.0, 2, 50)


def reliable_select(spark, d):
    return _chosen(spark, d)[0].select("c_custkey", F.round("c_acctbal", 2).cast("double").alias("score"))


def unreliable_rest(spark, d):
    return _chosen(spark, d)[1].select("c_custkey")


def fullest_slice(spark, d):
    return selection.fullest_slice(_mask(spark, d), "z")


def even_clicks(spark, d):
    clicks = selection.even_clicks(_mask(spark, d), 5)
    return clicks.select("case_id", "ord", "x", F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"))


def click_prefixes(spark, d):
    rank = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
    clicks = read(spark, d, "events").select("user_id", "event_id", F.expr(rank).alias("ord")).filter("ord < 5")
    return curves.click_prefixes(clicks, ["user_id"]).groupBy("user_id", "n_clicks").agg(F.count("event_id").alias("n"), F.max("event_id").alias("last"))


def strided_shard(spark, d):
    return curves.shard(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey", 3, 1, ["s_nationkey"])


def hash_folds(spark, d):
    return selection.hash_folds(read(spark, d, "documents").select("doc_id"), ["doc_id"], 5, 12345).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


# -- geometry, tiles, components


def boxes(spark, d):
    cells = _mask(spark, d)
    return rounded(surface.bounding_box(cells).join(surface.centroid(cells), "case_id"))


def border_voxels(spark, d):
    return surface.border(_mask(spark, d)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def dilated(spark, d):
    return surface.dilate(_mask(spark, d), (7, 8, 8)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def eroded(spark, d):
    return surface.erode(_mask(spark, d, "gt >= 0")).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def surface_distances(spark, d):
    return rounded(surface.surface_distances(tables.voxels(spark, d), (1, 2, 3), (7, 8, 8)))


def cropped(spark, d):
    cells = tables.voxels(spark, d)
    box = surface.bounding_box(cells.filter("gt = 1 AND x BETWEEN 1 AND 4"))
    return surface.crop_to_box(cells, box).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"))


def resampled(spark, d):
    cells = tables.voxels(spark, d).select("case_id", "x", "y", "z", "gt")
    return tiling.resample_nearest(cells, (7, 8, 8), (14, 16, 4)).groupBy("case_id", "gt").agg(F.count(F.lit(1)).alias("n"))


def tile_grid(spark, d):
    """Tiles of a grid for every part, whose shape follows from its size and key."""
    part = read(spark, d, "part")
    shapes = part.select(F.col("p_partkey").alias("case_id"), (F.col("p_size") + 20).cast("int").alias("nx"), (F.col("p_partkey") % 60 + 40).cast("int").alias("ny"), F.lit(33).alias("nz"))
    return tiling.tiles(shapes, (32, 64, 32), 0.5)


def tile_merge(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("case_id"), F.col("l_linenumber").alias("x"), F.col("l_discount").cast("double").alias("p"), F.col("l_quantity").cast("double").alias("w"))
    return rounded(tiling.merge_tiles(rows, ["case_id", "x"]))


def _labelled(spark, d):
    return components.label_components(_mask(spark, d), connectivity=6)


def component_count(spark, d):
    return components.component_count(_labelled(spark, d))


def largest_component(spark, d):
    return components.keep_largest(_labelled(spark, d)).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def small_removed(spark, d):
    return components.drop_small(_labelled(spark, d), 3).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def triage(spark, d):
    return components.triage(_labelled(spark, d), expected=20)


def threshold_search(spark, d):
    sizes = tables.voxels(spark, d).groupBy("case_id").agg(F.count(F.when(F.col("pred") == 1, 1)).alias("size"), (F.count(F.when(F.col("gt") == 1, 1)) > 80).alias("present"))
    return components.threshold_search(sizes, range(0, 200, 5))


def verify_labels(spark, d):
    out = workflows.unexpected_labels(tables.voxels(spark, d), [0, 1, 2])
    return out.select("case_id", _joined(F.col("labels")).alias("labels"), _joined(F.col("unexpected")).alias("unexpected"))


QUERIES = {
    f.__name__: f
    for f in (
        clip_scale, min_max, z_score_masked, ct_norm, relabel, encodings, argmax_label, softmax_sigmoid, region_decode, ensemble_mean, learning_rates, new_shapes, file_names, experiment_names, manifest_mapping, path_fallback,
        missing_predictions, fold_overlap, missing_by_model, restricted, nearest_slice, merged_store, channels, reliable_select, unreliable_rest, fullest_slice, even_clicks, click_prefixes, strided_shard, hash_folds, boxes,
        border_voxels, dilated, eroded, surface_distances, cropped, resampled, tile_grid, tile_merge, component_count, largest_component, small_removed, triage, threshold_search, verify_labels,
    )
}

_ORD = "SELECT o_orderpriority, o_orderkey, o_totalprice::DOUBLE AS v FROM orders"
_M = f"WITH {VOX}, m AS (SELECT case_id, x, y, z FROM vox WHERE gt = 1)"
_VEC = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS p FROM embeddings)"
_BALL = "o AS (SELECT a.i AS dx, b.i AS dy, c.i AS dz FROM range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i))"
_FACES = "o(dx, dy, dz) AS (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))"
_COMP = f"""
WITH RECURSIVE {VOX}, m AS (SELECT case_id, x, y, z, x * 64 + y * 8 + z AS id FROM vox WHERE gt = 1),
e AS (SELECT a.case_id, a.id AS a, b.id AS b FROM m a JOIN m b ON a.case_id = b.case_id AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1),
r AS (SELECT case_id, id AS a, id AS b FROM m UNION SELECT r.case_id, r.a, e.b FROM r JOIN e ON r.case_id = e.case_id AND r.b = e.a),
c AS (SELECT case_id, a AS id, min(b) AS root FROM r GROUP BY 1, 2),
s AS (SELECT case_id, root, count(*) AS n FROM c GROUP BY 1, 2)
"""

_PAD = "lpad(p_partkey::VARCHAR, 4, '0')"

SQL = {
    "clip_scale": "SELECT l_returnflag, round(avg((v - 1000) / 49000), 6) AS scaled, sum(floor(255 * (v - 1000) / 49000))::BIGINT AS bytes, count(*) FILTER (WHERE p > 30000) AS above FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS p, least(greatest(l_extendedprice::DOUBLE, 1000), 50000) AS v FROM lineitem) GROUP BY 1",
    "min_max": f"SELECT o_orderpriority, round(avg(s), 6) AS mean, round(max(s), 6) AS high FROM (SELECT o_orderpriority, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS s FROM ({_ORD}) WINDOW w AS (PARTITION BY o_orderpriority)) GROUP BY 1",
    "z_score_masked": f"""
WITH o AS ({_ORD}), f AS (SELECT o_orderpriority, avg(v) AS m, stddev_pop(v) AS s FROM o WHERE o_orderkey % 2 = 0 GROUP BY 1),
z AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN (v - m) / s ELSE 0 END AS z FROM o JOIN f USING (o_orderpriority))
SELECT o_orderpriority, round(max(z), 4) AS high, round(min(z), 4) AS low, round(avg(abs(z)), 4) AS spread FROM z GROUP BY 1""",
    "ct_norm": f"""
WITH o AS ({_ORD}), f AS (SELECT o_orderpriority, avg(v) AS m, stddev_pop(v) AS s, quantile_cont(v, 0.005) AS a, quantile_cont(v, 0.995) AS b FROM o GROUP BY 1),
z AS (SELECT o_orderpriority, (least(greatest(v, a), b) - m) / s AS z FROM o JOIN f USING (o_orderpriority))
SELECT o_orderpriority, round(max(z), 4) AS high, round(min(z), 4) AS low, round(avg(z), 4) AS mean FROM z GROUP BY 1""",
    "relabel": f"WITH {VOX} SELECT CASE gt WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE gt END::BIGINT AS kept, CASE gt WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 0 END::BIGINT AS dropped, count(*) AS n FROM vox GROUP BY 1, 2",
    "encodings": f"WITH {VOX} SELECT concat_ws(',', (gt = 0)::INT, (gt = 1)::INT, (gt = 2)::INT, (gt = 3)::INT) AS one_hot, concat_ws(',', (gt IN (1, 2))::INT, (gt = 1)::INT) AS regions, count(*) AS n FROM vox GROUP BY 1, 2",
    "argmax_label": f"{_VEC} SELECT vec_id, (list_position(p, list_max(p)) - 1)::INTEGER AS top FROM e",
    "softmax_sigmoid": f"""{_VEC}, s AS (SELECT vec_id, p, list_transform(p, lambda x: exp(x - list_max(p))) AS e FROM e)
SELECT vec_id, array_to_string(list_transform(e, lambda x: printf('%.4f', x / list_sum(e))), ',') AS softmax, array_to_string(list_transform(p, lambda x: printf('%.4f', 1 / (1 + exp(-x)))), ',') AS sigmoid FROM s""",
    "region_decode": f"{_VEC} SELECT vec_id, coalesce(list_extract(list_filter(list_transform(range(1, 65), lambda i: CASE WHEN p[i] > 0.2 THEN (7 * (i - 1)) % 64 + 1 END), lambda x: x IS NOT NULL), -1), 0)::INTEGER AS label FROM e",
    "ensemble_mean": f"""{_VEC}, u AS (SELECT label, unnest(p) AS v, unnest(range(64)) AS axis FROM e), a AS (SELECT label, axis, avg(v) AS v FROM u GROUP BY 1, 2)
SELECT label, (arg_max(axis, v) OVER (PARTITION BY label))::INTEGER AS top, axis::INTEGER AS axis, round(v, 6) AS mean FROM a""",
    "learning_rates": """
SELECT e AS epoch, steps, round(0.01::DOUBLE * pow(1 - e / 100.0::DOUBLE, 0.9::DOUBLE), 6) AS poly,
       round(CASE WHEN e % 20 < 5 THEN (0.1::DOUBLE - 0.001::DOUBLE) * (e % 20) / 5.0::DOUBLE + 0.001::DOUBLE ELSE 0.001::DOUBLE + 0.099::DOUBLE * (1 + cos(pi() * (e % 20 - 5) / 15.0::DOUBLE)) / 2 END, 6) AS cosine
FROM (SELECT o_orderkey % 101 AS e, count(*) AS steps FROM orders GROUP BY 1)""",
    "new_shapes": """
SELECT p_partkey, round_even((p_size / 2.0::DOUBLE) * (p_partkey % 90 + 10), 0)::INTEGER AS nx, round_even((4.0::DOUBLE / 3.0::DOUBLE) * 64, 0)::INTEGER AS ny,
       greatest(p_size, 4) / least(p_size, 4)::DOUBLE > 3 AS anisotropic, CASE WHEN p_size > 4 THEN '0' WHEN p_size < 4 THEN '1' ELSE '0,1' END AS coarse FROM part""",
    "file_names": f"""
WITH n AS (SELECT p_partkey, {_PAD} AS k, p_partkey % 3 AS t FROM part)
SELECT p_partkey, 'P_' || k || CASE t WHEN 0 THEN '_0000' WHEN 1 THEN '' ELSE '_3' END AS stem, CASE t WHEN 1 THEN '.nii.gz' ELSE '.mha' END AS suffix,
       CASE t WHEN 1 THEN 'P' ELSE 'P_' || k END AS base, CASE t WHEN 0 THEN 0 WHEN 1 THEN k::INTEGER ELSE 3 END::INTEGER AS idx,
       CASE t WHEN 2 THEN 'P_' || k || '_3.mha' ELSE 'P_' || k || '.mha' END AS truth, CASE t WHEN 1 THEN 'P' ELSE 'P_' || k END AS dropped FROM n""",
    "experiment_names": """
WITH n AS (SELECT p_partkey, p_brand AS plans, 'cfg' || p_size AS config, (p_partkey % 1000)::INTEGER AS number FROM part)
SELECT p_partkey, plans, config, 'Dataset' || lpad(number::VARCHAR, 3, '0') || '_X' AS dataset, '1' AS fold, number, 'ensemble___a___trainer__' || plans || '__' || config || '___0_1' AS ensemble, '0_1' AS folds FROM n""",
    "manifest_mapping": "SELECT 'j' || s_suppkey || '/output/o' || s_suppkey AS prediction, 'P' || s_suppkey || '_0000.mha' AS input FROM supplier WHERE s_suppkey % 4 <> 0",
    "path_fallback": "SELECT p_partkey::VARCHAR AS name, CASE WHEN s_suppkey IS NULL THEN 'none/' || p_partkey WHEN s_suppkey % 2 = 0 THEN s_suppkey::VARCHAR ELSE s_suppkey || '.mha' END AS found FROM part LEFT JOIN supplier ON p_partkey = s_suppkey",
    "missing_predictions": "SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "fold_overlap": "SELECT l_partkey, count(DISTINCT l_linenumber) AS folds FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) > 1",
    "missing_by_model": "SELECT n_name AS file, r_name AS model FROM nation, region WHERE n_regionkey <> r_regionkey",
    "restricted": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1",
    "nearest_slice": f"""WITH {VOX}, a AS (SELECT case_id, i AS "at" FROM (SELECT DISTINCT case_id FROM vox), range(0, 7) t(i)), t AS (SELECT DISTINCT case_id, x FROM vox WHERE gt = 1 AND x % 3 <> 1)
SELECT a.case_id, a."at", arg_min(x, abs(x - a."at") * 100 + x) AS near FROM a LEFT JOIN t ON a.case_id = t.case_id GROUP BY 1, 2""",
    "merged_store": "SELECT r_regionkey AS key, CASE WHEN r_regionkey = 2 THEN 'old' ELSE r_name END AS value FROM region",
    "channels": "SELECT 'case' || l_suppkey AS \"case\", string_agg('case' || l_suppkey || '_000' || c || '.nii.gz', '|' ORDER BY c) AS images FROM (SELECT DISTINCT l_suppkey, l_linenumber - 1 AS c FROM lineitem) GROUP BY l_suppkey",
    "reliable_select": "SELECT c_custkey, round(c_acctbal, 2)::DOUBLE AS score FROM customer WHERE c_acctbal > 1000 AND c_nationkey % 3 = 2 ORDER BY c_acctbal DESC, c_custkey LIMIT 50",
    "unreliable_rest": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 1000 AND c_nationkey % 3 = 2 ORDER BY c_acctbal DESC, c_custkey LIMIT 50))",
    "fullest_slice": f"{_M}, n AS (SELECT case_id, z, count(*) AS n FROM m GROUP BY 1, 2) SELECT case_id, arg_max(z, n * 100 - z) AS z, max(n) AS n FROM n GROUP BY 1",
    "even_clicks": f"""{_M}, s AS (SELECT case_id, min(x) AS a, max(x) AS b FROM m GROUP BY 1), p AS (SELECT case_id, i AS ord, floor(a + i * (b - a) / 4.0::DOUBLE + 0.5) AS place FROM s, range(0, 5) t(i)),
l AS (SELECT case_id, x, floor(quantile_cont(y, 0.5))::BIGINT AS y, floor(quantile_cont(z, 0.5))::BIGINT AS z FROM m GROUP BY 1, 2),
b AS (SELECT p.case_id, ord::INTEGER AS ord, arg_min(l, abs(x - place) * 100 + x) AS l FROM p JOIN l ON p.case_id = l.case_id GROUP BY 1, 2) SELECT case_id, ord, l.x AS x, l.y AS y, l.z AS z FROM b""",
    "click_prefixes": """
WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events), k AS (SELECT * FROM c WHERE ord < 5)
SELECT u.user_id, n::INTEGER AS n_clicks, count(k.event_id) AS n, max(k.event_id) AS last FROM (SELECT DISTINCT user_id FROM k) u CROSS JOIN range(0, 6) t(n) LEFT JOIN k ON k.user_id = u.user_id AND ord < n GROUP BY 1, 2""",
    "strided_shard": "SELECT s_suppkey, s_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r FROM supplier) WHERE r % 3 = 1",
    "hash_folds": "SELECT (('0x' || substr(md5('12345|' || doc_id), 1, 8))::BIGINT % 5)::INTEGER AS fold, count(*) AS n FROM documents GROUP BY 1",
    "boxes": f"{_M} SELECT case_id, min(x) AS low_x, max(x) + 1 AS high_x, min(y) AS low_y, max(y) + 1 AS high_y, min(z) AS low_z, max(z) + 1 AS high_z, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM m GROUP BY 1",
    "border_voxels": f"""{_M}, {_FACES}, n AS (SELECT a.case_id, a.x, a.y, a.z, count(b.x) AS c FROM m a CROSS JOIN o LEFT JOIN m b ON a.case_id = b.case_id AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4)
SELECT case_id, count(*) AS n FROM n WHERE c < 6 GROUP BY 1""",
    "dilated": f"{_M}, {_BALL}, d AS (SELECT DISTINCT case_id, x + dx AS x, y + dy AS y, z + dz AS z FROM m, o) SELECT case_id, count(*) AS n FROM d WHERE x BETWEEN 0 AND 6 AND y BETWEEN 0 AND 7 AND z BETWEEN 0 AND 7 GROUP BY 1",
    "eroded": f"WITH {VOX}, {_BALL}, n AS (SELECT case_id, x + dx AS x, y + dy AS y, z + dz AS z, count(*) AS c FROM vox, o GROUP BY 1, 2, 3, 4) SELECT case_id, count(*) AS n FROM n WHERE c = 27 GROUP BY 1",
    "surface_distances": f"""
WITH {VOX}, {_FACES}, k(label) AS (VALUES (1), (2), (3)),
m AS (SELECT 'g' AS s, case_id, label, x, y, z FROM vox JOIN k ON gt = label UNION ALL SELECT 'p', case_id, label, x, y, z FROM vox JOIN k ON pred = label),
n AS (SELECT a.s, a.case_id, a.label, a.x, a.y, a.z, count(b.x) AS c FROM m a CROSS JOIN o LEFT JOIN m b ON a.s = b.s AND a.case_id = b.case_id AND a.label = b.label AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY 1, 2, 3, 4, 5, 6),
b AS (SELECT * FROM n WHERE c < 6),
d AS (SELECT p.case_id, p.label, sqrt(min((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)) AS d FROM b p JOIN b q ON p.case_id = q.case_id AND p.label = q.label AND p.s <> q.s GROUP BY p.s, p.case_id, p.label, p.x, p.y, p.z),
h AS (SELECT case_id, label, max(d) AS hd, quantile_cont(d, 0.95) AS hd95, avg(d) AS msd FROM d GROUP BY 1, 2),
e AS (SELECT c.case_id, k.label, CASE WHEN count(m.s) > 0 THEN sqrt(177.0) ELSE 0.0 END AS other FROM (SELECT DISTINCT case_id FROM vox) c CROSS JOIN k LEFT JOIN m ON m.case_id = c.case_id AND m.label = k.label GROUP BY 1, 2)
SELECT case_id, label, round(coalesce(hd, other), 6) AS hd, round(coalesce(hd95, other), 6) AS hd95, round(coalesce(msd, other), 6) AS msd FROM e LEFT JOIN h USING (case_id, label)""",
    "cropped": f"""WITH {VOX}, b AS (SELECT case_id, min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d, min(z) AS e, max(z) AS f FROM vox WHERE gt = 1 AND x BETWEEN 1 AND 4 GROUP BY 1)
SELECT case_id, count(*) AS n, max(x - a) AS x FROM vox JOIN b USING (case_id) WHERE x BETWEEN a AND b.b AND y BETWEEN c AND d AND z BETWEEN e AND f GROUP BY 1""",
    "resampled": f"WITH {VOX} SELECT case_id, gt, count(*) * 4 AS n FROM vox WHERE z % 2 = 1 GROUP BY 1, 2",
    "tile_grid": """
WITH g AS (SELECT p_partkey AS case_id, unnest([p_size + 20, p_partkey % 60 + 40, 33]) AS n, unnest([32, 64, 32]) AS t, unnest(['x', 'y', 'z']) AS ax FROM part),
k AS (SELECT *, greatest(ceil((n - t) / (t * 0.5)) + 1, 1)::BIGINT AS c FROM g),
s AS (SELECT case_id, ax, round_even(CASE WHEN c > 1 THEN (n - t)::DOUBLE / (c - 1) ELSE 0 END * i, 0)::INTEGER AS p FROM k, range(0, 10) r(i) WHERE i < c)
SELECT x.case_id, x.p AS x0, y.p AS y0, z.p AS z0 FROM s x JOIN s y ON x.case_id = y.case_id JOIN s z ON x.case_id = z.case_id WHERE x.ax = 'x' AND y.ax = 'y' AND z.ax = 'z'""",
    "tile_merge": "SELECT l_suppkey AS case_id, l_linenumber AS x, round(sum(l_discount::DOUBLE * l_quantity::DOUBLE) / sum(l_quantity::DOUBLE), 6) AS p FROM lineitem GROUP BY 1, 2",
    "component_count": _COMP + "SELECT case_id, count(*) AS components, max(n) AS largest FROM s GROUP BY 1",
    "largest_component": _COMP + "SELECT case_id, max(n) AS n FROM s GROUP BY 1",
    "small_removed": _COMP + "SELECT case_id, sum(n)::BIGINT AS n FROM s WHERE n > 3 GROUP BY 1",
    "triage": _COMP + "SELECT case_id, count(*) AS components, CASE WHEN count(*) = 20 THEN 'good' ELSE 'bad' END AS verdict FROM s GROUP BY 1",
    "threshold_search": f"""WITH {VOX}, s AS (SELECT case_id, count(*) FILTER (WHERE pred = 1) AS n, count(*) FILTER (WHERE gt = 1) > 80 AS p FROM vox GROUP BY 1),
w AS (SELECT t, count(*) FILTER (WHERE (n > t) <> p) AS m FROM s, range(0, 200, 5) r(t) GROUP BY 1) SELECT min(t)::INTEGER AS first, max(t)::INTEGER AS last, min(m) AS mismatches FROM w WHERE m = (SELECT min(m) FROM w)""",
    "verify_labels": f"WITH {VOX} SELECT case_id, string_agg(DISTINCT gt::VARCHAR, ',' ORDER BY gt::VARCHAR) AS labels, coalesce(string_agg(DISTINCT gt::VARCHAR, ',' ORDER BY gt::VARCHAR) FILTER (WHERE gt > 2), '') AS unexpected FROM vox GROUP BY 1",
}
