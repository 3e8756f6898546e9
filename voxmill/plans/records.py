"""Queries over names, manifests, plans, stores and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import catalogue, curves, pairing, paths, summary, values, workflows
from voxmill.plans.base import VOX, rounded
from voxmill.sources import manifest, tables

read = tables.read


def _text(array):
    return F.array_join(F.transform(array, lambda v: v.cast("string")), ",")


def natural_sort(spark, d):
    name = F.concat(F.lit("case"), (F.col("s_suppkey") % 7).cast("string"), F.lit("_"), F.col("s_suppkey").cast("string"), F.lit(".mha"))
    rows = read(spark, d, "supplier").select("s_suppkey", name.alias("name"))
    before = F.expr("row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY key)")
    return rows.withColumn("key", catalogue.natural_order(F.col("name"))).select("s_suppkey", "name", before.cast("long").alias("place"))


def looked_up(spark, d):
    info = read(spark, d, "nation").select("n_nationkey", "n_name", (F.col("n_nationkey") % 5).alias("ed"), (F.col("n_nationkey") % 7 + 5).alias("es"))
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return catalogue.looked_up(rows, info, "n_nationkey", ["n_name"]).select("c_custkey", "n_name")


def time_phases(spark, d):
    info = read(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 5).alias("ed"), (F.col("n_nationkey") % 7 + 5).alias("es"))
    rows = read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return catalogue.phases(rows, info, "n_nationkey", ["ed", "es"]).select("s_suppkey", "phase", "at")


def available_models(spark, d):
    models = read(spark, d, "nation").select(F.lit("t").alias("trainer"), F.col("n_regionkey").cast("string").alias("plans"), F.col("n_name").alias("config"))
    plans = read(spark, d, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_regionkey").cast("string").alias("plans"), F.col("n_name").alias("config"))
    folders = plans.select(F.lit("t").alias("trainer"), "plans", "config")
    return catalogue.available_models(models, plans, folders).select("plans", "config")


def dataset_candidates(spark, d):
    name = F.concat(paths.dataset_prefix(F.col("p_partkey") % 10), F.lit("_"), F.col("p_brand"))
    one, two = read(spark, d, "part").select(name.alias("name")), read(spark, d, "part").filter("p_size > 20").select(name.alias("name"))
    return catalogue.candidates(F.lit(7), one, two)


def dataset_numbers(spark, d):
    what = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey").cast("string")).when(F.col("p_partkey") % 3 == 1, F.concat(paths.dataset_prefix(F.col("p_partkey") % 1000), F.lit("_X"))).otherwise("other")
    return read(spark, d, "part").select("p_partkey", catalogue.dataset_number(what).alias("number"))


def trained_folds(spark, d):
    path = F.concat(F.lit("m/fold_"), F.when(F.col("o_orderkey") % 11 == 0, "all").otherwise((F.col("o_orderkey") % 9).cast("string")), F.lit("/"), F.when(F.col("o_orderkey") % 9 < 5, "checkpoint_final.pth").otherwise("log.txt"))
    return catalogue.trained_folds(read(spark, d, "orders").select(path.alias("path")))


def selected_cases(spark, d):
    cases = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("case"))
    wanted = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("case"))
    broken = read(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("case"))
    return catalogue.selected(cases, wanted, broken, "case", ("_0000.mha", ".mha"))


def still_to_do(spark, d):
    done = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return catalogue.to_do(read(spark, d, "customer").select("c_custkey"), done, "c_custkey")


def transpose_orders(spark, d):
    spacing = F.array((F.col("p_partkey") % 4 + 1).cast("double"), (F.col("p_size") % 5 + 1).cast("double"), F.lit(3.0))
    rows = read(spark, d, "part").select("p_partkey", catalogue.transpose_order(spacing).alias("t"))
    return rows.select("p_partkey", _text(F.col("t.forward")).alias("forward"), _text(F.col("t.backward")).alias("backward"))


def inherited_settings(spark, d):
    """Each nation's settings under those of the nation of half its number, and so on up to the first."""
    key = F.col("n_nationkey")
    up = F.when(key > 0, F.floor(key / 2).cast("string"))
    own = F.create_map(F.lit("own"), F.col("n_name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), key.cast("string"))
    configs = read(spark, d, "nation").select(key.cast("string").alias("name"), up.alias("inherits_from"), own.alias("values"))
    return catalogue.inherited(configs).select("name", F.explode("values").alias("key", "value"))


def label_maps(spark, d):
    labels = F.map_from_arrays(F.array(F.lit("background"), F.col("p_brand"), F.lit("last")), F.array(F.lit(0), (F.col("p_size") % 9 + 1).cast("int"), F.lit(10)))
    regions = F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.array((F.col("p_size") % 3).cast("int"), F.lit(1)), F.array(F.lit(2), F.lit(1))))
    channels = catalogue.input_channels(F.array(F.lit("ct")), labels, F.col("p_partkey") % 2 == 0)
    rows = read(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.map_keys(catalogue.foreground(labels))), ",").alias("names"), _text(catalogue.all_labels(regions)).alias("labels"), channels.cast("long").alias("channels"))
    return rows


def crop_decisions(spark, d):
    after = F.array((F.col("p_size") % 10 + 1).cast("int"), F.lit(10), F.lit(10))
    ratio = catalogue.crop_ratio(F.array(F.lit(10), F.lit(10), F.lit(10)), after)
    return rounded(read(spark, d, "part").select("p_partkey", ratio.alias("ratio"), catalogue.uses_mask(ratio, F.col("p_partkey") % 3 != 0).alias("mask")))


def plans_renamed(spark, d):
    text = F.to_json(F.struct(F.lit("old").alias("dataset_name"), F.lit("p").alias("plans_name"), F.col("p_brand").alias("brand")))
    new = catalogue.renamed_plans(text, F.concat(F.lit("Dataset"), F.col("p_partkey").cast("string")), F.lit("q"))
    fields = F.from_json(new, "dataset_name string, plans_name string, brand string")
    return read(spark, d, "part").select("p_partkey", fields.alias("f")).select("p_partkey", "f.*")


def upgraded_datasets(spark, d):
    text = F.concat(F.lit('{"labels":{"0":"background","'), F.col("p_size").cast("string"), F.lit('":"'), F.col("p_brand"), F.lit('"},"name":"x","modality":{"0":"CT"},"license":"l"}'))
    return read(spark, d, "part").select("p_partkey", catalogue.upgraded_dataset(text, ["name"]).alias("json"))


def results_entries(spark, d):
    key = F.col("s_suppkey").cast("string")
    return read(spark, d, "supplier").select("s_suppkey", catalogue.results_entry(F.concat(key, F.lit(".mha")), F.concat(F.lit("out/"), key, F.lit(".mha"))).alias("json"))


def inference_commands(spark, d):
    folds = F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int"))
    return read(spark, d, "part").select("p_partkey", catalogue.inference_command(paths.dataset_prefix(F.col("p_partkey") % 1000), F.lit("3d"), F.lit("tr"), F.col("p_brand"), folds).alias("command"))


def dataset_description(spark, d):
    labels = read(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("value"))
    return catalogue.dataset_json({"0": "CT"}, labels, read(spark, d, "customer"), ".mha")


def store_changes(spark, d):
    store = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    key = F.col("s_suppkey") % 40
    changes = read(spark, d, "supplier").select(key.alias("key"), F.concat(F.lit("v"), F.col("s_suppkey").cast("string")).alias("value"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 4 == 0).alias("deleted"))
    return catalogue.changed_store(store, changes)


def store_lookups(spark, d):
    store = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("value"))
    asked = read(spark, d, "part").select((F.col("p_partkey") % 30).alias("key")).distinct()
    return catalogue.stored_json(store, asked, "name string, region int").select("key", "value.name", "value.region")


def _batches(spark, d):
    return read(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("batch"), "value")


def collated_outputs(spark, d):
    rows = _batches(spark, d).filter("value IS NOT NULL").select("user_id", "batch", F.round(F.col("value"), 3).alias("loss"), F.array(F.col("batch"), F.col("batch") + 1).alias("keys"))
    out = catalogue.collated(rows, ["user_id"], "batch", ["loss"], ["keys"])
    return out.select("user_id", F.size("loss").cast("long").alias("n"), F.element_at("loss", -1).alias("last"), F.aggregate("keys", F.lit(0).cast("long"), lambda a, k: a + k).alias("keys"))


def buffer_means(spark, d):
    rows = _batches(spark, d).withColumn("batch", F.col("batch") % 7)
    plain, by_batch = catalogue.buffered_mean(rows, ["event_type"], "value"), catalogue.buffered_mean(rows, ["event_type"], "value", "mean_batch").withColumnRenamed("value", "mean_batch")
    total = catalogue.buffered_mean(rows, ["event_type"], "value", "sum").withColumnRenamed("value", "total")
    return rounded(plain.join(by_batch, "event_type").join(total, "event_type"), 4)


def epoch_log(spark, d):
    rows = read(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("key"), (F.col("event_id") % 5).alias("epoch"), "value", F.col("event_id").alias("ord"))
    full = rows.join(rows.groupBy("key").agg(F.countDistinct("epoch").alias("k")).filter("k = 5").select("key"), "key", "left_semi")
    return rounded(catalogue.logged(full))


def log_upserts(spark, d):
    log = read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("key"), (F.col("o_orderkey") % 20).alias("epoch"), F.col("o_totalprice").cast("double").alias("value")).groupBy("key", "epoch").agg(F.max("value").alias("value"))
    new = log.filter("epoch % 3 = 0").withColumn("value", F.lit(-1.0))
    return rounded(curves.upsert_log(log, new), 2)


def augmented_rows(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey")
    made = rows.withColumn("s_suppkey", F.explode(F.array(F.col("s_suppkey") + 1000, F.col("s_suppkey") + 2000)))
    return catalogue.with_originals(made, rows)


def model_paths(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.concat_ws("/", F.col("l_returnflag"), F.col("l_suppkey").cast("string")).alias("path")).distinct()
    return pairing.paths_by_file(rows, "file", "path").select("file", F.array_join("paths", "|").alias("paths"))


def experiment_grid(spark, d):
    trainers, plans = read(spark, d, "region").select(F.col("r_name").alias("trainer")), read(spark, d, "nation").select(F.col("n_name").alias("plans"))
    return pairing.grid(trainers, plans).select(paths.experiment_id(F.col("trainer"), F.col("plans"), F.lit("3d")).alias("experiment"))


def merged_lists(spark, d):
    a, b = read(spark, d, "nation").select(F.col("n_name").alias("line")), read(spark, d, "region").select(F.col("r_name").alias("line"))
    return pairing.merged_lines([a, b, a])


def merged_tables(spark, d):
    a, b = read(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")), read(spark, d, "region").select(F.col("r_name").alias("name"))
    return pairing.merged_rows([a, b])


def label_texts(spark, d):
    labels = F.when(F.col("p_size") % 2 == 0, F.array((F.col("p_size") % 7).cast("int"))).otherwise(F.array(F.lit(1), (F.col("p_size") % 7).cast("int")))
    key = paths.label_key(labels)
    colour = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("p_partkey") * 4099 % 16777216)), 6, "0"))
    folds = paths.folds_to_string(F.sequence(F.lit(0), (F.col("p_partkey") % 5).cast("int")))
    return read(spark, d, "part").select("p_partkey", key.alias("key"), _text(paths.labels_of_key(key)).alias("back"), _text(paths.hex_to_rgb(colour)).alias("rgb"), folds.alias("folds"), F.size(paths.folds_of_string(folds)).cast("long").alias("n_folds"))


def normalisation_schemes(spark, d):
    name = F.element_at(F.array(F.lit("CT"), F.lit("MR"), F.lit("noNorm"), F.lit("zscore"), F.lit("rescale_to_0_1"), F.lit("rgb_to_0_1")), (F.col("p_partkey") % 6 + 1).cast("int"))
    return read(spark, d, "part").select("p_partkey", values.scheme_of(name).alias("scheme"), values.rescale_checked((F.col("p_size") * 5).cast("double")).alias("scaled")).select("p_partkey", "scheme", F.round("scaled", 6).alias("scaled"))


def world_points(spark, d):
    spacing, origin = F.lit([0.5, 2.0, 1.25]), F.lit([-10.0, 0.0, 3.0])
    rows = tables.voxels(spark, d).select("case_id", "x", "y", "z", values.voxel_to_world(F.array("x", "y", "z"), spacing, origin).alias("w"))
    back = values.world_to_voxel(F.transform("w", lambda v: v + 0.1), spacing, origin)
    near = values.all_close(F.col("w"), F.transform("w", lambda v: v + 1e-9))
    out = rows.select("case_id", "x", "w", F.col("w")[1].alias("wy"), back.alias("b"), near.alias("near"))
    return rounded(out.groupBy("case_id").agg(F.sum(F.col("w")[0]).alias("wx"), F.sum(F.col("w")[2]).alias("wz"), F.sum(F.col("b")[0]).alias("bx"), F.sum(F.col("b")[2]).alias("bz"), F.bool_and("near").alias("near")))


def boxed_points(spark, d):
    v = tables.voxels(spark, d)
    kept = v.filter(values.in_box(["x", "y", "z"], [1, 2, 0], [5, 7, 4]))
    return kept.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") - 1).alias("xs"))


def predicted_flags(spark, d):
    p = F.transform("embedding", lambda x: x.cast("double"))
    rows = read(spark, d, "embeddings").select("vec_id", p.alias("p"))
    return rows.select("vec_id", values.predict(F.col("p"), True).alias("label"), F.aggregate(values.predict(F.col("p"), False, 0.1), F.lit(0), lambda a, x: a + x).cast("long").alias("flags"))


def target_spacings(spark, d):
    spacing = F.array((F.col("p_size") + 10).cast("double"), (F.col("p_size") % 3 + 1).cast("double"), F.lit(1.0))
    size = F.array(F.lit(5), (F.col("p_size") + 60).cast("int"), F.lit(70))
    return rounded(summary.target_spacing(read(spark, d, "part").select(spacing.alias("spacing"), size.alias("size"))))


def safe_means(spark, d):
    rows = read(spark, d, "customer").groupBy("c_nationkey").agg(summary.safe_mean(F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal").cast("double"))).alias("mean"))
    return rounded(rows, 4)


def unique_names(spark, d):
    return read(spark, d, "nation").groupBy("n_nationkey").agg(pairing.unique_match("n_name").alias("name"))


def folds_accumulated(spark, d):
    v = tables.voxels(spark, d)
    parts = [v.filter(F.col("case_id") % 3 == k) for k in range(3)]
    return workflows.accumulate_folds(parts).groupBy("fold").agg(F.countDistinct("case_id").alias("cases"), F.count(F.lit(1)).alias("n"))


def clean_cases(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("price"))
    out = workflows.integrity(part, {"size": F.col("p_size") <= 40, "price": F.col("price") < 1500, "number": ~F.isnan("price")})
    return out.select("p_partkey", F.array_join("violations", ",").alias("violations"))


def filtered_rows(spark, d):
    """A flag and several equalities at once."""
    return read(spark, d, "lineitem").filter((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def zipped_tables(spark, d):
    """Two score tables side by side, by key rather than by position."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("case"), F.round(F.col("c_acctbal").cast("double"), 2).alias("first"))
    b = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("case")).agg(F.count(F.lit(1)).alias("second"))
    return a.join(b, "case")


def case_reports(spark, d):
    scores = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("case"), F.col("c_nationkey").alias("dice"))
    return manifest.case_reports(scores, "case", ["dice"])


def paired_files(spark, d):
    preds = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("file")).distinct()
    refs = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.col("c_nationkey").alias("fold"))
    return pairing.paired(preds, refs)


def click_files(spark, d):
    case = F.concat(F.lit("P"), F.col("s_suppkey").cast("string"))
    cases = read(spark, d, "supplier").select(case.alias("case"))
    kinds = F.explode(F.when(F.col("s_suppkey") % 4 == 0, F.array(F.lit("_clicks.json"), F.lit(".json"))).when(F.col("s_suppkey") % 4 == 1, F.array(F.lit(".json"), F.lit("_my_clicks.json"))).when(F.col("s_suppkey") % 4 == 2, F.array(F.lit("_my_clicks.json"), F.lit(".txt"))).otherwise(F.array(F.lit("_a_clicks.json"), F.lit("_b_clicks.json"))))
    files = read(spark, d, "supplier").select(case.alias("case"), kinds.alias("k")).select("case", F.concat("case", F.lit("/"), "case", "k").alias("path"))
    return pairing.click_file(cases, files)


def median_shapes(spark, d):
    return summary.median_shape(read(spark, d, "part").select(F.array("p_size", (F.col("p_partkey") % 90).cast("int"), F.lit(64)).alias("size")))


def class_summary(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    labels = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_linenumber").cast("int"))).otherwise(F.array(F.lit(1), F.col("l_linenumber").cast("int")))
    return summary.summary_json(rows.select(labels.alias("labels"), "n"), "labels", ["n"])


def files_of_folds(spark, d):
    """Validation files of all folds and models, each once."""
    rows = read(spark, d, "lineitem")
    lists = [rows.filter(F.col("l_linenumber") == k).select(F.concat(F.lit("P"), F.col("l_suppkey").cast("string")).alias("line")) for k in range(1, 5)]
    return pairing.merged_lines(lists)


QUERIES = {
    f.__name__: f
    for f in (
        natural_sort, looked_up, time_phases, available_models, dataset_candidates, dataset_numbers, trained_folds, selected_cases, still_to_do, transpose_orders, inherited_settings, label_maps, crop_decisions,
        plans_renamed, upgraded_datasets, results_entries, inference_commands, dataset_description, store_changes, store_lookups, collated_outputs, buffer_means, epoch_log, log_upserts, augmented_rows, model_paths,
        experiment_grid, merged_lists, merged_tables, label_texts, normalisation_schemes, world_points, boxed_points, predicted_flags, target_spacings, safe_means, unique_names, folds_accumulated, clean_cases,
        filtered_rows, zipped_tables, case_reports, paired_files, click_files, median_shapes, class_summary, files_of_folds,
    )
}

_UP = "WITH RECURSIVE t AS (SELECT n_nationkey AS name, n_nationkey AS k, 0 AS depth FROM nation UNION ALL SELECT name, k // 2, depth + 1 FROM t WHERE k > 0)"

SQL = {
    "natural_sort": "SELECT s_suppkey, 'case' || s_suppkey % 7 || '_' || s_suppkey || '.mha' AS name, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey % 7, s_suppkey) AS place FROM supplier",
    "looked_up": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "time_phases": "SELECT s_suppkey, 'ed' AS phase, s_nationkey % 5 AS \"at\" FROM supplier UNION ALL SELECT s_suppkey, 'es', s_nationkey % 7 + 5 FROM supplier",
    "available_models": "SELECT n_regionkey::VARCHAR AS plans, n_name AS config FROM nation WHERE n_nationkey % 3 = 0",
    "dataset_candidates": "SELECT DISTINCT 'Dataset007_' || p_brand AS name FROM part WHERE p_partkey % 10 = 7",
    "dataset_numbers": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey % 1000 END::INTEGER AS number FROM part",
    "trained_folds": "SELECT DISTINCT (o_orderkey % 9)::INTEGER AS fold FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 9 < 5",
    "selected_cases": "SELECT c_custkey::VARCHAR AS \"case\", c_custkey || '_0000.mha' AS source, c_custkey || '.mha' AS target FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders)",
    "still_to_do": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "transpose_orders": """
WITH s AS (SELECT p_partkey, p_partkey % 4 + 1 AS a, p_size % 5 + 1 AS b FROM part), w AS (SELECT p_partkey, CASE WHEN a >= b AND a >= 3 THEN 0 WHEN b >= 3 THEN 1 ELSE 2 END AS w FROM s)
SELECT p_partkey, CASE w WHEN 0 THEN '0,1,2' WHEN 1 THEN '1,0,2' ELSE '2,0,1' END AS forward, CASE w WHEN 0 THEN '0,1,2' WHEN 1 THEN '1,0,2' ELSE '1,2,0' END AS backward FROM w""",
    "inherited_settings": _UP
    + """, e AS (SELECT t.name, depth, 'own' AS key, n_name AS value FROM t JOIN nation ON k = n_nationkey UNION ALL SELECT t.name, depth, 'r' || n_regionkey, k::VARCHAR FROM t JOIN nation ON k = n_nationkey)
SELECT name::VARCHAR AS name, key, arg_min(value, depth) AS value FROM e GROUP BY 1, 2""",
    "label_maps": """
SELECT p_partkey, CASE WHEN p_brand < 'last' THEN p_brand || ',last' ELSE 'last,' || p_brand END AS names, CASE p_size % 3 WHEN 0 THEN '0,1,2' ELSE '1,2' END AS labels, 1 + CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS channels FROM part""",
    "crop_decisions": "SELECT p_partkey, round((p_size % 10 + 1) / 10.0::DOUBLE, 6) AS ratio, p_partkey % 3 <> 0 AND (p_size % 10 + 1) / 10.0::DOUBLE < 0.75 AS mask FROM part",
    "plans_renamed": "SELECT p_partkey, 'Dataset' || p_partkey AS dataset_name, 'q' AS plans_name, p_brand AS brand FROM part",
    "upgraded_datasets": """SELECT p_partkey, '{"labels":{"background":0,"' || p_brand || '":' || p_size || '},"channel_names":{"0":"CT"}}' AS json FROM part""",
    "results_entries": """SELECT s_suppkey, '{"outputs":[{"type":"metaio_image","filename":"out/' || s_suppkey || '.mha"}],"inputs":[{"type":"metaio_image","filename":"' || s_suppkey || '.mha"}],"error_messages":[]}' AS json FROM supplier""",
    "inference_commands": "SELECT p_partkey, 'predict -d Dataset' || lpad((p_partkey % 1000)::VARCHAR, 3, '0') || ' -c 3d -tr tr -p ' || p_brand || ' -f ' || array_to_string(range(0, p_partkey % 4 + 1), ' ') AS command FROM part",
    "dataset_description": """SELECT '{"channel_names":{"0":"CT"},"labels":{' || string_agg('"' || r_name || '":' || r_regionkey, ',' ORDER BY r_name) || '},"numTraining":' || (SELECT count(*) FROM customer) || ',"file_ending":".mha"}' AS json FROM region""",
    "store_changes": """
WITH c AS (SELECT n_nationkey AS key, n_name AS value, -1 AS ord, false AS gone FROM nation UNION ALL SELECT s_suppkey % 40, 'v' || s_suppkey, s_suppkey, s_suppkey % 4 = 0 FROM supplier)
SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord DESC) AS r FROM c) WHERE r = 1 AND NOT gone""",
    "store_lookups": "SELECT k AS key, n_name AS name, n_regionkey AS region FROM (SELECT DISTINCT p_partkey % 30 AS k FROM part) LEFT JOIN nation ON k = n_nationkey",
    "collated_outputs": "SELECT user_id, count(*) AS n, arg_max(round(value, 3), event_id) AS last, sum(2 * event_id + 1)::BIGINT AS keys FROM events WHERE value IS NOT NULL GROUP BY 1",
    "buffer_means": """
WITH b AS (SELECT event_type, event_id % 7 AS b, avg(value) AS m FROM events GROUP BY 1, 2), m AS (SELECT event_type, avg(m) AS mean_batch FROM b GROUP BY 1)
SELECT event_type, round(avg(value), 4) AS value, round(max(mean_batch), 4) AS mean_batch, round(sum(value), 4) AS total FROM events JOIN m USING (event_type) GROUP BY 1""",
    "epoch_log": """
WITH r AS (SELECT (user_id % 10)::VARCHAR AS key, event_id % 5 AS epoch, value, event_id FROM events), f AS (SELECT key FROM r GROUP BY 1 HAVING count(DISTINCT epoch) = 5)
SELECT key, epoch, round(arg_max(value, event_id), 6) AS value FROM r WHERE key IN (SELECT key FROM f) GROUP BY 1, 2""",
    "log_upserts": "SELECT o_custkey % 50 AS key, o_orderkey % 20 AS epoch, CASE WHEN o_orderkey % 20 % 3 = 0 THEN -1 ELSE round(max(o_totalprice::DOUBLE), 2) END AS value FROM orders GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, o_orderkey % 20"),
    "augmented_rows": "SELECT s_suppkey, false AS augmented FROM supplier UNION ALL SELECT s_suppkey + k, true FROM supplier, (VALUES (1000), (2000)) t(k)",
    "model_paths": "SELECT l_suppkey AS file, string_agg(p, '|' ORDER BY p) AS paths FROM (SELECT DISTINCT l_suppkey, l_returnflag || '/' || l_suppkey AS p FROM lineitem) GROUP BY 1",
    "experiment_grid": "SELECT r_name || '__' || n_name || '__3d' AS experiment FROM region, nation",
    "merged_lists": "SELECT n_name AS line FROM nation UNION SELECT r_name FROM region",
    "merged_tables": "SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT r_name, NULL FROM region",
    "label_texts": """
WITH c AS (SELECT *, printf('%06x', p_partkey * 4099 % 16777216) AS h, p_size % 7 AS l FROM part)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN l::VARCHAR ELSE '(1, ' || l || ')' END AS key, CASE WHEN p_size % 2 = 0 THEN l::VARCHAR ELSE '1,' || l END AS back,
       ('0x' || h[1:2])::INTEGER || ',' || ('0x' || h[3:4])::INTEGER || ',' || ('0x' || h[5:6])::INTEGER AS rgb, array_to_string(range(0, p_partkey % 5 + 1), '_') AS folds, p_partkey % 5 + 1 AS n_folds FROM c""",
    "normalisation_schemes": "SELECT p_partkey, ['ct', 'zscore', 'none', 'zscore', 'rescale', 'rgb'][p_partkey % 6 + 1] AS scheme, round(p_size * 5 / 255.0::DOUBLE, 6) AS scaled FROM part",
    "world_points": f"WITH {VOX} SELECT case_id, round(sum(x * 0.5::DOUBLE - 10), 6) AS wx, round(sum(z * 1.25::DOUBLE + 3), 6) AS wz, sum(x)::BIGINT AS bx, sum(z)::BIGINT AS bz, true AS near FROM vox GROUP BY 1",
    "boxed_points": f"WITH {VOX} SELECT case_id, count(*) AS n, sum(x - 1)::BIGINT AS xs FROM vox WHERE x BETWEEN 1 AND 4 AND y BETWEEN 2 AND 6 AND z BETWEEN 0 AND 3 GROUP BY 1",
    "predicted_flags": "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INTEGER AS label, len(list_filter(embedding, lambda x: x::DOUBLE >= 0.1::DOUBLE))::BIGINT AS flags FROM embeddings",
    "target_spacings": """
WITH s AS (SELECT 0 AS axis, p_size + 10 AS s, 5 AS n FROM part UNION ALL SELECT 1, p_size % 3 + 1, p_size + 60 FROM part UNION ALL SELECT 2, 1, 70 FROM part),
m AS (SELECT axis, median(s) AS s, median(n) AS n, quantile_cont(s, 0.1) AS p10 FROM s GROUP BY 1),
o AS (SELECT m.axis, max(b.s) AS top, min(b.n) AS least FROM m JOIN m b ON m.axis <> b.axis GROUP BY 1)
SELECT axis, round(CASE WHEN s > 3 * top AND n * 3 < least THEN greatest(p10, top + 1e-5) ELSE s END, 6) AS value FROM m JOIN o USING (axis)""",
    "safe_means": "SELECT c_nationkey, round(coalesce(avg(c_acctbal::DOUBLE) FILTER (WHERE c_acctbal > 9000), 0), 4) AS mean FROM customer GROUP BY 1",
    "unique_names": "SELECT n_nationkey, n_name AS name FROM nation",
    "folds_accumulated": f"WITH {VOX} SELECT (case_id % 3)::INTEGER AS fold, count(DISTINCT case_id) AS cases, count(*) AS n FROM vox GROUP BY 1",
    "clean_cases": "SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 40 THEN 'size' END, CASE WHEN p_retailprice >= 1500 THEN 'price' END) AS violations FROM part",
    "filtered_rows": "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N' AND l_linestatus = 'O' GROUP BY 1",
    "zipped_tables": "SELECT c_custkey AS \"case\", round(c_acctbal::DOUBLE, 2) AS first, n AS second FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "paired_files": "SELECT c_custkey::VARCHAR AS file, c_nationkey AS fold FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "click_files": "SELECT 'P' || s_suppkey AS \"case\", 'P' || s_suppkey || '/P' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '_clicks.json' WHEN 1 THEN '.json' WHEN 2 THEN '_my_clicks.json' END AS found FROM supplier",
    "median_shapes": "SELECT a::VARCHAR || 'x' || b::VARCHAR || 'x64.0' AS shape, a * b * 64 AS cells FROM (SELECT quantile_cont(p_size::DOUBLE, 0.5) AS a, quantile_cont((p_partkey % 90)::DOUBLE, 0.5) AS b FROM part)",
    "class_summary": """WITH n AS (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE '(1, ' || k || ')' END AS key, n FROM n)
SELECT '{' || string_agg('"' || key || '":{"n":' || n || '}', ',' ORDER BY key) || '}' AS json FROM t""",
    "files_of_folds": "SELECT DISTINCT 'P' || l_suppkey AS line FROM lineitem WHERE l_linenumber <= 4",
    "case_reports": """SELECT c_custkey::VARCHAR AS "case", '{"case":"' || c_custkey || '","scores":{"dice":' || c_nationkey || '}}' AS json FROM customer""",
}
