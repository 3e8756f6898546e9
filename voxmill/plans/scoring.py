"""Overlap scores of predicted against true label maps, and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxmill.operators import curves, overlap, selection, summary, workflows
from voxmill.plans.base import VOX, confusion_sql, rounded
from voxmill.sources import tables

LABELS = (1, 2, 3)


def _counts(spark, d, labels=LABELS, **more):
    return overlap.confusion(tables.voxels(spark, d), labels, **more)


def dice_labels(spark, d):
    """Dice of two binary labellings of documents: quality as truth, toxic as prediction."""
    rows = tables.read(spark, d, "labels").select(F.lit(0).alias("case_id"), F.col("quality").alias("gt"), F.col("toxic").alias("pred"))
    return rounded(overlap.confusion(rows, [1]).select("tp", "fp", "fn", "tn", overlap.dice().alias("dice")))


def confusion_by_case_class(spark, d):
    return _counts(spark, d)


def _dice(policy, labels=LABELS):
    return lambda spark, d: rounded(_counts(spark, d, labels).select("case_id", "label", overlap.dice(policy).alias("dice")))


def dice_smooth(spark, d):
    return rounded(_counts(spark, d, (1, 2, 3, 4)).select("case_id", "label", overlap.dice(eps=1e-5).alias("dice")))


def iou(spark, d):
    return rounded(overlap.with_metrics(_counts(spark, d)).select("case_id", "label", "iou", "n_pred", "n_ref"))


def region_dice(spark, d):
    counts = overlap.region_confusion(tables.voxels(spark, d), {"1+2": [1, 2], "1": [1]})
    return rounded(counts.select("case_id", "region", "tp", "fp", "fn", "tn", overlap.dice("skip_empty").alias("dice")))


def ignore_label_metrics(spark, d):
    return rounded(overlap.with_metrics(_counts(spark, d, (1, 2), ignore=3)).select("case_id", "label", "tp", "fp", "fn", "tn", "dice"))


def class_mean(spark, d):
    return rounded(overlap.class_means(overlap.with_metrics(_counts(spark, d))))


def foreground_mean(spark, d):
    return rounded(overlap.foreground_mean(overlap.class_means(overlap.with_metrics(_counts(spark, d, (0, 1, 2, 3))))))


def global_dice(spark, d):
    return rounded(overlap.global_scores(_counts(spark, d)).select("label", "tp", "fp", "fn", "dice", "iou"))


def absent_class_average(spark, d):
    scores = _counts(spark, d, (1, 2, 3, 4, 5)).select("case_id", overlap.dice().alias("dice"))
    return rounded(overlap.case_average(scores))


def aligned_sparse(spark, d):
    """The voxel-aligned join of two sparse maps: background cells of either are absent."""
    v = tables.voxels(spark, d)
    gt, pred = (v.filter(F.col(c) > 0).select("case_id", "x", "y", "z", F.col(c).alias("label")) for c in ("gt", "pred"))
    return overlap.joint_counts(overlap.aligned(gt, pred))


def evaluate(spark, d):
    return rounded(workflows.evaluate(tables.voxels(spark, d), LABELS)[1])


def folder_metrics(spark, d):
    return rounded(workflows.folder_metrics(tables.voxels(spark, d), LABELS)[1])


def consistency(spark, d):
    """Three models' maps: the last one against both earlier ones."""
    v = tables.voxels(spark, d).select("case_id", F.col("gt").alias("m3"), F.col("pred").alias("m1"), ((F.col("pred") + F.col("x")) % 4).alias("m2"))
    return rounded(overlap.consistency(v, "m3", ["m1", "m2"], LABELS))


def describe_scores(spark, d):
    events = tables.read(spark, d, "events")
    return rounded(summary.describe(events, ["value"], ["event_type"], spread=True))


def describe_text(spark, d):
    return summary.describe_text(tables.read(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


def fingerprint(spark, d):
    return rounded(summary.fingerprint(tables.read(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice"), 6)


def vector_percentile(spark, d):
    return rounded(summary.vector_percentile(tables.read(spark, d, "embeddings"), "embedding", 0.5, ["label"]))


def fold_pivot(spark, d):
    orders = tables.read(spark, d, "orders").groupBy("o_orderpriority", (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(summary.fold_table(orders, ["o_orderpriority"], "fold", "v", range(5)), 3)


def cross_table(spark, d):
    orders = tables.read(spark, d, "orders").filter("NOT (o_orderstatus = 'P' AND o_orderkey % 5 = 1 AND o_orderpriority LIKE '1%')")
    rows = orders.groupBy("o_orderpriority", "o_orderstatus", (F.col("o_orderkey") % 5).alias("fold")).agg(F.avg("o_totalprice").alias("v"))
    return rounded(summary.cross_table(rows, "o_orderpriority", "o_orderstatus", "fold", "v", ["F", "O", "P"], 5), 3)


def benchmark_pivot(spark, d):
    line = tables.read(spark, d, "lineitem").filter("NOT (l_linenumber = 3 AND l_returnflag = 'A')").select("l_linenumber", "l_returnflag", F.col("l_tax").alias("v"))
    return summary.benchmark_table(line, ["l_linenumber"], "l_returnflag", "v", ["A", "N", "R"])


def _clicks(spark, d):
    events = tables.read(spark, d, "events").select("user_id", "event_id", "ts", "value")
    rank = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"
    return events.withColumn("idx", F.expr(rank)).filter("idx <= 5")


def click_auc_final(spark, d):
    return rounded(curves.area_and_final(_clicks(spark, d), ["user_id"], "idx", "value"))


def ema_curve(spark, d):
    return rounded(curves.moving_average(_clicks(spark, d), ["user_id"], "idx", "value"))


def best_so_far(spark, d):
    return rounded(curves.best_so_far(_clicks(spark, d), ["user_id"], "idx", "value").select("user_id", "idx", "best"))


def fastest_epoch(spark, d):
    events = tables.read(spark, d, "events").withColumn("prev", F.expr("lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)"))
    log = events.filter("prev IS NOT NULL").select("user_id", F.unix_micros(F.col("prev").cast("timestamp")).alias("a"), F.unix_micros(F.col("ts").cast("timestamp")).alias("b"))
    return rounded(curves.epoch_times(log, ["user_id"], "a", "b"), 1)


def best_config(spark, d):
    line = tables.read(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_discount"), 6).alias("score"))
    return selection.best_configuration(line, "score", ["l_returnflag", "l_linestatus"])


def model_pairs(spark, d):
    return selection.model_pairs(tables.read(spark, d, "nation"), "n_name", "n_nationkey", ["n_regionkey"])


_DICE = "CASE WHEN tp + fp + fn = 0 THEN {both} WHEN tp + fn = 0 THEN {gt} ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"
_D, _SKIP = _DICE.format(both="1.0", gt="0.0"), _DICE.format(both="NULL", gt="0.0")
_IOU = "CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn)::DOUBLE END"
_CM5 = confusion_sql((1, 2, 3, 4, 5))
_STATS = """count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS pc25,
       round(quantile_cont(v, 0.5), 6) AS pc50, round(quantile_cont(v, 0.75), 6) AS pc75, round(max(v), 6) AS max"""
_CLICKS = "WITH c AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events), k AS (SELECT * FROM c WHERE idx <= 5)"

QUERIES = {
    "dice_labels": dice_labels, "confusion_by_case_class": confusion_by_case_class, "dice_by_case": _dice("challenge"), "dice_challenge": _dice("challenge", (1, 2, 3, 4)), "dice_nan_empty": _dice("skip_empty", (1, 2, 3, 4)),
    "dice_zero_empty": _dice("zero_empty", (1, 2, 3, 4)), "dice_skip_absent": _dice("skip_absent", (1, 2, 3, 4)), "dice_smooth": dice_smooth, "iou": iou, "region_dice": region_dice, "ignore_label_metrics": ignore_label_metrics,
    "class_mean": class_mean, "foreground_mean": foreground_mean, "global_dice": global_dice, "absent_class_average": absent_class_average, "aligned_sparse": aligned_sparse, "evaluate": evaluate, "folder_metrics": folder_metrics,
    "consistency": consistency, "describe_scores": describe_scores, "describe_text": describe_text, "fingerprint": fingerprint, "vector_percentile": vector_percentile, "fold_pivot": fold_pivot, "cross_table": cross_table,
    "benchmark_pivot": benchmark_pivot, "click_auc_final": click_auc_final, "ema_curve": ema_curve, "best_so_far": best_so_far, "fastest_epoch": fastest_epoch, "best_config": best_config, "model_pairs": model_pairs,
}


def _policy_sql(both: str, gt: str, labels=(1, 2, 3, 4)) -> str:
    return confusion_sql(labels) + f"SELECT case_id, label, round({_DICE.format(both=both, gt=gt)}, 6) AS dice FROM cm"


def _consistency_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT case_id, count(*) FILTER (WHERE m3 = label AND m{k} = label) AS tp, count(*) FILTER (WHERE m3 <> label AND m{k} = label) AS fp, count(*) FILTER (WHERE m3 = label AND m{k} <> label) AS fn FROM m CROSS JOIN cls GROUP BY case_id, label"
        for k in (1, 2)
    )
    return f"WITH {VOX}, cls AS (SELECT unnest([1, 2, 3]) AS label), m AS (SELECT case_id, gt AS m3, pred AS m1, (pred + x) % 4 AS m2 FROM vox), s AS ({each}) SELECT case_id, round(avg({_D}), 6) AS m_dice FROM s GROUP BY case_id"


SQL = {
    "dice_labels": f"""
WITH cm AS (
  SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp,
         count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels)
SELECT tp, fp, fn, tn, round({_D}, 6) AS dice FROM cm""",
    "confusion_by_case_class": confusion_sql() + "SELECT * FROM cm",
    "dice_by_case": _policy_sql("1.0", "0.0", (1, 2, 3)),
    "dice_challenge": _policy_sql("1.0", "0.0"),
    "dice_nan_empty": _policy_sql("NULL", "0.0"),
    "dice_zero_empty": _policy_sql("0.0", "0.0"),
    "dice_skip_absent": _policy_sql("NULL", "NULL"),
    "dice_smooth": confusion_sql((1, 2, 3, 4)) + "SELECT case_id, label, round((2.0::DOUBLE * tp + 1e-5) / (2 * tp + fp + fn + 1e-5), 6) AS dice FROM cm",
    "iou": confusion_sql() + f"SELECT case_id, label, round({_IOU}, 6) AS iou, tp + fp AS n_pred, tp + fn AS n_ref FROM cm",
    "region_dice": f"""
WITH {VOX}, r(region, labels) AS (VALUES ('1+2', [1, 2]), ('1', [1])),
cm AS (
  SELECT case_id, region, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn, count(*) FILTER (WHERE NOT g AND NOT p) AS tn
  FROM (SELECT case_id, region, list_contains(labels, gt::INTEGER) AS g, list_contains(labels, pred::INTEGER) AS p FROM vox CROSS JOIN r) GROUP BY 1, 2)
SELECT case_id, region, tp, fp, fn, tn, round({_SKIP}, 6) AS dice FROM cm""",
    "ignore_label_metrics": confusion_sql((1, 2), "gt <> 3") + f"SELECT case_id, label, tp, fp, fn, tn, round({_SKIP}, 6) AS dice FROM cm",
    "class_mean": confusion_sql() + f"SELECT label, round(avg({_SKIP}), 6) AS dice, round(avg({_IOU}), 6) AS iou FROM cm GROUP BY label",
    "foreground_mean": confusion_sql((0, 1, 2, 3))
    + f", m AS (SELECT label, avg({_SKIP}) AS dice, avg({_IOU}) AS iou FROM cm GROUP BY label) SELECT round(avg(dice), 6) AS dice, round(avg(iou), 6) AS iou FROM m WHERE label <> 0",
    "global_dice": confusion_sql()
    + f", s AS (SELECT label, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM cm GROUP BY label) SELECT label, tp, fp, fn, round({_SKIP}, 6) AS dice, round({_IOU}, 6) AS iou FROM s",
    "absent_class_average": _CM5 + f"SELECT case_id, round(avg({_D}), 6) AS dice FROM cm GROUP BY case_id",
    "aligned_sparse": f"WITH {VOX} SELECT case_id, gt, pred, count(*) AS n FROM vox WHERE gt > 0 OR pred > 0 GROUP BY 1, 2, 3",
    "evaluate": confusion_sql()
    + f""", s AS (SELECT case_id, label, {_D} AS v FROM cm),
l AS (SELECT 'dice_' || label AS "column", v FROM s UNION ALL SELECT 'dice_average', avg(v) FROM s GROUP BY case_id)
SELECT "column", {_STATS} FROM l GROUP BY 1""",
    "folder_metrics": confusion_sql() + f"SELECT label, round(avg({_SKIP}), 6) AS dice, round(avg({_IOU}), 6) AS iou FROM cm GROUP BY label",
    "consistency": _consistency_sql(),
    "describe_scores": f"""SELECT event_type, 'value' AS "column", {_STATS} FROM (SELECT event_type, value AS v FROM events) GROUP BY 1""",
    "describe_text": """
WITH l AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders),
n AS (SELECT "column", v, count(*) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT "column", sum(n)::BIGINT AS count, max(n) AS freq FROM n GROUP BY 1""",
    "fingerprint": """
SELECT l_returnflag, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
       round(quantile_cont(v, 0.995), 6) AS percentile_99_5, round(quantile_cont(v, 0.005), 6) AS percentile_00_5
FROM (SELECT l_returnflag, l_extendedprice::DOUBLE AS v FROM lineitem) GROUP BY 1""",
    "vector_percentile": """
SELECT label, (i - 1)::INTEGER AS axis, round(quantile_cont(v, 0.5), 6) AS value
FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2""",
    "fold_pivot": """
WITH f AS (SELECT o_orderpriority, o_orderkey % 5 AS fold, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, """
    + ", ".join(f"round(max(v) FILTER (WHERE fold = {k}), 3) AS fold{k}" for k in range(5))
    + ", round(avg(v), 3) AS mean FROM f GROUP BY 1",
    "cross_table": """
WITH o AS (SELECT * FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 5 = 1 AND o_orderpriority LIKE '1%')),
f AS (SELECT o_orderpriority, o_orderstatus, o_orderkey % 5 AS fold, avg(o_totalprice) AS v FROM o GROUP BY 1, 2, 3),
c AS (SELECT o_orderpriority, o_orderstatus, CASE WHEN count(v) = 5 THEN avg(v) END AS cell FROM f GROUP BY 1, 2)
SELECT o_orderpriority, round(max(cell) FILTER (WHERE o_orderstatus = 'F'), 3) AS "F", round(max(cell) FILTER (WHERE o_orderstatus = 'O'), 3) AS "O",
       round(max(cell) FILTER (WHERE o_orderstatus = 'P'), 3) AS "P", round(CASE WHEN count(cell) = 3 THEN avg(cell) END, 3) AS mean
FROM c GROUP BY 1""",
    "benchmark_pivot": "SELECT l_linenumber, "
    + ", ".join(f"coalesce(printf('%.2f', round(min(l_tax) FILTER (WHERE l_returnflag = '{x}'), 2)::DOUBLE), 'MISSING') AS \"{x}\"" for x in "ANR")
    + " FROM lineitem WHERE NOT (l_linenumber = 3 AND l_returnflag = 'A') GROUP BY 1",
    "click_auc_final": _CLICKS
    + """, p AS (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY idx) AS b FROM k WHERE value IS NOT NULL)
SELECT user_id, round(coalesce(sum((value + b) / 2.0), 0), 6) AS auc, round(arg_max(value, idx), 6) AS final FROM p GROUP BY 1""",
    "ema_curve": _CLICKS
    + """, s AS (SELECT user_id, list(value ORDER BY idx) AS v FROM k GROUP BY 1)
SELECT user_id, round(list_reduce(v, lambda a, x: 0.9::DOUBLE * a + (1 - 0.9::DOUBLE) * x), 6) AS ema FROM s""",
    "best_so_far": _CLICKS + " SELECT user_id, idx::INTEGER AS idx, round(max(value) OVER (PARTITION BY user_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS best FROM k",
    "fastest_epoch": """
WITH p AS (SELECT user_id, epoch_us(ts::TIMESTAMP) AS b, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)::TIMESTAMP) AS a FROM events)
SELECT user_id, min(b - a)::DOUBLE AS fastest, round(avg(b - a), 1) AS mean FROM p WHERE a IS NOT NULL GROUP BY 1""",
    "best_config": """
SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS score FROM lineitem GROUP BY 1, 2 ORDER BY score DESC, l_returnflag, l_linestatus LIMIT 1""",
    "model_pairs": "SELECT a.n_regionkey, a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
}
