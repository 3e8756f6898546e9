"""Lists of cases, models and plans: lookups, configuration inheritance, keyed stores, and the texts that are written from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# -- order and lookups


def natural_order(name: Column) -> Column:
    """An order in which numbers inside names count as numbers: digits are padded to 20."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def looked_up(rows: DataFrame, info: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``rows`` with fields of ``info``; an error, when it runs, for a key that it lacks."""
    found = rows.join(info.select(key, *fields, F.lit(True).alias("_there")), key, "left")
    check = lambda c: F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.col(key).cast("string")))).otherwise(F.col(c)).alias(c)
    return found.select(*[c for c in rows.columns], *[check(c) for c in fields])


def phases(rows: DataFrame, info: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Two or more rows for each case, one for each named time point of ``info``: ``(..., phase, at)``."""
    found = looked_up(rows, info, key, names)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("phase"), F.col(n).cast("int").alias("at")) for n in names]))
    return found.select(*rows.columns, pairs.alias("_p")).select(*rows.columns, "_p.*")


def available_models(models: DataFrame, plans: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """``models(trainer, plans, config)`` whose configuration their plans have; an error, when it runs, for one of those without a folder."""
    kept = models.join(plans.select("plans", "config").distinct(), ["plans", "config"], "left_semi")
    if folders is None:
        return kept
    there = kept.join(folders.select("trainer", "plans", "config").distinct().withColumn("_there", F.lit(True)), ["trainer", "plans", "config"], "left")
    ok = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no results of "), F.concat_ws("__", "trainer", "plans", "config")))).otherwise(F.lit(True))
    return there.filter(ok).drop("_there")


def candidates(number: Column, *listings: DataFrame, name: str = "name") -> DataFrame:
    """Distinct names ``Dataset<number>_...`` over several folders' listings."""
    rows = listings[0].select(name)
    for more in listings[1:]:
        rows = rows.unionByName(more.select(name))
    return rows.filter(F.col(name).startswith(F.concat(F.lit("Dataset"), F.lpad(number.cast("string"), 3, "0"), F.lit("_")))).distinct()


def dataset_number(what: Column) -> Column:
    """The number of a dataset given by number or by name."""
    return F.coalesce(what.try_cast("int"), F.regexp_extract(what, r"^Dataset(\d{3})_", 1).try_cast("int"))


def trained_folds(files: DataFrame, path: str = "path", checkpoint: str = "checkpoint_final.pth") -> DataFrame:
    """Folds ``k`` of the folders ``fold_k`` that hold the checkpoint, in order; ``fold_all`` is none."""
    fold = F.regexp_extract(path, rf"(?:^|/)fold_(\d+)/{checkpoint.replace('.', chr(92) + '.')}$", 1)
    return files.select(fold.alias("fold")).filter("fold <> ''").select(F.col("fold").cast("int").alias("fold")).distinct()


def to_do(cases: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Cases that have no output yet."""
    return cases.join(done.select(key), key, "left_anti")


def selected(cases: DataFrame, wanted: DataFrame, broken: DataFrame | None, key: str, suffix: tuple[str, str]) -> DataFrame:
    """``cases`` that are wanted and not broken, with ``source`` and ``target`` names: one suffix for the other."""
    kept = cases.join(wanted.select(key), key, "left_semi")
    kept = kept if broken is None else kept.join(broken.select(key), key, "left_anti")
    old, new = suffix
    return kept.withColumns({"source": F.concat(F.col(key), F.lit(old)), "target": F.concat(F.col(key), F.lit(new))})


# -- plans and labels


def transpose_order(spacing: Column) -> Column:
    """``(forward, backward)``: axes with the coarsest first (the first of equal ones), the others in order; and the way back."""
    worst = F.array_position(spacing, F.array_max(spacing)).cast("int") - 1
    forward = F.concat(F.array(worst), F.filter(F.sequence(F.lit(0), F.size(spacing) - 1), lambda a: a != worst))
    backward = F.transform(F.sequence(F.lit(0), F.size(spacing) - 1), lambda a: F.array_position(forward, a).cast("int") - 1)
    return F.struct(forward.alias("forward"), backward.alias("backward"))


def inherited(configs: DataFrame, name: str = "name", parent: str = "inherits_from", values: str = "values") -> DataFrame:
    """``(name, values)`` of ``configs(name, inherits_from, values map<string,string>)``: a configuration's own entries win over its ancestors'.

    Each round looks one generation further, for all configurations at once; as many rounds as there are configurations are a cycle, and an error.
    An unknown ancestor is an error too.
    """
    rest = configs.select(name, F.col(parent).alias("_up"), values)
    rounds, most = 0, configs.count()
    parents = configs.select(F.col(name).alias("_up"), F.col(parent).alias("_next"), F.col(values).alias("_more"))
    while rest.filter("_up IS NOT NULL").limit(1).count():
        if rounds > most:
            raise ValueError("configurations inherit from one another in a circle")
        rounds += 1
        unknown = F.when(F.col("_up").isNotNull() & F.col("_more").isNull(), F.raise_error(F.concat(F.lit("no configuration "), F.col("_up"))))
        own, more = F.col(values), F.coalesce(unknown, F.col("_more"), F.create_map().cast("map<string,string>"))
        merged = F.map_concat(F.map_filter(more, lambda k, v: ~F.map_contains_key(own, k)), own)
        rest = rest.join(parents, "_up", "left").select(name, F.col("_next").alias("_up"), merged.alias(values))
    return rest.select(name, values)


def merged_settings(first: Column, second: Column) -> Column:
    """A map of settings under another one that wins where both have a key."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)


def foreground(labels: Column) -> Column:
    """A map of label names to numbers without the background (0)."""
    return F.map_filter(labels, lambda name, number: number != 0)


def all_labels(labels: Column) -> Column:
    """The distinct labels of a map of names to lists of labels, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.map_values(labels))))


def input_channels(modalities: Column, labels: Column, cascade: Column) -> Column:
    """Channels of a network's input: the modalities and, in a cascade, one for each foreground label."""
    return F.size(modalities) + F.when(cascade, F.size(foreground(labels))).otherwise(F.lit(0))


def uses_mask(ratio: Column, allowed: Column) -> Column:
    """Whether statistics are taken inside of the nonzero mask: if cropping leaves less than three quarters, and the scheme allows it."""
    return allowed & (ratio < 0.75)


def crop_ratio(before: Column, after: Column) -> Column:
    """Share of a volume's cells that cropping leaves."""
    size = lambda shape: F.aggregate(shape, F.lit(1.0), lambda a, n: a * n)
    return size(after) / size(before)


def renamed_plans(text: Column, dataset: Column, identifier: Column) -> Column:
    """A plans file's JSON for another dataset: its name and its own identifier rewritten, everything else as it was."""
    entries = F.from_json(text, "map<string,string>")
    new = F.create_map(F.lit("dataset_name"), dataset, F.lit("plans_name"), identifier)
    return F.to_json(merged_settings(entries, new))


def upgraded_dataset(text: Column, drop: Sequence[str]) -> Column:
    """An older dataset description: keys dropped, and the label map turned from numbers to names."""
    entries = F.from_json(text, "struct<labels:map<string,string>,name:string,modality:map<string,string>>")
    labels = F.map_from_entries(F.transform(F.map_entries(entries["labels"]), lambda e: F.struct(e["value"], e["key"].cast("int"))))
    fields = {"labels": labels, "name": entries["name"], "channel_names": entries["modality"]}
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items() if n not in drop]))


# -- texts


def results_entry(case: Column, prediction: Column) -> Column:
    """An entry of a results file."""
    image = lambda name: F.struct(F.lit("metaio_image").alias("type"), name.alias("filename"))
    return F.to_json(F.struct(F.array(image(prediction)).alias("outputs"), F.array(image(case)).alias("inputs"), F.array().cast("array<string>").alias("error_messages")))


def dataset_json(channels: Mapping[str, str], labels: DataFrame, cases: DataFrame, suffix: str) -> DataFrame:
    """One row ``json``: a dataset's description from ``labels(name, value)`` and its number of ``cases``."""
    names = labels.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("labels"))  # a row a label
    table = F.create_map(*[F.lit(x) for pair in channels.items() for x in pair])
    count = cases.agg(F.count(F.lit(1)).alias("n")).scalar()
    return names.select(F.to_json(F.struct(table.alias("channel_names"), "labels", count.alias("numTraining"), F.lit(suffix).alias("file_ending"))).alias("json"))


def inference_command(dataset: Column, config: Column, trainer: Column, plans: Column, folds: Column) -> Column:
    """The command that predicts with a model."""
    return F.format_string("predict -d %s -c %s -tr %s -p %s -f %s", dataset, config, trainer, plans, F.array_join(F.transform(folds, lambda f: f.cast("string")), " "))


def write_csv(table: DataFrame, path: str, distinct: bool = True, append: bool = False) -> None:
    """``table`` as CSV files with a header, repeated rows dropped if asked for, in place of what is there or besides it."""
    (table.dropDuplicates() if distinct else table).write.mode("append" if append else "overwrite").csv(path, header=True)


def write_json(table: DataFrame, path: str) -> None:
    """``table`` as JSON lines; maps, arrays and structs keep their form."""
    table.write.mode("overwrite").json(path)


def write_lines(table: DataFrame, path: str, line: str = "line") -> None:
    """Lines of text in order of their content."""
    table.select(line).distinct().sort(line).write.mode("overwrite").text(path)


# -- keyed stores and buffers


def changed_store(store: DataFrame, changes: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """A keyed store after ``changes(key, value, deleted)`` in their ``ord``: the last change of a key holds, and deleted keys go."""
    rows = store.select(key, value, F.lit(-1).cast("long").alias("ord"), F.lit(False).alias("deleted")).unionByName(changes.select(key, value, F.col("ord").cast("long").alias("ord"), "deleted"))
    last = rows.groupBy(key).agg(F.max_by(F.struct(value, "deleted"), "ord").alias("_l"))
    return last.filter(~F.col("_l.deleted")).select(key, F.col(f"_l.{value}").alias(value))


def stored_json(store: DataFrame, keys: DataFrame, schema: str, key: str = "key", value: str = "value") -> DataFrame:
    """``keys`` with the store's value parsed, null where it has none."""
    return keys.join(store.select(key, F.from_json(value, schema).alias(value)), key, "left")


def collated(batches: DataFrame, by: Sequence[str], order: str, scalars: Sequence[str] = (), lists: Sequence[str] = ()) -> DataFrame:
    """Outputs of the batches of a group as one row: scalars listed in order, lists flattened in order. For a few batches a group."""
    parts = F.array_sort(F.collect_list(F.struct(order, *scalars, *lists)))
    rows = batches.groupBy(*by).agg(parts.alias("_p"))
    each = lambda c: F.transform("_p", lambda p: p[c])
    return rows.select(*by, *[each(c).alias(c) for c in scalars], *[F.flatten(each(c)).alias(c) for c in lists])


def buffered_mean(buffers: DataFrame, by: Sequence[str], value: str, reduction: str = "mean") -> DataFrame:
    """What a metric gathers over processes and batches, reduced: ``mean`` (nulls left out), ``sum``, or ``mean_batch``, the mean of each batch's mean."""
    if reduction == "mean_batch":
        return buffers.groupBy(*by, "batch").agg(F.avg(value).alias("_m")).groupBy(*by).agg(F.avg("_m").alias(value))
    return buffers.groupBy(*by).agg((F.sum(value) if reduction == "sum" else F.avg(value)).alias(value))


def logged(log: DataFrame, key: str = "key", epoch: str = "epoch", value: str = "value", ord_: str = "ord") -> DataFrame:
    """One value for each key and epoch, the last one logged; an error, when it runs, for an epoch that follows a gap."""
    last = log.groupBy(key, epoch).agg(F.max_by(value, ord_).alias(value))
    at = F.row_number().over(W.partitionBy(key).orderBy(epoch)) - 1
    gap = F.when(F.col(epoch) != F.col("_at"), F.raise_error(F.concat(F.lit("epochs missing before "), F.col(epoch).cast("string")))).otherwise(F.lit(True))
    return last.withColumn("_at", at).filter(gap).drop("_at")


def with_originals(made: DataFrame, originals: DataFrame) -> DataFrame:
    """Augmented rows and the originals, told apart by ``augmented``."""
    return made.withColumn("augmented", F.lit(True)).unionByName(originals.withColumn("augmented", F.lit(False)))
