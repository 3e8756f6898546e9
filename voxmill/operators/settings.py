"""Nested settings: documents as tables of paths, merged by path and put together again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.operators import shared


def union_settings(first: Column, second: Column) -> Column:
    """Two maps of lists as one: a key's list holds what either has, each value once and in order; keys without values go."""
    joined = F.map_zip_with(first, second, lambda k, a, b: F.array_sort(F.array_union(F.coalesce(a, b), F.coalesce(b, a))))
    return F.map_filter(joined, lambda k, v: F.size(v) > 0)


def flattened(documents: DataFrame, key: Sequence[str], document: str = "document") -> DataFrame:
    """``(*key, path, value, kind)``: a row for each leaf of JSON ``document``s. ``path`` lists the names on the way, ``value`` is the leaf as JSON and ``kind`` its type; lists and empty objects are leaves.

    Documents are parsed once, as variants; objects are opened level by level, all of a level at once, so there are as many rounds as levels. Null documents have no leaves, broken ones are an error.
    """
    left = documents.select(*key, F.array().cast("array<string>").alias("path"), F.parse_json(document).alias("_v")).filter("_v IS NOT NULL")
    leaves = None
    while True:
        left = shared.cut(left.withColumn("kind", F.schema_of_variant("_v")))
        opens = F.col("kind").startswith("OBJECT<") & (F.col("kind") != "OBJECT<>")
        found = left.filter(~opens).select(*key, "path", F.to_json("_v").alias("value"), "kind")
        leaves = found if leaves is None else leaves.unionByName(found)
        more = left.filter(opens)
        if not more.limit(1).count():
            return leaves
        inside = more.lateralJoin(documents.sparkSession.tvf.variant_explode(F.col("_v").outer()).select(F.col("key").alias("_name"), F.col("value").alias("_inner")))
        left = inside.select(*key, F.concat("path", F.array("_name")).alias("path"), F.col("_inner").alias("_v"))


def merged(layers: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """``(*key, path, value, kind)`` of layers as :func:`flattened` gives them: of one path the last layer's leaf; a leaf takes the place of an earlier object of its path, and an object that of an earlier leaf.

    Paths meet by key, as they are and by the paths above them; no document is held as a whole.
    """
    rows = None
    for k, layer in enumerate(layers):
        part = layer.select(*key, "path", "value", "kind", F.lit(k).alias("_layer"))
        rows = part if rows is None else rows.unionByName(part)
    above = F.transform(F.sequence(F.lit(0), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))
    last = shared.cut(rows.groupBy(*key, "path").agg(F.max_by(F.struct("value", "kind", "_layer"), "_layer").alias("_l")).select(*key, "path", "_l.*"))
    inner = last.filter(F.size("path") > 0).select(*key, "path", F.col("_layer").alias("_own"), F.explode(above).alias("_up"))
    leaf = last.select(*key, F.col("path").alias("_up"), "_layer")
    met = inner.join(leaf, [*key, "_up"])  # a leaf somewhere above another one: the later of the two stays
    gone = met.select(*key, F.when(F.col("_layer") > F.col("_own"), F.col("path")).otherwise(F.col("_up")).alias("path")).distinct()
    return last.join(gone, [*key, "path"], "left_anti").select(*key, "path", "value", "kind")


def rebuilt(leaves: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, document)``: JSON of ``(*key, path, value)``, the names of each object in order. From the deepest level up, an object is put together from its values."""
    rows = shared.cut(leaves.select(*key, "path", "value"))
    deepest = rows.agg(F.max(F.size("path"))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        here = F.size("path") == depth
        name = F.element_at("path", -1)
        quoted = F.regexp_extract(F.to_json(F.array(name)), r"(?s)^\[(.*)\]$", 1)
        parts = F.sort_array(F.collect_list(F.struct(name.alias("n"), F.concat(quoted, F.lit(":"), F.col("value")).alias("t"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(parts, lambda p: p["t"]), ","), F.lit("}"))
        objects = rows.filter(here).groupBy(*key, F.slice("path", F.lit(1), F.lit(depth - 1)).alias("path")).agg(text.alias("value"))
        rows = rows.filter(~here).unionByName(objects)
    return rows.select(*key, F.col("value").alias("document"))


def merge_documents(layers: Sequence[DataFrame], key: Sequence[str], document: str = "document") -> DataFrame:
    """``(*key, document)``: nested documents of several tables as one for each key, later tables winning path by path."""
    return rebuilt(merged([flattened(t, key, document) for t in layers], key), key)


def differing(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, path, before, after)``: the leaves in which two flattened tables differ."""
    both = first.select(*key, "path", F.col("value").alias("before")).join(second.select(*key, "path", F.col("value").alias("after")), [*key, "path"], "full_outer")
    return both.filter(~F.col("before").eqNullSafe(F.col("after")))


def instance_metadata(voxels: DataFrame, case: str = "case_id", label: str = "label", names: dict[int, str] | None = None) -> DataFrame:
    """``(case, name, document)``: the file name ``<case>_instances.json`` and its content, the voxels, box and centroid of each label but the background, by name."""
    named = F.create_map(*[F.lit(x) for k, n in (names or {}).items() for x in (k, n)]) if names else F.create_map().cast("map<int,string>")
    title = F.coalesce(F.try_element_at(named, F.col(label).cast("int")), F.concat(F.lit("label_"), F.col(label).cast("string")))
    axes = lambda f: F.array(*[f(c) for c in "xyz"])
    rows = voxels.filter(F.col(label) != 0).groupBy(case, label).agg(F.count(F.lit(1)).alias("voxels"), axes(F.min).alias("low"), axes(lambda c: F.max(c) + 1).alias("high"), axes(lambda c: F.round(F.avg(c), 4)).alias("centroid"))
    entry = F.struct(title.alias("k"), F.struct("voxels", "low", "high", "centroid").alias("v"))
    one = rows.groupBy(case).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("instances"))  # an entry for each label
    return one.select(case, F.concat(F.col(case).cast("string"), F.lit("_instances.json")).alias("name"), F.to_json(F.struct("instances")).alias("document"))
