"""Mixing sources to target weights by hash-random keys, distributed prefix sums and an exact cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.llm import common

#: Bits of the hash-random keys, 13 hex digits of an MD5, and how many of the highest deal them to ranges.
KEY_BITS, RANGE_BITS = 52, 30


def word_count(text: Column) -> Column:
    """Number of words of ``text``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``sources(skey, source, source_size)`` with the words that the mix shall take of each: ``target``.

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` of all words. No target exceeds
    ``cap`` times its source's words; what is beyond goes to the others by weight until none is above. That is a water
    level: ``min(cap * source_size, level * weight)``, found by one ordered pass over the sources (one row each).
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    order = W.orderBy(F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    before = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    level = (
        sources.withColumn("weight", F.element_at(w, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("spent", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.greatest((F.col("all_words") - F.col("spent")) / F.col("rest"), F.lit(0.0)))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))).over(everything))
    )
    target = F.least("limit", F.coalesce(F.col("final.level") * F.col("weight"), F.col("limit")))
    return level.select("skey", "source", "source_size", target.alias("target"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``docs`` with ``_size``, ``_skey`` (the source, null told apart) and the hash-random ``_key``."""
    return docs.withColumns({
        "_size": word_count(F.col(text_col)),
        "_skey": F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null")),
        "_key": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long"),
        "_id": F.struct(F.col(id_col)),
    })


def cuts(docs: DataFrame, weights: Sequence[float], share: float, cap: float, id_col: str, text_col: str, source_col: str, seed: int, per_bucket: int) -> DataFrame:
    """Of each source: ``target``, whole ``epochs``, and where the last epoch ends in the order of the keys.

    Each source's keys are split into ranges of about ``per_bucket`` rows. Sums of the ranges are added up in order; only the
    range in which the budget ends is sorted, so no window holds more than one range of one source.
    """
    rows = common.cut(sized(docs, id_col, text_col, source_col, seed).select("_skey", F.col(source_col).alias("source"), "_key", "_id", "_size"))
    sources = rows.groupBy("_skey").agg(F.first("source").alias("source"), F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    sources = common.cut(sources.withColumnRenamed("_skey", "skey"))
    budget = targets(sources, weights, share, cap).withColumn("budget", F.floor("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    )
    plan = common.cut(
        budget.join(sources.select("skey", "_rows"), "skey")
        .withColumn("_rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
        .withColumn("_ranges", F.ceil(F.col("_rows") / F.lit(per_bucket)))
    )
    # as the key's share of all keys: 30 of its bits times the number of ranges stay within 64 bits
    bucket = F.shiftright(F.shiftright("_key", KEY_BITS - RANGE_BITS) * F.col("_ranges"), RANGE_BITS)
    placed = common.lookup(rows.drop("source"), plan.select(F.col("skey").alias("_skey"), "_ranges", "_rest"), ["_skey"], "inner").withColumn("_bucket", bucket)
    sums = placed.groupBy("_skey", "_bucket").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"))
    through = F.sum("_words").over(W.partitionBy("_skey").orderBy("_bucket"))
    last = common.cut(
        sums.withColumn("_through", through)
        .filter((F.col("_through") > F.col("_rest")) & (F.col("_through") - F.col("_words") <= F.col("_rest")))
        .select("_skey", "_bucket", (F.col("_rest") - F.col("_through") + F.col("_words")).alias("_left"))
    )
    tied = common.lookup(placed.select("_skey", "_bucket", "_key", "_id", "_size"), last, ["_skey", "_bucket"], "inner")
    tied = tied.groupBy("_skey", "_bucket", "_key", "_id").agg(F.sum("_size").alias("_words"), F.first("_left").alias("_left"))
    upto = F.sum("_words").over(W.partitionBy("_skey", "_bucket").orderBy("_key", "_id"))
    ends = (
        tied.withColumn("_upto", upto)
        .filter((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_words") <= F.col("_left")))
        .select(F.col("_skey").alias("skey"), F.col("_key").alias("cut_key"), F.col("_id").alias("cut_id"), F.col("_words").alias("cut_words"), (F.col("_left") - F.col("_upto") + F.col("_words")).alias("cut_taken"))
    )
    return common.cut(plan.join(ends, "skey", "left").select("skey", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_words", "cut_taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 20, per_bucket: int = 10_000) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``: how many words of each document the mix takes.

    Documents of a source stand in the order of a hash of their id; the mix takes the source's words in that order, again
    from the front in every further epoch, until the source's budget (its target rounded down) is spent. The last document of
    the last epoch is taken in part, so each source meets its budget exactly.

    Null text has size 0; null sources form a source of their own, the last; a null id sorts first. Ids may be of any type that has an order. A row for each source is
    ordered in one task, so sources should be thousands at most, not hosts. Rows of equal id and source
    stand at one place of the order; where the cut falls on them they share what is left in proportion to their sizes, rounded down. An
    empty table gives an empty result. Input columns of the four names are replaced.
    """
    plan = cuts(docs, weights, share, cap, id_col, text_col, source_col, seed, per_bucket)
    found = common.lookup(sized(docs, id_col, text_col, source_col, seed), plan.select(*[F.col(c).alias(f"_p_{c}" if c != "skey" else "_skey") for c in plan.columns]), ["_skey"])
    before = (F.col("_key") < F.col("_p_cut_key")) | (F.col("_key") == F.col("_p_cut_key")) & (F.col("_id") < F.col("_p_cut_id"))
    at = (F.col("_key") == F.col("_p_cut_key")) & (F.col("_id") == F.col("_p_cut_id"))
    part = F.when(before, F.col("_size")).when(at, F.floor(F.col("_size") * F.col("_p_cut_taken") / F.col("_p_cut_words"))).otherwise(F.lit(0).cast("long"))
    new = {"size": F.col("_size"), "source_size": F.col("_p_source_size"), "target": F.col("_p_target"), "taken": F.col("_p_epochs") * F.col("_size") + part}
    kept = [c for c in docs.columns if c not in new]
    return found.select(*kept, *[x.alias(c) for c, x in new.items()])


def copies(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a row for each time that a document is taken.

    A document taken in part appears as its first words joined by single spaces. Documents of size 0 are not taken.
    Columns that are named like those of :func:`mix` stay as they are.
    """
    text = options.get("text_col", "text")
    own = ("size", "source_size", "target", "taken")
    mixed = mix(common.aside(docs, *own), **options)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    part = F.col("taken") - full * F.col("size")
    words = F.filter(F.split(F.col(text), common.SPACE), lambda w: w != "")
    taken = F.when(F.col("_copy") <= full, F.col(text)).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    out = mixed.filter(F.col("taken") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), full + F.when(part > 0, 1).otherwise(0))))
    out = out.withColumn("_taken", taken)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("_taken").cast("long"))
    return out.select(*[F.col("_taken").alias(text) if c == text else common.back(c, *own) for c in docs.columns])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix over all documents."""
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op10_source_mix": op10_source_mix}
SQL = {
    "op10_source_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('20:' || doc_id::VARCHAR), 1, 13))::BIGINT AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source),
r AS (SELECT *, 2.0::DOUBLE * source_size AS lim, 2.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(lim, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * w, lim)) AS target
  FROM l),
p AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken
FROM p
""",
}
