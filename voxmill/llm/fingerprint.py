"""Document fingerprints: one-permutation MinHash, optimally densified, kept as low-order bits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.llm import common

#: Bins of the one permutation; hex digits kept of each bin's minimum (8 bits are two digits); words in a shingle.
BINS, DIGITS, WIDTH = 128, 2, 5
#: Bins that an empty bin asks before it looks for the nearest filled one by hash.
ATTEMPTS = 8
BITS = 4 * DIGITS


def _with(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hash of every shingle of ``width`` words of the lower-cased text; fewer words are one shingle, no words none.

    Words are hashed once; a shingle is the hash of its words' hashes.
    """
    words = F.filter(F.split(common.ascii_lower(text), common.SPACE), lambda w: w != "")
    at = lambda hs, k: F.get(hs, k)
    long = lambda hs: F.transform(F.sequence(F.lit(0), F.size(hs) - width), lambda i: F.xxhash64(*[at(hs, i + k) for k in range(width)]))
    short = lambda hs: F.when(F.size(hs) > 0, F.array(F.xxhash64(hs))).otherwise(F.array().cast("array<bigint>"))
    return _with(F.transform(words, lambda w: F.xxhash64(w)), lambda hs: F.when(F.size(hs) >= width, long(hs)).otherwise(short(hs)))


def _asked(bins: int, attempts: int) -> list[list[int]]:
    """The bins that an empty bin asks, in order: a fixed table of hashes of (bin, attempt)."""
    digest = lambda i, t: hashlib.blake2b(f"{i}:{t}".encode(), digest_size=8).digest()
    return [[int.from_bytes(digest(i, t), "little") % bins for t in range(attempts)] for i in range(bins)]


def densify(known: Column, bins: int = BINS, attempts: int = ATTEMPTS) -> Column:
    """``known``, an array of ``bins`` values of which some but not all are null, with the nulls filled.

    Optimal densification: an empty bin asks the bins that a universal hash of (bin, attempt) names until one is filled, so
    each empty bin draws on its own and two documents draw alike. Should all ``attempts`` fail, it takes the filled bin of
    the smallest hash with its own number, which ends the search for any document.
    """
    table = F.lit(_asked(bins, attempts))
    held = lambda ks: F.filter(F.transform(ks, lambda k, i: F.struct(i.alias("i"), k.alias("v"))), lambda x: x["v"].isNotNull())
    last = lambda fs, i: F.array_min(F.transform(fs, lambda f: F.struct(F.xxhash64(i, f["i"]), f["v"].alias("v"))))["v"]

    def fill(ks: Column, fs: Column) -> Column:
        asks = lambda i: [F.get(ks, F.get(F.get(table, i), F.lit(t))) for t in range(attempts)]
        return F.transform(ks, lambda k, i: F.when(k.isNotNull(), k).otherwise(F.coalesce(*asks(i), last(fs, i))))

    return _with(known, lambda ks: _with(held(ks), lambda fs: fill(ks, fs)))


def fingerprint_bits(hashes: Column, bins: int = BINS) -> Column:
    """The fingerprint of an array of shingle hashes as ``bins`` small numbers; an empty array for no shingles.

    The bin is the hash modulo ``bins``; of the rest, the smallest in each bin is kept, and of that the ``BITS`` low-order bits. All of it
    happens inside the row: sorted by (bin, rest) together with the largest rest for each bin, the first of each bin is its minimum, and an empty bin has
    that largest rest only.
    """
    power = bins.bit_length() - 1
    if bins != 1 << power:
        raise ValueError("the number of bins must be a power of two")
    width = 63 - power
    top = (1 << width) - 1
    ends = F.lit([(i << width) | top for i in range(bins)]).cast("array<bigint>")
    placed = F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(bins - 1)), width).bitwiseOR(F.least(F.shiftrightunsigned(h, power + 1), F.lit(top - 1))))
    bin_of = lambda x: F.shiftright(x, width)
    firsts = _with(F.sort_array(F.concat(placed, ends)), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    known = F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(top)) != top, x.bitwiseAND(F.lit(top))))
    low = F.transform(densify(known, bins), lambda v: v.bitwiseAND(F.lit((1 << BITS) - 1)).cast("smallint"))
    return F.when(F.size(hashes) > 0, low).otherwise(F.array().cast("array<smallint>"))


def _text_bits(text: Column) -> Column:
    return _with(shingle_hashes(text), lambda hashes: fingerprint_bits(hashes))


def packed(bits: Column) -> Column:
    """The fingerprint as text: ``DIGITS`` hex digits a bin, empty for a document without shingles."""
    return F.array_join(F.transform(bits, lambda v: F.lower(F.lpad(F.hex(v.cast("long")), DIGITS, "0"))), "")


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard similarity of the shingle sets of two fingerprints (their ``bits``), from 0 to 1.

    Bins agree by chance with probability 2^-b, which is taken out. Two documents without shingles are alike; one without is
    unlike any other.
    """
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda hit: hit))
    chance = 2.0**-BITS
    fair = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - F.lit(chance)) / F.lit(1.0 - chance))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)).otherwise(fair)


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, bits)`` of every row of ``docs``: equal texts have equal fingerprints.

    Null and empty texts, and texts of white space, have the empty fingerprint. Nothing is shuffled; ids may repeat or be null.
    """
    bits = _text_bits(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(id_col, bits.alias("bits")).select(id_col, packed(F.col("bits")).alias("fingerprint"), "bits")


def neighbours(ids: DataFrame, *order: str) -> DataFrame:
    """``ids`` with ``_next``, the last of the ``order`` columns of the row before it in that order; the first row's is that of the last row.

    Rows are dealt out by range; windows order each range, and the ends of the ranges (one row each) are joined in order.
    """
    *_, key = order
    parts = common.cut(ids.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ends = common.cut(parts.groupBy("_part").agg(F.max(F.struct(*order))[key].alias("_high")))
    ends = ends.select("_part", F.coalesce(F.lag("_high").over(W.orderBy("_part")), F.max_by("_high", "_part").over(W.partitionBy())).alias("_below"))
    near = parts.withColumn("_down", F.lag(key).over(W.partitionBy("_part").orderBy(*order)))
    near = near.join(F.broadcast(ends), "_part")  # a row for each partition
    return near.select(*ids.columns, F.coalesce("_down", "_below").alias("_next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, bits, edited, after)`` of every row: the bits of its text, of its edited text and of the next document.

    The next document is that of the next smaller id, and after the smallest the largest. Null ids count as the smallest. Rows of equal id stand in the order of a
    hash of their texts, so every input row has one output row. Rows of equal id and text are one document until the end: all but one of them are followed by
    themselves. A document that is alone is followed by itself.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text)).alias("_k"))
    ids = common.cut(docs.select("_k", "_id", F.length("_text").cast("long").alias("n")).groupBy("_k").agg(F.first("_id").alias("_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("m")))
    near = neighbours(ids, "_id", "_k").select("_k", "_next", "_id", "n", F.lit(1).cast("long").alias("_times"), F.lit(True).alias("_main"))
    again = ids.filter("m > 1").select("_k", F.col("_k").alias("_next"), "_id", "n", (F.col("m") - 1).alias("_times"), F.lit(False).alias("_main"))
    cases = common.cut(near.unionByName(again))
    # two readers of one shuffle: Spark reuses the exchange. What a document lends is cut to size before it is moved
    texts = docs.groupBy("_k").agg(F.first("_text").alias("_text"))
    half = F.floor(F.col("n") / 2).cast("int")
    lent = texts.withColumnsRenamed({"_k": "_next"}).join(cases, "_next").select("_k", "_next", "_id", "n", "_times", "_main", F.substring("_text", F.lit(1), half).alias("_lent"))
    both = texts.join(lent, "_k")
    edited = F.concat(F.substring("_text", F.lit(1), (F.col("n") - half).cast("int")), F.col("_lent"))
    wide = both.select("_k", "_next", "_id", "n", "_times", "_main", F.sha2(edited, 256).alias("edited_sha256"), _text_bits(F.col("_text")).alias("bits"), _text_bits(edited).alias("edited"))
    wide = common.stored(wide, "edited")
    after = wide.filter("_main").select(F.col("_k").alias("_next"), F.col("bits").alias("after"))
    out = wide.join(after, "_next").withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), "_times")))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", "bits", "edited", "after")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike both, and neighbours, are."""
    made = edited_fingerprints(common.read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("bits")).alias("fingerprint"), packed(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited")).alias("near_edited"), likeness(F.col("bits"), F.col("after")).alias("near_next"),
    )


QUERIES = {"op7_fingerprint": op7_fingerprint}
SQL: dict[str, str] = {}
