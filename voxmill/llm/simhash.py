"""Near copies by SimHash: BK-trees over shards of fingerprints, and the components of their links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import common, near_join

#: Bits of a fingerprint, seed of a shingle's hash, and shingles whose bits are counted at once.
BITS, SEED, BLOCK = 64, 42, 1 << 16
#: Fingerprints of a shard before it is dealt anew by more of their bits, how often that happens at most, and rows of shards for each task.
SHARD, LEVELS, TASK_ROWS = 4_096, 5, 100_000
#: Searches that go down the trees of a task side by side.
_SEARCHES = 2_000


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint of a text: a bit is set if over half of the hashes of its runs of ``width`` words, repeats included, have it set.

    A-Z are lower-cased, words joined by single spaces; fewer words are one run; a text without words has fingerprint zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(length + 1) - 1
    reach = min(width, len(words)) - 1
    start, stop = (stop - length)[: len(words) - reach], stop[reach:]
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(start), BLOCK):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(start[lo : lo + BLOCK].tolist(), stop[lo : lo + BLOCK].tolist(), strict=True)]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, fp)`` of every row: the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash(t.as_py() or b"", width) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def parts(fixed: int, radius: int) -> list[int]:
    """The bits that ``fixed`` leaves free in ``radius + 1`` runs, each joined with ``fixed``: values that agree on ``fixed`` and differ in
    ``radius`` bits at most agree on one of these too."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    cuts = [len(free) * k // (radius + 1) for k in range(radius + 2)]
    return [fixed | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _deal(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """``rows(fp[, fixed])`` once for each part of the bits that are free at this level, as ``(fp, fixed)``."""
    masks = [0]
    for _ in range(level):
        masks = [m for mask in masks for m in parts(mask, radius)]
    finer = {m: F.array(*[F.lit(_signed(x)) for x in parts(m, radius)]) for m in masks}
    if level == 0:
        return rows.select("fp", F.explode(finer[0]).alias("fixed"))
    table = F.create_map(*[c for m, x in finer.items() for c in (F.lit(_signed(m)), x)])
    return rows.select("fp", F.explode(table[F.col("fixed")]).alias("fixed"))


def _key() -> Column:
    return F.col("fp").bitwiseAND(F.col("fixed"))


def shards(values: DataFrame, radius: int = 2, limit: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """``(fp, fixed)`` for distinct ``values(fp)``: the shards (``fixed`` and the value's bits there) in which a value meets all that are within ``radius``.

    A shard holds the values that agree on some of the bits. One of more than ``limit`` values is dealt anew by more bits, which keeps every pair within ``radius``
    together in one of the new shards; after five levels at radius 2 only 10 bits are free, so no shard can hold more than 4,096 values, however alike they are.
    """
    found, left = None, _deal(values, 0, radius)
    for level in range(1, levels):
        left = common.cut(left)
        large = left.groupBy("fixed", _key().alias("key")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("fixed", "key")
        large = common.cut(large)
        keyed, on = left.withColumn("key", _key()), ["fixed", "key"]
        small = keyed.join(large, on, "left_anti").select("fp", "fixed")
        found = small if found is None else found.unionByName(small)
        if not large.limit(1).count():
            return found
        left = _deal(keyed.join(large, on, "left_semi").select("fp", "fixed"), level, radius)
    return left if found is None else found.unionByName(left)


class Forest:
    """BK-trees of many shards as arrays. Each value is a node; a node has one child at most for each distance, and all below that child are at that distance from it.

    ``shard`` tells the values' shards, equal ones side by side; values of a shard are distinct.
    """

    def __init__(self, shard: np.ndarray, values: np.ndarray):
        first = np.append(True, shard[1:] != shard[:-1]) if len(shard) else np.zeros(0, bool)
        self.values, self.root = values, np.flatnonzero(first)[np.cumsum(first) - 1] if len(shard) else np.zeros(0, np.int64)
        node, at = np.flatnonzero(~first), self.root[~first]
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(node):  # all shards at once, a level of their trees in each round
            edge = at * (BITS + 1) + np.bitwise_count(values[node] ^ values[at])
            taken, lead, which = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(taken)
            children.append(node[lead])
            rest = np.ones(len(node), bool)
            rest[lead] = False
            node, at = node[rest], node[lead][which[rest]]
        edge, child = np.concatenate(edges), np.concatenate(children)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def within(self, nodes: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (node, other) with other values of the node's shard within ``radius``: of each node visited, only edges whose distance differs by at most ``radius`` are followed."""
        asked, at = nodes, self.root[nodes]
        while len(at):
            apart = np.bitwise_count(self.values[asked] ^ self.values[at]).astype(np.int64)
            hit = (apart <= radius) & (asked != at)
            yield asked[hit], at[hit]
            if not len(self.edge):
                return
            steps = apart[:, None] + np.arange(-radius, radius + 1)
            edge = np.where((steps > 0) & (steps <= BITS), at[:, None] * (BITS + 1) + steps, -1)
            place = np.minimum(np.searchsorted(self.edge, edge), len(self.edge) - 1)
            row, col = np.nonzero(self.edge[place] == edge)
            asked, at = asked[row], self.child[place[row, col]]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after the sets of each pair are joined: larger roots hang on smaller ones, then paths are shortened."""
    while True:
        low = np.minimum(root[a], root[b])
        apart = root[a] != root[b]
        if not apart.any():
            return root
        a, b, low = a[apart], b[apart], low[apart]
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (shorter := root[root] != root).any():
            root[shorter] = root[root[shorter]]


def shard_links(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """``(a, b)``: of the shards in ``rows(fp, fixed)``, each value and the first one of its shard that it is connected to there."""
    rows = rows.assign(key=rows["fp"] & rows["fixed"]).sort_values(["fixed", "key", "fp"])
    fixed, key, fp = (rows[c].to_numpy() for c in ("fixed", "key", "fp"))
    new = np.append(True, (fixed[1:] != fixed[:-1]) | (key[1:] != key[:-1])) if len(fp) else np.zeros(0, bool)
    forest, root = Forest(np.cumsum(new), fp.view(np.uint64)), np.arange(len(fp))
    for lo in range(0, len(fp), _SEARCHES):
        for a, b in forest.within(np.arange(lo, min(lo + _SEARCHES, len(fp))), radius):
            root = _join(root, a, b)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2, shard: int = SHARD) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row of ``docs``: 16 hex digits, and the smallest id reachable over fingerprints that differ in ``radius`` bits at most.

    Equal fingerprints are one value, looked for once. Values are dealt to shards by parts of their bits (:func:`shards`), so that those within the radius meet and no shard
    is large; the BK-trees of a shard's values are built and searched in one task, many shards side by side, and each value keeps one link for each shard.
    Star rounds join the links (:func:`near_join.components`).

    Null, empty and white-space texts have fingerprint zero and are linked like all others. Rows of equal ids are rows of their own. A row with a null id gets
    the smallest id of its component, null where no row of it has one. Other input columns are not read; an empty table gives an empty result.
    """
    rows = common.stored(fingerprints(docs, id_col, text_col, width), "simhash")
    values = common.cut(rows.groupBy("fp").agg(F.min("id").alias("rep")))
    dealt = common.cut(shards(values.select("fp"), radius, shard))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // TASK_ROWS))
    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("fixed", _key()), F.lit(tasks))).repartition(tasks, "task")
    links = dealt.groupBy("task").applyInPandas(lambda rows: shard_links(rows, radius), "a long, b long")
    top = near_join.components(links).select(F.col("node").alias("fp"), F.col("component").alias("top"))
    named = common.cut(values.join(top, "fp", "left").withColumn("top", F.coalesce("top", "fp")))
    named = named.select("fp", "top").join(named.groupBy("top").agg(F.min("rep").alias("component_id")), "top").select("fp", "component_id")
    out = rows.join(named, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within two bits."""
    return near_copies(common.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op13_simhash": op13_simhash}
SQL: dict[str, str] = {}
