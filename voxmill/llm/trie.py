"""The prefix trie of conversations: owned chains found by binary search against prefix-digest minima, aggregated bottom-up."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.llm import common

#: Prefix digests are sums of turn hashes times powers of BASE in the field of this many elements, so that parts of a conversation add up.
PRIME, BASE = 2**127 - 1, 0x5DEECE66D1F2C3B4A5968778695A4B3D % (2**127 - 1)
#: Turns at most that a conversation may take from another, digests that travel together, nodes of a chain that one window adds up, and ids in a piece of a list.
LEAD, BLOCK, SPAN, IDS = 3, 256, 1_024, 4_096
#: Characters of role and text that tell turns of one number apart when rows are dealt to ranges; within a range the whole texts decide.
_KEY_CHARS = 64


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def turn_hash(role: bytes, text: bytes) -> int:
    """A turn as an element of the field; the role's length keeps role and text apart."""
    return int.from_bytes(hashlib.blake2b(len(role).to_bytes(8, "big") + role + text, digest_size=16).digest(), "big") % PRIME


def numbered_turns(table: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """All turns in order, a conversation's as one run of rows in each range that has some of it.

    Rows ``turn``: ``(pid, conv_id, k, s, words)`` with the number ``k`` in the run and the run's digest ``s`` up to there. Rows ``run``: its length, digest and first turns. Ranges
    are cut within conversations too, so that no task holds a long one.
    """
    turns = table.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).filter("conv_id IS NOT NULL")
    n, first = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("turn").asc_nulls_first()
    ranges = turns.repartitionByRange(n, "conv_id", first, F.substring("role", 1, _KEY_CHARS), F.substring("text", 1, _KEY_CHARS))
    ranges = ranges.sortWithinPartitions("conv_id", first, "role", "text").select(F.spark_partition_id().alias("pid"), "conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, k, s, power, heads, pid = None, 0, 0, 1, b"", 0
        for batch in batches:
            rows = []
            pids, convs, roles, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()), batch.column(3).cast(pa.large_binary())
            for p, c, role, text in zip(pids, convs, roles, texts, strict=True):
                if c != conv:
                    if conv is not None:
                        rows.append(("run", pid, conv, k, _bytes(s), 0, heads))
                    conv, k, s, power, heads, pid = c, 0, 0, 1, b"", p
                body = text.as_py()
                t, words = turn_hash(role.as_py(), body), len(body.split())
                k, power = k + 1, power * BASE % PRIME
                s = (s + t * power) % PRIME
                if k <= LEAD:
                    heads += _bytes(t) + words.to_bytes(8, "big")
                rows.append(("turn", p, c, k, _bytes(s), words, None))
            yield _batch(rows)
        if conv is not None:
            yield _batch([("run", pid, conv, k, _bytes(s), 0, heads)])

    names, kinds = ("kind", "pid", "conv_id", "k", "s", "words", "heads"), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary())

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))

    return common.stored(ranges.mapInArrow(run, "kind string, pid int, conv_id long, k long, s binary, words long, heads binary"), "turns", "kind")


def _heads(runs: list[dict]) -> list[tuple[int, int]]:
    """(hash, words) of a conversation's first turns, at most ``LEAD``."""
    packed = b"".join(r["heads"] for r in runs[:LEAD])[: 24 * LEAD]
    return [(int.from_bytes(packed[at : at + 16], "big"), int.from_bytes(packed[at + 16 : at + 24], "big")) for at in range(0, len(packed), 24)]


def rebuilt(turns: DataFrame, base: Column, lead: Column) -> DataFrame:
    """What each conversation is put together from, by ``kind``.

    ``length``: its number of turns as ``depth``. ``head``: its first turns, those of the conversation ``base``, with their prefix digests ``a``. ``run``: how the digests of one run of its
    own turns go on: turn ``k > skip`` of the run has depth ``depth + k`` and digest ``a + f * s``.
    """
    runs = turns.filter("kind = 'run'").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pid", "k", "s", "heads"))).alias("runs"))
    runs = common.cut(runs.withColumn("base", base).withColumn("lead", lead))
    bases = runs.select(F.col("conv_id").alias("base"), F.slice("runs", 1, LEAD).alias("base_runs"))
    joined = runs.join(bases.join(runs.select("base").distinct(), "base", "left_semi"), "base", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "conv_id", "pid", "depth", "skip", "a", "f", "words")
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        for batch in batches:
            rows = []
            for c, h, own, other in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                taken = _heads(other or [])[:h]
                total, digest = sum(r["k"] for r in own), 0
                rows.append(("length", c, None, len(taken) + max(0, total - h), None, None, None, None))
                for i, (t, words) in enumerate(taken, 1):
                    digest = (digest + t * pow(BASE, i, PRIME)) % PRIME
                    rows.append(("head", c, None, i, None, _bytes(digest), None, words))
                # own turns keep their hashes and change their places by this many
                shift, seen = len(taken) - h, 0
                for i, (t, _) in enumerate(_heads(own)[:h], 1):
                    digest -= t * pow(BASE, i + shift, PRIME)
                for r in own:
                    factor = pow(BASE, seen + shift, PRIME)
                    rows.append(("run", c, r["pid"], seen + shift, h - seen, _bytes(digest % PRIME), _bytes(factor), None))
                    digest += factor * int.from_bytes(r["s"], "big")
                    seen += r["k"]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))

    parts = joined.select("conv_id", F.col("lead").cast("long"), "runs", "base_runs").mapInArrow(run, "kind string, conv_id long, pid int, depth long, skip long, a binary, f binary, words long")
    return common.stored(parts, "rebuilt", "kind")


def prefixes(turns: DataFrame, parts: DataFrame) -> DataFrame:
    """``(conv_id, depth, digest, words)``: every prefix of every conversation but the empty one, and the words of its last turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = lambda k: map(int.from_bytes, b.column(k).to_pylist())  # noqa: B023, E731
            found = [_bytes((a + f * s) % PRIME) for a, f, s in zip(number(2), number(3), number(4), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary()), b.column(5)], names=["conv_id", "depth", "digest", "words"])

    own = turns.filter("kind = 'turn'").select("conv_id", "pid", "k", "s", "words").join(parts.filter("kind = 'run'").select("conv_id", "pid", F.col("depth").alias("before"), "skip", "a", "f"), ["conv_id", "pid"])
    own = own.filter("k > skip").select("conv_id", (F.col("before") + F.col("k")).alias("depth"), "a", "f", "s", "words").mapInArrow(run, "conv_id long, depth long, digest binary, words long")
    heads = parts.filter("kind = 'head'").select("conv_id", "depth", F.col("a").alias("digest"), "words")
    return common.stored(own.unionByName(heads), "prefixes")


def _search(state: DataFrame, minima: DataFrame, probe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``state(conv_id, lo, hi, above, ..)`` with ``lo`` the first number from ``lo`` to ``hi`` at which the conversation owns its prefix (``hi`` if at none before).

    Each round asks for all conversations at once: ``probe`` adds the ``digest`` at ``mid``, and a join with ``minima(digest, owner)`` of the shared prefixes tells who owns it; a prefix
    that isn't shared is the conversation's own. ``above`` is the owner of the prefix at the last number that it doesn't own.
    """
    found, state, rest = [], common.cut(state), [c for c in state.columns if c not in ("conv_id", "lo", "hi", "above")]
    while True:
        found.append(state.filter("lo >= hi"))
        active = state.filter("lo < hi")
        if not active.limit(1).count():
            break
        told = probe(active.withColumn("mid", F.expr("(lo + hi) div 2"))).join(minima.select("digest", "owner"), "digest", "left")
        mine = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        lo, hi, above = F.when(mine, F.col("lo")).otherwise(F.col("mid") + 1), F.when(mine, F.col("mid")).otherwise(F.col("hi")), F.when(mine, F.col("above")).otherwise(F.col("owner"))
        state = common.cut(told.select("conv_id", lo.alias("lo"), hi.alias("hi"), above.alias("above"), *rest))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def owned(lengths: DataFrame, paths: DataFrame, minima: DataFrame) -> DataFrame:
    """``(conv_id, length, first, above)``: the first depth that each conversation owns (``length + 1`` for none), and the owner of the prefix before it (null at the root).

    A prefix belongs to the smallest conversation that starts with it, and who owns a prefix owns all longer ones of its own, so a binary search finds the first. Digests
    travel in blocks of ``BLOCK``: a conversation of several blocks first looks for its block by the blocks' last digests.
    """
    block = F.expr(f"(depth - 1) div {BLOCK}")
    blocks = common.cut(paths.groupBy("conv_id", block.alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("depth", "digest"))), lambda x: x["digest"]).alias("digests")))
    several = lengths.filter(F.col("length") > BLOCK)
    start = several.select("conv_id", F.lit(0).cast("long").alias("lo"), F.expr(f"(length - 1) div {BLOCK} + 1").alias("hi"), F.lit(None).cast("long").alias("above"), "length")
    ends = blocks.select("conv_id", F.col("block").alias("mid"), F.element_at("digests", -1).alias("digest"))
    at_block = _search(start, minima, lambda active: active.join(ends, ["conv_id", "mid"]))
    at_block = at_block.unionByName(lengths.filter(F.col("length") <= BLOCK).select("conv_id", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), F.lit(None).cast("long").alias("above"), "length"))
    inside = at_block.withColumn("block", F.col("lo")).join(blocks, ["conv_id", "block"], "left")
    before = F.col("block") * BLOCK
    size = F.greatest(F.lit(0), F.size("digests")).cast("long")
    # a block found by its last digest has an owned one; the only block of a short conversation may have none
    last = F.when(F.col("length") > BLOCK, F.least(F.col("length") + 1, before + size)).otherwise(F.col("length") + 1)
    state = inside.select("conv_id", F.least(F.col("length") + 1, before + 1).alias("lo"), F.when(F.col("digests").isNull(), F.least(F.col("length") + 1, before + 1)).otherwise(last).alias("hi"), "above", "length", "block", "digests")
    probe = lambda active: active.withColumn("digest", F.element_at("digests", (F.col("mid") - F.col("block") * BLOCK).cast("int")))
    return common.cut(_search(state, minima, probe).select("conv_id", "length", F.col("lo").alias("first"), "above"))


def bottom_up(chains: DataFrame) -> DataFrame:
    """``(conv_id, depth, chains, leaves, saved)``: what hangs below each node besides its own chain, summed over all chains that begin there.

    ``chains(conv_id, parent, at, leaves, saved)`` have their own figures. In each round the chains that nothing hangs on any more hand theirs to the chain above, so
    there are as many rounds as chains lie above one another, and each chain is handed on once.
    """
    given, left = [], common.cut(chains)
    while left.filter("parent IS NOT NULL").limit(1).count():
        waiting = left.filter("parent IS NOT NULL").select(F.col("parent").alias("conv_id")).distinct()
        ready = common.cut(left.join(waiting, "conv_id", "left_anti"))
        given.append(ready)
        sums = ready.groupBy(F.col("parent").alias("conv_id")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        left = left.join(ready.select("conv_id"), "conv_id", "left_anti").join(sums, "conv_id", "left")
        left = common.cut(left.select("conv_id", "parent", "at", *[(F.col(c) + F.coalesce(f"more_{c}", F.lit(0).cast("long"))).alias(c) for c in ("leaves", "saved")]))
    out = chains.limit(0)
    for g in given:
        out = out.unionByName(g)
    return common.cut(out.groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("chains"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))


def id_digests(ends: DataFrame) -> DataFrame:
    """``(conv_id, depth, sha)``: the SHA-256 of the ids in ``ends(owner, depth, conv_id)`` of each node, ascending and joined by commas.

    Ranges of sorted ids are joined to pieces first, so that a node at which very many conversations end sends few rows; its hash takes the pieces one after another, holding one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows = None, [], []
        for b in batches:
            for o, d, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (o, d) != key or len(ids) >= IDS:
                    if ids:
                        rows.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (o, d), []
                ids.append(c)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["owner", "depth", "lead", "ids"])
                rows = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, ids[0], ",".join(map(str, ids)))], names=["owner", "depth", "lead", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, rows = None, None, []
        for b in batches:
            for o, d, ids in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if (o, d) != key:
                    if key:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = (o, d), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["conv_id", "depth", "sha"])
                rows = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, sha.hexdigest())], names=["conv_id", "depth", "sha"])

    n, order = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["owner", "depth", "conv_id"]
    pieces = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(join, "owner long, depth long, lead long, ids string")
    pieces = pieces.repartition(n, "owner", "depth").sortWithinPartitions("owner", "depth", "lead").select("owner", "depth", "ids")
    return pieces.mapInArrow(digest, "conv_id long, depth long, sha string")


@dataclass(frozen=True)
class Trie:
    """``nodes``, a row for each distinct prefix, and ``ends(conv_id, owner, depth)``: the node that is the whole of each conversation."""

    nodes: DataFrame
    ends: DataFrame


def prefix_trie(
    conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Column | None = None, lead: Column | None = None
) -> Trie:
    """The trie of all conversations' turns (role and text), ordered by ``turn``.

    A node is a distinct sequence of first turns, named by the smallest conversation that starts with it, its owner, and its depth. ``nodes`` has ``conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``: the conversations that start with it, its child nodes, the childless nodes at or below it, the words that a cache of
    prefixes would save there and below, and the SHA-256 of the ids that end there. With ``base`` and ``lead`` (over ``conv_id``) a conversation's first ``lead`` turns, ``LEAD`` at most, are
    replaced by those of the conversation ``base``: all if that has fewer, none if there is no such one.

    The nodes that a conversation owns form a chain from its first owned depth to its end (:func:`owned`); each chain hangs on a node of another, and figures of subtrees are summed chain
    by chain (:func:`bottom_up`). Prefixes are told apart by 127-bit digests. A conversation's turns may fill many tasks, for digests of parts add up; lists of its
    runs have an entry for each task.

    Null turns come first; turns of equal number are in order of role, then text; repeated rows are turns of their own. Null roles and texts count as empty. Rows with a null id belong to no conversation and are left
    out. Other columns are not read. An empty table has no nodes, not even a root.
    """
    zero = F.lit(0).cast("long")
    turns = numbered_turns(conversations, id_col, turn_col, role_col, text_col)
    parts = rebuilt(turns, F.col("conv_id") if base is None else base, zero if lead is None else F.least(lead.cast("long"), F.lit(LEAD)))
    paths = prefixes(turns, parts)
    minima = common.cut(paths.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    lengths = parts.filter("kind = 'length'").select("conv_id", F.col("depth").alias("length"))
    root = lengths.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n")).first()
    owner, members = F.lit(root.owner).cast("long"), F.lit(root.n).cast("long")
    first = owned(lengths, paths, minima)
    above = F.coalesce("above", owner)
    ends = first.select("conv_id", F.when(F.col("first") <= F.col("length"), F.col("conv_id")).otherwise(above).alias("owner"), F.col("length").alias("depth"))
    is_root = F.col("conv_id") == owner
    chains = first.select("conv_id", "length", F.when(is_root, zero).otherwise(F.col("first")).alias("first"), F.when(~is_root, above).alias("parent"), F.when(~is_root, F.col("first") - 1).alias("at"))
    chains = common.cut(chains.filter("first <= length"))
    nodes = paths.join(chains, "conv_id").filter(F.col("depth") >= F.col("first")).join(minima.select("digest", "n"), "digest", "left")
    nodes = nodes.select("conv_id", "depth", "length", F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.coalesce("n", F.lit(1).cast("long")).alias("n_convs"), "words")
    nodes = nodes.unionByName(chains.filter("first = 0").select("conv_id", zero.alias("depth"), "length", F.lit(None).cast("long").alias("parent_conv_id"), members.alias("n_convs"), zero.alias("words")))
    nodes = common.stored(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")), "nodes")
    hung = chains.filter("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), F.col("at").alias("length"), F.lit(0).cast("long").alias("leaves")).distinct()
    own = chains.join(nodes.groupBy("conv_id").agg(F.sum("own").alias("saved")), "conv_id").join(hung, ["conv_id", "length"], "left")
    below = bottom_up(own.select("conv_id", "parent", "at", F.coalesce("leaves", F.lit(1).cast("long")).alias("leaves"), "saved"))
    nodes = nodes.join(below, ["conv_id", "depth"], "left")
    for c in ("chains", "leaves", "saved"):
        nodes = nodes.withColumn(c, F.coalesce(c, zero))
    last = F.col("depth") == F.col("length")
    nodes = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", (F.col("chains") + F.when(last, zero).otherwise(1)).alias("n_children"),
        (F.col("leaves") + F.when(last & (F.col("chains") == 0), 1).otherwise(0)).alias("leaves"), (F.col("own") + F.col("saved")).alias("saved"), F.expr(f"depth div {SPAN}").alias("span"), "length",
    )
    # sums from each node to the end of its chain: inside spans, and of whole spans behind
    nodes = common.cut(nodes)
    rest = W.partitionBy("conv_id").orderBy(F.desc("span")).rowsBetween(W.unboundedPreceding, -1)
    spans = nodes.filter(F.col("length") >= SPAN).groupBy("conv_id", "span").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    spans = spans.select("conv_id", "span", F.sum("leaves").over(rest).alias("far_leaves"), F.sum("saved").over(rest).alias("far_saved"))
    inside = W.partitionBy("conv_id", "span").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    nodes = nodes.withColumn("leaves", F.sum("leaves").over(inside)).withColumn("saved", F.sum("saved").over(inside)).join(spans, ["conv_id", "span"], "left")
    nodes = nodes.join(id_digests(ends), ["conv_id", "depth"], "left")
    nodes = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.coalesce("far_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("far_saved", zero)).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return Trie(nodes, ends)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with its first turns from the conversation at the twenty before."""
    own = F.col("conv_id")
    return prefix_trie(common.read(spark, sf_dir, "conversations"), base=own - own % 20, lead=F.crc32(own.cast("string")) % 4).nodes


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of a short ASCII text: a byte at a time, eight steps each."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda b: ascii(b)::BIGINT)), lambda c, b: {byte}), 4294967295)"


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
SQL = {
    "op11_prefix_trie": f"""
WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS path FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, path[1:d] AS path, d, d = len(path) AS whole FROM c, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)),
n AS (
  SELECT path, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN whole THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].t, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM p GROUP BY path, d),
k AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.path = n.path),
s AS (
  SELECT m.path[1:d] AS path, d AS depth, count(*) FILTER (m.n_children = 0) AS n_leaves, sum(m.saved) AS saved_tokens
  FROM m, LATERAL (SELECT unnest(range(0, m.depth + 1)) AS d) GROUP BY ALL)
SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.depth = m.depth AND s.path = m.path LEFT JOIN n u ON u.depth = m.depth - 1 AND u.path = m.path[1:m.depth - 1]
"""
}
