"""N-gram Jaccard self-join of documents over a token-group matrix, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import common

#: Counters of the frequency sketch, sets in a group, and visitors that one task compares with a group.
SKETCH_BITS, GROUP_SETS, VISITORS = 20, 128, 2_000
#: Rare shingles that a set must share with a group's union before the group is opened to it, and sets that every part of a large group is compared with.
SHARED, LEADERS = 2, 16
#: Shingles of a set up to which the matrix keeps its size and a token's place in it as they are; larger sets are of one kind.
EXACT = 64
#: Rows into which a task's sketch is cut, so that several tasks add them up; rows of units for each task.
_SLICES, _UNIT_ROWS = 64, 4_000
#: Rows of texts that a task holds the sets of at once.
_SLICE_ROWS = 500
#: Word hashes that a Python worker keeps.
_KEPT_WORDS = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < _KEPT_WORDS:
            self[word] = h
        return h


_HASHES = _WordHashes()


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``width`` words; fewer words are one run, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    runs = max(1, len(h) - width + 1)
    out = np.full(runs, min(len(h), width), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(len(h), width)):
            out = (out ^ h[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return np.unique(out)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for t in batch.column(column).cast(pa.large_binary()):
        yield t.as_py() or b""


def frequency_sketch(docs: DataFrame, text_col: str, width: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many (document, shingle) pairs fall to each of ``2**bits`` hash values: an array of fixed size, whatever the corpus.

    It only ranks shingles from rare to frequent; any ranking gives right results, a good one few candidates.
    """
    part = (1 << bits) // _SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in _texts(batch, 0):
                np.add.at(total, (shingles(text, width) >> np.uint64(64 - bits)).astype(np.int64), 1)
        rows = [total[k * part : (k + 1) * part].astype("<u4").tobytes() for k in range(_SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_SLICES), pa.int32()), pa.array(rows, pa.binary())], names=["slice", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(part, np.uint64)
        for c in rows["counts"]:
            total += np.frombuffer(c, "<u4")
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "_some": rows["_some"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    # a tree: slices of 64 tasks are added up, then those of 64 such sums, then all
    found = docs.select(text_col).mapInArrow(count, "slice int, counts binary").withColumn("_some", F.spark_partition_id().cast("long"))
    for _ in range(2):
        found = found.withColumn("_some", F.expr("_some div 64")).groupBy("slice", "_some").applyInPandas(lambda rows: add(rows), "slice int, _some long, counts binary")
    found = found.withColumn("_some", F.lit(0).cast("long")).groupBy("slice").applyInPandas(add, "slice int, _some long, counts binary").toPandas().sort_values("slice")
    return np.frombuffer(b"".join(found["counts"]) or bytes(4 << bits), "<u4")


def needed(n: int, percent: int) -> int:
    """How many rare shingles of a set of ``n`` each set that links with it has among its own."""
    return max(1, min(SHARED, (percent * n + 99) // 100))


def prefix(s: np.ndarray, sketch: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, so many that each set which links with it has :func:`needed` of them among its own.

    A link takes ``least = percent * n / 100`` common shingles; of those, at most ``least - k`` come after the first ``n - least + k``.
    """
    rank = sketch[(s >> np.uint64(64 - int(np.log2(len(sketch))))).astype(np.int64)]
    return s[np.lexsort((s, rank))[: len(s) - (percent * len(s) + 99) // 100 + needed(len(s), percent)]]


def parity(s: np.ndarray) -> bytes:
    """A bit for each of about ``len(s)`` hash values: whether an odd number of shingles falls to it.

    Two sets differ in at least as many shingles as their parities differ in bits, which bounds their overlap from above. The
    number of bits is a power of two, at least 64; a half of them is the parity of the other half's size, by exclusive or.
    """
    bits = max(64, 1 << (len(s) - 1).bit_length())
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _class(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """``(doc_id, n, class, prefix, parity)``: the set's size, its hash (equal sets are one class), its prefix and its parity bits."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, text_col, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, _SLICE_ROWS)):
            n, classes, prefixes, parities = [], [], [], []
            for text in _texts(batch, 1):
                s = shingles(text, width)
                n.append(len(s))
                classes.append(_class(s))
                prefixes.append(prefix(s, sketch.value, percent).view(np.int64) if len(s) else np.zeros(0, np.int64))
                parities.append(parity(s) if len(s) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(parities, pa.binary())],
                names=["doc_id", "n", "class", "prefix", "parity"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, n long, class long, prefix array<long>, parity binary")


def _fold(m: np.ndarray, times: int) -> np.ndarray:
    """Parity bits of so many halvings of the width."""
    for _ in range(times):
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return m


def _folded(parity: int, width: int, to: int) -> int:
    """Parity bits as one number, of ``width`` bits halved down to ``to``."""
    while width > to:
        width //= 2
        parity = (parity >> width) ^ (parity & ((1 << width) - 1))
    return parity


def _near(a: np.ndarray | int, b: np.ndarray | int, apart: np.ndarray | int, percent: int):
    """Whether sets of these sizes that differ in ``apart`` shingles at least may link."""
    return ((100 + percent) * apart <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))


def screen_unit(sizes: np.ndarray, parities: list[bytes], members: int, percent: int, inside: bool) -> np.ndarray:
    """Which sets of a unit may link with a member of its group, and which members with any: judged by sizes and parity bits.

    The first ``members`` are the group's. Sets of sizes a and b that link differ in at most ``(a + b) * (100 - percent) / (100 + percent)`` shingles. Members are
    compared with one another where ``inside`` holds, and with visitors always.
    """
    hit = np.zeros(len(sizes), bool)
    if len(sizes) <= 4:  # most units are that small
        n, bits, width = sizes.tolist(), [int.from_bytes(p, "little") for p in parities], [8 * len(p) for p in parities]
        for j in range(members):
            for k in range(j + 1 if inside else members, len(n)):
                if 100 * min(n[j], n[k]) >= percent * max(n[j], n[k]):
                    to = min(width[j], width[k])
                    apart = (_folded(bits[j], width[j], to) ^ _folded(bits[k], width[k], to)).bit_count()
                    if (100 + percent) * apart <= (100 - percent) * (n[j] + n[k]):
                        hit[j] = hit[k] = True
        return hit
    words = [np.frombuffer(b, np.uint64) for b in parities]
    width = np.array([len(w) for w in words])
    # sizes of sets that link are within a factor of 100 / percent, and so many halvings at most are between their numbers of bits
    steps = next(k for k in range(8) if (max(percent, 1) << k) >= 100)
    at_width = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    bits = {w: np.stack([words[k] for k in at]) for w, at in at_width.items()}
    for w, at in at_width.items():
        here = at < members
        own, mine = at[here], bits[w][here]
        for v, there in at_width.items():
            if not len(own) or max(v, w) > min(v, w) << steps:
                continue
            come = np.ones(len(there), bool) if inside else there >= members
            others, theirs = there[come], bits[v][come]
            k = min(v, w)
            left, right = _fold(mine, (w // k).bit_length() - 1), _fold(theirs, (v // k).bit_length() - 1)
            for lo in range(0, len(others), step := max(1, (1 << 20) // (len(own) * k))):
                some = others[lo : lo + step]
                apart = np.bitwise_count(left[:, None] ^ right[None, lo : lo + step]).sum(2, dtype=np.int64)
                near = _near(sizes[own][:, None], sizes[some][None], apart, percent) & (own[:, None] != some[None])
                hit[own[near.any(1)]] = True
                hit[some[near.any(0)]] = True
    return hit


def screen_units(rows: pd.DataFrame, percent: int, inside: bool) -> pd.DataFrame:
    """What :func:`screen_unit` leaves of each of many units, told apart by (group, chunk)."""
    group, chunk, own, classes = (rows[c].to_numpy() for c in ("group", "chunk", "own", "class"))
    order = np.lexsort((classes, ~own, chunk, group))
    group, chunk, own, sizes, parities = group[order], chunk[order], own[order], rows["n"].to_numpy()[order], rows["parity"].to_numpy()[order].tolist()
    starts = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])))
    hit = np.zeros(len(rows), bool)
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
        hit[lo:hi] = screen_unit(sizes[lo:hi], parities[lo:hi], int(own[lo:hi].sum()), percent, inside)
    return rows.iloc[order[hit]][["class", "group", "chunk", "own"]]


def solve_unit(rows: pd.DataFrame, percent: int, inside: bool) -> pd.DataFrame:
    """Links inside one unit: members of a group with the unit's visitors, and among themselves where ``inside`` holds.

    The union of the members' shingles bounds what a visitor can share with any of them; only visitors that may reach the
    threshold are compared. Returns each set's links, counted in documents, and the smallest set it is connected to here.
    """
    rows = rows.drop_duplicates("class").sort_values(["own", "class"], ascending=[False, True], kind="stable")
    sets = [np.frombuffer(b, np.uint64) for b in rows["shingles"]]
    sizes, copies, classes = np.array([len(s) for s in sets]), rows["copies"].to_numpy(), rows["class"].to_numpy()
    members = int(rows["own"].sum())
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    if members:
        owner = np.repeat(np.arange(members), sizes[:members])
        tokens = np.concatenate(sets[:members])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        union, start = np.unique(tokens, return_index=True)
        stop = np.append(start[1:], len(tokens))
        for k in range(0 if inside else members, len(sets)):
            at = np.searchsorted(union, sets[k])
            at = at[union[np.minimum(at, len(union) - 1)] == sets[k]]
            if 100 * len(at) < percent * sizes[k]:
                continue
            counts = stop[at] - start[at]
            flat = np.repeat(start[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared = np.bincount(owner[flat], minlength=members)
            hit = np.flatnonzero(100 * shared >= percent * (sizes[k] + sizes[:members] - shared))
            for m in hit[hit < k] if k < members else hit:
                links[k] += copies[m]
                links[m] += copies[k]
                a, b = find(k), find(int(m))
                root[max(a, b)] = min(a, b)
    tops = np.array([find(k) for k in range(len(sets))])
    return pd.DataFrame({"class": classes, "other": classes[tops], "links": links})


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the undirected ``edges(a, b)``: the smallest node that can be reached.

    Large-star and small-star rounds until nothing changes; each round is checkpointed, so lineage stays short.
    """
    edges = common.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = common.cut(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        after = mark(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def _class_of(width: int):
    """The class of a text's set, as a function of Columns."""
    return F.pandas_udf(lambda texts: pd.Series([_class(shingles(t or b"", width)) for t in texts], dtype="int64"), T.LongType())


def _solved(docs: DataFrame, classes: DataFrame, units: DataFrame, width: int, percent: int, id_col: str, text_col: str, inside: bool) -> DataFrame:
    """``(class, other, links)`` of ``units(class, group, chunk, own)``: what :func:`solve_unit` finds in each (group, chunk).

    First without the sets themselves, as their parity bits tell nearly all strangers apart; then the sets that are left are made
    from their texts and sent. The work of a unit isn't in proportion to its bytes, so the number of tasks follows the rows.
    """
    units = common.cut(units)
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units.count() // _UNIT_ROWS))
    bin_of = F.pmod(F.xxhash64("group", "chunk"), F.lit(tasks))
    screened = units.join(classes.select("class", "n", "parity"), "class").withColumn("bin", bin_of).repartition(tasks, "bin")
    screened = screened.groupBy("bin").applyInPandas(lambda rows: screen_units(rows, percent, inside), "class long, group long, chunk long, own boolean")
    stops = screened.groupBy("class").agg(F.collect_list(F.struct("group", "chunk", "own")).alias("stops"))
    stops = common.cut(stops.join(classes.select("class", F.col("rep").alias("_rep"), "copies"), "class"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, _SLICE_ROWS)):
            out: list[tuple] = []
            for text, cls, copies, places in zip(_texts(batch, 0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = shingles(text, width)
                if _class(s) == cls:  # ids may repeat with other texts
                    out += [(p["group"], p["chunk"], p["own"], cls, copies, s.tobytes()) for p in places]
            cols = list(zip(*out, strict=True)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["group", "chunk", "own", "class", "copies", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("_rep"), F.col(text_col).cast("binary").alias("_text"))
    named = common.lookup(texts, stops.filter("_rep IS NOT NULL"), ["_rep"], "inner").select("_text", "class", "copies", "stops")
    nameless = stops.filter("_rep IS NULL").drop("_rep")
    if nameless.limit(1).count():  # sets of rows without an id only are found by themselves
        own_class = _class_of(width)
        named = named.unionByName(texts.filter("_rep IS NULL").withColumn("class", own_class("_text")).join(nameless, "class").select("_text", "class", "copies", "stops"))
    sent = named.mapInArrow(send, "group long, chunk long, own boolean, class long, copies long, shingles binary")
    return common.cut(sent.groupBy("group", "chunk").applyInPandas(lambda rows: solve_unit(rows, percent, inside), "class long, other long, links long"))


def _least(n: Column, percent: int) -> Column:
    """How many shingles at least of a set of ``n`` are in any set that links with it."""
    return F.ceil(F.lit(percent) * n / 100)


def _shared(n: Column, percent: int) -> Column:
    """:func:`needed` of a set of ``n``, as a function of Columns."""
    return F.greatest(F.lit(1), F.least(F.lit(SHARED), _least(n, percent)))


def _may_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of ``n`` and ``m`` shingles may link if their rarest common one is the ``i``-th rarest of one and the ``j``-th of the other: all other common ones come after it. Zero sizes stand for all above ``EXACT``."""
    fit = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * (1 + F.least(n - i, m - j)) >= percent * (n + m))
    return F.when((n == 0) | (m == 0), (n + m == 0) | (100 * (n + m) > percent * EXACT)).otherwise(fit)


def _visits(hits: DataFrame, groups: DataFrame, labels: DataFrame | None, percent: int) -> DataFrame:
    """``(class, group)``: the groups of others that a set must be compared with.

    The matrix holds, for each token of a group's union, the sizes of the group's sets that have it and how many tokens of a set are rarer. Of two sets that link, the rarest common token
    leaves both enough shingles behind it, so a set is led from a token only to groups where that token stands in a fitting set at a fitting place; where texts are one template
    with a word of their own each, that is none, however many share the template's tokens. The tokens that a set finds in the whole union of such a group bound what it can
    share with any member, and only where they are as many as a link takes is the group opened.

    ``labels(class, label)`` names sets that are already known to be connected. Those need no comparison: of each token, the sets of its most
    frequent label stay where they are, and all others go to the groups that have it under another label. Without labels, each pair of groups that meet is opened once.
    """
    place = lambda c: F.when(F.col("n") <= EXACT, F.col(c)).otherwise(0).cast("long")
    matrix = common.cut(hits.select("token", "class", "n", place("n").alias("pn"), place("i").alias("pi")).join(groups, "class"))
    if labels is None:
        grouped = matrix.withColumn("label", F.col("class")).withColumn("out", F.lit(True))
    else:
        grouped = matrix.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
        counted = grouped.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"))
        most = counted.groupBy("token").agg(F.max_by("label", F.struct("m", "label")).alias("most"), F.count(F.lit(1)).alias("several")).filter("several > 1")
        grouped = grouped.join(most.drop("several"), "token").withColumn("out", F.col("label") != F.col("most")).drop("most")
    grouped = common.cut(grouped)
    there = grouped.groupBy("token", F.col("group").alias("to"), F.col("pn").alias("qn"), F.col("pi").alias("qi")).agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("label").alias("first"), F.max("label").alias("last"), F.bool_or(~F.col("out")).alias("home")
    )
    kinds = common.cut(grouped.groupBy("token", "pn", "pi").agg(F.count(F.lit(1)).alias("sets")))
    others = kinds.select("token", F.col("pn").alias("qn"), F.col("pi").alias("qi"))
    alone = (F.col("sets") == 1) & (F.col("pn") == F.col("qn")) & (F.col("pi") == F.col("qi"))
    fitting = kinds.join(others, "token").filter(_may_link(F.col("pn"), F.col("pi"), F.col("qn"), F.col("qi"), percent) & ~alone).select("token", "pn", "pi", "qn", "qi")
    fits = (100 * F.col("n") >= percent * F.col("low")) & (percent * F.col("n") <= 100 * F.col("high"))
    other = (F.col("to") != F.col("group")) & (F.col("home") | (F.col("to") > F.col("group"))) & ((F.col("first") != F.col("label")) | (F.col("last") != F.col("label")))
    led = grouped.filter("out").join(fitting, ["token", "pn", "pi"]).join(there, ["token", "qn", "qi"]).filter(other & fits)
    led = common.cut(led.groupBy("class", "to").agg(F.first("n").alias("n"), F.min("low").alias("low")))
    union = matrix.select("token", F.col("group").alias("to")).distinct()
    met = led.join(matrix.select("class", "token"), "class").join(union, ["token", "to"])
    met = met.groupBy("class", "to").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("low").alias("low"))
    return common.cut(met.filter(F.col("shared") >= F.least(_shared(F.col("n"), percent), _shared(F.col("low"), percent))).select("class", F.col("to").alias("group")))


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, group_sets: int, visitors: int, links: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and ``(class, rep, top, component_id)`` of the classes: ``top`` is a class of the component, ``rep`` the smallest id.

    With ``links``, ``n_links`` too.
    """
    rows = common.cut(signatures(docs, id_col, text_col, width, percent))
    classes = rows.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    classes = common.cut(classes)
    tokens = classes.select("class", "n", F.posexplode("prefix").alias("i", "token")).withColumn("i", F.col("i") + 1)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    hits = common.cut(tokens.join(shared, "token"))
    # a set that has fewer shared tokens than any link of it takes is linked with none
    takes = F.least(_shared(F.col("n"), percent), _shared(_least(F.col("n"), percent), percent))
    best = hits.groupBy("class").agg(F.max(F.struct("m", "token")).alias("best"), F.count(F.lit(1)).alias("found"), F.first("n").alias("n"))
    best = common.cut(best.filter(F.col("found") >= takes).select("class", F.col("best.token").alias("seed")))
    hits = hits.join(best.select("class"), "class", "left_semi")
    sizes = best.groupBy("seed").agg(F.ceil(F.count(F.lit(1)) / F.lit(group_sets)).alias("parts"))
    dealt = common.cut(best.join(sizes, "seed").withColumn("part", F.pmod(F.xxhash64("class"), "parts")).withColumn("group", F.xxhash64("seed", "part")))
    groups = dealt.select("class", "group")
    # the members of each group among themselves, and some sets of its seed, the same for each part of it
    several = groups.groupBy("group").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("group")
    units = groups.join(several, "group").select("class", "group", F.lit(True).alias("own"))
    if not links:
        split = dealt.filter("parts > 1")
        slot = F.pmod(F.xxhash64("class", F.lit("leader")), F.lit(LEADERS))
        leaders = split.groupBy("seed", "parts", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("class"), "class", "part")).alias("one"))
        leaders = leaders.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter(F.col("part") != F.col("one.part"))
        units = units.unionByName(leaders.select(F.col("one.class").alias("class"), F.xxhash64("seed", "part").alias("group"), F.lit(False).alias("own")))
    zero = F.lit(0).cast("long")
    found = _solved(docs, classes, units.select("class", "group", zero.alias("chunk"), "own"), width, percent, id_col, text_col, inside=True)
    label = components(found.select(F.col("class").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("class"), F.col("component").alias("label"))
    # what is left: sets not yet connected that may link all the same
    visits = _visits(hits, groups, None if links else label, percent)
    asked = common.cut(visits.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / F.lit(visitors)).alias("chunks")))
    own = groups.join(asked, "group").select("class", "group", F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("own"))
    guests = visits.join(asked, "group").select("class", "group", F.pmod(F.xxhash64("class"), "chunks").alias("chunk"), F.lit(False).alias("own"))
    more = _solved(docs, classes, own.unionByName(guests), width, percent, id_col, text_col, inside=False)
    named = lambda column: more.filter("class <> other").select(F.col(column).alias("class"), "_edge").join(label, "class", "left").select("_edge", F.coalesce("label", "class").alias(column))
    more = more.withColumn("_edge", F.xxhash64("class", "other"))
    between = named("class").join(named("other"), "_edge").select(F.col("class").alias("a"), F.col("other").alias("b"))
    joined = components(between).select(F.col("node").alias("label"), F.col("component").alias("_joined"))
    out = classes.select("class", "rep", "copies").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    out = common.cut(out.join(joined, "label", "left").withColumn("top", F.coalesce("_joined", "label")))
    lowest = out.groupBy("top").agg(F.min("rep").alias("component_id"))
    cols = ["class", "rep", "top", "component_id"]
    out = out.join(lowest, "top")
    if links:
        counted = found.unionByName(more.drop("_edge")).groupBy("class").agg(F.sum("links").alias("links"))
        out = out.join(counted, "class", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", zero))
        cols.append("n_links")
    return rows, out.select(*cols)


def jaccard_join(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group_sets: int = GROUP_SETS, visitors: int = VISITORS, links: bool = False
) -> DataFrame:
    """``(doc_id, n_shingles, class, component_id)`` of every document, and ``n_links`` if asked for.

    Documents are sets of runs of ``width`` words of the text with A-Z lower-cased; two link if ``100 * intersection >= percent * union``.
    Equal sets form a class and are joined once. Classes that share a rare shingle with another are put into groups of about ``group_sets``
    by the shingle that most of them share. Members of a group are compared with one another and, where one shingle makes many groups,
    with a few leaders that all of these have in common, which connects most of a large group of near copies in time proportional to its
    size. Only sets not connected so far are led to other groups, by the token-group matrix (:func:`_visits`). ``component_id`` is the smallest id
    reachable by links, itself included.

    ``n_links`` counts linked documents. Every pair of similar texts must be looked at for it, so it leaves out the leaders, and the work in a
    large group of near copies grows with the square of its size (in units of ``group_sets`` by ``visitors``).

    Null, empty and white-space texts have an empty set and no links; fewer than ``width`` words are one run. Rows with a null id
    are returned with a null component; they link, count as links and connect others as all rows do. Rows of equal id and text count as copies. Ids
    must be integers or null. Sets are compared by 64-bit hashes of their runs. Input columns but the two named are not read.
    """
    rows, label = _labelled(docs, width, percent, id_col, text_col, group_sets, visitors, links)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "class").join(label.drop("rep", "top"), "class", "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    counts = [F.when(alone, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links")] if links else []
    return out.select("doc_id", "n_shingles", "class", *counts, component)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", group_sets: int = GROUP_SETS, visitors: int = VISITORS) -> DataFrame:
    """``docs`` without all but one row of each component, one of the smallest id; texts without words all stay.

    That holds for rows of repeated and of null ids too: of a component, one row stays in all, and a null id stays only where no row of the
    component has an id. Of several rows of that id and set, the one of the smallest hash of its columns (maps, arrays and structs aside) stays.
    """
    rows, label = _labelled(docs, width, percent, id_col, text_col, group_sets, visitors)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "class")).alias("first")
    kept = common.cut(label.groupBy("top").agg(first).select(F.col("first.rep").alias("_kept"), F.col("first.class").alias("_class")))
    named = rows.filter("doc_id IS NOT NULL")
    several = common.cut(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("doc_id").alias("_kept")))
    ids = kept.filter("_kept IS NOT NULL").select("_kept").unionByName(named.filter("n = 0").select(F.col("doc_id").alias("_kept")))
    row_id = F.col(id_col).cast("long")
    out = docs.join(ids.join(several, "_kept", "left_anti"), row_id == F.col("_kept"), "left_semi")
    repeated, nameless = several.limit(1).count(), rows.filter("doc_id IS NULL").limit(1).count()
    if not repeated and not nameless:
        return out
    # rows that their id doesn't tell apart
    left = docs.filter(row_id.isNull())
    if repeated:
        left = left.unionByName(docs.join(several, row_id == F.col("_kept"), "left_semi"))
    own_class = _class_of(width)
    left = left.withColumn("_class", own_class(F.col(text_col).cast("binary"))).withColumn("_id", row_id)
    empty = F.col("_class") == F.lit(_class(np.zeros(0, np.uint64)))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)]
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    mine = kept.withColumnsRenamed({"_class": "_kept_class"})
    words = left.filter(~empty).join(mine, (F.col("_class") == F.col("_kept_class")) & F.col("_id").eqNullSafe(F.col("_kept")), "left_semi")
    one = words.groupBy("_class").agg(F.min_by(whole, F.xxhash64(*plain)).alias("_row")).select("_row.*")
    return out.unionByName(left.filter(empty).select(*docs.columns)).unionByName(one)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under three-word shingles and a similarity of 0.9."""
    docs = common.read(spark, sf_dir, "documents")
    return jaccard_join(docs, width=3, percent=90).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
SQL: dict[str, str] = {}
