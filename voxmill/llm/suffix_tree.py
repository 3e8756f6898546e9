"""LM scoring by a probabilistic suffix tree: contexts of variable length, kept where they change what comes next."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.llm import common

#: Longest context, and the count that a run of tokens must have to be stored.
DEPTH, C_MIN = 4, 3
#: Taken from the count of each stored transition for those that aren't; nats by which a context must improve its training text.
DISCOUNT, DIVERGENCE = 0.75, 8.0
#: The most counted tokens and transitions (and a quarter as many states) that every task holds: so many at most, whatever the corpus. All others are joined by key.
HOT_TOKENS, HOT_RUNS = 1 << 19, 5 << 20
#: Bytes of text handled at once, runs of a length that a task sums before it sends them on, and bytes of training text for each slice of the counts.
BLOCK, SUMMED, SLICE = 1 << 20, 1_000_000, 2 << 20
#: Texts that are sent to a Python worker at once: JVM and worker each hold one such batch for a task.
ROWS = 1000
#: Runs of three tokens and what is looked up in the tables that are sent at once, in shares of the training tokens, and so many of either at least: more of them go in rounds, one part of the
#: keys, or of the texts, after another. Longer runs have smaller shares, as more is stored by then; lookups have one of their own, as each round sends the tables too.
SHARE, LOOKUPS, AT_ONCE = 0.9, 0.3, 1 << 22
#: Most bits of a filter of stored runs, as a power of two, and the parts into which a task's bits are cut.
FILTER_BITS, _PARTS = 25, 64
#: Longer words, in bytes, are hashed one by one.
_LONG_WORD = 64


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Batches of ``ROWS`` rows for what is run within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def run_key(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The key of runs whose parts without the last and without the first token are given: what ``xxhash64(before, after)`` gives in SQL.

    A token is its own key, so a run of any length is the pair of the two runs within it.
    """
    h: np.ndarray | np.uint64 = np.uint64(42)
    with np.errstate(over="ignore"):
        for x in (before, after):
            h = h + _P5 + np.uint64(8)
            h = h ^ (_turn(x * _P2, 31) * _P1)
            h = _turn(h, 27) * _P1 + _P4
            h ^= h >> np.uint64(33)
            h *= _P2
            h ^= h >> np.uint64(29)
            h *= _P3
            h ^= h >> np.uint64(32)
    return h


#: The bytes that separate words, and what is left of eight bytes of which so many belong to a word.
_BREAKS = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words ``text[start:end]``, eight bytes of all of them at a time."""
    eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))  # the eight bytes from each place on
    size = end - start
    h, left, at = run_key(size.astype(np.uint64), eights[start] & _KEEP[np.minimum(size, 8)]), np.flatnonzero((size > 8) & (size <= _LONG_WORD)), 8
    while len(left):
        h[left] = run_key(h[left], eights[start[left] + at] & _KEEP[np.minimum(size[left] - at, 8)])
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > _LONG_WORD):
        h[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]])
    return h


#: The end of a text; no word is empty. Before the first word it stands as the context.
END = word_hashes(b"", np.zeros(1, np.int64), np.zeros(1, np.int64))[0]


def _streams(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, first row, token hashes, tokens of each text) of runs of whole texts: ``END``, the words of a text, ``END``, the next text's, ..."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        _, places, data = texts.buffers()
        bounds = np.frombuffer(places, np.int64, len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
        first = 0
        while first < len(texts):
            last = min(int(np.searchsorted(bounds, bounds[first] + BLOCK)), len(texts))  # the first text that ends there or later, or all
            own = bounds[first : last + 1] - bounds[first]
            text = data.slice(bounds[first], own[-1]).to_pybytes().lower() if own[-1] else b""
            # a word begins and ends where words and breaks meet, or texts
            inside = np.concatenate([[False], ~_BREAKS[np.frombuffer(text, np.uint8)], [False]])
            turns = inside[1:] != inside[:-1]
            cuts = own[inside[own] & inside[own + 1]]  # one word ends and the next one begins
            turns[cuts] = False
            turns = np.flatnonzero(turns)
            start, end = np.sort(np.concatenate([turns[::2], np.unique(cuts)])), np.sort(np.concatenate([turns[1::2], np.unique(cuts)]))
            words = np.diff(np.searchsorted(start, own))
            h = np.full(len(start) + len(words) + 1, END)
            h[np.arange(1, len(start) + 1) + np.repeat(np.arange(len(words)), words)] = word_hashes(text, start, end)
            yield batch, first, h, words + 1
            first = last


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each distinct key starts in it."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, np.int64)


class Table:
    """Values by key, held in one flat array: a key's place follows from its high bits, and 32 of its low bits tell it from others there.

    Places are one and a half times the keys at least, and a key goes to the first free one from its own on.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.power = max(4, (3 * len(keys) // 2).bit_length())
        self.cells = np.zeros(1 << self.power, np.dtype([("value", values.dtype), ("mark", np.uint32)], align=True))
        self.cells["value"] = np.nan
        marks, at, left = keys.astype(np.uint32), self._places(keys).astype(np.int32), np.arange(len(keys), dtype=np.int32)
        owner = np.full(1 << self.power, -1, np.int32)
        while len(left):
            free = owner[at[left]] < 0
            owner[at[left[free]]] = left[free]  # of several the last one stays
            left = left[owner[at[left]] != left]
            at[left] = (at[left] + 1) & ((1 << self.power) - 1)
        del at, left
        there = np.flatnonzero(owner >= 0)
        self.cells["mark"][there], self.cells["value"][there] = marks[owner[there]], values[owner[there]]

    def _places(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.power)).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        at, marks = self._places(keys), keys.astype(np.uint32)
        found = self.cells.take(at)
        out, wrong = found["value"].copy(), found["mark"] != marks
        left = np.flatnonzero(wrong & ~np.isnan(out))
        out[wrong] = np.nan
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.power) - 1)
            found = self.cells.take(at[left])
            wrong = found["mark"] != marks[left]
            out[left[~wrong]] = found["value"][~wrong]
            left = left[wrong & ~np.isnan(found["value"])]
        return out


@dataclass
class Filter:
    """Four bits for each of a set of keys: what isn't in it for certain. Its size has a bound; beyond that it lets more through."""

    bits: np.ndarray
    power: int

    @staticmethod
    def places(keys: np.ndarray, power: int) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            place, step = keys * np.uint64(0xD6E8FEB86659FD93), (keys ^ (keys >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
            for _ in range(4):
                yield place >> np.uint64(64 - power)
                place = place + step

    def passes(self) -> float:
        """The share of keys that pass by chance."""
        return float(np.bitwise_count(self.bits).sum(dtype=np.int64) / (8 * len(self.bits))) ** 4

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), np.uint8)
        for at in self.places(keys, self.power):
            found &= self.bits.take((at >> np.uint64(3)).view(np.int64)) >> (at.astype(np.uint8) & np.uint8(7))
        return (found & 1).view(bool)


def _filter(keyed: DataFrame) -> Filter:
    """The filter of the column ``key`` of a stored table."""
    rows = keyed.count()
    power, tasks = min(FILTER_BITS, max(16, (12 * rows).bit_length())), min(256, 1 + rows // 1_000_000)
    part = (1 << power) // 8 // _PARTS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, some = np.zeros(1 << power, bool), False
        for batch in batches:
            some = some or batch.num_rows > 0
            for at in Filter.places(batch.column(0).to_numpy().view(np.uint64), power):
                bits[at.astype(np.int64)] = True
        if some:
            made = np.packbits(bits, bitorder="little")
            rows = [made[k * part : (k + 1) * part].tobytes() for k in range(_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "bits"])

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": rows["part"].iloc[:1], "bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]]).tobytes()]})

    kind = "part int, bits binary"
    made = keyed.select("key").coalesce(tasks).mapInArrow(mark, kind)
    if tasks > 16:
        some = made.withColumn("_some", F.pmod(F.spark_partition_id(), F.lit(16)))
        made = some.groupBy("part", "_some").applyInPandas(lambda rows: unite(rows), kind)
    found = made.groupBy("part").applyInPandas(unite, kind).toPandas().sort_values("part")
    return Filter(np.frombuffer(b"".join(found["bits"]) or bytes((1 << power) // 8), np.uint8), power)


# -- counts: each task sends its sums as one compact block for each slice of the keys


def _slice(before: np.ndarray, key: np.ndarray, slices: int) -> np.ndarray:
    """The slice of each run, ``slices`` of them or a few more. Runs of one ``before`` are spread over about the square root of them, so that
    blocks name it seldom, however many slices there are, and one that very many runs begin with isn't in one slice."""
    spread = 1 << (slices.bit_length() // 2)
    return before % np.uint64(-(-slices // spread)) * np.uint64(spread) + key % np.uint64(spread)


def rounds_for(runs: float, tokens: int, share: float) -> int:
    """Rounds in which so many runs are sent, so that a round's are a fixed share of the tokens."""
    return max(1, min(-(-int(runs) // AT_ONCE), int(np.ceil(runs / (share * max(tokens, 1))))))


def _round_of(key: Column, rounds: int) -> Column:
    """The round of each key; that of a run is its ``before``'s, so that a context's transitions meet in one round. Other bits than those of slices."""
    return F.shiftrightunsigned(key, 33) % rounds


def _blocks(length: int, before: np.ndarray, after: np.ndarray, slices: int) -> pa.RecordBatch:
    """(length, slice, block) of the counts of runs: a block has the distinct ``before``, how often each stands, then ``after`` and the counts."""
    if length == 1:  # all have one ``after``
        before, counts = np.unique(before, return_counts=True)
        after = np.zeros_like(before)
        key = run_key(before, after)
    else:
        key = run_key(before, after)
        order, first = _grouped(key)
        counts, at = np.diff(np.append(first, len(key))), order[first]
        key, before, after = key[at], before[at], after[at]
    place = _slice(before, key, slices)
    # by slice, and in it by ``before``
    order = np.argsort((place << np.uint64(44)) | (before >> np.uint64(20))) if slices < 1 << 19 else np.lexsort((before, place))
    place, before, after, counts = place[order].astype(np.int64), before[order], after[order], counts[order].astype("<u4")
    some, start = np.unique(place, return_index=True)
    blocks = []
    for lo, hi in zip(start, np.append(start[1:], len(place)), strict=True):
        firsts = np.flatnonzero(np.append(True, before[lo + 1 : hi] != before[lo : hi - 1]))
        stands = np.diff(np.append(firsts, hi - lo)).astype("<u4")
        head = np.array([hi - lo, len(firsts)], "<u4")
        blocks.append(b"".join(x.tobytes() for x in (head, before[lo:hi][firsts], stands, after[lo:hi], counts[lo:hi])))
    return pa.RecordBatch.from_arrays([pa.array([length] * len(some), pa.int32()), pa.array(some, pa.int64()), pa.array(blocks, pa.binary())], names=["length", "slice", "block"])


def _merged(rows: pd.DataFrame, least: int) -> Iterator[pd.DataFrame]:
    """The summed counts of the blocks of one slice, for each length; runs of several tokens from ``least`` on."""
    for length, blocks in rows.groupby("length")["block"]:
        before, after, counts = [], [], []
        for b in blocks:
            n, m = np.frombuffer(b, "<u4", 2).tolist()
            before.append(np.repeat(np.frombuffer(b, np.uint64, m, 8), np.frombuffer(b, "<u4", m, 8 + 8 * m)))
            after.append(np.frombuffer(b, np.uint64, n, 8 + 12 * m))
            counts.append(np.frombuffer(b, "<u4", n, 8 + 12 * m + 8 * n))
        before, after = np.concatenate(before), np.concatenate(after)
        order, first = _grouped(run_key(before, after))
        total, at = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first), order[first]
        kept = total >= (least if length > 1 else 1)
        yield pd.DataFrame({"length": np.int32(length), "pre": before[at][kept].view(np.int64), "suf": after[at][kept].view(np.int64), "c": total[kept]})


def _counted(train: DataFrame, text_col: str, runs, path: str, slices: int, turn: int = 0, rounds: int = 1) -> DataFrame:
    """A stored table ``(length, pre, suf, c)`` of what ``runs`` finds in a stream of tokens: (length, runs without their last, without their first token).

    A token has a ``suf`` of 0. ``slices`` follows the size of the texts, so what a task merges at once has a bound. Only runs of one of the ``rounds`` are sent.
    """
    slices = -(-slices // rounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes: dict[int, int] = {}

        def sums(length: int) -> pa.RecordBatch:
            sizes[length] = 0
            return _blocks(length, *map(np.concatenate, zip(*held.pop(length), strict=True)), slices)

        for _, _, h, _ in _streams(batches, 0):
            for length, before, after in runs(h):
                if rounds > 1:
                    own = (before >> np.uint64(33)) % np.uint64(rounds) == turn
                    before, after = before[own], after[own]
                if not len(before):
                    continue
                held.setdefault(length, []).append((before, after))
                sizes[length] = sizes.get(length, 0) + len(before)
                if sizes[length] >= SUMMED:
                    yield sums(length)
        for length in list(held):
            yield sums(length)

    sent = train.select(text_col).mapInArrow(count, "length int, slice long, block binary")
    merged = sent.groupBy("slice").applyInPandas(lambda rows: pd.concat([*_merged(rows, C_MIN)]), "length int, pre long, suf long, c long")
    with _few_rows(train.sparkSession):
        return common.stored(merged, path, "length")


def _short(h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All tokens but the first, and all pairs of a stream."""
    yield 1, h[1:], np.broadcast_to(np.uint64(0), len(h) - 1)
    yield 2, h[:-1], h[1:]


def _long(lengths: range, part: int, depth: int, parts, states):
    """Runs of ``lengths`` tokens whose runs of ``part`` tokens all are in ``parts``, and that a state of ``part - 1`` tokens reaches, or may extend as contexts."""

    def runs(h: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        keys = [h]
        while len(keys) < part:
            keys.append(run_key(keys[-1][:-1], keys[-1][1:]))
        key, fine = keys[-1], parts.has(keys[-1])
        may = fine  # of a run that starts here; the tokens in between don't end a text
        for k in range(1, part - 1):
            may = may & (h[k : k + len(may)] != END)
        for length in range(part + 1, lengths.stop):
            if len(key) < 2:
                return
            may = may[:-1] & fine[length - part :] & (h[length - 2 : -1] != END)
            if length in lengths:
                at = np.flatnonzero(may)
                reached = states.has(keys[-2][at + length - part])
                if length <= depth:  # its count is the size of a longer context
                    reached |= states.has(keys[-2][at + length - part + 1])
                at = at[reached]
                yield length, key[at], key[at + 1]
            key = run_key(key[:-1], key[1:])

    return runs


@dataclass
class Tree:
    """The hot part of the tree: the most counted tokens, states and transitions, with what each adds to a score.

    ``own`` is what a transition (a state and the next token) adds to the score of its last token, ``after`` what a state adds to that of the next token.
    Everything else is in tables; the filters tell which keys may be there. ``asked`` is how often texts like those of training look there, for each of their tokens (no less, by and large).
    """

    symbols: Table
    states: Table
    moves: Table
    tokens: int
    distinct: int
    more_states: Filter
    more_moves: Filter
    depth: int
    asked: float = 0.0

    def root(self, c: np.ndarray | float) -> np.ndarray:
        """log10 probability, at the root, of a token counted ``c`` times."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def score(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, list[tuple[np.ndarray, np.ndarray]]]]:
        """Of every token but the first: whether it is a hot symbol, its root log10 probability (0 if not), and what the hot runs make of it.

        Then the keys of runs that may be stored but aren't hot, with a token of the text that asks: by 1 for those asked for as a state, 2 as a transition, 3 as both, which happens where a
        run ends at a token and goes on to the next. From token to token the states of growing length are followed as far as there are any.
        """
        base = self.symbols.get(h[1:])
        symbol = ~np.isnan(base)
        base[~symbol] = 0
        made = base.copy()
        cold: dict[int, list] = {1: [], 2: [], 3: []}

        def look(keys: np.ndarray, at: np.ndarray, there: Table, more: Filter) -> tuple[np.ndarray, np.ndarray]:
            """Adds the weights of hot keys, and tells which keys are hot or may be stored; and those of the latter alone."""
            found = there.get(keys)
            hot = ~np.isnan(found)
            made[at[hot]] += found[hot]
            others = np.flatnonzero(~hot)
            others = others[more.has(keys[others])]
            hot[others] = True
            return hot, others

        key, t, moved = h, np.arange(1, len(h)), np.zeros(0, np.int64)  # ``moved``: where the transitions asked for end
        for n in range(1, self.depth + 2):  # runs of n tokens: as states before each t, and as transitions
            if n > 1:
                t = t[t >= n]
                t = t[h[t - n + 1] != END]
            if n > self.depth:
                t = t[:0]
            there, others = look(key[t - n], t - 1, self.states, self.more_states)
            ends = t[others] - 1
            if n == 1:
                cold[1].append((key[ends], ends))
            else:
                both = np.intersect1d(ends, moved, assume_unique=True)
                for kind, own in ((1, np.setdiff1d(ends, both, True)), (2, np.setdiff1d(moved, both, True)), (3, both)):
                    cold[kind].append((key[own - n + 1], own - 1 if kind > 1 else own))
            t = t[there]
            if not len(t):
                break
            key = run_key(key[:-1], key[1:])
            moved = t[look(key[t - n], t - 1, self.moves, self.more_moves)[1]]
        return symbol, base, made, cold


def grow(runs: DataFrame, sizes: DataFrame, below: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(key, c, after)`` of the states of a length, ``(key, c, own)`` of their transitions, and ``(key, v)`` of the transitions.

    ``runs(pre, suf, c)`` are the counts of runs of one token more, ``sizes(pre, size)`` those of the states-to-be, and ``below(key, v)`` the transitions of the
    states of one token less, ``v`` being their count and log10 probability. A stored transition has ``(count - DISCOUNT) / count of the context``; the rest of the mass goes to all other
    tokens in proportion to what the context without its first token gives them, so every state's probabilities add up to one. A context becomes a state if the
    context without its first token is one (the empty one always is) and its distribution improves the log likelihood of what followed it by ``DIVERGENCE`` nats
    over that shorter state. The log10 of it all is a sum of weights of the runs that end with a token or before it (see :class:`Tree`).
    """
    # what the shorter state gives the last token; runs that no shorter state reaches go
    found = runs.join(below.select(F.col("key").alias("suf"), F.col("v.logp").alias("given")), "suf").select("pre", "suf", "c", "given")
    passing = common.scratch_path(runs.sparkSession, f"runs{name}")
    found = common.stored(found.join(sizes, "pre"), passing)
    own = F.col("c") - DISCOUNT
    sums = found.groupBy("pre").agg(
        F.sum(own).alias("mass"), F.sum(F.pow(F.lit(10.0), "given")).alias("given"), F.sum("c").alias("n"), F.first("size").alias("size"),
        F.sum(F.col("c") * (F.ln(own) - F.col("given") * float(np.log(10)))).alias("gain"),
    )
    rest = F.greatest(1 - F.col("mass") / F.col("size"), F.lit(1e-12)) / F.greatest(1 - F.col("given"), F.lit(1e-12))
    gain = F.col("gain") - F.col("n") * F.ln("size") + (F.col("size") - F.col("n")) * F.ln(rest)
    states = common.stored(sums.select("pre", "size", F.log10(rest).cast("float").alias("after"), gain.alias("gain")).filter(F.col("gain") >= DIVERGENCE).drop("gain"), f"states{name}")
    logp = F.log10(own / F.col("size"))
    moves = found.join(states.select("pre", "after"), "pre")
    moves = moves.select(F.xxhash64("pre", "suf").alias("key"), F.struct("c", logp.alias("logp")).alias("v"), (logp - F.col("given") - F.col("after").cast("double")).cast("float").alias("own"))
    moves = common.stored(moves, f"moves{name}")
    common.removed(runs.sparkSession, passing)
    return (
        states.select(F.col("pre").alias("key"), F.col("size").alias("c"), "after"),
        moves.select("key", "v.c", "own"),
        moves.select("key", "v"),
    )


def learn(train: DataFrame, text_col: str = "text", depth: int = DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables of the tree of the training texts: ``(token, c)`` of all tokens, and the states and transitions (:func:`grow`).

    Texts are read three times if few of their runs are counted often: for tokens and pairs, for the runs of three tokens whose pairs are stored, and for all longer ones whose runs of three are. Where
    more could be sent at once than :data:`SHARE` allows, each length is counted by itself and in rounds, and a round's transitions are made before the next one is counted, so that disk stays in proportion to
    the texts however often their runs recur. Only runs that a state reaches are counted; no other can be in the tree. Counts that no later step reads are removed.
    """
    spark = train.sparkSession
    path = common.scratch_path(spark, "grams")
    size = train.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    slices = max(1, -(-size // SLICE))
    grams, paths = _counted(train, text_col, _short, path, slices), {2: [path]}
    tokens = grams.filter("length = 1").select(F.col("pre").alias("token"), "c")
    facts = tokens.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    root = F.log10((F.col("c") + 0.5) / F.lit((facts.n or 0) + 0.5 * (facts.v + 1)))
    often = F.col("c") >= C_MIN
    below = tokens.filter(often).select(F.col("token").alias("key"), F.struct("c", root.alias("logp")).alias("v"))
    key = F.xxhash64("pre", "suf")
    runs_of, found = {1: grams.filter("length = 1"), 2: grams.filter("length = 2")}, ([], [])
    for n in range(1, depth + 1):  # states of n tokens
        sizes = runs_of[n].filter(often).select((F.col("pre") if n == 1 else key).alias("pre"), F.col("c").alias("size"))
        made = []
        if n + 1 in runs_of:
            made.append(grow(runs_of[n + 1].select("pre", "suf", "c"), sizes, below, str(n)))
        else:
            may = runs_of[n].agg(F.sum("c")).first()[0] or 0  # so many places at most have a run of one token more
            share = 2 * SHARE / n
            lengths = range(n + 1, depth + 2 if n > 2 and rounds_for((depth + 1 - n) * may, facts.n or 0, share) == 1 else n + 2)
            rounds = rounds_for(len(lengths) * may, facts.n or 0, share)
            parts, reached = (spark.sparkContext.broadcast(_filter(t)) for t in (runs_of[n].select(key.alias("key")), states))
            runs = lambda h, a=(lengths, n, depth), b=parts, c=reached: _long(*a, b.value, c.value)(h)
            turns = []
            for turn in range(rounds):
                path = common.scratch_path(spark, f"grams{n + 1}")
                turns.append(_counted(train, text_col, runs, path, slices, turn, rounds))
                for length in lengths:
                    paths.setdefault(length, []).append(path)
                own = sizes if rounds == 1 else sizes.filter(_round_of(F.col("pre"), rounds) == turn)
                made.append(grow(turns[-1].filter(F.col("length") == n + 1).select("pre", "suf", "c"), own, below, str(n)))
                if n == depth and turn + 1 < rounds:
                    common.removed(spark, f"{path}/length={n + 1}")
                    paths[n + 1].pop()
            runs_of |= {length: reduce(DataFrame.unionByName, [t.filter(F.col("length") == length) for t in turns]) for length in lengths}
            for filters in (parts, reached):  # the counts are written
                filters.unpersist()
        states, moves, below = (reduce(DataFrame.unionByName, of) for of in zip(*made, strict=True))
        found[0].append(states)
        found[1].append(moves)
        for done in sorted({n, n + 1 if n == depth else n} & paths.keys()):  # tokens are kept
            for path in paths[done]:
                common.removed(spark, f"{path}/length={done}")
    return tokens, *(reduce(DataFrame.unionByName, parts) for parts in found)


def _most(table: DataFrame, rows: int, *names: str) -> tuple[list[np.ndarray], DataFrame, tuple[float, float]]:
    """The columns ``names`` of the most counted rows of a table, ``rows`` at most: from the count on that no more reach (to an eighth of a power of two). The rest as a table, and the sums of its counts and of all."""
    step = F.floor(F.log2("c") * 8)
    found = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("count"), F.sum("c").alias("c")).toPandas().sort_values("step", ascending=False)  # a few hundred rows
    fits = found.loc[found["count"].cumsum() <= rows, "step"]
    least = int(fits.min()) if len(fits) else 1 << 30
    # a column at a time, so that the driver holds the rows once
    made, columns = table.filter(step >= least).select(*names).toArrow(), []
    for name in names:
        columns.append(made.column(name).to_numpy())
        made = made.drop_columns([name])
    pa.default_memory_pool().release_unused()
    return columns, table.filter(step < least), (float(found.loc[found["step"] < least, "c"].sum()), float(found["c"].sum()))


def hot(tokens: DataFrame, states: DataFrame, moves: DataFrame, depth: int = DEPTH, hot_tokens: int = HOT_TOKENS, hot_runs: int = HOT_RUNS) -> tuple[Tree, DataFrame, DataFrame, DataFrame]:
    """What of the tables of :func:`learn` every task holds: the most counted rows of each, a fixed number at most. Then the other rows of the three tables."""
    facts = tokens.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()

    root = lambda c: np.log10((c + 0.5) / (int(facts.n or 0) + 0.5 * (int(facts.v) + 1)))

    def most(table: DataFrame, name: str, rows: int, value: str) -> tuple[Table, DataFrame, tuple[float, float]]:
        (keys, values), rest, times = _most(table.select(name, "c", *({value} - {"c"})), rows, name, value)
        values = root(values.astype(float)) if value == "c" else values.astype(np.float32, copy=False)
        return Table(keys.astype(np.int64, copy=False).view(np.uint64), values), rest, times

    symbols, more_tokens, _ = most(tokens, "token", hot_tokens, "c")
    (heads, more_heads, begun), (tails, more_tails, moved) = most(states, "key", hot_runs // 4, "after"), most(moves, "key", hot_runs, "own")
    n, filters = int(facts.n or 0), (_filter(more_heads), _filter(more_tails))
    # what is stored is found as often as it was counted; by chance pass the transitions that states lack, and states beyond the last one of a chain
    states_by_chance, moves_by_chance = (f.passes() for f in filters)
    beyond = min(depth, states_by_chance / max(1 - states_by_chance, 1e-9)) * (1 + moves_by_chance)
    asked = (begun[0] + moved[0] + moves_by_chance * max(begun[1] - moved[1], 0.0)) / max(n, 1) + beyond
    tree = Tree(symbols, heads, tails, n, int(facts.v), *filters, depth, min(asked, 2 * depth))
    return tree, more_tokens, more_heads, more_tails


def scores(
    docs: DataFrame, train_when: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, hot_tokens: int = HOT_TOKENS, hot_runs: int = HOT_RUNS
) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of all ``docs``, learnt from those where ``train_when`` holds.

    Tokens are the words of the text with A-Z lower-cased, and one end. ``base_score`` is the log10 probability under smoothed counts of single
    tokens, ``score`` that of the tree, whose states have 1 to ``depth`` tokens: each token is scored at the longest state that the tokens before it
    end with. All runs counted ``C_MIN`` times are tried, however large the corpus. Every task holds the most counted
    tokens and transitions, ``hot_tokens`` and ``hot_runs`` at most, and a quarter as many states; all others are looked up by joins, so neither changes a score. Weights are kept in single precision.

    Null text counts as empty: its only token is the end. Rows of equal id are scored each by itself. Rows whose
    condition is null are held out. Without training rows the model is uniform over the one unknown token. Tokens and runs are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(train_when, F.lit(False)).alias("_train"))
    tokens, heads, tails = learn(docs.filter("_train"), "_text", depth)
    tree, tokens, heads, tails = hot(tokens, heads, tails, depth, hot_tokens, hot_runs)  # the tables without what is hot
    spark, shared = docs.sparkSession, docs.sparkSession.sparkContext.broadcast(tree)
    lists = T.ArrayType(T.LongType())
    schema = T.StructType([docs.schema["_id"], docs.schema["_train"]]).add("n", "long").add("known", "long").add("base", "double").add("made", "double").add("rare", lists).add("states", lists).add("runs", lists).add("both", lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, h, lengths in _streams(batches, 1):
            tree = shared.value
            symbol, base, made, cold = tree.score(h)
            start = np.cumsum(lengths) - lengths

            def by_text(keys: np.ndarray, at: np.ndarray) -> pa.ListArray:
                order = np.argsort(at, kind="stable")
                ends = np.append(np.searchsorted(at[order], start), len(at))
                return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[order].view(np.int64)))

            none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            joined = [by_text(*map(np.concatenate, zip(*(cold[kind] or [none]), strict=True))) for kind in (1, 2, 3)]
            rare = np.flatnonzero(~symbol)
            part = batch.slice(first, len(lengths))
            known = np.add.reduceat(symbol.astype(np.int64), start)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(lengths, pa.int64()), pa.array(known), pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(made, start)), by_text(h[1:][rare], rare), *joined],
                names=["_id", "_train", "n", "known", "base", "made", "rare", "states", "runs", "both"],
            )

    none = float(tree.root(0))
    root = F.log10((F.col("c") + 0.5) / F.lit(tree.tokens + 0.5 * (tree.distinct + 1)))
    more = heads.select("key", F.lit(1).alias("kind"), F.col("after").alias("more")).unionByName(tails.select("key", F.lit(2).alias("kind"), F.col("own").alias("more")))

    def scored(texts: DataFrame) -> DataFrame:
        """The scores of some of the texts, stored; what they look up is removed."""
        path = common.scratch_path(spark, "scored")
        with _few_rows(spark):  # the rows' numbers are fixed once they are written
            rows = common.stored(texts.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), path)
        seen = rows.select("_row", F.explode("rare").alias("token")).join(tokens, "token").select("_row", F.lit(1).alias("seen"), (root - none).alias("root"), F.lit(0.0).alias("more"))
        # a row's number and what its key is asked for as, in one
        asked = reduce(DataFrame.unionByName, [rows.select((F.col("_row") * 4 + kind).alias("_for"), F.explode(name).alias("key")) for kind, name in ((1, "states"), (2, "runs"), (3, "both"))])
        found = asked.join(more, "key").filter(F.col("_for").bitwiseAND(F.col("kind")) != 0).select(F.expr("shiftright(_for, 2)").alias("_row"), F.lit(0).alias("seen"), F.lit(0.0).alias("root"), F.col("more").cast("double").alias("more"))
        rest = seen.unionByName(found).groupBy("_row").agg(F.sum("seen").alias("seen"), F.sum("root").alias("root"), F.sum("more").alias("more"))
        out = rows.withColumn("unseen", F.size("rare") * F.lit(none)).drop("rare", "states", "runs", "both").join(rest, "_row", "left")
        base = F.col("unseen") + F.coalesce("root", F.lit(0.0))
        out = out.select(
            F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
            F.lit(tree.tokens).cast("long").alias("train_tokens"), (F.col("base") + base).alias("base_score"), (F.col("made") + base + F.coalesce("more", F.lit(0.0))).alias("score"),
        )
        out = common.stored(out, "scores")
        common.removed(spark, path)
        return out

    rounds = rounds_for(tree.asked * tree.tokens, tree.tokens, LOOKUPS)
    texts = docs.select("_id", "_text", "_train")
    made = [scored(texts if rounds == 1 else texts.filter(_round_of(F.xxhash64("_id", "_text"), rounds) == turn)) for turn in range(rounds)]
    shared.unpersist()
    return reduce(DataFrame.unionByName, made)


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose id's CRC-32 has another remainder by 5 than 1."""
    docs = common.read(spark, sf_dir, "documents")
    return scores(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)


QUERIES = {"op1_suffix_tree": op1_suffix_tree}
SQL: dict[str, str] = {}
