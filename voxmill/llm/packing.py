"""Packing documents into windows of tokens: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import common

WINDOW, END = 4096, 2
#: Pieces that one task packs by itself, and words whose ids a Python worker keeps between batches.
PIECES_PER_SHARD, CACHED_WORDS = 50_000, 300_000
#: Bytes of text that a task looks up at once.
BLOCK = 8 << 20


#: Texts that tell whether a tokenizer encodes words apart from one another, in either case, and marks behind a letter apart from words.
PROBES = ("The cat, the CAT and the hat.", "two  spaces\tand\nlines \r\n end", "A.B,C. x, 3.14, U.S.A.", "\u00c9t\u00e9 stra\u00dfe, \u4f60\u597d. na\u00efve", "<|end|> Mixed <b> it's 'quoted' \u2014 dash", " lead and trail ", "wow!!! what?! this; that: a*** b.$& c,,")
#: Marks that are cut off the ends of words, and words that the tokenizer gets at once.
MARKS, TOGETHER = b",.;:!?$&*", 256


class Encoder:
    """Token ids of whole texts, word by word: equal to encoding the text at once, as no token of the tokenizer spans white space.

    The normaliser lower-cases, so words that differ in ASCII case share their ids, except where the text of a special token
    may be meant. Marks behind a letter are tokens of their own. A tokenizer for which that doesn't hold is refused.

    Arrow splits a block of texts and numbers its distinct words; Python sees each of these once, and Arrow puts their ids in the order of the texts.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; Spark's tasks fill the others
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(tokenizer)
        self.encode_batch = whole.encode_batch_fast
        self.kept: dict[bytes, bytes] = {}
        suffix, vocabulary = getattr(whole.model, "end_of_word_suffix", None), whole.get_vocab()
        #: whether a token ends a word; None if tokens don't tell
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        for text, ids in zip(PROBES, self.ids([t.encode() for t in PROBES]), strict=True):
            if np.frombuffer(ids, "<u4").tolist() != whole.encode(text, add_special_tokens=False).ids:
                raise ValueError(f"{tokenizer} can't be used word by word: it encodes {text!r} otherwise")
        self.kept.clear()

    def _alone(self, words: list[str]) -> Iterator[bytes]:
        for e in self.encode_batch(words, add_special_tokens=False):
            yield np.array(e.ids, "<u4").tobytes()

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word. Words of letters alone are encoded many at a time and cut where tokens end words; if there are more or fewer ends than words, each by itself."""
        found, lone, letters = {}, [], []
        for w in words:
            (letters if self.ends is not None and w.decode().isalpha() else lone).append(w)
        groups = [letters[i : i + TOGETHER] for i in range(0, len(letters), TOGETHER)]
        for group, e in zip(groups, self.encode_batch([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(group) and ends[-1] == 4 * len(ids):
                raw = ids.tobytes()
                found |= {w: raw[a:b] for w, a, b in zip(group, [0, *ends], ends, strict=False)}
            else:
                lone += group
        found |= zip(lone, self._alone([w.decode() for w in lone]), strict=True)
        return found

    def ids(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each of the texts, without an end."""
        split = pc.ascii_split_whitespace(pa.array([t if b"<|" in t else t.lower() for t in texts], pa.large_string()))
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        kept, found, stems = self.kept, {b"": b""}, {}
        for w in distinct:
            if (known := kept.get(w)) is not None:
                found[w] = known
            elif w:
                s = w.rstrip(MARKS)
                stems[w] = s if s[-1:].isalpha() else w
        parts = {*stems.values(), *(w[len(s) :] for w, s in stems.items())}
        fresh = self._fresh([p for p in parts if p not in found and p not in kept])
        part = lambda p: ids if (ids := fresh.get(p)) is not None else ids if (ids := found.get(p)) is not None else kept[p]
        for w, s in stems.items():
            found[w] = part(s) + part(w[len(s) :]) if len(w) > len(s) else part(s)
        if (room := CACHED_WORDS - len(kept)) > 0:
            kept.update([(w, found[w]) for w in stems][:room])
        joined = pa.array([found[w] for w in distinct], pa.large_binary()).take(words.indices)
        at = np.frombuffer(joined.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist() if len(joined) else [0] * (len(texts) + 1)
        data = memoryview(joined.buffers()[2] or b"")
        for a, b in zip(at, at[1:], strict=False):
            yield bytes(data[a:b])


_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder for a tokenizer file; read once, as its cache of words is worth keeping."""
    if tokenizer not in _ENCODERS:
        _ENCODERS[tokenizer] = Encoder(tokenizer)
    return _ENCODERS[tokenizer]


def blocks(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """The texts in order, in lists of about ``BLOCK`` bytes."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, keep_ids: bool = False) -> DataFrame:
    """``(id, start, length, ids_crc32, doc_tokens)`` of every document, and its ``ids`` if asked for.

    A document is the ids of its whole text and an end. Overlong ones are cut into full windows and a rest; null and empty texts
    are the end alone. Rows of equal id are documents of their own.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            texts, at = batch.column(1).cast(pa.large_binary()), 0
            for block in blocks(t.as_py() or b"" for t in texts):
                rows: list[tuple] = []
                for n, ids in enumerate(encode.ids(block)):
                    ids += last
                    for i in range(0, len(ids), 4 * window):
                        part = ids[i : i + 4 * window]
                        rows.append((at + n, i // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, *([np.frombuffer(part, "<u4").tolist()] if keep_ids else [])))
                at += len(block)
                take, *cols = zip(*rows, strict=True)
                arrays = [batch.column(0).take(pa.array(take, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:4]]]
                names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(cols[4], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(id_col, text_col).mapInArrow(run, schema + (", ids array<int>" if keep_ids else ""))


def best_fit(lengths: Iterable[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of pieces given in decreasing length: each goes to the tightest open window that holds it.

    Leaves of the segment tree are the remaining capacities 0 to ``window``, a node counts the open windows below it.
    """
    size = 1 << window.bit_length()
    tree, open_at = [0] * (2 * size), [[] for _ in range(window + 1)]
    out, used = [], 0

    def change(capacity: int, by: int) -> None:
        node = capacity + size
        while node:
            tree[node] += by
            node >>= 1

    for length in lengths:
        node = length + size
        while not tree[node]:  # up, until a subtree to the right (or this leaf) has an open window
            while node & 1 and node > 1:
                node >>= 1
            if node <= 1:
                break
            node += 1
        if node <= 1:
            capacity, chosen = window, used
            used += 1
        else:
            while node < size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
            capacity = node - size
            chosen = open_at[capacity].pop()
            change(capacity, -1)
        out.append((chosen, window - capacity))
        if capacity > length:
            open_at[capacity - length].append(chosen)
            change(capacity - length, 1)
    return out


def assign(cut: DataFrame, id_col: str = "doc_id", window: int = WINDOW, per_shard: int = PIECES_PER_SHARD) -> DataFrame:
    """``cut`` (see :func:`pieces`) with ``sequence_id`` and ``offset``.

    Pieces are dealt to shards of about ``per_shard`` by a hash of their rows' numbers, so that rows of one id, or repeated ones, don't fall to one shard. Each shard is packed
    by best-fit decreasing, ties by id and start. Only a shard's last windows can stay half empty, so shards of any fixed size waste the same small share. ``cut`` must
    be a checkpoint or a written table, which has the same row numbers whenever it is read.
    """
    shards = max(1, -(-cut.count() // per_shard))
    schema = cut.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "start"], ascending=[False, True, True], kind="stable")
        placed = np.array(best_fit(rows["length"].tolist(), window), np.int64).reshape(-1, 2)
        return rows.drop(columns="_shard").assign(sequence_id=placed[:, 0] + (int(key[0]) << 32), offset=placed[:, 1])

    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Where every piece of every document goes: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``.

    Join on (id, start) with :func:`pieces` that keeps ids to write the windows. An empty table gives an empty result.
    """
    return assign(common.cut(pieces(docs, tokenizer, id_col, text_col, window)), id_col, window)


def public_tokenizer() -> str:
    """The tokenizer file of the queries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 tokens."""
    return pack(common.read(spark, sf_dir, "documents"), public_tokenizer())


QUERIES = {"op8_packing": op8_packing}
SQL: dict[str, str] = {}
