"""Vector codes: product quantisation by Lloyd rounds that keep Elkan's bounds between them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import common
from voxmill.llm.knn import usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096.0
#: Components after scaling must be smaller, so that squared distances are exact in 64 bits.
LARGEST = 2**26
#: Relative and absolute room that bounds keep for rounding, which is far smaller.
_ROOM = 1e-6

_STATE = "id long, label string, kind string, x binary, code binary, upper binary, lower binary, sums binary"


class Codebooks:
    """``entries[part, entry]``: integer vectors; and what of them the bounds need: distances among the entries of a part, and how far each has moved."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray | None = None):
        self.entries = entries
        self.moved = np.zeros(entries.shape[:2]) if moved is None else moved
        gap = entries[:, :, None] - entries[:, None]
        self.half = np.sqrt((gap * gap).sum(3).astype(float)) / 2 * (1 - _ROOM)

    def replaced(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Entries at the floors of their parts' means; unused ones stay."""
        new = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], self.entries)
        step = new - self.entries
        return Codebooks(new, np.sqrt((step * step).sum(2).astype(float)) * (1 + _ROOM))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    return ((x - y) ** 2).sum(-1)


def first_codes(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of each part of ``x[row, part]``, the upper bound on its distance, and a lower bound for every entry."""
    d = np.stack([squared(x, books.entries[None, :, j]) for j in range(books.entries.shape[1])], 2)
    code = d.argmin(2)
    far = np.sqrt(d.astype(float))
    return code, np.take_along_axis(far, code[..., None], 2)[..., 0] * (1 + _ROOM) + _ROOM, np.maximum(far * (1 - _ROOM) - _ROOM, 0)


def next_codes(x: np.ndarray, books: Codebooks, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes and bounds after the entries moved, and how many distances were computed.

    Bounds are shifted by the entries' movement. An entry can't win, not even by a tie, where the upper bound of the part's own entry is strictly below the other's lower bound
    or below half of the distance between the two; for the rest the upper bound is made exact, and what is left is decided by integer distances, ties to the lower index.
    """
    part = np.arange(x.shape[1])[None]
    upper = upper + books.moved[part, code]
    lower = np.maximum(lower - books.moved[None], 0)
    half = books.half[part, code]
    own = np.arange(lower.shape[2]) == code[..., None]
    rivals = ~own & (upper[..., None] >= lower) & (upper[..., None] >= half)
    rows, parts = np.nonzero(rivals.any(2))
    near = squared(x[rows, parts], books.entries[parts, code[rows, parts]])
    far = np.sqrt(near.astype(float))
    upper[rows, parts] = far * (1 + _ROOM) + _ROOM
    lower[rows, parts, code[rows, parts]] = np.maximum(far * (1 - _ROOM) - _ROOM, 0)
    exact = upper[rows, parts][:, None]
    which, entry = np.nonzero(rivals[rows, parts] & (exact >= lower[rows, parts]) & (exact >= half[rows, parts]))
    d = squared(x[rows[which], parts[which]], books.entries[parts[which], entry])
    far = np.sqrt(d.astype(float))
    lower[rows[which], parts[which], entry] = np.maximum(far * (1 - _ROOM) - _ROOM, 0)
    # the best of each part: its own entry, or a rival of smaller distance, or of the same and a lower index
    order = np.lexsort((entry, d, which))
    lead = order[np.append(True, which[order][1:] != which[order][:-1])] if len(which) else order
    w, e, best = which[lead], entry[lead], d[lead]
    better = (best < near[w]) | (best == near[w]) & (e < code[rows[w], parts[w]])
    w, e, best = w[better], e[better], np.sqrt(best[better].astype(float))
    code = code.copy()
    code[rows[w], parts[w]] = e
    upper[rows[w], parts[w]] = best * (1 + _ROOM) + _ROOM
    return code, upper, lower, len(rows) + len(which)


def _binary(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in a], pa.binary())


def _rows(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _up(a: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are no smaller."""
    return np.nextafter(a.astype("<f4"), np.float32(np.inf))


def _down(a: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(a.astype("<f4"), np.float32(-np.inf)), np.float32(0))


def integers(table: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """``(id, label, x)`` of the usable vectors: ``x`` holds ``floor(scale * component)`` as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.floor(scale * np.asarray(v, np.float64)) for v in b.column(2).to_pylist()]
            if any(len(v) and np.abs(v).max() >= LARGEST for v in found):
                raise ValueError(f"components must be smaller than {LARGEST / scale:g}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.astype("<i4").tobytes() for v in found], pa.binary())], names=["id", "label", "x"])

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    return rows.mapInArrow(run, "id long, label string, x binary")


def _sums(x: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """``[part, entry]``: the sums of the parts at each entry, and their number in the last place."""
    out = np.zeros((x.shape[1], entries, x.shape[2] + 1), np.int64)
    for part in range(x.shape[1]):
        np.add.at(out[part, :, :-1], code[:, part], x[:, part])
        out[part, :, -1] = np.bincount(code[:, part], minlength=entries)
    return out


def _assigned(table: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    """Rows of ``_STATE``: every vector with its codes and bounds, and for each task a row of kind ``sums``."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        names = [f.split()[0] for f in _STATE.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                b = whole.slice(at, 2_000)
                x = _rows(b.column("x"), "<i4", parts, width).astype(np.int64)
                if fresh:
                    code, upper, lower = first_codes(x, books)
                else:
                    code, upper, lower = _rows(b.column("code"), np.uint8, parts).astype(np.int64), _rows(b.column("upper"), "<f4", parts).astype(float), _rows(b.column("lower"), "<f4", parts, entries).astype(float)
                    code, upper, lower, _ = next_codes(x, books, code, upper, lower)
                total += _sums(x, code, entries)
                n = b.num_rows
                cols = [b.column("id"), b.column("label"), pa.array(["row"] * n), b.column("x"), _binary(code.astype(np.uint8)), _binary(_up(upper)), _binary(_down(lower)), pa.nulls(n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
        kinds = (pa.int64(), pa.string(), None, *[pa.binary()] * 4)
        cols = [pa.nulls(1, k) if k else pa.array(["sums"]) for k in kinds] + [pa.array([total.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=names)

    return table.mapInArrow(run, _STATE)


def _added(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The tasks' sums added up: slices of a part and entry meet by key, so that what reaches the driver is one codebook."""
    parts, entries, width = shape

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            for s in b.column(0).to_pylist():
                total += np.frombuffer(s, "<i8").reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    rows = state.filter("kind = 'sums'").select("sums").mapInArrow(cut, "at long, v long").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(parts * entries * (width + 1), np.int64)
    for r in rows:
        out[r.at] = r.v
    return out.reshape(parts, entries, width + 1)


def compressed(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE
) -> tuple[DataFrame, np.ndarray | None]:
    """``(id, label, codes, error)`` of the usable vectors (``codes`` has a byte a part, ``error`` is the squared distance to the coded vector), and the final codebooks.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal parts, each with a codebook that starts at the parts of the ``entries`` smallest ids. Each round
    assigns every part to the nearest entry, ties to the lower index, and moves each entry to the floor of its parts' mean. The rows, their codes
    and bounds are written as a table in the shared folder by each round and read by the next; a lost task begins again from there. The codebooks (``parts * entries`` short vectors)
    and their sums are all that reaches the driver.

    Vectors that are null or hold null or non-finite components are left out. Shorter ones count as ending in zeros, and so does a width that ``parts`` doesn't divide.
    Rows of equal ids are rows of their own; for the first codebooks null ids come last and equal ids are taken in order of their vectors.
    With fewer vectors than ``entries`` the codebooks are shorter; without any, the result is empty and there is none. ``label`` is returned as text.
    """
    rows = common.stored(integers(table, id_col, vector_col, label_col, scale), "vectors")
    longest = rows.agg(F.max(F.length("x"))).first()[0]
    if longest is None:
        return rows.select("id", "label", F.col("x").alias("codes"), F.lit(0).cast("long").alias("error")), None
    width = max(1, -(-longest // 4 // parts))
    size = 4 * parts * width
    rows = rows.withColumn("x", F.rpad("x", size, F.lit(b"\0")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), F.hex("x")).limit(entries).select("x").toPandas()["x"]
    books = Codebooks(np.stack([np.frombuffer(x, "<i4").reshape(parts, width) for x in first], 1).astype(np.int64))
    state = rows
    for k in range(rounds):
        state = common.stored(_assigned(state, books, k == 0), f"codes{k}", "kind")
        added = _added(state, (parts, books.entries.shape[1], width))
        books = books.replaced(added[..., :-1], added[..., -1])
        state = state.filter("kind = 'row'")
    final = _assigned(state, books, rounds == 0).filter("kind = 'row'").select("id", "label", "x", "code")

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, code = _rows(b.column(2), "<i4", parts, width).astype(np.int64), _rows(b.column(3), np.uint8, parts)
            d = squared(x, books.entries[np.arange(parts)[None], code]).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(d)], names=["id", "label", "codes", "error"])

    return final.mapInArrow(errors, "id long, label string, codes binary, error long"), books.entries


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of eight parts with 16 entries each for every vector, and their errors."""
    codes, entries = compressed(common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    codes = common.stored(codes, "coded").withColumn("_no_label", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit("")))
    by_label = common.cut(codes.groupBy("label", "_no_label").agg(F.sum("error").alias("label_error")))
    out = common.lookup(codes, by_label, ["label", "_no_label"], "inner")
    digest = Codebooks(entries).digest() if entries is not None else ""
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    assign = """
a{k} AS (
  SELECT rid, part, min(struct_pack(d := d, e := entry)) AS best
  FROM (SELECT p.rid, p.part, c.entry, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c USING (part))
  GROUP BY rid, part)"""
    move = """
s{n} AS (SELECT p.part, a.best.e AS entry, i, sum(p.x[i])::BIGINT AS s, count(*) AS n FROM a{k} a JOIN p USING (rid, part), range(1, 9) r(i) GROUP BY ALL),
m{n} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{n} GROUP BY part, entry),
c{n} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{n} m USING (part, entry))"""
    steps = [assign.format(k=0)]
    for k in range(ROUNDS):
        steps += [move.format(k=k, n=k + 1), assign.format(k=k + 1)]
    return (
        """
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096.0::DOUBLE * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, part, x[part * 8 + 1 : part * 8 + 8] AS x FROM v, range(0, 8) r(part)),
c0 AS (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 16),"""
        + ",".join(steps)
        + f""",
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS}),
o AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o JOIN v USING (rid), h
"""
    )


QUERIES = {"op12_vector_codes": op12_vector_codes}
SQL = {"op12_vector_codes": _sql()}
