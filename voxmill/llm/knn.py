"""Exact top-k search by inner product: a Voronoi kNN join with per-group distance bounds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxmill.llm import common

#: Pivots at most, and rows of data and of queries that one task compares.
MAX_PIVOTS, DATA_ROWS, QUERY_ROWS = 64, 20_000, 2_000


def usable(vector: Column) -> Column:
    """Whether a vector is there and has finite components only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def packed(v: np.ndarray) -> bytes:
    """A vector of integers held as doubles: 16-bit integers where they suffice, else the doubles; the first byte tells which."""
    small = v.astype("<i2") if not len(v) or np.abs(v).max() < 2**15 else None
    return b"s" + small.tobytes() if small is not None else b"d" + v.astype("<f8").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    """The vector of :func:`packed`."""
    return np.frombuffer(b, "<i2" if b[:1] == b"s" else "<f8", offset=1)


def prepared(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(id, v, width, norm2)`` of usable vectors of rows with an id, so that ids stay integers in every batch; each component ``floor(scale * x)`` in double precision; ``v`` is :func:`packed`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors = [np.floor(scale * np.asarray(v, np.float64)) for v in b["v"]]
            yield pd.DataFrame({"id": b["id"], "v": [packed(v) for v in vectors], "width": np.array([len(v) for v in vectors], np.int32), "norm2": np.array([float(v @ v) for v in vectors])})

    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.mapInPandas(run, "id long, v binary, width int, norm2 double")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Rows of vectors; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width))
    for k, v in enumerate(vectors):
        x = unpacked(v)
        out[k, : len(x)] = x
    return out


@dataclass(frozen=True)
class Space:
    """Inner products as distances: data ``x`` lies at ``(x, sqrt(m2 - |x|^2))`` and a query at ``(q, 0)``, so the squared distance is ``|q|^2 + m2 - 2 q.x``."""

    width: int
    m2: float

    def data(self, vectors: pd.Series) -> np.ndarray:
        x = _matrix(vectors, self.width)
        return np.hstack([x, np.sqrt(np.maximum(self.m2 - (x * x).sum(1), 0))[:, None]])

    def queries(self, vectors: pd.Series) -> np.ndarray:
        return np.hstack([_matrix(vectors, self.width), np.zeros((len(vectors), 1))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` to those of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; floating point holds them exactly unless vectors are very long."""
    return (q @ x.T).astype(np.int64) if exact else (q.astype(object) @ x.T.astype(object)).astype(np.int64)


def knn_join(queries: DataFrame, data: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, max_pivots: int = MAX_PIVOTS, data_rows: int = DATA_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of ``data`` with the highest inner product for each of ``queries``.

    Queries and data go to the nearest of at most ``max_pivots`` pivots. Each data group is summarised by its radius, its rows and its
    members nearest to the pivot. Those members bound how far a query's k-th neighbour can be; with the triangle inequality, a query group's
    largest bound tells which data it can need. Only that is sent to it, in units of about ``query_rows`` by ``data_rows``; units are
    solved locally and their best merged. Pivots and summaries are of fixed size and reach every task; nothing else does.

    Ties go to the smaller id. Rows of the query's own id are no candidates. Query rows of one id are queries of their own, each with a list of its own; data rows of
    one id are candidates of their own. Ids are integers of 64 bits; rows with a null id take no part, neither as queries nor as candidates. Null vectors and those with null or non-finite components
    take no part; shorter vectors count as ending in zeros; empty ones score 0. With fewer than ``k`` candidates all are returned; without any,
    none. Scores must fit in 64 bits.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    data, queries = prepared(data, id_col, vector_col, scale), prepared(queries, id_col, vector_col, scale)
    facts, asked = (t.agg(F.max("width").alias("width"), F.max("norm2").alias("m2"), F.count(F.lit(1)).alias("n")).first() for t in (data, queries))
    if not facts.n or not asked.n:
        return data.sparkSession.createDataFrame([], schema)
    space = Space(max(facts.width, asked.width), facts.m2)
    exact = max(facts.m2, asked.m2) < 2**52
    count = min(max_pivots, max(1, round(asked.n**0.5)))
    picked = data.orderBy(F.xxhash64("id"), "id").limit(4 * count).toPandas()
    pivots = spread(np.unique(space.data(picked["v"]), axis=0), count)
    eps = 1e-6 * (1 + facts.m2**0.5 + asked.m2**0.5)

    def place(batches: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = distances(of(b["v"]), pivots)
            near = d.argmin(1) if len(d) else np.zeros(0, int)
            yield b.assign(g=near, d=d[np.arange(len(d)), near])

    placed = data.select("id", "v").mapInPandas(lambda bs: place(bs, space.data), "id long, v binary, g int, d double")
    # the summaries: k + 1 members nearest to each pivot (one may be the query itself), and each group's rows and radius
    nearest = placed.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("d", "id"))).filter(F.col("r") <= k + 1)
    members = nearest.select("id", "v").toPandas()
    groups = placed.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("high")).toPandas().set_index("g").reindex(range(len(pivots)))
    rows = groups["n"].fillna(0).to_numpy()
    near_points, near_ids = space.data(members["v"]), members["id"].to_numpy()

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in place(batches, space.queries):
            d = distances(space.queries(b["v"]), near_points)
            d[b["id"].to_numpy()[:, None] == near_ids[None]] = np.inf
            d = np.sort(d, axis=1)
            theta = d[:, k - 1] if d.shape[1] >= k else np.full(len(d), np.inf)
            yield b.assign(theta=theta)

    bounded = queries.select("id", "v", F.monotonically_increasing_id().alias("q")).mapInPandas(bound, "id long, v binary, q long, g int, d double, theta double")
    limits = bounded.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("radius"), F.max("theta").alias("theta")).toPandas().set_index("g")
    active = limits.index.to_numpy()
    theta, radius = limits["theta"].to_numpy() + eps, limits["radius"].to_numpy()
    between = distances(pivots[active], pivots)
    # data x of group j can matter to query group i only if  low[i, j] <= |x p_j| <= high[i, j]
    low, high = between - radius[:, None] - theta[:, None], between + radius[:, None] + theta[:, None]
    wanted = (low <= groups["high"].fillna(-1).to_numpy()[None]) @ rows
    salts = np.maximum(1, np.ceil(wanted / data_rows)).astype(int)
    chunks = np.maximum(1, np.ceil(limits["n"].to_numpy() / query_rows)).astype(int)
    at = {int(g): i for i, g in enumerate(active)}

    def units(i: np.ndarray, chunk: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return (i * 1_000_000 + chunk) * 1_000_000 + salt

    def send_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches):
            i = b["g"].map(at).to_numpy(np.int64)
            times = salts[i]
            row = np.repeat(np.arange(len(b)), times)
            salt = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            yield b.iloc[row][["id", "v", "q"]].assign(unit=units(i[row], _mix(b["id"].to_numpy()[row]) % chunks[i[row]], salt))

    def send_data(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _parts(batches):
            g, d = b["g"].to_numpy(), b["d"].to_numpy()[None]
            i, row = np.nonzero((low[:, g] <= d) & (d <= high[:, g]))
            times = chunks[i]
            chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            i, row = np.repeat(i, times), np.repeat(row, times)
            yield b.iloc[row][["id", "v"]].assign(unit=units(i, chunk, _mix(b["id"].to_numpy()[row]) % salts[i]))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if q.empty or x.empty:
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []}, dtype=np.int64)
        x = x.sort_values("id", kind="stable")
        ids, points, out = x["id"].to_numpy(), _matrix(x["v"], space.width), []
        for at in range(0, len(q), 256):
            part = q.iloc[at : at + 256]
            scores = products(_matrix(part["v"], space.width), points, exact)
            for own, number, s in zip(part["id"].to_numpy(), part["q"].to_numpy(), scores, strict=True):
                other = np.flatnonzero(ids != own)
                best = other[np.argsort(-s[other], kind="stable")[:k]]
                out.append(pd.DataFrame({"query_id": own, "q": number, "vec_id": ids[best], "score": s[best]}))
        return pd.concat(out)

    left = bounded.select("id", "v", "q", "g").mapInPandas(send_queries, "id long, v binary, q long, unit long")
    right = placed.mapInPandas(send_data, "id long, v binary, unit long")
    solved = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInPandas(solve, "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return solved.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _parts(batches: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The batches in small parts: each row may be sent to as many places as there are units."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.iloc[at : at + rows]


def _mix(ids: np.ndarray) -> np.ndarray:
    """Ids scattered over the integers from 0."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(33)).astype(np.int64)


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the points, each the farthest from those before it."""
    chosen = [0]
    away = distances(points, points[:1])[:, 0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(away.argmax()))
        away = np.minimum(away, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every vector whose id is divisible by 50."""
    rows = common.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return knn_join(rows.filter(F.col("vec_id") % 50 == 0), rows)


QUERIES = {"op2_topk": op2_topk}
SQL = {
    "op2_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
