"""Exact top-k search by inner product as a Voronoi kNN join.

Pivots split all vectors into cells, and distances from the pivot (doubling) split a cell into rings. A first
local pass compares every query with one block of its own cell and ring: the k-th best score found there is
the score that its answers surely reach. A group of queries is a cell and ring with its summary: the pivot p,
the greatest distance r from it, the greatest norm and the least of the sure scores (where the local pass met
too few vectors, bounds from the summaries of the data cells stand in). A vector x has an inner product of at
most p.x + r |x|, and of at most norm times |x|, with any query of the group, and is sent to the group only
if that reaches the group's sure score. Groups are joined up to `QUERY_BLOCK` queries, so that a vector goes
once to each joined group that needs it. There, blocks of bounded size are solved locally by matrix products,
and the blocks' results (k for each query) are merged by one window over the queries.

How much is sent depends on the vectors: queries with near neighbours need little more than their ring, while
in vectors without any structure (random directions of many dimensions) no exact bound spares anything and
every joined group needs them all.

Defined results: vectors that are null, hold null or non-finite components, or differ in length from most
pivots take no part; ties go to the smaller vec_id; each row whose vec_id is not the query's is a candidate;
rows that repeat the vec_id of a query are one query, by the least of their vectors; fewer than k candidates
give fewer rows; rows without vec_id take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, table

K = 5
MOST_PIVOTS = 256
QUERY_BLOCK = 2048
DATA_BLOCK = 4096
#: Rings of a cell: by the binary length of the distance; all beyond the last are one.
MOST_RINGS = 40
_ROUNDING = 1e-6


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(256 * x.cast("double")))


def whole(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(vector) > 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def assign(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vectors(vec_id, v, is_query) of the pivots' length with the nearest pivot's number, the distance from
    it, its ring and the norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(1) / 2
        for b in batches:
            x = _matrix(b["v"])
            if not len(x):
                continue
            cell = np.argmin(half - x @ pivots.T, 1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            ring = np.minimum(np.frexp(far)[1].clip(0), MOST_RINGS)
            new = pa.array(cell, pa.int32()), pa.array(ring, pa.int32()), pa.array(far), pa.array(np.sqrt((x**2).sum(1)))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "cell", "ring", "far", "norm"])

    same = vectors.filter(F.size("v") == pivots.shape[1])
    return same.mapInArrow(run, "vec_id bigint, v array<bigint>, is_query boolean, cell int, ring int, far double, norm double")


def scores_of(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products of two matrices of integers."""
    exact = np.abs(q).max(initial=0) * np.abs(d).max(initial=0) * q.shape[1] < 2**53
    return (q @ d.T if exact else q.astype(np.int64) @ d.astype(np.int64).T).astype(np.int64)


def best(scores: np.ndarray, qi: np.ndarray, di: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of the k best of each query, ties to smaller ids, its own id left out."""
    other = qi[:, None] != di[None, :]
    masked = np.where(other, scores, np.iinfo(np.int64).min)
    least = np.partition(masked, -k, axis=1)[:, -k] if masked.shape[1] > k else np.full(len(qi), np.iinfo(np.int64).min)
    row, col = np.nonzero(other & (scores >= least[:, None]))
    order = np.lexsort((di[col], ~scores[row, col], row))  # ~x falls as x rises and never overflows
    row, col = row[order], col[order]
    turn = np.arange(len(row)) - np.searchsorted(row, row)
    return row[turn < k], col[turn < k]


def _local(k: int):
    def run(block: pa.Table) -> pa.Table:
        is_query = block["is_query"].to_numpy()
        if not is_query.any():
            return pa.table({"vec_id": pa.array([], pa.int64()), "sure": pa.array([], pa.float64())})
        x, ids = _matrix(block["v"]), block["vec_id"].to_numpy()
        qi, di = ids[is_query], ids[~is_query]
        row, col = best(scores := scores_of(x[is_query], x[~is_query]), qi, di, k) if len(di) else (np.zeros(0, int),) * 2
        sure = np.full(len(qi), -np.inf)
        enough = np.bincount(row, minlength=len(qi)) >= k
        if len(row):
            np.copyto(sure, [scores[row[row == i], col[row == i]].min() if e else -np.inf for i, e in enumerate(enough)])
        return pa.table({"vec_id": pa.array(qi, pa.int64()), "sure": pa.array(sure, pa.float64())})

    return run


def sure_by_summaries(p: np.ndarray, r: float, pivots: np.ndarray, data: dict[int, tuple[int, float]], k: int, own: int) -> float:
    """A score that k candidates surely reach for every query within r of p. data: cell to (rows, radius);
    own: the most rows that one query's id may have."""
    cells = sorted(data)
    n, s = np.array([data[c][0] for c in cells]), np.array([data[c][1] for c in cells])
    o = pivots[cells]
    mid = o @ p
    low = mid - (r * np.sqrt((o**2).sum(1)) + s * np.sqrt((p**2).sum()) + r * s + _ROUNDING * (1 + np.abs(mid)))
    order = np.argsort(-low, kind="stable")
    enough = np.searchsorted(np.cumsum(n[order]), k + own)
    return float(low[order[enough]]) if enough < len(order) else -math.inf


def joined_groups(rows: list[int], most: int) -> list[int]:
    """Number of the joined group of each group, in the order given: filled up to `most` queries."""
    out, now, held = [], 0, 0
    for n in rows:
        if held and held + n > most:
            now, held = now + 1, 0
        out.append(now)
        held += n
    return out


class Needs:
    """Which joined groups need a vector. Groups: pivot, radius, greatest norm, sure score, joined group."""

    def __init__(self, groups: list[tuple[int, float, float, float, int]], pivots: np.ndarray):
        self.cell = np.array([g[0] for g in groups])
        self.radius, self.norm, self.sure = (np.array([g[i] for g in groups], float) for i in (1, 2, 3))
        self.joined = np.array([g[4] for g in groups])
        self.pivots = pivots

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, joined group) pairs."""
        norm = np.sqrt((x**2).sum(1))[:, None]
        mid = (x @ self.pivots.T)[:, self.cell]
        high = np.minimum(mid + self.radius * norm, self.norm * norm)
        needed = high + _ROUNDING * (1 + np.abs(mid) + self.radius * norm) >= self.sure
        by_group = np.zeros((len(x), self.joined.max() + 1), bool)
        for g in np.unique(self.joined):
            by_group[:, g] = needed[:, self.joined == g].any(1)
        return np.nonzero(by_group)

    def sent(self, rows: DataFrame) -> DataFrame:
        """rows(vec_id, v) to g, vec_id, v: a row for each joined group that needs it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    row, g = self.of(_matrix(part["v"]))
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), part["vec_id"].take(pa.array(row)), part["v"].take(pa.array(row))], ["g", "vec_id", "v"])

        return rows.select("vec_id", "v").mapInArrow(run, "g int, vec_id bigint, v array<bigint>")


def _solve(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        qi, di = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        scores = scores_of(_matrix(left["v"]), _matrix(right["v"]))
        row, col = best(scores, qi, di, k)
        return pa.table({"query_id": qi[row], "vec_id": di[col], "score": scores[row, col]})

    return run


def top_k(vectors: DataFrame, k: int = K, rows_per_pivot: int = 2048) -> DataFrame:
    """vectors(vec_id, v array<bigint>, is_query) to query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    n = vectors.count()
    wanted = min(MOST_PIVOTS, max(1, n // rows_per_pivot))
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").collect()  # at most MOST_PIVOTS vectors
    if not picked:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max({len(r["v"]) for r in picked}, key=lambda w: (sum(len(r["v"]) == w for r in picked), w))
    pivots = np.unique(np.array([r["v"] for r in picked if len(r["v"]) == width], float), axis=0)
    of_length = vectors.filter(F.size("v") == width)
    queries = of_length.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("repeats"))
    repeats = queries.agg(F.max("repeats")).first()[0] or 0
    both = of_length.select("vec_id", "v", F.lit(False).alias("is_query")).unionByName(queries.select("vec_id", "v", F.lit(True).alias("is_query")))
    placed = cut(assign(both, pivots), "cells")
    # sure scores from one block of the own cell and ring: at most MOST_PIVOTS * MOST_RINGS summaries
    sums = placed.groupBy("cell", "ring", "is_query").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect()
    blocks = {(r["cell"], r["ring"]): -(-r["n"] // DATA_BLOCK) for r in sums if not r["is_query"]}
    size = F.broadcast(spark.createDataFrame([(*c, b) for c, b in blocks.items()] or [(-1, -1, 1)], "cell int, ring int, blocks int"))
    h = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(2**31))
    dealt = placed.join(size, ["cell", "ring"], "left").withColumn("block", (h % F.coalesce("blocks", F.lit(1))).cast("int"))
    sure = dealt.select("cell", "ring", "block", "vec_id", "v", "is_query").groupBy("cell", "ring", "block").applyInArrow(_local(k), "vec_id bigint, sure double")
    asked = cut(placed.filter("is_query").join(sure, "vec_id").select("vec_id", "v", "cell", "ring", "far", "norm", "sure"), "queries")
    least = {(r["cell"], r["ring"]): r["sure"] for r in asked.groupBy("cell", "ring").agg(F.min("sure").alias("sure")).collect()}
    data: dict[int, tuple[int, float]] = {}
    for r in sums:
        if not r["is_query"]:
            a, b = data.get(r["cell"], (0, 0.0))
            data[r["cell"]] = (a + r["n"], max(b, r["far"]))
    groups = []
    for r in sums:
        if r["is_query"]:
            known = max(least[r["cell"], r["ring"]], sure_by_summaries(pivots[r["cell"]], r["far"], pivots, data, k, repeats))
            groups.append((r["cell"], r["ring"], r["far"], r["norm"], known, r["n"]))
    if not groups:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    groups.sort(key=lambda x: (x[1], x[0]))  # near rings, which need little, join near rings
    joined = joined_groups([x[5] for x in groups], QUERY_BLOCK)
    needs = Needs([(x[0], x[2], x[3], x[4], g) for x, g in zip(groups, joined, strict=True)], pivots)
    reach = needs.sent(placed.filter("not is_query"))
    counts = {r["g"]: r["n"] for r in reach.groupBy("g").agg(F.count("*").alias("n")).collect()}
    held = {g: sum(x[5] for x, j in zip(groups, joined, strict=True) if j == g) for g in set(joined)}
    route = [(x[0], x[1], g, -(-held[g] // QUERY_BLOCK), max(1, -(-counts.get(g, 0) // DATA_BLOCK))) for x, g in zip(groups, joined, strict=True)]
    places = F.broadcast(spark.createDataFrame(route, "cell int, ring int, g int, q_blocks int, d_blocks int"))
    sizes = F.broadcast(spark.createDataFrame(sorted({x[2:] for x in route}), "g int, q_blocks int, d_blocks int"))
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    by = ["g", "qb", "db"]
    left = asked.join(places, ["cell", "ring"]).withColumn("qb", (h % F.col("q_blocks")).cast("int")).withColumn("db", spread("d_blocks")).select(*by, "vec_id", "v")
    right = reach.join(sizes, "g").withColumn("db", (h % F.col("d_blocks")).cast("int")).withColumn("qb", spread("q_blocks")).select(*by, "vec_id", "v")
    found = left.groupBy(*by).cogroup(right.toDF(*right.columns).groupBy(*by)).applyInArrow(_solve(k), "query_id bigint, vec_id bigint, score bigint")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for each whose vec_id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & whole(F.col("embedding")))
    return top_k(rows.select("vec_id", quantised(F.col("embedding")).alias("v"), (F.col("vec_id") % 50 == 0).alias("is_query")))


SQL = {
    "op1_voronoi_knn": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
qs AS (SELECT vec_id, min(v) AS v FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM qs q JOIN e d ON q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
