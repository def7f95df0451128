"""Exact top-k search by inner product, by aggregation of sorted lists without random access.

Candidates meet queries in tiles of bounded size. Within a tile a run of candidates has one list for each dimension,
sorted by that dimension's part of the score: from the largest entry down where the query's entry is positive, from the
smallest up where it is negative. All lists are read to the same depth. What has been read of a candidate counts as it
is; what has not lies between the list's last read entry and its end, which gives a lower and an upper bound for every
pair. A pair whose upper bound is below the k-th best score that its query has for certain goes; lists are read further
until few pairs are left, whose scores are then resolved. The bounds of a run for a block of queries are matrix products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, written
from .vectors import integers, matrix, usable

SCALE = 1024
K = 10
TILE_ROWS = 1 << 16  # candidates of a tile, about
TILE_QUERIES = 1 << 14
LEAST_ROWS = 2048  # of a tile, before tiles are made for the sake of more tasks
RUN = 2048  # candidates whose lists are read together
BLOCK = 256  # queries whose bounds are computed together
DEPTHS = (1 / 8, 1 / 4, 1 / 2, 3 / 4)  # of a run, at which bounds are compared
FEW = 1 / 32  # of the pairs of a run: resolved without reading further
_EXACT = 1 << 53


class Best:
    """The k best candidates of each query so far: score falling, then place (order of the ids) rising."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.score, self.place = [np.zeros(0, object) for _ in range(queries)], [np.zeros(0, np.int64) for _ in range(queries)]

    def sure(self, first: int, end: int) -> np.ndarray:
        """The score that a further candidate must reach, for each query."""
        return np.array([float(s[-1]) if len(s) == self.k else -np.inf for s in self.score[first:end]])

    def add(self, query: int, scores: np.ndarray, places: np.ndarray) -> None:
        scores, places = np.concatenate([self.score[query], scores]), np.concatenate([self.place[query], places])
        order = np.lexsort((places, -scores))[: self.k]
        self.score[query], self.place[query] = scores[order], places[order]


def pruned(rows: np.ndarray, lists: np.ndarray, queries: np.ndarray, own: np.ndarray, sure: np.ndarray, k: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, query) that may belong to the best k. lists: rows with each column sorted; own: pairs that do not count;
    sure: for each query a score that k other candidates are known to reach.
    """
    m, plus, minus = len(rows), np.maximum(queries, 0).T, np.minimum(queries, 0).T
    for depth in DEPTHS:
        t = max(1, int(m * depth))
        high, low = lists[m - t], lists[t - 1]
        upper = np.maximum(rows, high) @ plus + np.minimum(rows, low) @ minus
        lower = np.where(rows >= high, rows, lists[0]) @ plus + np.where(rows <= low, rows, lists[-1]) @ minus
        upper[own[:, 0], own[:, 1]] = lower[own[:, 0], own[:, 1]] = -np.inf
        if m > k:
            sure = np.maximum(sure, np.partition(lower, m - k, axis=0)[m - k] - margin)
        alive = upper + margin >= sure
        if np.count_nonzero(alive) <= max(FEW * alive.size, k * alive.shape[1]):
            break
    else:
        upper = rows @ queries.T
        upper[own[:, 0], own[:, 1]] = -np.inf
        if m > k:
            sure = np.maximum(sure, np.partition(upper, m - k, axis=0)[m - k] - 2 * margin)
        alive = upper + margin >= sure
    alive[own[:, 0], own[:, 1]] = False
    return np.nonzero(alive)


def tile_best(rows: np.ndarray, uids: np.ndarray, places: np.ndarray, queries: np.ndarray, query_uids: np.ndarray, k: int) -> Best:
    """The best k of rows for every query; a row and a query of one uid are the same row and do not meet."""
    best = Best(len(queries), k)
    largest = int(np.abs(rows).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    exact, margin = largest < _EXACT, 0.0 if largest < _EXACT else float(largest) * 2.0**-44
    at = {u: i for i, u in enumerate(query_uids.tolist())}
    for first in range(0, len(rows), RUN):
        x, ids = rows[first : first + RUN], uids[first : first + RUN].tolist()
        wide, lists = x.astype(np.float64), np.sort(x.astype(np.float64), axis=0)
        met = np.array([(i, at[u]) for i, u in enumerate(ids) if u in at], np.int64).reshape(-1, 2)
        for start in range(0, len(queries), BLOCK):
            q = queries[start : start + BLOCK]
            own = met[(met[:, 1] >= start) & (met[:, 1] < start + len(q))] - [0, start]
            r, c = pruned(wide, lists, q.astype(np.float64), own, best.sure(start, start + len(q)), k, margin)
            order = np.argsort(c, kind="stable")
            r, c = r[order], c[order]
            scores = np.einsum("ij,ij->i", x[r], q[c]).astype(object) if exact else np.einsum("ij,ij->i", x[r].astype(object), q[c].astype(object))
            cuts = np.searchsorted(c, np.arange(len(q) + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[i], cuts[i + 1])
                best.add(start + i, scores[part], places[first + r[part]])
    return best


def search(df: DataFrame, id: str, vector: str, is_query: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), id under its own name, score: the k rows with the largest inner products for each row where
    is_query holds, all if there are fewer; ties go to the smaller id, null last. A query's own row is no candidate, other
    rows with its id are; rows that share an id are rows of their own. Rows whose vector is null or holds null or a number
    that is not finite take no part; a shorter vector has zeros behind it. Scores beyond a long are held to it.
    """
    own = F.col(f"`{vector}`")
    kept = df.where(usable(own)).select(F.col(f"`{id}`").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), integers(own, scale).alias("x"), F.monotonically_increasing_id().alias("uid"))
    rows = written(kept, "vectors")
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    session = df.sparkSession
    across = max(1, -(-total // TILE_ROWS), min(session.sparkContext.defaultParallelism, -(-total // LEAST_ROWS)))
    down = max(1, -(-asking // TILE_QUERIES))
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("id", "uid", "x", spread(across).alias("g")).withColumn("h", every(down))
    queries = rows.where("asks").select("id", "uid", "x", spread(down).alias("h")).withColumn("g", every(across))
    ids = pa.int64() if dict(rows.dtypes)["id"] == "bigint" else None

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names, out = left.column("id").combine_chunks(), {"query": [], "query_id": [], "id": [], "uid": [], "score": []}
        if len(left) and len(right):
            dims = max(int(t.column("x").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (left, right))
            order = pc.sort_indices(left.select(["id", "uid"]), sort_keys=[("id", "ascending"), ("uid", "ascending")], null_placement="at_end").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            uids, query_uids = left.column("uid").to_numpy(), right.column("uid").to_numpy()
            best = tile_best(matrix(left.column("x"), dims), uids, place, matrix(right.column("x"), dims), query_uids, k)
            asked = right.column("id").to_pylist()
            for i, (scores, places) in enumerate(zip(best.score, best.place, strict=True)):
                picked = order[places]
                out["query"] += [query_uids[i]] * len(picked)
                out["query_id"] += [asked[i]] * len(picked)
                out["id"] += names.take(pa.array(picked)).to_pylist()
                out["uid"] += uids[picked].tolist()
                out["score"] += [max(-(1 << 63), min((1 << 63) - 1, int(s))) for s in scores]
        kind = ids or names.type
        return pa.table([pa.array(out["query"], pa.int64()), pa.array(out["query_id"], kind), pa.array(out["id"], kind), pa.array(out["uid"], pa.int64()), pa.array(out["score"], pa.int64())], names=[*out])

    own_type = dict(rows.dtypes)["id"]
    found = lean(candidates).groupBy("g", "h").cogroup(queries.groupBy("g", "h")).applyInArrow(tile, f"query long, query_id {own_type}, id {own_type}, uid long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id), "score")


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows of embeddings for each one whose vec_id is divisible by 100; an empty table gives no rows. Rows without
    a vec_id are candidates, after those with one where scores tie.
    """
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(rows, "vec_id", "embedding", F.col("vec_id") % 100 == 0)


def op13_sql() -> str:
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT q.uid AS query, q.vec_id AS query_id, c.vec_id, c.uid, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, uid)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
