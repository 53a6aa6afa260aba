"""Exact nearest neighbours by inner product with a block matrix join of int8 tiles.

Equal vectors are searched once: of each distinct vector the least ids are kept, as many as an answer can hold.
The distinct vectors go into blocks. Each block of queries meets each stripe of candidates in one tile task: an int8
product gives every inner product within a bound, |q.v - approximate| <= e, that follows from the quantisation
errors; only pairs whose upper bound reaches the k-th best lower bound of their query are recomputed from the
original vectors in double precision. Each query's answers from all stripes are merged by a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltstone.llm.common import cut, hot_keys, spread_join, table

K, EVERY = 20, 20
#: Distinct candidate vectors in a stripe and distinct query vectors in a block, on average.
STRIPE, BLOCK = 16_384, 2_048
#: Candidates that a tile multiplies at a time.
_STEP = 4_096


def usable(vector: str = "embedding") -> Column:
    """Not null, without null or non-finite components, not zero."""
    at = F.col(vector)
    fine = ~F.exists(at, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return at.isNotNull() & fine & F.exists(at, lambda x: x != 0)


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, the scale of each row, the length of its error and the length of what int8 holds of it."""
    scale = np.abs(rows).max(axis=1) / 127
    scale[scale == 0] = 1
    small = np.rint(rows / scale[:, None]).astype(np.int8)
    held = small * scale[:, None]
    return small, scale, np.linalg.norm(rows - held, axis=1), np.linalg.norm(held, axis=1)


def tile(queries: np.ndarray, candidates: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and double inner products of at least each query's `k` nearest candidates.

    q.v = q'.v' + q'.dv + dq.v' + dq.dv for quantised q', v' and errors dq, dv; the last three terms are within the
    products of their lengths. All whose inner product equals the k-th are there, too."""
    qi, qs, qe, qn = quantise(queries)
    best = np.full((len(queries), 0), -np.inf)
    floor = np.full(len(queries), -np.inf)
    rows, cols, scores = [], [], []
    for begin in range(0, len(candidates), _STEP):
        part = candidates[begin : begin + _STEP]
        vi, vs, ve, vn = quantise(part)
        # Products of int8 summed over a vector's length are whole numbers that float32 holds exactly up to 1,024 components.
        exact = np.float32 if queries.shape[1] <= 1024 else np.float64
        near = (qi.astype(exact) @ vi.astype(exact).T).astype(np.float64) * (qs[:, None] * vs)
        error = (qn[:, None] * ve + qe[:, None] * (vn + ve)) * (1 + 1e-9) + 1e-12 * (qn + qe)[:, None] * (vn + ve)
        low = near - error
        if low.shape[1] > k:
            low = np.partition(low, low.shape[1] - k, axis=1)[:, -k:]
        best = np.concatenate([best, low], axis=1)
        if best.shape[1] > k:
            best = np.partition(best, best.shape[1] - k, axis=1)[:, -k:]
        if best.shape[1] == k:
            floor = best.min(axis=1)
        q, v = np.nonzero(near + error >= floor[:, None])
        rows.append(q)
        cols.append(v + begin)
        scores.append((near + error)[q, v])
    q, v, top = map(np.concatenate, (rows, cols, scores))
    alive = top >= floor[q]
    q, v = q[alive], v[alive]
    step = max(1, (8 << 20) // queries.shape[1] // 8)
    exact_scores = [np.einsum("ij,ij->i", queries[q[i : i + step]], candidates[v[i : i + step]]) for i in range(0, len(q), step)]
    return q, v, np.concatenate(exact_scores) if exact_scores else np.empty(0)


def _search(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The `k` best candidates of a stripe for each query of a block, of equal scores those of the least first id."""
    out = {"q": [], "h": [], "v": [], "ids": pd.Series([], dtype=object), "score": []}
    if len(left) and len(right):
        right = right.sort_values("v", ignore_index=True)
        q, v, score = tile(np.stack(left["vector"].to_numpy()).astype(np.float64), np.stack(right["vector"].to_numpy()).astype(np.float64), k)
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, q, side="left")
        keep = np.arange(len(q)) - first < k
        q, v, score = q[keep], v[keep], score[keep]
        out = {"q": left["q"].to_numpy()[q], "h": left["h"].to_numpy()[q], "v": right["v"].to_numpy()[v], "ids": right["ids"].to_numpy()[v], "score": score}
    return pd.DataFrame(out)


def _merge(parts: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """A heap of the `k` best for each query of this partition. Rows of a query come from one partition."""
    heaps: dict[tuple[int, int], list] = {}
    for part in parts:
        for q, h, v, ids, score in zip(part["q"].tolist(), part["h"].tolist(), part["v"].tolist(), part["ids"].tolist(), part["score"].tolist(), strict=True):
            heap = heaps.setdefault((q, h), [])
            item = (score, -v, ids)
            if len(heap) < k:
                heapq.heappush(heap, item)
            elif item[:2] > heap[0][:2]:
                heapq.heapreplace(heap, item)
    rows = [(*key, score, i) for key, heap in heaps.items() for score, _, ids in heap for i in ids]
    yield pd.DataFrame(rows, columns=["q", "h", "score", "id"])


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """For each row of `vectors` with `is_query`, its `k` nearest other rows: query_id, rank, vec_id, score.

    The nearest have the largest inner product in double precision; ties go to the smaller id. Vectors that are
    null, zero or hold null or non-finite components take no part, nor do rows without an id. Vectors of another
    length than the query's are no candidates. Rows that repeat an id and vector count once; rows of one id with
    different vectors are rows of their own, none of which answers that id's queries. Fewer candidates give fewer
    rows. Other columns are ignored."""
    spark = vectors.sparkSession
    rows = vectors.where(is_query.isNotNull() & F.col(vec_id).isNotNull() & usable(vector))
    rows = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), is_query.alias("asks"))
    # An answer holds k rows, so of each distinct vector the k + 1 least ids suffice (one may be the query itself).
    ranked = rows.dropDuplicates(["id", "vector"]).withColumn("n", F.row_number().over(W.partitionBy("vector").orderBy("id")))
    distinct = ranked.where(F.col("n") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = cut(distinct.select("vector", "ids", F.col("ids")[0].alias("v"), F.xxhash64("vector").alias("h"), F.size("vector").alias("dim")))
    asking = rows.where("asks").select("id", "vector").distinct()
    asked = cut(spread_join(asking, "vector", distinct.select("vector", F.col("v").alias("q"), "h", "dim"), hot_keys(asking, "vector")).select("id", "vector", F.struct("q", "h").alias("at"), "q", "h", "dim"))
    # A distinct vector is named by its least id and, as rows may share an id, by its hash.
    queries = asked.dropDuplicates(["q", "h"]).select("q", "h", "vector", "dim")
    n_v, n_q = distinct.count(), queries.count()
    stripes, blocks = max(1, -(-n_v // stripe)), max(1, -(-n_q // block))
    left = queries.withColumn("b", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = distinct.withColumn("s", F.pmod(F.xxhash64(F.lit(1), "v"), F.lit(stripes)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _search(a, b, k + 1)

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _merge(parts, k + 1)

    tiles = left.groupBy("s", "b", "dim").cogroup(right.groupBy("s", "b", "dim")).applyInPandas(search, "q long, h long, v long, ids array<long>, score double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = tiles.repartition(tasks, "q", "h").mapInPandas(merge, "q long, h long, score double, id long")
    lists = found.groupBy(F.struct("q", "h").alias("at")).agg(F.collect_list(F.struct("score", "id")).alias("near"))
    answers = spread_join(asked.select(F.col("id").alias("query_id"), "at"), "at", lists, hot_keys(asked, "at"))
    answers = answers.select("query_id", F.explode("near").alias("x")).select("query_id", "x.score", "x.id").where("query_id <> id")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(EVERY)) == 0)


QUERIES = {"op9_neighbours": op9_neighbours}
ORACLE_SQL: dict[str, str] = {
    "op9_neighbours": """
    with rows as (select vec_id, embedding::double[] v from embeddings where vec_id is not null and embedding is not null),
    fine as (select * from rows where len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
    pairs as (select a.vec_id query_id, b.vec_id vec_id, list_inner_product(a.v, b.v) score
              from fine a join fine b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 20 = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
    select query_id, rank::int as rank, vec_id, score from ranked where rank <= 20
    """
}
