"""Hard negatives by norm-bucketed search, exact in whole numbers.

Candidates are sorted by norm, longest first, and dealt as buckets of rows that are alike in length. An anchor's
inner product with any row of a bucket is at most the product of the anchor's norm and the bucket's largest
(Cauchy-Schwarz). So an anchor passes over a bucket, and over all shorter ones, once that bound is below the lower
limits of all its windows, or below the k-th score that each window has so far. Blocks of anchors meet stripes of
buckets; a stripe holds buckets of any length, so its first ones fill the windows and prune the others.

The same search finds the positives (one window without limits, rows of the anchor's label) and, for the window
that each positive gives, the negatives (rows of other labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siltstone.llm.common import cut, table

POSITIVES, NEGATIVES, EVERY, MOVED, LABELS, GRID = 5, 5, 100, 7, 10, 256
#: Rows of a bucket, buckets of a stripe and anchors of a block; the last two on average.
BUCKET, STRIPE, BLOCK = 2_048, 8, 1_024
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_BUCKETS = "bucket long, dim int, top long, ids binary, labels binary, vectors binary, width int"
_FOUND = "anchor_id long, at int, id long, score long"


def whole_vectors(vectors: DataFrame, label: Column, grid: int = GRID) -> DataFrame:
    """vec_id, label, vector (whole numbers: floor(grid * x)), dim and norm2, the squared length, of the rows that take part.

    Rows without an id, a label or a vector, or with a null or non-finite component take no part. Nor do rows whose squared
    length is 2^62 or more, whose scores a long couldn't hold. Of rows that repeat an id the one of the
    least label, then of the least vector, takes part."""
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    ints = F.transform("embedding", lambda v: F.floor(v.cast("double") * grid))
    size = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), ints.alias("vector")).where(size < 2.0**62)
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("x")).select("vec_id", "x.label", "x.vector")
    return one.select("*", F.size("vector").alias("dim"), F.aggregate("vector", F.lit(0).cast("long"), lambda s, v: s + v * v).alias("norm2"))


def _small(values: np.ndarray) -> np.ndarray:
    """`values` in the narrowest whole numbers that hold them."""
    most = max(int(values.max(initial=0)), -1 - int(values.min(initial=0)))
    return values.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _bucketed(batches: Iterator[pa.RecordBatch], bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows as they come, which is by dim and falling norm, `bucket` of one dim to a row."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        ids, labels, norms = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "norm2"))
        flat, ends = batch.column("vector").flatten().to_numpy(zero_copy_only=False), np.cumsum(dims, dtype=np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(dims)) + 1, [len(dims)]]) if len(dims) else np.zeros(1, int)
        cuts = [i for a, b in zip(edges[:-1], edges[1:]) for i in range(a, b, bucket)] + [len(dims)]
        made = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            vectors = _small(flat[ends[a] - dims[a] : ends[b - 1]])
            made.append((0, int(dims[a]), int(norms[a:b].max()), ids[a:b].astype("<i8").tobytes(), labels[a:b].astype("<i8").tobytes(), vectors.tobytes(), vectors.itemsize))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32()))], ["bucket", "dim", "top", "ids", "labels", "vectors", "width"])


def buckets_of(rows: DataFrame, many: int, bucket: int = BUCKET) -> DataFrame:
    """The rows sorted by norm, in buckets; ties in norm are parted by id. `many` is how many rows there are."""
    order = ["dim", F.desc("norm2"), "vec_id"]
    dealt = rows.repartitionByRange(max(1, -(-many // (4 * bucket))), *order).sortWithinPartitions(*order)
    packed = cut(dealt.mapInArrow(lambda batches: _bucketed(batches, bucket), _BUCKETS))
    return packed.withColumn("bucket", F.monotonically_increasing_id())


def products(left: np.ndarray, right: np.ndarray, most: float) -> np.ndarray:
    """Inner products in whole numbers; no sum of absolute terms is over `most`, so floats that hold it are exact."""
    if most < 2.0**53:
        kind = np.float32 if most < 2.0**24 else np.float64
        return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)
    return left @ right.astype(np.int64).T


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The `k` first of each row: largest scores, ties by smaller id."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], score[keep], ids[keep]


def search(left: pd.DataFrame, right: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    """For each window of each anchor of `left` its `k` first rows among the buckets of `right`; see `_FOUND`.

    `at` is the window's place. `same` asks for other rows of the anchor's label, else for rows of other labels."""
    empty = pd.DataFrame({"anchor_id": [], "at": [], "id": [], "score": []}, dtype="int64")
    if not len(left) or not len(right):
        return empty
    dim, own, label = int(left["dim"].iloc[0]), left["vec_id"].to_numpy(), left["label"].to_numpy()
    anchors = np.array(left["vector"].tolist(), np.int64).reshape(len(left), dim)
    norm = np.sqrt(left["norm2"].to_numpy(np.float64))
    windows = max(map(len, left["low"]))
    low, high = np.full((len(left), windows), _HIGH), np.full((len(left), windows), _LOW)
    for i, (a, b) in enumerate(zip(left["low"], left["high"], strict=True)):
        low[i, : len(a)], high[i, : len(b)] = a, b
    need = low.copy()
    top = high.max(axis=1)
    none = np.zeros(0, np.int64)
    held = [(none, none, none)] * windows
    for _, b in right.sort_values(["top", "bucket"], ascending=[False, True]).iterrows():
        least = need.min(axis=1)
        reach = norm * np.sqrt(float(b["top"])) * (1 + 1e-9) + 1e-6
        live = np.flatnonzero(reach >= least)
        if not len(live):
            break  # the other buckets are shorter
        ids, labels = np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8")
        vectors = np.frombuffer(b["vectors"], f"i{b['width']}").reshape(len(ids), dim)
        scores = products(anchors[live], vectors, float(reach[live].max()))
        fit = (scores >= least[live][:, None]) & (scores <= top[live][:, None])
        fit &= (label[live][:, None] == labels[None, :]) == same
        if same:
            fit &= own[live][:, None] != ids[None, :]
        row, col = np.nonzero(fit)
        score, row, ids = scores[row, col], live[row], ids[col]
        for w in range(windows):
            at = np.flatnonzero((score >= need[row, w]) & (score <= high[row, w]))
            if len(at):
                held[w] = _best(*(np.concatenate([x, y[at]]) for x, y in zip(held[w], (row, score, ids))), k)
                full, count = np.unique(held[w][0], return_counts=True)
                last = held[w][1][np.cumsum(count) - 1]
                need[full[count == k], w] = np.maximum(need[full[count == k], w], last[count == k])
    parts = [pd.DataFrame({"anchor_id": own[r], "at": w, "id": i, "score": s}) for w, (r, s, i) in enumerate(held) if len(r)]
    return pd.concat(parts) if parts else empty


def first(anchors: DataFrame, buckets: DataFrame, blocks: int, stripes: int, same: bool, k: int) -> DataFrame:
    """anchor_id, at, id, score and rank of the `k` first rows for each window (`low`, `high`) of each anchor."""
    left = anchors.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = buckets.withColumn("s", F.pmod(F.xxhash64("bucket"), F.lit(stripes)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    tiles = left.groupBy("s", "b", "dim").cogroup(right.groupBy("s", "b", "dim"))
    found = tiles.applyInPandas(lambda a, b: search(a, b, same, k), _FOUND)
    order = W.partitionBy("anchor_id", "at").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, bucket: int = BUCKET, stripe: int = STRIPE, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for `vectors` (vec_id, embedding).

    `is_anchor` is asked of vec_id, `label` of the columns of `vectors`. A positive is one of the anchor's first `positives`
    other rows of its label; its negatives are the first `negatives` rows of other labels that score at least 80 % and at
    most 100 % of it. Higher scores come first, ties by smaller id; fewer rows give fewer. Which rows take
    part says `whole_vectors`; rows of another vector length than the anchor's are no candidates. An anchor without
    positives, and a positive without negatives, gives no rows; so does an empty table. Other columns are ignored."""
    rows = cut(whole_vectors(vectors, label))
    asks = rows.where(is_anchor)
    many = rows.count()
    buckets = buckets_of(rows, many, bucket)
    stripes, blocks = max(1, -(-buckets.count() // stripe)), max(1, -(-asks.count() // block))
    any_score = asks.withColumns({"low": F.array(F.lit(int(_LOW))), "high": F.array(F.lit(int(_HIGH)))})
    found = first(any_score, buckets, blocks, stripes, True, positives)
    near = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    near = cut(near.select(F.col("anchor_id").alias("vec_id"), "near"))
    high = F.transform("near", lambda x: x["score"])
    # Four fifths of a score, rounded up, without leaving whole numbers.
    limits = {"low": F.transform(high, lambda s: s - F.call_function("div", s - F.pmod(s, F.lit(5)), F.lit(5))), "high": high}
    windows = asks.join(near, "vec_id").withColumns(limits).drop("near")
    mined = first(windows, buckets, blocks, stripes, False, negatives)
    joined = mined.join(near.withColumnRenamed("vec_id", "anchor_id"), "anchor_id").withColumn("positive", F.col("near")[F.col("at")])
    return joined.select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))


def moved_label(every: int = MOVED, labels: int = LABELS) -> Column:
    """The label, or the next one where `every` divides vec_id."""
    return F.when(F.pmod("vec_id", F.lit(every)) == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))


def op12_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(EVERY)) == 0, moved_label())


QUERIES = {"op12_mining": op12_mining}
ORACLE_SQL: dict[str, str] = {
    "op12_mining": """
    with fine as (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
      from embeddings
      where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
    pairs as (
      select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
      from fine a join fine b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 100 = 0),
    near as (
      select anchor_id, id as positive_id, score as positive_score
      from (select *, row_number() over (partition by anchor_id order by score desc, id) as n from pairs where same) where n <= 5),
    ranked as (
      select n.anchor_id, n.positive_id, row_number() over (partition by n.anchor_id, n.positive_id order by p.score desc, p.id)::int as rank, p.id as negative_id, n.positive_score, p.score as negative_score
      from near n join pairs p on p.anchor_id = n.anchor_id and not p.same
      where 80 * n.positive_score <= 100 * p.score and 100 * p.score <= 100 * n.positive_score)
    select * from ranked where rank <= 5
    """
}
