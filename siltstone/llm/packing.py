"""Cost-balanced packing of documents into sequences of a fixed token capacity.

A piece of L tokens costs `linear * L + quadratic * L * L`: the dense layers' work and that of attention.
Pieces are taken in descending length; each goes to the sequence of lowest cost so far that still has room.
Documents over the capacity are first cut into full pieces and a rest.

Spark deals the pieces out by a hash of document and start into groups of about `GROUP_TOKENS` tokens, whatever
the input's size; each group is packed by itself in one task, so a group leaves less than one sequence unfilled
beyond what the rule itself leaves. Of the tokens only counts and checksums move; they are found once.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, table, text_or_empty
from siltstone.llm.tokens import chunk_encoder, slices

CAPACITY, END_ID = 4096, 2
#: Tokens that one task packs: about 1,000 sequences.
GROUP_TOKENS = 4_000_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _cut(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encoder, end = chunk_encoder(path), np.array([end_id], "<u4")
    for batch in batches:
        ids_of = batch.column(0)
        for begin, texts in slices(batch.column(1)):
            flat, bounds = encoder.encode(texts)
            rows: list[tuple[int, int, int, int]] = []
            for i in range(len(texts)):
                ids = np.concatenate([flat[bounds[i] : bounds[i + 1]], end])
                rows += [(begin + i, s, min(capacity, len(ids) - s), zlib.crc32(ids[s : s + capacity].tobytes()), len(ids)) for s in range(0, len(ids), capacity)]
            row, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(row)), *map(pa.array, rest)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's tokens and an end id, cut at multiples of `capacity`; a null text counts as empty.

    Repeated rows stay documents of their own; a null doc_id stays null; other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(partial(_cut, path=path, capacity=capacity, end_id=end_id), PIECES)


def assign(lengths: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset there of each length; `lengths` must descend and none be over `capacity`.

    There are as many sequences as the tokens need; what then fits in none is dealt out alike over further ones.
    Of sequences that cost the same, the first is taken."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    todo, made = np.arange(len(lengths)), 0
    while len(todo):
        n = -(-int(lengths[todo].sum()) // capacity)
        used, left = [0] * n, []
        heap = [(0.0, made + k) for k in range(n)]
        for at in todo.tolist():
            size = int(lengths[at])
            aside = []
            while heap and used[heap[0][1] - made] + size > capacity:
                aside.append(heapq.heappop(heap))
            if heap:
                cost, k = heap[0]
                sequence[at], offset[at] = k, used[k - made]
                used[k - made] += size
                heapq.heapreplace(heap, (cost + linear * size + quadratic * size * size, k))
            else:
                left.append(at)
            for x in aside:
                if used[x[1] - made] < capacity:
                    heapq.heappush(heap, x)
        todo, made = np.array(left, np.int64), made + n
    return sequence, offset


def _pack(group: pd.DataFrame, capacity: int, linear: float, quadratic: float) -> pd.DataFrame:
    number = int(group["pack_group"].iloc[0])
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True], kind="stable")
    sequence, offset = assign(group["length"].to_numpy(), capacity, linear, quadratic)
    return group.drop(columns="pack_group").assign(sequence_id=(number << 32) + sequence, offset=offset)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, linear: float = 1.0, quadratic: float = 1 / CAPACITY, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """`docs` (doc_id, text) packed: a row for each piece with its sequence_id and the offset there.

    Full pieces have sequences of their own. An empty table gives no rows; an empty text has its end id alone.
    The number of groups follows the number of tokens, so a task's memory doesn't grow with the input."""
    found = cut(pieces(docs, path, capacity, end_id))
    total = found.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / group_tokens))
    spark = docs.sparkSession
    tasks = max(1, min(groups, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Pieces that are alike in everything are counted and told apart by ordinals, so that they don't share a group.
    alike = found.groupBy(*found.columns).agg(F.count("*").alias("n")).select(*found.columns, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    dealt = alike.select(*found.columns, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups)).alias("pack_group"))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        return _pack(group, capacity, linear, quadratic)

    return dealt.repartition(tasks, "pack_group").groupBy("pack_group").applyInPandas(fill, PACKED)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_packing": op1_packing}
ORACLE_SQL: dict[str, str] = {}
