"""Similarity joins of short texts within blocks, without pairing all rows of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import tokens


def similar_pairs(rows: DataFrame, block: list[str], text: str, threshold: float) -> DataFrame:
    """Pairs (left, right) of distinct texts of a block, as `block`, `a`, `b` and `similarity`, whose token sets have a
    Jaccard similarity of `threshold` or more.

    Texts of which the sets are equal count as one, the least of them. Two sets that are similar enough share one of the first
    |x| - ceil(threshold |x|) + 1 tokens of each, in an order where rare tokens come first; only texts that do are compared."""
    held = rows.select(*block, F.array_sort(tokens(F.col(text))).alias("set"), F.col(text).alias("text")).groupBy(*block, "set").agg(F.min("text").alias("text"))
    each = held.select(*block, "text", "set", F.explode("set").alias("token"))
    often = each.groupBy(*block, "token").agg(F.count("*").alias("n"))
    by_rarity = F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"])
    ordered = each.join(often, [*block, "token"]).groupBy(*block, "text").agg(by_rarity.alias("set"))
    first = F.size("set") - F.ceil(F.lit(threshold) * F.size("set") - 1e-9) + 1
    keyed = ordered.withColumn("token", F.explode(F.slice("set", F.lit(1), first.cast("int"))))
    left, right = (keyed.select(*block, "token", F.col("text").alias(name), F.col("set").alias(f"{name}_set")) for name in "ab")
    near = F.size(F.array_intersect("a_set", "b_set")) / F.size(F.array_union("a_set", "b_set"))
    size = (F.size("a_set") >= threshold * F.size("b_set")) & (F.size("b_set") >= threshold * F.size("a_set"))
    met = left.join(right, [*block, "token"]).where((F.col("a") < F.col("b")) & size)
    return met.select(*block, "a", "b", near.alias("similarity")).where(F.col("similarity") >= threshold).distinct()
