"""Filters, relevance, orders and pages of a search."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import canonicalize, like_pattern


def all_of(facets: Iterable[Column | None]) -> Column:
    """The conjunction of the facets that are given; none lets every row through."""
    return reduce(lambda a, b: a & b, (f for f in facets if f is not None), F.lit(True))


def any_contains(columns: Iterable[str], text: str | None) -> Column | None:
    if not text:
        return None
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in columns))


def any_like(columns: Iterable[str], text: str | None) -> Column | None:
    """As any_contains, by an escaped LIKE."""
    if not text:
        return None
    return reduce(lambda a, b: a | b, (F.like(F.lower(F.col(c)), F.lit(f"%{like_pattern(text.lower())}%"), F.lit("!")) for c in columns))


def one_of(column: str, names: Iterable[str] | None, known: Iterable[str]) -> Column | None:
    """IN, from names as people type them; unknown ones are dropped, and none left means no predicate."""
    known = set(known)
    found = [n for n in (x.strip().upper().replace(" ", "_") for x in names or ()) if n in known]
    return F.col(column).isin(found) if found else None


def at_most_or_unset(column: str, limit: float | None) -> Column | None:
    return None if limit is None else F.col(column).isNull() | (F.col(column) <= limit)


def since(first: str, fallback: str, at: Column) -> Column:
    return F.coalesce(F.col(first), F.col(fallback)) > at


def optional_in(column: str, values: list | None) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(values)


def relevance(phrase: str, title: str, document: str, most_terms: int = 6) -> tuple[Column, Column]:
    """Whether all terms of the phrase are there, and the score: whole title 1000, its beginning 400, the phrase in it
    250; for each term 60 in the title and 5 in the document."""
    said = " ".join(phrase.lower().split())
    terms = list(dict.fromkeys(said.split()))[:most_terms]
    name, text = canonicalize(F.col(title)), canonicalize(F.col(document))

    def points(test: Column, n: int) -> Column:
        return F.when(test, n).otherwise(0)

    whole = points(name == said, 1000) + points(name.startswith(said), 400) + points(name.contains(said), 250)
    each = [points(name.contains(t), 60) + points(text.contains(t), 5) for t in terms]
    every = reduce(lambda a, b: a & b, (name.contains(t) | text.contains(t) for t in terms), F.lit(True))
    return every, reduce(lambda a, b: a + b, each, whole)


def page(rows: DataFrame, order: list[Column], number: int, size: int, cap: int = 100) -> DataFrame:
    """A page in an order that ends with a unique key."""
    size, number = max(1, min(size, cap)), max(0, number)
    return rows.orderBy(*order).offset(number * size).limit(size)


def pages_of(rows: DataFrame, size: int, cap: int = 100) -> DataFrame:
    """How many rows and pages of a size there are; it is counted when it is asked for."""
    size = max(1, min(size, cap))
    return rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


def top_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each key; Spark cuts each task's rows before it shuffles them."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("place") <= n)


def placed(rows: DataFrame, key: str, rank: str, score: str, tie: str, step: float) -> DataFrame:
    """`rows` with place, from 1 within each `key`: by rank, then by falling score, unknown ones last, then by `tie`.

    Rows are ordered within steps of the score only, and what is in the steps before is counted, so that not all rows of a
    large key are sorted in one task. `step` is to leave few enough rows in each. Null keys and ranks are values like others."""
    band = F.coalesce(F.floor(F.col(score) / step), F.lit(-(2**62)))
    held = rows.withColumn("__band", band)
    counts = held.groupBy(key, rank, "__band").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(key).orderBy(rank, F.desc("__band")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(key, rank, "__band").orderBy(F.desc_nulls_last(score), tie)
    counts = counts.select(F.col(key).alias("__key"), F.col(rank).alias("__rank"), F.col("__band").alias("__of"), "__before")
    same = F.col(key).eqNullSafe(F.col("__key")) & F.col(rank).eqNullSafe(F.col("__rank")) & (F.col("__band") == F.col("__of"))
    return held.withColumn("__at", F.row_number().over(within)).join(counts, same).withColumn("place", F.col("__before") + F.col("__at")).drop("__band", "__at", "__before", "__key", "__rank", "__of")
