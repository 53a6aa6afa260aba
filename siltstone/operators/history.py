"""Operators over histories: latest and first rows, streaks, admission, retention, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key in `order`, by an aggregate that needs no sort and merges before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("__row")).select(*key, "__row.*")


def first(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(*key).agg(best.alias("__row")).select(*key, "__row.*")


def streaks(rows: DataFrame, key: list[str], order: list[Column], failed: Column) -> DataFrame:
    """For each row the failures in a row up to it: 0 after a success."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__run", F.sum(F.when(failed, 0).otherwise(1)).over(upto))
    run = Window.partitionBy(*key, "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(run)).drop("__run")


def transitions(rows: DataFrame, key: list[str], order: list[Column], state: str) -> DataFrame:
    """from_state and to_state of each change of state; the first row of a key comes from null."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("from_state", before).withColumnRenamed(state, "to_state").where(F.col("from_state").isNull() | (F.col("from_state") != F.col("to_state")))


def superseded(rows: DataFrame, key: list[str], order: list[Column], keep: int, exempt: Column) -> DataFrame:
    """Rows beyond the newest `keep` of each key, apart from those that are exempt and don't count."""
    counted = rows.where(~exempt)
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return counted.withColumn("place", place).where(F.col("place") > keep)


def dense_histogram(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A count for every value of an enumeration, zero where there is none."""
    every = rows.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"position int, {column} string")
    return every.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left").select("position", column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
