"""Operators between snapshots: upserts, gap filling, vanished and changed rows, guarded updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(state: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """`rows`, and those of `state` whose key isn't among them."""
    return state.join(rows, key, "left_anti").unionByName(rows)


def fill_gaps(state: DataFrame, rows: DataFrame, key: list[str], columns: list[str], owner: Column) -> DataFrame:
    """`state` with values of matching `rows`: the owner's replace, those of others fill nulls only.

    `owner` may name columns of both sides, as `old.` and `new.`."""
    both = state.alias("old").join(rows.alias("new"), [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key], "left")
    mine = F.coalesce(owner, F.lit(False))
    filled = {c: F.when(mine, F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}"))).otherwise(F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}"))) for c in columns}
    return both.select(*[filled.get(c, F.col(f"old.{c}")).alias(c) for c in state.columns])


def field_changes(old: DataFrame, new: DataFrame, key: list[str], fields: dict[str, Column | None]) -> DataFrame:
    """A row (key, field, previous, current) for each field that differs by its test, or by plain inequality.

    Tests name columns as `old.` and `new.`. It is one join and one pass, whatever the number of fields."""
    both = old.alias("old").join(new.alias("new"), [F.col(f"old.{k}") == F.col(f"new.{k}") for k in key])

    def change(name: str, test: Column | None) -> Column:
        was, now = F.col(f"old.{name}"), F.col(f"new.{name}")
        differs = ~was.eqNullSafe(now) if test is None else F.coalesce(test, F.lit(False))
        return F.when(differs, F.struct(F.lit(name).alias("field"), was.cast("string").alias("previous"), now.cast("string").alias("current")))

    found = F.filter(F.array(*[change(n, t) for n, t in fields.items()]), lambda x: x.isNotNull())
    return both.select(*[F.col(f"old.{k}").alias(k) for k in key], F.explode(found).alias("x")).select(*key, "x.*")


def vanished(active: DataFrame, seen: DataFrame, key: list[str], parent: str) -> DataFrame:
    """parent, n_left and closed: whether any row of `active` remains once those that weren't seen go."""
    marked = active.join(seen.select(*key).distinct().withColumn("__seen", F.lit(True)), key, "left")
    return marked.groupBy(parent).agg(F.count("__seen").alias("n_left")).withColumn("closed", F.col("n_left") == 0)


def illegal(steps: DataFrame, edges: list[tuple], names: list[str]) -> DataFrame:
    """Steps that a state machine's few edges don't allow."""
    allowed = steps.sparkSession.createDataFrame(edges, names)
    return steps.join(F.broadcast(allowed), names, "left_anti")
