"""Tables as Parquet files below a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def settled(rows: DataFrame) -> DataFrame:
    """`rows`, each found once before what is made of it: an array of a row is exploded, which filters aren't moved below,
    where each use of a column would bring a copy of all of its making along."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("__row")).select("__row.*")


def dealt(rows: DataFrame, *keys: str, tasks: int = 4) -> DataFrame:
    """`rows` dealt over all cores by `keys`, so many tasks to each, where a table of few splits has much to be done a row.

    The number is stated, as partitions of few bytes would otherwise be put together again."""
    spark = rows.sparkSession
    n = max(tasks * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(n, *keys)


#: Texts up to which a dictionary of what they say is broadcast, and the characters that each of them has at most.
FEW_TEXTS, SHORT_TEXT = 10_000, 1_000


def found_once(rows: DataFrame, finders: dict[str, tuple[Column, Callable[[Column], Column]]], name: str, most: int = FEW_TEXTS) -> DataFrame:
    """`rows` with a column `name`: a struct of `find(text)` for each of `finders` (a text column and its find).

    Of texts that are few for all the rows that have them, each is read once and joined from a dictionary; what isn't in
    it (long texts, and all where they are over `most`) is read row by row. If `most` isn't 0, `rows` are gone through twice before, for the number of texts and
    for the texts themselves, so they can't be a stream. Each struct is found before what is made of it, as in `settled`."""
    texts = {k: F.when(F.length(text) <= SHORT_TEXT, text) for k, (text, _) in finders.items()}
    few: list[str] = []
    if most:
        counts = rows.agg(F.count("*").alias("__n"), *[F.approx_count_distinct(text).alias(k) for k, text in texts.items()]).first()
        few = [k for k in texts if 0 < counts[k] <= min(most, counts["__n"] / 4)]
    known: dict[str, list] = {k: [] for k in few}
    if few:
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), texts[k].alias("x")) for k in few])).alias("e")
        for r in rows.select(each).select("e.*").where("x is not null").distinct().collect():
            known[r["k"]].append((r["x"],))
    held, made = rows, []
    for i, (k, (text, find)) in enumerate(finders.items()):
        value = find(text)
        if known.get(k):
            # Dealt, as a projection of local rows would be found by the driver alone.
            given = rows.sparkSession.createDataFrame(known[k], "x string").repartition(rows.sparkSession.sparkContext.defaultParallelism)
            held = held.join(F.broadcast(given.select(F.col("x").alias(f"__x{i}"), find(F.col("x")).alias(f"__f{i}"))), text == F.col(f"__x{i}"), "left")
            value = F.when(F.col(f"__x{i}").isNotNull(), F.col(f"__f{i}")).otherwise(value)
        made.append(value.alias(k))
    return held.select(*[F.col(f"`{c}`") for c in rows.columns], F.explode(F.array(F.struct(*made))).alias(name))


def contracted(rows: DataFrame, contract: str) -> DataFrame:
    """`rows` as a contract has them: its columns in its order and of its types. Columns that it doesn't have go; a value
    that isn't of the type is null; a column that isn't there is an error, as no rows could be right."""
    fields = T.StructType.fromDDL(contract).fields
    missing = [f.name for f in fields if f.name not in rows.columns]
    if missing:
        raise ValueError(f"columns that aren't there: {', '.join(missing)}")
    return rows.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def breaches(rows: DataFrame, contract: str) -> DataFrame:
    """column, problem and n of what breaks a contract (DDL, `not null` where a value is demanded).

    MISSING and EXTRA columns have no number; of others TYPE counts the values that aren't of the type, and NULL those that
    are demanded and aren't there, or aren't of the type. All are counted in one pass over the table."""
    fields = T.StructType.fromDDL(contract).fields
    wanted = {f.name for f in fields}
    there = [f for f in fields if f.name in rows.columns]
    told = [(f.name, "MISSING") for f in fields if f.name not in rows.columns] + [(c, "EXTRA") for c in rows.columns if c not in wanted]
    counts = []
    for f in there:
        value, cast = F.col(f"`{f.name}`"), F.col(f"`{f.name}`").try_cast(f.dataType)
        counts += [(f.name, "TYPE", F.count_if(value.isNotNull() & cast.isNull())), (f.name, "NULL", F.count_if(cast.isNull()) if not f.nullable else F.lit(0).cast("long"))]
    spark = rows.sparkSession
    fixed = spark.createDataFrame([(c, p, None) for c, p in told], "column string, problem string, n long")
    if not counts:
        return fixed
    cells = rows.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), n.alias("n")) for c, p, n in counts]).alias("x"))
    return fixed.unionAll(cells.select(F.explode("x").alias("x")).select("x.*").where("n > 0"))


def bounded(body: str, most: int) -> tuple:
    """Columns of the first `most` bytes of a binary column as text, and whether there were more.

    A character that the bound cuts through is replaced, as are bytes that are no text."""
    held = F.col(body)
    return F.make_valid_utf8(F.substring(held, 1, most).cast("string")), F.coalesce(F.length(held) > most, F.lit(False))
