"""What the operators of this subpackage share: reading tables, cutting lineage, the text of a row."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session in one process may leave it unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="siltstone-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df`, written once to the shared folder, so that no later job computes it anew."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def doc_mod(doc_id: str, n: int) -> Column:
    """crc32(doc_id as text) mod n, by which labelled rows are divided; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def written(df: DataFrame) -> DataFrame:
    """`df`, written once as a table in the shared folder: smaller than a checkpoint where rows hold long texts."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows up to which a table of a key and a number or two is broadcast (some 50 bytes a row); beyond it, the join is salted.
FEW_KEYS, SALTS = 100_000, 32


def attach(rows: DataFrame, key: str, found: DataFrame, many: int, spread: Column) -> DataFrame:
    """`rows` with the columns of `found`, which has one row for each value of its column `key`; `many` is its size.

    Rows without a match get nulls. No key's rows need meet in one task: they are dealt out by `spread`, too. Neither table
    may have columns named `__key`, `__salt` or `__at`."""
    found = found.withColumnRenamed(key, "__key")
    if many <= FEW_KEYS:
        return rows.join(F.broadcast(found), F.col(key) == F.col("__key"), "left").drop("__key")
    salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("__at", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col(key) == F.col("__key")) & (F.col("__at") == F.col("__salt")), "left").drop("__key", "__salt", "__at")


#: A key is hot if it has more than this share of all rows, and so many rows at least. At most `1 / HOT_SHARE` keys are.
HOT_SHARE, HOT_ROWS = 1 / 1000, 20_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """The hot values of a column, at most 1,000 of them and so few enough to broadcast; None if there are none."""
    counts = rows.groupBy(key).agg(F.count("*").alias("__n"))
    frequent = cut(counts.where(F.col("__n") >= HOT_ROWS))
    if frequent.isEmpty():
        return None
    hot = cut(frequent.where(F.col("__n") > rows.count() * HOT_SHARE).select(key))
    return None if hot.isEmpty() else hot


def spread_join(rows: DataFrame, key: str, found: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """`rows` joined with `found`, which has one row for each value of `key`, so that rows of hot keys stay where they are."""
    if hot is None:
        return rows.join(found, key, how)
    few = F.broadcast(hot)
    usual = rows.join(few, key, "left_anti").join(found, key, how)
    return usual.unionByName(rows.join(few, key, "left_semi").join(F.broadcast(found.join(few, key, "left_semi")), key, how))
