"""Two-pass external shuffle of documents into shards.

Pass one scatters rows over buckets by a seeded hash of the whole row, so that each bucket fits a task's memory; rows
that repeat so often that they would fill a bucket are scattered by their ordinals, too. Pass two puts each bucket into a
fixed order, shuffles it (Fisher-Yates, seeded by the bucket) and numbers its rows from where the buckets before it end.
Row p of that order goes to shard p mod n, slot p div n: shards differ by one row at most (law `rows`), and a shard read
in slot order is a uniform sample of all documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltstone.llm.common import attach, cut, table, text_or_empty

SHARDS, SEED = 8, 20240229
#: Text that a bucket holds on average.
BUCKET_BYTES = 48 << 20
#: Buckets whose sizes are summed at a time.
_BLOCK = 2048


def _shuffle_bucket(rows: pa.Table, shards: int, seed: int, schema: pa.Schema) -> pa.Table:
    """Numpy's permutation is a Fisher-Yates shuffle; sorting first makes it independent of how rows arrive."""
    bucket, base = rows["bucket"][0].as_py(), rows["base"][0].as_py()
    ordered = np.argsort(rows["hash"].to_numpy(), kind="stable")
    held = rows["row"].combine_chunks().take(pa.array(ordered[np.random.default_rng([seed, bucket]).permutation(len(rows))]))
    place = base + np.arange(len(rows))
    columns = [*held.flatten(), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
    return pa.table(columns, names=schema.names)


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind.fields)


def _running(sizes: DataFrame) -> DataFrame:
    """bucket and base, the rows of all buckets before it: summed within blocks of buckets, then over the blocks."""
    block = F.floor(F.col("bucket") / _BLOCK)
    before = W.rowsBetween(W.unboundedPreceding, -1)
    sizes = cut(sizes.withColumn("block", block))
    blocks = sizes.groupBy("block").agg(F.sum("n").alias("held")).withColumn("upto", F.coalesce(F.sum("held").over(before.orderBy("block")), F.lit(0)))
    within = F.coalesce(F.sum("n").over(before.partitionBy("block").orderBy("bucket")), F.lit(0))
    return sizes.withColumn("within", within).join(blocks.select("block", "upto"), "block").select("bucket", (F.col("upto") + F.col("within")).alias("base"))


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of `docs`, with `shard` (int) and `slot` (long, from 0 in each shard without gaps).

    Columns of these names in `docs` are replaced; other names can't clash. Null texts and null ids are rows like others;
    rows that repeat are all kept. An empty table gives no rows. The result depends on the rows alone, not on files or
    partitions (rows that are alike in every column are interchangeable), apart from the number of buckets, which
    follows the bytes of text and is at least the number of shuffle partitions."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # Spark has no hash of maps; their JSON has one.
    hashed = [F.to_json(F.struct(*columns))] if _has_map(docs.schema) else columns
    size = F.octet_length(text_or_empty()) + 1 if "text" in docs.columns else F.lit(1)
    keyed = docs.select(F.struct(*columns).alias("row"), F.xxhash64(F.lit(seed), *hashed).alias("hash"), F.xxhash64(F.lit(seed + 2), *hashed).alias("again"), size.cast("long").alias("size"))
    seen = cut(keyed.groupBy("hash", "again").agg(F.count("*").alias("n"), F.sum("size").alias("held")))
    held = seen.agg(F.sum("held")).first()[0] or 0
    buckets = max(least, -(-held // bucket_bytes))

    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed + 1), *parts), F.lit(buckets)).alias("bucket")

    hot = cut(seen.where((F.col("n") > 1) & (F.col("held") > held / buckets / 2)).select("hash", "again", "n"))
    many = hot.count()
    if many:
        marks = hot.groupBy("hash").agg(F.collect_set("again").alias("hot"))
        marked = attach(keyed, "hash", marks, many, F.col("again")).withColumn("hot", F.coalesce(F.array_contains("hot", F.col("again")), F.lit(False)))
        alike = marked.where("hot").groupBy("hash", "again").agg(F.any_value("row").alias("row"), F.count("*").alias("n"))
        each = alike.select("row", "hash", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select("row", "hash", bucket("hash", "k"))
        dealt = marked.where("not hot").select("row", "hash", bucket("hash")).unionAll(each)
        usual = seen.join(hot.select("hash", "again"), ["hash", "again"], "left_anti").select("n", bucket("hash"))
        sizes = usual.unionAll(hot.select("hash", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select(F.lit(1).cast("long").alias("n"), bucket("hash", "k")))
    else:
        dealt, sizes = keyed.select("row", "hash", bucket("hash")), seen.select("n", bucket("hash"))
    bases = _running(sizes.groupBy("bucket").agg(F.sum("n").alias("n")))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    names = pa.schema([(n, pa.null()) for n in schema.names])

    def work(rows: pa.Table) -> pa.Table:
        return _shuffle_bucket(rows, shards, seed, names)

    return dealt.join(bases, "bucket").groupBy("bucket").applyInArrow(work, schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """`docs` shuffled and written below `path`, a folder for each shard. Each task writes its buckets as they are, so a
    file holds a run of slots for each bucket, in order; read a shard in the order of `slot`."""
    shuffle(docs, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = shuffle(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op2_sharding": op2_sharding}
ORACLE_SQL: dict[str, str] = {}
