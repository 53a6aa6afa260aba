"""Search, filters, orders, limits and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import search as S
from siltstone.sources.tables import read

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT_SPECIFIED", "5-LOW"]


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    return part.withColumn("document", F.concat_ws(" ", "p_name", "p_brand", "p_type"))


def job_search(spark: SparkSession, sf: str) -> DataFrame:
    every, score = S.relevance("red bolt", "p_name", "document")
    found = _titled(spark, sf).where(every & (F.col("p_size") <= 40)).withColumn("score", score.cast("long"))
    rows = S.page(found, [F.desc("score"), F.length("p_name"), F.desc("p_retailprice"), F.asc("p_partkey")], 0, 20)
    return rows.select("p_partkey", "p_name", "score", "p_retailprice")


def faceted(spark: SparkSession, sf: str) -> DataFrame:
    facets = [F.col("o_orderstatus").isin("O", "F"), S.at_most_or_unset("o_totalprice", 200000.0), F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"), S.optional_in("o_custkey", None)]
    return read(spark, sf, "orders").where(S.all_of(facets)).select("o_orderkey", "o_orderstatus", "o_totalprice")


def contains_any(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part").where(S.any_contains(["p_name", "p_type"], "RED")).select("p_partkey", "p_name")


def escaped_like(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").where(S.any_like(["c_name"], "r#0000000_1") | S.any_like(["c_name"], "00012")).select("c_custkey", "c_name")


def lenient_enum(spark: SparkSession, sf: str) -> DataFrame:
    test = S.one_of("o_orderstatus", [" o ", "f", "nonsense"], ["O", "F", "P"])
    return read(spark, sf, "orders").where(S.all_of([test])).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def recency(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by their day or, for those that are open and so have none yet, by the day of their first shipment."""
    shipped = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_shipped"))
    orders = read(spark, sf, "orders").withColumn("posted", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate"))).join(shipped, "o_orderkey", "left")
    cutoff = F.lit("1997-06-01").cast("timestamp_ntz")
    return orders.where(S.since("posted", "first_shipped", cutoff)).select("o_orderkey")


def fail_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in a segment that their nation is granted; a nation that is granted none sees none."""
    people = read(spark, sf, "customer")
    granted = people.where("c_acctbal > 9900").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("granted"))
    rows = people.join(granted, "c_nationkey", "left").withColumn("granted", F.coalesce("granted", F.array().cast("array<string>")))
    return rows.where(F.array_contains("granted", F.col("c_mktsegment"))).select("c_custkey")


def scoped(spark: SparkSession, sf: str) -> DataFrame:
    """Row-level scope: institution and (wide, or a granted department and no batch grant or a granted batch)."""
    grants = spark.createDataFrame([(1, 2, "BUILDING"), (1, 3, None), (2, 8, "MACHINERY")], "region int, nation int, segment string")
    wide = F.col("n_regionkey") == 3
    people = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    match = (F.col("n_regionkey") == F.col("region")) & (F.col("c_nationkey") == F.col("nation")) & (F.col("segment").isNull() | (F.col("c_mktsegment") == F.col("segment")))
    granted = people.join(F.broadcast(grants), match, "left_semi")
    return people.where(wide).select("c_custkey", "c_nationkey").unionByName(granted.where(~wide).select("c_custkey", "c_nationkey"))


def cross_scale(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem")
    return lines.where(F.col("l_discount") * 10 * F.lit(100) >= F.lit(100) * F.lit(0.7)).groupBy("l_returnflag").agg(F.count("*").alias("n"))


def all_skills(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who bought parts of every asked type: one aggregate rather than a join for each."""
    asked = ["Brand#11", "Brand#12", "Brand#13"]
    # Lines meet the few asked parts first, so that only theirs are shuffled to their orders.
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "part").where(F.col("p_brand").isin(asked)), F.col("l_partkey") == F.col("p_partkey"))
    bought = lines.select("l_orderkey", "p_brand").join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    held = bought.groupBy("o_custkey").agg(F.count_distinct("p_brand").alias("n"))
    return held.where(F.col("n") == len(asked)).select("o_custkey")


def named_sorts(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    newest = S.page(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 1, 25)
    dearest = S.page(orders, [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], 0, 25)
    return newest.select(F.lit("newest").alias("sort"), "o_orderkey").unionAll(dearest.select(F.lit("price"), "o_orderkey"))


def paging(spark: SparkSession, sf: str) -> DataFrame:
    """A page and, beside it, how many rows and pages there are: scalar subqueries, found when the page is."""
    suppliers = read(spark, sf, "supplier")
    sizes = S.pages_of(suppliers, 7)
    return S.page(suppliers, [F.asc("s_suppkey")], -3, 7).select("s_suppkey", sizes.select("total").scalar().alias("total"), sizes.select("pages").scalar().alias("pages"))


def correlated_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the sum of their orders; those without one rank as -1."""
    spent = read(spark, sf, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    people = read(spark, sf, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    return people.select("c_custkey", F.coalesce("spent", F.lit(-1.0)).alias("rank_value")).orderBy(F.desc("rank_value"), "c_custkey").limit(50)


def capped_resort(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best, those that qualify of these, juniors first, then at most 10."""
    best = read(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(50)
    kept = best.where(F.col("c_mktsegment") != "BUILDING").withColumn("later", (F.col("c_nationkey") >= 10).cast("int"))
    return kept.orderBy("later", F.desc("c_acctbal"), "c_custkey").limit(10).select("c_custkey", "c_acctbal")


def capped_per_key(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    return S.top_per_key(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 8).select("o_orderpriority", "place", "o_orderkey")


def bucketed_sort(spark: SparkSession, sf: str) -> DataFrame:
    bucket = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return read(spark, sf, "orders").withColumn("bucket", bucket).orderBy("bucket", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "bucket")


def activity_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Unlike events as one feed, latest first."""
    orders = read(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    events = read(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at"))
    return orders.unionByName(events).orderBy(F.desc_nulls_last("at"), "kind", "id").limit(40).select("kind", "id")


QUERIES = {
    "sco16_job_search": job_search,
    "flt01_faceted_filter": faceted,
    "flt03_contains_any": contains_any,
    "flt04_escaped_like": escaped_like,
    "flt05_lenient_enum": lenient_enum,
    "flt07_recency_fallback": recency,
    "flt08_fail_closed": fail_closed,
    "flt10_scope": scoped,
    "flt11_cross_scale": cross_scale,
    "flt12_all_skills": all_skills,
    "srt02_named_sorts": named_sorts,
    "lim01_page": paging,
    "srt04_correlated_sort": correlated_sort,
    "srt06_capped_resort": capped_resort,
    "lim02_capped_per_key": capped_per_key,
    "srt08_bucketed_sort": bucketed_sort,
    "srt07_activity_feed": activity_feed,
}
ORACLE_SQL = {
    "sco16_job_search": """
    select p_partkey, p_name, score, p_retailprice from (
      select *, (case when lower(p_name) = 'red bolt' then 1000 else 0 end + case when starts_with(lower(p_name), 'red bolt') then 400 else 0 end
        + case when contains(lower(p_name), 'red bolt') then 250 else 0 end
        + case when contains(lower(p_name), 'red') then 60 else 0 end + case when contains(doc, 'red') then 5 else 0 end
        + case when contains(lower(p_name), 'bolt') then 60 else 0 end + case when contains(doc, 'bolt') then 5 else 0 end)::bigint as score
      from (select *, lower(p_name || ' ' || p_brand || ' ' || p_type) as doc from part) where contains(doc, 'red') and contains(doc, 'bolt') and p_size <= 40)
    order by score desc, length(p_name), p_retailprice desc, p_partkey limit 20""",
    "flt01_faceted_filter": "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderstatus in ('O', 'F') and o_totalprice <= 200000 and o_orderdate >= timestamp '1996-01-01'",
    "flt03_contains_any": "select p_partkey, p_name from part where contains(lower(p_name), 'red') or contains(lower(p_type), 'red')",
    "flt04_escaped_like": "select c_custkey, c_name from customer where contains(lower(c_name), 'r#0000000_1') or contains(c_name, '00012')",
    "flt05_lenient_enum": "select o_orderstatus, count(*) as n from orders where o_orderstatus in ('O', 'F') group by 1",
    "flt07_recency_fallback": "select o_orderkey from orders left join (select l_orderkey, min(l_shipdate) as s from lineitem group by 1) on l_orderkey = o_orderkey where coalesce(case when o_orderstatus <> 'O' then o_orderdate end, s) > timestamp '1997-06-01'",
    "flt08_fail_closed": "select c_custkey from customer a where exists (select 1 from customer b where b.c_acctbal > 9900 and b.c_nationkey = a.c_nationkey and b.c_mktsegment = a.c_mktsegment)",
    "flt10_scope": """select c_custkey, c_nationkey from customer join nation on c_nationkey = n_nationkey
      where n_regionkey = 3 or (n_regionkey = 1 and c_nationkey = 2 and c_mktsegment = 'BUILDING') or (n_regionkey = 1 and c_nationkey = 3)
      or (n_regionkey = 2 and c_nationkey = 8 and c_mktsegment = 'MACHINERY')""",
    "flt11_cross_scale": "select l_returnflag, count(*) as n from lineitem where l_discount * 10 * 100 >= 100 * 0.7::double group by 1",
    "flt12_all_skills": """select o_custkey from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey
      where p_brand in ('Brand#11', 'Brand#12', 'Brand#13') group by 1 having count(distinct p_brand) = 3""",
    "srt02_named_sorts": """(select 'newest' as sort, o_orderkey from orders order by o_orderdate desc, o_orderkey limit 25 offset 25)
      union all (select 'price', o_orderkey from orders order by o_totalprice desc nulls last, o_orderkey limit 25)""",
    "lim01_page": "select s_suppkey, (select count(*) from supplier)::bigint as total, ceil((select count(*) from supplier) / 7)::bigint as pages from supplier order by 1 limit 7",
    "srt04_correlated_sort": """select c_custkey, coalesce((select round(sum(o_totalprice), 2) from orders where o_custkey = c_custkey), -1) as rank_value
      from customer order by 2 desc, 1 limit 50""",
    "srt06_capped_resort": """select c_custkey, c_acctbal from (select * from customer order by c_acctbal desc, c_custkey limit 50)
      where c_mktsegment <> 'BUILDING' order by (c_nationkey >= 10), c_acctbal desc, c_custkey limit 10""",
    "lim02_capped_per_key": """select o_orderpriority, place, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey)::int as place from orders) where place <= 8""",
    "srt08_bucketed_sort": """select o_orderkey, case o_orderstatus when 'P' then 0 when 'O' then 1 else 2 end as bucket from orders order by 2, o_orderdate desc, 1 limit 100""",
    "srt07_activity_feed": """select kind, id from (select 'order' as kind, o_orderkey as id, o_orderdate as moment from orders union all select 'event', event_id, ts from events)
      order by moment desc nulls last, kind, id limit 40""",
}
