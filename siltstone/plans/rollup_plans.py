"""Roll-ups, joins and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.numbers import round_half_up, success_ratio
from siltstone.operators import history as H
from siltstone.operators import search as S
from siltstone.functions.urls import host_suffixes
from siltstone.sources.tables import read

TYPES = ["signup", "purchase", "view", "click", "error", "refund"]


def conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    return orders.agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.count_if(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("recent"), F.max("o_orderdate").cast("string").alias("newest")
    )


def group_count(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


def top_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve brands with the most distinct buyers."""
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("p_brand").agg(F.count_distinct("o_custkey").alias("holders")).orderBy(F.desc("holders"), "p_brand").limit(12)


def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("user_id"))).alias("buyers"))


def rounded_average(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(round_half_up(F.round(F.avg("c_acctbal"), 4)).alias("mean"))


def having(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count_if(F.col("o_orderstatus") == "F")
    return read(spark, sf, "orders").groupBy("o_custkey").agg(n.alias("n")).where(F.col("n") > 5)


def changes_per_key(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.lit("2024-01-30").cast("timestamp_ntz")
    events = read(spark, sf, "events").where(~F.col("event_type").isin("signup", "error") & (F.col("ts") > as_of - F.expr("interval 14 days")))
    return events.groupBy("user_id").agg(F.count("*").alias("n"))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return H.dense_histogram(read(spark, sf, "events"), "event_type", TYPES)


def sum_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    active = read(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey")
    counts = read(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return counts.join(active, F.col("o_custkey") == F.col("c_custkey"), "left_semi").agg(F.sum("n").alias("n"))


def tally(spark: SparkSession, sf: str) -> DataFrame:
    """Updated counts duplicates, too."""
    events = read(spark, sf, "events")
    is_a = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    day = F.to_date("ts").cast("string").alias("day")
    return events.groupBy(day).agg(F.count("*").alias("raw"), is_a("signup").alias("new"), is_a("view", "click").alias("updated"), is_a("click").alias("duplicate"), is_a("error").alias("errors"))


def collected(spark: SparkSession, sf: str) -> DataFrame:
    """The types of each user's events in the order of their first."""
    first = read(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", "event_type")))
    return first.groupBy("user_id").agg(F.array_join(F.transform(listed, lambda x: x["event_type"]), ",").alias("types"))


def first_flags(spark: SparkSession, sf: str) -> DataFrame:
    kinds = {"signup": "saved", "click": "dismissed", "purchase": "applied"}
    return read(spark, sf, "events").groupBy("user_id").agg(*[F.bool_or(F.col("event_type") == k).alias(v) for k, v in kinds.items()])


def ratios(spark: SparkSession, sf: str) -> DataFrame:
    good, bad = F.count_if(F.col("event_type") == "purchase"), F.count_if(F.col("event_type") == "error")
    return read(spark, sf, "events").groupBy("user_id").agg(good.alias("good"), bad.alias("bad")).select("user_id", success_ratio(F.col("good"), F.col("bad")).alias("percent"))


def any_match(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.bool_or(F.col("c_acctbal") > 9000).alias("any_rich"), F.max("c_acctbal").alias("most"))


def strata(spark: SparkSession, sf: str) -> DataFrame:
    """Eight rows of each stratum: a sampling operator, so its limit is the feature."""
    stratum = F.when(F.col("text").rlike("[0-9]"), "digits").when(F.col("text").rlike("[#$%&*]"), "symbols").otherwise("plain")
    return S.top_per_key(read(spark, sf, "documents").select("doc_id", stratum.alias("stratum")), ["stratum"], [F.asc("doc_id")], 8).select("stratum", "doc_id")


def sentence(spark: SparkSession, sf: str) -> DataFrame:
    counts = read(spark, sf, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["P", "O", "F"]).agg(F.count(F.lit(1)))
    part = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what}")))
    return counts.select("o_custkey", F.concat_ws(", ", part("P", "waiting"), part("O", "in progress"), part("F", "closed")).alias("sentence"))


def left_outer(spark: SparkSession, sf: str) -> DataFrame:
    people, orders = read(spark, sf, "customer"), read(spark, sf, "orders").where("o_totalprice > 300000")
    return people.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


def semi(spark: SparkSession, sf: str) -> DataFrame:
    big = read(spark, sf, "lineitem").where("l_quantity >= 49").select("l_orderkey")
    return read(spark, sf, "orders").join(big, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


def anti(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that never placed an order."""
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def ordered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in the order of the ids asked for; ids that aren't there are dropped."""
    asked = spark.createDataFrame(list(enumerate([17, 3, 999999999, 42, 5])), "place int, id long")
    return read(spark, sf, "customer").join(F.broadcast(asked), F.col("c_custkey") == F.col("id")).select("place", "c_custkey", "c_name")


def distinct_after_join(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that ordered, each once: a semi-join keeps the plan from multiplying rows first."""
    return read(spark, sf, "customer").join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def unseen(spark: SparkSession, sf: str) -> DataFrame:
    """What users have ever done and didn't do in the last days."""
    events = read(spark, sf, "events")
    known = events.select("user_id", "event_type").distinct()
    seen = events.where("ts >= timestamp_ntz '2024-01-24'").select("user_id", "event_type")
    return known.join(seen, ["user_id", "event_type"], "left_anti")


def theta(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier the customers of its nation with a larger balance, without pairing them: customers are counted by
    nation and step of balance, and one by one only within a supplier's own step."""
    sides = read(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.lit(None).cast("long").alias("s_suppkey"), F.lit(1).alias("one"))
    sides = sides.unionByName(read(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), "s_suppkey", F.lit(0).alias("one"))).withColumn("step", F.floor("balance"))
    steps = sides.groupBy("nation", "step").agg(F.sum("one").alias("held"))
    above = Window.partitionBy("nation").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("nation", "step", F.coalesce(F.sum("held").over(above), F.lit(0)).alias("above"))
    upto = F.sum("one").over(Window.partitionBy("nation", "step").orderBy(F.desc("balance")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    equal = F.sum("one").over(Window.partitionBy("nation", "step", "balance"))
    within = sides.withColumn("larger", upto - equal).where("s_suppkey is not null")
    return within.join(steps, ["nation", "step"]).select("s_suppkey", (F.col("larger") + F.col("above")).alias("n")).where("n > 0")


def domains(spark: SparkSession, sf: str) -> DataFrame:
    """A mail's domain belongs to the tenant that claims it or a domain above it; several tenants are an error."""
    nations = read(spark, sf, "nation")
    land = F.lower(F.replace("n_name", F.lit(" "), F.lit("-")))
    claims = nations.select(F.concat(land, F.lit(".example")).alias("claim"), F.concat(F.lit("region "), "n_regionkey").alias("tenant"))
    claims = claims.unionByName(nations.where("n_nationkey > 12").select(F.concat(F.lit("sub1."), land, F.lit(".example")).alias("claim"), F.lit("other").alias("tenant")))
    people = read(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    mails = people.select("s_suppkey", F.concat(F.lit("sub"), (F.col("s_suppkey") % 3).cast("string"), F.when(F.col("s_suppkey") % 7 == 0, "not").otherwise("."), land, F.lit(".example")).alias("domain"))
    above = mails.select("s_suppkey", F.explode(host_suffixes(F.col("domain"))).alias("claim"))
    hits = above.join(claims, "claim", "left").groupBy("s_suppkey").agg(F.count_distinct("tenant").alias("n"), F.min("tenant").alias("tenant"))
    return hits.select("s_suppkey", F.when(F.col("n") == 1, F.col("tenant")).alias("tenant"), (F.col("n") > 1).alias("ambiguous"))


def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    """All words that a conversation's user and assistant say: those that both do, either does, and only the user does."""
    words = F.array_distinct(F.split(F.coalesce("text", F.lit("")), " "))
    said = read(spark, sf, "conversations").select("conv_id", "role", F.explode(words).alias("word")).distinct()
    each = said.groupBy("conv_id", "word").agg(F.bool_or(F.col("role") == "user").alias("a"), F.bool_or(F.col("role") == "assistant").alias("b")).where("a or b")
    return each.groupBy("conv_id").agg(F.count_if(F.col("a") & F.col("b")).alias("common"), F.count("*").alias("either"), F.count_if(F.col("a") & ~F.col("b")).alias("missing"))


def set_ops_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The words of the first half of a whole text against those of its second half."""
    words, half = F.split(F.coalesce("text", F.lit("")), " "), F.floor(F.size("words") / 2).cast("int")
    held = read(spark, sf, "documents").select("doc_id", words.alias("words"))
    held = held.select("doc_id", F.array_distinct(F.slice("words", 1, half)).alias("a"), F.array_distinct(F.slice("words", half + 1, F.size("words") - half)).alias("b"))
    return held.select("doc_id", F.size(F.array_intersect("a", "b")).alias("common"), F.size(F.array_union("a", "b")).alias("either"), F.size(F.array_except("a", "b")).alias("missing"))


def by_precedence(spark: SparkSession, sf: str) -> DataFrame:
    """The first source that has a key gives its value."""
    events = read(spark, sf, "events")
    layers = events.where("event_type in ('purchase', 'view', 'click')").select("user_id", F.expr("case event_type when 'purchase' then 1 when 'view' then 2 else 3 end").alias("layer"), "event_id")
    return H.first(layers, ["user_id"], F.col("layer"), F.col("event_id"))


QUERIES = {
    "agg01_conditional_counts": conditional_counts,
    "agg02_group_count": group_count,
    "agg03_top_distinct": top_distinct,
    "agg04_count_distinct": distinct_counts,
    "agg05_rounded_average": rounded_average,
    "agg06_having": having,
    "agg07_changes_per_key": changes_per_key,
    "agg08_dense_histogram": histogram,
    "agg09_sum_of_counts": sum_of_counts,
    "agg10_run_tally": tally,
    "agg12_collect_in_order": collected,
    "agg13_first_flags": first_flags,
    "agg14_success_ratio": ratios,
    "agg15_any_match": any_match,
    "agg18_strata": strata,
    "agg19_sentence": sentence,
    "join02_left_outer": left_outer,
    "join03_distinct_after_join": distinct_after_join,
    "join04_semi": semi,
    "join05_anti": anti,
    "join06_unseen": unseen,
    "join08_theta": theta,
    "join10_ordered_lookup": ordered_lookup,
    "join17_domain_tenant": domains,
    "set01_set_operations": set_ops,
    "set01_whole_texts": set_ops_whole,
    "set04_union_by_precedence": by_precedence,
}
ORACLE_SQL = {
    "agg01_conditional_counts": "select count(*) as total, count(*) filter (o_orderstatus = 'O') as open, count(*) filter (o_orderdate >= timestamp '1997-01-01') as recent, max(o_orderdate)::varchar as newest from orders",
    "agg02_group_count": "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1",
    "agg03_top_distinct": "select p_brand, count(distinct o_custkey) as holders from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey group by 1 order by 2 desc, 1 limit 12",
    "agg04_count_distinct": "select count(distinct user_id) as users, count(distinct case when event_type = 'purchase' then user_id end) as buyers from events",
    "agg05_rounded_average": "select c_mktsegment, floor(round(avg(c_acctbal), 4) + 0.5)::bigint as mean from customer group by 1",
    "agg06_having": "select o_custkey, count(*) filter (o_orderstatus = 'F') as n from orders group by 1 having n > 5",
    "agg07_changes_per_key": "select user_id, count(*) as n from events where event_type not in ('signup', 'error') and ts > timestamp '2024-01-30' - interval 14 days group by 1",
    "agg08_dense_histogram": "select p::int as position, t as event_type, (select count(*) from events where event_type = t) as n from (select unnest(['signup', 'purchase', 'view', 'click', 'error', 'refund']) as t, unnest(range(6)) as p)",
    "agg09_sum_of_counts": "select count(*)::bigint as n from orders where o_orderstatus = 'O' and o_custkey in (select c_custkey from customer where c_acctbal > 0)",
    "agg10_run_tally": """select ts::date::varchar as day, count(*) as raw, count(*) filter (event_type = 'signup') as new, count(*) filter (event_type in ('view', 'click')) as updated,
      count(*) filter (event_type = 'click') as duplicate, count(*) filter (event_type = 'error') as errors from events group by 1""",
    "agg12_collect_in_order": "select user_id, string_agg(event_type, ',' order by t, i) as types from (select user_id, event_type, min(ts) as t, min_by(event_id, (ts, event_id)) as i from events group by 1, 2) group by 1",
    "agg13_first_flags": "select user_id, bool_or(event_type = 'signup') as saved, bool_or(event_type = 'click') as dismissed, bool_or(event_type = 'purchase') as applied from events group by 1",
    "agg14_success_ratio": """select user_id, case when g + b = 0 then -1 else floor(100.0::double * g / (g + b) + 0.5)::bigint end as percent
      from (select user_id, count(*) filter (event_type = 'purchase') as g, count(*) filter (event_type = 'error') as b from events group by 1)""",
    "agg15_any_match": "select c_nationkey, bool_or(c_acctbal > 9000) as any_rich, max(c_acctbal) as most from customer group by 1",
    "agg18_strata": """select stratum, doc_id from (select *, row_number() over (partition by stratum order by doc_id) as n from (
      select doc_id, case when regexp_matches(text, '[0-9]') then 'digits' when regexp_matches(text, '[#$%&*]') then 'symbols' else 'plain' end as stratum from documents)) where n <= 8""",
    "agg19_sentence": """select o_custkey, concat_ws(', ', case when p > 0 then p || ' waiting' end, case when o > 0 then o || ' in progress' end, case when f > 0 then f || ' closed' end) as sentence
      from (select o_custkey, count(*) filter (o_orderstatus = 'P') as p, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'F') as f from orders group by 1)""",
    "join02_left_outer": "select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000 group by 1",
    "join03_distinct_after_join": "select c_mktsegment, count(distinct c_custkey) as n from customer join orders on c_custkey = o_custkey group by 1",
    "join04_semi": "select o_orderkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)",
    "join05_anti": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)",
    "join06_unseen": "select distinct user_id, event_type from events where (user_id, event_type) not in (select (user_id, event_type) from events where ts >= timestamp '2024-01-24')",
    "join08_theta": "select s_suppkey, count(*) as n from supplier join customer on s_nationkey = c_nationkey and s_acctbal < c_acctbal group by 1",
    "join10_ordered_lookup": "select place::int as place, c_custkey, c_name from customer join (values (0, 17), (1, 3), (2, 999999999), (3, 42), (4, 5)) as v(place, id) on c_custkey = id",
    "join17_domain_tenant": """with l as (select *, lower(replace(n_name, ' ', '-')) as land from nation), c as (select land || '.example' as claim, 'region ' || n_regionkey as tenant from l union all select 'sub1.' || land || '.example', 'other' from l where n_nationkey > 12),
      m as (select s_suppkey, 'sub' || (s_suppkey % 3) || case when s_suppkey % 7 = 0 then 'not' else '.' end || land || '.example' as d from supplier join l on s_nationkey = n_nationkey)
      select s_suppkey, case when count(distinct tenant) = 1 then min(tenant) end as tenant, count(distinct tenant) > 1 as ambiguous from m left join c on d = claim or ends_with(d, '.' || claim) group by 1""",
    "set01_set_operations": """with w as (select conv_id, list_distinct(flatten(list(string_split(coalesce(text, ''), ' ')) filter (role = 'user'))) as a, list_distinct(flatten(list(string_split(coalesce(text, ''), ' ')) filter (role = 'assistant'))) as b from conversations where role <> 'system' group by 1),
      n as (select conv_id, coalesce(a, []) as a, coalesce(b, []) as b from w) select conv_id, len(list_intersect(a, b))::bigint as common, len(list_distinct(a || b))::bigint as either, (len(a) - len(list_intersect(a, b)))::bigint as missing from n""",
    "set01_whole_texts": """select doc_id, len(list_intersect(a, b))::int as common, len(list_distinct(a || b))::int as either, (len(a) - len(list_intersect(a, b)))::int as missing
      from (select doc_id, list_distinct(w[1:len(w) // 2]) as a, list_distinct(w[len(w) // 2 + 1:len(w)]) as b from (select doc_id, string_split(coalesce(text, ''), ' ') as w from documents))""",
    "set04_union_by_precedence": """select user_id, layer::int as layer, event_id from (select *, row_number() over (partition by user_id order by layer, event_id) as n
      from (select user_id, event_id, case event_type when 'purchase' then 1 when 'view' then 2 else 3 end as layer from events where event_type in ('purchase', 'view', 'click'))) where n = 1""",
}
