"""Histories, events and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import changes as C
from siltstone.operators import history as H
from siltstone.sources.tables import read
from siltstone.streaming import admission as A


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return H.latest(read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return H.first(read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


def newest_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """The 48 newest events, of these the newest of each user, of these 8: a report's limits, in this order."""
    newest = read(spark, sf, "events").select("user_id", "ts", "event_id").orderBy(F.desc("ts"), F.desc("event_id")).limit(48)
    return H.latest(newest, ["user_id"], F.col("ts"), F.col("event_id")).orderBy(F.desc("ts"), F.desc("event_id")).limit(8).select("user_id", "event_id")


def superseded(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    return H.superseded(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey", "place")


def failure_streaks(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").where("event_type <> 'view'").select("user_id", "ts", "event_id", "event_type")
    found = H.streaks(events, ["user_id"], [F.asc("ts"), F.asc("event_id")], F.col("event_type") == "error")
    state = F.when(F.col("streak") >= 8, "PENDING_REVIEW").when(F.col("streak") >= 3, "DEGRADED").otherwise("ACTIVE")
    return found.select("event_id", F.col("streak").cast("long").alias("streak"), state.alias("state"))


def state_transitions(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return H.transitions(events, ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_type").select("event_id", "from_state", "to_state")


def total_order(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_name", "p_partkey"))
    return read(spark, sf, "part").select("p_partkey", place.alias("place"))


def monotone_times(spark: SparkSession, sf: str) -> DataFrame:
    """Each time at least a microsecond after the one before: the running maximum of time less place, plus place."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = read(spark, sf, "events").select("user_id", "event_id", F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")).alias("t")).withColumn("k", F.row_number().over(w))
    return rows.select("event_id", (F.max(F.col("t") - F.col("k")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k")).alias("micros"))


def repeated_in_file(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose key an accepted row before them has."""
    place = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return read(spark, sf, "events").where("value > 5").select("event_id", place.alias("n")).where("n > 1").select("event_id")


def sliding_admission(spark: SparkSession, sf: str) -> DataFrame:
    return A.sliding_window(read(spark, sf, "events"), "user_id", "ts", "event_id", 3, 86_400)


def minimum_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return A.spacing(read(spark, sf, "events"), "user_id", "ts", "event_id", 7_200, 10_800)


def idempotent_publish(spark: SparkSession, sf: str) -> DataFrame:
    return A.idempotent(read(spark, sf, "events").select("user_id", "event_type"), ["user_id", "event_type"], "ts", "1 hour")


def tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    return A.tumbling(read(spark, sf, "events"), "ts", "6 hours", "1 hour", "event_type").select(F.col("start").cast("string").alias("start"), "event_type", "n")


def _old(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), F.lower("o_orderpriority").alias("o_orderpriority"))


def _new(spark: SparkSession, sf: str) -> DataFrame:
    """A later sighting, by rule: every third order, with another price, status or spelling."""
    status = F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus"))
    price = F.when(F.col("o_orderkey") % 6 == 0, F.lit(None)).when(F.col("o_orderkey") % 15 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return _old(spark, sf).where("o_orderkey % 3 = 0").select("o_orderkey", "o_custkey", status.alias("o_orderstatus"), price.alias("o_totalprice"), F.upper("o_orderpriority").alias("o_orderpriority"))


def upserted(spark: SparkSession, sf: str) -> DataFrame:
    return C.upsert(_old(spark, sf).where("o_orderkey % 2 = 0"), _new(spark, sf), ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


def gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    owner = F.col("old.o_custkey") % 2 == 0
    return C.fill_gaps(_old(spark, sf), _new(spark, sf), ["o_orderkey"], ["o_orderstatus", "o_totalprice"], owner).select("o_orderkey", "o_orderstatus", "o_totalprice")


def detected_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A missing price is no change; spelling alone is none."""
    tests = {"o_orderstatus": None, "o_totalprice": F.col("new.o_totalprice") != F.col("old.o_totalprice"), "o_orderpriority": F.lower("new.o_orderpriority") != F.lower("old.o_orderpriority")}
    found = C.field_changes(_old(spark, sf), _new(spark, sf), ["o_orderkey"], tests)
    return found.groupBy("field").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


def close_vanished(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return C.vanished(orders, orders.where("o_orderkey % 5 = 0"), ["o_orderkey"], "o_custkey")


def stale(spark: SparkSession, sf: str) -> DataFrame:
    """Open rows last seen over 45 days before the given instant, the oldest 200 in a run."""
    as_of = F.lit("1998-12-01").cast("timestamp_ntz")
    return read(spark, sf, "orders").where((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < as_of - F.expr("interval 45 days"))).orderBy("o_orderdate", "o_orderkey").limit(200).select("o_orderkey")


def state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that the machine forbids."""
    edges = [("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "view"), ("purchase", "view"), ("click", "view")]
    return C.illegal(state_transitions(spark, sf).where("from_state is not null"), edges, ["from_state", "to_state"]).groupBy("from_state", "to_state").agg(F.count("*").alias("n"))


def retention(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of old, unheld rows go; the rows stay."""
    held = read(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")
    orders = read(spark, sf, "orders").join(held.withColumn("held", F.lit(True)), F.col("o_custkey") == F.col("c_custkey"), "left")
    old = (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("held").isNull()
    return orders.select("o_orderkey", F.when(~old, F.col("o_orderpriority")).alias("o_orderpriority"))


def guarded_rename(spark: SparkSession, sf: str) -> DataFrame:
    """Keys move where the new one is free."""
    keys = read(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") + F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(100_000)).alias("wanted"))
    taken = keys.select(F.col("s_suppkey").alias("wanted")).withColumn("taken", F.lit(True))
    return keys.join(taken, "wanted", "left").select("s_suppkey", F.when(F.col("taken").isNull(), F.col("wanted")).otherwise(F.col("s_suppkey")).alias("new_key"))


def ordered_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Insertions, removals and moves between the orders in which a user first did things before and after a day."""
    events = read(spark, sf, "events")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")

    def order(rows: DataFrame, name: str) -> DataFrame:
        first = rows.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("first"))
        return first.select("user_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).alias(name))

    both = order(events.where(F.col("ts") < cut), "was").join(order(events.where(F.col("ts") >= cut), "now"), ["user_id", "event_type"], "full_outer")
    kind = F.when(F.col("was").isNull(), "inserted").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "moved")
    return both.select("user_id", "event_type", kind.alias("kind")).where("kind is not null")


QUERIES = {
    "win01_latest_per_key": latest_per_key,
    "win02_first_per_key": first_per_key,
    "win03_newest_distinct": newest_distinct,
    "win04_keep_newest": superseded,
    "win05_failure_streaks": failure_streaks,
    "win06_transitions": state_transitions,
    "win07_total_order": total_order,
    "win08_sliding_admission": sliding_admission,
    "win09_monotone_times": monotone_times,
    "win11_repeated_in_file": repeated_in_file,
    "strs4_idempotent_publish": idempotent_publish,
    "strs8_minimum_spacing": minimum_spacing,
    "ext_tumbling_counts": tumbling_counts,
    "snk01_upsert": upserted,
    "ent03_fill_gaps": gap_fill,
    "chg01_changes": detected_changes,
    "chg03_ordered_diff": ordered_diff,
    "ent05_close_vanished": close_vanished,
    "ent07_stale": stale,
    "stm01_illegal_steps": state_machine,
    "gov02_retention": retention,
    "dml03_guarded_rename": guarded_rename,
}
_STEPS = "select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as from_state, event_type as to_state from events"
#: Events of a user in order; what depends on the ones admitted before follows them one by one.
_TIMED = "with recursive ev as (select user_id, event_id, epoch_us(ts) as tm, row_number() over (partition by user_id order by ts, event_id) as n from events), "
_OLD = "select o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) as o_totalprice, lower(o_orderpriority) as o_orderpriority from orders"
_NEW = f"""select o_orderkey, o_custkey, case when o_orderkey % 9 = 0 then 'X' else o_orderstatus end as o_orderstatus,
  case when o_orderkey % 6 = 0 then null when o_orderkey % 15 = 0 then o_totalprice + 1 else o_totalprice end as o_totalprice, upper(o_orderpriority) as o_orderpriority from ({_OLD}) where o_orderkey % 3 = 0"""
ORACLE_SQL = {
    "win01_latest_per_key": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1",
    "win02_first_per_key": "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1",
    "win03_newest_distinct": """select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n
      from (select * from events order by ts desc, event_id desc limit 48)) where n = 1 order by ts desc, event_id desc limit 8""",
    "win04_keep_newest": "select o_custkey, o_orderkey, place::int as place from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as place from orders where o_orderstatus <> 'P') where place > 3",
    "win05_failure_streaks": """select event_id, streak, case when streak >= 8 then 'PENDING_REVIEW' when streak >= 3 then 'DEGRADED' else 'ACTIVE' end as state from (
      select event_id, sum((event_type = 'error')::int) over (partition by user_id, run order by ts, event_id)::bigint as streak from (
      select *, sum((event_type <> 'error')::int) over (partition by user_id order by ts, event_id) as run from events where event_type <> 'view'))""",
    "win06_transitions": f"select * from ({_STEPS}) where from_state is null or from_state <> to_state",
    "win07_total_order": "select p_partkey, row_number() over (partition by p_brand order by p_retailprice desc, p_name, p_partkey)::int as place from part",
    "win09_monotone_times": """select event_id, max(t - k) over (partition by user_id order by event_id) + k as micros from (
      select user_id, event_id, epoch_us(date_trunc('hour', ts)) as t, row_number() over (partition by user_id order by event_id) as k from events)""",
    "win11_repeated_in_file": "select event_id from (select event_id, row_number() over (partition by user_id, event_type order by event_id) as n from events where value > 5) where n > 1",
    "win08_sliding_admission": _TIMED + f"""q as (select distinct user_id, 0::bigint as n, null::bigint as event_id, []::bigint[] as taken, null::boolean as accepted from events
      union all select user_id, n, event_id, case when len(held) < 3 then list_append(held, tm) else held end, len(held) < 3
      from (select e.user_id, e.n, e.event_id, e.tm, list_filter(q.taken, lambda t: t > e.tm - 86400000000) as held from q join ev e on e.user_id = q.user_id and e.n = q.n + 1))
      select user_id, event_id, accepted from q where n > 0""",
    "strs8_minimum_spacing": _TIMED + """q as (select distinct user_id, 0::bigint as n, null::bigint as event_id, 0::bigint as free, null::double as wait from events
      union all select user_id, n, event_id, case when late <= 10800000000 then tm + late + 7200000000 else free end, case when late <= 10800000000 then late / 1e6 end
      from (select e.user_id, e.n, e.event_id, e.tm, q.free, greatest(0, q.free - e.tm) as late from q join ev e on e.user_id = q.user_id and e.n = q.n + 1))
      select user_id, event_id, wait from q where n > 0""",
    "strs4_idempotent_publish": "select distinct user_id, event_type from events",
    "ext_tumbling_counts": "select time_bucket(interval 6 hours, ts, timestamp '2024-01-01')::varchar as start, event_type, count(*) as n from events group by 1, 2",
    "snk01_upsert": f"""with o as ({_OLD}), n as ({_NEW}) select o_orderkey, o_orderstatus, o_totalprice from n
      union all select o_orderkey, o_orderstatus, o_totalprice from o where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0""",
    "ent03_fill_gaps": f"""with o as ({_OLD}), n as ({_NEW}) select o.o_orderkey,
      case when o.o_custkey % 2 = 0 then coalesce(n.o_orderstatus, o.o_orderstatus) else coalesce(o.o_orderstatus, n.o_orderstatus) end as o_orderstatus,
      case when o.o_custkey % 2 = 0 then coalesce(n.o_totalprice, o.o_totalprice) else coalesce(o.o_totalprice, n.o_totalprice) end as o_totalprice from o left join n on o.o_orderkey = n.o_orderkey""",
    "chg01_changes": f"""with o as ({_OLD}), n as ({_NEW}), b as (select o.o_orderkey as k, o.o_orderstatus as s, n.o_orderstatus as t, o.o_totalprice as p, n.o_totalprice as q from o join n on o.o_orderkey = n.o_orderkey)
      select field, count(*) as n, min(k) as first_key, max(k) as last_key from (select k, 'o_orderstatus' as field from b where s <> t union all select k, 'o_totalprice' from b where p <> q) group by 1""",
    "chg03_ordered_diff": """with f as (select user_id, event_type, ts >= timestamp '2024-01-16' as late, min((ts, event_id)) as first from events group by 1, 2, 3), r as (select *, row_number() over (partition by user_id, late order by first) as n from f),
      b as (select user_id, event_type, max(n) filter (not late) as was, max(n) filter (late) as now from r group by 1, 2) select user_id, event_type, case when was is null then 'inserted' when now is null then 'removed' else 'moved' end as kind from b where was is distinct from now""",
    "ent05_close_vanished": "select o_custkey, count(*) filter (o_orderkey % 5 = 0) as n_left, n_left = 0 as closed from orders group by 1",
    "ent07_stale": "select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate < timestamp '1998-12-01' - interval 45 days order by o_orderdate, o_orderkey limit 200",
    "stm01_illegal_steps": f"""select from_state, to_state, count(*) as n from ({_STEPS}) where from_state is not null and from_state <> to_state
      and (from_state, to_state) not in (('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('view', 'view'), ('purchase', 'view'), ('click', 'view')) group by 1, 2""",
    "gov02_retention": """select o_orderkey, case when o_orderdate < timestamp '1996-01-01' and o_custkey not in (select c_custkey from customer where c_acctbal < 0) then null else o_orderpriority end as o_orderpriority from orders""",
    "dml03_guarded_rename": """select s_suppkey, case when w in (select s_suppkey from supplier) then s_suppkey else w end as new_key
      from (select s_suppkey, s_suppkey + case when s_suppkey % 2 = 0 then 1 else 100000 end as w from supplier)""",
}
