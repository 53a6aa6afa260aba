"""Queues and limiters by key, over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import read
from siltstone.streaming import stateful as S

#: What an event is to a user's request; any other kind asks for one.
KINDS = {"click": "claim", "purchase": "done", "error": "failed"}
#: A run that has lasted so many hours has stopped.
STALLED = 12


def queue(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of the users' requests."""
    kind = F.col("event_type")
    for event, meaning in KINDS.items():
        kind = F.when(F.col("event_type") == event, meaning).otherwise(kind)
    rows = read(spark, sf, "events").select("user_id", "ts", "event_id", kind.alias("kind"))
    made = S.stepped(rows, "user_id", "ts", "event_id", "kind", S.WorkQueue(stalled=STALLED * 3600))
    return made.select("user_id", F.unix_micros("at").alias("micros"), "status", "attempts", "reason")


def depth(spark: SparkSession, sf: str) -> DataFrame:
    """How many users' requests wait, run, have ended or have failed, at last."""
    last = queue(spark, sf).groupBy("user_id").agg(F.max_by(F.struct("status", "attempts"), F.struct("micros", F.when(F.col("status") == "PENDING", 0).otherwise(1))).alias("x"))
    return last.groupBy("x.status").agg(F.count("*").alias("n"))


QUERIES = {"strs6_work_queue": queue, "strs6_queue_depth": depth}
_WIDTH = STALLED * 3_600_000_000
_QUEUE = f"""with recursive ev as (
    select user_id, epoch_us(ts) as tm, row_number() over (partition by user_id order by ts, event_id) as n, case event_type when 'click' then 'claim' when 'purchase' then 'done' when 'error' then 'failed' else event_type end as kind from events),
  q as (
    select distinct user_id, 0::bigint as n, null::bigint as tm, null::varchar as kind, null::varchar as status, 0 as tries, null::varchar as reason, null::bigint as since, null::varchar as fell, 0 as fell_tries, null::varchar as fell_reason, null::bigint as fell_at, false as changed from events
    union all
    select user_id, n, tm, kind,
      case when kind = 'claim' then case when mid = 'PENDING' then 'RUNNING' else mid end
        when kind = 'done' then case when mid = 'RUNNING' then 'COMPLETED' else mid end
        when kind = 'failed' then case when mid = 'RUNNING' then case when tries < 3 then 'PENDING' else 'FAILED' end else mid end
        when mid = 'RUNNING' then mid else 'PENDING' end,
      case when kind = 'claim' and mid = 'PENDING' then tries + 1 when kind not in ('claim', 'done', 'failed') and coalesce(mid, '') <> 'RUNNING' then 0 else tries end,
      case when kind not in ('claim', 'done', 'failed') and coalesce(mid, '') <> 'RUNNING' then kind else reason end,
      case when kind = 'claim' and mid = 'PENDING' then tm else since end,
      case when ended then mid end, tries, reason, since + {_WIDTH},
      coalesce(case when kind = 'claim' then mid = 'PENDING' when kind in ('done', 'failed') then mid = 'RUNNING' else coalesce(mid, '') <> 'RUNNING' end, false)
    from (select e.user_id, e.n, e.tm, e.kind, q.tries, q.reason, q.since, coalesce(q.status = 'RUNNING' and q.since + {_WIDTH} <= e.tm, false) as ended,
        case when coalesce(q.status = 'RUNNING' and q.since + {_WIDTH} <= e.tm, false) then case when q.tries < 3 then 'PENDING' else 'FAILED' end else q.status end as mid
      from q join ev e on e.user_id = q.user_id and e.n = q.n + 1)),
  last as (select * from (select *, row_number() over (partition by user_id order by n desc) as back from q) where back = 1 and status = 'RUNNING'),
  made as (
    select user_id, tm as micros, status, tries::int as attempts, reason from q where changed
    union all select user_id, fell_at, fell, fell_tries::int, fell_reason from q where fell is not null
    union all select user_id, since + {_WIDTH}, case when tries < 3 then 'PENDING' else 'FAILED' end, tries::int, reason from last)
  """
ORACLE_SQL = {
    "strs6_work_queue": _QUEUE + "select user_id, micros, status, attempts, reason from made",
    "strs6_queue_depth": _QUEUE
    + "select status, count(*) as n from (select user_id, status, row_number() over (partition by user_id order by micros desc, (status <> 'PENDING') desc) as back from made) where back = 1 group by status",
}
