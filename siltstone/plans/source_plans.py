"""Configured sources and their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import resolve, robots
from siltstone.sources import adapters
from siltstone.sources.tables import breaches, read

#: What a page of these sources holds, and the ceiling of every second one.
SIZE, MOST = 3, 20


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source for each nation; a few name no adapter, or another."""
    k = F.col("n_nationkey")
    adapter = F.when(k % 4 == 0, "oracle-hcm").when(k % 11 == 5, "lever")
    base = F.when(k % 4 == 1, " https://Fa-x.OracleCloud.com// ").when(k % 4 == 2, "https://jobs.fa.ocs.oraclecloud.com").otherwise(F.concat(F.lit("https://hcm."), k.cast("string"), F.lit(".example/")))
    return read(spark, sf, "nation").select(F.col("n_name").alias("source"), adapter.alias("adapter"), base.alias("base_url"), F.concat(F.lit("CX_"), k).alias("token"), F.when(k % 2 == 0, F.lit(MOST)).alias("most"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """The orders of a month and nation are a page. One without lists can't be read; some have two lists."""
    rows = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    page = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    item = F.struct(
        F.when(F.col("o_orderkey") % 7 != 3, F.col("o_orderkey")).alias("Id"), F.col("o_orderpriority").alias("Title"), F.col("o_orderstatus").alias("JobType"), F.col("c_mktsegment").alias("PrimaryLocation"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("PostedDate"),
    )
    held = rows.groupBy(F.col("n_name").alias("source"), "n_nationkey", page.cast("int").alias("page")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("items"))
    items = F.transform("items", lambda x: x["item"])
    half = F.floor(F.size(items) / 2).cast("int")
    two = F.array(F.struct(F.slice(items, F.lit(1), half).alias("requisitionList")), F.struct(F.slice(items, half + 1, F.size(items)).alias("requisitionList")))
    one = F.array(F.struct(items.alias("requisitionList")))
    body = F.when((F.col("n_nationkey") % 9 == 4) & (F.col("page") == 2), F.to_json(F.struct(F.array(F.struct(F.size(items).alias("total"))).alias("items"))))
    body = body.when(F.col("page") % 2 == 0, F.to_json(F.struct(two.alias("items")))).otherwise(F.to_json(F.struct(one.alias("items"))))
    return held.select("source", "page", body.alias("body"))


def oracle_hcm(spark: SparkSession, sf: str) -> DataFrame:
    found = adapters.fetched(_sources(spark, sf), _pages(spark, sf), "oracle-hcm", SIZE)
    return found.select("source", "external_id", "title", "company_name", "location_text", "employment_type_text", "apply_url", F.unix_seconds("posted_at").alias("posted_at"))


def source_health(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.health(_sources(spark, sf), _pages(spark, sf), "oracle-hcm", SIZE)


def source_probes(spark: SparkSession, sf: str) -> DataFrame:
    """What would be asked of suppliers' sites, by where they say that they are."""
    boards = ["https://boards.greenhouse.io/x", "HTTPS://JOBS.LEVER.CO/x", "https://jobs.ashbyhq.com/x", "https://careers.smartrecruiters.com/x", "https://apply.workable.com/x", "https://x.breezy.hr", "https://eu.oraclecloud.com/", "https://nowhere.example", None]
    k = F.col("s_suppkey")
    base = F.element_at(F.array(*map(F.lit, boards)), (F.pmod(k, F.lit(len(boards))) + 1).cast("int"))
    sources = read(spark, sf, "supplier").select(k.alias("source"), F.when(k % 10 == 7, "breezy").when(k % 10 == 8, "none").alias("adapter"), base.alias("base_url"), F.concat(F.lit("t"), k).alias("token"), F.when(k % 3 == 0, k.cast("int")).alias("most"))
    return adapters.probes(sources, 200)


#: What a load of orders is to have: a column that isn't there, one of another type, and values that are demanded.
CONTRACT = "o_orderkey long not null, o_custkey long, o_orderpriority int not null, o_totalprice double not null, o_clerk string, o_orderdate timestamp"


def checked_orders(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, sf, "orders").withColumns({"o_orderpriority": F.when(k % 6 > 0, F.substring("o_orderpriority", 1, F.when(k % 4 == 0, 2).otherwise(1).cast("int"))), "o_custkey": F.when(k % 10 > 0, F.col("o_custkey"))})
    return breaches(rows, CONTRACT)


def robots_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as answers for robots.txt, of which 1,000 bytes are read."""
    k = F.col("doc_id")
    rows = read(spark, sf, "documents").select(k.alias("host"), F.when(k % 7 == 1, 404).when(k % 7 == 2, 503).when(k % 7 > 3, 200).alias("status"), "text").withColumnRenamed("text", "body")
    made = robots.published(rows.withColumn("status", F.coalesce("status", F.when(F.col("host") % 7 == 0, 301))), 1_000)
    return made.select("host", "state", "truncated", F.length("body").cast("long").alias("n_chars"))


def company_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of suppliers by name: some are known, some seeded, once or twice, some answer."""
    k = F.col("s_suppkey")
    letters = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    name = F.when(k % 11 == 0, " ").when(k % 11 == 1, "++").otherwise(F.concat(F.lit("Acme "), letters, F.lit(" Pvt. Ltd")))
    rows = read(spark, sf, "supplier").select(k, letters.alias("x"), name.alias("name"))
    domain = F.concat(F.lit("acme"), "x")
    registry = rows.where("s_suppkey % 5 = 2").select(F.concat(F.lit("acme-"), "x", F.lit("-pvt-ltd")).alias("slug"), F.when(k % 2 == 0, F.concat(domain, F.lit(".org"))).alias("domain"))
    seeds = rows.where("s_suppkey % 3 = 0").select(F.concat(F.lit("Acme-"), "x", F.lit(".in")).alias("domain")).unionAll(rows.where("s_suppkey % 6 = 0").select(F.concat(domain, F.lit(".co.in")).alias("domain")))
    slug = F.concat(F.lit("acme-"), "x", F.lit("-pvt-ltd"))
    verified = rows.where("s_suppkey % 4 = 1").select(F.concat(domain, F.lit(".com")).alias("domain"), slug.alias("slug")).unionAll(rows.where("s_suppkey % 8 = 1").select(F.concat(domain, F.lit(".in")).alias("domain"), slug.alias("slug")))
    found = resolve.resolved(rows.select("s_suppkey", "name"), registry, seeds, verified)
    return found.select("s_suppkey", "slug", "outcome", "evidence", F.array_join("domains", " ").alias("domains"))


QUERIES = {"src01_checked_orders": checked_orders, "src16_robots_answers": robots_answers, "txt11_company_sites": company_sites, "src09_oracle_hcm": oracle_hcm, "src02_source_health": source_health, "src02_source_probes": source_probes}
_READ = f"""with sources as (select n_name as source, n_nationkey as k, case when k % 4 = 1 then 'https://Fa-x.OracleCloud.com' when k % 4 = 2 then 'https://jobs.fa.ocs.oraclecloud.com' else 'https://hcm.' || k || '.example' end as host,
    'CX_' || k as token, case when k % 2 = 0 then {MOST} end as most from nation where k % 4 = 0 or (k % 11 <> 5 and k % 4 in (1, 2))),
  items as (select s.*, (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 as page, o_orderkey, o_orderkey % 7 <> 3 as has_id, o_orderpriority, o_orderstatus, c_mktsegment, o_orderdate
    from orders join customer on o_custkey = c_custkey join sources s on s.k = c_nationkey),
  pages as (select source, k, most, page, count(*) as n, count(*) filter (has_id) as ids, k % 9 = 4 and page = 2 as broken from items group by all),
  counted as (select source, page, most, broken, case when broken then 0 else ids end as ids, broken or n < least(coalesce(most, {SIZE}), {SIZE}) as short from pages),
  told as (select *, coalesce(sum(ids) over w, 0) as before, coalesce(bool_or(short) over w, false) as stopped from counted window w as (partition by source order by page rows between unbounded preceding and 1 preceding)),
  used as (select * from told where not stopped and (most is null or before < most)),
  failed as (select distinct source from used where broken)
  """
_BOARDS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable", "breezy", "oracle-hcm"]
ORACLE_SQL = {
    "src09_oracle_hcm": _READ
    + """, placed as (select i.*, row_number() over (partition by i.source order by i.page, o_orderkey) as place from items i join used u on u.source = i.source and u.page = i.page where has_id)
  select source, o_orderkey::varchar as external_id, o_orderpriority as title, source as company_name, c_mktsegment as location_text, o_orderstatus as employment_type_text,
    host || '/hcmUI/CandidateExperience/en/sites/' || token || '/job/' || o_orderkey as apply_url, epoch(date_trunc('day', o_orderdate))::bigint as posted_at
  from placed where (most is null or place <= most) and source not in (select source from failed)""",
    "src01_checked_orders": """with o as (select o_orderkey as k, substr(o_orderpriority, 1, case when o_orderkey % 4 = 0 then 2 else 1 end) as p from orders)
      select 'o_clerk' as "column", 'MISSING' as problem, null::bigint as n union all select 'o_orderstatus', 'EXTRA', null
      union all select 'o_orderpriority', 'TYPE', count(*) from o where k % 6 > 0 and k % 4 = 0 having count(*) > 0 union all select 'o_orderpriority', 'NULL', count(*) from o where k % 6 = 0 or k % 4 = 0 having count(*) > 0""",
    "src16_robots_answers": """select doc_id as host, case doc_id % 7 when 1 then 'NOT_PUBLISHED' when 2 then 'UNAVAILABLE' when 3 then 'UNAVAILABLE' else 'READ' end as state,
      doc_id % 7 not in (1, 2, 3) and strlen(text) > 1000 as truncated,
      case when doc_id % 7 not in (1, 2, 3) then case when strlen(text) <= 1000 then length(text) else len(list_filter(range(1, 1001), lambda i: i <= length(text) and strlen(substr(text, 1, i)) <= 1000))
        + (strlen(substr(text, 1, len(list_filter(range(1, 1001), lambda i: i <= length(text) and strlen(substr(text, 1, i)) <= 1000)))) < 1000)::int end end::bigint as n_chars from documents""",
    "txt11_company_sites": """with s as (select s_suppkey as k, translate(s_suppkey::varchar, '0123456789', 'abcdefghij') as x from supplier),
      d as (select *, k % 11 < 2 as none, case when k % 5 = 2 and k % 2 = 0 then ['acme' || x || '.org'] when k % 6 = 0 then ['Acme-' || x || '.in', 'acme' || x || '.co.in'] when k % 3 = 0 then ['Acme-' || x || '.in']
        when k % 8 = 1 then ['acme' || x || '.com', 'acme' || x || '.in'] when k % 4 = 1 then ['acme' || x || '.com'] else [] end as d from s)
      select k as s_suppkey, case when none then '' else 'acme-' || x || '-pvt-ltd' end as slug, case when none or len(d) = 0 then 'NOT_FOUND' when len(d) = 1 then 'RESOLVED' else 'AMBIGUOUS' end as outcome,
      case when none or len(d) = 0 then null when k % 5 = 2 and k % 2 = 0 then 'REGISTRY' when k % 3 = 0 then 'SEED_LIST' else 'VERIFIED_SITE' end as evidence, case when none then '' else array_to_string(d, ' ') end as domains from d""",
    "src02_source_health": _READ
    + """select s.source, case when bool_or(u.broken) is null then 'UNREACHABLE' when bool_or(u.broken) then 'FAILING' else 'HEALTHY' end as status,
    case when not bool_or(u.broken) then least(sum(u.ids), coalesce(any_value(s.most), sum(u.ids)))::bigint end as postings from sources s left join used u on u.source = s.source group by s.source""",
    "src02_source_probes": """with s as (select s_suppkey as k, case when k % 10 = 7 then 'breezy' when k % 9 < 7 then ['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workable', 'breezy', 'oracle-hcm'][(k % 9 + 1)::int] end as serving,
    't' || k as token, least(100, case when k % 3 = 0 then k else 100 end) as lim from supplier)
  select k as source, serving, case serving when 'greenhouse' then 'https://boards-api.greenhouse.io/v1/boards/' || token || '/jobs?content=true' when 'lever' then 'https://api.lever.co/v0/postings/' || token || '?mode=json'
    when 'ashby' then 'https://api.ashbyhq.com/posting-api/job-board/' || token || '?includeCompensation=true' when 'smartrecruiters' then 'https://api.smartrecruiters.com/v1/companies/' || token || '/postings?limit=' || lim
    when 'workable' then 'https://apply.workable.com/api/v1/widget/accounts/' || token || '?details=true' when 'breezy' then 'https://' || token || '.breezy.hr/json'
    when 'oracle-hcm' then 'https://eu.oraclecloud.com/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList&finder=findReqs;siteNumber=' || token || ',limit=' || lim || ',offset=200' end as address from s""",
}
