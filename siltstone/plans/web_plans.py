"""Pages: robots rules, JSON-LD postings and sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.urls import host
from siltstone.operators import robots
from siltstone.sources import jsonld
from siltstone.sources.tables import read

#: Rules that a host may publish, and the status of the answer; by the length of its name.
PUBLISHED = [
    (200, "User-agent: *\nDisallow: /en/\nAllow: /en/1 # some\nDisallow: /*.html$\n"),
    (200, "User-agent: other\nDisallow: /\n\nUser-agent: siltstone\nUser-agent: x\nDisallow:\nDisallow: /de\nAllow: /de\nno rule\nDisallow: /fr*/2"),
    (200, ""),
    (404, "User-agent: *\nDisallow: /"),
    (503, None),
]

#: Postings that a listing tells in one block, so that no block is too large to be read, however many pages a host has.
BLOCK = 40


def robots_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    paths = read(spark, sf, "pages").select(host(F.col("url")).alias("host"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("/")).alias("path"))
    choice = (F.length("host") % len(PUBLISHED) + 1).cast("int")
    status, body = (F.element_at(F.array(*[F.lit(p[k]) for p in PUBLISHED]), choice) for k in (0, 1))
    bodies = paths.select("host").distinct().select("host", status.alias("status"), body.alias("body"))
    return robots.verdicts(bodies, paths, "siltstone/1").groupBy("host", "path", "verdict").agg(F.count("*").alias("n"))


def json_ld(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of parts: one posting, one among others, one deep in graphs, a block that can't be read, terms of another
    vocabulary, and one named by address there. Some are told twice, once with less."""
    k = F.col("p_partkey")
    address = F.struct(F.col("p_type").alias("addressLocality"), F.when(k % 3 > 0, F.when(k % 3 == 1, "AP").otherwise("Andhra")).alias("addressRegion"), F.when(k % 2 == 0, F.struct(F.lit("in").alias("name"))).alias("addressCountry"))
    none = F.lit(None).cast("string")
    pay = F.struct(F.element_at(F.array(*map(F.lit, ["INR", "usd", "EUR", "XXX"])), (k % 4 + 1).cast("int")).alias("currency"), F.struct(F.col("p_size").alias("minValue"), F.when(k % 7 > 0, F.col("p_size") + k % 7 - 2).alias("maxValue"), F.lit("year").alias("unitText")).alias("value"))
    url = F.when(k % 3 == 0, F.concat(F.lit("HTTPS://Jobs.site.com/j/"), k)).when(k % 3 == 1, F.concat(F.lit("https://jobs.lever.co/acme/"), k)).otherwise(F.concat(F.lit("https://elsewhere.com/"), k))

    def node(kind: str, title: Column, more: bool) -> Column:
        parts = {"@type": F.lit(kind), "identifier": F.struct(F.concat(F.lit("id "), k).alias("value")), "title": title, "url": url}
        if more:
            parts |= {
                "hiringOrganization": F.struct(F.col("p_brand").alias("name")), "jobLocation": F.array(*[F.struct(a.alias("address"), n.alias("name")) for a, n in ((address, none), (F.when(k < 0, address), F.lit("Oslo")), (address, none))]),
                "employmentType": F.array(F.lit("FULL_TIME"), F.when(k % 2 == 0, "INTERN")), "jobLocationType": F.when(k % 5 == 0, "telecommute"), "datePosted": F.lit("2024-05-01T00:00:00Z"), "baseSalary": pay,
            }
        return F.struct(*[v.alias(name) for name, v in parts.items()])

    def under(context: str, name: str, *held: Column) -> Column:
        return F.concat(F.lit('{"@context":' + context + f',"{name}":['), F.concat_ws(",", *held), F.lit("]}"))

    whole, less, other = (F.to_json(x) for x in (node("JobPosting", F.col("p_name"), True), node("JobPosting", F.upper("p_name"), False), F.struct(F.lit("Organization").alias("@type"), F.col("p_brand").alias("name"))))
    by_address = F.to_json(node("https://schema.org/JobPosting", F.col("p_name"), True))
    inner = F.concat(F.lit('[{"@graph":['), less, F.lit(","), whole, F.lit("]}]"))
    body = F.when(k % 6 == 0, whole).when(k % 6 == 1, F.concat(F.lit("["), F.concat_ws(",", other, less, whole, less), F.lit("]"))).when(k % 6 == 2, under('["x", {"@vocab": "http://schema.org/"}]', "@graph", inner))
    body = body.when(k % 6 == 3, F.concat(whole, F.lit(" more"))).when(k % 6 == 4, under('"https://other.example/"', "@graph", whole)).otherwise(under('"https://other.example/"', "@graph", by_address))
    html = F.concat(F.lit("<html><!-- <script type=\"application/ld+json\">{\"@type\":\"JobPosting\",\"title\":\"no\"}</script> --><SCRIPT id=x type='application/ld+json; v=1'>"), body, F.lit("</script><p>text</p></html>"))
    pages = read(spark, sf, "part").select(k.alias("page_id"), html.alias("html"), F.concat(F.lit("https://jobs.site.com/"), k).alias("url"))
    made = jsonld.raw_postings(jsonld.posting_nodes(pages, "page_id"), F.lit("Site"), F.col("url"), own_page=F.lit(True))
    return made.select("page_id", "external_id", "title", "company_name", "location_text", "employment_type_text", "work_mode_text", "salary_text", "apply_url", F.unix_seconds("posted_at").alias("posted_at"))


def _career_page(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as their hosts answer for them, with what they say of a posting, and what the host's listing says of it."""
    k = F.col("page_id")
    url = F.regexp_replace(F.regexp_replace("url", "^(https?://[^/?#]*)[.]example", "$1.com"), "[?#].*$", "")
    own = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.when(k % 6 < 5, F.concat(F.lit("p"), k)).alias("identifier"), F.concat(F.lit("own "), k).alias("title"), F.when(k % 8 == 1, "2020-01-01").otherwise("2099-01-01").alias("validThrough")))
    shown = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("p"), k).alias("identifier"), F.concat(F.lit("listed "), k).alias("title"), F.col("url"), F.when(k % 9 == 4, "2020-01-01T10:00:00Z").alias("validThrough")))
    status = F.when(k % 10 == 0, 404).when(k % 10 == 1, 410).when(k % 10 == 2, 500).otherwise(200)
    rows = read(spark, sf, "pages").select("page_id", url.alias("url")).withColumn("source", host(F.col("url")))
    return rows.select("source", k.alias("place"), "url", status.alias("status"), F.concat(F.lit("<script type=application/ld+json>"), own, F.lit("</script>")).alias("html"), (k % 11 != 3).alias("allowed"), shown.alias("shown"))


def crawl(spark: SparkSession, sf: str) -> DataFrame:
    pages = _career_page(spark, sf)
    listed = pages.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "shown"))), lambda x: x["shown"]).alias("shown"))

    def block(i: Column) -> Column:
        return F.concat(F.lit('<script type="application/ld+json">['), F.array_join(F.slice("shown", i * BLOCK + 1, F.lit(BLOCK)), ","), F.lit("]</script>"))

    starts = F.sequence(F.lit(0), F.ceil(F.size("shown") / BLOCK).cast("int") - 1)
    listings = listed.select("source", F.array_join(F.transform(starts, block), "\n").alias("html"), F.concat(F.lit("https://"), "source", F.lit("/careers")).alias("url"))
    made = jsonld.crawled(listings, pages, F.lit("2024-06-01T00:00:00Z").cast("timestamp"), budget=6, most=40)
    return made.select("source", "page_url", "own", "rank", "external_id", "title", "apply_url")


def sitemap(spark: SparkSession, sf: str) -> DataFrame:
    """Sitemaps of up to 100 pages of a host each, and what they list."""
    rows = read(spark, sf, "pages").select(host(F.col("url")).alias("host"), F.floor(F.col("page_id") / 100).alias("file"), F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>")).alias("entry"))
    maps = rows.groupBy("host", "file").agg(F.concat(F.lit("<?xml version='1.0'?><urlset>"), F.array_join(F.collect_list("entry"), "\n"), F.lit("</urlset>")).alias("xml"))
    return jsonld.listed(maps).select("host", "loc", "nested").distinct()


QUERIES = {"dom02_robots": robots_verdicts, "txt02_json_ld": json_ld, "src13_sitemaps": sitemap, "src12_crawl": crawl}
_HOST = "lower(regexp_extract(url, '://([^/:?#]*)', 1))"
ORACLE_SQL = {
    "dom02_robots": f"""with p as (select {_HOST} as host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) as path from pages), c as (select *, length(host) % 5 as c from p)
      select host, path, case c when 0 then case when starts_with(path, '/en/1') and not (ends_with(path, '.html') and 8 > 5) then 'ALLOWED' when ends_with(path, '.html') then 'DISALLOWED' when starts_with(path, '/en/') then 'DISALLOWED' else 'ALLOWED' end
        when 1 then case when regexp_matches(path, '^/fr.*/2') then 'DISALLOWED' else 'ALLOWED' end when 2 then 'ALLOWED' when 3 then 'NOT_PUBLISHED' else 'UNAVAILABLE' end as verdict, count(*) as n from c group by all""",
    "txt02_json_ld": """with p as (select *, p_partkey as k, p_size::varchar as lo, (p_size + p_partkey % 7 - 2)::varchar as hi, ['₹', '$', '€', null][(p_partkey % 4 + 1)::int] as sign from part where p_partkey % 6 not in (3, 4))
      select k as page_id, 'id ' || k as external_id, p_name as title, 'Site' as company_name, p_type || case when k % 3 = 1 then ', AP' when k % 3 = 2 and k % 2 = 0 then ', Andhra' else '' end || case when k % 2 = 0 then ', India' else '' end || ' • Oslo' as location_text,
      case when k % 2 = 1 then 'FULL_TIME' end as employment_type_text, case when k % 5 = 0 then 'remote' end as work_mode_text,
      case when k % 7 = 0 then sign || lo || ' - ' || sign || lo || ' per year' when k % 7 <> 1 then sign || lo || ' - ' || sign || hi || ' per year' end as salary_text,
      case k % 3 when 0 then 'HTTPS://Jobs.site.com/j/' || k when 1 then 'https://jobs.lever.co/acme/' || k else 'https://jobs.site.com/' || k end as apply_url, 1714521600::bigint as posted_at from p""",
    "src12_crawl": """with p as (select page_id as k, regexp_replace(regexp_replace(url, '^(https?://[^/?#]*)[.]example', '\\1.com'), '[?#].*$', '') as url from pages), h as (select *, lower(regexp_extract(url, '://([^/:?#]*)', 1)) as source from p),
      opened as (select * from (select *, row_number() over (partition by source order by k, url) as n from h where k % 11 <> 3) where n <= 6),
      own as (select source, url as page_url, true as own, k as place, case when k % 6 < 5 then 'p' || k else url end as external_id, 'own ' || k as title, url as apply_url from opened where k % 10 > 2 and k % 8 <> 1),
      claims as (select source, 'https://' || source || '/careers' as page_url, false as own, k as place, 'p' || k as external_id, 'listed ' || k as title, url as apply_url
        from (select *, row_number() over (partition by source order by k) as n from h) where n <= 50 and k % 9 <> 4 and (source, url) not in (select source, url from opened where k % 10 < 2)),
      every as (select * from own union all select * from claims), one as (select *, row_number() over (partition by source, external_id order by own desc, place) as n from every),
      ranked as (select *, row_number() over (partition by source order by own desc, place)::int as rank from one where n = 1)
      select source, page_url, own, rank, external_id, title, apply_url from ranked where rank <= 40""",
    "src13_sitemaps": f"select distinct {_HOST} as host, url as loc, false as nested from pages",
}
