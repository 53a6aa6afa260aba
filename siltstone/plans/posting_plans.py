"""Postings from feeds of job boards, and their normalised fields. The feeds' bodies are made of the lines of orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import postings as P
from siltstone.sources import feeds
from siltstone.sources.tables import dealt, read


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = read(spark, sf, "lineitem").join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    day = F.to_date("l_shipdate")
    return lines.select(
        F.concat(F.lit("order "), "l_orderkey").alias("source"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_partkey", "p_name", "p_brand", "p_type", "l_quantity", "l_returnflag",
        F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("iso"), (F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400).alias("seconds"),
        F.concat_ws("/", F.lit("https://jobs.example"), "l_orderkey", "l_linenumber").alias("url"),
    )


def _bodies(spark: SparkSession, sf: str, item: dict[str, Column], whole: Callable[[Column], Column]) -> DataFrame:
    """One body for each order, with an item for each of its lines."""
    rows = _lines(spark, sf).select("source", "k", F.struct(*[v.alias(k) for k, v in item.items()]).alias("item"))
    return rows.groupBy("source", "k").agg(F.collect_list("item").alias("items")).select("source", F.to_json(whole(F.col("items"))).alias("body"))


def _of(key: str) -> Callable[[Column], Column]:
    return lambda items: F.struct(items.alias(key))


def _told(bodies: DataFrame, board: feeds.Board, columns: list[str]) -> DataFrame:
    found = feeds.postings(bodies, board)
    return found.select("source", *[F.unix_seconds(c).alias(c) if c in feeds.INSTANTS else F.col(c) for c in columns])


def _id() -> Column:
    return F.when(F.col("n") < 7, F.col("n"))


def _few() -> Column:
    return F.col("l_quantity") < 25


_PLAIN = ["external_id", "title", "company_name", "location_text", "apply_url", "posted_at"]


def greenhouse(spark: SparkSession, sf: str) -> DataFrame:
    content = F.concat(F.lit("&lt;p&gt;"), "p_name", F.lit(" &amp;amp; co&lt;/p&gt;"))
    item = {
        "id": _id(), "requisition_id": F.concat(F.lit(" R-"), "l_partkey", F.lit(" ")), "title": F.col("p_name"), "company": F.struct(F.when(_few(), F.col("p_brand")).alias("name")),
        "location": F.struct(F.col("p_type").alias("name")), "content": content, "departments": F.array(F.struct(F.col("p_type").alias("name"))), "absolute_url": F.col("url"), "first_published": F.col("iso"),
    }
    return _told(_bodies(spark, sf, item, _of("jobs")), feeds.BOARDS["greenhouse"], [*_PLAIN, "requisition_id", "description_html", "department_text"])


def lever(spark: SparkSession, sf: str) -> DataFrame:
    lists = F.array(F.struct(F.lit("Tasks").alias("text"), F.concat(F.lit("<li>"), "p_type", F.lit("</li>")).alias("content")), F.struct(F.when(_few(), "More").alias("text"), F.lit(None).cast("string").alias("content")))
    item = {
        "id": _id(), "text": F.col("p_name"), "categories": F.struct(F.col("p_type").alias("location"), F.lit("Full-time").alias("commitment")), "workplaceType": F.when(_few(), "remote"), "lists": lists,
        "description": F.concat(F.lit("<p>"), "p_brand", F.lit("</p>")), "createdAt": F.when(F.col("l_returnflag") != "R", F.col("seconds") * 1000).otherwise(-1), "hostedUrl": F.col("url"), "applyUrl": F.when(_few(), F.concat("url", F.lit("/apply"))),
    }
    return _told(_bodies(spark, sf, item, lambda items: items), feeds.BOARDS["lever"], [*_PLAIN, "description_html", "work_mode_text", "employment_type_text"])


def ashby(spark: SparkSession, sf: str) -> DataFrame:
    item = {
        "id": _id(), "title": F.col("p_name"), "location": F.col("p_type"), "isListed": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") != "R"), "isRemote": F.when(F.col("n") < 5, _few()),
        "compensation": F.struct(F.col("p_brand").alias("compensationTierSummary")), "jobUrl": F.col("url"), "publishedAt": F.col("iso"),
    }
    return _told(_bodies(spark, sf, item, _of("jobs")), feeds.BOARDS["ashby"], [*_PLAIN, "work_mode_text", "salary_text"])


def smartrecruiters(spark: SparkSession, sf: str) -> DataFrame:
    item = {
        "id": _id(), "name": F.col("p_name"), "refNumber": F.col("l_partkey"), "company": F.struct(F.col("p_brand").alias("name"), F.when(_few(), "acme").alias("identifier")),
        "location": F.struct(F.col("p_type").alias("city"), F.when(_few(), " ").alias("region"), F.lit("de").alias("country")), "typeOfEmployment": F.struct(F.lit("Contract").alias("label")), "releasedDate": F.col("iso"),
    }
    return _told(_bodies(spark, sf, item, _of("content")), feeds.BOARDS["smartrecruiters"], [*_PLAIN, "requisition_id", "employment_type_text"])


def workable(spark: SparkSession, sf: str) -> DataFrame:
    item = {
        "shortcode": _id(), "code": F.col("l_partkey"), "title": F.col("p_name"), "city": F.col("p_type"), "state": F.when(_few(), F.col("p_brand")), "country": F.lit("India"), "telecommuting": F.when(F.col("n") < 5, _few()),
        "url": F.col("url"), "published_on": F.col("iso"), "employment_type": F.lit("Full-time"),
    }
    account = F.when(F.col("k") % 2 == 1, F.concat(F.lit("account "), "k"))
    bodies = _bodies(spark, sf, item, lambda items: F.struct(account.alias("name"), items.alias("jobs")))
    return _told(bodies, feeds.BOARDS["workable"], [*_PLAIN, "requisition_id", "work_mode_text"])


def breezy(spark: SparkSession, sf: str) -> DataFrame:
    named = F.struct(F.col("p_brand").alias("name"), F.lit(1).alias("id"))
    item = {
        "id": _id(), "name": F.col("p_name"), "friendly_id": F.col("l_partkey"), "company": F.struct(F.when(_few(), F.col("p_brand")).alias("name")), "location": F.struct(F.col("p_type").alias("city"), named.alias("state"), F.when(_few(), named).alias("country")),
        "type": F.struct(F.lit("Part-time").alias("name")), "salary": F.col("l_quantity").cast("int"), "url": F.col("url"), "published_date": F.when(_few(), F.col("iso")).otherwise("soon"),
    }
    return _told(_bodies(spark, sf, item, lambda items: items), feeds.BOARDS["breezy"], [*_PLAIN, "salary_text", "employment_type_text"])


def sample(spark: SparkSession, sf: str) -> DataFrame:
    item = {"externalId": _id(), "title": F.col("p_name"), "companyName": F.col("p_brand"), "location": F.col("p_type"), "applyUrl": F.col("url"), "postedAt": F.col("iso"), "workMode": F.when(_few(), "Hybrid")}
    return _told(_bodies(spark, sf, item, _of("jobs")), feeds.BOARDS["sample"], [*_PLAIN, "work_mode_text"])


CONFIGURED = feeds.configured(
    "/data/rows",
    {"external_id": "/ref", "title": "/names/0", "company_name": "/firm", "location_text": "/places", "department_text": "team.name", "posted_at": "/at", "salary_text": "/pay~1year"},
    {"apply_url": "https://{token}.example/{id}"},
)


def configured(spark: SparkSession, sf: str) -> DataFrame:
    places = F.array(F.struct(F.col("p_type").alias("name")), F.struct(F.when(_few(), F.col("p_brand")).alias("name")))
    item = {
        "ref": _id(), "names": F.array("p_name", "p_brand"), "firm": F.struct(F.col("p_brand").alias("name")), "places": places, "team": F.struct(F.lit("  ops ").alias("name")),
        "at": F.when(_few(), F.col("seconds")).otherwise(F.col("seconds") * 1000), "pay/year": F.col("l_quantity").cast("int"),
    }
    bodies = _bodies(spark, sf, item, lambda items: F.struct(F.struct(items.alias("rows")).alias("data")))
    return _told(bodies, CONFIGURED, [*_PLAIN, "department_text", "salary_text"])


def unreadable(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties as bodies: those with an array `jobs` would be a feed; none is."""
    bodies = read(spark, sf, "events").select(F.concat(F.lit("event "), "event_id").alias("source"), F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("body"))
    return feeds.unreadable(bodies, feeds.BOARDS["greenhouse"])


#: Titles, places and descriptions that a line's posting may have; {name} and {n} are filled in.
TITLES = ["Senior {name} (Remote)", "{name} Intern", "Internal {name} III", "Lead {name} - Contract", "{name} m/f/d", "Jr. {name} [2 openings]", "  ", "Principal {name} | urgent", "(remote)", "Graduate {name} iv"]
PLACES = ["Hyderabad, Telangana, India", "San Francisco, CA • New York, NY • United States", "Remote", "Remote, India", "Berlin; Munich", None, "New York, NY", "In office | Pune, MH", "Hybrid - Oslo"]
TEXTS = [
    "<p>Needs {n}-5 years.</p><p>Part of a fully remote team</p>", "{n}+ yrs &amp; a full-time job", "at least {n} years<br>an internship", "9 to 4 years, minimum of {n} yrs", "<h3>Requirements</h3><ul><li>SQL {n}</li><li>Java</li></ul><p>Our Benefits</p><p>tea</p>",
    "$80k - ${n}20k per hour", "₹{n},000 to 2,500.50 /month. Hybrid working", "<style>p{}</style><p>What you will do</p><p>lift {name}</p><p>Who you are</p><p>strong</p>", "€9 - 5", "for a fresher {n} – 44 years",
]
STATED = [None, "Remote office", "hybrid", "the office", "other"]
TYPES = [None, "Intern", "freelance", "Part", "temp", "FULLTIME", "other"]
_N = "(l_linenumber + 1)"


def _chosen(choices: list[str | None], number: Column) -> Column:
    text = F.element_at(F.array(*map(F.lit, choices)), (F.pmod(number, F.lit(len(choices))) + 1).cast("int"))
    return F.replace(F.replace(text, F.lit("{name}"), F.col("p_name")), F.lit("{n}"), (F.col("n") + 1).cast("string"))


def normalized(spark: SparkSession, sf: str, wanted: list[str] = P.FIELDS) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    rows = P.with_fields(dealt(_lines(spark, sf).select("k", "n", "p_name"), "k", "n"), _chosen(TITLES, k + n), _chosen(PLACES, k * 3 + n), _chosen(TEXTS, k + 2 * n), _chosen(STATED, k + 3 * n), _chosen(TYPES, 2 * k + n), F.lit(None).cast("string"), wanted)
    return rows.select("k", "n", *wanted)


def _some(*columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: normalized(spark, sf, list(columns))


FIELD_QUERIES = {
    "str10_titles": ["title", "normalized_title"],
    "str11_places": ["location_raw", "city", "region", "country"],
    "str12_work_modes": ["work_mode"],
    "str13_employment_types": ["employment_type"],
    "str14_levels": ["seniority"],
    "str15_experience": ["min_experience", "max_experience"],
    "str16_salaries": ["salary_min", "salary_max", "salary_currency", "salary_period"],
    "str17_sections": ["responsibilities", "requirements"],
    "str05_html_to_text": ["description"],
}
QUERIES = {
    "src03_greenhouse": greenhouse,
    "src04_lever": lever,
    "src05_ashby": ashby,
    "src06_smartrecruiters": smartrecruiters,
    "src07_workable": workable,
    "src08_breezy": breezy,
    "src10_configured": configured,
    "src11_sample": sample,
    "ent08_unreadable_bodies": unreadable,
    "txt01_normalized": normalized,
    **{name: _some(*columns) for name, columns in FIELD_QUERIES.items()},
}

_FROM = "from lineitem join part on l_partkey = p_partkey where l_linenumber < 7"
_S, _URL = "'order ' || l_orderkey", "'https://jobs.example/' || l_orderkey || '/' || l_linenumber"
_DAY, _LITTLE = "(l_shipdate::date - date '1970-01-01')::bigint * 86400", "l_quantity < 25"
_HEAD = f"select {_S} as source, l_linenumber::varchar as external_id, p_name as title"


def _literal(text: str | None) -> str:
    return "null::varchar" if text is None else "'" + text.replace("'", "''") + "'"


def _pick(choices: list[str | None], number: str) -> str:
    return f"replace(replace(([{', '.join(map(_literal, choices))}])[(({number}) % {len(choices)} + 1)::int], '{{name}}', p_name), '{{n}}', {_N}::varchar)"


def _contains(column: str, signs: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {_literal(s)})" for s in signs) + ")"


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_BREAKS = r"regexp_replace(regexp_replace(regexp_replace(h, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?i)<br\s*/?>|</(?:p|div|li|h[1-6])>', chr(10), 'g'), '(?i)<li[^>]*>', '• ', 'g')"
_DECODED = f"replace(replace(regexp_replace({_BREAKS}, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<')"
_TEXT = _TRIM.format(rf"regexp_replace(regexp_replace({_DECODED}, '[\t\r ]+', ' ', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')")
_NOISE = P.NOISE.replace("'", "''")
_CANON = "trim(regexp_replace(lower({0}), '[^a-z0-9+#.]+', ' ', 'g'))"
_CLEAN = _CANON.format(rf"regexp_replace(regexp_replace(t, '(?i)\s*[\(\[\-–|]\s*(?:{_NOISE})\s*[\)\]]?\s*', ' ', 'g'), '(?i)\b(?:{P.GENDERS})\b', ' ', 'g')")
_LEVEL = " ".join(f"when {_contains('lower(t)', signs)} then '{level}'" for level, signs in P.LEVELS.items())


def _mode(column: str) -> str:
    return f"when {_contains(column, P.HYBRID)} then 'HYBRID' when {_contains(column, P.REMOTE)} then 'REMOTE' when {_contains(column, P.ONSITE)} then 'ONSITE'"


def _section(headings: str) -> str:
    rest = rf"(select substr(b, 2) as r from (select substr(description, strpos(description, m) + length(m)) as b from (select regexp_extract(description, '(?im)^\s*(?:{headings})\s*:?\s*$') as m) where m <> ''))"
    held = rf"(select case when e = '' then r else left(r, strpos(r, e) - 1) end as s from (select r, regexp_extract(r, '(?m)^\s*[A-Z][A-Za-z ''/&]{{3,40}}\s*:?\s*$') as e from {rest}))"
    return f"(select nullif({_TRIM.format('s')}, '') from {held})"


_PAID = P._PAY.replace("'", "''")
_SPAN = r"(?i)(\d{1,2})\s*(?:-|to|–)\s*(\d{1,2})\s*\+?\s*(?:years?|yrs?)"
_BASE = rf"""with raw as (select l_orderkey as k, l_linenumber as n, nullif({_TRIM.format(_pick(TITLES, "l_orderkey + l_linenumber"))}, '') as t, {_pick(PLACES, "l_orderkey * 3 + l_linenumber")} as p,
    {_pick(TEXTS, "l_orderkey + 2 * l_linenumber")} as h, lower({_pick(STATED, "l_orderkey + 3 * l_linenumber")}) as sm, lower({_pick(TYPES, "2 * l_orderkey + l_linenumber")}) as st from lineitem join part on l_partkey = p_partkey),
  a as (select *, {_TEXT} as description, {_CLEAN} as c, string_split_regex(p, '\s*[•|;]\s*') as offices from raw),
  b as (select *, string_split_regex(offices[1], '\s*,\s*') as parts, lower(coalesce(t, '') || chr(10) || coalesce(p, '') || chr(10) || description) as hay, trim(regexp_replace(c, '\b(?:i{{1,3}}|iv|v)\b$', '')) as c2,
    regexp_extract(description, '{_SPAN}', ['a', 'b']) as span, regexp_extract(description, '(?i)(\d{{1,2}})\s*\+\s*(?:years?|yrs?)', 1) as plus,
    regexp_extract(description, '(?i)(?:at least|minimum(?: of)?|min\.?)\s*(\d{{1,2}})\s*(?:years?|yrs?)', 1) as floor, regexp_extract(description, '{_PAID}', ['s', 'a', 'ak', 'u', 'b', 'bk']) as pay from a),
  d as (select *, lower(p) = 'remote' as anywhere, case when len(parts) > 1 then parts[-1] end as last, try_cast(span.a as decimal(4,1)) as lo, try_cast(span.b as decimal(4,1)) as hi,
    try_cast(replace(pay.a, ',', '') as decimal(18,2)) * case when pay.ak <> '' then 1000 else 1 end as pa, try_cast(replace(pay.b, ',', '') as decimal(18,2)) * case when pay.bk <> '' then 1000 else 1 end as pb from b),
  f as (select k, n, t as title, case when t is not null then case when c2 = '' then {_CANON.format("t")} else c2 end end as normalized_title, description, {_section(P.DUTIES)} as responsibilities, {_section(P.WANTED)} as requirements,
    p as location_raw, case when not anywhere and lower(parts[1]) <> 'remote' then parts[1] end as city,
    case when not anywhere then case when len(parts) > 2 then parts[2] when regexp_matches(last, '^[A-Z][A-Z]$') then last end end as region,
    case when not anywhere then case when not regexp_matches(last, '^[A-Z][A-Z]$') then last when len(offices) > 1 and not contains(offices[-1], ',') then offices[-1] end end as country,
    case when {_contains('sm', P.REMOTE)} then 'REMOTE' when {_contains('sm', P.HYBRID)} then 'HYBRID' when {_contains('sm', [*P.ONSITE, 'office'])} then 'ONSITE' {_mode('lower(t)')} {_mode('lower(p)')}
      when {_contains('hay', P.REMOTE_PHRASES)} then 'REMOTE' when {_contains('hay', P.HYBRID_PHRASES)} then 'HYBRID' else 'UNSPECIFIED' end as work_mode,
    case when contains(st, 'intern') then 'INTERNSHIP' when contains(st, 'contract') or contains(st, 'freelance') then 'CONTRACT' when contains(st, 'part') then 'PART_TIME' when contains(st, 'temp') then 'TEMPORARY'
      when contains(st, 'full') then 'FULL_TIME' when contains(hay, 'internship') then 'INTERNSHIP' when contains(hay, 'full-time') or contains(hay, 'full time') then 'FULL_TIME' else 'UNSPECIFIED' end as employment_type,
    case when contains(lower(t), 'intern') and not contains(lower(t), 'internal') then 'INTERN' {_LEVEL} when contains(hay, 'fresher') or contains(hay, 'entry-level') then 'ENTRY' else 'UNSPECIFIED' end as seniority,
    case when lo <= hi and hi <= 40 then lo when try_cast(plus as decimal(4,1)) <= 40 then try_cast(plus as decimal(4,1)) when try_cast(floor as decimal(4,1)) <= 40 then try_cast(floor as decimal(4,1)) end as min_experience,
    case when lo <= hi and hi <= 40 then hi end as max_experience, case when pa <= pb then pa end::decimal(18,2) as salary_min, case when pa <= pb then pb end::decimal(18,2) as salary_max,
    case when pa <= pb then case pay.s when '$' then 'USD' when '₹' then 'INR' when '€' then 'EUR' when '£' then 'GBP' end end as salary_currency,
    case when pa <= pb then case when {_contains('lower(description)', ['per hour', '/hr', 'hourly'])} then 'HOURLY' when {_contains('lower(description)', ['per month', '/month'])} then 'MONTHLY' else 'ANNUAL' end end as salary_period from d)"""
ORACLE_SQL = {
    "src03_greenhouse": f"{_HEAD}, case when {_LITTLE} then p_brand else {_S} end as company_name, p_type as location_text, {_URL} as apply_url, {_DAY} as posted_at, 'R-' || l_partkey as requisition_id, '<p>' || p_name || ' &amp; co</p>' as description_html, p_type as department_text {_FROM}",
    "src04_lever": f"{_HEAD}, {_S} as company_name, p_type as location_text, {_URL} || case when {_LITTLE} then '/apply' else '' end as apply_url, case when l_returnflag <> 'R' then {_DAY} end as posted_at, '<p>' || p_brand || '</p><h3>Tasks</h3><ul><li>' || p_type || '</li></ul>' || case when {_LITTLE} then '<h3>More</h3>' else '' end as description_html, case when {_LITTLE} then 'remote' end as work_mode_text, 'Full-time' as employment_type_text {_FROM}",
    "src05_ashby": f"{_HEAD}, {_S} as company_name, p_type as location_text, {_URL} as apply_url, {_DAY} as posted_at, case when l_linenumber < 5 then case when {_LITTLE} then 'Remote' else 'Onsite' end end as work_mode_text, p_brand as salary_text {_FROM} and l_returnflag <> 'R'",
    "src06_smartrecruiters": f"{_HEAD}, p_brand as company_name, p_type || ', de' as location_text, 'https://jobs.smartrecruiters.com/' || case when {_LITTLE} then 'acme' else {_S} end || '/' || l_linenumber as apply_url, {_DAY} as posted_at, l_partkey::varchar as requisition_id, 'Contract' as employment_type_text {_FROM}",
    "src07_workable": f"{_HEAD}, case when l_orderkey % 2 = 1 then 'account ' || l_orderkey else {_S} end as company_name, p_type || case when {_LITTLE} then ', ' || p_brand else '' end || ', India' as location_text, {_URL} as apply_url, {_DAY} as posted_at, l_partkey::varchar as requisition_id, case when l_linenumber < 5 and {_LITTLE} then 'Remote' end as work_mode_text {_FROM}",
    "src08_breezy": f"{_HEAD}, case when {_LITTLE} then p_brand end as company_name, p_type || ', ' || p_brand || case when {_LITTLE} then ', ' || p_brand else '' end as location_text, {_URL} as apply_url, case when {_LITTLE} then {_DAY} end as posted_at, l_quantity::int::varchar as salary_text, 'Part-time' as employment_type_text {_FROM}",
    "src10_configured": f"{_HEAD}, p_brand as company_name, p_type || case when {_LITTLE} then ', ' || p_brand else '' end as location_text, 'https://' || {_S} || '.example/' || l_linenumber as apply_url, {_DAY} as posted_at, 'ops' as department_text, l_quantity::int::varchar as salary_text {_FROM}",
    "src11_sample": f"{_HEAD}, p_brand as company_name, p_type as location_text, {_URL} as apply_url, {_DAY} as posted_at, case when {_LITTLE} then 'Hybrid' end as work_mode_text {_FROM}",
    "ent08_unreadable_bodies": "select 'event ' || event_id as source, case when event_type = 'error' then 'not JSON' else 'no array of postings' end as problem from events",
    "txt01_normalized": f"{_BASE} select * from f",
    **{name: f"{_BASE} select k, n, {', '.join(columns)} from f" for name, columns in FIELD_QUERIES.items()},
}
