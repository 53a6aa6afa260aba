"""Scalars over texts, addresses, dates and numbers; scores; joins by text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import numbers as N
from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.sources import feeds
from siltstone.sources.tables import read


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "part")


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return _parts(spark, sf).select("p_partkey", T.slugify(label).alias("slug"), T.skill_slug(F.col("p_brand")).alias("skill"), T.canonicalize(label).alias("canonical"), T.prettify(T.slugify(label)).alias("pretty"), T.friendly(F.col("p_type")).alias("label"))


def hashes(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("text", "lang", "source")]), 256).alias("content_hash"))


def similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.token_similarity(F.col("p_name"), F.concat_ws(" ", F.lit("red ring"), "p_type")).alias("similarity"))


def mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.mentions_term(F.col("p_name"), "red").alias("term"), T.mentions(F.concat_ws(" ", "p_name", "p_brand"), F.lit("Brand#1")).alias("part"))


def keys(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", T.canonical_key(F.col("p_brand"), F.col("p_name"), F.lit(" ")).alias("key"), T.usable_requisition(F.col("p_brand")).alias("usable"), T.usable_requisition(F.col("p_name")).alias("unusable"))


def mail_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of domains as people write them: addresses, capitals, repeats, a path among them."""
    name = F.replace("s_name", F.lit("#"), F.lit("-"))
    said = F.concat(name, F.lit(".Org, @b.example.com,"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://x.org/y, "), name, F.lit(".org"))).otherwise("a@b.org,,c d.org"))
    return read(spark, sf, "supplier").select("s_suppkey", T.clean_domains(said).alias("domains"))


def naturally(spark: SparkSession, sf: str) -> DataFrame:
    found = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("segments"))
    return found.select("c_nationkey", T.join_naturally(F.col("segments")).alias("sentence"))


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses as they are, without a scheme in capitals, and with what follows a visitor."""
    typed = [F.col("url"), F.concat(F.lit("\t"), F.upper(F.regexp_replace(F.split(F.split("url", "#")[0], r"\?")[0], "^https?://", ""))), F.concat(F.split(F.split("url", "#")[0], r"\?")[0], F.lit("?utm_source=x&B=%20&Z=2&ref=y&a=1#top"))]
    rows = read(spark, sf, "pages").select("page_id", F.posexplode(F.array(*typed)).alias("form", "typed"))
    return rows.select("page_id", "form", U.normalize_url(F.col("typed")).alias("url"), U.host(F.col("typed")).alias("host"))


def instants(spark: SparkSession, sf: str) -> DataFrame:
    """Times of events as feeds write them: with an offset, with Z, with UTC, as a day, not at all."""
    day, at = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    shapes = [F.concat(day, F.lit("T"), at, F.lit("Z")), F.concat(day, F.lit("T"), at, F.lit("+05:30")), F.concat(day, F.lit(" "), at, F.lit(" UTC")), F.concat(day, F.lit("T00:00:00Z")), F.lit("soon"), F.lit(None).cast("string")]
    given = F.element_at(F.array(*shapes), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", F.unix_seconds(N.lenient_instant(given)).alias("seconds"))


def partial_dates(spark: SparkSession, sf: str) -> DataFrame:
    given = F.element_at(F.array(*[F.date_format("o_orderdate", f) for f in ("yyyy", "yyyy-MM", "yyyy-MM-dd", "MMM yyyy")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, sf, "orders").select("o_orderkey", N.partial_date(given).cast("string").alias("day"))


def business_days(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").groupBy(N.business_day(F.col("ts").cast("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("n"))


def roundings(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", N.round_half_up(F.col("c_acctbal")).alias("whole"), N.scaled(F.col("c_acctbal"), 12, 1).cast("double").alias("tenth"))


def pointers(spark: SparkSession, sf: str) -> DataFrame:
    """Scalars as text, an object by its name, an array's elements with commas, missing members as null."""
    body = F.try_parse_json(F.concat(F.lit('{"a":[{"name":"'), "event_type", F.lit('"},'), F.col("user_id").cast("string"), F.lit('],"o":{"name":" x "},"p":'), "props", F.lit("}")))
    pointed = {"k": "/p/k", "listed": "/a", "first": "/a/0", "named": "o", "missing": "/p/missing/name"}
    return read(spark, sf, "events").select("event_id", body.alias("b")).select("event_id", *[feeds.coerced_at(F.col("b"), p).alias(k) for k, p in pointed.items()])


def experience(spark: SparkSession, sf: str) -> DataFrame:
    years = F.floor(F.col("c_acctbal") / 500).cast("double")
    least = F.when(F.col("c_nationkey") % 5 != 0, (F.col("c_nationkey") % 5).cast("double"))
    most = F.when(F.col("c_nationkey") % 3 != 0, (F.col("c_nationkey") % 5 + 4).cast("double"))
    return read(spark, sf, "customer").select("c_custkey", S.experience_score(years, least, most).alias("score"))


def matches(spark: SparkSession, sf: str) -> DataFrame:
    """Six dimensions, some unknown, with confidence and tier."""
    n = F.col("c_custkey")
    scores = {k: F.when(n % m != 0, (n * p % 101).cast("double")) for k, m, p in (("skills", 3, 7), ("role", 4, 11), ("experience", 5, 13), ("location", 7, 17), ("seniority", 11, 19), ("work_mode", 2, 23))}
    sure = S.confidence(scores)
    rows = read(spark, sf, "customer").select("c_custkey", S.weighted(scores).alias("mean"), sure.alias("confidence"))
    score = F.when(F.col("confidence") != "INSUFFICIENT", F.col("mean"))
    return rows.select("c_custkey", score.alias("score"), "confidence", S.tier(score, n % 13 == 0, n % 2 == 0, F.col("confidence")).alias("tier"))


def skill_scores(spark: SparkSession, sf: str) -> DataFrame:
    held = read(spark, sf, "orders").join(read(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("o_custkey").agg(F.collect_set("p_brand").alias("held"))
    tiers = {"required": F.array(*map(F.lit, ["Brand#1", "Brand#2", "Brand#3"])), "preferred": F.array(*map(F.lit, ["Brand#4", "Brand#5"])), "optional": F.array().cast("array<string>")}
    return held.select("o_custkey", S.skill_score(F.col("held"), tiers).alias("score"))


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a small dictionary in each text, found by splitting the text once and joining its tokens."""
    terms = spark.createDataFrame([("red", "colour"), ("blue", "colour"), ("ring", "thing"), ("bolt", "thing")], "term string, kind string")
    token = F.explode(T.tokens(F.col("p_name"))).alias("term")
    return _parts(spark, sf).select("p_partkey", token).join(F.broadcast(terms), "term").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """An alias, else the name itself, else none."""
    aliases = spark.createDataFrame([("economy", "budget"), ("promo", "offer")], "alias string, name string")
    names = spark.createDataFrame([("standard",), ("budget",), ("offer",)], "own string")
    rows = _parts(spark, sf).select("p_partkey", T.slugify(F.col("p_type")).alias("slug"))
    found = rows.join(F.broadcast(aliases), F.col("slug") == F.col("alias"), "left").join(F.broadcast(names), F.col("slug") == F.col("own"), "left")
    return found.select("p_partkey", F.coalesce("name", "own").alias("resolved"))


def cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The first of several signals that matches decides: each is an equi-join, and the least rank wins."""
    wanted = _parts(spark, sf).where("p_partkey % 10 = 3").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    known = _parts(spark, sf).where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("known_id"), "p_name", "p_brand", "p_type")
    signals = [["p_name", "p_brand", "p_type"], ["p_name", "p_brand"], ["p_name"]]
    hits = None
    for rank, on in enumerate(signals, 1):
        best = known.groupBy(*on).agg(F.min("known_id").alias("known_id"))  # one row a key: the join can't fan out
        found = wanted.join(best, on).select("id", F.lit(rank).alias("rank"), "known_id")
        hits = found if hits is None else hits.unionAll(found)
    return hits.groupBy("id").agg(F.min(F.struct("rank", "known_id")).alias("m")).select("id", "m.rank", "m.known_id")


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Children by parent, gathered once and joined."""
    few = read(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))
    return read(spark, sf, "region").join(few, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", "nations")


def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts that claim a name at or above another's, by equal suffixes."""
    every = read(spark, sf, "pages").select(U.host(F.col("url")).alias("host"))
    # The sites of the networks' blogs claim the whole name.
    hosts = every.unionAll(every.where("host like 'blog.%.net'").select(F.substring("host", 6, 300))).distinct()
    above = hosts.select("host", F.explode(U.host_suffixes(F.col("host"))).alias("claim")).where("claim <> host")
    return above.join(hosts.withColumnRenamed("host", "claim"), "claim", "left_semi").select("host", "claim")


QUERIES = {
    "str01_slugs": slugs,
    "str04_hashes": hashes,
    "str08_token_similarity": similarity,
    "str09_mentions": mentions,
    "str19_canonical_keys": keys,
    "str28_mail_domains": mail_domains,
    "str29_join_naturally": naturally,
    "url01_normalize": page_urls,
    "dat01_instants": instants,
    "dat05_partial_dates": partial_dates,
    "dat04_business_days": business_days,
    "num01_roundings": roundings,
    "jsn01_pointers": pointers,
    "sco02_experience": experience,
    "sco07_matches": matches,
    "sco01_skills": skill_scores,
    "join09_children": members,
    "join12_cascade": cascade,
    "join14_alias": alias_lookup,
    "join15_dictionary": dictionary,
    "join18_overlap": overlaps,
}
_LABEL = "p_name || ' ' || p_brand || ' ' || p_type"
_SLUG = f"trim(regexp_replace(lower({_LABEL}), '[^a-z0-9]+', '-', 'g'), '-')"
_DIMENSIONS = (("skills", 3, 7, 40), ("role", 4, 11, 20), ("experience", 5, 13, 15), ("location", 7, 17, 10), ("seniority", 11, 19, 10), ("work_mode", 2, 23, 5))
_SCORES = ", ".join(f"case when c_custkey % {m} <> 0 then (c_custkey * {p} % 101)::double end as {k}" for k, m, p, _ in _DIMENSIONS)
_KNOWN = " + ".join(f"case when {k} is not null then {w}.0::double else 0 end" for k, _, _, w in _DIMENSIONS)
_GOT = " + ".join(f"coalesce({k} * {w}, 0)" for k, _, _, w in _DIMENSIONS)
ORACLE_SQL = {
    "str01_slugs": f"""select p_partkey, {_SLUG} as slug, trim(regexp_replace(lower(replace(p_brand, '#', ' sharp ')), '[^a-z0-9]+', '-', 'g'), '-') as skill,
      trim(regexp_replace(lower({_LABEL}), '[^a-z0-9+#.]+', ' ', 'g')) as canonical,
      array_to_string(list_transform(string_split({_SLUG}, '-'), lambda x: upper(x[1]) || x[2:]), ' ') as pretty, upper(p_type[1]) || replace(lower(p_type[2:]), '_', ' ') as label from part""",
    "str04_hashes": "select doc_id, sha256(text) as sha, sha256(coalesce(text, '') || '|' || coalesce(lang, '') || '|' || coalesce(source, '')) as content_hash from documents",
    "str08_token_similarity": """select p_partkey, len(list_intersect(a, b)) / len(list_distinct(a || b)) as similarity from (select p_partkey, list_distinct(string_split(p_name, ' ')) as a, list_distinct(string_split('red ring ' || lower(p_type), ' ')) as b from part)""",
    "str09_mentions": "select p_partkey, list_contains(string_split(p_name, ' '), 'red') as term, contains(lower(replace(p_name || p_brand, ' ', '')), 'brand#1') as part from part",
    "str19_canonical_keys": "select p_partkey, trim(regexp_replace(lower(p_brand || '::' || p_name || '::any'), '[^a-z0-9]+', '-', 'g'), '-') as key, true as usable, false as unusable from part",
    "str28_mail_domains": """select s_suppkey, case when s_suppkey % 2 = 0 then array_to_string(list_sort(['b.example.com', lower(replace(s_name, '#', '-')) || '.org']), ',') else array_to_string(list_sort(['b.example.com', lower(replace(s_name, '#', '-')) || '.org']), ',') end as domains from supplier""",
    "str29_join_naturally": """select c_nationkey, case len(s) when 1 then s[1] else array_to_string(s[:-2], ', ') || ' and ' || s[-1] end as sentence from (select c_nationkey, list_sort(list(distinct c_mktsegment)) as s from customer group by 1)""",
    "url01_normalize": """select page_id, 0 as form, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/$', '') || case when regexp_matches(url, '[?&]page=') then '?page=' || regexp_extract(url, '[?&]page=([^&#]*)', 1) else '' end as url,
      regexp_extract(url, '://([^/]*)', 1) as host from pages
      union all select page_id, 1, regexp_replace(lower(regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://', '')), '(.)/$', '\\1'), null from pages
      union all select page_id, 2, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '(.)/$', '\\1') || '?a=1&b= &z=2', lower(regexp_extract(url, '://([^/:?#]*)', 1)) from pages""",
    "dat01_instants": """select event_id, case event_id % 6 when 0 then epoch(date_trunc('second', ts)) when 1 then epoch(date_trunc('second', ts)) - 19800 when 2 then epoch(date_trunc('second', ts)) when 3 then epoch(date_trunc('day', ts)) end::bigint as seconds from events""",
    "dat05_partial_dates": """select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-01-01') when 1 then strftime(o_orderdate, '%Y-%m-01') when 2 then strftime(o_orderdate, '%Y-%m-%d') end as day from orders""",
    "dat04_business_days": "select (ts + interval 330 minutes)::date::varchar as day, count(*) as n from events group by 1",
    "num01_roundings": "select c_custkey, floor(c_acctbal + 0.5)::bigint as whole, round(c_acctbal::decimal(12,2), 1)::double as tenth from customer",
    "jsn01_pointers": """select event_id, json_extract_string(props, '$.k') as k, event_type || ', ' || user_id as listed, event_type as first, 'x' as named, null::varchar as missing from events""",
    "sco02_experience": """select c_custkey, case when least is null and most is null then null else floor(greatest(0, least(100, case when y < coalesce(least, 0) then 100 - 25 * (coalesce(least, 0) - y)
      when y > coalesce(most, 99) then 100 - 8 * (y - coalesce(most, 99)) else 100 end)) + 0.5)::bigint end as score
      from (select c_custkey, floor(c_acctbal / 500) as y, case when c_nationkey % 5 <> 0 then c_nationkey % 5 end as least, case when c_nationkey % 3 <> 0 then c_nationkey % 5 + 4 end as most from customer)""",
    "sco07_matches": f"""with s as (select c_custkey, {_SCORES} from customer), m as (select c_custkey, skills, role, {_KNOWN} as known, {_GOT} as got from s),
      c as (select c_custkey, case when known > 0 then floor(got / known + 0.5)::bigint end as mean, case when (skills is null and role is null) or floor(known + 0.5) < 30 then 'INSUFFICIENT'
        when floor(known + 0.5) >= 80 then 'HIGH' when floor(known + 0.5) >= 50 then 'MEDIUM' else 'LOW' end as confidence from m), f as (select *, case when confidence <> 'INSUFFICIENT' then mean end as score from c)
      select c_custkey, score, confidence, case when score is null then 'UNAVAILABLE' when c_custkey % 13 = 0 then 'NOT_ELIGIBLE' when score < 70 then 'HIDDEN'
        when score >= 95 and c_custkey % 2 <> 0 and confidence = 'HIGH' then 'EXCELLENT' when score >= 85 then 'STRONG' when score >= 75 then 'MODERATE' else 'WEAK' end as tier from f""",
    "sco01_skills": """select o_custkey, floor(100 * (0.7::double * r / 3 + 0.2::double * p / 2) / (0.7::double + 0.2::double) + 0.5)::bigint as score from (
      select o_custkey, count(distinct p_brand) filter (p_brand in ('Brand#1', 'Brand#2', 'Brand#3')) as r, count(distinct p_brand) filter (p_brand in ('Brand#4', 'Brand#5')) as p
      from orders join lineitem on o_orderkey = l_orderkey join part on l_partkey = p_partkey group by 1)""",
    "join09_children": "select r_name, (select string_agg(n_name, ',' order by n_name) from nation where n_regionkey = r_regionkey) as nations from region",
    "join12_cascade": """with w as (select * from part where p_partkey % 10 = 3), k as (select * from part where p_partkey % 10 <> 3),
      h as (select w.p_partkey as id, case when w.p_brand = k.p_brand and w.p_type = k.p_type then 1 when w.p_brand = k.p_brand then 2 else 3 end as rank, k.p_partkey as known_id from w join k on w.p_name = k.p_name)
      select id, rank, known_id from (select *, row_number() over (partition by id order by rank, known_id) as n from h) where n = 1""",
    "join14_alias": "select p_partkey, case lower(p_type) when 'economy' then 'budget' when 'promo' then 'offer' when 'standard' then 'standard' end as resolved from part",
    "join15_dictionary": "select p_partkey, string_agg(t, ',' order by t) as terms from (select distinct p_partkey, unnest(string_split(p_name, ' ')) as t from part) where t in ('red', 'blue', 'ring', 'bolt') group by 1",
    "join18_overlap": "with e as (select regexp_extract(url, '://([^/]*)', 1) as host from pages), h as (select host from e union select substr(host, 6) from e where host like 'blog.%.net') select a.host, b.host as claim from h a join h b on ends_with(a.host, '.' || b.host)",
}
