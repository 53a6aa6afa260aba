"""Filters, states, checks, summaries and rewrites of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import postings as P
from siltstone.functions import records as R
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import search as S
from siltstone.operators.similar import similar_pairs
from siltstone.plans import posting_plans
from siltstone.sources.tables import read


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def status_set(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that are open or half done, and of the urgent ones all."""
    orders = read(spark, sf, "orders")
    return orders.where(F.col("o_orderstatus").isin("O", "P") | (F.col("o_orderpriority") == "1-URGENT")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def optional_parameters(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    asked = {"any": (None, None), "some": (["O", "F"], ["1-URGENT"]), "none": ([], None)}
    counts = [F.count_if(S.optional_in("o_orderstatus", a) & S.optional_in("o_orderpriority", b)).alias(k) for k, (a, b) in asked.items()]
    return orders.agg(*[c.alias(f"n_{k}") for c, k in zip(counts, asked, strict=True)])


def unset_or_at_most(spark: SparkSession, sf: str) -> DataFrame:
    posted = posting_plans.normalized(spark, sf)
    return posted.where(S.at_most_or_unset("min_experience", 3)).groupBy("min_experience").agg(F.count("*").alias("n"))


def post_score(spark: SparkSession, sf: str) -> DataFrame:
    """After scoring: eligible by a name in any case, a known score of at least 50, and on the list (has an order that is half done)."""
    scored = read(spark, sf, "customer").withColumn("score", F.when(F.col("c_acctbal") > 0, F.floor(F.col("c_acctbal") / 100)))
    listed = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return scored.where((F.lower("c_mktsegment") == "building") & (F.col("score") >= 50)).join(listed, "c_custkey", "left_semi").select("c_custkey", F.col("score").cast("long").alias("score"))


def freshers(spark: SparkSession, sf: str) -> DataFrame:
    return posting_plans.normalized(spark, sf).where(R.fresher_suitable(F.col("seniority"), F.col("min_experience"))).groupBy("seniority", "min_experience").agg(F.count("*").alias("n"))


def due_for_work(spark: SparkSession, sf: str) -> DataFrame:
    """Customers whose last order is long ago or who have none, the stalest first, as many as one cycle takes."""
    last = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    rows = read(spark, sf, "customer").join(last, "c_custkey", "left").where(F.col("last").isNull() | (F.col("last") < _at("1998-01-01")))
    return rows.orderBy(F.asc_nulls_first("last"), "c_custkey").limit(200).select("c_custkey", F.date_format("last", "yyyy-MM-dd").alias("last"))


def erasure_due(spark: SparkSession, sf: str) -> DataFrame:
    """Grace is over, or the run failed, or it has been running too long."""
    orders, age = read(spark, sf, "orders"), F.col("o_orderdate")
    due = (F.col("o_orderstatus") == "O") & (age < _at("1993-01-01")) | (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "5-LOW") | (F.col("o_orderstatus") == "P") & (age < _at("1996-01-01"))
    return orders.where(due).select("o_orderkey")


def empty_or_member(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without orders, or with one of a given priority: one pass over orders rather than a query for each."""
    asked = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("member"))
    return read(spark, sf, "customer").join(asked, "c_custkey", "left").where(F.col("member").isNull() | F.col("member")).select("c_custkey")


def visible_page(spark: SparkSession, sf: str) -> DataFrame:
    """What may not be seen goes before the page is cut, so that pages are full; the service it is from cut first."""
    seen = read(spark, sf, "orders").where("o_orderpriority <> '5-LOW'")
    return seen.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20).select("o_orderkey")


def stale_policies(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers never checked, without a rule, or last checked too long before the newest shipment."""
    lines = read(spark, sf, "lineitem")
    last = lines.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_shipdate").alias("verified"))
    now = lines.agg(F.max("l_shipdate")).scalar()
    rows = read(spark, sf, "supplier").join(last, "s_suppkey", "left")
    return rows.where(F.col("verified").isNull() | (F.col("s_acctbal") < 0) | (F.col("verified") < now - F.expr("interval 30 days"))).select("s_suppkey")


def projections(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat_ws(" / ", "n_name", "c_mktsegment").alias("label"), (F.col("c_acctbal") < 0).alias("in_debt"))


def redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Names and balances are for those of the same region; others see that there is a record."""
    rows = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.col("n_regionkey") == 1
    return rows.select("c_custkey", F.when(own, F.col("c_name")).otherwise("withheld").alias("name"), F.when(own, F.col("c_acctbal")).alias("balance"), (~own).alias("redacted"))


def inner_join(spark: SparkSession, sf: str) -> DataFrame:
    named = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


def scalar_subquery_order(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by the mean of their orders, -1 for none: one aggregate beside them, not a query for each."""
    mean = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.floor(F.avg("o_totalprice")).alias("mean"))
    rows = read(spark, sf, "customer").join(mean, "c_custkey", "left").withColumn("mean", F.coalesce("mean", F.lit(-1)).cast("long"))
    return rows.orderBy(F.desc("mean"), "c_custkey").limit(100).select("c_custkey", "mean")


def similar_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of one brand and size that are the same posting in other words."""
    rows = read(spark, sf, "part").withColumn("title", F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_partkey") % 3 == 0, "new")))
    return similar_pairs(rows, ["p_brand"], "title", 0.72)


def scopes_with_members(spark: SparkSession, sf: str) -> DataFrame:
    member = read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("member")).distinct()
    return read(spark, sf, "nation").join(member, "n_nationkey", "left").select("n_name", F.coalesce("member", F.lit(False)).alias("has_member"))


def last_computed(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").where("event_type = 'purchase'").agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.max("value").alias("most"))


def already_sent(spark: SparkSession, sf: str) -> DataFrame:
    """Orders whose customer had one of the same priority and day already: EXISTS as a semi-join."""
    orders = read(spark, sf, "orders")
    keys = ["o_custkey", "o_orderpriority", "o_orderdate"]
    before = orders.groupBy(*keys).agg(F.min("o_orderkey").alias("first"))
    return orders.join(before, keys).where("o_orderkey > first").select("o_orderkey")


def deleted_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What goes with each customer of a nation that is erased, as a JSON object of counts."""
    gone = read(spark, sf, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    orders = read(spark, sf, "orders").join(gone, "o_custkey", "left_semi")
    lines = read(spark, sf, "lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    counts = [t.agg(F.lit(name).alias("kind"), F.count("*").alias("n")) for name, t in (("customers", gone), ("lines", lines), ("orders", orders))]
    every = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return every.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("deleted"))


def sheet_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A row's number in its sheet: its place in order, and one more for the heading."""
    return read(spark, sf, "conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) + 1).cast("long").alias("row"))


def ranked_nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    """By eligibility, then by a score that may be unknown, unknown last."""
    score = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    rank = F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(2)
    rows = read(spark, sf, "customer").withColumns({"score": score, "rank": rank})
    placed = S.placed(rows, "c_nationkey", "rank", "score", "c_custkey", 50.0)
    return placed.select("c_custkey", "c_nationkey", "place")


def scope_intersection(spark: SparkSession, sf: str) -> DataFrame:
    granted = read(spark, sf, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("granted"))
    target = F.when(F.col("c_nationkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("BUILDING"), F.lit("SPACE"), F.lit("MACHINERY")))
    return granted.select("c_nationkey", F.array_join(F.array_sort(R.within_scope(target, F.col("granted"))), ",").alias("scope"))


def missing_required(spark: SparkSession, sf: str) -> DataFrame:
    held = read(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("held"))
    need = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("5-LOW"))
    return held.select("o_custkey", F.array_join(F.array_except(need, F.col("held")), ",").alias("missing"))


def distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", "p_name", "p_brand")), " "))
    return read(spark, sf, "part").select("p_partkey", F.array_join(words, " ").alias("words"))


def mixed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and clicks as one stream of events; what a kind doesn't tell is null."""
    orders = read(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"))
    clicks = read(spark, sf, "events").where("event_type = 'click'").select(F.lit("click").alias("kind"), F.col("event_id").alias("id"), F.col("user_id").alias("who"))
    return orders.unionByName(clicks, allowMissingColumns=True)


def capped_names(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(F.lit(" "), x["role"], F.lit(" "))).alias("names"))
    return turns.select("conv_id", F.array_join(R.first_distinct(F.col("names"), 2), ",").alias("names"))


def truncated(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", F.substring("text", 1, 12).alias("short"), T.has_text(F.col("text")).alias("told"), T.has_text(F.regexp_replace("text", r"\S", "")).alias("rest"))


def skills(spark: SparkSession, sf: str) -> DataFrame:
    listed = F.concat(F.element_at(F.array(F.lit("- "), F.lit("• * "), F.lit(" "), F.lit("--")), (F.col("p_partkey") % 4 + 1).cast("int")), "p_name", F.lit(" "), "p_type", F.when(F.col("p_size") > 25, " and more words;.").otherwise(".,"))
    return read(spark, sf, "part").select("p_partkey", R.clean_skill(listed).alias("skill"), R.clean_skill(F.col("p_size").cast("string")).alias("short"))


CATEGORIES = {"ring": "TOOL", "bolt": "TOOL", "red": "SOFT", "blue": "SOFT", "gear": "CLOUD", "economy": "PRACTICE"}


def categories(spark: SparkSession, sf: str) -> DataFrame:
    """By a dictionary of slugs: one lookup, not a chain of tests."""
    word = T.skill_slug(F.split("p_name", " ")[1])
    known = F.create_map(*[x for k, v in CATEGORIES.items() for x in (F.lit(k), F.lit(v))])
    return read(spark, sf, "part").groupBy(F.coalesce(F.try_element_at(known, word), F.when(word.contains("develop"), "DOMAIN"), F.lit("OTHER")).alias("category")).agg(F.count("*").alias("n"))


def search_texts(spark: SparkSession, sf: str) -> DataFrame:
    fields = posting_plans.normalized(spark, sf, ["title", "normalized_title", "description", "location_raw", "work_mode", "employment_type"])
    return fields.select("k", "n", T.canonicalize(F.concat_ws(" ", "title", "normalized_title", "location_raw", "work_mode", "employment_type", F.substring("description", 1, 4000))).alias("search_text"))


def domains(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws(" ", F.col("s_name"), F.element_at(F.array(F.lit("Pvt. Ltd."), F.lit("GmbH"), F.lit("Works"), F.lit("Co., Inc")), (F.col("s_suppkey") % 4 + 1).cast("int")))
    return read(spark, sf, "supplier").select("s_suppkey", F.array_join(R.company_core(name), " ").alias("core"), F.array_join(R.domain_guesses(name), ",").alias("domains"))


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of pages, and what becomes of them when people type them."""
    typed = [F.col("url"), F.regexp_replace("url", "^https?://[^/]*", "HTTP://Localhost"), F.regexp_replace("url", "^https?", "ftp"), F.regexp_replace("url", "^https?://", ""), F.regexp_replace("url", "://([^/]*)", "://$1.TEST:8080"), F.concat(F.lit(" "), "url", F.lit("/"))]
    return read(spark, sf, "pages").select("page_id", F.posexplode(F.array(*typed)).alias("form", "typed"))


def apply_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).groupBy("form", U.valid_apply_url(F.col("typed")).alias("valid")).agg(F.count("*").alias("n"))


def canonical_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).where("form in (0, 4)").select("page_id", "form", U.canonical_url(F.col("typed")).alias("canonical"))


def boards(spark: SparkSession, sf: str) -> DataFrame:
    links = ["https://boards.greenhouse.io/embed/job_board?for={t}", "see jobs.lever.co/{t} or https://jobs.ashbyhq.com/x{t}", "https://{t}.applytojob.com/apply", "xjobs.lever.co/{t}", "https://{t}.icims.com", "nothing"]
    text = F.replace(F.element_at(F.array(*map(F.lit, links)), (F.col("s_suppkey") % 6 + 1).cast("int")), F.lit("{t}"), F.concat(F.lit("acme"), "s_suppkey"))
    return read(spark, sf, "supplier").select("s_suppkey", U.board_of(text).alias("b")).select("s_suppkey", "b.provider", "b.token")


def page_kinds(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.element_at(F.array(F.lit("/openings/1"), F.lit("/in"), F.lit("/en-in/x"), F.lit("/india.html"), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    url = F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), extra)
    return read(spark, sf, "pages").select("page_id", U.is_job_page(url).alias("job"), U.is_for_india(url).alias("india"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "pages").select("page_id", F.explode(U.links_of(F.col("html"), F.col("url"))).alias("link"))


def tokens_of_hosts(spark: SparkSession, sf: str) -> DataFrame:
    host = F.concat(F.lit("careers.my-"), F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))), F.lit(".co.in"))
    return read(spark, sf, "supplier").select("s_suppkey", F.array_join(U.board_tokens(host), ",").alias("tokens"))


def expired(spark: SparkSession, sf: str) -> DataFrame:
    """A posting's last day: an instant that is past, or a date that ended; what can't be read isn't past."""
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    day, at = F.try_to_date(F.when(said.rlike(r"^\d{4}-\d\d-\d\d$"), said), "yyyy-MM-dd"), F.try_to_timestamp(F.when(said.contains("T"), said), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    now = F.lit("1997-03-01")
    past = F.coalesce(F.date_add(day, 1) < now.cast("date"), F.unix_seconds(at) < 857_174_400, F.lit(False))
    return read(spark, sf, "orders").groupBy(past.alias("expired")).agg(F.count("*").alias("n"))


def retry_after(spark: SparkSession, sf: str) -> DataFrame:
    header = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") * 7).cast("string")).when(F.col("event_id") % 4 == 1, F.concat(F.date_format(F.to_date("ts"), "EEE, d MMM yyyy"), F.lit(" 12:00:00 GMT"))).when(F.col("event_id") % 4 == 2, "later")
    now = F.to_timestamp(F.lit("2024-01-15T11:00:00Z"))
    return read(spark, sf, "events").select("event_id", R.backoff(header, now).alias("seconds"))


def validations(spark: SparkSession, sf: str) -> DataFrame:
    """Why a line's numbers can't be right; the first reason counts."""
    why = R.problem((F.col("l_discount") > 0.08, "discount over the range"), (F.col("l_quantity") > 40, "quantity over the range"), (F.round("l_extendedprice", 0) == F.col("l_extendedprice"), "price without cents"))
    return read(spark, sf, "lineitem").groupBy(F.coalesce(why, F.lit("fine")).alias("why")).agg(F.count("*").alias("n"))


def completeness(spark: SparkSession, sf: str) -> DataFrame:
    had = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    rows = read(spark, sf, "customer").join(had, "c_custkey", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    fields = [F.col("c_acctbal") > 0, F.col("c_acctbal") > 2000, F.col("c_acctbal") > 4000, F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") > 5, F.col("c_nationkey") > 15]
    return rows.select("c_custkey", R.completeness(fields, F.col("orders"), F.col("orders") > 0, F.col("orders") > 12, F.col("c_acctbal") > 8000).cast("long").alias("completeness"))


def list_functions(spark: SparkSession, sf: str) -> DataFrame:
    sizes = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_quantity").cast("int"))).alias("q"))
    large = F.filter("q", lambda x: x > 20)
    return sizes.select("l_orderkey", F.size(large).cast("long").alias("large"), F.array_contains("q", 7).alias("seven"), F.array_max("q").alias("most"), F.array_join(F.transform(F.slice("q", 1, 2), lambda x: x * 2), ",").alias("least_twice"))


def count_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by type for each user, with a zero for each type that isn't there."""
    types = ["click", "error", "purchase", "signup", "view"]
    counts = read(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == t).alias(t) for t in types])
    return counts.select("user_id", F.to_json(F.map_from_arrays(F.array(*map(F.lit, types)), F.array(*types))).alias("counts"))


def sorted_json(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of events, nested and in three orders of names, in one form."""
    k = F.col("event_id")
    inner = F.when(k % 2 == 0, F.lit('{"b": [1.0, {"y": 2.50, "x": null}, []], "a": "é\\u00e9"}')).otherwise('{"a":"\\u00e9é" , "b":[1,{"x":null,"y":25e-1},[ ]]}')
    kind = F.concat(F.lit('"event_type": "'), "event_type", F.lit('"'))
    parts = [F.concat(F.lit('"z": '), inner), F.concat(F.lit('"props": '), "props"), kind]
    body = F.when(k % 3 == 0, F.concat_ws(", ", *parts)).when(k % 3 == 1, F.concat_ws(",", *parts[::-1])).otherwise(F.concat_ws(" , ", parts[1], parts[2], parts[0]))
    body = F.when(k % 10 == 9, "no json").otherwise(F.concat(F.lit("{"), body, F.lit("}")))
    return read(spark, sf, "events").select("event_id", T.canonical_json(body).alias("canonical"))


def to_json_or_default(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "customer").select("c_custkey", F.coalesce(F.to_json(F.when(F.col("c_acctbal") > 0, F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))), F.lit("{}")).alias("body"))


LADDER = ["INTERN", "ENTRY", "JUNIOR", "MID", "SENIOR", "LEAD", "PRINCIPAL"]


def ladder_distance(spark: SparkSession, sf: str) -> DataFrame:
    """How far a posting's level is from MID, and its score; levels that aren't on the ladder have none."""
    from siltstone.functions.numbers import seniority_score

    steps = F.array(*map(F.lit, LADDER))
    at = F.nullif(F.array_position(steps, F.col("seniority")), F.lit(0).cast("long"))
    rows = posting_plans.normalized(spark, sf).groupBy("seniority").agg(F.count("*").alias("n"))
    return rows.select("seniority", "n", F.abs(at - 4).alias("distance"), seniority_score(F.col("seniority"), F.lit("MID"), LADDER).cast("long").alias("score"))


def lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """What a second snapshot says of the first: orders up to a day, and from a day before it on, by customer."""
    orders = read(spark, sf, "orders")
    old = orders.where(F.col("o_orderdate") < _at("1996-01-01")).groupBy("o_custkey").agg(F.count("*").alias("was"))
    new = orders.where(F.col("o_orderdate") >= _at("1995-06-01")).groupBy("o_custkey").agg(F.count("*").alias("now"))
    both = old.join(new, "o_custkey", "full")
    kind = F.when(F.col("was").isNull(), "CREATED").when(F.col("now").isNull(), "CLOSED").when(F.col("now") > F.col("was"), "NEW_SOURCE_OBSERVED").otherwise("SEEN")
    return both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def numeric_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Prices written with other scales are the same; a price that isn't told any more is a change."""
    now = F.when(F.col("p_partkey") % 5 == 0, None).when(F.col("p_partkey") % 5 == 1, F.col("p_retailprice") + 0.01).otherwise(F.col("p_retailprice"))
    changed = R.changed_number(F.col("p_retailprice").cast("decimal(12,2)"), now.cast("decimal(14,4)"))
    return read(spark, sf, "part").groupBy(changed.alias("changed")).agg(F.count("*").alias("n"))


def _steps(spark: SparkSession, sf: str, states: list[str]) -> DataFrame:
    """Each event of a user as a step between two states."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    state = F.element_at(F.array(*map(F.lit, states)), (F.floor(F.col("value")) % len(states) + 1).cast("int"))
    rows = read(spark, sf, "events").withColumn("state", state)
    return rows.select("event_type", F.col("state").alias("after"), F.lag("state").over(order).alias("before")).where("before is not null")


STAGES = ["SHORTLISTED", "INVITED", "INTERESTED", "SELECTED", "NOT_PROCEEDING", "DECLINED"]


def placement_steps(spark: SparkSession, sf: str) -> DataFrame:
    actor = F.when(F.col("event_type").isin("click", "view"), "STUDENT").otherwise("STAFF")
    steps = _steps(spark, sf, STAGES)
    return steps.groupBy("before", "after", actor.alias("actor")).agg(F.count("*").alias("n")).withColumn("legal", R.may_place(F.col("before"), F.col("after"), F.col("actor")))


def requirement_steps(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf, ["DRAFT", "OPEN", "CLOSED"]).groupBy(R.may_step(F.col("before"), F.col("after"), R.REQUIREMENT).alias("legal")).agg(F.count("*").alias("n"))


def anonymised(spark: SparkSession, sf: str) -> DataFrame:
    """Erased people keep a key and nothing that tells who they are; their address follows from the key."""
    gone = F.col("c_acctbal") < 0
    return read(spark, sf, "customer").select("c_custkey", F.when(gone, F.concat(F.lit("erased-"), F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 12), F.lit("@erased.invalid"))).otherwise(F.col("c_name")).alias("name"), F.when(~gone, F.col("c_acctbal")).alias("balance"))


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that no line refers to, older than the newest day of work."""
    used = read(spark, sf, "lineitem").where("l_quantity > 48 and l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return read(spark, sf, "part").where("p_size > 5").join(used, "p_partkey", "left_anti").select("p_partkey")


def import_validation(spark: SparkSession, sf: str) -> DataFrame:
    """The first problem of each row of an import: name, address, section, repeated in the file, unknown department, known already."""
    rows = read(spark, sf, "conversations").withColumn("mail", F.concat_ws("@", "role", F.when(F.col("turn") % 5 != 4, F.concat("conv_id", F.lit(".example")))))
    # Rows without an address have another problem before that of being repeated, so they needn't meet.
    apart = F.when(~F.col("mail").contains("@"), F.xxhash64("conv_id", "turn", "text"))
    place = F.row_number().over(Window.partitionBy("mail", apart).orderBy("conv_id", "turn", "text"))
    known = read(spark, sf, "benchmark").select(F.concat(F.lit("user@"), "item_id", F.lit(".example")).alias("mail"), F.lit(True).alias("known")).distinct()
    rows = rows.withColumn("place", place).join(known, "mail", "left")
    why = R.problem((~T.has_text(F.col("text")), "no name"), (~F.col("mail").contains("@"), "no address"), (F.col("role") == "system", "unknown section"), (F.col("place") > 1, "repeated"), (F.coalesce("known", F.lit(False)), "exists"))
    return rows.groupBy(F.coalesce(why, F.lit("fine")).alias("why")).agg(F.count("*").alias("n"))


def backfill(spark: SparkSession, sf: str) -> DataFrame:
    """A column that is null is filled from the row that a key refers to."""
    orders = read(spark, sf, "orders").withColumn("segment", F.when(F.col("o_orderstatus") == "F", "KEPT"))
    found = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return orders.join(found, "o_custkey", "left").groupBy(F.coalesce("segment", "c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


def value_split(spark: SparkSession, sf: str) -> DataFrame:
    """Balances that people told themselves move to a column of their own; both columns are made from the old row."""
    told = F.col("c_mktsegment") == "HOUSEHOLD"
    return read(spark, sf, "customer").select("c_custkey", F.when(~told, F.col("c_acctbal")).alias("verified"), F.when(told, F.col("c_acctbal")).alias("reported"))


def remapped(spark: SparkSession, sf: str) -> DataFrame:
    """Names that change at once, so that targets may be old names of others."""
    names = {"1-URGENT": "2-HIGH", "2-HIGH": "3-MEDIUM", "3-MEDIUM": "1-URGENT"}
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return read(spark, sf, "orders").groupBy(F.coalesce(F.try_element_at(known, F.col("o_orderpriority")), "o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


def guarded_insert(spark: SparkSession, sf: str) -> DataFrame:
    """A default row for each region that has a nation with orders but none with the default's name."""
    nations, customers = read(spark, sf, "nation"), read(spark, sf, "customer")
    used = nations.join(customers.join(read(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"), F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    have = nations.where("n_name = 'FRANCE'").select("n_regionkey")
    return used.select("n_regionkey").distinct().join(have, "n_regionkey", "left_anti").select("n_regionkey", F.lit("default").alias("name"))


def finders(spark: SparkSession, sf: str) -> DataFrame:
    """By equality and IN; how many; whether any; and by part of a name in any case."""
    part = read(spark, sf, "part")
    some = part.where((F.col("p_type") == "PROMO") & F.col("p_size").isin(1, 2, 3)).select(F.lit("some").alias("finder"), F.col("p_partkey").cast("string").alias("found"))
    count = part.where(F.col("p_size") == 10).agg(F.lit("count").alias("finder"), F.count("*").cast("string").alias("found"))
    exists = part.agg(F.lit("exists").alias("finder"), F.bool_or(F.col("p_size") > 49).cast("string").alias("found"))
    named = part.where(S.any_contains(["p_name"], "BoLt")).agg(F.lit("named").alias("finder"), F.count("*").cast("string").alias("found"))
    return some.unionByName(count).unionByName(exists).unionByName(named)


def pruned(spark: SparkSession, sf: str) -> DataFrame:
    """What stays when rows before a time go."""
    return read(spark, sf, "events").where(F.col("ts") >= _at("2024-01-16 00:00:00")).groupBy("event_type").agg(F.count("*").alias("n"))


def exported(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's whole record as one document; what isn't for export is named."""
    lines = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    rows = read(spark, sf, "customer").join(lines, "c_custkey", "left")
    none = F.array().cast("array<struct<id:bigint,status:string>>")
    return rows.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.coalesce("orders", none).alias("orders"), F.array(F.lit("balance")).alias("left_out"))).alias("record"))


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """What each source said of a part: first and last seen, how often, and whether the newest sighting is recent."""
    seen = read(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count("*").alias("times"))
    return seen.select("l_suppkey", "l_partkey", F.date_format("first", "yyyy-MM-dd").alias("first_seen"), F.date_format("last", "yyyy-MM-dd").alias("last_seen"), "times", (F.col("last") >= _at("1998-01-01")).alias("active"))


def reopened(spark: SparkSession, sf: str) -> DataFrame:
    """Closed orders that are seen again: open again, with a row that says so."""
    seen = read(spark, sf, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("seen", F.lit(True))
    rows = read(spark, sf, "orders").join(seen, "o_orderkey", "left")
    again = (F.col("o_orderstatus") == "F") & F.col("seen")
    return rows.groupBy(F.when(again, "REOPENED").when(F.col("o_orderstatus") == "F", "CLOSED").otherwise("OPEN").alias("state")).agg(F.count("*").alias("n"))


def dimension_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Companies by the slug of their name; a site is filled in only where none is known."""
    old = read(spark, sf, "supplier").where("s_acctbal > 0").select(T.slugify(F.col("s_name")).alias("slug"), F.col("s_name").alias("name"), F.when(F.col("s_nationkey") > 10, "https://old.example").alias("site"))
    new = read(spark, sf, "supplier").where("s_suppkey > 5").select(T.slugify(F.upper("s_name")).alias("slug"), F.upper("s_name").alias("given"), F.concat(F.lit("https://"), T.slugify(F.col("s_name")), F.lit(".com")).alias("told"))
    return old.join(new, "slug", "full").select("slug", F.coalesce("name", "given").alias("name"), F.coalesce("site", "told").alias("site"))


def proposal_diff(spark: SparkSession, sf: str) -> DataFrame:
    """What a proposal would change in a customer's record, and what is left after decisions on it."""
    rows = read(spark, sf, "customer")
    offered = {"c_mktsegment": F.when(F.col("c_custkey") % 2 == 0, "BUILDING"), "c_name": F.when(F.col("c_custkey") % 3 == 0, F.upper("c_name")), "c_nationkey": F.when(F.col("c_nationkey") < 3, "7")}
    entries = F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("was"), v.alias("offered")) for k, v in offered.items()])
    diff = F.filter(entries, lambda x: x["offered"].isNotNull() & ~x["offered"].eqNullSafe(x["was"]))
    accepted = F.col("d.field") != "c_name"
    changes = rows.select("c_custkey", F.explode(diff).alias("d"))
    return changes.select("c_custkey", "d.field", F.col("d.was").alias("was"), F.col("d.offered").alias("offered"), F.when(accepted, F.col("d.offered")).otherwise(F.col("d.was")).alias("after"))


def policy_verdict(spark: SparkSession, sf: str) -> DataFrame:
    blockers = R.problems((F.col("s_acctbal") < 0, "no terms"), (F.col("s_nationkey") > 20, "robots forbid"))
    warnings = R.problems((F.col("s_acctbal") < 1000, "rate unknown"), (F.col("s_suppkey") % 2 == 0, "not verified"))
    return read(spark, sf, "supplier").select("s_suppkey", (F.size(blockers) == 0).alias("passes"), F.array_join(blockers, "; ").alias("blockers"), F.array_join(warnings, "; ").alias("warnings"))


QUERIES = {
    "flt02_status_set": status_set, "flt09_optional_parameters": optional_parameters, "flt06_unset_or_at_most": unset_or_at_most, "flt13_post_score": post_score, "flt14_freshers": freshers, "flt15_due_for_work": due_for_work,
    "flt16_erasure_due": erasure_due, "flt17_empty_or_member": empty_or_member, "flt18_visible_page": visible_page, "flt19_stale_policies": stale_policies, "prj01_projections": projections, "prj03_redacted": redacted,
    "join01_inner": inner_join, "join07_scalar_subquery": scalar_subquery_order, "join13_similar_titles": similar_titles, "join16_scopes_with_members": scopes_with_members, "agg11_last_computed": last_computed,
    "agg16_already_sent": already_sent, "agg17_deleted_counts": deleted_counts, "win10_sheet_rows": sheet_rows, "srt03_ranked_nulls_last": ranked_nulls_last, "set02_scope_intersection": scope_intersection,
    "set03_missing_required": missing_required, "set05_distinct_in_order": distinct_in_order, "set06_mixed_events": mixed_events, "set07_capped_names": capped_names, "str06_truncated": truncated, "str21_skills": skills,
    "str22_categories": categories, "str25_search_texts": search_texts, "str26_domains": domains, "str30_tokens": tokens_of_hosts, "url02_apply_urls": apply_urls, "url03_canonical_urls": canonical_urls, "url04_boards": boards,
    "url05_page_kinds": page_kinds, "url06_page_links": page_links, "dat02_expired": expired, "dat06_retry_after": retry_after, "num03_validations": validations, "num04_completeness": completeness, "arr01_list_functions": list_functions,
    "map01_count_maps": count_maps, "jsn02_sorted_json": sorted_json, "jsn03_to_json": to_json_or_default, "dom03_ladder_distance": ladder_distance, "chg02_lifecycle": lifecycle, "chg04_numeric_changes": numeric_changes,
    "stm02_placement_steps": placement_steps, "stm03_requirement_steps": requirement_steps, "gov01_anonymised": anonymised, "gov03_orphans": orphans, "gov04_import_validation": import_validation, "dml01_backfill": backfill,
    "dml02_value_split": value_split, "dml04_remapped": remapped, "dml05_guarded_insert": guarded_insert, "drv01_finders": finders, "snk02_pruned": pruned, "snk03_exported": exported, "ent04_observations": observations,
    "ent06_reopened": reopened, "ent09_dimension_upsert": dimension_upsert, "diff01_proposals": proposal_diff, "sco17_policy_verdict": policy_verdict,
}
_POSTED = posting_plans._BASE
_RING = "(['SHORTLISTED', 'INVITED', 'INTERESTED', 'SELECTED', 'NOT_PROCEEDING', 'DECLINED'])"


def _told(states: str, n: int) -> str:
    return f"with s as (select user_id, event_type, ({states})[(floor(value)::bigint % {n} + 1)::int] as after, ts, event_id from events), w as (select event_type, after, lag(after) over (partition by user_id order by ts, event_id) as before from s)"


_TYPED = """with t as (select page_id, unnest([0, 1, 2, 3, 4, 5]) as form, unnest([url, regexp_replace(url, '^https?://[^/]*', 'HTTP://Localhost'), regexp_replace(url, '^https?', 'ftp'), regexp_replace(url, '^https?://', ''),
  regexp_replace(url, '://([^/]*)', '://\\1.TEST:8080'), ' ' || url || '/']) as typed from pages)"""
_LEGAL = ", ".join(f"'{w}'" for w in R.LEGAL)
_LADDER = "list_position(['" + "', '".join(LADDER) + "'], seniority)"
ORACLE_SQL = {
    "flt02_status_set": "select o_orderstatus, count(*) as n from orders where o_orderstatus in ('O', 'P') or o_orderpriority = '1-URGENT' group by 1",
    "flt09_optional_parameters": "select count(*) as n_any, count(*) filter (o_orderstatus in ('O', 'F') and o_orderpriority = '1-URGENT') as n_some, 0::bigint as n_none from orders",
    "flt06_unset_or_at_most": f"{_POSTED} select min_experience, count(*) as n from f where min_experience is null or min_experience <= 3 group by 1",
    "flt13_post_score": "select c_custkey, floor(c_acctbal / 100)::bigint as score from customer where lower(c_mktsegment) = 'building' and c_acctbal > 0 and floor(c_acctbal / 100) >= 50 and c_custkey in (select o_custkey from orders where o_orderstatus = 'P')",
    "flt14_freshers": f"{_POSTED} select seniority, min_experience, count(*) as n from f where (seniority in ('INTERN', 'ENTRY') and (min_experience is null or min_experience <= 1)) or (seniority in ('JUNIOR', 'UNSPECIFIED') and min_experience <= 1) group by all",
    "flt15_due_for_work": "select c_custkey, strftime(last, '%Y-%m-%d') as last from (select c_custkey, max(o_orderdate) as last from customer left join orders on o_custkey = c_custkey group by 1) where last is null or last < timestamp '1998-01-01' order by last nulls first, c_custkey limit 200",
    "flt16_erasure_due": "select o_orderkey from orders where (o_orderstatus = 'O' and o_orderdate < timestamp '1993-01-01') or (o_orderstatus = 'F' and o_orderpriority = '5-LOW') or (o_orderstatus = 'P' and o_orderdate < timestamp '1996-01-01')",
    "flt17_empty_or_member": "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey) or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority in ('1-URGENT', '2-HIGH'))",
    "flt18_visible_page": "select o_orderkey from orders where o_orderpriority <> '5-LOW' order by o_totalprice desc, o_orderkey limit 20 offset 20",
    "flt19_stale_policies": "select s_suppkey from supplier left join (select l_suppkey, max(l_shipdate) as v from lineitem where l_returnflag = 'R' group by 1) on l_suppkey = s_suppkey where v is null or s_acctbal < 0 or v < (select max(l_shipdate) from lineitem) - interval 30 days",
    "prj01_projections": "select c_custkey as id, c_name as name, n_name || ' / ' || c_mktsegment as label, c_acctbal < 0 as in_debt from customer join nation on c_nationkey = n_nationkey",
    "prj03_redacted": "select c_custkey, case when n_regionkey = 1 then c_name else 'withheld' end as name, case when n_regionkey = 1 then c_acctbal end as balance, n_regionkey <> 1 as redacted from customer join nation on c_nationkey = n_nationkey",
    "join01_inner": "select n_name, c_mktsegment, count(*) as n, min(o_orderkey) as first_order from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all",
    "join07_scalar_subquery": "select c_custkey, coalesce((select floor(avg(o_totalprice)) from orders where o_custkey = c_custkey), -1)::bigint as mean from customer order by mean desc, c_custkey limit 100",
    "join13_similar_titles": """with t as (select distinct p_brand, p_name || ' ' || p_type || case when p_partkey % 3 = 0 then ' new' else '' end as title from part), s as (select p_brand, list_sort(list_distinct(string_split(lower(title), ' '))) as w, min(title) as title from t group by 1, 2)
      select x.p_brand, x.title as a, y.title as b, len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) as similarity from s x join s y on x.p_brand = y.p_brand and x.title < y.title where len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) >= 0.72""",
    "join16_scopes_with_members": "select n_name, exists (select 1 from customer where c_nationkey = n_nationkey and c_acctbal > 9000) as has_member from nation",
    "agg11_last_computed": "select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last, max(value) as most from events where event_type = 'purchase'",
    "agg16_already_sent": "select o_orderkey from orders a where exists (select 1 from orders b where b.o_custkey = a.o_custkey and b.o_orderpriority = a.o_orderpriority and b.o_orderdate = a.o_orderdate and b.o_orderkey < a.o_orderkey)",
    "agg17_deleted_counts": """with c as (select c_custkey from customer where c_nationkey = 3), o as (select o_orderkey from orders where o_custkey in (from c)), l as (select 1 from lineitem where l_orderkey in (from o))
      select '{"customers":' || (select count(*) from c) || ',"lines":' || (select count(*) from l) || ',"orders":' || (select count(*) from o) || '}' as deleted""",
    "win10_sheet_rows": "select conv_id, turn, row_number() over (partition by conv_id order by turn, role, text) + 1 as row from conversations",
    "srt03_ranked_nulls_last": "select c_custkey, c_nationkey, row_number() over (partition by c_nationkey order by case c_mktsegment when 'BUILDING' then 0 when 'MACHINERY' then 1 else 2 end, case when c_acctbal > 0 then c_acctbal end desc nulls last, c_custkey) as place from customer",
    "set02_scope_intersection": "select c_nationkey, coalesce(string_agg(distinct c_mktsegment, ',' order by c_mktsegment) filter (c_nationkey % 4 = 0 or c_mktsegment in ('BUILDING', 'SPACE', 'MACHINERY')), '') as scope from customer group by 1",
    "set03_missing_required": "select o_custkey, array_to_string(list_filter(['1-URGENT', '2-HIGH', '5-LOW'], lambda x: not list_contains(h, x)), ',') as missing from (select o_custkey, list(o_orderpriority) as h from orders group by 1)",
    "set05_distinct_in_order": "select p_partkey, (select string_agg(w, ' ' order by k) from (select w, min(k) as k from (select unnest(ws) as w, generate_subscripts(ws, 1) as k) group by w)) as words from (select p_partkey, string_split(lower(p_name || ' ' || p_type || ' ' || p_name || ' ' || p_brand), ' ') as ws from part)",
    "set06_mixed_events": "select 'order' as kind, o_orderkey as id, o_totalprice as amount, null::bigint as who from orders union all select 'click', event_id, null, user_id from events where event_type = 'click'",
    "set07_capped_names": "select conv_id, array_to_string((list(role order by k, role))[1:2], ',') as names from (select conv_id, role, min(turn) as k from conversations group by 1, 2) group by 1",
    "str06_truncated": "select conv_id, turn, text[1:12] as short, coalesce(regexp_matches(text, '[^[:space:]]'), false) as told, false as rest from conversations",
    "str21_skills": "select p_partkey, case when p_size <= 25 then p_name || ' ' || p_type end as skill, case when length(p_size::varchar) between 2 and 60 then p_size::varchar end as short from part",
    "str22_categories": "select case split_part(p_name, ' ', 2) " + " ".join(f"when '{k}' then '{v}'" for k, v in CATEGORIES.items()) + " else 'OTHER' end as category, count(*) as n from part group by 1",
    "str25_search_texts": f"{_POSTED} select k, n, {posting_plans._CANON.format("concat_ws(' ', title, normalized_title, location_raw, work_mode, employment_type, description[1:4000])")} as search_text from f",
    "str26_domains": f"""with s as (select s_suppkey, list_filter(string_split_regex(lower(regexp_replace(s_name || ' ' || (['Pvt. Ltd.', 'GmbH', 'Works', 'Co., Inc'])[(s_suppkey % 4 + 1)::int], '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' and w not in ({_LEGAL})) as core from supplier)
      select s_suppkey, array_to_string(core, ' ') as core, array_to_string(flatten(list_transform([core[1], array_to_string(core, '')], lambda x: [x || '.com', x || '.in', x || '.co.in', x || '.io'])), ',') as domains from s""",
    "str30_tokens": "select s_suppkey, 'my-' || lower(replace(s_name, '#', '-')) || ',' || replace('my' || lower(replace(s_name, '#', '-')), '-', '') as tokens from supplier",
    "url02_apply_urls": f"{_TYPED}, v as (select form, typed, lower(regexp_extract(typed, '://([^/:?#]*)', 1)) as host from t) select form, regexp_matches(trim(typed), '(?i)^https?://') and contains(host, '.') and host not in ('example.com', 'example.org', 'example.net') and not regexp_matches(host, '\\.(example|invalid|test|localhost|local)$') as valid, count(*) as n from v group by all",
    "url03_canonical_urls": f"{_TYPED}, p as (select page_id, form, split_part(typed, '#', 1) as u from t where form in (0, 4)), q as (select *, split_part(u, '?', 1) as base, case when contains(u, '?') then '?' || split_part(u, '?', 2) else '' end as query from p) select page_id, form, lower(regexp_extract(base, '^[^/]*//[^/]*')) || case when regexp_matches(base, '^[^/]*//[^/]*/$') then '/' else regexp_replace(regexp_replace(base, '^[^/]*//[^/]*', ''), '/$', '') end || query as canonical from q",
    "url04_boards": "select s_suppkey, case s_suppkey % 6 when 0 then 'GREENHOUSE' when 1 then 'LEVER' when 2 then 'JAZZHR' when 4 then 'ICIMS' end as provider, case when s_suppkey % 6 in (0, 1, 2, 4) then 'acme' || s_suppkey end as token from supplier",
    "url05_page_kinds": "select page_id, page_id % 5 = 0 as job, regexp_matches(lower(regexp_extract(url, '://([^/:]*)', 1)), '\\.in$') or page_id % 5 in (1, 2, 3) as india from pages",
    "url06_page_links": """with h as (select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) as origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''#\\s]+)', 1)) as x from pages),
      w as (select page_id, origin, case when regexp_matches(x, '(?i)^https?://') then x when starts_with(x, '//') then scheme || ':' || x when starts_with(x, '/') then origin || x when not regexp_matches(x, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then origin || case when contains(path, '/') then regexp_replace(path, '[^/]*$', '') else '/' end || x end as link from h)
      select distinct page_id, link from w where starts_with(link, origin || '/') and not regexp_matches(split_part(link, '?', 1), '(?i)\\.(css|js|png|jpe?g|gif|svg|ico|woff2?|pdf|zip|xml)$')""",
    "dat02_expired": "select case o_orderkey % 3 when 0 then o_orderdate::date < date '1997-03-01' when 1 then o_orderdate::date + 1 < date '1997-03-01' else false end as expired, count(*) as n from orders group by 1",
    "dat06_retry_after": "select event_id, case event_id % 4 when 0 then least(14400, event_id * 7) when 1 then least(14400, greatest(0, epoch(ts::date)::bigint + 43200 - 1705316400)) else 300 end::bigint as seconds from events",
    "num03_validations": "select case when l_discount > 0.08 then 'discount over the range' when l_quantity > 40 then 'quantity over the range' when round(l_extendedprice, 0) = l_extendedprice then 'price without cents' else 'fine' end as why, count(*) as n from lineitem group by 1",
    "num04_completeness": "select c_custkey, least(100, 10 * ((c_acctbal > 0)::int + (c_acctbal > 2000)::int + (c_acctbal > 4000)::int + (c_mktsegment = 'BUILDING')::int + (c_nationkey > 5)::int + (c_nationkey > 15)::int + (o > 0)::int) + 5 * ((o > 12)::int + (c_acctbal > 8000)::int) + case when o >= 8 then 20 when o >= 3 then 12 when o > 0 then 6 else 0 end)::bigint as completeness from (select c_custkey, any_value(c_acctbal) as c_acctbal, any_value(c_mktsegment) as c_mktsegment, any_value(c_nationkey) as c_nationkey, count(o_orderkey) as o from customer left join orders on o_custkey = c_custkey group by 1)",
    "arr01_list_functions": "select l_orderkey, count(*) filter (q > 20) as large, bool_or(q = 7) as seven, max(q) as most, array_to_string(list_transform((list(q order by q))[1:2], lambda x: x * 2), ',') as least_twice from (select l_orderkey, l_quantity::int as q from lineitem) group by 1",
    "map01_count_maps": "select user_id, '{' || string_agg('\"' || t || '\":' || n, ',' order by t) || '}' as counts from (select user_id, t, count(event_type) as n from (select distinct user_id from events) cross join (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as t) left join events e using (user_id) where true and (e.event_type = t) group by 1, 2 union all select u.user_id, t, 0 from (select distinct user_id from events) u cross join (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as t) where not exists (select 1 from events e where e.user_id = u.user_id and e.event_type = t)) group by 1",
    "jsn02_sorted_json": """select event_id, case when event_id % 10 <> 9 then '{"event_type":"' || event_type || '","props":' || replace(props, ' ', '') || ',"z":{"a":"éé","b":[1,{"x":null,"y":2.5},[]]}}' end as canonical from events""",
    "jsn03_to_json": "select c_custkey, case when c_acctbal > 0 then '{\"id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}' else '{}' end as body from customer",
    "dom03_ladder_distance": f"{_POSTED} select seniority, count(*) as n, abs({_LADDER} - 4)::bigint as distance, case abs({_LADDER} - 4) when 0 then 100 when 1 then 80 when 2 then 55 when 3 then 25 end::bigint as score from f group by 1",
    "chg02_lifecycle": "select case when was = 0 then 'CREATED' when now = 0 then 'CLOSED' when now > was then 'NEW_SOURCE_OBSERVED' else 'SEEN' end as kind, count(*) as n from (select o_custkey, count(*) filter (o_orderdate < timestamp '1996-01-01') as was, count(*) filter (o_orderdate >= timestamp '1995-06-01') as now from orders group by 1) group by 1",
    "chg04_numeric_changes": "select p_partkey % 5 in (0, 1) as changed, count(*) as n from part group by 1",
    "stm02_placement_steps": f"{_told(_RING, 6)} select before, after, actor, count(*) as n, case actor when 'STAFF' then (before, after) in (('SHORTLISTED', 'INVITED'), ('SHORTLISTED', 'NOT_PROCEEDING'), ('INVITED', 'NOT_PROCEEDING'), ('INTERESTED', 'SELECTED'), ('INTERESTED', 'NOT_PROCEEDING')) else (before, after) in (('INVITED', 'INTERESTED'), ('INVITED', 'DECLINED')) end as legal from (select *, case when event_type in ('click', 'view') then 'STUDENT' else 'STAFF' end as actor from w where before is not null) group by all",
    "stm03_requirement_steps": f"{_told("(['DRAFT', 'OPEN', 'CLOSED'])", 3)} select (before, after) in (('DRAFT', 'OPEN'), ('DRAFT', 'CLOSED'), ('OPEN', 'CLOSED'), ('CLOSED', 'OPEN')) as legal, count(*) as n from w where before is not null group by 1",
    "gov01_anonymised": "select c_custkey, case when c_acctbal < 0 then 'erased-' || sha256(c_custkey::varchar)[1:12] || '@erased.invalid' else c_name end as name, case when not c_acctbal < 0 then c_acctbal end as balance from customer",
    "gov03_orphans": "select p_partkey from part where p_size > 5 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 48 and l_returnflag = 'R')",
    "gov04_import_validation": """with m as (select *, role || case when turn % 5 <> 4 then '@' || conv_id || '.example' else '' end as mail from conversations), p as (select *, row_number() over (partition by mail order by conv_id, turn, text) as place from m)
      select case when not coalesce(regexp_matches(text, '[^[:space:]]'), false) then 'no name' when not contains(mail, '@') then 'no address' when role = 'system' then 'unknown section' when place > 1 then 'repeated' when mail in (select 'user@' || item_id || '.example' from benchmark) then 'exists' else 'fine' end as why, count(*) as n from p group by 1""",
    "dml01_backfill": "select coalesce(case when o_orderstatus = 'F' then 'KEPT' end, (select c_mktsegment from customer where c_custkey = o_custkey)) as segment, count(*) as n from orders group by 1",
    "dml02_value_split": "select c_custkey, case when c_mktsegment <> 'HOUSEHOLD' then c_acctbal end as verified, case when c_mktsegment = 'HOUSEHOLD' then c_acctbal end as reported from customer",
    "dml04_remapped": "select case o_orderpriority when '1-URGENT' then '2-HIGH' when '2-HIGH' then '3-MEDIUM' when '3-MEDIUM' then '1-URGENT' else o_orderpriority end as priority, count(*) as n from orders group by 1",
    "dml05_guarded_insert": "select distinct n_regionkey, 'default' as name from nation a where exists (select 1 from customer join orders on o_custkey = c_custkey where c_nationkey = n_nationkey) and not exists (select 1 from nation b where b.n_regionkey = a.n_regionkey and b.n_name = 'FRANCE')",
    "drv01_finders": "select 'some' as finder, p_partkey::varchar as found from part where p_type = 'PROMO' and p_size in (1, 2, 3) union all select 'count', count(*)::varchar from part where p_size = 10 union all select 'exists', bool_or(p_size > 49)::varchar from part union all select 'named', count(*)::varchar from part where contains(lower(p_name), 'bolt')",
    "snk02_pruned": "select event_type, count(*) as n from events where not ts < timestamp '2024-01-16' group by 1",
    "snk03_exported": """select c_custkey, '{"id":' || c_custkey || ',"name":"' || c_name || '","orders":[' || coalesce((select string_agg('{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}', ',' order by o_orderkey) from orders where o_custkey = c_custkey), '') || '],"left_out":["balance"]}' as record from customer""",
    "ent04_observations": "select l_suppkey, l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') as first_seen, strftime(max(l_shipdate), '%Y-%m-%d') as last_seen, count(*) as times, max(l_shipdate) >= timestamp '1998-01-01' as active from lineitem group by 1, 2",
    "ent06_reopened": "select case when o_orderstatus = 'F' and o_orderkey in (select l_orderkey from lineitem where l_linestatus = 'O') then 'REOPENED' when o_orderstatus = 'F' then 'CLOSED' else 'OPEN' end as state, count(*) as n from orders group by 1",
    "ent09_dimension_upsert": """with s as (select *, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from supplier) select slug, case when s_acctbal > 0 then s_name else upper(s_name) end as name,
      coalesce(case when s_acctbal > 0 and s_nationkey > 10 then 'https://old.example' end, case when s_suppkey > 5 then 'https://' || slug || '.com' end) as site from s where s_acctbal > 0 or s_suppkey > 5""",
    "diff01_proposals": """with d as (select c_custkey, unnest([{'field': 'c_mktsegment', 'was': c_mktsegment, 'offered': case when c_custkey % 2 = 0 then 'BUILDING' end}, {'field': 'c_name', 'was': c_name, 'offered': case when c_custkey % 3 = 0 then upper(c_name) end},
      {'field': 'c_nationkey', 'was': c_nationkey::varchar, 'offered': case when c_nationkey < 3 then '7' end}], recursive := true) from customer) select c_custkey, field, was, offered, case when field <> 'c_name' then offered else was end as after from d where offered is not null and offered is distinct from was""",
    "sco17_policy_verdict": "select s_suppkey, not (s_acctbal < 0 or s_nationkey > 20) as passes, concat_ws('; ', case when s_acctbal < 0 then 'no terms' end, case when s_nationkey > 20 then 'robots forbid' end) as blockers, concat_ws('; ', case when s_acctbal < 1000 then 'rate unknown' end, case when s_suppkey % 2 = 0 then 'not verified' end) as warnings from supplier",
}
