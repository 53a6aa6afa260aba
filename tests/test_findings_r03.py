"""What the reviewer of round 3 found, on small tables."""

from siltstone.plans import registry
from tests.oracle import check

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_any_order_keeps_a_customer_from_the_anti_join(spark, tmp_path):
    """join05_anti"""
    spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(1, "5-LOW", 10.0), (None, "1-URGENT", 300000.0), (3, "1-URGENT", 300000.0)]
    spark.createDataFrame(orders, "o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.c_custkey for r in QUERIES["join05_anti"](spark, str(tmp_path)).collect()] == [2]


def test_a_crawl_reads_the_listing_of_a_host_with_many_pages(spark, tmp_path):
    """src12_crawl: a listing of 3,000 postings was over the limit of a block, and none of it was read."""
    pages = spark.range(3000).selectExpr("id as page_id", "concat('https://one.example/en/', id % 1700) as url").coalesce(1)
    pages.write.parquet(f"{tmp_path}/pages")
    next((tmp_path / "pages").glob("*.parquet")).rename(tmp_path / "pages.parquet")
    assert check(QUERIES["src12_crawl"](spark, str(tmp_path)), SQL["src12_crawl"], str(tmp_path)) == 40


def test_a_pair_is_scored_once_however_often_its_score_is_used(spark, tiny):
    """sco15_routing: the plan held some 60 copies of all dimensions, one for each use of a score in a filter."""
    plan = QUERIES["sco15_routing"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("array_intersect") <= 3


def test_skills_are_found_once_for_those_that_are_stated(spark, tiny):
    """txt06_kept_skills: the texts were gone through a second time for the rows of urgent orders."""
    assert QUERIES["txt06_kept_skills"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_rows_of_one_split_are_dealt_over_the_cores(spark, tiny):
    """txt01_normalized and its fields, txt08_resume_fields, txt07_redacted: one task had all rows of a small file."""
    for name in ("txt01_normalized", "str10_titles", "txt08_resume_fields", "txt07_redacted"):
        assert QUERIES[name](spark, tiny).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism, name


def test_a_feed_is_read_once_and_each_text_sought_once(spark, tiny):
    """src03 to src08, src10, src11: filters brought copies of all reading along, and each text was sought four times or more."""
    plan = QUERIES["src08_breezy"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert plan.count("$.friendly_id, StringType") <= 1 and plan.count("$.name, StringType") == 1


def test_what_begins_with_no_year_is_no_instant(spark):
    """src08_breezy: three forms were tried on it, each failing with an exception."""
    from pyspark.sql import functions as F

    from siltstone.functions.numbers import lenient_instant

    given = {"soon": None, "": None, " 2024-01-02": None, "2024-01-02": 1704153600, "2024-01-02T00:00:00Z": 1704153600, "2024-01-02 00:00:00 UTC": 1704153600, "+12024-01-02": 317273673600, "20240102": None}
    rows = spark.createDataFrame(list(given.items()), "text string, at long").select("text", "at", F.unix_seconds(lenient_instant(F.col("text"))).alias("got"))
    assert not [r for r in rows.collect() if r.got != r["at"]]


def test_fields_are_found_only_where_they_are_wanted(spark, tiny):
    """str12_work_modes, str15_experience, str17_sections: years, pay and places were found for each of them and thrown away."""
    places, years, pay = "[•|;]", "(?:years?|yrs?)", "$₹€£"
    for name, spared in (("str12_work_modes", [years, pay, places]), ("str15_experience", [pay, places]), ("str17_sections", [years, pay, places])):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in spared if x in plan], name


def test_tokens_of_a_title_are_found_once(spark, tiny):
    """sco11_components: the tokens of both texts were found for the intersection and again for the union, for each target."""
    plan = QUERIES["sco11_components"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_union" not in plan and plan.count("translate(") <= 2
