"""Postings of pages: what is found, which of two copies stays, what is trusted, and how a crawl is merged."""

import json

from pyspark.sql import functions as F

from siltstone.sources import jsonld


def page(*values, kind="application/ld+json"):
    return "<html>" + "".join(f'<script type="{kind}">{v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}</script>' for v in values)


def job(title="T", **more):
    return {"@type": "JobPosting", "title": title, **more}


def titles(html):
    return [json.loads(x).get("title") for x in jsonld.postings_of(html)]


def test_where_postings_are():
    deep = job("deep")
    for _ in range(15):
        deep = {"@graph": [deep]}
    assert titles(page(deep)) == ["deep"]
    assert titles(page({"@graph": [job("a"), [job("b", **{"@graph": [job("c")]})], 7, None]}, [[[job("d")]]])) == ["a", "b", "c", "d"]
    assert titles(page({"mainEntity": job("not there")})) == []
    assert titles("<!-- " + page(job("a")) + " -->" + page(job("b"))) == ["b"] and titles("<!-- " + page(job("a"))) == []
    assert titles(page("{broken", job("a"))) == ["a"] and titles(page(json.dumps(job()) + " 1")) == [] and titles(page(job("a"))[:-9]) == []
    assert titles("<SCRIPT\ndata-x='>' TYPE = application/LD+json;v=1 >" + json.dumps(job("a")) + "</Script >") == ["a"]
    assert titles("<script type='application/ld+json" + page(job("a"))) == [] and titles(page(job("a"), kind="text/javascript")) == []
    assert titles("<scripty type=application/ld+json>" + json.dumps(job("a")) + "</script>") == []
    for wrapped in ("<!--%s-->", "//<![CDATA[%s//]]>", "<![CDATA[ %s ]]>"):
        assert titles(page(wrapped % json.dumps(job("a")))) == ["a"] or wrapped.startswith("<!--")


def test_vocabularies():
    def found(context, kind="JobPosting", **above):
        inner = {"@type": kind} | ({} if context == "none" else {"@context": context})
        return len(jsonld.postings_of(page({"@graph": [inner], **above})))

    assert [found(c) for c in ("none", None, "https://schema.org", "http://www.Schema.org/", ["x", {"@vocab": "https://schema.org/"}], {"@vocab": "https://schema.org"})] == [1] * 6
    assert [found(c) for c in ("https://other.org", {"job": "https://schema.org"}, [], 7, "schema.org")] == [0] * 5
    assert found("none", **{"@context": "https://other.org"}) == 0 and found("https://schema.org", **{"@context": "https://other.org"}) == 1
    assert found("https://other.org", ["Thing", "https://schema.org/JobPosting"]) == 1 and found("none", "schema:JobPosting") == 1 and found("none", "jobposting") == 0


def test_limits():
    assert len(titles(page(*[job(str(i)) for i in range(40)]))) == 32  # blocks
    assert titles(page("[" * 33 + "]" * 33, "[" * 31 + json.dumps(job("a")) + "]" * 31)) == ["a"]  # depth
    assert titles(page("[" * 100_000, job("a"))) == ["a"]
    assert titles(page(job("a", x=[0] * 19_000), job("b", x=[0] * 20_000))) == ["a"]  # tokens
    assert titles(page(json.dumps(job("a"))[:-1] + ',"n":' + "1" * 64 + "}", json.dumps(job("b"))[:-1] + ',"n":' + "1" * 65 + "}")) == ["a"]
    assert titles(page(job("a", description="é" * 120_000), job("b", description="é" * 140_000))) == ["a"]  # bytes
    assert titles(page(job("a", **{"k" * 1025: 1}), json.dumps(job("b"))[:-1] + ',"n":NaN}')) == []


def test_time_is_linear():
    for text in ("<script " * 200_000, "<!--" * 400_000, "<script>" * 200_000, "<script type='" * 100_000, '<script type="application/ld+json">' * 50_000):
        assert jsonld.postings_of(text) == []


def rows_of(spark, pages, **more):
    df = spark.createDataFrame([(i, h, f"https://a.dev/{i}", "x") for i, h in enumerate(pages)], "id long, html string, url string, name string")
    return df, jsonld.posting_nodes(df.drop("name"), "id", **more)


def test_which_copy_stays(spark):
    poor, rich = job("A b", identifier="7"), job("a", identifier={"value": 7}, url=None, skills="x", sameAs="y")
    by_url = [job(" One  two", url="HTTPS://A.dev/x/#f"), job("one TWO", url="https://a.dev/x", skills="s"), job("one two", url="https://a.dev/y")]
    pages = [page(poor, job("B"), rich), page(*by_url), page(job("same", b=1), {"title": "same", "b": 1.0, "@type": "JobPosting"}), None, "", page(*[job(str(i // 2), identifier=str(i // 2), place=i) for i in range(12)])]
    _, nodes = rows_of(spark, pages)
    got = sorted((r["id"], r["place"], json.loads(r["json"])["title"]) for r in nodes.collect())
    assert got[:5] == [(0, 0, "a"), (0, 1, "B"), (1, 0, "one TWO"), (1, 2, "one two"), (2, 0, "same")] and len(got) == 11
    _, few = rows_of(spark, pages, most=3)
    assert sorted((r["id"], r["place"]) for r in few.collect() if r["id"] == 5) == [(5, 0), (5, 2), (5, 4)]
    assert rows_of(spark, [])[1].collect() == []


def test_fields(spark):
    place = {"@type": "Place", "address": {"addressLocality": " Pune ", "addressRegion": "Maharashtra", "addressCountry": {"name": "in"}}}
    pay = {"currency": "eur", "value": {"minValue": "10.50", "maxValue": 12e3, "unitText": "hour"}}
    pages = [
        page(job(" T ", identifier={"value": "r1"}, jobLocation=[place, {"name": "HQ"}, {"address": "Oslo"}, place, {"address": {"addressLocality": "Bari", "addressRegion": "Puglia"}}], employmentType=["FULL", "FULL"], baseSalary=pay, url="https://evil.dev/x", hiringOrganization={"name": "Other"})),
        page(job("u", url="https://jobs.lever.co/acme/1", employmentType=["A", "B"], jobLocationType="TeleCommute", baseSalary={"currency": "EUR", "value": {"minValue": 3, "maxValue": 2, "unitText": "YEAR"}})),
        page(job("v", url="https://a.dev/2?x=1", mainEntityOfPage={"@id": "https://a.dev/m"}, baseSalary={"currency": "USD", "value": {"value": 5, "unitText": "MONTH"}})),
        page(job("", identifier="x"), job("no id")),
        page(job("w", identifier="i" * 300)),
    ]
    _, nodes = rows_of(spark, pages)
    got = {r["id"]: r for r in jsonld.raw_postings(nodes, F.lit("Mine"), F.col("url"), own_page=F.col("id") == 0).collect()}
    assert sorted(got) == [0, 1, 2, 4] and {r["company_name"] for r in got.values()} == {"Mine"}
    assert [got[0][c] for c in ("external_id", "requisition_id", "title", "location_text", "employment_type_text", "salary_text", "apply_url")] == ["r1", "r1", "T", "Pune, Maharashtra, India • HQ • Oslo • Bari", "FULL", "€10.5 - €12000 per hour", "https://a.dev/0"]
    assert [got[1][c] for c in ("external_id", "employment_type_text", "work_mode_text", "salary_text", "apply_url")] == ["https://jobs.lever.co/acme/1", None, "remote", None, "https://jobs.lever.co/acme/1"]
    assert [got[2][c] for c in ("external_id", "salary_text", "apply_url", "location_text")] == ["https://a.dev/2?x=1", "$5 - $5 per month", "https://a.dev/2?x=1", None]
    assert got[4]["external_id"].startswith("sha256:") and len(got[4]["external_id"]) == 71 and len(got[4]["requisition_id"]) == 120


def test_crawl(spark):
    def shown(i, **more):
        return job(f"listed {i}", identifier=f"p{i}", url=f"https://a.dev/{i}", **more)

    listing = page([shown(1), shown(2), shown(3), shown(4), shown(5, validThrough="2020-01-01"), shown(6), shown(9)])
    old = "2024-05-31"
    pages = [
        ("a", 1, 200, page(job("own 1", identifier="p1")), True), ("a", 2, 404, None, True), ("a", 3, 500, None, True), ("a", 4, 200, page(job("own 4", identifier="p4", validThrough=old)), True),
        ("a", 5, 200, page(job("own 5")), True), ("a", 6, 410, None, False), ("a", 7, 200, page(job("x", identifier="q1"), job("y")), True), ("a", 8, 200, page(job("z", identifier="p1")), True), ("a", 9, 410, None, True),
    ]
    pages = spark.createDataFrame([(s, i, f"https://a.dev/{i}", st, h, ok) for s, i, st, h, ok in pages], "source string, place int, url string, status int, html string, allowed boolean")
    listings = spark.createDataFrame([("a", "https://a.dev/jobs", listing), ("b", "https://b.dev", "nothing")], "source string, url string, html string")
    at = F.lit("2024-06-01T00:00:01Z").cast("timestamp")
    got = [(r["external_id"], r["title"], r["own"]) for r in jsonld.crawled(listings, pages, at).orderBy("rank").collect()]
    # 2 is withdrawn, 6 wasn't asked, 3 couldn't be read, 4 has ended on its own page but is still claimed.
    assert got == [("p1", "own 1", True), ("https://a.dev/5", "own 5", True), ("q1", "x", True), ("p3", "listed 3", False), ("p4", "listed 4", False), ("p6", "listed 6", False)]
    few = [(r["external_id"], r["title"]) for r in jsonld.crawled(listings, pages, at, budget=1, most=3).orderBy("rank").collect()]
    assert few == [("p1", "own 1"), ("p2", "listed 2"), ("p3", "listed 3")]
    assert jsonld.crawled(listings.limit(0), pages.limit(0), at).collect() == []


def test_when_a_posting_has_ended(spark):
    given = ["2024-05-31", "2024-06-01", "2024-05-31T23:59:59Z", "2024-06-01T01:00:00+02:00", "2024-06-01T00:00:00Z", "soon", None, "2024-05-30T10:00:00"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string").orderBy("i")
    at = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    assert [r[0] for r in df.select(jsonld.has_expired(F.col("t"), at)).collect()] == [False, False, True, True, False, False, False, True]
