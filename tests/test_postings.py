"""Fields of postings, feeds, robots rules, JSON-LD and records by cases."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from siltstone.functions import postings as P
from siltstone.functions import records as R
from siltstone.functions import urls as U
from siltstone.operators import robots
from siltstone.operators.similar import similar_pairs
from siltstone.sources import feeds, jsonld


def values(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_titles(spark):
    given = ["Data Engineer (Remote)", "Welder - Contract", "Nurse m/w/d", "Clerk II", "(remote)", " ", None, "Baker [3 openings]"]
    assert values(spark, given, P.normalized_title) == ["data engineer", "welder", "nurse", "clerk", "remote", None, None, "baker"]


def test_places(spark):
    given = ["Lyon, Rhone, France", "Austin, TX", "Remote", "remote, Spain", "Graz | Wien | Austria", "Graz; XY", "  ", "Ulm,,"]
    found = values(spark, given, P.location)
    assert [(f["city"], f["region"], f["country"]) for f in found] == [
        ("Lyon", "Rhone", "France"), ("Austin", "TX", None), (None, None, None), (None, None, "Spain"), ("Graz", None, "Austria"), ("Graz", None, None), (None, None, None), ("Ulm", None, None),
    ]
    assert found[6]["raw"] is None and found[2]["raw"] == "Remote"


def test_years_and_pay(spark):
    years = values(spark, ["from 2 to 4 yrs", "9-3 years, 5+ years", "min. 6 years", "50+ years", None], P.experience)
    assert [(y["least"], y["most"]) for y in years] == [(2, 4), (5, None), (6, None), (None, None), (None, None)]
    pay = values(spark, ["€40k – €60k", "$12.50-$20 hourly", "£900 to 800", "no pay", "₹1,00,000-2,00,000 per month"], P.salary)
    assert [(p["low"], p["high"], p["currency"], p["period"]) for p in pay] == [
        (Decimal(40000), Decimal(60000), "EUR", "ANNUAL"), (Decimal("12.5"), Decimal(20), "USD", "HOURLY"), (None,) * 4, (None,) * 4, (Decimal(100000), Decimal(200000), "INR", "MONTHLY"),
    ]


def test_sections(spark):
    text = "Intro\nResponsibilities:\n- bake\n- clean\n\nQualifications\nflour skills\nOur Benefits\nbread"
    assert values(spark, [text, "Nothing", None], lambda x: P.section(x, P.DUTIES)) == ["- bake\n- clean", None, None]
    assert values(spark, [text], lambda x: P.section(x, P.WANTED)) == ["flour skills"]


def test_modes_and_levels(spark):
    none = F.lit(None).cast("string")
    given = [("remote or office", "x", None, ""), (None, "Clerk (hybrid)", "Remote", ""), (None, "Clerk", "Remote - UK", "hybrid role"), (None, "Clerk", "Rome", "a fully remote team"), (None, None, None, "")]
    df = spark.createDataFrame(given, "s string, t string, p string, e string").select(P.work_mode(F.col("s"), F.col("t"), F.col("p"), F.col("e")).alias("m"))
    assert [r.m for r in df.collect()] == ["REMOTE", "HYBRID", "REMOTE", "REMOTE", "UNSPECIFIED"]
    levels = values(spark, ["Internal auditor", "Intern", "Senior Staff", "Sr. cook", "Graduate", None], lambda x: P.seniority(x, F.lit("")))
    assert levels == ["UNSPECIFIED", "INTERN", "LEAD", "SENIOR", "ENTRY", "UNSPECIFIED"]
    assert values(spark, ["Contract", None], lambda x: P.employment_type(x, F.lit("full time"))) == ["CONTRACT", "FULL_TIME"]
    assert spark.range(1).select(P.work_mode(none, none, none, F.lit("")).alias("m")).first().m == "UNSPECIFIED"


BODIES = {
    "greenhouse": ({"jobs": [{"id": 1, "title": " A ", "content": "&lt;b&gt;x&lt;/b&gt;", "location": {"name": "Bonn"}, "first_published": "2024-05-01T10:00:00+02:00"}, {"title": "no id"}, {"id": {"x": 1}}]}, [("1", "A", "me", "Bonn")]),
    "lever": ([{"id": "a", "text": "B", "categories": {"location": "Rom"}, "createdAt": 1714550400000}], [("a", "B", "me", "Rom")]),
    "ashby": ({"jobs": [{"id": "a", "title": "C", "isListed": False}, {"id": "b", "title": "D", "isListed": "no", "location": ""}]}, [("b", "D", "me", None)]),
    "smartrecruiters": ({"content": [{"id": "7", "name": "E", "company": {"name": "F"}, "location": {"city": "Ulm", "region": " ", "country": "de"}}]}, [("7", "E", "F", "Ulm, de")]),
    "workable": ({"name": "G", "jobs": [{"shortcode": "s", "title": "H", "city": "X", "country": "Y", "telecommuting": True}]}, [("s", "H", "G", "X, Y")]),
    "breezy": ([{"id": "9", "name": "I", "location": {"city": {"name": "Oslo"}, "country": "NO"}}], [("9", "I", None, "Oslo, NO")]),
    "sample": ({"jobs": [{"externalId": "q", "title": "J", "companyName": "K", "location": "L"}, {"externalId": None}]}, [("q", "J", "K", "L")]),
}


@pytest.mark.parametrize("name", sorted(BODIES))
def test_feeds(spark, name):
    body, expected = BODIES[name]
    df = spark.createDataFrame([("me", json.dumps(body)), ("bad", "{"), ("none", "{\"a\":1}"), (None, None)], "source string, body string")
    rows = feeds.postings(df, feeds.BOARDS[name]).collect()
    assert [(r.external_id, r.title, r.company_name, r.location_text) for r in rows] == expected
    assert {r.source for r in feeds.unreadable(df, feeds.BOARDS[name]).collect()} >= {"bad", None}
    assert feeds.postings(df.limit(0), feeds.BOARDS[name]).count() == 0
    assert feeds.postings(df, feeds.BOARDS[name], most=0).count() == 0


def test_configured_feeds(spark):
    board = feeds.configured(None, {"external_id": "/a~1b/0", "title": "t.u", "posted_at": "/at"}, {"apply_url": "https://x.example/{token}/{id}"})
    body = json.dumps([{"a/b": [5], "t": {"u": [{"name": "x"}, None, "y"]}, "at": 1714550400}, {"t": 1}])
    row = feeds.postings(spark.createDataFrame([("me", body)], "source string, body string"), board).select("*", F.unix_seconds("posted_at").alias("s")).collect()
    assert [(r.external_id, r.title, r.apply_url, r.s) for r in row] == [("5", "x, y", "https://x.example/me/5", 1714550400)]


def test_robots(spark):
    bodies = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /x\nAllow: /x\n\nUser-agent: siltstone\nDisallow: /p.*$\nDisallow:"), ("b", 200, "Disallow: /"), ("c", 404, None), ("d", 500, "x"), ("e", 200, None)], "host string, status int, body string")
    paths = spark.createDataFrame([("a", "/x"), ("a", "/p.q"), ("a", "/pq"), ("b", "/"), ("c", "/"), ("d", "/"), ("e", "/"), ("f", "/")], "host string, path string")
    found = {(r.host, r.path): r.verdict for r in robots.verdicts(bodies, paths, "siltstone/2.0").collect()}
    assert found == {("a", "/x"): "ALLOWED", ("a", "/p.q"): "DISALLOWED", ("a", "/pq"): "ALLOWED", ("b", "/"): "ALLOWED", ("c", "/"): "NOT_PUBLISHED", ("d", "/"): "UNAVAILABLE", ("e", "/"): "UNAVAILABLE", ("f", "/"): "UNAVAILABLE"}
    other = {(r.host, r.path): r.verdict for r in robots.verdicts(bodies, paths, "else").collect()}
    assert other["a", "/x"] == "ALLOWED" and other["a", "/p.q"] == "ALLOWED"


def test_addresses(spark):
    given = ["HTTPS://A.example.com:8/x/?q=1#f", "a.example.com/x", "ftp://a.b", "http://a.com/", "http://localhost/x", None]
    assert values(spark, given, U.canonical_url) == ["https://a.example.com:8/x?q=1", None, None, "http://a.com/", "http://localhost/x", None]
    assert values(spark, ["https://a.dev/x", "http://localhost", "https://x.test", "a.dev", "https://nodot/", None], U.valid_apply_url) == [True, False, False, False, False, False]
    assert values(spark, ["Example.COM/Path/", "HTTP://Example.COM/Path?ref=1&B=2"], U.normalize_url) == ["example.com/path", "http://example.com/Path?b=2"]
    html = "<a href='/b'>x</a><a class=x href=\"c.html?d=1\">y</a><a href='https://o.example/'>z</a><a href='/s.css'>s</a><a href='mailto:x@y'>m</a><a href='/b'>again</a>"
    assert values(spark, [html], lambda x: U.links_of(x, F.lit("https://a.example/p/q"))) == [["https://a.example/b", "https://a.example/p/c.html?d=1"]]


def test_similar_pairs_are_those_of_all_pairs(spark):
    words = ["red", "blue", "new", "large", "bolt", "ring", "gear"]
    texts = [(b, " ".join(w for k, w in enumerate(words) if n >> k & 1)) for b in "xy" for n in range(1, 128) if (n * 7 + ord(b)) % 3]
    found = {(r.b0, r.a, r.b): r.similarity for r in similar_pairs(spark.createDataFrame(texts, "b0 string, t string"), ["b0"], "t", 0.72).collect()}
    expected = {}
    for b, s in texts:
        for c, t in texts:
            x, y = set(s.split()), set(t.split())
            if b == c and s < t and len(x & y) / len(x | y) >= 0.72:
                expected[b, s, t] = len(x & y) / len(x | y)
    assert found == pytest.approx(expected) and found


def test_records(spark):
    now = F.to_timestamp(F.lit("2024-05-01T12:00:00Z"))
    assert values(spark, ["120", "99999", "99999999999999999999", "-5", "Wed, 1 May 2024 12:10:00 GMT", "Wed, 1 May 2024 11:00:00 GMT", "soon", None], lambda x: R.backoff(x, now)) == [120, 14400, 14400, 300, 600, 0, 300, 300]
    assert values(spark, [" • Java;", "C", "a b c d e", "- * SQL..", None], R.clean_skill) == ["Java", None, None, "SQL", None]
    assert values(spark, ["Foo Bar Pvt. Ltd.", "Ltd", None], R.domain_guesses) == [["foo.com", "foo.in", "foo.co.in", "foo.io", "foobar.com", "foobar.in", "foobar.co.in", "foobar.io"], [], []]
    row = spark.createDataFrame([(Decimal("1.0"), Decimal("1.000")), (None, Decimal("1.0")), (None, None)], "a decimal(4,1), b decimal(6,3)").select(R.changed_number(F.col("a"), F.col("b")).alias("v")).collect()
    assert [r.v for r in row] == [False, True, False]
