"""Texts that took quadratic time, or the engine's stack: each repeats one sign 100,000 times or has 10 MB."""

import time

from pyspark.sql import functions as F

from siltstone.functions import postings as P
from siltstone.functions import text as T
from siltstone.operators.robots import pattern_of, verdicts

N = 100_000
TEXTS = ["a" + s * N + tail for s in (",", " , ", ";", "• ", " ", "\n", "\r\n", "<", "<script ", "<script>", "<style>x", "<br ", "( ", "9", "$1,", "3 - ", "&amp;") for tail in ("", "b")] + ["<p>Some words &amp; signs </p>\n" * 350_000]


def test_time_is_linear(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").repartition(8)
    begin = time.monotonic()
    fields = P.with_fields(rows, F.col("t"), F.col("t"), F.col("t"), F.col("t"), F.col("t"), F.col("t"))
    assert fields.count() == len(TEXTS) and len(fields.agg(*[F.max(F.length(c)) for c in P.FIELDS if c not in ("min_experience",)]).first()) > 10
    assert time.monotonic() - begin < 120


def test_markup_that_does_not_end(spark):
    html = ["a<script>b<p>c", "<script>x</script>y<script>z<style>q</style>w", "<style>q<script>x</script>y", "a < b", "a<b", "5 > 3 < 4", "<li class=x>one</LI><li>two", "A<SCRIPT a='1'>x</style>y</Script >b</script>c", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, t string").orderBy("i").select(T.strip_html(F.col("t"))).collect()]
    assert got == ["a b c", "y z w", "q y", "a < b", "a<b", "5 > 3 < 4", "• one\n• two", "A c", None, ""]


def test_rules_are_texts_but_for_stars_and_the_end(spark):
    cases = [("/a\\E.*", "/a\\E.x", True), ("/a\\E.*", "/ab.x", False), ("/a\\Qb", "/a\\Qb", True), ("/fish*.php$", "/fish.php?x.php", True), ("/fish*.php$", "/fish.phpx", False), ("/*", "/x", True), ("$", "", True), ("/p$", "/p", True), ("/p$", "/pq", False), ("/a*b*$", "/axxbyy", True), ("/(x)[y]{2}+?^|", "/(x)[y]{2}+?^|z", True), ("*/b*c$", "/b/bcc", True), ("/a*a$", "/a", False)]
    rows = spark.createDataFrame([c[:2] for c in cases], "r string, p string")
    assert [r[0] for r in rows.select(F.rlike("p", pattern_of(F.col("r")))).collect()] == [c[2] for c in cases]
    many = spark.createDataFrame([("/" + "*a" * 40 + "*b$", "/" + "a" * 3000)], "r string, p string")
    assert many.select(F.rlike("p", pattern_of(F.col("r")))).first()[0] is False


def test_one_host_cannot_end_the_query(spark):
    bodies = spark.createDataFrame([("a", 200, "User-agent: *\nDisallow: /a\\E.*\nDisallow: /\\Q*$"), ("b", 200, "User-agent: *\nDisallow: /b")], "host string, status int, body string")
    paths = spark.createDataFrame([("a", "/a\\E.x"), ("a", "/c"), ("b", "/b"), ("b", "/c")], "host string, path string")
    assert sorted((r["host"], r["path"], r["verdict"]) for r in verdicts(bodies, paths, "bot").collect()) == [("a", "/a\\E.x", "DISALLOWED"), ("a", "/c", "ALLOWED"), ("b", "/b", "DISALLOWED"), ("b", "/c", "ALLOWED")]
