"""Checked scans, robots answers and companies' sites."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions.text import canonical_json
from siltstone.operators import resolve, robots
from siltstone.sources.tables import breaches, contracted


def test_breaches(spark):
    rows = spark.createDataFrame([("1", "a", 1), ("x", None, 2), (None, "c", 3)], "n string, t string, extra int")
    got = {(r["column"], r["problem"]): r["n"] for r in breaches(rows, "n int, t string not null, gone date").collect()}
    assert got == {("gone", "MISSING"): None, ("extra", "EXTRA"): None, ("n", "TYPE"): 1, ("t", "NULL"): 1}
    assert {(r["column"], r["problem"]): r["n"] for r in breaches(rows.select("n"), "n int not null").collect()} == {("n", "TYPE"): 1, ("n", "NULL"): 2}
    assert breaches(rows.limit(0), "n int, t string, extra int").collect() == [] and breaches(rows.select("extra"), "x int").count() == 2


def test_contracted(spark):
    rows = spark.createDataFrame([("1", "a"), ("x", None)], "n string, t string")
    assert [tuple(r) for r in contracted(rows, "t string, n int").collect()] == [("a", 1), (None, None)]
    with pytest.raises(ValueError, match="gone"):
        contracted(rows, "gone int")


def test_broken_files(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "n long, t string").write.parquet(str(tmp_path / "t.parquet"))
    (tmp_path / "t.parquet" / "part-bad.parquet").write_bytes(b"PAR1 is no footer")
    with pytest.raises(Exception, match="(?i)parquet"):
        breaches(spark.read.schema("n long, t string").parquet(str(tmp_path / "t.parquet")), "n long").collect()


def test_answers_for_robots(spark):
    answers = [("a", 200, b"User-agent: *\nDisallow: /x\n"), ("b", 404, b"Disallow: /"), ("c", 503, b""), ("d", None, None), ("e", 200, "Disallow: é".encode()), ("f", 200, b"\xff\xfe"), ("g", 301, b"")]
    got = {r["host"]: (r["state"], r["truncated"], r["body"]) for r in robots.published(spark.createDataFrame(answers, "host string, status int, body binary"), 11).collect()}
    assert got == {"a": ("READ", True, "User-agent:"), "b": ("NOT_PUBLISHED", False, None), "c": ("UNAVAILABLE", False, None), "d": ("UNAVAILABLE", False, None), "e": ("READ", True, "Disallow: �"), "f": ("READ", False, "��"), "g": ("READ", False, "")}


def test_sites_of_companies(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["Acme Ltd", "Acme Ltd", "Blue Sky", "Zed", "Two", "Nobody", " ", None, "++", "Cé Inc."])], "i int, name string")
    registry = spark.createDataFrame([("acme-ltd", "acme.dev"), ("blue-sky", None), ("zed", " ")], "slug string, domain string")
    seeds = spark.createDataFrame([("acme.com",), ("blue-sky.in",), ("bluesky.com",), ("two.com",)], "domain string")
    verified = spark.createDataFrame([("zed.com", "zed"), ("zed.in", "zed"), ("two.in", "two"), ("nobody.com", "other"), ("cé.com", "ce-inc")], "domain string, slug string")
    got = {r["i"]: (r["outcome"], r["evidence"], r["domains"]) for r in resolve.resolved(names, registry, seeds, verified).collect()}
    assert got[0] == got[1] == ("RESOLVED", "REGISTRY", ["acme.dev"]) and got[2] == ("AMBIGUOUS", "SEED_LIST", ["blue-sky.in", "bluesky.com"])
    assert got[3] == ("AMBIGUOUS", "VERIFIED_SITE", ["zed.com", "zed.in"]) and got[4] == ("RESOLVED", "SEED_LIST", ["two.com"]) and got[9] == ("RESOLVED", "VERIFIED_SITE", ["cé.com"])
    assert [got[i] for i in (5, 6, 7, 8)] == [("NOT_FOUND", None, [])] * 4 and len(got) == 10


def test_json_in_one_form(spark):
    given = ['{"b":1.0,"a":{"d":[{"y":1e2,"x":""}],"c":null}}', ' {"a" : {"c":null,"d":[{"x":"","y":100.00}]},"b":1}', "[2,1]", "{", '{"a":1,"a":2}', None, '"x"', "{}"]
    got = [r[0] for r in spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string").orderBy("i").select(canonical_json(F.col("t"))).collect()]
    assert got[2:] == ["[2,1]", None, None, None, '"x"', "{}"] and got[0].startswith('{"a":{"c":null,"d":[{"x":"","y":100') and got[0].endswith('"b":1}')
