"""What the reviewer of round 4 found, on small tables."""

from pyspark.sql import functions as F

from siltstone.functions import postings as P
from siltstone.functions.text import canonicalize
from siltstone.plans import registry
from siltstone.sources import tables

QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_that_many_rows_have_are_read_once(spark, tiny):
    """txt01_normalized: each of its rows had its title, place and description read anew."""
    assert plan(QUERIES["txt01_normalized"](spark, tiny)).count("LeftOuter") == 3
    assert "LeftOuter" not in plan(QUERIES["str10_titles"](spark, tiny))  # found sooner than its rows are gone through


def test_what_is_found_once_is_what_is_found_row_by_row(spark):
    """txt01_normalized: long texts, null ones and those that no other row has, too."""
    often, rare = ["Senior cook (Remote)", "Pay: $10k - $20k per hour, 3+ years", " ", None, "x" * tables.SHORT_TEXT, "Ulm, BY • hybrid working"], ["y" * 1001 + " hybrid role", "z 2-4 yrs\nSkills\ntea", "<p>internship</p>"]
    texts = often * 30 + rare
    rows = spark.createDataFrame([(i, texts[i], texts[(i * 7) % len(texts)], texts[(i * 11) % len(texts)], texts[(i * 13) % len(texts)] if i % 3 else None) for i in range(len(texts))], "i int, t string, p string, h string, pay string")
    made = lambda df: df, F.col("t"), F.col("p"), F.col("h"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("pay")
    found = P.with_fields(rows, *made[1:]).orderBy("i").collect()
    alone = [P.with_fields(rows.where(F.col("i") == i), *made[1:]).first() for i in (0, 1, 4, 5, 100, 180, 181, 182)]
    assert [found[r["i"]] for r in alone] == alone and len(found) == len(texts)
    held = tables.found_once(rows, {"a": (F.col("t"), canonicalize)}, "x")
    assert plan(held).count("LeftOuter") == 1 and [r.x.a for r in held.orderBy("i").collect()] == [r.a for r in rows.select("i", canonicalize(F.col("t")).alias("a")).orderBy("i").collect()]
    assert "LeftOuter" not in plan(tables.found_once(rows.where("i < 3"), {"a": (F.col("t"), canonicalize)}, "x"))
    assert tables.found_once(rows.limit(0), {"a": (F.col("t"), canonicalize)}, "x").collect() == []


def test_search_texts_find_only_what_they_hold(spark, tiny):
    """str25_search_texts: years, pay, sections and parts of places were found and thrown away."""
    found = plan(QUERIES["str25_search_texts"](spark, tiny))
    assert not [x for x in ("[•|;]", "(?:years?|yrs?)", "$₹€£", "your profile") if x in found]


def test_canonical_texts_of_all_characters(spark):
    """txt05_skill_tiers, txt06_kept_skills, str25_search_texts: a negated class took most of the time; the one in its place has the same characters."""
    texts = ["a".join(map(chr, range(c, c + 256))) for c in (*range(0, 0xD800, 256), *range(0xE000, 0x11000, 256), 0x1F600, 0x10FF00)]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", canonicalize(F.col("x")).alias("got"))
    assert "[^a-z0-9+#.]" not in plan(rows)
    fold = lambda x: F.regexp_replace(F.translate(x, *_folding()), r"\p{M}", "")
    assert rows.where(F.col("got") != F.trim(F.regexp_replace(F.lower(fold(F.col("x"))), "[^a-z0-9+#.]+", " "))).count() == 0


def _folding():
    from siltstone.functions import text

    return text._MARKED, text._PLAIN


def test_a_text_is_read_in_one_task_and_gives_a_row_for_each_skill(spark, tiny):
    """txt05_skill_tiers: each mention was a row that was sorted and shuffled, and texts were dealt a second time."""
    found = QUERIES["txt05_skill_tiers"](spark, tiny)
    body = plan(found)
    assert body.count("MapInArrow") == 1 and "Aggregate" not in body[: body.index("MapInArrow")]


def test_headings_and_items_of_odd_characters(spark):
    """txt05_skill_tiers, txt06_kept_skills: what Spark's expressions made of such lines stays."""
    from siltstone.operators import skills

    given = {"Requirements²": "REQUIRED", "²required:": "REQUIRED", "árequired:": None, "required́ x:": None, "ſkills and experience": None, "_required_:": None, "NICE to have": "PREFERRED", "nice²to have": None}
    assert {x: skills.heading_tier(x) for x in given} == given
    assert skills.blocks("Java\fnice to have") == ("java nice to have", [(None, None, ["java nice to have"])])
    assert skills.blocks("Java here.\fmust have\n\nTeam: ＪＡＶＡ jáva • Go.\n") == ("java here. must have team java go.", [(None, None, ["java here."]), ("must have", "REQUIRED", ["team java", "go."])])


def test_kept_skills_sort_no_mentions(spark, tiny):
    """txt06_kept_skills: mentions were sorted and shuffled before the skills of a text were."""
    body = plan(QUERIES["txt06_kept_skills"](spark, tiny))
    assert "Aggregate" in body[: body.index("MapInArrow")] and body.count("min(struct") == 1
