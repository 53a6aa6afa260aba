from siltstone.llm import quality
from siltstone.llm.queries import oracle_sql, queries
from tests.llm.plainly import words
from tests.oracle import check

SCHEMA = "doc_id long, text string, source string, kept string, host int, n_words string"
GOOD = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = ["", None, " \n ", GOOD, "a b " * 40, "x y z\n" * 7, "# * $ % & | < >", "line\nline\n\n \nline two\nline two", GOOD + " " + GOOD, "wörter sind 😀 hier " * 5, "word " * 30_000]


def plainly(text: str | None) -> tuple:
    text = text or ""
    found = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    often = {w for w in windows if windows.count(w) > 1} if len(set(windows)) < len(windows) and len(found) < 5000 else set(windows if len(found) >= 5000 else ())
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    n = len(found)
    return n, sum(map(len, found)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_query_matches_sql(spark, tiny):
    check(queries()["op4_quality"](spark, tiny), oracle_sql()["op4_quality"], tiny)


def test_measures_of_odd_texts_with_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, f"h{i}", "x", 1, "y") for i, t in enumerate(TEXTS)], SCHEMA)
    for r in quality.judge(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plainly(TEXTS[r.doc_id])


def test_a_host_of_failures_takes_its_good_documents_with_it(spark):
    rows = [(i, GOOD if i % 10 == 0 else "bad", "spam.example", None, None, None) for i in range(100)]
    rows += [(100 + i, GOOD, f"fine{i % 5}.example", None, None, None) for i in range(100)]
    rows += [(200, GOOD, None, None, None, None), (200, GOOD, None, None, None, None), (None, None, "fine1.example", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = quality.judge(docs).where("kept").collect()
    assert sorted(r.doc_id for r in kept) == [*range(100, 200), 200, 200]
    stayed = quality.keep(docs)
    assert stayed.columns == docs.columns
    assert sorted(r.doc_id for r in stayed.collect()) == [*range(100, 200), 200, 200]


def test_small_hosts_lean_on_the_prior(spark):
    """One failure alone shrinks towards the other hosts' rate."""
    rows = [(i, GOOD, f"h{i // 20}", None, None, None) for i in range(400)] + [(500, "bad", "small", None, None, None), (501, GOOD, "small", None, None, None)]
    rates = {r.host: r.host_rate for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert rates["h1"] < rates["small"] < 0.5


def test_many_hosts_take_the_salted_join(spark, monkeypatch):
    from siltstone.llm import common

    docs = spark.createDataFrame([(i, GOOD if i % 3 else "bad", f"h{i % 7}", None, None, None) for i in range(200)], SCHEMA)
    expected = sorted(quality.judge(docs).collect())
    monkeypatch.setattr(common, "FEW_KEYS", 0)
    assert sorted(quality.judge(docs).collect()) == expected


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert quality.judge(docs).count() == 0 and quality.keep(docs).count() == 0
