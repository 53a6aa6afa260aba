"""Each stage's decisions against plain versions, on what its predecessor kept."""

import corpus_pipeline as P
from siltstone.llm import pii, toxicity
from siltstone.llm.common import doc_mod, table, written
from siltstone.llm.queries import oracle_sql
from tests.llm import plain_pii
from tests.llm.plainly import fingerprint, groups
from tests.llm.test_packing import verify
from tests.oracle import by_sql


def test_stages_decide_as_their_plain_versions(spark, tiny):
    docs = table(spark, tiny, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    steps = []
    for _, stage in P.STAGES[:-1]:
        docs = written(stage(spark, docs, tiny))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        steps.append({r.doc_id: r for r in docs.collect()})
    good, calm, single, hidden = steps

    names, judged = by_sql(oracle_sql()["op4_quality"], tiny)
    assert set(good) == {r[names.index("doc_id")] for r in judged if r[names.index("kept")]}

    every = table(spark, tiny, "documents")
    model = toxicity.fit(every, table(spark, tiny, "labels"), doc_mod("doc_id", 5) != 0)
    scores = {r.doc_id: r.score for r in model.score(every.select("doc_id", "text")).collect()}
    assert set(calm) == {i for i in good if scores[i] < 0.5}

    assert set(single) == set(groups({i: fingerprint(r.text) for i, r in calm.items()}).values())
    assert all(single[i] == rows[i] for i in single)

    assert {i: r.text for i, r in hidden.items()} == {i: plain_pii.pseudonymised(rows[i].text, pii.DEMO_KEY) for i in single}

    verify(P.STAGES[-1][1](spark, docs, tiny).collect(), [(i, r.text) for i, r in hidden.items()], 4096)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, host int, hash string, score string, text_hash int, v int, host_rate int, n int, pack_group int"
GOOD = " ".join(f"word{i}" for i in range(40))
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, GOOD, "en", "a", 5),
    (3, GOOD, "en", "a", 5),
    (4, GOOD.upper(), None, None, None),
    (None, GOOD + " reach me at jane.doe@mail.example.org", None, "b", None),
    (5, " ".join(f"w{i} and" for i in range(60_000)), "en", "b", 1),
    (6, "same same same same same same same same same same same same", "en", "b", 1),
]


def odd(spark):
    return spark.createDataFrame([(*r, "r", 1, "h", "s", 2, 3, 4, 5, 6) for r in ODD], SCHEMA)


def kept(df) -> list:
    return sorted((r.doc_id or 0) for r in df.collect())


def test_stages_hold_for_odd_rows_and_clashing_names(spark, tiny):
    """pipeline: nulls, empty and long texts, repeated rows and ids, and columns that have names of the stages' own."""
    docs = odd(spark)
    results = {name: stage(spark, docs, tiny) for name, stage in P.STAGES}
    for name, _ in P.STAGES[:-1]:
        assert results[name].columns == docs.columns and {r.row for r in results[name].collect()} == {"r"}, name
    assert kept(results["quality rules"]) == [0, 3, 3, 4, 5]
    assert kept(results["toxicity"]) == [0, 1, 2, 3, 3, 4, 5, 6]
    # Documents 1 and 2 are empty, 3 and 4 alike but for case; the one without an id is near neither.
    assert kept(results["near copies"]) == [0, 1, 3, 5, 6]
    assert kept(results["personal data"]) == [0, 1, 2, 3, 3, 4, 5, 6]
    changed = [r.text for r in results["personal data"].collect() if r.doc_id is None]
    assert changed[0].startswith(GOOD) and changed[0].endswith("@mail.example.org") and "jane.doe" not in changed[0]
    packed = results["packing"].collect()
    assert sorted((r.doc_id or 0) for r in packed if r.start == 0) == [0, 1, 2, 3, 3, 4, 5, 6]
    places = sorted((r.sequence_id, r.offset, r.length) for r in packed)
    assert all(o == (0 if k == 0 or places[k - 1][0] != s else sum(places[k - 1][1:])) for k, (s, o, _) in enumerate(places))


def test_stages_hold_for_empty_tables(spark, tiny):
    none = odd(spark).limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, tiny).count() == 0, name
