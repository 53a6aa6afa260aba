import random

import numpy as np

from siltstone.llm import simhash
from siltstone.llm.common import table
from siltstone.llm.queries import queries
from tests.llm.plainly import fingerprint, groups

SCHEMA = "doc_id long, text string, print string, n int, component_id string"


def test_query_matches_all_pairs(spark, tiny):
    texts = {r.doc_id: r.text for r in table(spark, tiny, "documents").collect()}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    expected = groups(prints)
    rows = queries()["op5_simhash"](spark, tiny).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == expected


def test_trie_loses_no_link_however_small_the_buckets(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(15)]
    values = {v for s in seeds for v in [s, *(s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(20))]}
    values |= {(1 << k) - 1 for k in range(64)}  # a long chain of links
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "print long")
    expected = groups({v: int(np.int64(v).astype(np.uint64)) for v in signed})
    for bucket in (50_000, 5):
        found = {r.vertex: r.root for r in simhash.components(simhash.stars(prints, bucket=bucket)).collect()}
        assert {v: found.get(v, v) for v in signed} == expected


def test_nulls_repeats_and_long_texts(spark):
    long = " ".join(str(i) for i in range(100_000))
    docs = spark.createDataFrame([(5, None, "", 1, ""), (4, "", "", 1, ""), (7, " \n", "", 1, ""), (9, long, "", 1, ""), (9, long, "", 1, ""), (8, "A b", "", 1, ""), (3, "a B", "", 1, ""), (None, "a b", "", 1, "")], SCHEMA)
    found = sorted((r.doc_id or 0, r.component_id) for r in simhash.classes(docs).collect())
    assert found == [(0, 3), (3, 3), (4, 4), (5, 4), (7, 4), (8, 3), (9, 9), (9, 9)]
    stayed = simhash.keep_one(docs)
    assert stayed.columns == docs.columns
    assert sorted(r.doc_id for r in stayed.collect()) == [3, 4, 9]


def test_rows_without_ids_alone(spark):
    docs = spark.createDataFrame([(None, "one two three four", "", 1, ""), (None, "one two three four", "", 1, "")], SCHEMA)
    assert [r.component_id for r in simhash.classes(docs).collect()] == [None, None]
    assert simhash.keep_one(docs).count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.classes(docs).count() == 0 and simhash.keep_one(docs).count() == 0
