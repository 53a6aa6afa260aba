import math
import zlib
from collections import defaultdict

import zstandard

from siltstone.llm import language
from siltstone.llm.common import doc_mod, table
from siltstone.llm.queries import queries
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score int"


def test_held_out_documents_get_their_language(spark):
    rows = queries()["op10_language"](spark, SMALL).collect()
    truth = {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}
    assert len(rows) == len(truth)
    assert all(0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, truth[r.doc_id].lang) for r in rows if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    for r in rows:
        text = truth[r.doc_id].text
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))


def test_odd_texts_ties_and_clashing_columns(spark):
    learned = spark.createDataFrame([(1, "the cat and the dog are here", "en", 0), (2, "der Hund und die Katze sind hier", "de", 0), (3, None, "fr", 0), (4, "x", None, 0)], SCHEMA)
    known = language.learn(learned, F.lit(True))
    assert set(known) == {"en", "de"}
    docs = spark.createDataFrame([(1, None, "", 1), (2, "", "", 1), (3, "123 !?", "", 1), (4, "the cat and the dog", "", 1), (4, "the cat and the dog", "", 1), (None, "der Hund und die Katze " * 40_000, "", 1)], SCHEMA)
    found = sorted(((r.doc_id or 0), r.lang_pred) for r in language.identify(docs, known).collect())
    assert found == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    same = language.identify(docs.where("doc_id = 4"), {"aa": b"the cat", "bb": b"the cat"}).first()
    assert same.lang_pred == "aa" and same.margin == 0 and same.rejected
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert language.learn(docs, F.lit(True)) == {}
    assert language.identify(docs, {"en": b"the"}).count() == 0


def test_query_gives_what_plain_compression_gives(spark, tiny):
    """op10_language: every document, one compression for each language."""
    for folder in (tiny, SMALL):
        docs = table(spark, folder, "documents")
        known = language.learn(docs, doc_mod("doc_id", 4) != 2)
        learnable = defaultdict(list)
        for r in docs.collect():
            if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
                learnable[r.lang].append(r.text)
        assert list(known) == sorted(learnable, key=lambda x: (-len(learnable[x]), x))
        packers = {k: zstandard.ZstdCompressor(level=language.LEVEL, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k, v in known.items()}
        texts = {r.doc_id: r.text for r in docs.collect()}
        for r in queries()["op10_language"](spark, folder).collect():
            text = texts[r.doc_id]
            if text is None or not any(c.isalpha() for c in text):
                assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
                continue
            data = text.lower().encode().translate(None, bytes(b for b in range(33, 127) if not chr(b).isalpha()))
            sizes = {k: len(p.compress(data)) for k, p in packers.items()}
            first, *others = sorted(sizes.values())
            assert r.lang_pred == min(sizes, key=sizes.get)
            assert abs(r.margin - (others[0] - first) / others[0]) < 1e-12 and r.rejected == (r.margin < language.MARGIN)
            assert abs(r.score - 1 / sum(math.exp((first - s) / max(2.0, math.sqrt(first))) for s in sizes.values())) < 1e-12


def test_what_counts_as_a_letter(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ", "", 1), (2, "½ é", "", 1), (3, "①_9", "", 1)], SCHEMA)
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, {"en": b"the"}).collect()}
    assert found == {1: "und", 2: "en", 3: "und"}


def test_bytes_of_a_dictionary_are_bounded_before_they_are_collected(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 2_000, "en", 0) for i in range(40)] + [(99, "lang " * 100_000, "de", 0)], SCHEMA)
    rows = language.sample(docs, F.lit(True), dict_bytes=50_000).collect()
    assert {r.lang for r in rows} == {"en", "de"}
    for lang in ("en", "de"):
        sizes = [len(r.text.encode()) for r in rows if r.lang == lang]
        assert sum(sizes) - sizes[-1] < 50_000 and max(sizes) <= 50_000
