import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from siltstone.llm import sentencepiece_codec as codec
from siltstone.llm.common import table
from siltstone.llm.queries import queries

ODD = ["", " ", "  a  b ", "a" * 3000, "▁x▁", "日本語 текст 🙂", "￿ x￿", "tab\tand\nline\r\n", "naïve ﬁ Å ½", "\u0000a", "x" + " " * 50 + "y", "don't stop1 2three..."]
SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=codec.model_path())


def test_query_equals_the_library(spark, tiny, library):
    rows = {r.doc_id: r for r in queries()["op7_sentencepiece"](spark, tiny).collect()}
    docs = table(spark, tiny, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        r = rows[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_texts_with_clashing_columns(spark, library):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(ODD)] + [(99, None, "x", 1), (99, None, "x", 1), (None, "a", "x", 1)], SCHEMA)
    rows = codec.encode(docs, codec.model_path()).collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        text = ODD[r.doc_id] if r.doc_id is not None and r.doc_id < 99 else "a" if r.doc_id is None else ""
        assert list(r.ids) == library.encode(text, add_eos=True), repr(text)
        assert r.decoded == library.decode(list(r.ids))
    assert codec.encode(docs.limit(0), codec.model_path()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aeinrst lo.▁1é世🙂\n"), max_size=60), min_size=1, max_size=4))
def test_any_text_equals_the_library(texts):
    library = SentencePieceProcessor(model_file=codec.model_path())
    flat, bounds = codec.codec(codec.model_path()).encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == library.encode(text)
