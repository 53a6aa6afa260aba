import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing
from siltstone.llm.common import table
from siltstone.llm.queries import queries

ODD = ["", " ", "\n\n", "a" * 9000, "It's  THE don't\tx\r\ny", "naïve Straße ÀÉ ǅ İI ſ", "日本語 текст 🙂🙂", "12345 3.14 1,000", "x<|endoftext|>y <|", " a b\u0085c", "é ﬁ Å"]
SCHEMA = "doc_id long, text string, pack_group int, length string"


def true_ids(text: str | None) -> np.ndarray:
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def verify(rows, texts: list[tuple[int, str | None]], capacity: int) -> float:
    """Each document's ids lie in its pieces once, sequences have no gap; the share of tokens in all sequences' room."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {i for i, _ in texts}
    for i, text in texts:
        ids = true_ids(text)
        own = sorted(pieces[i], key=lambda r: r.start)
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for held in sequences.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == list(np.cumsum([0, *(r.length for r in held)])[:-1])
        assert sum(r.length for r in held) <= capacity
    return sum(r.length for r in rows) / capacity / len(sequences)


def test_query_on_all_documents(spark, tiny):
    texts = [(r.doc_id, r.text) for r in table(spark, tiny, "documents").select("doc_id", "text").collect()]
    assert verify(queries()["op1_packing"](spark, tiny).collect(), texts, 4096) > 0.9


def test_odd_texts_nulls_and_extra_columns(spark):
    texts = [*enumerate(ODD), (100, None)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], SCHEMA)
    verify(packing.pack(docs, packing.tokenizer_path(), capacity=256).collect(), texts, 256)


def test_repeated_rows_and_null_ids_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(1, "one two", 0, ""), (1, "one two", 0, ""), (None, "three", 0, "")], SCHEMA)
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.start) for r in rows) == [(0, 0), (1, 0), (1, 0)]
    assert len({(r.sequence_id, r.offset) for r in rows}) == 3


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), packing.tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_assign_takes_the_cheapest_sequence_with_room(seed):
    lengths = np.sort(np.random.default_rng(seed).integers(1, 100, 200))[::-1]
    sequence, _ = packing.assign(lengths, 100)
    n = -(-int(lengths.sum()) // 100)
    used, cost = np.zeros(n), np.zeros(n)
    for size, at in zip(lengths, sequence, strict=True):
        room = [k for k in range(n) if used[k] + size <= 100]
        if not room:
            assert at >= n
            continue
        assert at == min(room, key=lambda k: (cost[k], k))
        used[at] += size
        cost[at] += size + size * size / packing.CAPACITY
