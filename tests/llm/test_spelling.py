import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import spelling
from siltstone.llm.queries import queries

SCHEMA = "doc_id long, text string, word string, n int, root string"


def words_plainly(rows):
    total = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zA-ZÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 5}


def differ_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plainly(rows):
    """Forms by all pairs of words whose lengths differ by one at most, and that share a half."""
    n = words_plainly(rows)
    halves = {}
    for w in n:
        for size in (len(w) - 1, len(w), len(w) + 1):
            halves.setdefault(("front", size, w[: size // 2]), []).append(w)
        # One error leaves the front half or the rest of a word as it is.
        for back in {w[len(w) // 2 :], w[len(w) // 2 + 1 :], w[(len(w) - 1) // 2 :]}:
            halves.setdefault(("back", back), []).append(w)
    near = {w: set() for w in n}
    for together in halves.values():
        for a in together:
            for b in together:
                if abs(len(a) - len(b)) <= 1 and differ_by_one(a, b):
                    near[a].add(b)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_query_matches_all_pairs(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    expected = plainly(rows)
    assert found(queries()["op11_spelling"](spark, tiny)) == expected
    assert any(r[1] for r in expected) and any(r[4] > 1 for r in expected)


def test_made_words(spark):
    texts = ["Banana " * 30 + "bananna " * 5 + "bananä " * 6 + "bananas " * 6, "banaa " * 9 + "bananana " * 5, "banana Äpfelchen " * 130, None, "", "aaaaaa aaaaaaa aaaaaaaa " * 5, "×÷×÷×÷ " * 7]
    long = "q" * 3000
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(texts)] + [(None, "bananna " * 2, "", 0, None), (3, "bananna", "", 0, ""), (3, "bananna", "", 0, "")]
    rows += [(50, f"{long} " * 60 + f"{long[:1500]}x{long[1500:]} " * 7 + f"{long}q " * 5, "", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = found(spelling.variants(df))
    assert got == plainly([r[:2] for r in rows])
    by = {r[0]: r for r in got}
    assert by["bananna"][1] == "banana" and by["bananas"][2] == "banana" and by["bananana"][1] is None


def test_chains_of_forms(spark):
    """Words of which each leads to the next, over more steps than one round follows."""
    chain = ["abcdef", "abcdeg", "abcdhg", "abcihg", "abjihg"]
    text = " ".join(" ".join([w] * 5 * 6**k) for k, w in enumerate(chain))
    got = found(spelling.variants(spark.createDataFrame([(7, text, "", 1, "")], SCHEMA)))
    assert got == plainly([(7, text)])
    assert {r[2] for r in got if r[0] in chain} == {"abjihg"}


def test_empty_table(spark):
    assert found(spelling.variants(spark.createDataFrame([], SCHEMA))) == []
    assert found(spelling.variants(spark.createDataFrame([(1, "short words", "", 1, "")], SCHEMA))) == []


def test_every_neighbour_once():
    alphabet = np.array(sorted(map(ord, "abc")), np.int64)
    listed = ["aabbca", "c", "abc", "aaaa"]
    own = spelling.Words(listed)
    made = {i: Counter() for i in range(len(listed))}
    for row, a, b in own.neighbours(alphabet):
        for r, x, y in zip(row.tolist(), a.tolist(), b.tolist()):
            made[r][x, y] += 1
    for i, w in enumerate(listed):
        expected = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in "abc"} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in "abc"}
        sums = spelling.Words(sorted(expected - {w}))
        assert made[i] == Counter(zip(sums.sums[0].tolist(), sums.sums[1].tolist()))


def test_crowded_field_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_field", lambda keyed: np.full(1 << (spelling.FIELD_BITS - 3), 255, np.uint8))
    rows = [(i, "banana bananna " * 5 + "banana " * 40, "", 1, "") for i in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).where(F.lit(True))
    assert found(spelling.variants(df)) == plainly([r[:2] for r in rows])
