import hashlib
from collections import Counter

import numpy as np

from siltstone.llm import repeats
from siltstone.llm.queries import queries

SCHEMA = "doc_id long, text string, body string, ref int, id string"


def plainly(rows, depth=400):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(b[p : p + depth] for _, b in bodies for p in range(len(b) - depth + 1))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, np.int32)
        for p in range(len(b) - depth + 1):
            if count[b[p : p + depth]] > 1:
                gone[p] += 1
                gone[p + depth if p + depth <= len(b) else len(b)] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def test_query_matches_all_windows(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text").collect()]
    expected = plainly(rows)
    assert found(queries()["op13_repeats"](spark, tiny)) == expected
    assert any(0 < r[2] < r[1] for r in expected)


def made(rng, n, letters="abcdefgh "):
    return "".join(rng.choice(list(letters), n))


def planted(seed):
    """Passages about as long as a window, shorter, longer, cut at their ends, beside each other and within themselves."""
    rng = np.random.default_rng(seed)
    passages = [made(rng, n) for n in (399, 400, 401, 430, 700, 900, 1500)]
    rows = []
    for i in range(60):
        text = made(rng, int(rng.integers(0, 300)))
        for _ in range(int(rng.integers(1, 4))):
            p = passages[rng.integers(len(passages))]
            a, b = int(rng.integers(0, 60)), len(p) - int(rng.integers(0, 60))
            text += (p if rng.random() < 0.4 else p[a:b]) + made(rng, int(rng.integers(0, 200)) * int(rng.integers(0, 2)))
        if i % 7 == 0:
            at = int(rng.integers(0, len(text)))
            text = text[:at] + "é" + text[at:]  # an edit, of two bytes
        rows.append((i, text))
    return [*rows, *rows[:5]]


def test_planted_passages(spark):
    for seed in (1, 2):
        rows = planted(seed)
        assert found(repeats.without_repeats(frame(spark, rows))) == plainly(rows)


def test_large_buckets_are_parted(spark):
    rows = planted(3)
    expected = plainly(rows)
    assert found(repeats.without_repeats(frame(spark, rows), bucket=3)) == expected


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_SCAN", 1000)  # long texts in parts
    rng = np.random.default_rng(8)
    once = made(rng, 2500)
    rows = [(1, None), (2, ""), (None, "x"), (4, "a" * 399), (5, "b" * 400), (6, "c" * 401), (7, "ab" * 700), (8, once), (9, once), (9, once), (10, once[:1200] + once[1201:]), (11, "d" * 3000 + once[700:1300]), (12, "\0" * 420), (13, "\0" * 300 + "e" * 150)]
    assert found(repeats.without_repeats(frame(spark, rows))) == plainly(rows)


def test_empty_table(spark):
    assert found(repeats.without_repeats(frame(spark, []))) == []


def test_other_depth(spark):
    rows = planted(5)
    assert found(repeats.without_repeats(frame(spark, rows), depth=300)) == plainly(rows, 300)
