import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

from siltstone.llm import sharding
from siltstone.llm.common import table
from siltstone.llm.queries import queries

SCHEMA = "doc_id long, text string, shard string, __bucket int, hash string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", 7) for r in rows], schema=SCHEMA)


def number(values, seed: int = 42) -> int:
    """Spark's xxhash64: the bytes of each value, hashed with the hash of those before it as the seed; nulls change nothing."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else None if v is None else struct.pack("<i", v)
        seed = seed if raw is None else xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plainly(rows: list[tuple], buckets: int, shards: int = 8, seed: int = sharding.SEED) -> dict:
    """Each row's shard and slot, by a loop over the buckets. Rows hold (long,), texts and ints, and none of them repeats."""
    dealt = defaultdict(list)
    for row in rows:
        h = number([seed, *row])
        dealt[number([seed + 1, (h,)]) % buckets].append((h, row))
    out, base = {}, 0
    for b in sorted(dealt):
        held = sorted(dealt[b])
        for place, at in enumerate(np.random.default_rng([seed, b]).permutation(len(held)), base):
            out[held[at][1]] = (place % shards, place // shards)
        base += len(held)
    return out


def test_query_puts_rows_where_a_plain_loop_puts_them(spark, tiny):
    """op2_sharding"""
    docs = table(spark, tiny, "documents")
    rows = [tuple((v,) if k in ("doc_id", "n_chars") and v is not None else v for k, v in r.asDict().items()) for r in docs.collect()]
    expected = {r[0][0]: at for r, at in plainly(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))).items()}
    assert {r.doc_id: (r.shard, r.slot) for r in queries()["op2_sharding"](spark, tiny).collect()} == expected


def test_rows_that_repeat_often_are_scattered(spark):
    """op2_sharding: half of all rows are alike in every column."""
    docs = frame(spark, [(1, "same", "x", 0)] * 4000 + [(i, f"text {i}", "x", 0) for i in range(4000)])
    done = sharding.shuffle(docs)
    rows = done.collect()
    assert Counter(r.doc_id for r in rows)[1] == 4001 and len(rows) == 8000
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s in range(8) for k in range(1000)}
    parts = [Counter() for _ in range(8)]
    for r in rows:
        parts[r.slot // 125][r.text == "same"] += 1
    assert all(300 < p[True] < 700 for p in parts)


def test_columns_of_any_name_and_kind(spark):
    schema = "doc_id long, text string, slot int, base map<string,int>, again array<map<int,string>>, n struct<hash:int>"
    docs = spark.createDataFrame([(i % 3, None if i % 2 else "t", i, {"a": i}, [{i: "b"}], (i,)) for i in range(50)], schema)
    rows = sharding.shuffle(docs).collect()
    assert sorted(r.base["a"] for r in rows) == list(range(50)) and all(r.again == [{r.n.hash: "b"}] for r in rows)
    assert sorted((r.shard, r.slot) for r in rows) == [(i % 8, i // 8) for i in sorted(range(50), key=lambda i: (i % 8, i // 8))]
    assert sharding.shuffle(docs.select("n")).count() == 50


def test_query_keeps_every_row_in_even_shards(spark, tiny):
    docs = table(spark, tiny, "documents").select("doc_id", "text").collect()
    rows = queries()["op2_sharding"](spark, tiny).collect()
    expected = Counter((d.doc_id, len((d.text or "").encode()) + 1, zlib.crc32((d.text or "").encode())) for d in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_order_depends_on_rows_and_seed_alone(spark):
    docs = frame(spark, [(i, f"text {i}", "x", 0) for i in range(500)])

    def order(df, seed):
        return {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle(df, seed=seed).collect()}

    first = order(docs, 1)
    assert first == order(docs.repartition(7).orderBy("text"), 1)
    assert first != order(docs, 2)


def test_shuffle_leaves_no_trace_of_the_order(spark):
    docs = frame(spark, [(i, "same", "x", 0) for i in range(8000)])
    halves = Counter(r.shard for r in sharding.shuffle(docs).where("doc_id < 4000").collect())
    assert all(400 < halves[k] < 600 for k in range(8))


def test_nulls_repeats_and_empty_tables(spark):
    docs = frame(spark, [(1, None, "a", 0), (1, None, "a", 0), (None, "", None, 0), (2, "long " * 50_000, "b", 0)])
    rows = sharding.shuffle(docs).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert sharding.shuffle(docs.limit(0)).count() == 0


def test_written_shards_hold_all_rows(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}", "x", 0) for i in range(100)])
    sharding.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r.shard for r in back.collect()} == set(range(8))
