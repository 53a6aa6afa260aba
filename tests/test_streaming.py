"""Admission against plain loops, and the same operators on streams."""

from collections import defaultdict

from siltstone.sources.tables import read
from siltstone.streaming import admission as A


def events(spark, tiny):
    by = defaultdict(list)
    for r in read(spark, tiny, "events").orderBy("user_id", "ts", "event_id").collect():
        by[r.user_id].append((r.ts.timestamp(), r.event_id))
    return by


def test_sliding_window_is_that_of_a_loop(spark, tiny):
    expected = {}
    for rows in events(spark, tiny).values():
        taken = []
        for at, i in rows:
            expected[i] = sum(t > at - 86_400 for t in taken) < 3
            taken += [at] * expected[i]
    got = {r.event_id: r.accepted for r in A.sliding_window(read(spark, tiny, "events"), "user_id", "ts", "event_id", 3, 86_400).collect()}
    assert got == expected and len(set(got.values())) == 2


def test_spacing_is_that_of_a_loop(spark, tiny):
    expected = {}
    for rows in events(spark, tiny).values():
        free = 0
        for at, i in rows:
            wait = max(0, free - at)
            expected[i] = wait if wait <= 90_000 else None
            free = free if wait > 90_000 else at + wait + 72_000
    got = {r.event_id: r.wait for r in A.spacing(read(spark, tiny, "events"), "user_id", "ts", "event_id", 72_000, 90_000).collect()}
    assert set(got) == set(expected) and None in got.values()
    assert all((got[i] is None) == (w is None) and (w is None or abs(got[i] - w) < 1e-3) for i, w in expected.items())


def test_streams_give_what_batches_give(spark, tiny, tmp_path):
    rows = read(spark, tiny, "events").selectExpr("user_id", "event_type", "cast(ts as timestamp) ts")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, make in (("counts", lambda df: A.tumbling(df, "ts", "6 hours", "60 days", "event_type")), ("once", lambda df: A.idempotent(df, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"))):
        mode = "complete" if name == "counts" else "append"
        query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        expected = make(rows).select(*spark.table(name).columns)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, expected.collect()))


def test_null_and_long_keys_are_keys_like_others(spark):
    """WIN-08, STR-S8: beside nulls, keys beyond 2 ** 53 stay apart, and events without a time are refused."""
    big = 1 << 60
    rows = [(None, f"2024-01-01 00:00:0{i}", i) for i in range(6)] + [(big + i % 2, f"2024-01-01 00:00:0{i}", 10 + i) for i in range(4)] + [(7, None, 20)]
    df = spark.createDataFrame(rows, "k long, at string, i long").selectExpr("k", "cast(at as timestamp) at", "i")
    taken = {r.i: r.accepted for r in A.sliding_window(df, "k", "at", "i", 1, 1_000).collect()}
    assert [i for i, fine in sorted(taken.items()) if fine] == [0, 10, 11] and len(taken) == 11
    waits = {r.i: r.wait for r in A.spacing(df, "k", "at", "i", 3, 4).collect()}
    assert [waits[i] for i in range(3)] == [0.0, 2.0, 4.0] and waits[3] is None and waits[10] == waits[11] == 0.0 and waits[20] is None
