"""The keyed queue and the limiter on streams against loops."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from siltstone.sources.tables import read
from siltstone.streaming import stateful as S

#: Minutes from a first time, and what happens then, by key.
BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def queue_plainly(rows, attempts=3, stalled=30):
    """Of rows (minute, tie, kind) of one key in order: minute, status, tries, reason of each change."""
    out, status, tries, reason, since = [], None, 0, None, None

    def failed(at):
        nonlocal status
        status = "PENDING" if tries < attempts else "FAILED"
        out.append((at, status, tries, reason))

    for at, _, kind in [*sorted(rows), (1e18, 0, "")]:
        if status == "RUNNING" and since + stalled <= at:
            failed(since + stalled)
        if at == 1e18:
            break
        if kind == "claim" and status == "PENDING":
            status, tries, since = "RUNNING", tries + 1, at
        elif kind == "done" and status == "RUNNING":
            status = "COMPLETED"
        elif kind == "failed" and status == "RUNNING":
            failed(at)
            continue
        elif kind not in ("claim", "done", "failed") and status != "RUNNING":
            status, tries, reason = "PENDING", 0, kind
        else:
            continue
        out.append((at, status, tries, reason))
    return out


def history(seed, keys=12, rows=400):
    pick = random.Random(seed)
    return [(pick.randrange(keys), pick.randrange(3000), i, pick.choice(["profile", "policy", "claim", "claim", "claim", "done", "failed"])) for i in range(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(k, BEGIN + dt.timedelta(minutes=m), i, kind) for k, m, i, kind in rows], "k long, at timestamp, i long, kind string")


def by_key(rows):
    out = defaultdict(list)
    for k, *row in rows:
        out[k].append(tuple(row))
    return out


def minutes(rows):
    return sorted((r["k"], (r["at"].replace(tzinfo=dt.timezone.utc) - BEGIN).total_seconds() / 60, r["status"], r["attempts"], r["reason"]) for r in rows)


def expected(rows):
    return sorted((k, *r) for k, own in by_key(rows).items() for r in queue_plainly(own))


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, folder, parts, make):
    """Rows of `make(stream)` once each part has arrived as a file of its own."""
    schema = parts[0].schema
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(folder / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder / "in"))
    query = make(stream).writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return spark.table("made").collect()


def test_queue_of_a_table(spark):
    rows = history(1)
    got = S.stepped(frame(spark, rows), "k", "at", "i", "kind", S.WorkQueue()).collect()
    assert minutes(got) == expected(rows) and {r[2] for r in expected(rows)} == {"PENDING", "RUNNING", "COMPLETED", "FAILED"}
    assert S.stepped(frame(spark, []), "k", "at", "i", "kind", S.WorkQueue()).collect() == []


def test_queue_of_a_stream(spark, tmp_path, rocks):
    """Rows arrive by time in four batches, within each out of order; a last row lets the watermark pass all others."""
    rows = sorted(history(2, rows=250), key=lambda r: r[1])
    parts = [rows[i : i + 70] for i in range(0, 250, 70)]
    for p in parts:
        random.Random(5).shuffle(p)
    frames = [frame(spark, p) for p in parts] + [frame(spark, [(99, 10_000, 10_000, "profile")])]
    got = streamed(spark, tmp_path, frames, lambda s: S.stepped(s, "k", "at", "i", "kind", S.WorkQueue(), "1 minute"))
    assert [r for r in minutes(got) if r[0] != 99] == expected(rows)


def test_limiter_of_a_stream(spark, tiny, tmp_path, rocks):
    rows = read(spark, tiny, "events").selectExpr("user_id k", "cast(ts as timestamp) at", "event_id i").orderBy("at")
    held = rows.collect()
    frames = [spark.createDataFrame(held[i : i + 400], rows.schema) for i in range(0, len(held), 400)]
    last = spark.createDataFrame([(-1, held[-1]["at"] + dt.timedelta(days=30), -1)], rows.schema)
    machine = S.SlidingWindow(3, 86_400)
    got = streamed(spark, tmp_path, [*frames, last], lambda s: S.stepped(s, "k", "at", "i", None, machine, "1 second"))
    batch = S.stepped(rows, "k", "at", "i", None, machine).collect()
    loop = {}
    for k, own in by_key([(r["k"], r["at"].timestamp(), r["i"]) for r in held]).items():
        taken = []
        for at, i in sorted(own):
            loop[k, i] = sum(t > at - 86_400 for t in taken) < 3
            taken += [at] * loop[k, i]
    assert {(r["k"], r["tie"]): r["accepted"] for r in batch} == loop
    assert {(r["k"], r["tie"]): r["accepted"] for r in got if r["k"] != -1} == loop
