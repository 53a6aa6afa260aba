"""Long repeats across all texts by bucket-pointer refinement of their suffixes.

A window is `depth` bytes; it goes if it starts anywhere else, too. Windows are pointers into the texts, sorted into ever
finer buckets, and a bucket of one pointer is done.

* Initial buckets. Each window has an anchor, the place of the least 8-gram hash among its first `SPREAD` places, which
  windows of equal bytes have at the same distance. Windows of neighbouring starts share anchors, so they form runs. A run's
  bucket is the q-gram at its anchor, q = depth - SPREAD + 1 bytes that all windows of the run hold. Buckets with a single pointer
  are dropped. Of runs that are equal in all bytes one stands for all; they are repeats.
* Refinement. Within a bucket windows differ in what follows the q-gram and in what precedes it. Both are sorted once,
  which gives each run, for each length, the identifier of a bucket at a later and at an earlier offset. These identifiers
  serve all windows of the bucket: it is refined by sorting its windows on their distance and those two.
* Recursion. A bucket too large for one task isn't collected: its runs are parted by distance into quarters, which share longer
  q-grams, and these are the buckets of the next round, down to whole windows, which are equal and need no more sorting.

Equal texts are taken once. Texts lie in a table bucketed by their hash and aren't shuffled again.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import HOT_ROWS, cut, shared_dir, spread_join, table, text_or_empty
from siltstone.llm.tokens import slices

DEPTH = 400
#: First places of a window among which its anchor is; a power of 4.
SPREAD = 256
#: Distinct runs of a bucket that one task sorts; larger buckets are parted.
BUCKET = 16_384
#: Bytes of a text that are scanned at a time; places within them have 24 bits.
_SCAN = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
_SALTS = 32
_COUNTS = "key long, copies long"
_RUNS = "id long, copies long, at long, near int, far int, key long, u long, v long"


def _anchors(data: np.ndarray) -> np.ndarray:
    """For each place, the place of the least hash of 8 bytes among the next `SPREAD` ones, of equal ones the first."""
    n = len(data)
    whole = -(-n // SPREAD) * SPREAD + SPREAD
    grams = np.ndarray((whole,), "<u8", buffer=np.concatenate([data, np.zeros(whole + 8 - n, np.uint8)]).data, strides=(1,)).copy()
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    rows = ((grams & ~_PLACE) | np.arange(whole, dtype=np.uint64)).reshape(-1, SPREAD)
    # A stretch of SPREAD places is the end of one row and the beginning of the next.
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[: whole - SPREAD], head[SPREAD - 1 : whole - 1]) & _PLACE).astype(np.int64)


def runs_of(data: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts that share an anchor: the text's row, the first start, the last start, the anchor.

    `data` holds texts one after the other, `ends` where each begins and the last ends."""
    starts = np.maximum(0, np.diff(ends) - depth + 1)
    total = int(starts.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 4
    row = np.repeat(np.arange(len(starts)), starts)
    start = np.arange(total) + np.repeat(ends[:-1] - (np.cumsum(starts) - starts), starts)
    anchor = _anchors(data)[start]
    edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [total]]) - 1
    return row[begin], start[begin], start[end], anchor[begin]


def _scanned(batch: pa.RecordBatch, depth: int) -> Iterator[tuple]:
    """Row of the batch, first start within its text, and the runs with the bytes that they point into."""
    for begin, texts in slices(batch.column("body")):
        offsets = texts.buffers()[1]
        kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        # A text beyond the scan's size is alone; its parts overlap, so that each window is in just one.
        for at in range(0, max(1, len(data) - depth + 1), _SCAN) if len(texts) == 1 else [0]:
            part = data[at : at + _SCAN + depth - 1] if len(texts) == 1 else data
            row, first, last, anchor = runs_of(part, np.array([0, len(part)]) if len(texts) == 1 else ends, depth)
            yield begin + row, at + first - ends[row], part, first, last, anchor


def _counts(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest as digest

    q = depth - SPREAD + 1
    for batch in batches:
        for row, _, data, _, _, anchor in _scanned(batch, depth):
            view = memoryview(data)
            key = np.array([digest(view[a : a + q]) for a in anchor.tolist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("copies").take(pa.array(row))], ["key", "copies"])


def _runs(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest as digest
    from xxhash import xxh3_128_digest as whole

    q, names = depth - SPREAD + 1, [c.split()[0] for c in _RUNS.split(", ")]
    for batch in batches:
        for row, at, data, first, last, anchor in _scanned(batch, depth):
            view, places = memoryview(data), list(zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True))
            key = np.array([digest(view[s : s + q]) for _, _, s in places], np.uint64).view(np.int64)
            # Equal bytes with the anchor at the same place: the run stands for the other.
            both = np.frombuffer(b"".join(whole(view[a : b + depth], s - a) for a, b, s in places), "<i8").reshape(-1, 2)
            rows = pa.array(row)
            columns = [batch.column("id").take(rows), batch.column("copies").take(rows), pa.array(at), pa.array((anchor - last).astype(np.int32)), pa.array((anchor - first).astype(np.int32)), pa.array(key), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, names)


def _often(rows: DataFrame, count: str, *keys: str) -> DataFrame:
    """The keys of the largest counts: at most 1,000, so few enough to broadcast."""
    return cut(rows.where(F.col(count) >= HOT_ROWS).orderBy(F.desc(count)).limit(1_000).select(*keys))


def _salted_join(rows: DataFrame, found: DataFrame, keys: list[str], hot: DataFrame, spread: Column) -> DataFrame:
    """`rows` joined with `found`, one row for each value of `keys`; rows of hot keys are dealt out by `spread`."""
    few = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")).otherwise(0)
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(few, keys, "left").withColumn("__salt", salt).drop("__hot")
    right = found.join(few, keys, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def _ranks(parts: list[bytes], needed: np.ndarray) -> np.ndarray:
    """For each part and needed length, the identifier of the bucket of parts that begin with the same so many bytes.

    A part shorter than a needed length has an identifier of no meaning there; it can't stand, in sorted order, between
    two that agree in so many bytes."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    size = np.array([len(parts[i]) for i in order])
    most = int(size.max(initial=0))
    table = np.frombuffer(b"".join(parts[i].ljust(most, b"\0") for i in order), np.uint8).reshape(len(parts), most)
    differs = np.concatenate([table[1:] != table[:-1], np.ones((len(parts) - 1, 1), bool)], axis=1)
    common = np.minimum(differs.argmax(axis=1), np.minimum(size[1:], size[:-1]))
    out = np.zeros((len(parts), len(needed)), np.int64)
    out[order[1:]] = np.cumsum(common[:, None] < needed[None, :], axis=0)
    return out


def refined(pieces: list[bytes], near: np.ndarray, far: np.ndarray, low: int, high: int, depth: int) -> np.ndarray:
    """Which windows of a bucket's runs occur twice in it: for each run and distance from `low` to `high`.

    A run's windows have distances from `near` to `far` to its anchor; its piece begins at the farthest."""
    q = depth - SPREAD + 1
    distance = np.arange(low, high + 1)
    after = _ranks([p[f + q :] for p, f in zip(pieces, far.tolist())], depth - q - distance)
    before = _ranks([p[:f][::-1] for p, f in zip(pieces, far.tolist())], distance)
    there = (near[:, None] <= distance) & (distance <= far[:, None])
    bucket = (distance[None, :] * len(pieces) + after) * len(pieces) + before
    _, inverse, count = np.unique(bucket[there], return_inverse=True, return_counts=True)
    out = np.zeros(there.shape, bool)
    out[there] = count[inverse] > 1
    return out


def _sorted(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Windows that repeat, of runs that are alone: id, first and last start. Rows come sorted by bucket."""
    made: list[tuple[int, int, int]] = []

    def judge(held: list[dict]) -> None:
        if len(held) < 2:
            return
        near, far = np.array([r["near"] for r in held]), np.array([r["far"] for r in held])
        low = held[0]["low"]
        twice = refined([r["piece"] for r in held], near, far, low, held[0]["high"], depth)
        for r, x in zip(held, twice, strict=True):
            if r["n"] == 1 and x.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
                # Distances fall as starts rise.
                made.extend((r["id"], r["at"] + r["far"] - low - b + 1, r["at"] + r["far"] - low - a) for a, b in edge.reshape(-1, 2).tolist())

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["key"], row["more"], row["low"], row["high"]) != (held[0]["key"], held[0]["more"], held[0]["low"], held[0]["high"]):
                judge(held)
                held = []
            held.append(row)
        if len(made) >= 10_000:
            yield _spans(made)
            made.clear()
    judge(held)
    yield _spans(made)


def _spans(made: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], pa.int64()) for i in range(3)], ["id", "first", "last"])


def _parted(rows: DataFrame, depth: int) -> DataFrame:
    """Runs in quarters of their bucket's distances, in buckets of what all windows of a quarter hold."""
    size = F.expr("(high - low + 1) div 4").cast("int")
    quarters = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.struct((F.col("low") + k * size).alias("low"), (F.col("low") + (k + 1) * size - 1).alias("high")))
    each = rows.withColumn("quarter", F.explode(quarters)).where("quarter.low <= far and quarter.high >= near")
    each = each.withColumns({"low": F.col("quarter.low"), "high": F.col("quarter.high")}).drop("quarter")
    held = F.substring("piece", F.col("far") - F.col("low") + 1, F.lit(depth) - (F.col("high") - F.col("low")))
    return each.withColumns({"key": F.xxhash64(held), "more": F.xxhash64(F.lit(1), held)})


def refine(pieces: DataFrame, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """id, first, last: starts of repeated windows of those `pieces` whose n is 1.

    `pieces` has key, id, at (the first start), near, far, n (how often the run occurs) and piece (the run's bytes)."""
    todo = pieces.withColumns({"more": F.lit(0).cast("long"), "low": F.lit(0), "high": F.lit(SPREAD - 1)})
    found: DataFrame | None = None
    by = ["key", "more", "low", "high"]
    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        todo = cut(todo)
        large = cut(todo.groupBy(*by).agg(F.count("*").alias("many")).where(F.col("many") > bucket).select(*by))
        none = large.isEmpty()
        usual = todo if none else todo.join(large, by, "left_anti")
        dealt = usual.repartition(tasks, *by).sortWithinPartitions(*by)
        made = dealt.select(*by, "id", "at", "near", "far", "n", "piece").mapInArrow(lambda batches: _sorted(batches, depth), "id long, first long, last long")
        found = made if found is None else found.unionAll(made)
        if none:
            return found
        parted = cut(_parted(todo.join(large, by, "left_semi"), depth))
        again = parted.groupBy(*by).agg(F.count("*").alias("many"), F.min("n").alias("least")).where("many > 1 and least = 1")
        parted = _salted_join(parted, again.select(*by), by, _often(again, "many", *by), F.col("u"))
        # A quarter of one distance is a window, and all of its bucket are equal.
        start = F.col("at") + F.col("far") - F.col("low")
        found = found.unionAll(parted.where("low = high and n = 1").select("id", start.alias("first"), start.alias("last")))
        todo = parted.where("low < high")


def _kept(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for body, marks in zip(batch.column("body").to_pylist(), batch.column("marks").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for first, last in sorted((m["first"], m["last"]) for m in marks):
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], last + depth)
                else:
                    spans.append([first, last + depth])
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            out.append((sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column("ref"), *(pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["ref", "n_removed", "n_spans", "kept_sha256"])


def _bucketed(rows: DataFrame, key: str) -> DataFrame:
    """`rows` as a table in the shared folder, bucketed by `key`, so that joins on it needn't move them."""
    spark = rows.sparkSession
    name = f"siltstone_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.write.bucketBy(parts, key).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def marks(texts: DataFrame, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """id, first, last: starts of repeated windows of `texts` (id, ref, body, copies), whose bodies differ."""
    scan = texts.select("id", "copies", "body")
    counts = scan.select("copies", "body").mapInArrow(lambda batches: _counts(batches, depth), _COUNTS)
    keys = cut(counts.groupBy("key").agg(F.sum("copies").alias("m")).where("m > 1"))
    runs = scan.mapInArrow(lambda batches: _runs(batches, depth), _RUNS)
    runs = cut(_salted_join(runs, keys.select("key"), ["key"], _often(keys, "m", "key"), F.col("id")))
    run = F.struct("id", "at", "near", "far", "key")
    alike = cut(runs.groupBy("u", "v").agg(F.sum("copies").alias("n"), F.min(run).alias("run")).select("u", "v", "n", "run.*"))
    many = alike.where("n > 1")
    whole = _salted_join(runs, many.select("u", "v"), ["u", "v"], _often(many, "n", "u", "v"), F.col("id"))
    whole = whole.select("id", F.col("at").alias("first"), (F.col("at") + F.col("far") - F.col("near")).alias("last"))
    # Runs that are alone but share a bucket with others, and those others.
    open_keys = alike.groupBy("key").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 and least = 1")
    unclear = _salted_join(alike, open_keys.select("key"), ["key"], _often(open_keys, "k", "key"), F.col("u"))
    named = unclear.join(texts.select("id", "ref"), "id")
    length = F.col("far") - F.col("near") + depth
    pieces = named.join(texts.select("ref", "body"), "ref").withColumn("piece", F.substring("body", (F.col("at") + 1).cast("int"), length.cast("int")))
    return whole.unionAll(refine(pieces.select("key", "u", "id", "at", "near", "far", "n", "piece"), depth, bucket))


def without_repeats(docs: DataFrame, depth: int = DEPTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of `docs` (doc_id, text).

    Each byte goes that is covered by a string of `depth` bytes, depth > SPREAD + 8, that also starts anywhere else,
    the same text included. A null text counts as empty; rows that repeat are repeats of each other and all stay as rows;
    a null doc_id stays null; an empty table gives no rows. Other columns are ignored, whatever their names."""
    body = text_or_empty().cast("binary")
    rows = docs.select("doc_id", body.alias("body")).withColumn("ref", F.unhex(F.sha2("body", 256)))
    long = rows.where(F.length("body") >= depth).groupBy("ref").agg(F.first("body").alias("body"), F.count("*").alias("copies"))
    texts = _bucketed(long.withColumn("id", F.monotonically_increasing_id()), "ref")
    found = marks(texts, depth, bucket).groupBy("id").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    single = texts.where("copies = 1").select("id", "ref")
    held = found.join(single, "id").select("ref", "marks").join(texts.select("ref", "body"), "ref")
    part = held.select("ref", "body", "marks").mapInArrow(lambda batches: _kept(batches, depth), "ref binary, n_removed long, n_spans long, kept_sha256 string")
    nothing = hashlib.sha256().hexdigest()
    gone = texts.where("copies > 1").select("ref", F.length("body").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(nothing).alias("kept_sha256"))
    results = cut(part.unionAll(gone))
    hot = _often(texts, "copies", "ref")
    joined = spread_join(rows.select("doc_id", F.length("body").cast("long").alias("n_bytes"), "ref"), "ref", results, None if hot.isEmpty() else hot, "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("ref"))).alias("kept_sha256"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op13_repeats": op13_repeats}
ORACLE_SQL: dict[str, str] = {}
