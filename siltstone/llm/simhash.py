"""SimHash near-duplicates by a self-join of binary tries of fingerprints.

Two fingerprints that differ in at most `budget` bits agree in at least one of `budget + 1` blocks of bits. So each
distinct fingerprint goes, once for each block, to the bucket of that block's value; buckets that stay too large are
parted again by blocks of their remaining bits, which loses no link. The fingerprints of a bucket form a binary trie over the
remaining bits. It is joined with itself from the root: pairs of nodes go down together, a pair whose nodes take
different branches has one more differing bit, and pairs over the budget are pruned. Leaf pairs are links; of these a
bucket hands on only a star for each group it connects. Connected components over all stars give the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import cut, hot_keys, spread_join, table, text_or_empty

BITS, BUDGET, WORDS, SEED = 64, 3, 3, 42
#: Fingerprints of a bucket that one task takes; larger buckets are parted.
BUCKET = 50_000
#: Node pairs that are taken down together.
_PAIRS = 1 << 16
_SHINGLES = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit k is set if it is set in over half of the hashes of the text's shingles, repeats included."""
    import xxhash

    found = text.encode("utf-8", "replace").lower().split()  # of bytes: lower-cases A-Z, splits at ASCII white space
    if not found:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(found) - words + 1)
    line = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size) - 1
    begins = (ends - size + 1).tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, _SHINGLES):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins[at : min(n, at + _SHINGLES)], ends[at : at + _SHINGLES])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], [*batch.schema.names[:-1], "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (a null text counts as empty) and print (the fingerprint's bits as a long) of each row."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("text_hash long, print long")])
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text")).mapInArrow(_fingerprints, schema)


def _connect(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """`label` (for each row the least row of its group) once the groups of `left` and `right` are one, pair by pair."""
    left, right = label[left], label[right]
    while (apart := left != right).any():
        left, right = left[apart], right[apart]
        step = np.arange(len(label))
        np.minimum.at(step, np.maximum(left, right), np.minimum(left, right))
        while not np.array_equal(further := step[step], step):
            step = further
        label, left, right = step[label], step[left], step[right]
    return label


def trie_groups(values: np.ndarray, bucket: np.ndarray, bits: int, budget: int) -> np.ndarray:
    """For each row the least row that links within its bucket lead to.

    Rows must be sorted by bucket and value, and a bucket's values be distinct; two are linked if at most `budget` of
    their low `bits` bits differ. A node of the trie is a range of rows. A pair of nodes ends where its rows are linked
    whatever their remaining bits, or where all of them are in one group already."""
    edge = np.flatnonzero(np.diff(bucket)) + 1
    low, high = np.concatenate([[0], edge]), np.concatenate([edge, [len(values)]])
    some = high - low > 1
    low, high = low[some], high[some]
    ones = [np.concatenate([[0], np.cumsum((values >> np.uint64(b)) & np.uint64(1))]).astype(np.int64) for b in range(bits)]
    label = np.arange(len(values))
    group = label.copy()  # two rows hold the same number if no border between groups is between them
    todo = [(bits, low, high, low, high, np.zeros(len(low), np.int8))]
    while todo:
        bit, *pairs = todo.pop()
        al, ah, bl, bh, errors = pairs
        if len(al) > _PAIRS:
            half = len(al) // 2
            todo += [(bit, *(x[:half] for x in pairs)), (bit, *(x[half:] for x in pairs))]
            continue
        rest = (label[al] != label[bl]) | (group[al] != group[ah - 1]) | (group[bl] != group[bh - 1])
        near = rest & (errors + bit <= budget)
        if near.any():
            chain = np.zeros(len(values) + 1, np.int64)
            for lo, hi in ((al, ah), (bl, bh)):
                np.add.at(chain, lo[near], 1)
                np.add.at(chain, hi[near] - 1, -1)
            inner = np.flatnonzero(np.cumsum(chain)[:-1] > 0)
            label = _connect(label, np.concatenate([al[near], inner]), np.concatenate([bl[near], inner + 1]))
            group = np.cumsum(np.concatenate([[0], label[1:] != label[:-1]]))
        rest &= ~near
        if not rest.any():
            continue
        al, ah, bl, bh, errors = (x[rest] for x in pairs)
        bit -= 1
        am, bm = ah - (ones[bit][ah] - ones[bit][al]), bh - (ones[bit][bh] - ones[bit][bl])
        same = al == bl  # ranges at one depth are equal or apart
        alone = same & (ah - al == 1)
        found = []
        for a0, a1, b0, b1, more, off in ((al, am, bl, bm, 0, alone), (am, ah, bm, bh, 0, alone), (al, am, bm, bh, 1, alone), (am, ah, bl, bm, 1, same)):
            keep = (a0 < a1) & (b0 < b1) & (errors + more <= budget) & ~off
            found.append((a0[keep], a1[keep], b0[keep], b1[keep], errors[keep] + np.int8(more)))
        todo.append((bit, *(np.concatenate(x) for x in zip(*found, strict=True))))
    return label


def _stars(batches: Iterator[pa.RecordBatch], bits: int, budget: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, prints = batch.column("values"), batch.column("prints")
        sizes = np.diff(values.offsets.to_numpy(zero_copy_only=False))
        value = values.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        own = prints.flatten().to_numpy(zero_copy_only=False)
        bucket = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((value, bucket))
        value, own = value[order], own[order]
        label = trie_groups(value, bucket, bits, budget)
        far = np.flatnonzero(label != np.arange(len(label)))
        yield pa.RecordBatch.from_arrays([pa.array(own[label[far]]), pa.array(own[far])], ["a", "b"])


def _parted(rows: DataFrame, bits: int, budget: int) -> tuple[DataFrame, int]:
    """Each row once for each of `budget + 1` blocks of the low `bits` bits of `value`, turned so that the block comes
    first among them; `path` names the blocks chosen so far. Also the bits that remain below the block.

    Blocks are of one size; bits that are left over belong to none, which only makes a block agree more often."""
    n = budget + 1
    size = bits // n
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1)
    value = F.col("value")
    low = value.bitwiseAND(mask)

    def turned(k: int) -> Column:
        by = k * size
        if not by:
            return value
        spun = F.shiftleft(low, by).bitwiseOR(F.shiftrightunsigned(low, bits - by)).bitwiseAND(mask)
        return value.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(spun)

    each = F.array(*[F.struct((F.col("path") * n + k).alias("path"), turned(k).alias("value")) for k in range(n)])
    return rows.select("print", F.explode(each).alias("x")).select("print", "x.path", "x.value"), bits - size


def stars(prints: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct values of `prints.print` that connect all within `budget` differing bits."""
    rows, bits = _parted(prints.select("print", F.lit(0).cast("long").alias("path"), F.col("print").alias("value")), BITS, budget)
    found: DataFrame | None = None
    while True:
        keyed = rows.withColumn("key", F.shiftrightunsigned("value", bits))
        hot = None
        if bits > 2 * (budget + 1):
            hot = cut(keyed.groupBy("path", "key").count().where(F.col("count") > bucket).select("path", "key"))
            if hot.isEmpty():
                hot = None
        cool = keyed.join(hot, ["path", "key"], "left_anti") if hot else keyed
        held = cool.groupBy("path", "key").agg(F.collect_list("value").alias("values"), F.collect_list("print").alias("prints")).where(F.size("values") > 1)

        def links(batches: Iterator[pa.RecordBatch], bits: int = bits) -> Iterator[pa.RecordBatch]:
            return _stars(batches, bits, budget)

        made = held.select("values", "prints").mapInArrow(links, "a long, b long")
        found = found.unionAll(made) if found else made
        if not hot:
            return found.distinct()
        rows, bits = _parted(keyed.join(hot, ["path", "key"], "left_semi"), bits, budget)


def components(links: DataFrame) -> DataFrame:
    """vertex, root: the least vertex that links (a, b) lead to. Each round takes the least label among a vertex and
    its neighbours, then the label of that label, so long chains shrink by half or better. The many rows of a hub, or of
    the root of a large class, aren't moved to the row that they are joined with."""
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    hubs = hot_keys(both, "b")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("vertex"), "root"))
    while True:
        near = spread_join(both, "b", labels.select(F.col("vertex").alias("b"), "root"), hubs).groupBy("a").agg(F.min("root").alias("near"))
        stepped = labels.join(near, labels["vertex"] == near["a"], "left").select("vertex", F.col("root").alias("was"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("vertex").alias("root"), F.col("root").alias("to"))
        stepped = cut(stepped)
        now = cut(spread_join(stepped, "root", jump, hot_keys(stepped, "root"), "left").select("vertex", "was", F.least("root", F.coalesce("to", "root")).alias("root")))
        if now.where("was <> root").isEmpty():
            return now.select("vertex", "root")
        labels = now.select("vertex", "root")


def classes(docs: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """For each row of `docs` its doc_id, text_hash, print and component_id: the least doc_id reachable over links.

    A null text counts as empty, with fingerprint zero. Rows that repeat are all kept. A null doc_id never names a
    class; a class of such rows alone has a null component_id. An empty table gives no rows; other columns are ignored."""
    prints = cut(fingerprints(docs))
    least = cut(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(stars(least.select("print"), budget, bucket))
    joined = cut(least.join(roots, least["print"] == roots["vertex"], "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    best = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(joined, "root", best, hot_keys(joined, "root")).select("print", "component_id")
    return spread_join(prints, "print", named, hot_keys(prints, "print")).select("doc_id", "text_hash", "print", "component_id")


def keep_one(docs: DataFrame, budget: int = BUDGET, bucket: int = BUCKET) -> DataFrame:
    """The rows of `docs`, with its columns, that stay when of each class only the document of the least doc_id does.

    Of rows that repeat a doc_id one stays. Rows without a doc_id go if their class has a document with one;
    else one of each text stays. Columns may have any name."""
    found = cut(classes(docs, budget, bucket))
    chosen = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash")
    single = chosen.groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("n")).where("doc_id is not null")
    nameless = chosen.where("doc_id is null").select("text_hash").distinct()
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"))
    named = rows.join(single, ["doc_id", "text_hash"])
    once = named.where("n = 1").select("row")
    again = named.where("n > 1").groupBy("doc_id").agg(F.any_value("row").alias("row")).select("row")
    rest = rows.where("doc_id is null").join(nameless, "text_hash", "left_semi").groupBy("text_hash").agg(F.any_value("row").alias("row")).select("row")
    return once.unionAll(again).unionAll(rest).select("row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict[str, str] = {}
