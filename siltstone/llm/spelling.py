"""Spelling variants by full neighbourhood generation.

The distinct words are counted once. Of each word all distinct deletions, replacements and insertions over the
alphabet that the words are made of are generated and joined, by hash, with the words: what is found is at distance
one by construction and isn't measured again. A candidate is made as two 64-bit sums over its code points, from the
word's own sums, so its letters are never put together. Before candidates are shuffled they are looked up in a bit
field of the words' first sums; it has a fixed size, and where it is crowded the join has more to do, no less to find.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import cut, hot_keys, spread_join, table, text_or_empty

#: A letter is dropped from a run of letters whose hash this divides.
DROP_EVERY = 199
#: Least code points and occurrences of a word, and how many times more often its form must occur.
LENGTH, OCCURRENCES, TIMES = 6, 5, 5
#: Bits of the field that candidates are looked up in: 16 MiB, however many words there are.
FIELD_BITS = 27
_RUN = re.compile("[a-zÀ-ÿ]+")
#: Words that a task counts before it hands them on, and (place, letter) pairs of words that it takes at a time.
_HELD, _PAIRS = 500_000, 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SALTS = (0x632BE59BD9B4E019, 0xE7037ED1A0B428DB)


def count_words(doc_id: str, text: str, found: Counter, length: int = LENGTH, every: int = DROP_EVERY) -> None:
    """Adds the words of a text: runs of letters, A-Z in lower case, some of them short of a letter."""
    start = zlib.crc32(f"{doc_id}:".encode())
    # Bytes know lower case of A-Z alone.
    for word, n in Counter(_RUN.findall(text.encode("utf-8", "replace").lower().decode())).items():
        h = zlib.crc32(word.encode(), start)
        if h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= length:
            found[word] += n


def _counted(batches: Iterator[pa.RecordBatch], length: int, every: int) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            count_words(doc_id, text, found, length, every)
            if len(found) >= _HELD:
                yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                found.clear()
    yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})


def words(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES, every: int = DROP_EVERY) -> DataFrame:
    """word, n of all words of `length` code points or more that occur `least` times or more in `docs`."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), text_or_empty().alias("text"))
    counted = rows.mapInArrow(lambda batches: _counted(batches, length, every), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A number of 64 bits for each code point."""
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a batch, one code point after the other, and the two sums of each: number of letter times base^place."""

    def __init__(self, listed: list[str]):
        self.size = np.fromiter(map(len, listed), np.int64, len(listed))
        self.letters = np.frombuffer("".join(listed).encode("utf-32-le"), "<u4")
        self.begin = np.cumsum(self.size) - self.size
        place = np.arange(len(self.letters)) - np.repeat(self.begin, self.size)
        longest = int(self.size.max(initial=0)) + 1
        self.power = [_powers(b, longest) for b in _BASES]
        self.sums, self.prefix = [], []
        for base, salt in enumerate(_SALTS):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(self.letters, salt) * self.power[base][place])])
            self.prefix.append(total)
            self.sums.append(total[self.begin + self.size] - total[self.begin])

    def neighbours(self, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of all distinct deletions, replacements and insertions: the row of the word and the candidate's two sums."""
        places = self.size + 1
        end = np.cumsum(places)
        step = max(1, _PAIRS // max(1, len(alphabet)))
        for at in range(0, int(end[-1]) if len(end) else 0, step):
            pair = np.arange(at, min(at + step, int(end[-1])))
            row = np.searchsorted(end, pair, side="right")
            i = pair - (end[row] - places[row])
            inner = np.flatnonzero(i < self.size[row])
            here = self.begin[row] + i
            letter = np.full(len(pair), -1, np.int64)
            letter[inner] = self.letters[here[inner]]
            before = np.full(len(pair), -1, np.int64)
            later = np.flatnonzero(i > 0)
            before[later] = self.letters[here[later] - 1]
            # Of a run of equal letters the first is deleted; a letter isn't put behind its like.
            gone = inner[letter[inner] != before[inner]]
            put = np.nonzero(before[:, None] != alphabet[None, :])
            other = np.nonzero((letter[:, None] != alphabet[None, :]) & (letter >= 0)[:, None])
            made = []
            for k, salt in enumerate(_SALTS):
                whole, power = self.sums[k][row], self.power[k][i]
                pre = self.prefix[k][here] - self.prefix[k][self.begin[row]]
                suf = whole - pre
                own, letters = np.zeros(len(pair), np.uint64), _mixed(alphabet, salt)
                own[inner] = _mixed(letter[inner], salt) * power[inner]
                base, back = np.uint64(_BASES[k]), np.uint64(pow(_BASES[k], -1, 1 << 64))
                deleted = pre[gone] + (suf[gone] - own[gone]) * back
                replaced = (whole - own)[other[0]] + letters[other[1]] * power[other[0]]
                inserted = (pre + suf * base)[put[0]] + letters[put[1]] * power[put[0]]
                made.append(np.concatenate([deleted, replaced, inserted]))
            yield np.concatenate([row[gone], row[other[0]], row[put[0]]]), *made


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Words(batch.column("word").to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(_signed, found.sums)], [*batch.schema.names, "a", "b"])


def _slot(sums: np.ndarray) -> np.ndarray:
    return sums >> np.uint64(64 - FIELD_BITS)


def _candidates(batches: Iterator[pa.RecordBatch], alphabet: np.ndarray, field: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Words(batch.column("word").to_pylist())
        for row, a, b in found.neighbours(alphabet):
            slot = _slot(a)
            there = np.flatnonzero((field[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
            row = row[there]
            yield pa.RecordBatch.from_arrays([_signed(x) for x in (a[there], b[there], found.sums[0][row], found.sums[1][row])], ["a", "b", "own_a", "own_b"])


def _field(keyed: DataFrame) -> np.ndarray:
    """The bit field of the words' first sums; at most 2^21 rows of 64 bits come to the driver."""
    slot = F.shiftrightunsigned("a", 64 - FIELD_BITS)
    bits = keyed.select(F.shiftrightunsigned(slot, 6).alias("at"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(a, {64 - FIELD_BITS}) & 63))").alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << (FIELD_BITS - 6), np.int64)
    field[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return field.view(np.uint8)


def near(keyed: DataFrame) -> DataFrame:
    """own_a, own_b of a word, and word, n of each word that differs from it by one letter; `keyed` has word, n, a, b."""
    spark = keyed.sparkSession
    # At most 90 letters, as runs are of so many kinds of code points.
    letters = keyed.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.int64)
    field = spark.sparkContext.broadcast(_field(keyed))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = keyed.repartition(tasks, "a").mapInArrow(lambda batches: _candidates(batches, alphabet, field.value), "a long, b long, own_a long, own_b long")
    return made.join(keyed, ["a", "b"]).select("own_a", "own_b", "word", "n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word that `form` leads to from each word of `forms` (word, form), itself if its form is null.

    Each round follows the form that the round before has found, so chains shrink by half."""
    found = cut(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        to = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = cut(spread_join(found, "root", to, hot_keys(found, "root")).select("word", "root", "next"))
        if found.where("root <> next").isEmpty():
            return found.select("word", "root")
        found = found.select("word", F.col("next").alias("root"))


def variants(docs: DataFrame, length: int = LENGTH, least: int = OCCURRENCES, times: int = TIMES, every: int = DROP_EVERY) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of `docs` (doc_id, text).

    A null text counts as empty, a null doc_id as the empty text; rows that repeat are counted each; an empty table
    gives no rows. A word's form is its near word of largest n, of these the smallest in code-point order, if it occurs
    `times` times as often; form and form_n are null otherwise. Other columns are ignored, whatever their names."""
    keyed = cut(words(docs, length, least, every).mapInArrow(_keyed, "word string, n long, a long, b long"))
    rank: Column = F.struct(-F.col("n"), "word")
    best = near(keyed).groupBy("own_a", "own_b").agg(F.count("*").alias("n_near"), F.min(rank).alias("best"))
    joined = keyed.join(best, (keyed["a"] == best["own_a"]) & (keyed["b"] == best["own_b"]), "left")
    often = -F.col("best.col1") >= F.col("n") * times
    formed = cut(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.col1")).alias("form_n")))
    return formed.join(roots(formed), "word").select("word", "form", "root", "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling": op11_spelling}
ORACLE_SQL: dict[str, str] = {}
