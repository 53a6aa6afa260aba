"""Language identification by compression: the language whose dictionary makes a text smallest.

For each language a raw-content zstandard dictionary is made of whole labelled texts. A text is compressed once
with each; the smallest result names the language, or of equal ones the language with most learnable documents.
Where the best two differ by less than `MARGIN` of the size, the verdict is marked as rejected. Texts are compressed
in lower case and without ASCII digits and punctuation, which tell little of a language.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from siltstone.llm.common import attach, cut, doc_mod, table

#: Texts that a dictionary is made of at most, and the bytes at which it takes no further one; of a text that alone is
#: longer, so many characters. These bound the sample that is learned from, and what the driver collects.
SAMPLE_DOCS, DICT_BYTES = 200, 256 << 10
LEVEL, MARGIN, UNKNOWN = 6, 0.01, "und"
_DROPPED = bytes(b for b in range(33, 127) if not chr(b).isalpha())
#: Letters, and a few signs such as fractions and Roman numerals, which are none.
_LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "lang_pred string, score double, margin double, rejected boolean"


def plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(None, _DROPPED)


def sample(docs: DataFrame, learnable: Column, per_lang: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> DataFrame:
    """At most `per_lang` texts of each language, those of the least hashes, until they have `dict_bytes` bytes: a
    uniform sample of bounded size."""
    usable = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rank = F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    share = cut(usable.groupBy("lang").agg((F.lit(4.0 * per_lang) / F.count("*")).alias("__share"), F.count("*").alias("__docs")))
    rows = attach(usable.select("lang", "text", "doc_id", rank.alias("__rank")), "lang", share, share.count(), F.col("doc_id"))
    few = rows.where("__rank < __share").select("lang", F.substring("text", 1, dict_bytes).alias("text"), "__rank", "__docs")
    by_rank = W.partitionBy("lang").orderBy("__rank", "text")
    held = F.coalesce(F.sum(F.octet_length("text")).over(by_rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    few = few.withColumn("__n", F.row_number().over(by_rank)).where(F.col("__n") <= per_lang).withColumn("__held", held)
    return few.where(F.col("__held") < dict_bytes).select("lang", "text", "__n", "__docs")


def learn(docs: DataFrame, learnable: Column, per_lang: int = SAMPLE_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, of at most `dict_bytes` bytes and one text; languages of most documents first."""
    found: dict[str, list[bytes]] = {}
    rows = sample(docs, learnable, per_lang, dict_bytes).collect()
    for lang, text, _, _ in sorted(rows, key=lambda r: (-r["__docs"], r["lang"], r["__n"])):
        found.setdefault(lang, []).append(plain(text))
    return {lang: b"\n".join(parts) for lang, parts in found.items()}


def spoken(text: str | None) -> bool:
    """Whether a text has a letter."""
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def _classify(batches: Iterator[pa.RecordBatch], dictionaries: dict[str, bytes], level: int, margin: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import zstandard

    langs, packers = list(dictionaries), []
    for content in dictionaries.values():
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=level)
        packers.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False))
    for batch in batches:
        out = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            if not langs or not spoken(text):
                out.append((UNKNOWN, 0.0, 0.0, True))
                continue
            data = plain(text)
            sizes = [len(p.compress(data)) for p in packers]
            order = sorted(range(len(langs)), key=lambda i: (sizes[i], i))
            best = sizes[order[0]]
            gap = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
            spread = max(2.0, math.sqrt(best))
            weight = sum(math.exp((best - s) / spread) for s in sizes)
            out.append((langs[order[0]], 1 / weight, gap, gap < margin))
        cols = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.float64(), pa.float64(), pa.bool_())]
        kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"]
        yield pa.RecordBatch.from_arrays([*kept, *cols], schema.names)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN) -> DataFrame:
    """For each row of `docs` its doc_id, lang_pred, score (the winner's share of exp(-size)), margin and rejected.

    A text that is null or without a letter, and any text where no language was learned, gets `und`, score 0 and
    rejected. Of languages with equal sizes the first in `dictionaries` wins, with margin 0. Rows that repeat are all kept; an
    empty table gives no rows; other columns are ignored."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(SCHEMA)])
    names = pa.schema([(n, pa.null()) for n in schema.names])
    return docs.select("doc_id", "text").mapInArrow(partial(_classify, dictionaries=dictionaries, level=level, margin=margin, schema=names), schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = doc_mod("doc_id", 4) == 2
    return identify(docs, learn(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "margin", "rejected")


QUERIES = {"op10_language": op10_language}
ORACLE_SQL: dict[str, str] = {}
