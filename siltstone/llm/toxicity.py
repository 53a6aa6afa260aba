"""Toxicity of whole texts: gradient-boosted trees over dense features, calibrated by isotonic regression.

A bounded sample of labelled documents is dealt by a hash into three parts: one gives the lexicon (words and word beginnings
that toxic documents hold far more often), one the trees, one the calibration. Features: densities of
the lexicon over the text and in its densest window, hits near a word of address, capitals, punctuation and
obfuscation. They are found for each distinct word of a batch and gathered over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import cut, doc_mod, table, text_or_empty
from siltstone.llm.tokens import slices

#: Labelled documents that a model is fitted to, on average.
SAMPLE = 20_000
#: An entry is in at least so many toxic documents of its part, and its log odds are so many standard errors over zero.
LEAST_DOCS, LEAST_Z = 3, 2.5
STEMS = (4, 5, 6)
#: The parts of a class's documents in turn: below 5 for the lexicon, below 8 for the trees, the others for calibration.
DEAL = (5, 8, 0, 6, 1, 9, 2, 7, 3, 4)
NEAR, WINDOW = 5, 50
#: Words that address the reader, in the languages of the corpus.
ADDRESS = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "tú", "ti", "usted", "ustedes", "vos"]
#: Signs that stand in for letters.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
FEATURES = ["hits", "density", "weight", "densest", "addressed", "masked", "capitals", "shouted", "punctuation", "exclaimed", "obfuscated", "log_words"]


def _words(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The letters of each chunk in lower case, as they stand and with stand-ins read as letters."""
    low = pc.utf8_lower(chunks)
    read = low
    for sign, letter in STAND_INS.items():
        read = pc.replace_substring(read, sign, letter)
    return pc.replace_substring_regex(low, r"[^\p{L}]+", ""), pc.replace_substring_regex(read, r"[^\p{L}]+", "")


def _weights(words: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """The largest weight of a lexicon entry that a word is, or begins with."""
    known, weight = pa.array(list(lexicon), pa.string()), np.array([0.0, *lexicon.values()])
    best = np.zeros(len(words))
    for form in (pc.binary_join_element_wise(words, "$", ""), *(pc.utf8_slice_codeunits(words, 0, n) for n in STEMS)):
        at = pc.fill_null(pc.index_in(form, known), -1).to_numpy(zero_copy_only=False)
        best = np.maximum(best, weight[at + 1])
    return best


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums within each text; differences of sums over the batch would depend, in the last bits, on the texts before."""
    return np.bincount(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), values, len(bounds) - 1)


def features(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    """A row of FEATURES for each text (no nulls)."""
    split = pc.split_pattern_regex(texts, r"[\x09-\x0D ]+")
    codes = split.values.dictionary_encode()
    chunks, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
    at = split.offsets.to_numpy(zero_copy_only=False)
    bounds = (at - at[0]).astype(np.int64)
    plain, read = _words(chunks)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(chunks, pattern).to_numpy(zero_copy_only=False).astype(np.float64)

    size = pc.utf8_length(chunks).to_numpy(zero_copy_only=False)
    letters, capitals = count(r"\p{L}"), count(r"\p{Lu}")
    shown = _weights(plain, lexicon)
    weight = np.maximum(shown, _weights(read, lexicon))
    address = pc.is_in(plain, pa.array(ADDRESS)).to_numpy(zero_copy_only=False)
    mixed = pc.match_substring_regex(chunks, r"\p{L}[^\p{L}\s'’-]+\p{L}").to_numpy(zero_copy_only=False)
    words = np.maximum(1, _per_text((size > 0)[code], bounds))
    signs = np.maximum(1, _per_text(size[code], bounds))
    hit = weight[code] > 0
    upto = np.concatenate([[0], np.cumsum(hit)])
    spoken = np.concatenate([[0], np.cumsum(address[code])])
    place = np.flatnonzero(hit)
    text = np.searchsorted(bounds, place, side="right") - 1
    begin, end = bounds[text], bounds[text + 1]
    densest, addressed = np.zeros(len(texts)), np.zeros(len(texts))
    np.maximum.at(densest, text, upto[np.minimum(place + WINDOW, end)] - upto[place])
    np.add.at(addressed, text, spoken[np.minimum(place + NEAR + 1, end)] > spoken[np.maximum(place - NEAR, begin)])
    hits = _per_text(hit, bounds)
    per = {
        "hits": hits,
        "density": 100 * hits / words,
        "weight": _per_text(weight[code], bounds),
        "densest": densest,
        "addressed": 100 * addressed / words,
        "masked": _per_text((weight > shown)[code], bounds),
        "capitals": _per_text(capitals[code], bounds) / np.maximum(1, _per_text(letters[code], bounds)),
        "shouted": _per_text(((capitals == letters) & (letters > 2))[code], bounds) / words,
        "punctuation": _per_text(count(r"[^\p{L}\p{N}\s]")[code], bounds) / signs,
        "exclaimed": 100 * _per_text(count(r"[!?]")[code], bounds) / signs,
        "obfuscated": 100 * _per_text(mixed[code], bounds) / words,
        "log_words": np.log1p(words),
    }
    return np.column_stack([per[k].astype(np.float64) for k in FEATURES])


def _featured(batches: Iterator[pa.RecordBatch], lexicon: dict[str, float], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        given = batch.column("text")
        for begin, texts in slices(pc.fill_null(given, pa.scalar("", given.type))):
            rows = batch.slice(begin, len(texts))
            rows = rows if with_text else rows.drop_columns(["text"])
            found = features(texts, lexicon)
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(found[:, i]) for i in range(len(FEATURES)))], [*rows.schema.names, *FEATURES])


def with_features(docs: DataFrame, lexicon: dict[str, float], with_text: bool = False) -> DataFrame:
    """The columns of `docs`, without `text` unless it is asked for, and FEATURES; a null text counts as empty."""
    rest = [f for f in docs.schema.fields if with_text or f.name != "text"]
    schema = T.StructType([*rest, *(T.StructField(k, T.DoubleType()) for k in FEATURES)])
    return docs.mapInArrow(partial(_featured, lexicon=lexicon, with_text=with_text), schema)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word (with `$`) and word beginning of a text, with the text's label."""
    for batch in batches:
        for begin, texts in slices(batch.column("text"), 1 << 20):
            split = pc.split_pattern_regex(texts, r"[\x09-\x0D ]+")
            _, read = _words(split.values)
            which = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy(zero_copy_only=False)))
            parts = []
            for form, least in ((pc.binary_join_element_wise(read, "$", ""), 3), *((pc.utf8_slice_codeunits(read, 0, n), n) for n in STEMS)):
                long = pc.greater_equal(pc.utf8_length(form), least)
                parts.append(pa.table({"text": pa.array(which).filter(long), "form": form.filter(long)}))
            once = pa.concat_tables(parts).group_by(["text", "form"]).aggregate([])
            label = batch.column("toxic").take(pc.add(once["text"].combine_chunks(), begin))
            sums = pa.table({"form": once["form"].combine_chunks(), "toxic": label, "n": pa.array(np.ones(len(label), np.int64))}).group_by("form").aggregate([("toxic", "sum"), ("n", "sum")])
            yield from sums.select(["form", "toxic_sum", "n_sum"]).rename_columns(["form", "toxic", "n"]).to_batches()


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries and their smoothed log odds, from rows of text and toxic (0 or 1, long): all that meet LEAST_DOCS and
    LEAST_Z. As the rows are a bounded sample, so are the entries."""
    total = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    counts = rows.select("text", "toxic").mapInArrow(_forms, "form string, toxic long, n long").groupBy("form").agg(F.sum("toxic").alias("bad"), F.sum("n").alias("n"))
    a, b = F.col("bad") + 0.5, F.col("n") - F.col("bad") + 0.5
    odds = F.log(a / F.lit(bad + 1.0)) - F.log(b / F.lit(good + 1.0))
    strong = counts.where(F.col("bad") >= LEAST_DOCS).withColumns({"odds": odds, "z": odds / F.sqrt(1 / a + 1 / b)}).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= 2.5))
    return {r["form"]: r["odds"] for r in strong.orderBy("form").collect()}


@dataclass
class Model:
    """A lexicon with trees and their calibration, or a constant where the labels don't hold both classes."""

    lexicon: dict[str, float]
    trees: PipelineModel | None = None
    calibration: object = None
    constant: float = 0.0

    def score(self, docs: DataFrame, with_text: bool = False) -> DataFrame:
        """The columns of `docs`, without `text` unless it is asked for, and `score` from 0 to 1 in place of a column of that name.

        A null text counts as empty. Rows that repeat are all scored, alike; an empty table gives no rows."""
        kept, text = [c for c in docs.columns if c not in ("text", "score")], ["text"] * with_text
        if self.trees is None:
            return docs.select(*kept, *text, F.lit(float(self.constant)).alias("score"))
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row"), "text")  # names of their columns can't clash
        raw = vector_to_array("rawPrediction")[1].alias("margin")
        done = self.calibration.transform(self.trees.transform(with_features(held, self.lexicon, with_text)).select("__row", *text, raw))
        return done.select(*[F.col("__row")[c].alias(c) for c in kept], *text, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """A model from a sample of about `sample` labelled documents whose doc_id is `learnable`: all of a class up to half
    of the sample, more where the other class has fewer. Parts are dealt by class, and calibration weighs classes as the labels do.

    Labels that are null or not 0 or 1 are left out; of several labels for a document the largest counts."""
    given = labels.where(learnable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    many = {r[0]: r[1] for r in given.groupBy("toxic").count().collect()}
    rates = {label: min(1.0, max(sample / 2, sample - many.get(1 - label, 0)) / n) for label, n in many.items()}
    at = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    bound = F.when(F.col("toxic") == 1, int(rates.get(1, 1.0) * (1 << 30))).otherwise(int(rates.get(0, 1.0) * (1 << 30)))
    few = given.where(at < bound).withColumn("at", F.xxhash64(F.lit(13), "doc_id"))
    schema = T.StructType([*few.drop("at").schema.fields, T.StructField("part", T.LongType())])
    dealt, upto = [], {0: 0, 1: 0}
    for r in sorted(few.collect(), key=lambda r: (r["at"], r["doc_id"])):
        dealt.append((r["doc_id"], r["toxic"], DEAL[upto[r["toxic"]] % len(DEAL)]))
        upto[r["toxic"]] += 1
    few = docs.sparkSession.createDataFrame(dealt, schema)
    # The sample's labels are some 20,000 pairs of numbers, whatever the tables' sizes.
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id").select("text", "toxic", "part")
    rows = cut(rows)
    lexicon = learn_lexicon(rows.where("part < 5"))
    seen = cut(with_features(rows.where("part >= 5"), lexicon))
    share = {tuple(r[:2]): r[2] for r in seen.groupBy((F.col("part") >= 8).alias("late"), "toxic").count().collect()}
    if not (share.get((False, 0)) and share.get((False, 1))):
        return Model(lexicon, constant=many.get(1, 0) / sum(many.values()) if many else 0.0)
    whole = share.get((True, 0)) and share.get((True, 1))  # else a class has a single document
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.3, seed=5)
    early = assembler.transform(seen.where("part < 8")).select("features", F.col("toxic").cast("double").alias("toxic")).coalesce(4)
    boosted = PipelineModel([assembler, trees.fit(early)])
    late = boosted.transform(seen.where("part >= 8") if whole else seen).select(
        vector_to_array("rawPrediction")[1].alias("margin"), F.col("toxic").cast("double").alias("toxic"), F.when(F.col("toxic") == 1, 1 / rates[1]).otherwise(1 / rates[0]).alias("weight")
    )
    calibration = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score", weightCol="weight").fit(late.coalesce(1))
    return Model(lexicon, boosted, calibration)


def keep(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of `docs`, with its columns, whose score is below `limit`. Texts go to Python and back once, beside the row of the others."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(F.lit(True).alias("here"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    scored = model.score(docs.select(row.alias("row"), "text"), with_text=True).where(F.col("score") < limit)
    return scored.select(*[F.col("text") if c == "text" else F.col("row")[f"c{rest.index(c)}"].alias(c) for c in docs.columns])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = doc_mod("doc_id", 5) == 0
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = model.score(docs.select("doc_id", "text"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE_SQL: dict[str, str] = {}
