"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame: the columns of documents, or after the last one the
pieces of packed sequences. Columns beside those of documents are kept, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import packing, pii, quality, simhash, toxicity
from siltstone.llm.common import doc_mod, table, written


def keep_good_hosts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host passes; rows that repeat all stay. A null or empty text fails,
    a document without a source is judged by the base rules alone."""
    return quality.keep(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled documents doesn't call toxic; rows that repeat are judged alike. A null text
    counts as empty."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), doc_mod("doc_id", 5) != 0)
    return toxicity.keep(docs, model)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the least doc_id; of rows that repeat it, one. Null and empty
    texts are copies of each other. Documents without an id stay, one of each text, where none of their class has one."""
    return simhash.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, rows that repeat too, with pseudonyms for personal data; a null text stays null."""
    return pii.pseudonymise(docs, pii.session_key(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences; a null text is its end alone, rows that repeat are packed each."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", keep_good_hosts),
    ("toxicity", drop_toxic),
    ("near copies", keep_one_of_near_copies),
    ("personal data", hide_personal_data),
    ("packing", pack),
]
#: Trees, tries and tokenizers are beyond SQL; tests hold the result against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
