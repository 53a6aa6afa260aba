"""Host-level quality rules, in DataFrame functions alone.

Each document is measured in one pass. Failures of the document rules are counted by host, each host's rate is shrunk
towards the rate of all hosts with a beta prior estimated from the hosts themselves, and a host over the limit takes
its documents with it. A document that fails the base rules goes whatever its host is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WORD_GAP, attach, cut, table, text_or_empty, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The share of a host's documents that may fail a rule, after shrinking.
HOST_LIMIT = 0.5
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` found once for each row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that the array holds twice or more. Windows are compared by 64-bit hashes."""

    def covered(at: Column) -> Column:
        """Words in windows beginning at the ascending places `at`."""
        gaps = F.transform(at, lambda p, k: F.when(k < F.size(at) - 1, F.least(F.lit(window), F.get(at, k + 1) - p)).otherwise(window))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def of_sorted(pairs: Column) -> Column:
        again = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        return let(F.sort_array(F.transform(again, lambda x: x["k"])), covered)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(pairs, of_sorted))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, 0).otherwise(let(hashes, of_hashes))


def measures(text: str = "text") -> Column:
    """A struct of MEASURES and base_failed. It is one expression that binds the words once: as columns of their own
    they would be split anew for each use when a filter on the measures is pushed below them."""
    held = text_or_empty(text)
    lines = F.filter(F.split(held, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return let(
            F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                (F.length(held) - F.length(F.translate(held, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                repeat_words(words).cast("long").alias("n_repeat_words"),
            ),
            lambda m: F.struct(*[m[k].alias(k) for k in MEASURES], ((m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])).alias("base_failed")),
        )

    return let(F.array_remove(F.split(held, WORD_GAP), ""), of_words)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with MEASURES and base_failed, in place of columns of these names; a null text counts as empty."""
    rest = [c for c in docs.columns if c not in (*MEASURES, "base_failed")]
    return docs.select(*[F.col(f"`{c}`") for c in rest], measures(text).alias("__m")).select(*[F.col(f"`{c}`") for c in rest], "__m.*")


def rule_failed(m: Column) -> Column:
    """Whether a document of these measures counts against its host: a base rule, many symbols, repeated lines or odd words."""
    words, chars = m["n_words"], m["word_chars"]
    return m["base_failed"] | (10 * m["n_symbols"] > words) | (m["n_dup_lines"] > 5) | (chars < 2 * words) | (chars > 20 * words)


def host_rates(rows: DataFrame, failed: Column) -> tuple[DataFrame, int]:
    """For each `host` its documents, failures and shrunk rate, and the number of hosts; rows without a host have none.

    The prior's mean is the mean of the hosts' rates; its weight follows from how far their variance exceeds what
    chance alone gives (no excess: all the weight that any host's documents have). Both are sums over hosts."""
    by = cut(rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    mean, spread, chance, most, hosts = by.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("n_docs")), F.max("n_docs"), F.count("*")).first()
    if not hosts:
        return by.withColumn("host_rate", rate), 0
    excess = spread - mean * (1 - mean) * chance
    weight = max(0.0, mean * (1 - mean) / excess - 1) if excess > 0 else float(most)
    return by.withColumn("host_rate", (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))), hosts


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """For each row of `docs` its doc_id, host, MEASURES, base_failed, host_rate and kept.

    A null text counts as empty and fails. Without a host the base rules alone decide. Rows that repeat are all
    kept and each count. An empty table gives no rows; other columns are ignored."""
    found = cut(measured(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text"))
    rates, hosts = host_rates(found, rule_failed(F.struct(*MEASURES, "base_failed")))
    rated = attach(found, "host", rates.select("host", "host_rate"), hosts, F.col("doc_id"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.coalesce("host_rate", F.lit(0.0)) <= limit))


def keep(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of `docs`, with its columns, that `judge` keeps. Columns may have any name.

    Texts are measured once: what a row is judged by is written beside it, without the row where the base rules fail."""
    verdict = let(measures(), lambda m: F.struct(m["base_failed"].alias("base"), rule_failed(m).alias("failed")))
    held = docs.select(F.col(host).alias("host"), verdict.alias("v"), F.struct("*").alias("row"))
    held = written(held.select("host", F.col("v.failed").alias("failed"), F.when(~F.col("v.base"), F.col("row")).alias("row")))
    rates, hosts = host_rates(held, F.col("failed"))
    rated = attach(held.where("row is not null").select("host", "row"), "host", rates.select("host", "host_rate"), hosts, F.col("row.doc_id"))
    return rated.where(F.coalesce("host_rate", F.lit(0.0)) <= limit).select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL = {
    "op4_quality": f"""
    with held as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
    split as (select *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from held),
    windows as (select r, i, words[i:i+{WINDOW - 1}] as w from (select r, words, unnest(range(1, greatest(1, len(words) - {WINDOW - 2}))) as i from split)),
    again as (select r, i from (select r, i, count(*) over (partition by r, w) as n from windows) where n > 1),
    covered as (select r, count(distinct i + k) as n from again, range(0, {WINDOW}) as s(k) group by r),
    measures as (select r, doc_id, source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
              (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols,
              (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words
              from split left join covered using (r)),
    base as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from measures),
    rules as (select *, base_failed or 10 * n_symbols > n_words or n_dup_lines > 5 or word_chars / n_words < 2 or word_chars / n_words > 20 as failed from base),
    hosts as (select source, count(*) as n, sum(failed::int)::bigint as f from rules where source is not null group by source),
    moments as (select avg(f / n) as m, var_pop(f / n) as v, avg(1 / n) as c, max(n) as most from hosts),
    prior as (select m, case when v - m * (1 - m) * c > 0 then greatest(0, m * (1 - m) / (v - m * (1 - m) * c) - 1) else most end as weight from moments),
    rates as (select source, (f + m * weight) / (n + weight) as rate from hosts, prior)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and coalesce(rate, 0) <= {HOST_LIMIT} as kept
    from rules left join rates using (source)
    """
}
