"""Robots rules: texts of robots.txt and paths in, verdicts out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.postings import strip
from siltstone.functions.text import once
from siltstone.sources.tables import bounded


def pattern_of(rule: Column) -> Column:
    """A rule's path as a regular expression: a star is anything, a dollar at the end is the end, all else is itself.

    What follows a star is taken at the first place that has it and isn't tried at later ones, as that loses no match;
    only what must be at the end is sought from there. So a rule of many stars takes no longer than its path has places."""
    ends = rule.endswith("$")
    plain = F.when(ends, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    parts = F.transform(F.split(plain, r"\*"), lambda x: F.regexp_replace(x, r"([^\p{L}\p{N}/_])", r"\\$1"))

    def joined(parts: Column) -> Column:
        last = F.when(ends & (F.size(parts) > 1), F.concat(F.lit(".*"), F.element_at(parts, -1))).otherwise("")
        between = F.slice(parts, F.lit(2), F.greatest(F.lit(0), F.size(parts) - F.when(ends, 2).otherwise(1)))
        taken = F.array_join(F.transform(between, lambda x: F.concat(F.lit("(?>.*?"), x, F.lit(")"))), "")
        return F.concat(F.lit("(?s)^"), parts[0], taken, last, F.when(ends, "$").otherwise(""))

    return once(parts, joined)


def rules(bodies: DataFrame, agent: str) -> DataFrame:
    """host and its rules for an agent: an array of length, allow, pattern and rule.

    Lines that name agents begin a group; rules for the agent by name count, those for all agents only without them.
    Comments and lines without a colon say nothing, nor does an empty rule."""
    lines = bodies.select("host", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("n", "raw")).withColumn("line", F.regexp_replace("raw", "#.*$", "")).where(F.col("line").contains(":"))
    parts = F.split("line", ":", 2)
    lines = lines.select("host", "n", F.lower(F.trim(parts[0])).alias("field"), F.coalesce(strip(parts[1]), F.lit("")).alias("value"))
    order = Window.partitionBy("host").orderBy("n")
    names = F.col("field") == "user-agent"
    starts = names & ~F.coalesce(F.lag("field").over(order) == "user-agent", F.lit(False))
    grouped = lines.withColumn("group", F.sum(starts.cast("int")).over(order))
    said = F.lower("value")
    own = names & (said != "*") & (F.lit(agent).contains(said) | said.contains(agent))
    groups = grouped.groupBy("host", "group").agg(F.bool_or(own).alias("own"), F.bool_or(names & (said == "*")).alias("every"))
    kept = grouped.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).join(groups, ["host", "group"]).where("own or every")
    rule = F.struct(F.length("value").alias("length"), (F.col("field") == "allow").alias("allow"), pattern_of(F.col("value")).alias("pattern"), F.col("value").alias("rule"))
    by = kept.groupBy("host").agg(F.collect_list(F.when(F.col("own"), rule)).alias("own"), F.collect_list(F.when(F.col("every"), rule)).alias("every"))
    return by.select("host", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every")).alias("rules"))


#: Bytes of a robots.txt that are read; the rest is passed over.
MOST_BYTES = 512 * 1024


def published(answers: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """host, status, body, truncated and state of answers (host, status, body as bytes or text) for robots.txt.

    Of a body the first `most` bytes count. A status from 400 says NOT_PUBLISHED, one from 500, and no answer at all,
    UNAVAILABLE; their bodies aren't read. READ bodies are what `verdicts` takes."""
    held = answers.select("host", "status", F.col("body").cast("binary").alias("body"))
    text, more = bounded("body", most)
    state = F.when(F.col("status").between(400, 499), "NOT_PUBLISHED").when(F.col("status").isNull() | (F.col("status") >= 500) | F.col("body").isNull(), "UNAVAILABLE").otherwise("READ")
    read = state == "READ"
    return held.select("host", "status", F.when(read, text).alias("body"), (read & more).alias("truncated"), state.alias("state"))


def verdicts(bodies: DataFrame, paths: DataFrame, agent: str) -> DataFrame:
    """host, path, verdict and rule for each row of `paths` (host, path). `bodies` has one row a host: host, status, body.

    The longest rule that matches decides, of equally long ones the one that allows. Without a rule a path is allowed.
    A status from 400 says that no rules are published, one from 500 and a missing body that they can't be told."""
    held = bodies.select("host", "status", F.col("body").isNotNull().alias("read")).join(rules(bodies.where("status < 400"), agent), "host", "left")
    rows = paths.join(held, "host", "left")
    hits = F.filter("rules", lambda r: F.rlike(F.col("path"), r["pattern"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["length"], r["allow"], r["rule"])))
    out = rows.withColumn("best", best)
    verdict = F.when(F.col("status").between(400, 499), "NOT_PUBLISHED").when(F.col("status").isNull() | (F.col("status") >= 500) | ~F.col("read"), "UNAVAILABLE").when(F.col("best").isNull() | F.col("best.allow"), "ALLOWED").otherwise("DISALLOWED")
    return out.select("host", "path", verdict.alias("verdict"), F.when(F.col("status") < 400, F.col("best.rule")).alias("rule"))
