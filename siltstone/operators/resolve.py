"""Which site a company's name means: a cascade of evidence whose outcome is by how many sites it leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.records import company_core, domain_guesses
from siltstone.functions.text import has_text, slugify


def resolved(names: DataFrame, registry: DataFrame, seeds: DataFrame, verified: DataFrame, name: str = "name") -> DataFrame:
    """The columns of `names` with slug, outcome, evidence and domains (sorted) for each row's `name`.

    In this order: what `registry` (slug, domain) has for the name's slug; the domains of `seeds` (domain) whose first label is
    the name's core words, joined by hyphens or by nothing; of the domains that are constructed from the name those that
    `verified` (domain, slug) tells to have answered as that company. The first of the three that has any decides: one
    domain is RESOLVED, more are AMBIGUOUS, as no one is guessed at, and none anywhere is NOT_FOUND. A blank name and one
    without letters or digits aren't looked up. Each distinct name is looked up once, whatever the number of its rows."""
    each = names.select(F.col(name).alias("__name")).distinct().where(has_text(F.col("__name")))
    each = each.withColumn("slug", slugify(F.col("__name"))).where("slug <> ''").withColumn("core", company_core(F.col("__name")))
    known = each.join(registry.where(has_text(F.col("domain"))).select("slug", "domain").distinct(), "slug").select("__name", F.lit(1).alias("step"), "domain")
    labels = each.select("__name", F.explode(F.array_distinct(F.array(F.array_join("core", "-"), F.array_join("core", "")))).alias("label"))
    seeded = labels.join(seeds.select(F.lower(F.split("domain", r"\.")[0]).alias("label"), "domain").distinct(), "label").select("__name", F.lit(2).alias("step"), "domain")
    guessed = each.select("__name", "slug", F.explode(domain_guesses(F.col("__name"))).alias("domain"))
    answered = guessed.join(verified.select("domain", "slug").distinct(), ["domain", "slug"]).select("__name", F.lit(3).alias("step"), "domain")
    found = known.unionAll(seeded).unionAll(answered).groupBy("__name", "step").agg(F.array_sort(F.collect_set("domain")).alias("domains"))
    best = found.groupBy("__name").agg(F.min(F.struct("step", "domains")).alias("best"))
    step = F.col("best.step")
    evidence: Column = F.when(F.col("best").isNull(), None).when(step == 1, "REGISTRY").when(step == 2, "SEED_LIST").otherwise("VERIFIED_SITE")
    count = F.size("best.domains")
    outcome = F.when(count == 1, "RESOLVED").when(count > 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    rows = names.join(best, names[name].eqNullSafe(best["__name"]), "left").drop("__name")
    slug = F.when(has_text(F.col(name)), slugify(F.col(name))).otherwise("")
    return rows.select(*[F.col(f"`{c}`") for c in names.columns], slug.alias("slug"), outcome.alias("outcome"), evidence.alias("evidence"), F.coalesce("best.domains", F.array().cast("array<string>")).alias("domains"))
