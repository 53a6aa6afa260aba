"""Scores of a candidate for a role, as Column expressions. Null means unknown, never zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.numbers import round_half_up
from siltstone.functions.text import has_text, once, overlap, tokens

#: The weight of each dimension and of each tier of skills.
WEIGHTS = {"skills": 40, "role": 20, "experience": 15, "location": 10, "seniority": 10, "work_mode": 5}
TIERS = {"required": 0.7, "preferred": 0.2, "optional": 0.1}


def experience_score(years: Column, least: Column, most: Column) -> Column:
    """100 inside the range; 25 less for each year short of it and 8 less for each year over."""
    low, high = F.coalesce(least, F.lit(0.0)), F.coalesce(most, F.lit(99.0))
    score = F.when(years < low, 100 - 25 * (low - years)).when(years > high, 100 - 8 * (years - high)).otherwise(100)
    known = years.isNotNull() & (least.isNotNull() | most.isNotNull())
    return F.when(known, round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score.cast("double")))))


def skill_score(held: Column, tiers: dict[str, Column]) -> Column:
    """The share of each tier that is held, weighted over the tiers that ask for anything."""
    parts = [(F.lit(TIERS[t]), asked) for t, asked in tiers.items()]
    total = reduce(lambda a, b: a + b, (F.when(F.size(asked) > 0, w).otherwise(0.0) for w, asked in parts))
    got = reduce(lambda a, b: a + b, (F.when(F.size(asked) > 0, w * F.size(F.array_intersect(held, asked)) / F.size(asked)).otherwise(0.0) for w, asked in parts))
    return F.when(total > 0, round_half_up(100 * F.try_divide(got, total)))


def weighted(scores: dict[str, Column], weights: dict[str, int] = WEIGHTS) -> Column:
    """The mean of the known dimensions by their weights; null if none is known."""
    total = reduce(lambda a, b: a + b, (F.when(s.isNotNull(), float(weights[k])).otherwise(0.0) for k, s in scores.items()))
    got = reduce(lambda a, b: a + b, (F.coalesce(s * float(weights[k]), F.lit(0.0)) for k, s in scores.items()))
    return F.when(total > 0, round_half_up(F.try_divide(got, total)))


def confidence(scores: dict[str, Column], weights: dict[str, int] = WEIGHTS) -> Column:
    """How much of the weight is known. Without skills and role there is nothing to go by."""
    known = reduce(lambda a, b: a + b, (F.when(s.isNotNull(), float(weights[k])).otherwise(0.0) for k, s in scores.items()))
    percent = round_half_up(known / float(sum(weights[k] for k in scores)) * 100)
    blind = scores["skills"].isNull() & scores["role"].isNull()
    return F.when(blind | (percent < 30), "INSUFFICIENT").when(percent >= 80, "HIGH").when(percent >= 50, "MEDIUM").otherwise("LOW")


def tier(score: Column, blocked: Column, lacks: Column, sure: Column) -> Column:
    """The tier that a match is shown in."""
    best = (score >= 95) & ~lacks & (sure == "HIGH")
    return F.when(score.isNull(), "UNAVAILABLE").when(blocked, "NOT_ELIGIBLE").when(score < 70, "HIDDEN").when(best, "EXCELLENT").when(score >= 85, "STRONG").when(score >= 75, "MODERATE").otherwise("WEAK")


#: Years short of the least at which a role is out of reach, and the scores at which a match is told.
BLOCKING_YEARS = 2.0
PRIORITIES = {"IMMEDIATE": 95, "DIGEST": 85, "IN_APP": 75}


def role_score(targets: Column, title: Column) -> Column:
    """The best similarity of a target to the title, raised by 1.6 and capped; null without targets or title."""
    best = once(tokens(title), lambda said: F.array_max(F.transform(targets, lambda t: F.when(has_text(t), overlap(tokens(t), said)).otherwise(F.lit(0.0)))))
    return F.when((F.size(targets) > 0) & has_text(title), round_half_up(F.least(F.lit(1.0), best * 1.6) * 100))


def _plain(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def place_acceptable(wanted: Column, city: Column, place: Column) -> Column:
    """Whether one of the wanted places is the city, is named in the place, or names the city."""
    town, where = _plain(city), _plain(place)

    def fits(option: Column) -> Column:
        x = _plain(option)
        return (x != "") & ((x == town) | ((where != "") & where.contains(x)) | ((town != "") & x.contains(town)))

    return F.exists(wanted, fits)


def location_score(wanted: Column, modes: Column, relocates: Column, mode: Column, city: Column, place: Column) -> Column:
    """Remote work suits anywhere; else a place that is acceptable, then one that can be moved to."""
    told = (mode != "UNSPECIFIED") | has_text(city) | has_text(place)
    remote = F.when(F.array_contains(modes, "REMOTE") | (F.size(modes) == 0), 100).otherwise(80)
    there = F.when(place_acceptable(wanted, city, place), 100).when(relocates, 60).when(mode == "ONSITE", 20).otherwise(30)
    return F.when(told & (F.size(wanted) > 0), F.when(mode == "REMOTE", remote).otherwise(there)).cast("long")


def work_mode_score(modes: Column, mode: Column) -> Column:
    return F.when((mode != "UNSPECIFIED") & (F.size(modes) > 0), F.when(F.array_contains(modes, mode), 100).otherwise(40)).cast("long")


def blockers(years: Column, least: Column, mode: Column, acceptable: Column, relocates: Column) -> Column:
    """What keeps a candidate from a role."""
    short = F.when(least - years >= BLOCKING_YEARS, "EXPERIENCE_BELOW_MINIMUM")
    away = F.when((mode == "ONSITE") & ~acceptable & ~relocates, "ONSITE_UNREACHABLE")
    return F.array_compact(F.array(short, away))


def eligibility(blocked: Column, sure: Column, states_anything: Column, gaps: Column) -> Column:
    return F.when(F.size(blocked) > 0, "NOT_ELIGIBLE").when((sure == "INSUFFICIENT") | ~states_anything, "UNKNOWN").when(gaps, "ELIGIBLE_WITH_GAPS").otherwise("ELIGIBLE")


def priority(score: Column, alerts: Column) -> Column:
    """How a match is told, null for one that isn't; without alerts nothing is told at once."""
    out = None
    for name, least in PRIORITIES.items():
        shown = F.when(alerts, name).otherwise("DIGEST") if name == "IMMEDIATE" else F.lit(name)
        out = F.when(score >= least, shown) if out is None else out.when(score >= least, shown)
    return out
