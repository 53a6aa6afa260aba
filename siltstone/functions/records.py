"""Checks, states and summaries of records, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.postings import strip
from siltstone.functions.text import SPACE, has_text

#: The steps that a placement may take, by who takes them, and those of a requirement.
PLACEMENT = {
    "STAFF": [("SHORTLISTED", "INVITED"), ("SHORTLISTED", "NOT_PROCEEDING"), ("INVITED", "NOT_PROCEEDING"), ("INTERESTED", "SELECTED"), ("INTERESTED", "NOT_PROCEEDING")],
    "STUDENT": [("INVITED", "INTERESTED"), ("INVITED", "DECLINED")],
}
REQUIREMENT = [("DRAFT", "OPEN"), ("DRAFT", "CLOSED"), ("OPEN", "CLOSED"), ("CLOSED", "OPEN")]
#: Seconds after which to come back if nothing is said, and at most.
DEFAULT_BACKOFF, MOST_BACKOFF = 300, 4 * 3600
#: What follows a company's name and isn't part of it, and where its site may be.
LEGAL = ["inc", "llc", "ltd", "limited", "pvt", "private", "corp", "corporation", "co", "company", "gmbh", "plc"]
ENDINGS = [".com", ".in", ".co.in", ".io"]


def problem(*checks: tuple[Column, str]) -> Column:
    """The first problem that a record has, null if it has none. A check that can't be told doesn't fail."""
    return F.coalesce(*[F.when(test, message) for test, message in checks])


def problems(*checks: tuple[Column, str]) -> Column:
    """All problems of a record, in order."""
    return F.array_compact(F.array(*[F.when(test, message) for test, message in checks]))


def criterion(wanted: Column, had: Column, met: Column) -> Column:
    """MET, NOT_MET or UNKNOWN; null where nothing is wanted."""
    return F.when(wanted.isNull(), None).when(had.isNull(), "UNKNOWN").when(met, "MET").otherwise("NOT_MET")


def formal_eligibility(*outcomes: Column) -> Column:
    """What isn't met decides before what isn't known; nothing asked for is met."""
    told = F.array_compact(F.array(*outcomes))
    return F.when(F.array_contains(told, "NOT_MET"), "NOT_ELIGIBLE").when(F.array_contains(told, "UNKNOWN"), "UNKNOWN").otherwise("ELIGIBLE")


def completeness(fields: list[Column], skills: Column, experience: Column, education: Column, target: Column) -> Column:
    """Ten for each field that is told and for experience, five for education and a target; skills count by how many, 100 at most."""
    told = reduce(lambda a, b: a + b, (F.when(f, 10).otherwise(0) for f in fields))
    listed = F.when(skills >= 8, 20).when(skills >= 3, 12).when(skills > 0, 6).otherwise(0)
    rest = F.when(experience, 10).otherwise(0) + F.when(education, 5).otherwise(0) + F.when(target, 5).otherwise(0)
    return F.least(F.lit(100), told + listed + rest)


def changed_number(was: Column, now: Column, scale: int = 4) -> Column:
    """Whether a number changed, whatever the scales that it is written in; null against a value is a change."""
    return ~was.cast(f"decimal(30,{scale})").eqNullSafe(now.cast(f"decimal(30,{scale})"))


def fresher_suitable(level: Column, least: Column) -> Column:
    """Interns and entry level: nothing asked, or a year at most; juniors and unspecified: that has to be said."""
    out = F.when(level.isin("INTERN", "ENTRY"), least.isNull() | (least <= 1)).when(level.isin("JUNIOR", "UNSPECIFIED"), least.isNotNull() & (least <= 1))
    return F.coalesce(out, F.lit(False))


def may_step(start: Column, end: Column, steps: list[tuple[str, str]]) -> Column:
    return F.concat_ws(">", start, end).isin([f"{a}>{b}" for a, b in steps])


def may_place(start: Column, end: Column, actor: Column) -> Column:
    """Whether an actor may take a placement from one stage to the next."""
    return reduce(lambda a, b: a | b, ((actor == who) & may_step(start, end, steps) for who, steps in PLACEMENT.items()))


def backoff(header: Column, now: Column) -> Column:
    """Seconds to wait by a Retry-After header: a number, or a date of RFC 1123; dates that are past give none."""
    said = strip(header)
    number = F.when(said.rlike("^[0-9]{1,9}$"), said.cast("long")).when(said.rlike("^[0-9]+$"), F.lit(MOST_BACKOFF).cast("long"))
    at = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(said, "^[A-Z][a-z]{2}, ", ""), " GMT$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    until = F.when(at.isNotNull(), F.greatest(F.lit(0).cast("long"), F.unix_seconds(at) - F.unix_seconds(now)))
    return F.least(F.lit(MOST_BACKOFF).cast("long"), F.coalesce(number, until, F.lit(DEFAULT_BACKOFF).cast("long")))


def clean_skill(text: Column) -> Column:
    """A skill as it is listed, without bullets and closing marks; null if it has less than 2 or more than 60 characters, or over 4 words."""
    plain = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^[\-\x{2022}*\s]+", ""), "[.,;:]+$", ""))
    return F.when(F.length(plain).between(2, 60) & (F.size(F.split(plain, r"\s+")) <= 4), plain)


def company_core(name: Column) -> Column:
    """The words of a company's name without what says its legal form."""
    return F.filter(F.split(F.lower(F.trim(F.regexp_replace(name, f"[^\\p{{L}}\\p{{N}}]+|{SPACE}+", " "))), " "), lambda w: (w != "") & ~w.isin(LEGAL))


def domain_guesses(name: Column) -> Column:
    """Where a company's site may be: its first word and all its words, with each ending, without repeats."""
    core = company_core(name)
    stems = F.array_distinct(F.array(core[0], F.array_join(core, "")))
    return F.when(F.size(core) > 0, F.flatten(F.transform(stems, lambda s: F.array(*[F.concat(s, F.lit(e)) for e in ENDINGS])))).otherwise(F.array().cast("array<string>"))


def first_distinct(names: Column, most: int) -> Column:
    """The first `most` distinct names, trimmed, none of them blank."""
    return F.slice(F.array_distinct(F.filter(F.transform(names, strip), has_text)), 1, most)


def within_scope(target: Column, granted: Column) -> Column:
    """Where a target meets what is granted; no target means all that is granted."""
    return F.when(F.size(target) == 0, granted).otherwise(F.array_intersect(target, granted))
