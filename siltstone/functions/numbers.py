"""Number and date scalars: rounding half up, lenient instants, trailing windows, business days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves upwards: floor(x + 0.5)."""
    return F.floor(x + F.lit(0.5)).cast("long")


def scaled(x: Column, precision: int, scale: int) -> Column:
    """A decimal of a scale, halves away from zero."""
    return F.round(x.cast("decimal(38,10)"), scale).cast(f"decimal({precision},{scale})")


def lenient_instant(text: Column) -> Column:
    """An instant from ISO text with or without offset, `yyyy-MM-dd HH:mm:ss UTC` or a date at midnight; else null.

    What begins with no year isn't tried: each form that fails costs an exception."""
    spaced = F.regexp_replace(text, " UTC$", "Z")
    return F.when(text.rlike(r"^[+-]?\d{4,}-"), F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")), F.try_to_timestamp(spaced, F.lit("yyyy-MM-dd HH:mm:ssX")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))


def partial_date(text: Column) -> Column:
    """`yyyy`, `yyyy-MM` or `yyyy-MM-dd`, as its first day."""
    whole = F.when(text.rlike(r"^\d{4}$"), F.concat(text, F.lit("-01-01"))).when(text.rlike(r"^\d{4}-\d{2}$"), F.concat(text, F.lit("-01"))).otherwise(text)
    return F.when(whole.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(whole, "yyyy-MM-dd"))


def within(at: Column, as_of: Column, interval: str) -> Column:
    """After `as_of` less the interval. `as_of` is given, so that results can be had again."""
    return at > as_of - F.expr(f"interval {interval}")


def business_day(at: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def success_ratio(good: Column, bad: Column) -> Column:
    """Percent, halves upwards; -1 where nothing was measured."""
    return F.when(good + bad == 0, F.lit(-1).cast("long")).otherwise(round_half_up(100.0 * good / (good + bad)))


def seniority_score(left: Column, right: Column, ladder: list[str]) -> Column:
    """By the distance on a ladder of names: 100, 80, 55, else 25; null for names that aren't on it."""
    steps = F.array(*map(F.lit, ladder))
    a, b = F.array_position(steps, left), F.array_position(steps, right)
    far = F.abs(a - b)
    return F.when((a == 0) | (b == 0), None).when(far == 0, 100).when(far == 1, 80).when(far == 2, 55).otherwise(25)
