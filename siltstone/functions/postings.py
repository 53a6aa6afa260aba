"""Fields of a posting from its texts, as Column expressions: title, place, work mode, employment, level, experience, pay, sections."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE, canonicalize, has_text, once, strip_html, trimmed
from siltstone.sources.tables import FEW_TEXTS, found_once, settled

#: What a title says beside the title, and how it is set off.
NOISE = r"remote|hybrid|onsite|on-site|contract|full[ -]?time|part[ -]?time|urgent|hiring|immediate joiner|w2|c2c|[a-z]{2,3}\s*only|\d+\s*(?:openings?|positions?)"
GENDERS = "m/f/d|f/m/d|m/w/d|h/f"
#: Signs of a work mode.
REMOTE = ["remote", "work from home", "wfh", "anywhere", "distributed"]
HYBRID = ["hybrid", "flexible location", "partially remote"]
ONSITE = ["on-site", "onsite", "in office", "in-office"]
REMOTE_PHRASES = ["fully remote", "100% remote", "remote-first", "remote first"]
HYBRID_PHRASES = ["hybrid role", "hybrid position", "hybrid working", "hybrid work model"]
#: Signs of a level in a title, the first that fits counting.
LEVELS = {
    "PRINCIPAL": ["principal", "distinguished"],
    "LEAD": ["staff", "lead", "head of", "manager"],
    "SENIOR": ["senior", "sr.", "sr "],
    "JUNIOR": ["junior", "jr.", "associate"],
    "ENTRY": ["entry level", "graduate", "trainee", "fresher"],
    "MID": ["mid-level", "mid level"],
}
#: Headings of two sections, and what any heading looks like.
DUTIES = r"what you.{0,20}do|responsibilities|the role|your impact|about the role|key responsibilities|duties"
WANTED = r"requirements|qualifications|what we.{0,20}looking for|who you are|skills|must have|your profile|what you bring"
#: White space within a line.
_GAP = r"[ \t\x0B\f]*+"
_HEADING = rf"(?m)^{_GAP}[A-Z][A-Za-z '/&]{{3,40}}{_GAP}:?{_GAP}$"
_YEARS = r"(?:years?|yrs?)"
_AMOUNT = r"([\d,]+(?:\.\d+)?)\s?(k)?"
_PAY = rf"(?i)([$₹€£])\s?{_AMOUNT}\s*(?:-|to|–)\s*([$₹€£])?\s?{_AMOUNT}"


def strip(text: Column) -> Column:
    """Without Unicode white space around it; null if nothing else is there."""
    return F.when(has_text(text), F.regexp_replace(text, f"^{SPACE}+|(?<!{SPACE}){SPACE}+$", ""))


def has_any(text: Column, signs: list[str]) -> Column:
    """Whether any of the signs is in a text; a null text has none."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.contains(s) for s in signs)), F.lit(False))


def normalized_title(title: Column) -> Column:
    """For comparing: without markers of mode, contract or gender and without a trailing Roman numeral; the canonical title
    if nothing else is left, null for a blank one."""
    plain = F.regexp_replace(title, rf"(?i)(?<!\s)\s*+[\(\[\-–|]\s*(?:{NOISE})\s*+[\)\]]?\s*+", " ")
    plain = canonicalize(F.regexp_replace(plain, rf"(?i)\b(?:{GENDERS})\b", " "))
    plain = F.trim(F.regexp_replace(plain, r"\b(?:i{1,3}|iv|v)\b$", ""))
    return F.when(has_text(title), once(plain, lambda x: F.when(x == "", canonicalize(title)).otherwise(x)))


def _region_code(text: Column) -> Column:
    return text.rlike(r"^\p{Lu}{2}$")


def _split(text: Column, signs: str) -> Column:
    """The parts of a text between signs, without white space around them or signs at its end."""
    ends = rf"(?<![\s{signs}])[\s{signs}]+$"
    return F.transform(F.split(F.regexp_replace(text, ends, ""), f"[{signs}]"), lambda x: trimmed(x))


def location(text: Column) -> Column:
    """A struct of raw, city, region and country, of the first of several offices.

    A code of two capitals at the end is a region, not a country; without a country, a last office without commas names
    it. A sign of remote work is no city."""

    def of_parts(raw: Column, offices: Column, parts: Column) -> Column:
        last, shared = F.when(F.size(parts) > 1, F.element_at(parts, -1)), F.element_at(offices, -1)
        code, anywhere = _region_code(last), F.lower(raw).isin(REMOTE)
        region = F.when(F.size(parts) > 2, parts[1]).when(code, last)
        country = F.when(~code, last).when((F.size(offices) > 1) & ~shared.contains(",") & ~_region_code(shared), shared)
        fields = {"city": F.when(~F.lower(parts[0]).isin(REMOTE), parts[0]), "region": region, "country": country}
        return F.struct(raw.alias("raw"), *[F.when(~anywhere & (v != ""), v).alias(k) for k, v in fields.items()])

    def of_raw(raw: Column) -> Column:
        return once(_split(raw, "•|;"), lambda o: once(_split(o[0], ","), lambda parts: of_parts(raw, o, parts)))

    return once(strip(text), of_raw)


def _signs(text: Column) -> Column:
    """What a text of a posting says wherever it stands, of a lower-case text: phrases of work modes, employments and of the first level."""
    fields = {"remote": REMOTE_PHRASES, "hybrid": HYBRID_PHRASES, "intern": ["internship"], "full": ["full-time", "full time"], "entry": ["fresher", "entry-level"]}
    return F.struct(*[has_any(text, phrases).alias(k) for k, phrases in fields.items()])


def _stated_mode(said: Column) -> Column:
    return F.when(has_any(said, REMOTE), "REMOTE").when(has_any(said, HYBRID), "HYBRID").when(has_any(said, [*ONSITE, "office"]), "ONSITE")


def _told_mode(text: Column) -> Column:
    return F.when(has_any(text, HYBRID), "HYBRID").when(has_any(text, REMOTE), "REMOTE").when(has_any(text, ONSITE), "ONSITE")


def _work_mode(stated: Column, by_title: Column, by_place: Column, remote: Column, hybrid: Column) -> Column:
    return F.coalesce(_stated_mode(F.lower(stated)), by_title, by_place, F.when(remote, "REMOTE").when(hybrid, "HYBRID").otherwise("UNSPECIFIED"))


def work_mode(stated: Column, title: Column, place: Column, everything: Column) -> Column:
    """What is stated counts before the title, the title before the place, and of the text only plain phrases do."""
    says = _signs(everything)
    return _work_mode(stated, _told_mode(F.lower(title)), _told_mode(F.lower(place)), says["remote"], says["hybrid"])


def _employment_type(stated: Column, intern: Column, full: Column) -> Column:
    said = F.lower(stated)
    out = F.when(said.contains("intern"), "INTERNSHIP").when(has_any(said, ["contract", "freelance"]), "CONTRACT").when(said.contains("part"), "PART_TIME").when(said.contains("temp"), "TEMPORARY").when(said.contains("full"), "FULL_TIME")
    return out.when(intern, "INTERNSHIP").when(full, "FULL_TIME").otherwise("UNSPECIFIED")


def employment_type(stated: Column, everything: Column) -> Column:
    says = _signs(everything)
    return _employment_type(stated, says["intern"], says["full"])


def _level(name: Column) -> Column:
    out = F.when(name.contains("intern") & ~name.contains("internal"), "INTERN")
    for level, signs in LEVELS.items():
        out = out.when(has_any(name, signs), level)
    return out


def _seniority(level: Column, entry: Column) -> Column:
    return F.coalesce(level, F.when(entry, "ENTRY").otherwise("UNSPECIFIED"))


def seniority(title: Column, everything: Column) -> Column:
    return _seniority(_level(F.lower(title)), _signs(everything)["entry"])


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def experience(text: Column) -> Column:
    """A struct of least and most years: the first range, else the first `n+`, else the first `at least n`. A range that
    descends, and more than 40 years, count as nothing stated in that form."""
    span, plus, floor = rf"(\d{{1,2}})\s*+(?:-|to|–)\s*+(\d{{1,2}})\s*+\+?\s*+{_YEARS}", rf"(\d{{1,2}})\s*+\+\s*+{_YEARS}", rf"(?:at least|minimum(?: of)?|min\.?)\s*+(\d{{1,2}})\s*+{_YEARS}"

    def found(low_text: Column) -> Column:
        one = F.struct(F.regexp_substr(low_text, F.lit(span)).alias("a"), F.regexp_substr(low_text, F.lit(plus)).alias("b"), F.regexp_substr(low_text, F.lit(floor)).alias("c"))
        return once(one, parts)

    def parts(one: Column) -> Column:
        given = {"low": ("a", span, 1), "high": ("a", span, 2), "n": ("b", plus, 1), "m": ("c", floor, 1)}
        return once(F.struct(*[_group(one[k], p, g).cast("decimal(4,1)").alias(name) for name, (k, p, g) in given.items()]), told)

    def told(years: Column) -> Column:
        low, high, n, m = (years[k] for k in ("low", "high", "n", "m"))
        whole = (low <= high) & (high <= 40)
        least = F.when(whole, low).when(n <= 40, n).when(m <= 40, m)
        return F.struct(least.alias("least"), F.when(whole, high).alias("most"))

    none = F.struct(F.lit(None).cast("decimal(4,1)").alias("least"), F.lit(None).cast("decimal(4,1)").alias("most"))
    return once(F.lower(text), lambda low: F.when(has_any(low, ["year", "yr"]), found(low)).otherwise(none))


def _money(digits: Column, thousands: Column) -> Column:
    value = F.replace(digits, F.lit(",")).try_cast("decimal(18,2)")
    return F.when(thousands.isNotNull(), value * 1000).otherwise(value).cast("decimal(18,2)")


def salary(text: Column) -> Column:
    """A struct of low, high, currency and period, from the first range of amounts; nulls if it descends or there is none."""

    def of_span(span: Column) -> Column:
        low, high = (_money(_group(span, _PAY, a), _group(span, _PAY, k)) for a, k in ((2, 3), (5, 6)))
        sign = F.substring(span, 1, 1)
        currency = F.when(sign == "$", "USD").when(sign == "₹", "INR").when(sign == "€", "EUR").when(sign == "£", "GBP")
        return once(F.struct(low.alias("low"), high.alias("high"), currency.alias("currency")), in_order)

    def in_order(pay: Column) -> Column:
        said = F.lower(text)
        period = F.when(has_any(said, ["per hour", "/hr", "hourly"]), "HOURLY").when(has_any(said, ["per month", "/month"]), "MONTHLY").otherwise("ANNUAL")
        fields = {"low": pay["low"], "high": pay["high"], "currency": pay["currency"], "period": period}
        return F.struct(*[F.when(pay["low"] <= pay["high"], v).alias(k) for k, v in fields.items()])

    return once(F.when(has_any(text, ["$", "₹", "€", "£"]), F.regexp_substr(text, F.lit(_PAY))), of_span)


def section(text: Column, headings: str) -> Column:
    """The text below the first heading of a kind, up to the next line that looks like a heading; null if there is none."""
    heading = rf"(?im)^{_GAP}(?:{headings}){_GAP}:?{_GAP}$"
    rest = once(F.split(text, heading, 2), lambda parts: F.when(F.size(parts) > 1, F.substring(parts[1], F.lit(2), F.length(parts[1]))))
    found = once(once(rest, lambda x: F.split(x, _HEADING, 2)[0]), lambda x: strip(x))
    # A heading has a line of its own, so a text in one line has no text below one.
    return F.when(text.contains("\n") | text.contains("\r"), found)


#: The fields of a posting, in order.
FIELDS = [
    "title", "normalized_title", "description", "responsibilities", "requirements", "location_raw", "city", "region", "country", "work_mode", "employment_type", "seniority",
    "min_experience", "max_experience", "salary_min", "salary_max", "salary_currency", "salary_period",
]


#: Fields that are found sooner than all rows are gone through to find which texts repeat.
_QUICK = {"title", "normalized_title", "description"}
#: Fields that are made of what several texts say.
_SHARED = {"work_mode", "employment_type", "seniority"}


def _of_title(wanted: set[str]) -> Callable[[Column], Column]:
    def of_name(name: Column) -> Column:
        held = {"title": F.substring(name, 1, 300)} if "title" in wanted else {}
        if "normalized_title" in wanted:
            held["normalized_title"] = F.substring(normalized_title(name), 1, 200)
        if wanted & _SHARED:
            held["said"] = once(F.lower(name), lambda low: F.struct(_told_mode(low).alias("mode"), _level(low).alias("level"), _signs(low).alias("signs")))
        return F.struct(*[v.alias(k) for k, v in held.items()])

    return lambda title: once(strip(title), of_name)


def _of_place(wanted: set[str]) -> Callable[[Column], Column]:
    split = wanted & {"city", "region", "country"}

    def of_where(where: Column) -> Column:
        held = {"location_raw": F.substring(where["raw"], 1, 300)} if "location_raw" in wanted else {}
        held |= {k: F.substring(where[k], 1, 120) for k in ("city", "region", "country") if k in wanted}
        if wanted & _SHARED:
            held["said"] = once(F.lower(where["raw"]), lambda low: F.struct(_told_mode(low).alias("mode"), _signs(low).alias("signs")))
        return F.struct(*[v.alias(k) for k, v in held.items()])

    return lambda place: once(location(place) if split else F.struct(strip(place).alias("raw")), of_where)


def _of_html(wanted: set[str]) -> Callable[[Column], Column]:
    def of_text(text: Column) -> Column:
        held = {"description": text} if "description" in wanted else {}
        held |= {k: section(text, headings) for k, headings in (("responsibilities", DUTIES), ("requirements", WANTED)) if k in wanted}
        if wanted & {"min_experience", "max_experience"}:
            held["years"] = experience(text)
        if any(k.startswith("salary_") for k in wanted):
            held["pay"] = salary(text)
        if wanted & _SHARED:
            held["said"] = once(F.lower(text), lambda low: F.struct(_signs(low).alias("signs")))
        return F.struct(*[v.alias(k) for k, v in held.items()])

    return lambda html: once(strip_html(html), of_text)


#: The fields that each text of a posting says alone, and what finds them.
_FROM = {
    "title": (["title", "normalized_title"], _of_title),
    "place": (["location_raw", "city", "region", "country"], _of_place),
    "html": (["description", "responsibilities", "requirements", "min_experience", "max_experience", "salary_min", "salary_max", "salary_currency", "salary_period"], _of_html),
}


def with_fields(rows: DataFrame, title: Column, place: Column, html: Column, stated_mode: Column, stated_type: Column, stated_pay: Column, wanted: list[str] | None = None) -> DataFrame:
    """The columns of `rows` and the fields that are `wanted` (all by default), in place of columns of these names; lengths are
    those that fields are stored with. Nothing is found that no wanted field is made of.

    What a text says is found once for each text: by `found_once` for texts that many rows have, else row by row before the
    fields. `rows` are gone through for that (not for quick fields alone), so they can't be a stream."""
    wanted = FIELDS if wanted is None else wanted
    given = set(wanted)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in FIELDS]
    held = settled(rows.select(*kept, title.alias("__title"), place.alias("__place"), html.alias("__html"), stated_mode.alias("__mode"), stated_type.alias("__type"), stated_pay.alias("__pay")))
    finders = {k: (F.col(f"__{k}"), of(given)) for k, (fields, of) in _FROM.items() if given & _SHARED or given & set(fields)}
    if any(k.startswith("salary_") for k in wanted):
        finders["pay"] = (F.col("__pay"), salary)
    held = found_once(held, finders, "__g", 0 if given <= _QUICK else FEW_TEXTS)
    name, where, text = (F.col("__g")[k] for k in _FROM)

    def any_says(sign: str) -> Column:
        return name["said"]["signs"][sign] | where["said"]["signs"][sign] | text["said"]["signs"][sign]

    pay = F.when(F.col("__pay").isNull(), text["pay"]).otherwise(F.col("__g.pay"))
    makes = {
        **{k: lambda k=k: name[k] for k in _FROM["title"][0]}, **{k: lambda k=k: where[k] for k in _FROM["place"][0]}, **{k: lambda k=k: text[k] for k in ("description", "responsibilities", "requirements")},
        "work_mode": lambda: _work_mode(F.col("__mode"), name["said"]["mode"], where["said"]["mode"], any_says("remote"), any_says("hybrid")),
        "employment_type": lambda: _employment_type(F.col("__type"), any_says("intern"), any_says("full")), "seniority": lambda: _seniority(name["said"]["level"], any_says("entry")),
        "min_experience": lambda: text["years"]["least"], "max_experience": lambda: text["years"]["most"], **{f"salary_{k}": lambda f=f: pay[f] for k, f in (("min", "low"), ("max", "high"), ("currency", "currency"), ("period", "period"))},
    }
    return held.select(*kept, *[makes[k]().alias(k) for k in FIELDS if k in wanted])
