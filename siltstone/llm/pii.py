"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Numbers and dates that pass their check (Luhn sum, IBAN's check digits, calendar, ranges) are permuted within their own
format by a keyed Feistel network whose rounds are SHA-256, and so are mail names, access keys, tokens and hexadecimal
secrets. The result has the same shape and passes the same check, and as nothing but the key and the value decides,
equal values stay equal over all documents. Letter case of mail names is kept but decides nothing, nor does that of hexadecimal
secrets and addresses, which are written in capitals where they were in part.

Dates written with two figures for day and month, and ISO dates, are permuted among all days of 400 years, alike in each
order; dates with a single figure are permuted among those whose day and month have as many figures.
"""

from __future__ import annotations

from calendar import isleap, monthrange
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table
from siltstone.llm.quality import let

#: The key of the registered query and the pipeline where `KEY_SETTING` is unset. It is public, so it hides nothing: set your own.
DEMO_KEY, KEY_SETTING = "siltstone pseudonyms 1", "spark.siltstone.pseudonym.key"
ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DAY, _MONTH, _YEAR = r"(?:0?[1-9]|[12]\d|3[01])", r"(?:0?[1-9]|1[0-2])", r"(?:1[89]\d\d|20\d\d|21\d\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: How tokens of known services begin.
_PREFIX = "(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk-|[sprw]k_live_|[sprw]k_test_|AIza|hf_|npm_)"
#: In order of precedence. No pattern has groups that capture, and none repeats a group without a bound: Java would go
#: a level deeper with each repetition. What repeats freely is a single class, anchored where a run of it begins.
KINDS = {
    "mail": r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]++\.[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?",
    "access": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "token": rf"(?<![\w-]){_PREFIX}(?=[A-Za-z_-]*+\d)[\w-]{{16,}}+(?!\w)",
    "signed": r"(?<![\w-])eyJ(?=[A-Za-z_.-]*+\d)[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?=[a-f]*+\d)[0-9a-f]{32,}+|(?=[A-F]*+\d)[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "ip6": rf"(?<![\w:.])(?=[0-9A-Fa-f:]{{0,36}}[0-9A-Fa-f]{{3}})(?=[A-Fa-f:]{{0,39}}\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|{_GROUP}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\w:])",
    "iso": rf"(?<![\w.-]){_YEAR}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?![\w-]|\.\d)",
    "dmy": rf"(?<![\w./-])(?:{_DAY}\.{_MONTH}\.|{_DAY}/{_DAY}/){_YEAR}(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|(?<!\.)\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)|(?<![\w+])\+\d{1,3}(?:[ -]?\d{2,4}){2,4}(?![\w-]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
}
#: The length of an IBAN by country.
IBAN_LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
#: Days in 400 years, the period of the calendar: 146,097 = 189 * 773. Dates are permuted among those from 1800-01-01.
_FIRST_YEAR, _DAY_A, _DAY_B = 1800, 189, 773
_FIRST_DAY = f"{_FIRST_YEAR}-01-01"
#: Month and day, as a number, of the days that every year has, by whether day and month have two figures; and the leap years.
DAYS_BY_WIDTH = {
    f"day of {1 + long_day} and month of {1 + long_month}": [100 * m + d for m in range(1, 13) for d in range(1, monthrange(2023, m)[1] + 1) if (d > 9) == long_day and (m > 9) == long_month]
    for long_day in (False, True)
    for long_month in (False, True)
}
LEAP_YEARS = [y for y in range(_FIRST_YEAR, _FIRST_YEAR + 400) if isleap(y)]
#: The valid social security numbers: 898 areas by 99 groups of 9,999.
_AREAS, _REST = 898, 99 * 9999


def _digest(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def _letters(text: Column) -> Column:
    """An array of the text's characters."""
    return F.split(text, "")


def feistel_text(value: Column, alphabet: str, key: str, tweak: Column) -> Column:
    """A keyed permutation of the strings over `alphabet` of the same length.

    Each round adds to the characters of one half, modulo the alphabet, what a digest of the other half says: 32 characters
    for each block, so that the work follows the length."""

    def plus(half: Column, digest: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.length(half) - 1) / 32).cast("int")), lambda j: _digest(digest, j))

        def shifted(blocks: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                by = F.conv(F.substring(F.get(blocks, F.floor(i / 32).cast("int")), 2 * F.pmod(i, F.lit(32)) + 1, F.lit(2)), 16, 10).cast("int")
                return F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + by, F.lit(len(alphabet))) + 1, F.lit(1))

            return F.array_join(F.transform(_letters(half), one), "")

        return F.when(F.length(half) == 0, half).otherwise(let(blocks, shifted))

    def rounds(s: Column) -> Column:
        cut = F.floor(F.length(s) / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), cut).alias("a"), F.substring(s, cut + 1, F.length(s)).alias("b"))

        def step(x: Column, r: Column) -> Column:
            return F.struct(x["b"].alias("a"), let(_digest(key, tweak, r, x["b"]), lambda d: plus(x["a"], d)).alias("b"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda x: F.concat(x["a"], x["b"]))

    return F.when(F.length(value) == 0, value).otherwise(let(value, rounds))


def feistel_pair(a: Column, size_a: Column, b: Column, size_b: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of the pairs below (size_a, size_b): a struct of a and b."""

    def part(x: Column, r: Column, other: Column, size: Column) -> Column:
        return F.pmod(x + F.conv(F.substring(_digest(key, tweak, r, other), 1, 15), 16, 10).cast("long"), size)

    def step(x: Column, r: Column) -> Column:
        return let(part(x["a"], r, x["b"], size_a), lambda now: F.struct(now.alias("a"), part(x["b"], -r, now, size_b).alias("b")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _only(value: Column, not_in: str) -> Column:
    return F.regexp_replace(value, not_in, "")


def _from(value: Column, first: Column) -> Column:
    return F.substring(value, first, F.length(value))


def refill(shape: Column, charset: str, filling: Column) -> Column:
    """`shape` with its characters of the class `charset`, from the first, replaced by those of `filling`."""
    gaps = F.split(shape, f"[{charset}]")
    return F.array_join(F.zip_with(gaps, _letters(filling), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _class(value: Column, charset: str, alphabet: str, key: str, tweak: Column) -> Column:
    """The characters of a class permuted as one string; the others stay where they are."""
    own = F.concat(tweak, F.lit(f" {charset}"))
    return F.when(~value.rlike(f"[{charset}]"), value).otherwise(let(feistel_text(_only(value, f"[^{charset}]"), alphabet, key, own), lambda f: refill(value, charset, f)))


def _in_case_of(was: Column, now: Column) -> Column:
    """`now` with capitals where `was` has them."""
    return F.array_join(F.zip_with(_letters(was), _letters(now), lambda a, b: F.when(a.between("A", "Z"), F.upper(b)).otherwise(b)), "")


def luhn_rest(digits: Column, doubled_last: bool) -> Column:
    """The Luhn sum of `digits` modulo 10; the last digit is doubled if `doubled_last` (where the check digit is to follow)."""
    doubled = 1 if doubled_last else 0  # places are counted from the last, which is 1

    def plus(total: Column, k: Column) -> Column:
        d = F.substring(digits, -k, F.lit(1)).cast("int")
        twice = 2 * d - F.when(d > 4, 9).otherwise(0)
        return total + F.when(F.pmod(k, F.lit(2)) == doubled, twice).otherwise(d)

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), plus), F.lit(10))


def _mod97(text: Column) -> Column:
    """The number that digits and letters (A is 10) spell, modulo 97."""

    def plus(rest: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), F.pmod(rest * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(rest * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(_letters(text), F.lit(0), plus)


def _iban_plain(m: Column) -> Column:
    """The number without spaces, as long as its country says; null for an unknown country. What follows it in the match is no part of it."""
    at = F.instr(F.lit(IBAN_LENGTHS), F.substring(m, 1, 2))
    return F.when(at > 0, F.substring(_only(m, " "), F.lit(1), F.substring(F.lit(IBAN_LENGTHS), at + 2, F.lit(2)).cast("int")))


def _turned(parts: Column, m: Column) -> Column:
    """Whether the month comes first: with slashes, where only that is a date."""
    return m.contains("/") & (parts[1].cast("int") > 12)


def _calendar_day(m: Column) -> Column:
    """The date that an iso or dmy match names, null if the calendar has no such day."""

    def of_parts(p: Column) -> Column:
        d, mo = F.when(_turned(p, m), p[1]).otherwise(p[0]), F.when(_turned(p, m), p[0]).otherwise(p[1])
        return F.concat_ws("-", p[2], F.lpad(mo, 2, "0"), F.lpad(d, 2, "0"))

    return F.try_to_date(F.when(m.contains("-"), m).otherwise(let(F.split(m, "[./]"), of_parts)), "yyyy-MM-dd")


def _two_figures(m: Column) -> Column:
    return m.rlike("-|^..[./]..[./]")


def _pair_of(kind: Column, m: Column) -> Column:
    """A number or date as a pair (a, b) below sizes (sa, sb), and the tweak of its domain."""

    def pair(a: Column, sa: Column | int, b: Column, sb: int, tweak: str) -> Column:
        return F.struct(a.cast("long").alias("a"), F.lit(sa).cast("long").alias("sa"), b.cast("long").alias("b"), F.lit(sb).cast("long").alias("sb"), F.lit(tweak).alias("tweak"))

    def of_day(day: Column) -> Column:
        n, year = F.datediff(day, F.lit(_FIRST_DAY).cast("date")), F.year(day)
        number = F.month(day) * 100 + F.dayofmonth(day)
        out = pair(F.array_position(F.lit(LEAP_YEARS), year) - 1, len(LEAP_YEARS), F.lit(0), 1, "leap day")
        for name, days in DAYS_BY_WIDTH.items():
            out = F.when(F.array_contains(F.lit(days), number), pair(F.array_position(F.lit(days), number) - 1, len(days), year - _FIRST_YEAR, 400, name)).otherwise(out)
        return F.when(_two_figures(m), pair(F.pmod(n, F.lit(_DAY_A)), _DAY_A, F.floor(n / _DAY_A), _DAY_B, "date")).otherwise(out)

    area = F.substring(m, 1, 3).cast("int")
    rest = (F.substring(m, 5, 2).cast("int") - 1) * 9999 + F.substring(m, 8, 4).cast("int") - 1
    ssn = pair(area - 1 - F.when(area > 666, 1).otherwise(0), _AREAS, rest, _REST, "ssn")
    return F.when(kind == "ssn", ssn).otherwise(let(_calendar_day(m), of_day))


def _of_pair(kind: Column, m: Column, was: Column, now: Column) -> Column:
    """The number or date that a pair stands for, in the format of the match."""
    area = now["a"] + 1 + F.when(now["a"] + 1 >= 666, 1).otherwise(0)
    figures = ((area, 3), (F.floor(now["b"] / 9999) + 1, 2), (F.pmod(now["b"], F.lit(9999)) + 1, 4))
    ssn = F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in figures])

    def of(number: Column, year: Column) -> Column:
        return F.make_date(year.cast("int"), F.floor(number / 100).cast("int"), F.pmod(number, F.lit(100)).cast("int"))

    at = now["a"].cast("int")
    day = of(F.lit(229), F.get(F.lit(LEAP_YEARS), at))
    for name, days in DAYS_BY_WIDTH.items():
        day = F.when(was["tweak"] == name, of(F.get(F.lit(days), at), now["b"] + _FIRST_YEAR)).otherwise(day)
    day = F.when(was["tweak"] == "date", F.date_add(F.lit(_FIRST_DAY).cast("date"), (now["b"] * _DAY_A + now["a"]).cast("int"))).otherwise(day)

    def written(x: Column) -> Column:
        def of_parts(p: Column) -> Column:
            mark, month, day = F.when(m.contains("/"), "/").otherwise("."), F.month(x), F.dayofmonth(x)
            one, two = F.when(_turned(p, m), month).otherwise(day), F.when(_turned(p, m), day).otherwise(month)
            return F.concat(F.lpad(one.cast("string"), F.length(p[0]), "0"), mark, F.lpad(two.cast("string"), F.length(p[1]), "0"), mark, F.year(x).cast("string"))

        return F.when(kind == "iso", F.date_format(x, "yyyy-MM-dd")).otherwise(let(F.split(m, "[./]"), of_parts))

    return F.when(kind == "ssn", ssn).otherwise(let(day, written))


def _code(m: Column) -> Column:
    """The country code after a phone number's plus, which stays."""
    return F.regexp_extract(m, r"^(\+\d{1,3})(?=[ .(-])", 1)


def _prefix(m: Column) -> Column:
    return F.regexp_extract(m, rf"^(?:A[KS]IA|eyJ|{_PREFIX})", 0)


def _body(kind: Column, m: Column) -> Column:
    """What of a match is permuted as text."""
    octets = F.array_join(F.transform(F.split(m, r"\."), lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")
    digits = _only(m, "[^0-9]")
    return (
        F.when(kind == "mail", F.lower(F.substring_index(m, "@", 1)))
        .when(kind == "iban", _from(_iban_plain(m), F.lit(5)))
        .when(kind == "card", F.substring(digits, F.lit(1), F.length(digits) - 1))
        .when(kind == "phone", _from(m, F.length(_code(m)) + 1))
        .when(kind == "ip", octets)
        .when(kind.isin("ip6", "secret"), F.lower(m))
        .otherwise(_from(m, F.length(_prefix(m)) + 1))
    )


def _of_body(kind: Column, m: Column, body: Column) -> Column:
    """The match with a permuted body in its place, and its check digits made anew. A mail's domain stays, so that
    statistics by provider remain, and so do an IBAN's country, a phone number's country code and a token's prefix."""

    def iban(country: Column) -> Column:
        check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
        return refill(m, "A-Z0-9", F.concat(country, check, body, _from(_only(m, " "), F.length(body) + 5)))

    octets = F.concat_ws(".", *[F.conv(F.substring(body, 1 + 2 * k, 2), 16, 10) for k in range(4)])
    return (
        F.when(kind == "mail", F.concat(_in_case_of(F.substring_index(m, "@", 1), body), F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "iban", iban(F.substring(m, 1, 2)))
        .when(kind == "card", refill(m, "0-9", F.concat(body, F.pmod(10 - luhn_rest(body, True), F.lit(10)).cast("string"))))
        .when(kind == "phone", F.concat(_code(m), body))
        .when(kind == "ip", octets)
        .when(kind.isin("ip6", "secret"), F.when(m.rlike("[A-F]"), F.upper(body)).otherwise(body))
        .otherwise(F.concat(_prefix(m), body))
    )


def _fine(kind: str, m: Column) -> Column:
    """Whether a match passes the check of its kind beyond the pattern."""
    if kind == "iban":
        return let(_iban_plain(m), lambda x: F.coalesce((F.length(x) > 14) & (_mod97(F.concat(_from(x, F.lit(5)), F.substring(x, 1, 4))) == 1), F.lit(False)))
    if kind == "ip6":  # more than eight groups, or eight beside a gap, aren't an address
        return F.size(F.filter(F.split(m, ":"), lambda x: x != "")) <= F.when(m.contains("::"), 7).otherwise(8)
    if kind in ("iso", "dmy"):
        return _calendar_day(m).isNotNull()
    return luhn_rest(_only(m, "[^0-9]"), False) == 0 if kind == "card" else F.lit(True)


def pseudonym(match: Column, key: str) -> Column:
    """What stands in for a match of KINDS, by the first kind that it is as a whole; what fails its check stays."""

    def by_text(kind: Column) -> Column:
        def permuted(body: Column) -> Column:
            tweak = F.when(kind == "mail", "mail").when(kind.isin("ip", "ip6", "secret", "iban", "card", "phone"), kind).otherwise("token")

            def in_class(value: Column, charset: str, alphabet: str) -> Column:
                return let(value, lambda v: _class(v, charset, alphabet, key, tweak))

            out = in_class(in_class(in_class(body, "a-z", LOWER), "A-Z", UPPER), "0-9", DIGITS)
            return F.when(kind.isin("ip", "ip6", "secret"), _class(body, "0-9a-f", HEX, key, tweak)).otherwise(out)

        return let(let(_body(kind, match), permuted), lambda body: _of_body(kind, match, body))

    def by_pair(kind: Column) -> Column:
        def moved(was: Column) -> Column:
            return let(feistel_pair(was["a"], was["sa"], was["b"], was["sb"], key, was["tweak"]), lambda now: _of_pair(kind, match, was, now))

        return let(_pair_of(kind, match), moved)

    kind = F.lit("")
    for name, pattern in reversed(KINDS.items()):
        kind = F.when(match.rlike(f"^(?:{pattern})$"), F.when(_fine(name, match), name).otherwise("")).otherwise(kind)
    return let(kind, lambda k: F.when(k == "", match).when(k.isin("iso", "dmy", "ssn"), by_pair(k)).otherwise(by_text(k)))


def pseudonymised(text: Column, key: str) -> Column:
    """`text` with its personal data replaced; null stays null."""
    found = "|".join(KINDS.values())
    made = F.transform(F.regexp_extract_all(text, F.lit(found), F.lit(0)), lambda m: pseudonym(m, key))

    def joined(parts: Column) -> Column:
        return F.array_join(F.zip_with(F.split(text, found), parts, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")

    # Every kind has a figure, an at sign or the beginning of an access key: a text without them needs no further look.
    return F.when(text.rlike("[0-9@]|A[KS]IA"), let(made, lambda parts: F.when(F.size(parts) == 0, text).otherwise(joined(parts)))).otherwise(text)


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with the personal data in `text` replaced; its rows and other columns stay, repeated rows and all.

    A null or empty text stays; an empty table gives no rows. Equal values get equal pseudonyms, whatever their document.
    Keep `key` secret: whoever has it can undo the pseudonyms."""
    return docs.withColumn(text, pseudonymised(F.col(text), key))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("was"), "text")
    return pseudonymise(docs, session_key(spark)).select("doc_id", "text", (~F.col("was").eqNullSafe(F.col("text"))).alias("changed"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
