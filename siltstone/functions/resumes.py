"""Résumés as Column expressions: sections, date ranges, fields, and texts without personal data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.postings import strip
from siltstone.functions.text import has_text, once

#: Lines that head a part of a résumé; those of OTHER only end the part above.
HEADINGS = {
    "SUMMARY": ["summary", "professional summary", "career summary", "profile", "professional profile", "profile summary", "objective", "career objective", "about", "about me", "overview"],
    "EXPERIENCE": [
        "experience", "work experience", "professional experience", "employment", "employment history", "work history", "internship", "internships", "internship experience", "industry experience",
        "professional background", "relevant experience",
    ],
    "EDUCATION": ["education", "educational qualifications", "academic qualifications", "academics", "academic background", "qualifications", "educational background", "education and training", "academic details"],
    "OTHER": [
        "skills", "technical skills", "key skills", "core competencies", "competencies", "technologies", "projects", "academic projects", "personal projects", "certifications", "certificates", "achievements",
        "awards", "honours", "honors", "publications", "activities", "interests", "hobbies", "languages", "references", "extracurricular", "positions of responsibility", "workshops", "training", "courses",
        "coursework", "volunteer experience", "accomplishments", "personal details", "declaration", "strengths", "contact", "links", "profiles",
    ],
}
#: How dates and ranges of dates are written, and what stands for the time of reading.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_DATE = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec)[a-z]{0,9}\.?,?\s+\d{4}|\d{1,2}/\d{4}|\d{4}"
ONGOING = r"present|current|now|ongoing|till\s+date|to\s+date|date"
RANGE = rf"(?i)({_DATE})\s*(?:-|–|—|to|until|till)\s*({_DATE}|{ONGOING})"
YEARS = r"(?i)(\d{1,2}(?:\.\d)?)\s*\+?\s*(?:years?|yrs?)\s+(?:of\s+)?experience"
#: Words of roles.
ROLES = [
    "engineer", "developer", "intern", "analyst", "manager", "designer", "scientist", "consultant", "architect", "lead", "trainee", "associate", "administrator", "specialist", "officer", "executive",
    "coordinator", "assistant", "technician", "programmer", "researcher", "strategist", "accountant", "teacher", "instructor",
]
_MAIL_SIGN = r"[A-Za-z0-9._%+-]"
PHONE = r"(?<![\w+])\(?\+?\d[\d \t()-]{8,20}\d(?!\w)"


def lines_of(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")


def heading_of(line: Column) -> Column:
    """The part that a line heads; null for lines that are long, end a sentence or hold an address."""

    def named(name: Column) -> Column:
        found = F.lit(None).cast("string")
        for part, names in HEADINGS.items():
            found = F.when(name.isin(names), part).otherwise(found)
        return found

    key = F.trim(F.regexp_replace(F.lower(line), "[^a-z]+", " "))
    return F.when((F.length(line) <= 48) & ~line.endswith(".") & ~line.contains("@"), once(key, named))


def parts(text: Column) -> Column:
    """A map of part to what is below its headings, in order; lines above the first heading are in none.

    Each line has the part of the last heading before it, found by the places of headings: a text isn't taken apart
    into rows, so a text of any length stays one row."""

    def cut(lines: Column) -> Column:
        heads = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), heading_of(strip(x)).alias("part"))), lambda h: h["part"].isNotNull())
        return once(heads, lambda h: gathered(lines, h))

    def gathered(lines: Column, heads: Column) -> Column:
        def below(h: Column, k: Column) -> Column:
            end = F.coalesce(F.get(heads, k + 1)["at"], F.size(lines))
            return F.struct(h["part"].alias("part"), F.slice(lines, h["at"] + 2, end - h["at"] - 1).alias("lines"))

        def named(part: str) -> Column:
            own = F.filter(held, lambda x: x["part"] == part)
            return F.struct(F.lit(part).alias("key"), F.flatten(F.transform(own, lambda x: x["lines"])).alias("lines"), (F.size(own) > 0).alias("there"))

        held = F.transform(heads, below)
        return F.map_from_entries(F.transform(F.filter(F.array(*map(named, HEADINGS)), lambda x: x["there"]), lambda x: F.struct(x["key"], F.array_join(x["lines"], "\n"))))

    return F.when(text.isNotNull(), once(lines_of(text), cut))


def month_of(token: Column, last: bool = False) -> Column:
    """Months since year 0 of `Mar 2019`, `3/2019` or `2019`, which is its first month, or its last; null for no month."""
    low = F.replace(F.lower(token), F.lit(","), F.lit(""))
    year = F.regexp_extract(low, r"(\d{4})$", 1).try_cast("int")
    slash = F.regexp_extract(low, r"^(\d{1,2})/", 1).try_cast("int")
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(low, 1, 3)).cast("int")
    month = F.when(slash.isNotNull(), F.when(slash.between(1, 12), slash)).when(named > 0, named).otherwise(12 if last else 1)
    return year * 12 + month - 1


def date_ranges(text: Column, as_of: Column) -> Column:
    """An array of first, last (months since year 0, both included) and ongoing, of all ranges of dates in a text.

    Ranges that end before they begin, or name no month, are none. What goes on ends with the month of `as_of`."""
    starts, ends = (F.regexp_extract_all(text, F.lit(RANGE), F.lit(g)) for g in (1, 2))
    now = F.year(as_of) * 12 + F.month(as_of) - 1

    def read(s: Column, e: Column) -> Column:
        going = e.rlike(rf"(?i)^(?:{ONGOING})$")
        return F.struct(month_of(s).alias("first"), F.when(going, now).otherwise(month_of(e, last=True)).alias("last"), going.alias("ongoing"))

    return F.filter(F.zip_with(starts, ends, read), lambda r: r["first"] <= r["last"])


def covered_months(ranges: Column) -> Column:
    """How many months are in any of the ranges; those in several count once."""
    begin = F.struct(F.lit(0).alias("total"), F.lit(-1).alias("upto"))

    def add(held: Column, r: Column) -> Column:
        fresh = F.greatest(F.lit(0), r["last"] - F.greatest(held["upto"], r["first"] - 1))
        return F.struct((held["total"] + fresh).alias("total"), F.greatest(held["upto"], r["last"]).alias("upto"))

    return F.aggregate(F.array_sort(ranges), begin, add)["total"]


def plausible_phone(text: Column) -> Column:
    """Whether the digits of a text may be a phone number: by their count, first digits and a plus sign."""
    digits, abroad = F.regexp_replace(text, "[^0-9]", ""), text.contains("+")
    n = F.length(digits)
    return F.when(n == 10, digits.rlike("^[6-9]")).when(n == 11, digits.startswith("0") | abroad).when(n == 12, digits.startswith("91") | abroad).otherwise((n == 13) & abroad)


def phone(text: Column) -> Column:
    """The first plausible number: of a run of digits the longest prefix, cut at spaces and hyphens, that is one."""

    def prefixes(run: Column) -> Column:
        pieces = F.split(run, r"(?<=[ \t-])|(?=[ \t-])")
        upto = F.transform(F.sequence(F.size(pieces), F.lit(1), F.lit(-1)), lambda k: F.trim(F.array_join(F.slice(pieces, F.lit(1), k), "")))
        return F.filter(F.transform(upto, lambda x: F.regexp_replace(x, r"[\s-]+$", "")), lambda x: plausible_phone(x))

    return F.get(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"({PHONE})"), F.lit(1)), prefixes)), 0)


def email(text: Column) -> Column:
    return F.regexp_substr(text, F.lit(r"(?<![\w.+-])[\w.+-]++@[\w-]++\.[\w.]{2,}"))


def stated_years(text: Column) -> Column:
    """Years of experience as a résumé states them first."""
    return F.nullif(F.regexp_extract(text, YEARS, 1), F.lit("")).try_cast("double")


def name(text: Column) -> Column:
    """The first short line of two to four words without digits or an address, in upper case at its beginning."""

    def fits(x: Column) -> Column:
        return (F.length(x) <= 60) & ~x.rlike(r"\d") & email(x).isNull() & x.rlike(r"^\p{Lu}") & F.size(F.split(x, r"\s+")).between(2, 4)

    return F.get(F.filter(F.transform(lines_of(text), lambda x: strip(x)), fits), 0)


def place(text: Column) -> Column:
    """The first of the parts of the first eight lines that reads as a place: two or three capitalised names and commas."""

    def fits(x: Column) -> Column:
        names = F.split(x, r"\s*,\s*")
        return F.length(x).between(4, 60) & x.contains(",") & ~x.rlike(r"[\d@/]") & F.size(names).between(2, 3) & F.forall(names, lambda n: n.rlike(r"^\p{Lu}") & (F.size(F.split(n, r"\s+")) <= 3))

    return F.get(F.filter(F.flatten(F.transform(F.slice(lines_of(text), 1, 8), lambda x: F.transform(F.split(x, "[|·•]"), lambda y: strip(y)))), fits), 0)


def headline(text: Column) -> Column:
    """The first of the first six lines, above any heading, that names a role."""
    top = F.transform(F.slice(lines_of(text), 1, 6), lambda x: strip(x))

    def fits(x: Column, who: Column) -> Column:
        said = ~F.coalesce(F.lower(x) == F.lower(who), F.lit(False))
        return (F.length(x) <= 80) & ~x.endswith(".") & ~x.rlike(r"[\d@|]") & said & x.rlike(rf"(?i)\b(?:{'|'.join(ROLES)})\b")

    def above(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: heading_of(x).isNotNull()), True).cast("int")
        own = F.when(first > 0, F.slice(lines, F.lit(1), first - 1)).otherwise(lines)
        return once(name(text), lambda who: F.get(F.filter(own, lambda x: fits(x, who)), 0))

    return once(top, above)


def fields(text: Column, as_of: Column) -> Column:
    """What a résumé says: name, email, phone, place, headline, linkedin, github, years (as stated), months (of its ranges
    of dates under experience, overlaps once) and summary. What it doesn't say is null; nothing is inferred."""

    def told(p: Column) -> Column:
        return F.struct(
            name(text).alias("name"), email(text).alias("email"), phone(text).alias("phone"), place(text).alias("place"), headline(text).alias("headline"),
            F.regexp_substr(text, F.lit(r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/[\w-]+")).alias("linkedin"), F.regexp_substr(text, F.lit(r"(?i)(?:https?://)?(?:www\.)?github\.com/[\w-]+")).alias("github"),
            stated_years(text).alias("years"), F.when(p["EXPERIENCE"].isNotNull(), covered_months(date_ranges(p["EXPERIENCE"], as_of))).alias("months"), F.substring(strip(p["SUMMARY"]), 1, 4000).alias("summary"),
        )

    return F.when(has_text(text), once(parts(text), told))


#: What stands where personal data was.
TOKENS = {k: f"[{k}]" for k in ("CANDIDATE", "EMAIL", "PHONE", "LINK", "ID", "ADDRESS", "DATE OF BIRTH", "FILE")}
#: Hosts of profiles, ends of domains, names of technologies that look like domains, and words of addresses.
PROFILE_HOSTS = [
    "linkedin.com", "github.com", "gitlab.com", "bitbucket.org", "behance.net", "dribbble.com", "medium.com", "twitter.com", "x.com", "instagram.com", "facebook.com", "leetcode.com", "hackerrank.com",
    "codechef.com", "codeforces.com", "kaggle.com", "stackoverflow.com", "github.io", "vercel.app", "netlify.app", "pages.dev", "herokuapp.com", "wixsite.com", "about.me", "dev.to",
]
DOMAIN_ENDS = ["com", r"co\.in", "in", "org", "net", "io", "dev", "me", "site", "xyz", "tech", "app", "ai", "co"]
TECHNOLOGIES = ["asp.net", "ado.net", "vb.net", "dot.net", "socket.io", "draw.io", "fast.ai"]
ADDRESS_WORDS = [
    "flat", "house", r"h\.?\s?no", r"door\s?no", r"d\.?\s?no", "plot", "street", "road", "rd", "lane", "nagar", "colony", "layout", "sector", "apartments?", "apts?", "block", "village", "mandal", "district",
    "dist", "opp", "opposite", "near", "cross", "main",
]
CONTACT_LINES = 12
#: Parts of names that are words of their own, and stay where they stand alone.
COMMON_WORDS = [
    "ram", "rom", "java", "ruby", "rust", "swift", "dart", "perl", "julia", "apex", "flask", "spring", "rails", "node", "react", "angular", "kotlin", "scala", "elixir", "crystal", "azure", "redis", "kafka",
    "spark", "hive", "maven", "jenkins", "docker", "linux", "unity", "blender", "figma", "excel", "word", "power", "oracle", "tableau", "looker", "express", "django", "pandas", "numpy", "january", "february",
    "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "summer", "winter", "hope", "grace", "joy", "faith", "king", "prince", "rich", "will", "mark", "art",
    "sky", "star", "sun", "moon", "rose", "lily", "sunny",
]
_PATH = r"""(?:/[^\s<>()"'|]*+)?+"""


def _either(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") if "\\" not in w else w for w in words)


_FIRST_LABEL = r"(?<![A-Za-z0-9][-.])"
#: In this order: what an earlier rule has replaced isn't there for a later one. A run of signs is tried from its beginning
#: only, and groups repeat a bounded number of times, so that time is linear and the stack isn't used up.
RULES: list[tuple[str, str]] = [
    (rf"(?:(?<!{_MAIL_SIGN})|\G){_MAIL_SIGN}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){{1,30}}+", TOKENS["EMAIL"]),
    (r"""(?i)\b(?:https?://|www\.)[^\s<>()"'|]++""", TOKENS["LINK"]),
    (rf"(?i)\b{_FIRST_LABEL}(?:[a-z0-9-]++\.){{0,30}}(?:{_either(PROFILE_HOSTS)}){_PATH}", TOKENS["LINK"]),
    (rf"(?i)(?<![@\w.-])(?!(?:{_either(TECHNOLOGIES)})(?![\w/-]|\.[a-z0-9]))[a-z0-9][a-z0-9-]*[a-z0-9](?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?){{0,30}}\.(?:{'|'.join(DOMAIN_ENDS)}){_PATH}(?![\w-])", TOKENS["LINK"]),
    (r"(?i)(?<![\w.-])([.-]*+)\w[\w.-]*\.(?:jpe?g|png|gif|bmp|webp|heic|pdf|docx?|odt|rtf)\b", "$1" + TOKENS["FILE"]),
    (r"(?i)\b(?:d\.?\s?o\.?\s?b\b\.?|date\s+of\s+birth|birth\s*date|born\s+on)\s*[:\-–]?\s*[^\n|;]{1,40}", "Date of birth: " + TOKENS["DATE OF BIRTH"]),
    (r"(?i)\b(?:(?:permanent|present|current|residential|postal|home|correspondence)\s+)?address\s*[:\-–][^\n|]*+", TOKENS["ADDRESS"]),
    (r"(?i)\b(?:pin(?:\s*code)?|pincode|postal\s+code|zip(?:\s*code)?)\s*[:\-]?\s*\d{3}\s?\d{3}\b", TOKENS["ADDRESS"]),
    (r",\s*+\d{6}(?!\d)", ", " + TOKENS["ADDRESS"]),
]
#: After the lines of the contact block, and the candidate's own number.
NUMBER_RULES: list[tuple[str, str]] = [
    (r"(?<!\d)(?!(?:19|20)\d\d[\s-](?:19|20)\d\d[\s-](?:19|20)\d\d(?!\d))\d{4}[\s-]\d{4}[\s-]\d{4}(?!\d)", TOKENS["ID"]),
    (r"\b[A-Z]{5}\d{4}[A-Z]\b", TOKENS["ID"]),
    (r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b", TOKENS["ID"]),
    (r"(?<![\w])\+\d{1,3}(?:[\s.-]?\(?\d{1,5}\)?){2,5}", TOKENS["PHONE"]),
    (r"(?<![\w+])(?:\+?91[\s.-]?)?(?:\(0\)[\s.-]?)?[6-9]\d{4}[\s.-]?\d{5}(?!\d)", TOKENS["PHONE"]),
    (r"(?<!\d)\(?0\d{2,4}\)?[\s.-]?\d{6,8}(?!\d)", TOKENS["PHONE"]),
    (r"(?<!\d)\d{9,}+", TOKENS["ID"]),
]


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, r"([^\p{L}\p{N}])", r"\\$1")


def _contact_block(text: Column) -> Column:
    """Lines of the first twelve that say something, with a figure and a word of an address, are an address."""

    def cleaned(lines: Column) -> Column:
        said = F.filter(F.transform(lines, lambda x, i: F.when(has_text(x), i)), lambda i: i.isNotNull())
        last = F.coalesce(F.get(said, CONTACT_LINES - 1), F.size(lines))
        words = rf"(?i)\b(?:{'|'.join(ADDRESS_WORDS)})\b"
        # Found once: what a lambda holds is worked out for each element.
        return once(last, lambda end: F.array_join(F.transform(lines, lambda x, i: F.when((i <= end) & x.rlike(r"\d") & x.rlike(words), TOKENS["ADDRESS"]).otherwise(x)), "\n"))

    return once(F.split(text, "\n"), cleaned)


def redacted(text: Column, full_name: Column | None = None, mail: Column | None = None, number: Column | None = None) -> Column:
    """A text without addresses, links, files, dates of birth, numbers of persons and, where they are told, the candidate's
    own name, mail address and phone number, in any case and spacing. A null or blank text stays as it is.

    A part of a name of three letters or more goes by itself, too, unless it is a common word; repeats become one."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))

    def then(value: Column, pattern: Column | str, token: str) -> Column:
        return F.regexp_replace(value, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(token))

    if mail is not None:
        out = F.when(has_text(mail), then(out, F.concat(F.lit("(?i)"), _quoted(strip(mail))), TOKENS["EMAIL"])).otherwise(out)
    for pattern, token in RULES:
        out = then(out, pattern, token)
    out = _contact_block(out)
    if number is not None:
        digits = F.regexp_replace(number, r"\D", "")
        local = F.regexp_replace(F.when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits), r"(\d)(?=\d)", r"$1[\\s.()-]?")
        pattern = F.concat(F.lit(r"(?<!\d)(?:\+?\d{1,3}[\s.-]?)?"), local, F.lit(r"(?!\d)"))
        out = once(out, lambda x: F.when(F.length(digits) >= 8, then(x, pattern, TOKENS["PHONE"])).otherwise(x))
    for pattern, token in NUMBER_RULES:
        out = then(out, pattern, token)
    if full_name is not None:
        names = F.filter(F.split(strip(full_name), r"[\s.,-]+"), lambda x: F.length(x) >= 2)
        alone = F.filter(names, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(COMMON_WORDS))

        def sequence(x: Column) -> Column:
            return F.concat(F.lit(r"(?i)(?<!\w)"), F.array_join(F.transform(x, lambda y: _quoted(y)), r"[\s.,-]+"), F.lit(r"(?!\w)"))

        whole = F.when(F.size(names) > 1, F.array(sequence(names), sequence(F.reverse(names)))).otherwise(F.array().cast("array<string>"))
        single = F.transform(alone, lambda x: sequence(F.array(x)))
        patterns = F.coalesce(F.concat(whole, single), F.array().cast("array<string>"))
        out = F.aggregate(patterns, out, lambda held, p: then(held, p, TOKENS["CANDIDATE"]))
    again = r"\[CANDIDATE\](?:[\s.,-]+\[CANDIDATE\]){1,100}+"
    return F.when(has_text(text), then(out, again, TOKENS["CANDIDATE"])).otherwise(text)
