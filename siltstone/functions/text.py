"""Text scalars as Column expressions: slugs, canonical forms, similarity, HTML to text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Latin letters whose compatibility decomposition is one ASCII character and marks, and that character."""
    found = [(chr(c), base) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)) if (base := "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) and len(base) == 1 and base.isascii()]
    return "".join(a for a, _ in found), "".join(b for _, b in found)


_MARKED, _PLAIN = _folding()
_FOLDED = str.maketrans(_MARKED, _PLAIN)
#: Unicode white space, as in the regular expressions below.
SPACE = r"[\s\x{85}\p{Z}]"
#: Runs of all but `a-z0-9+#.`. The same class as a negated one (`[^a-z0-9+#.]+`) takes eight times as long.
_NO_NAME = r"[\x00-\x22\x24-\x2A\x2C\x2D\x2F\x3A-\x60\x7B-\x{10FFFF}]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)`, with `value` found once for each row however often it is used."""
    return F.transform(F.array(value), use)[0]


def fold(text: Column) -> Column:
    """Latin letters without their marks. Other scripts stay as they are."""
    return once(text, lambda x: F.when(F.octet_length(x) > F.length(x), F.regexp_replace(F.translate(x, _MARKED, _PLAIN), r"\p{M}", "")).otherwise(x))


def folded(text: str) -> str:
    """As `fold`, of a text in Python."""
    return "".join(c for c in text.translate(_FOLDED) if unicodedata.category(c)[0] != "M")


def has_text(text: Column) -> Column:
    return text.isNotNull() & text.rlike(r"[^\s\x{85}\p{Z}]")


def slugify(text: Column) -> Column:
    """Lower-case letters and digits, all else one hyphen between them; null or blank gives the empty text."""
    slug = F.regexp_replace(F.lower(fold(text)), "[^a-z0-9]+", "-")
    return F.when(has_text(text), F.regexp_replace(slug, "^-|-$", "")).otherwise("")


def skill_slug(text: Column) -> Column:
    return slugify(F.replace(F.replace(text, F.lit("+"), F.lit(" plus ")), F.lit("#"), F.lit(" sharp ")))


def canonicalize(text: Column) -> Column:
    """For comparing: lower case, no marks, only `a-z0-9+#.` and single spaces; null gives the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(fold(text)), _NO_NAME, " ")), F.lit(""))


def trimmed(text: Column, space: str = " \t\n\x0b\f\r") -> Column:
    """Without these characters at either end, in one pass; a pattern for the end looks at each inner run from all its places."""
    return F.trim(text, F.lit(space))


def strip_html(html: Column) -> Column:
    """Readable text of an HTML fragment; the references that feeds use are decoded in a fixed order.

    Time is linear in the text: markup is sought up to the last `>` only, so each tag that begins ends, and a script or
    style that isn't closed takes the rest of its pass (`$2`) rather than being sought an end for again and again."""
    size = F.length(html)
    last = size - F.locate(">", F.reverse(html)) + 1
    tagged = html.contains("<") & html.contains(">")

    def without_tags(head: Column) -> Column:
        low = F.lower(head)
        out = head
        for kind in ("script|style", "script", "style"):
            out = F.regexp_replace(out, rf"(?is)<({kind})[^>]*>(?:.*?</\1>|(.*))", " $2")
        out = F.when(low.contains("<script") | low.contains("<style"), out).otherwise(head)
        out = F.regexp_replace(out, r"(?i)<br\s*+/?>|</(?:p|div|li|h[1-6])>", "\n")
        return F.regexp_replace(F.regexp_replace(out, r"(?i)<li[^>]*>", "• "), "<[^>]+>", " ")

    out = F.when(tagged, F.concat(without_tags(F.substring(html, F.lit(1), last)), F.substring(html, last + 1, size))).otherwise(html)
    return once(out, _decoded)


def _decoded(text: Column) -> Column:
    out = text
    for reference, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&rsquo;", "'"), ("&ndash;", "-"), ("&mdash;", "-")):
        out = F.replace(out, F.lit(reference), F.lit(sign))
    out = F.regexp_replace(F.when(text.contains("&"), out).otherwise(text), r"[\t\x0B\f\r ]+", " ")
    return trimmed(F.regexp_replace(out, "\n{3,}", "\n\n"), "".join(map(chr, range(33))))


def canonical_json(text: Column) -> Column:
    """JSON in one form: names in order at every depth, numbers without needless digits, no white space; null for what is
    no JSON, names that repeat among it."""
    return F.to_json(F.try_parse_json(text))


def tokens(text: Column) -> Column:
    """The distinct canonical tokens; a text of punctuation alone has the empty token."""
    return F.array_distinct(F.split(canonicalize(text), " "))


def overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays of distinct elements, each found once."""

    def of_both(x: Column) -> Column:
        return once(F.size(F.array_intersect(x["a"], x["b"])), lambda n: n / (F.size(x["a"]) + F.size(x["b"]) - n))

    return once(F.struct(left.alias("a"), right.alias("b")), of_both)


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of the token sets; 0 if either text is blank."""
    return F.when(has_text(left) & has_text(right), overlap(tokens(left), tokens(right))).otherwise(F.lit(0.0))


def mentions_term(text: Column, term: str) -> Column:
    """Whether canonical text has the term between characters that are no letter, digit, plus or hash."""
    quoted = "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in term)
    return canonicalize(text).rlike(rf"(^|[^a-z0-9+#]){quoted}($|[^a-z0-9+#])")


def comparable(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def mentions(haystack: Column, needle: Column) -> Column:
    """Containment of letters and digits alone, for needles of three or more of them."""
    return (F.length(comparable(needle)) >= 3) & comparable(haystack).contains(comparable(needle))


def prettify(slug: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(slug, "-"), lambda x: x != ""), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))), " ")


def friendly(name: Column) -> Column:
    """An enumeration's name as a label: `ON_SITE` gives `On site`."""
    low = F.replace(F.lower(name), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))


def like_pattern(text: str) -> str:
    """`text` as a LIKE pattern of itself, with `!` as the escape."""
    return "".join("!" + c if c in "!%_" else c for c in text)


def join_naturally(items: Column) -> Column:
    """`a`, `a and b`, `a, b and c`."""
    last = F.element_at(items, -1)
    return F.when(F.size(items) == 0, "").when(F.size(items) == 1, last).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.size(items) - 1), ", "), F.lit(" and "), last))


def canonical_key(company: Column, title: Column, city: Column) -> Column:
    """The key under which two sightings are one posting."""

    def part(x: Column, default: str) -> Column:
        return F.when(has_text(x), x).otherwise(default)

    key = F.concat_ws("::", part(company, "unknown"), part(title, "untitled"), part(city, "any"))
    return F.substring(slugify(key), 1, 255)


def usable_requisition(text: Column) -> Column:
    """2 to 64 characters, a digit among them, no white space."""
    return F.coalesce(F.length(text).between(2, 64) & text.rlike("[0-9]") & ~text.rlike(SPACE), F.lit(False))


def clean_domains(text: Column) -> Column:
    """A comma-separated list of mail domains: no addresses, paths or spaces; distinct, sorted."""
    parts = F.transform(F.split(F.lower(text), ","), lambda x: F.regexp_replace(F.trim(x), "^@", ""))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)+$")))), ",")
