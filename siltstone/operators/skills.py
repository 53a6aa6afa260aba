"""Skills that postings mention, and how firmly they ask for each.

Texts go to Python as Arrow batches, one row each, and come back as one row for each skill: a text is cut into blocks
below its headings and blocks into items, all terms of a dictionary are sought by an automaton, and of a skill's mentions the
strongest counts. What the words around the mentions say is read once for all that are alike in a batch.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import canonicalize, folded, has_text

#: How firmly a skill is asked for, strongest first.
TIERS = ["REQUIRED", "PREFERRED", "OPTIONAL"]
#: Words of headings above what is required, and above what is welcome, which are looked for first.
REQUIRED_HEADINGS = [
    "requirements?", "required", "qualifications?", "what (?:you|we).{0,12}(?:need|looking for)", "must[- ]haves?", "essential", "minimum qualifications?", "basic qualifications?", "who you are",
    "skills? (?:and|&) experience", "required skills?",
]
PREFERRED_HEADINGS = [
    "nice[- ]to[- ]haves?", "preferred(?: qualifications?| skills?)?", "bonus(?: points?)?", "good to have", "desirable", "pluses", "additional skills?", "it.{0,3}s a plus", "even better", "extra credit",
]
#: Words around a mention that require it, that welcome it, and that only tell of it.
REQUIRED_PHRASES = [
    "must have", "must possess", "required", "require[sd]?", "mandatory", "essential", "minimum(?: of)?", r"at least \d+\+? years?", r"\d+\+? years? of (?:hands[- ]on )?experience",
    "strong (?:experience|proficiency|background|command)", "proficiency in", "demonstrated experience", "solid (?:experience|understanding)", "experience (?:with|in|using|building|working with)",
    "hands[- ]on (?:experience|knowledge)", "expertise (?:in|with)", "working knowledge of", "background in", "proficient (?:in|with)", "skilled (?:in|with)", "competency (?:in|with)",
    "experience working (?:on|in|with)", "deep (?:understanding|knowledge) of", "ability to (?:write|build|develop)", "comfortable (?:with|in)", "well[- ]versed (?:in|with)",
    r"(?:strong|excellent|exceptional|outstanding)[\w ,-]{0,60}skills", "(?:strong|excellent|exceptional) (?:communication|collaboration|leadership|interpersonal|analytical|problem[- ]solving)",
]
PREFERRED_PHRASES = [
    "nice to have", "preferred", "preferable", "a plus", "bonus", "ideally", "desirable", "would be great", "familiarity with", "exposure to", "good to have", "advantageous", "we.{0,3}d love",
]
CONTEXT_PHRASES = [
    "work (?:with|alongside)", "collaborate with", "partner with", "interface with", "our .{0,20}team", "built (?:on|with)", "powered by", "our (?:stack|platform) (?:is|uses)", "migrating (?:from|off)", "legacy",
]
#: Skills whose names are common words, by slug, and what shows that a text means the skill.
AMBIGUOUS = {
    "go": "|".join([
        r"\bgo(?:lang)? (?:developer|engineer|programming|program|services?|microservices?|routines?|modules?|code|codebase|backend|experience)\b",
        r"\b(?:in|with|using|learn(?:ing)?|write|writing|written|know|knows) go\b", r"\b(?:or|and) go\b", r"\bgo (?:or|and) \w+", r"\bgolang\b",
    ])
}
#: Characters on either side of a mention that may say something of it.
AROUND = 120
#: Skills that a posting keeps.
CAP = 25
#: Terms that one pass looks for; a larger dictionary takes a pass for each part.
PART = 50_000
_NAME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+#")


def _any(words: list[str]) -> str:
    return rf"\b(?:{'|'.join(words)})\b"


#: White space around a line, the ends of lines, and what ASCII characters are in canonical text.
_SPACE = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_LINES, _GAPS, _SIGNS, _ITEMS = (re.compile(x) for x in ("\r\n|[\n\x0b\f\r\x85\u2028\u2029]", "[ \t\n\x0b\f\r]+", "[•·]+", "[\r\n•·]+"))
_CANONICAL = {c: chr(c).lower() if chr(c).lower() in _NAME or c == ord(".") else " " for c in range(128)}
_HEADINGS = [(tier, re.compile(_any(words))) for tier, words in (("PREFERRED", PREFERRED_HEADINGS), ("REQUIRED", REQUIRED_HEADINGS))]


def _canonical(text: str) -> str:
    """As `canonicalize`."""
    if not text.isascii():
        text = folded(text).lower().encode("ascii", "replace").decode()
    return " ".join(text.translate(_CANONICAL).split())


def is_heading(line: str) -> bool:
    """A short line that ends with a colon, or reads as a title: eight words at most, no list sign, no stop at its end."""
    if not 1 <= len(line) <= 60 or line[0] in "•·*-":
        return False
    return line[-1] == ":" or (line[0].isalpha() and line[-1] not in ".,;" and len(_GAPS.split(line)) <= 8)


@lru_cache(10_000)
def heading_tier(line: str) -> str | None:
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), line)
    if not low.isascii():  # words are of letters, decimal digits and marks upon them, as Spark's expressions have them
        made = ""
        for c in low:
            mark = unicodedata.category(c) == "Mn" and made[-1:].isalnum()
            made += "ʘ" if mark else c if not c.isalnum() or c.isalpha() or c.isdecimal() else "\x01"
        low = made
    return next((tier for tier, words in _HEADINGS if words.search(low)), None)


def blocks(text: str) -> tuple[str, list[tuple[str | None, str | None, list[str]]]]:
    """The canonical text, and heading, tier and canonical items of what is between headings.

    A text of headings alone is one block without a heading."""
    lines = _LINES.split(text.rstrip("\r\n"))
    items = [[x for x in map(_canonical, _SIGNS.split(line)) if x] for line in lines]
    plain = [line.strip(_SPACE) for line in lines]
    heads = [is_heading(line) for line in plain]
    whole = " ".join([x for each in items for x in each])
    if all(heads):
        return whole, [(None, None, [x for x in map(_canonical, _ITEMS.split(text)) if x])]
    found: list[tuple[str | None, str | None, list[str]]] = [(None, None, [])]
    for line, head, each in zip(plain, heads, items, strict=True):
        if head:
            found.append((line, heading_tier(line), []))
        else:
            found[-1][2].extend(each)
    return whole, found


class Finder:
    """All mentions of terms in canonical text: a term begins and ends where no character of a name is beside it."""

    def __init__(self, terms: list[tuple[str, str, str]]):
        import ahocorasick

        self.automaton, self.named = ahocorasick.Automaton(), {}
        for needle, name, slug in terms:
            self.named.setdefault(needle, []).append((name, slug))
        for needle in self.named:
            self.automaton.add_word(needle, needle)
        if self.named:
            self.automaton.make_automaton()

    def mentions(self, text: str) -> Iterator[tuple[int, str]]:
        last: dict[str, int] = {}
        for end, needle in self.automaton.iter(text) if self.named else ():
            at = end + 1 - len(needle)
            clear = (at == 0 or text[at - 1] not in _NAME) and (end + 1 == len(text) or text[end + 1] not in _NAME)
            if clear and at >= last.get(needle, 0):
                last[needle] = end + 1
                yield at, needle


def around(item: str, at: int, size: int, reach: int = AROUND) -> str:
    """The words around a mention, within its item."""
    return item[max(0, at - reach) : at + size + reach]


def _first(words: pa.Array, phrases: list[str]) -> pa.Array:
    """The first phrase that is in each of `words`, or null."""
    held = pc.if_else(pc.match_substring_regex(words, f"(?i){_any(phrases)}"), words, None)
    return pc.struct_field(pc.extract_regex(held, f"(?i)(?P<x>{_any(phrases)})"), "x")


def _told(words: list[str]) -> list[tuple[int, str, str | None]]:
    """Rank, cue and evidence of words around mentions; what is weaker is sought only where nothing stronger is said."""
    out: list[tuple[int, str, str | None]] = [(2, "NO_CUE", None)] * len(words)
    rest, silent = pa.array(words, pa.string()), list(range(len(words)))
    for rank, cue, phrases in ((1, "PHRASE_PREFERRED", PREFERRED_PHRASES), (0, "PHRASE_REQUIRED", REQUIRED_PHRASES), (2, "CONTEXTUAL", CONTEXT_PHRASES)):
        said = _first(rest, phrases)
        for i, x in zip(silent, said.to_pylist(), strict=True):
            if x is not None:
                out[i] = (rank, cue, x)
        none = pc.is_null(said)
        rest, silent = rest.filter(none), [i for i, free in zip(silent, none.to_pylist(), strict=True) if free]
    return out


def _found(batches: Iterator[pa.RecordBatch], finder: Finder) -> Iterator[pa.RecordBatch]:
    """Skill, slug, tier, cue and evidence of each skill of each text."""
    ambiguous = {slug: re.compile(pattern) for slug, pattern in AMBIGUOUS.items()}
    for batch in batches:
        words: dict[str, int] = {}
        mentioned: list[tuple[int, str, str, dict]] = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            whole, parts = blocks(text)
            held = dict.fromkeys(needle for _, needle in finder.mentions(whole))
            if not held:
                continue
            # Of each term what headings or words say of it, in order; what is said again adds nothing.
            said: dict[str, dict] = {needle: {} for needle in held}
            for heading, tier, items in parts:
                for item in items:
                    for at, needle in finder.mentions(item):
                        said[needle].setdefault((tier, heading) if tier else words.setdefault(around(item, at, len(needle)), len(words)))
            for needle in held:
                for name, slug in finder.named[needle]:
                    if slug not in ambiguous or ambiguous[slug].search(whole):
                        mentioned.append((row, name, slug, said[needle]))
        told = _told(list(words))
        best = [min((((0 if x[0] == "REQUIRED" else 1, f"HEADING_{x[0]}", x[1]) if isinstance(x, tuple) else told[x]) for x in said), key=lambda t: t[0], default=(3, "NOT_MENTIONED", None)) for *_, said in mentioned]
        key = batch.column("key").take(pa.array([m[0] for m in mentioned], pa.int64()))
        made = [[m[1] for m in mentioned], [m[2] for m in mentioned], [TIERS[min(b[0], 2)] for b in best], [b[1] for b in best], [b[2] for b in best]]
        yield pa.RecordBatch.from_arrays([key, *(pa.array(x, pa.string()) for x in made)], ["key", "skill", "slug", "tier", "cue", "evidence"])


def tagged(postings: DataFrame, terms: DataFrame, key: str = "id", text: str = "text", part: int = PART) -> DataFrame:
    """`key`, skill, slug, tier, cue and evidence of each skill that a text of `postings` mentions.

    `terms` has name and slug. A mention below a heading of what is required or welcome is that; else the words around
    it tell, and those that welcome it count before those that require it. Of several mentions the strongest counts, of
    equally strong ones the first. A skill that is named in headings alone, or across lines, is optional. `key` names a
    text, so no two rows have one; a null or blank text mentions nothing; terms without letters, digits, `+`, `#` or `.` are none."""
    rows = postings.where(has_text(F.col(text))).select(F.col(key).alias("key"), F.col(text).alias("text"))
    given = terms.select(canonicalize(F.col("name")).alias("needle"), "name", "slug").where("needle <> ''").distinct()
    parts = max(1, -(-given.count() // part))
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL("skill string, slug string, tier string, cue string, evidence string")])
    found: DataFrame | None = None
    for k in range(parts):
        held = given.where(F.pmod(F.xxhash64("needle"), F.lit(parts)) == k) if parts > 1 else given
        finder_terms = [tuple(r) for r in held.collect()]

        def find(batches: Iterator[pa.RecordBatch], finder_terms: list = finder_terms) -> Iterator[pa.RecordBatch]:
            return _found(batches, Finder(finder_terms))

        made = rows.mapInArrow(find, schema)
        found = made if found is None else found.unionAll(made)
    return found.withColumnRenamed("key", key)


def applied(tagged: DataFrame, stated: DataFrame | None = None, key: str = "id", cap: int = CAP) -> DataFrame:
    """`key`, slug, skill, tier and place: the skills that a posting keeps, strongest first and then by name, `cap` at most.

    `stated` (`key`, skill, slug, tier) replaces what was found of the skills that it names. Of names with one slug the
    first counts."""
    rows = tagged.select(key, "skill", "slug", "tier")
    if stated is not None:
        stated = stated.select(key, "skill", "slug", "tier")
        rows = rows.join(stated.select(key, "skill"), [key, "skill"], "left_anti").unionByName(stated)
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    one = rows.groupBy(key, "slug").agg(F.min(F.struct(rank.alias("rank"), "skill", "tier")).alias("x"))
    order = Window.partitionBy(key).orderBy("x.rank", "x.skill", "slug")
    return one.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select(key, "slug", "x.skill", "x.tier", "place")
