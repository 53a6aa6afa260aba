"""Skills of texts against a loop over blocks, terms and mentions."""

import random
import re

from siltstone.operators import skills

TERMS = [("Go", "go"), ("Java", "java"), (".NET", "net"), ("C++", "c-plus-plus"), ("C", "c"), ("Node.js", "node-js"), ("Machine Learning", "machine-learning"), ("a.a", "a-a"), ("!!", ""), ("java", "java")]
SCHEMA = "id long, text string, skill string, tier string, n int"


def canonical(text):
    return re.sub("[^a-z0-9+#.]+", " ", text.lower()).strip(" ")


def is_heading(line):
    if not line or len(line) > 60 or line[0] in "•·-*":
        return False
    return line.endswith(":") or (len(re.split(r"\s+", line)) <= 8 and line[-1] not in ".,;" and line[0].isalpha())


def find(text, needle, start=0):
    at = text.find(needle, start)
    while at >= 0:
        if (at == 0 or not re.match("[a-z0-9+#]", text[at - 1])) and not re.match("[a-z0-9+#]", text[at + len(needle) :][:1]):
            return at
        at = text.find(needle, at + 1)
    return -1


def items(text):
    return "\n".join(x for x in map(canonical, re.split("[\r\n•·]+", text)) if x)


def plainly(text):
    if not text or not text.strip():
        return {}
    parts, held, context, heading = [], [], None, None
    lines = re.split(r"\r\n|\n|\r", text.rstrip("\r\n"))
    for raw in lines:
        line = raw.strip()
        if is_heading(line):
            if held:
                parts.append((items("\n".join(held)), context, heading))
            held, heading = [], line
            context = "PREFERRED" if re.search(skills._any(skills.PREFERRED_HEADINGS), line, re.I) else "REQUIRED" if re.search(skills._any(skills.REQUIRED_HEADINGS), line, re.I) else None
        else:
            held.append(raw)
    if held:
        parts.append((items("\n".join(held)), context, heading))
    if all(is_heading(x.strip()) for x in lines):
        parts = [(items(text), None, None)]
    out, whole = {}, canonical(text)
    for name, slug in set(TERMS):
        needle = canonical(name)
        if not needle or find(whole, needle) < 0 or (slug == "go" and not re.search(skills.AMBIGUOUS["go"], whole)):
            continue
        best = ("OPTIONAL", "NOT_MENTIONED", None)
        rank = 3
        for body, tier, heading in parts:
            at = find(body, needle)
            while at >= 0:
                if tier:
                    told = (tier, f"HEADING_{tier}", heading)
                else:
                    low, high = max(0, at - 120), min(len(body), at + len(needle) + 120)
                    words = body[low:at].rpartition("\n")[2] + body[at : at + len(needle)] + body[at + len(needle) : high].partition("\n")[0]
                    r, p, c = (re.search(skills._any(x), words, re.I) for x in (skills.REQUIRED_PHRASES, skills.PREFERRED_PHRASES, skills.CONTEXT_PHRASES))
                    told = ("PREFERRED", "PHRASE_PREFERRED", p[0]) if p else ("REQUIRED", "PHRASE_REQUIRED", r[0]) if r else ("OPTIONAL", "CONTEXTUAL" if c else "NO_CUE", c and c[0])
                if skills.TIERS.index(told[0]) < rank:
                    best, rank = told, skills.TIERS.index(told[0])
                at = find(body, needle, at + len(needle))
        out[name, slug] = best
    return out


def found(spark, texts, **more):
    rows = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], SCHEMA)
    terms = spark.createDataFrame(TERMS, "name string, slug string")
    out = {i: {} for i in range(len(texts))}
    for r in skills.tagged(rows, terms, **more).collect():
        out[r["id"]][r["skill"], r["slug"]] = (r["tier"], r["cue"], r["evidence"])
    return out


TEXTS = [
    "Requirements:\n• Java, C++\n• Node.js.\nAbout us\nWe work with Java and .NET",
    "You must have Java.\nC would be a plus\nExperience in C++; exposure to node.js",
    "go-to-market lead, ready to go live",
    "Proficiency in Go",
    "Java developer",
    "Nice to have:\nmachine\nlearning and Machine   Learning\n",
    "Machine\r\nLearning, c#, javac and java2 but not C+",
    None, "", "  \n ", "a.a.a.a a.a",
    "x " * 300 + "required java" + " y" * 300 + " java",
    "required " + "y " * 60 + "java", "required " + "y " * 59 + "java",
    "Preferred qualifications\n- Go or Java.\nResponsibilities\nJava is mandatory here, at least.",
]


def test_cases(spark):
    expected = {i: plainly(t) for i, t in enumerate(TEXTS)}
    assert found(spark, TEXTS) == expected
    assert found(spark, TEXTS, part=3) == expected  # in several passes
    assert expected[0]["Java", "java"] == ("REQUIRED", "HEADING_REQUIRED", "Requirements:") and ("Go", "go") not in expected[2]


def test_random_postings(spark):
    pick = random.Random(3)
    said = ["Requirements:", "Nice to have", "About the team", "must have", "a plus", "we", "java", "c++", ".net", "go", "in go", "node.js", "machine learning", "legacy", "•", "·", "\n", "\n", "\r\n", ".", ";", "and so on and so forth,", "strong", "skills"]
    texts = [" ".join(pick.choices(said, k=pick.randint(1, 60))) for _ in range(300)]
    assert found(spark, texts) == {i: plainly(t) for i, t in enumerate(texts)}


def test_long_text(spark):
    text = "We use Java here.\n" * 200_000 + "Requirements:\nGo programming, go."
    got = found(spark, [text])[0]
    assert got["Java", "java"][0] == "OPTIONAL" and got["Go", "go"] == ("REQUIRED", "HEADING_REQUIRED", "Requirements:")


def test_what_is_kept(spark):
    tagged = spark.createDataFrame([(1, "Java", "java", "OPTIONAL"), (1, "java", "java", "REQUIRED"), (1, "Go", "go", "PREFERRED"), (1, "C", "c", "OPTIONAL"), (2, "C", "c", "OPTIONAL")], "id long, skill string, slug string, tier string")
    stated = spark.createDataFrame([(1, "C", "c", "REQUIRED"), (3, "Rust", "rust", "PREFERRED")], "id long, skill string, slug string, tier string")
    got = sorted((r["id"], r["place"], r["skill"], r["tier"]) for r in skills.applied(tagged, stated, cap=2).collect())
    assert got == [(1, 1, "C", "REQUIRED"), (1, 2, "java", "REQUIRED"), (2, 1, "C", "OPTIONAL"), (3, 1, "Rust", "PREFERRED")]
    assert skills.applied(tagged.limit(0), stated.limit(0)).collect() == []
