"""Paged sources: files that a reader takes in order, and the same cut over tables."""

import json

from siltstone.sources import adapters

SOURCES = "source string, adapter string, base_url string, token string, most int"


def page(ids, lists=1):
    items = [{"Id": i, "Title": f"job {i}"} for i in ids]
    return json.dumps({"items": [{"requisitionList": items[k::lists]} for k in range(lists)]})


#: Pages of at most three postings.
PAGES = {
    "two and a bit": [page([1, 2, 3]), page([4, 5, 6], 2), page([7]), page([8, 9, 10])],
    "even": [page([1, 2, 3]), page([]), page([4])],
    "ceiling": [page([1, 2, 3]), page([4, None, 5]), page([6, 7, 8]), "{never read"],
    "broken": [page([1, 2, 3]), '{"items": [{"total": 3}]}', page([4])],
    "not json": ["{"],
    "none": [],
}


def written(folder):
    for source, pages in PAGES.items():
        (folder / source).mkdir(parents=True)
        for i, body in enumerate(pages):
            (folder / source / f"{i}.json").write_text(body)
    (folder / "a file.json").write_text("[]")


def sources(spark):
    rows = [(s, "oracle-hcm", "https://h.example//", "CX", 5 if s == "ceiling" else None) for s in PAGES]
    return spark.createDataFrame([*rows, ("other", "lever", None, None, None), ("unknown", None, "https://x.example", None, None)], SOURCES)


def told(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["source"], int(r["external_id"]))):
        out.setdefault(r["source"], []).append(int(r["external_id"]))
    return out


EXPECTED = {"two and a bit": [1, 2, 3, 4, 5, 6, 7], "even": [1, 2, 3], "ceiling": [1, 2, 3, 4, 5]}
HEALTH = {"two and a bit": ("HEALTHY", 7), "even": ("HEALTHY", 3), "ceiling": ("HEALTHY", 5), "broken": ("FAILING", None), "not json": ("FAILING", None), "none": ("UNREACHABLE", None)}


def test_pages_of_files(spark, tmp_path):
    written(tmp_path)
    adapters.register(spark)
    read = spark.read.format("posting_pages").option("path", str(tmp_path)).option("limit", 3).option("most", 5).option("items", "items.requisitionList").load()
    got = {}
    for r in read.collect():
        got.setdefault(r["source"], []).append(r["page"])
    # Only what is before the first short page, or the ceiling of five, is read; a body that can't be read is short.
    assert got == {"two and a bit": [0, 1], "even": [0, 1], "ceiling": [0, 1], "broken": [0, 1], "not json": [0]}
    found = adapters.fetched(sources(spark), read, "oracle-hcm", 3).collect()
    assert told(found) == EXPECTED | {"two and a bit": [1, 2, 3, 4, 5, 6]}
    assert {r["apply_url"] for r in found if r["external_id"] == "1"} == {"https://h.example/hcmUI/CandidateExperience/en/sites/CX/job/1"}


def test_pages_of_a_table(spark):
    pages = spark.createDataFrame([(s, i, body) for s, own in PAGES.items() for i, body in enumerate(own)] + [(None, 0, page([1])), ("nobody", 0, page([1]))], "source string, page int, body string")
    assert told(adapters.fetched(sources(spark), pages, "oracle-hcm", 3).collect()) == EXPECTED
    assert {r["source"]: (r["status"], r["postings"]) for r in adapters.health(sources(spark), pages, "oracle-hcm", 3).collect()} == HEALTH
    assert adapters.fetched(sources(spark), pages.limit(0), "oracle-hcm").collect() == []


def test_who_serves(spark):
    rows = {r["source"]: (r["serving"], r["address"]) for r in adapters.probes(sources(spark), 100).collect()}
    assert rows["other"] == ("lever", "https://api.lever.co/v0/postings/?mode=json") and rows["unknown"] == (None, None)
    assert rows["ceiling"][1].endswith("siteNumber=CX,limit=5,offset=100") and rows["even"][1].endswith("siteNumber=CX,limit=100,offset=100")


def test_counts_of_bodies():
    reader = adapters.PagesReader({"path": "x", "items": "items.requisitionList"})
    assert [reader.count(b) for b in (page([1, 2, 3], 2), "{", "[]", "7", '{"items": {"requisitionList": [1]}}')] == [3, 0, 0, 0, 1]
    assert adapters.PagesReader({"path": "x"}).count("[1, 2]") == 2
