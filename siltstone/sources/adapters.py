"""Sources by configuration: which adapter serves one, what it would ask for, its pages, its postings and its health.

A source is a row: source (its name), adapter (a key, or null), base_url, token (its name at the provider) and most (the
ceiling of postings; null: none). Pages come as rows of source, page (from 0) and body, from any table or from
`spark.read.format("posting_pages")`; nothing is fetched from a network.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions.text import trimmed
from siltstone.sources import feeds


@dataclass(frozen=True)
class Adapter:
    """How postings of a provider are found: parts of addresses that it serves, the address that is asked, with {host},
    {token}, {limit} and {offset}, how many postings a page holds at most (None: it isn't paged), and an advert's address."""

    serves: tuple[str, ...]
    endpoint: str
    page: int | None = None
    advert: str | None = None


#: Addresses of the providers' public interfaces, in the order in which adapters are asked.
ADAPTERS = {
    "greenhouse": Adapter(("greenhouse.io",), "https://boards-api.greenhouse.io/v1/boards/{token}/jobs?content=true"),
    "lever": Adapter(("lever.co",), "https://api.lever.co/v0/postings/{token}?mode=json"),
    "ashby": Adapter(("ashbyhq.com",), "https://api.ashbyhq.com/posting-api/job-board/{token}?includeCompensation=true"),
    "smartrecruiters": Adapter(("smartrecruiters.com",), "https://api.smartrecruiters.com/v1/companies/{token}/postings?limit={limit}", 100),
    "workable": Adapter(("workable.com",), "https://apply.workable.com/api/v1/widget/accounts/{token}?details=true"),
    "breezy": Adapter(("breezy.hr",), "https://{token}.breezy.hr/json"),
    "oracle-hcm": Adapter(
        ("oraclecloud.com",),
        "{host}/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&expand=requisitionList&finder=findReqs;siteNumber={token},limit={limit},offset={offset}",
        100,
        "{host}/hcmUI/CandidateExperience/en/sites/{token}/job/{id}",
    ),
}


def host_of(base_url: Column) -> Column:
    return F.regexp_replace(trimmed(base_url), "(?<!/)/+$", "")


def chosen(sources: DataFrame) -> DataFrame:
    """`sources` with `serving`: the adapter that a source names, else the first that serves its address; null for none."""
    low, found = F.lower("base_url"), F.when(F.col("adapter").isin(*ADAPTERS), F.col("adapter"))
    for key, adapter in ADAPTERS.items():
        for part in adapter.serves:
            found = found.when(low.contains(part), key)
    return sources.withColumn("serving", found)


def _filled(template: str, **values: Column) -> Column:
    text: Column = F.lit(template)
    for name, value in values.items():
        if "{" + name + "}" in template:
            text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return text


def _limit(adapter: Adapter, most: Column) -> Column:
    return F.least(most, F.lit(adapter.page))  # the smaller of those that are told


def probes(sources: DataFrame, offset: int = 0) -> DataFrame:
    """source, serving and the address that would be asked for postings from `offset` on."""
    address = F.lit(None).cast("string")
    for key, adapter in ADAPTERS.items():
        limit = F.coalesce(_limit(adapter, F.col("most")), F.lit(0))
        told = _filled(adapter.endpoint, host=host_of(F.col("base_url")), token=F.coalesce("token", F.lit("")), limit=limit, offset=F.lit(offset))
        address = F.when(F.col("serving") == key, told).otherwise(address)
    return chosen(sources).select("source", "serving", address.alias("address"))


def _read(sources: DataFrame, pages: DataFrame, key: str, size: int | None) -> DataFrame:
    """The pages of one adapter's sources that are read, in order: up to the first short one or the ceiling.

    With before (how many postings the pages before have), ids (how many this one has) and broken (it can't be read)."""
    adapter, board = ADAPTERS[key], feeds.BOARDS[key]
    held = chosen(sources).where(F.col("serving") == key).select("source", "base_url", "token", "most")
    size = size or adapter.page
    rows = feeds.with_items(pages.join(held, "source"), board, carry=("page", "base_url", "token", "most"))
    kept = F.size(F.filter("items", lambda x: feeds.made_id(board, x) & board.keep(x)))
    short = F.lit(True) if size is None else F.size("items") < F.least(F.col("most"), F.lit(size))
    counted = rows.select("source", "page", "base_url", "token", "most", F.col("items").isNull().alias("broken"), F.coalesce(kept, F.lit(0)).alias("ids"), F.coalesce(short, F.lit(True)).alias("short"))
    order = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    told = counted.withColumns({"before": F.coalesce(F.sum("ids").over(order), F.lit(0)), "stopped": F.coalesce(F.max("short").over(order), F.lit(False))})
    return told.where(~F.col("stopped") & (F.col("most").isNull() | (F.col("before") < F.col("most"))))


def fetched(sources: DataFrame, pages: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """Rows of source and the fields of raw postings of all sources that adapter `key` serves, at most `most` of each.

    Pages are read in order until one is short, has no posting or the ceiling is met; what is behind isn't looked
    at. A page among them that can't be read fails its source, which then has no postings; see `health`. `size` is how many
    postings a page holds, if not the provider's number. A page number that repeats is read twice; rows of sources
    without pages, and pages without a source, give nothing."""
    adapter, board = ADAPTERS[key], feeds.BOARDS[key]
    read = _read(sources, pages, key, size)
    failed = read.where("broken").select("source").distinct()
    fine = read.join(failed, "source", "left_anti").select("source", "page", "base_url", "token", F.when(F.col("most").isNull(), 2**31 - 1).otherwise(F.col("most") - F.col("before")).cast("int").alias("left"))
    rows = feeds.postings(pages.join(fine, ["source", "page"]), board, F.col("left"), carry=("left", "base_url", "token"))
    if adapter.advert:
        url = _filled(adapter.advert, host=host_of(F.col("base_url")), token=F.coalesce("token", F.lit("")), id=F.col("external_id"))
        rows = rows.withColumns({"apply_url": url, "source_url": url})
    return rows.drop("left", "base_url", "token")


def health(sources: DataFrame, pages: DataFrame, key: str, size: int | None = None) -> DataFrame:
    """source, status and postings: HEALTHY with how many its read pages have, FAILING if one can't be read, UNREACHABLE
    if it has no page."""
    seen = _read(sources, pages, key, size).groupBy("source").agg(F.bool_or("broken").alias("broken"), F.sum("ids").alias("ids"), F.max("most").alias("most"))
    rows = chosen(sources).where(F.col("serving") == key).select("source").distinct().join(seen, "source", "left")
    status = F.when(F.col("broken").isNull(), "UNREACHABLE").when(F.col("broken"), "FAILING").otherwise("HEALTHY")
    return rows.select("source", status.alias("status"), F.when(~F.col("broken"), F.least("ids", "most")).alias("postings"))


@dataclass
class _Folder(InputPartition):
    source: str
    path: str


class PagesReader(DataSourceReader):
    """A partition for each source, whose pages are read one after the other, as whether to go on is in the page before."""

    def __init__(self, options: dict):
        self.root, self.limit = options["path"], int(options.get("limit", 100))
        self.most, self.inside = int(options.get("most", 2**31 - 1)), [p for p in options.get("items", "").split(".") if p]

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = self._files()
        found = files.get_file_info(fs.FileSelector(root))
        return [_Folder(f.base_name, f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.Directory]

    def count(self, body: str) -> int:
        """How many items a body has; none if it can't be read, which ends the source."""
        try:
            held = [json.loads(body)]
        except ValueError:
            return 0
        for name in self.inside:
            held = [x[name] for x in held if isinstance(x, dict) and name in x]
            held = [y for x in held for y in (x if isinstance(x, list) else [x])]
        return len(held) if self.inside else sum(len(x) for x in held if isinstance(x, list))

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        files, _ = self._files()
        seen, page = 0, 0
        while seen < self.most:
            path = f"{partition.path}/{page}.json"
            if files.get_file_info(path).type != fs.FileType.File:
                return
            with files.open_input_stream(path) as stream:
                body = stream.read().decode("utf-8", "replace")
            yield partition.source, page, body
            found = self.count(body)
            seen, page = seen + found, page + 1
            if found < min(self.limit, self.most):
                return


class PostingPages(DataSource):
    """Pages of sources as files `<path>/<source>/<page>.json`: source, page and body of those that are worth reading.

    Options: path; limit, what a page holds (100); most, the ceiling of items a source; items, the names that lead to the
    items of a body, with dots, through arrays and objects (none: the body is the array)."""

    @classmethod
    def name(cls) -> str:
        return "posting_pages"

    def schema(self) -> str:
        return "source string, page int, body string"

    def reader(self, schema: object) -> PagesReader:
        return PagesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes `spark.read.format("posting_pages")` known to a session."""
    spark.dataSource.register(PostingPages)
