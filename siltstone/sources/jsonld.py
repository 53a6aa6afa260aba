"""Postings that pages describe in JSON-LD, and addresses that sitemaps list.

Blocks are found and objects collected in tasks, in one pass over a page; identity, choice among copies and fields are
read from VARIANT in Spark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.postings import strip
from siltstone.functions.text import once
from siltstone.functions.urls import canonical_url, host, is_board, valid_apply_url
from siltstone.sources.feeds import instant_at

#: What is read of a page at most. Beyond them a block is rejected, or the page is read no further.
PAGE_CHARS, BLOCKS, BLOCK_BYTES, DEPTH, TOKENS, STRING_CHARS, NAME_CHARS, DIGITS, TAG_CHARS, POSTINGS = 2 << 20, 32, 256 << 10, 32, 20_000, 256 << 10, 1024, 64, 4096, 50
#: Fields by which copies of a posting are compared.
KNOWN = [
    "identifier", "title", "description", "datePosted", "validThrough", "employmentType", "hiringOrganization", "jobLocation", "jobLocationType", "applicantLocationRequirements", "baseSalary",
    "experienceRequirements", "skills", "qualifications", "responsibilities", "url", "mainEntityOfPage", "sameAs",
]
#: Signs of currencies and words of periods in which pay can be told.
SIGNS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}
PERIODS = {"YEAR": "per year", "MONTH": "per month", "HOUR": "per hour"}
#: Names of countries by code, for the most frequent ones; `countries` of `raw_postings` takes others.
COUNTRIES = {
    "AE": "United Arab Emirates", "AU": "Australia", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland", "CN": "China", "DE": "Germany", "ES": "Spain", "FR": "France", "GB": "United Kingdom", "IE": "Ireland",
    "IN": "India", "IT": "Italy", "JP": "Japan", "MX": "Mexico", "NL": "Netherlands", "PL": "Poland", "SE": "Sweden", "SG": "Singapore", "US": "United States",
}
OFFICES = " • "
_OPENING = re.compile(r"<!--|<script(?=[ \t\n\r\f/>])", re.I)
_CLOSING = re.compile(r"</script(?=[ \t\n\r\f/>]|$)", re.I)
_ATTRIBUTE = re.compile(r"""[ \t\n\r\f/]*(?:(>)|([^ \t\n\r\f=>/]*)[ \t\n\r\f]*(?:=[ \t\n\r\f]*(?:"([^"]*)"|'([^']*)'|(?!["'])([^ \t\n\r\f>]*)))?)""")


def _tag(html: str, at: int, end: int) -> tuple[int, str | None]:
    """Where a start tag ends, and its type; 0 if it doesn't end within reach."""
    kind = None
    while at < end and (m := _ATTRIBUTE.match(html, at, end)) and m.end() > at:
        if m[1]:
            return m.end(), kind
        if kind is None and (m[2] or "").lower() == "type":
            kind = next((x for x in m.group(3, 4, 5) if x is not None), "")
        at = m.end()
    return 0, None


def blocks(html: str) -> Iterator[str]:
    """The contents of a page's JSON-LD scripts, in order. Those in comments, or that aren't closed, are none."""
    end, at = min(len(html), PAGE_CHARS), 0
    while m := _OPENING.search(html, at, end):
        if m[0] == "<!--":
            at = html.find("-->", m.end(), end) + 3
            if at < 3:
                return
            continue
        limit = min(end, m.end() + TAG_CHARS)
        begin, kind = _tag(html, m.end(), limit)
        if not begin:
            at = limit
            continue
        close = _CLOSING.search(html, begin, end)
        if not close:
            return
        if (kind or "").partition(";")[0].strip().lower() == "application/ld+json":
            yield html[begin : close.start()]
        at = close.end()


def unwrapped(block: str) -> str:
    """A block without the comment or CDATA marks around it."""
    text = block.strip()
    if text.startswith("<!--") and text.endswith("-->"):
        text = text[4:-3].strip()
    for mark in ("//<![CDATA[", "<![CDATA["):
        text = text.removeprefix(mark)
    for mark in ("//]]>", "]]>"):
        text = text.removesuffix(mark)
    return text.strip()


def _number(digits: str) -> float | int:
    if len(digits) > DIGITS:
        raise ValueError("number")
    return float(digits) if set(digits) & set(".eE") else int(digits)


def _none(name: str) -> None:
    raise ValueError(name)


def parsed(text: str) -> object:
    """The value of a block; ValueError if it is none or over a limit."""
    if len(text.encode("utf-8", "replace")) > BLOCK_BYTES:
        raise ValueError("size")
    try:
        value = json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_none)
    except RecursionError as deep:
        raise ValueError("depth") from deep
    tokens, todo = 0, [(value, 1)]
    while todo:
        x, depth = todo.pop()
        if isinstance(x, str):
            if len(x) > STRING_CHARS:
                raise ValueError("string")
        elif isinstance(x, (dict, list)):
            if depth > DEPTH:
                raise ValueError("depth")
            tokens += 1 + len(x) * isinstance(x, dict)
            if isinstance(x, dict) and any(len(k) > NAME_CHARS for k in x):
                raise ValueError("name")
            todo += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x)]
        tokens += 1
        if tokens > TOKENS:
            raise ValueError("tokens")
    return value


def _of_vocabulary(context: object) -> bool:
    """Whether terms mean schema.org's; where no context is told they do."""
    if isinstance(context, str):
        try:
            parts = urlsplit(context.strip())
            return parts.scheme.lower() in ("http", "https") and (parts.hostname or "") in ("schema.org", "www.schema.org")
        except ValueError:
            return False
    if isinstance(context, dict):
        return isinstance(context.get("@vocab"), str) and _of_vocabulary(context["@vocab"])
    if isinstance(context, list):
        return any(_of_vocabulary(x) for x in context if isinstance(x, (str, dict)))
    return context is None


def collected(value: object, context: object = None) -> Iterator[dict]:
    """The postings of a block in order: objects at the top, in arrays and in graphs of any depth, each under the context
    that is nearest above it."""
    if isinstance(value, list):
        for x in value:
            yield from collected(x, context)
    elif isinstance(value, dict):
        context = value.get("@context", context)
        kinds = value.get("@type")
        kinds = {x for x in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(x, str)}
        if kinds & {"http://schema.org/JobPosting", "https://schema.org/JobPosting"} or (kinds & {"JobPosting", "schema:JobPosting"} and _of_vocabulary(context)):
            yield value
        if "@graph" in value:
            yield from collected(value["@graph"], context)


def postings_of(html: str) -> list[str]:
    """The postings of a page as JSON. A block that can't be read is passed over, and counts among the blocks."""
    found: list[str] = []
    for n, block in enumerate(blocks(html)):
        if n == BLOCKS:
            break
        try:
            found += [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in collected(parsed(unwrapped(block)))]
        except ValueError:
            continue
    return found


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, html = batch.columns
        rows = [(i, n, x) for i, page in enumerate(html.to_pylist()) for n, x in enumerate(postings_of(page or ""))]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*[c.take(at) for c in kept], pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], [*batch.schema.names[:-1], "place", "json"])


def string_at(node: Column, path: str) -> Column:
    """The text at a path; null for anything but a text that says something."""
    value = F.try_variant_get(node, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", strip(F.try_variant_get(node, path, "string")))


def identifier(node: Column) -> Column:
    """The text of an identifier, or its value's, which may be a whole number."""
    value = F.try_variant_get(node, "$.identifier.value", "variant")
    return F.coalesce(string_at(node, "$.identifier"), string_at(node, "$.identifier.value"), F.when(F.schema_of_variant(value).rlike(r"^(BIGINT|DECIMAL\(\d+,0\))"), F.try_variant_get(node, "$.identifier.value", "string")))


def posting_nodes(pages: DataFrame, key: str, html: str = "html", most: int = POSTINGS) -> DataFrame:
    """The columns of `pages` but `html`, with place, json and node (as VARIANT) of each posting that a page describes.

    `key` names a page. Two descriptions are of one posting if their address and identifier are, or address and title,
    or identifier alone; else if they are equal but for the order of names. Of these the one that tells more of KNOWN
    stays, at the place of the first, of equally rich ones that of the smaller hash. At the posting after the first
    `most` a page is read no further. A null page has none. No column may be called place, json or node."""
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([*pages.select(*kept).schema.fields, *T.StructType.fromDDL("place int, json string")])
    rows = pages.select(*kept, html).mapInArrow(_told, schema).withColumn("node", F.try_parse_json("json"))
    n = F.col("node")
    read = {"__url": string_at(n, "$.url"), "__said": identifier(n), "__title": F.lower(F.regexp_replace(string_at(n, "$.title"), r"\s+", " ")), "__hash": F.sha2(F.to_json(n), 256)}
    rows = rows.withColumns(read).withColumn("__url", once(F.col("__url"), lambda x: canonical_url(x)))
    url, said, title, digest = map(F.col, read)
    name = F.when(url.isNotNull() & said.isNotNull(), F.concat(F.lit("url:"), url, F.lit("|id:"), said)).when(url.isNotNull(), F.concat(F.lit("url:"), url, F.coalesce(F.concat(F.lit("|title:"), title), F.concat(F.lit("|json:"), digest))))
    name = name.when(said.isNotNull(), F.concat(F.lit("id:"), said)).otherwise(F.concat(F.lit("json:"), digest))
    told = F.map_filter(F.try_variant_get(n, "$", "map<string, variant>"), lambda k, v: k.isin(KNOWN) & (F.schema_of_variant(v) != "VOID"))
    present = F.coalesce(F.size(told), F.lit(0))
    rows = rows.select(*kept, "place", "json", name.alias("__name"), present.alias("__present"), digest.alias("__hash"))
    rows = rows.withColumn("__first", F.min("place").over(Window.partitionBy(key, "__name")))
    by_page = Window.partitionBy(key)
    rows = rows.withColumn("__rank", F.dense_rank().over(by_page.orderBy("__first")))
    rows = rows.withColumn("__end", F.min(F.when(F.col("__rank") > most, F.col("__first"))).over(by_page))
    best = F.min_by(F.struct(*[c for c in kept if c != key], "json"), F.struct(-F.col("__present"), "__hash"))
    one = rows.where("__end is null or place < __end").groupBy(key, "__name").agg(F.min("place").alias("place"), best.alias("x"))
    return one.select(key, *[F.col(f"x.`{c}`").alias(c) for c in kept if c != key], "place", F.col("x.json").alias("json"), F.try_parse_json("x.json").alias("node")).select(*kept, "place", "json", "node")


def _each(value: Column, path: str) -> Column:
    """The elements of an array at a path, or what is there as the only one."""
    there = F.try_variant_get(value, path, "variant")
    kind = F.schema_of_variant(there)
    none = F.array().cast("array<variant>")
    return F.when(kind.startswith("ARRAY"), F.try_variant_get(value, path, "array<variant>")).when(there.isNull() | (kind == "VOID"), none).otherwise(F.array(there))


def _texts(value: Column, path: str) -> Column:
    return F.array_distinct(F.filter(F.transform(_each(value, path), lambda x: string_at(x, "$")), lambda x: x.isNotNull()))


def _location(node: Column, countries: dict[str, str]) -> Column:
    """Offices, the first of them first. A region that is written out isn't told without a country, as it would be read as one."""
    named = F.create_map(*[F.lit(x) for pair in countries.items() for x in pair])

    def office(place: Column) -> Column:
        city, region = string_at(place, "$.address.addressLocality"), string_at(place, "$.address.addressRegion")
        stated = F.coalesce(string_at(place, "$.address.addressCountry"), string_at(place, "$.address.addressCountry.name"))
        country = F.coalesce(F.try_element_at(named, F.upper(stated)), stated)
        region = F.when(city.isNull() | country.isNotNull() | region.rlike(r"^\p{Lu}{2}$"), region)
        kind = F.schema_of_variant(F.try_variant_get(place, "$.address", "variant"))
        parts = F.nullif(F.concat_ws(", ", city, region, country), F.lit(""))
        return F.when(kind.startswith("OBJECT"), parts).when(kind == "STRING", string_at(place, "$.address")).otherwise(string_at(place, "$.name"))

    offices = F.array_distinct(F.filter(F.transform(_each(node, "$.jobLocation"), office), lambda x: x.isNotNull()))
    return F.nullif(F.array_join(offices, OFFICES), F.lit(""))


def _amount(node: Column, name: str) -> Column:
    path = f"$.baseSalary.value.{name}"
    kind = F.schema_of_variant(F.try_variant_get(node, path, "variant"))
    said = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|STRING)"), F.try_variant_get(node, path, "string"))
    return F.trim(said).try_cast("decimal(28,8)")


def _plain(amount: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(amount.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _salary(node: Column) -> Column:
    """Pay as a range with sign and period; null where a part is missing, unknown or out of order."""

    def looked_up(table: dict[str, str], value: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.upper(value))

    sign, period = looked_up(SIGNS, string_at(node, "$.baseSalary.currency")), looked_up(PERIODS, string_at(node, "$.baseSalary.value.unitText"))
    one = F.struct(_amount(node, "minValue").alias("low"), _amount(node, "maxValue").alias("high"), _amount(node, "value").alias("single"))

    def told(x: Column) -> Column:
        low = F.coalesce(x["low"], x["single"])
        high = F.coalesce(x["high"], low)
        return F.when((high >= low) & sign.isNotNull() & period.isNotNull(), F.concat(sign, _plain(low), F.lit(" - "), sign, _plain(high), F.lit(" "), period))

    return once(one, told)


def external_id(node: Column) -> Column:
    """What names a posting: its identifier, its address, or that of the page that it is the entity of."""
    main = F.coalesce(string_at(node, "$.mainEntityOfPage"), string_at(node, "$.mainEntityOfPage['@id']"), string_at(node, "$.mainEntityOfPage.url"))
    return F.coalesce(identifier(node), once(string_at(node, "$.url"), lambda x: canonical_url(x)), once(main, lambda x: canonical_url(x)))


def raw_postings(nodes: DataFrame, company: Column, page_url: Column, fallback: Column | None = None, own_page: Column | None = None, countries: dict[str, str] | None = None) -> DataFrame:
    """The columns of `nodes` (see `posting_nodes`) but node, and the fields of raw postings that have a title and an id.

    `company` is whose source it is; what a page says of the employer isn't trusted. An address leads on only to the
    page's own host or to a known board, else to the page itself where it is the posting's own (`own_page`).
    `fallback` is an id for postings that tell none. Ids of over 200 characters are named by their hash."""
    n = F.col("node")
    found = {"__id": F.coalesce(fallback, external_id(n)) if fallback is not None else external_id(n), "__url": string_at(n, "$.url"), "__kinds": _texts(n, "$.employmentType"), "__host": host(page_url), "__pay": _salary(n)}
    names = nodes.columns
    nodes = nodes.withColumns(found)
    said, url, kinds = F.col("__id"), F.col("__url"), F.col("__kinds")
    said = F.when(F.length(said) <= 200, said).otherwise(F.concat(F.lit("sha256:"), F.sha2(said, 256)))
    trusted = once(url, lambda x: valid_apply_url(x) & ((host(x) == F.col("__host")) | is_board(x)))
    own = F.when((own_page if own_page is not None else F.lit(False)) & valid_apply_url(page_url), F.trim(page_url))
    leads = F.when(trusted, url).otherwise(own)
    fields = {
        "external_id": said, "requisition_id": F.substring(identifier(n), 1, 120), "title": string_at(n, "$.title"), "company_name": company, "location_text": _location(n, countries or COUNTRIES),
        "description_html": F.when(F.schema_of_variant(F.try_variant_get(n, "$.description", "variant")) == "STRING", F.try_variant_get(n, "$.description", "string")),
        "employment_type_text": F.when(F.size(kinds) == 1, kinds[0]), "work_mode_text": F.when(F.exists(_texts(n, "$.jobLocationType"), lambda x: F.upper(x) == "TELECOMMUTE"), "remote"),
        "salary_text": F.col("__pay"), "apply_url": leads, "source_url": leads, "posted_at": instant_at(n, "$.datePosted"), "valid_through": string_at(n, "$.validThrough"), "raw_payload": F.col("json"),
    }
    kept = [c for c in names if c not in ("node", "json") and c not in fields]
    return nodes.select(*kept, *[v.alias(k) for k, v in fields.items()]).where("title is not null and external_id is not null")


def has_expired(valid_through: Column, as_of: Column) -> Column:
    """Whether a time has passed, or a day has ended; what can't be read hasn't."""
    at = F.try_to_timestamp(valid_through, F.lit("yyyy-MM-dd'T'HH:mm[:ss][.SSS]XXX"))
    day = F.try_to_timestamp(F.substring(valid_through, 1, 10), F.lit("yyyy-MM-dd")) + F.expr("interval 1 day")
    return F.coalesce(F.coalesce(at, day) < as_of, F.lit(False))


def crawled(listings: DataFrame, pages: DataFrame, as_of: Column, budget: int = 60, most: int | None = None) -> DataFrame:
    """Raw postings of careers pages, by source: what `listings` (source, url, html; one a source) claim and what the
    `pages` that were opened for them (source, place, url, status, html; allowed by robots rules) say themselves.

    Of each source the first `budget` allowed pages by place count. A posting's own page outranks the listing; a claim
    whose page answers 404 or 410 is withdrawn, one whose page couldn't be read stands. Postings that have expired at
    `as_of` are none. A page of one posting that tells no id gives it its address. Own pages come first, then claims, each
    in order, at most `most`. Columns: source, page_url, own, rank and the fields of raw postings."""
    opened = pages.where("allowed").withColumn("__n", F.row_number().over(Window.partitionBy("source").orderBy("place", "url"))).where(F.col("__n") <= budget)
    gone = opened.where(F.col("status").isin(404, 410)).select("source", F.col("url").alias("apply_url")).distinct()
    read = opened.where("status between 200 and 299").select(F.struct("source", "place", "url").alias("page"), "source", F.col("url").alias("page_url"), F.col("place").alias("page_place"), "html")
    mine = posting_nodes(read, "page")
    mine = mine.withColumn("__alone", F.count("*").over(Window.partitionBy("page")) == 1)
    silent = external_id(F.col("node")).isNull()
    mine = raw_postings(mine.withColumns({"own": F.lit(True), "__fall": F.when(F.col("__alone") & silent, F.col("page_url"))}), F.col("source"), F.col("page_url"), F.col("__fall"), F.col("__alone"))
    shown = listings.select(F.struct("source", "url").alias("page"), "source", F.col("url").alias("page_url"), F.lit(-1).cast("long").alias("page_place"), "html")
    claims = raw_postings(posting_nodes(shown, "page").withColumn("own", F.lit(False)), F.col("source"), F.col("page_url"))
    claims = claims.join(gone, ["source", "apply_url"], "left_anti")
    columns = ["source", "page_url", "page_place", "place", "own", *RAW]
    every = mine.select(*columns).unionByName(claims.select(*columns)).where(~has_expired(F.col("valid_through"), as_of))
    order = [F.desc("own"), F.col("page_place"), F.col("page_url"), F.col("place")]
    first = every.withColumn("__n", F.row_number().over(Window.partitionBy("source", "external_id").orderBy(*order))).where("__n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(*order)))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    return ranked.select("source", "page_url", "own", "rank", *RAW)


RAW = ["external_id", "requisition_id", "title", "company_name", "location_text", "description_html", "employment_type_text", "work_mode_text", "salary_text", "apply_url", "source_url", "posted_at", "valid_through", "raw_payload"]


def listed(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """The columns of `sitemaps` but `xml`, with each address that a sitemap lists (`loc`), once, and whether it lists
    sitemaps rather than pages (`nested`)."""
    locs = F.array_distinct(F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?\s*([^<\]\s]+)\s*(?:\]\]>)?\s*</loc>"), F.lit(1)), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&"))))
    return sitemaps.withColumns({"loc": F.explode(locs), "nested": F.col(xml).rlike("(?i)<sitemapindex")}).drop(xml)
