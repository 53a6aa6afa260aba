"""Job-board feeds: JSON bodies, one a row, to rows of raw postings.

A board is described by where its items are and by an expression for each field; all fields are read from VARIANT, so
an odd type in one posting spoils neither the others nor a schema. A body that can't be read, or without its array of
items, gives no rows in `postings` and one row in `unreadable`. Items without an id are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.numbers import lenient_instant
from siltstone.functions.postings import strip
from siltstone.functions.text import has_text, once

FIELDS = [
    "external_id", "requisition_id", "title", "company_name", "location_text", "description_html", "employment_type_text", "work_mode_text",
    "department_text", "salary_text", "apply_url", "source_url", "posted_at", "updated_at",
]
INSTANTS = ("posted_at", "updated_at")


#: A text that is no object or array, and has no white space around it.
_BARE = r"(?s)^[^\s\x{85}\p{Z}\[{](?:.*[^\s\x{85}\p{Z}])?\z"


def text_at(item: Column, path: str) -> Column:
    """The scalar at a JSON path as text; null for null, blank, objects and arrays, whose texts begin with a bracket.

    What is there is sought once, however often the text is looked at."""
    nested = F.schema_of_variant(F.try_variant_get(item, path, "variant")).rlike("^(OBJECT|ARRAY)")
    return once(F.try_variant_get(item, path, "string"), lambda x: F.when(x.rlike(_BARE), x).when(~(x.rlike(r"^[\[{]") & nested), strip(x)))


def flag_at(item: Column, path: str) -> Column:
    return F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "BOOLEAN", F.try_variant_get(item, path, "boolean"))


def instant_at(item: Column, path: str) -> Column:
    return once(text_at(item, path), lenient_instant)


def whole_at(item: Column, path: str) -> Column:
    """The number at a JSON path as a long; null for all else."""
    return F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(item, path, "bigint"))


def millis_at(item: Column, path: str) -> Column:
    return once(whole_at(item, path), lambda value: F.when(value > 0, F.timestamp_millis(value)))


def joined(*parts: Column) -> Column:
    """The parts that have text, with commas; null if none has."""
    return once(F.concat_ws(", ", *parts), lambda x: F.when(x != "", x))


def object_or_text(item: Column, path: str) -> Column:
    """The `name` of an object, or the scalar itself."""
    return F.coalesce(text_at(item, f"{path}.name"), text_at(item, path))


def _unescaped(text: Column) -> Column:
    """Markup that a feed escaped once more; the ampersand comes last, so that it isn't decoded twice."""

    def signs(x: Column) -> Column:
        for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(reference), F.lit(sign))
        return x

    return once(text, signs)


def _lever_description(item: Column) -> Column:
    def section(x: Column) -> Column:
        head, body = text_at(x, "$.text"), text_at(x, "$.content")
        return F.concat(F.coalesce(F.concat(F.lit("<h3>"), head, F.lit("</h3>")), F.lit("")), F.coalesce(F.concat(F.lit("<ul>"), body, F.lit("</ul>")), F.lit("")))

    lists = F.coalesce(F.try_variant_get(item, "$.lists", "array<variant>"), F.array().cast("array<variant>"))
    whole = F.concat(F.coalesce(text_at(item, "$.description"), F.lit("")), F.array_join(F.transform(lists, section), ""), F.coalesce(text_at(item, "$.additional"), F.lit("")))
    return F.nullif(whole, F.lit(""))


@dataclass(frozen=True)
class Board:
    """Where the items are, and how fields are read from an item; `source` is the name that the feed is registered under,
    `body` the whole of it. With `lists`, items hold arrays of postings at that path rather than being them."""

    items: str
    fields: Callable[[Column, Column, Column], dict[str, Column]]
    keep: Callable[[Column], Column] = lambda item: F.lit(True)
    lists: str | None = None


def _greenhouse(x: Column, source: Column, body: Column) -> dict[str, Column]:
    url = text_at(x, "$.absolute_url")
    return {
        "external_id": text_at(x, "$.id"), "requisition_id": text_at(x, "$.requisition_id"), "title": text_at(x, "$.title"), "company_name": F.coalesce(text_at(x, "$.company.name"), source),
        "location_text": text_at(x, "$.location.name"), "description_html": _unescaped(text_at(x, "$.content")), "department_text": text_at(x, "$.departments[0].name"),
        "apply_url": url, "source_url": url, "posted_at": instant_at(x, "$.first_published"), "updated_at": instant_at(x, "$.updated_at"),
    }


def _lever(x: Column, source: Column, body: Column) -> dict[str, Column]:
    hosted = text_at(x, "$.hostedUrl")
    return {
        "external_id": text_at(x, "$.id"), "title": text_at(x, "$.text"), "company_name": source, "location_text": text_at(x, "$.categories.location"), "description_html": _lever_description(x),
        "employment_type_text": text_at(x, "$.categories.commitment"), "work_mode_text": text_at(x, "$.workplaceType"), "department_text": text_at(x, "$.categories.department"),
        "salary_text": text_at(x, "$.salaryRange.currency"), "apply_url": F.coalesce(text_at(x, "$.applyUrl"), hosted), "source_url": hosted,
        "posted_at": millis_at(x, "$.createdAt"), "updated_at": millis_at(x, "$.updatedAt"),
    }


def _ashby(x: Column, source: Column, body: Column) -> dict[str, Column]:
    url, remote = text_at(x, "$.jobUrl"), flag_at(x, "$.isRemote")
    return {
        "external_id": text_at(x, "$.id"), "title": text_at(x, "$.title"), "company_name": source, "location_text": text_at(x, "$.location"), "description_html": text_at(x, "$.descriptionHtml"),
        "employment_type_text": text_at(x, "$.employmentType"), "work_mode_text": F.when(remote, "Remote").when(~remote, "Onsite"), "department_text": text_at(x, "$.department"),
        "salary_text": text_at(x, "$.compensation.compensationTierSummary"), "apply_url": F.coalesce(text_at(x, "$.applyUrl"), url), "source_url": url,
        "posted_at": instant_at(x, "$.publishedAt"), "updated_at": instant_at(x, "$.updatedAt"),
    }


def _smartrecruiters(x: Column, source: Column, body: Column) -> dict[str, Column]:
    url = F.concat_ws("/", F.lit("https://jobs.smartrecruiters.com"), F.coalesce(text_at(x, "$.company.identifier"), source), text_at(x, "$.id"))
    return {
        "external_id": text_at(x, "$.id"), "requisition_id": text_at(x, "$.refNumber"), "title": text_at(x, "$.name"), "company_name": text_at(x, "$.company.name"),
        "location_text": joined(*[text_at(x, f"$.location.{k}") for k in ("city", "region", "country")]), "employment_type_text": text_at(x, "$.typeOfEmployment.label"),
        "department_text": text_at(x, "$.department.label"), "apply_url": url, "source_url": url, "posted_at": instant_at(x, "$.releasedDate"),
    }


def _workable(x: Column, source: Column, body: Column) -> dict[str, Column]:
    return {
        "external_id": text_at(x, "$.shortcode"), "requisition_id": text_at(x, "$.code"), "title": text_at(x, "$.title"), "company_name": F.coalesce(text_at(body, "$.name"), source),
        "location_text": joined(*[text_at(x, f"$.{k}") for k in ("city", "state", "country")]), "description_html": text_at(x, "$.description"), "employment_type_text": text_at(x, "$.employment_type"),
        "department_text": text_at(x, "$.department"), "work_mode_text": F.when(F.lower(text_at(x, "$.telecommuting")) == "true", "Remote"), "apply_url": text_at(x, "$.url"),
        "source_url": text_at(x, "$.shortlink"), "posted_at": instant_at(x, "$.published_on"), "updated_at": instant_at(x, "$.created_at"),
    }


def _breezy(x: Column, source: Column, body: Column) -> dict[str, Column]:
    url = text_at(x, "$.url")
    return {
        "external_id": text_at(x, "$.id"), "requisition_id": text_at(x, "$.friendly_id"), "title": text_at(x, "$.name"), "company_name": text_at(x, "$.company.name"),
        "location_text": joined(*[object_or_text(x, f"$.location.{k}") for k in ("city", "state", "country")]), "employment_type_text": text_at(x, "$.type.name"),
        "department_text": text_at(x, "$.department"), "salary_text": text_at(x, "$.salary"), "apply_url": url, "source_url": url, "posted_at": instant_at(x, "$.published_date"),
    }


def _oracle_hcm(x: Column, source: Column, body: Column) -> dict[str, Column]:
    return {
        "external_id": text_at(x, "$.Id"), "title": text_at(x, "$.Title"), "company_name": source, "location_text": text_at(x, "$.PrimaryLocation"), "description_html": text_at(x, "$.ShortDescriptionStr"),
        "employment_type_text": text_at(x, "$.JobType"), "work_mode_text": text_at(x, "$.WorkplaceType"), "department_text": text_at(x, "$.JobFamily"), "posted_at": instant_at(x, "$.PostedDate"),
    }


def _sample(x: Column, source: Column, body: Column) -> dict[str, Column]:
    names = {
        "external_id": "externalId", "requisition_id": "requisitionId", "title": "title", "company_name": "companyName", "location_text": "location", "description_html": "description",
        "employment_type_text": "employmentType", "work_mode_text": "workMode", "department_text": "department", "salary_text": "salary", "apply_url": "applyUrl", "source_url": "sourceUrl",
    }
    return {k: text_at(x, f"$.{v}") for k, v in names.items()} | {"posted_at": instant_at(x, "$.postedAt")}


#: By the names that sources are registered under.
BOARDS = {
    "greenhouse": Board("$.jobs", _greenhouse),
    "lever": Board("$", _lever),
    "ashby": Board("$.jobs", _ashby, lambda x: F.coalesce(flag_at(x, "$.isListed"), F.lit(True))),
    "smartrecruiters": Board("$.content", _smartrecruiters),
    "workable": Board("$.jobs", _workable),
    "breezy": Board("$", _breezy),
    "oracle-hcm": Board("$.items", _oracle_hcm, lists="$.requisitionList"),
    "sample": Board("$.jobs", _sample),
}


def json_path(pointer: str) -> str:
    """A JSON Pointer (RFC 6901), or names with dots, as a JSON path: `/a/0/b~1c` is `$['a'][0]['b/c']`."""
    if not pointer.startswith("/"):
        parts = pointer.split(".")
    else:
        parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    return "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in parts if p)


def coerced_at(item: Column, pointer: str) -> Column:
    """What is at a pointer as text: a scalar, an object's `name`, or the texts of an array's elements with commas."""
    path = json_path(pointer)
    elements = F.transform(F.try_variant_get(item, path, "array<variant>"), lambda x: object_or_text(x, "$"))
    listed = once(F.array_join(F.filter(elements, has_text), ", "), lambda x: F.when(x != "", x))
    return F.coalesce(object_or_text(item, path), listed)


def timed_at(item: Column, pointer: str) -> Column:
    """An instant from text, or from seconds or milliseconds since 1970."""
    told = once(coerced_at(item, pointer), lenient_instant)
    return once(whole_at(item, json_path(pointer)), lambda value: F.when(value > 100_000_000_000, F.timestamp_millis(value)).when(value > 0, F.timestamp_seconds(value)).when(value.isNull(), told))


def configured(items: str | None, pointers: dict[str, str], templates: dict[str, str] | None = None) -> Board:
    """A board that is declared: a pointer to the items (none: the body itself), one for each field, and templates of
    addresses with `{token}` (the source) and `{id}`."""

    def fields(x: Column, source: Column, body: Column) -> dict[str, Column]:
        found = {k: timed_at(x, p) if k in INSTANTS else coerced_at(x, p) for k, p in pointers.items()}
        for k, template in (templates or {}).items():
            filled = F.replace(F.replace(F.lit(template), F.lit("{token}"), source), F.lit("{id}"), found["external_id"])
            found[k] = F.coalesce(found[k], filled) if k in found else filled
        return found

    return Board(json_path(items) if items else "$", fields)


def _array(value: Column, path: str) -> Column:
    """The array at a path; null if something else is there."""
    return F.try_variant_get(value, path, "array<variant>")


def found(value: Column) -> Column:
    """`value`, found once for each row: an array of it is exploded, which neither filters nor projections are moved below."""
    return F.explode(F.array(value))


def with_items(bodies: DataFrame, board: Board, body: str = "body", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """source, the columns `carry`, body as VARIANT and items, which are null if the body can't be read.

    Where postings are in lists, no list in any item can't be read either; no item at all is no posting."""
    held = bodies.select(F.col(source).alias("source"), *carry, found(F.try_parse_json(F.col(body))).alias("body"))
    items = _array(F.col("body"), board.items)
    if board.lists:
        lists = F.filter(F.transform(items, lambda x: _array(x, board.lists)), lambda x: x.isNotNull())
        items = F.when((F.size(items) == 0) | (F.size(lists) > 0), F.flatten(lists))
    return held.select("*", found(items).alias("items"))


def postings(bodies: DataFrame, board: Board, most: int | Column | None = None, body: str = "body", source: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows of source and FIELDS, those of the first `most` items of each body that the board keeps and that have an id,
    and the columns `carry` of the bodies, which may tell `most`, too.

    Fields that the board doesn't tell are null. Bodies that repeat give their postings again; an empty table gives no rows."""
    held = with_items(bodies, board, body, source, carry)
    item = F.col("item")
    made = board.fields(item, F.col("source"), F.col("body"))
    if most is not None:
        items = F.filter("items", lambda x: made_id(board, x) & board.keep(x))
        held = held.select("source", *carry, "body", found(F.slice(items, F.lit(1), F.lit(most) if isinstance(most, int) else most)).alias("items"))
    rows = held.select("source", *carry, "body", F.explode("items").alias("item"))
    kinds = {k: "timestamp" if k in INSTANTS else "string" for k in FIELDS}
    columns = [made.get(k, F.lit(None)).cast(kinds[k]).alias(k) for k in FIELDS]
    rows = rows.select("source", *carry, *columns, F.to_json("item").alias("raw_payload"), board.keep(item).alias("__keep"))
    rows = rows.select("source", *carry, *FIELDS, "raw_payload", found(F.when(F.col("__keep"), F.col("external_id"))).alias("__id"))
    return rows.where("__id is not null").drop("__id")


def made_id(board: Board, item: Column) -> Column:
    """Whether an item has an id."""
    return board.fields(item, F.lit(""), item)["external_id"].isNotNull()


def unreadable(bodies: DataFrame, board: Board, body: str = "body", source: str = "source") -> DataFrame:
    """The sources of bodies that are no JSON or don't have the board's array, and why."""
    why = F.when(F.col("body").isNull(), "not JSON").otherwise("no array of postings")
    return with_items(bodies, board, body, source).where("items is null").select("source", why.alias("problem"))
