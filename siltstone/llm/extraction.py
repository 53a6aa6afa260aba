"""Main text of web pages, with boilerplate found by a suffix array over the pages of a host.

A page is cut into blocks, and the text of all its blocks is its token stream. What lies in a run of `LEAST` tokens or more
that `PAGES` distinct streams of a host hold is boilerplate and is cut out, token by token; unique runs stay. (A run is made
of windows of `LEAST` tokens that stand in at least the same streams, so these windows cover just what the longest runs
cover, and suffixes need be sorted by their first `LEAST` tokens only.)

Pages are dealt by their streams into groups of about `GROUP_BYTES` of html of a host. A group's streams are sorted by their
suffixes. On hosts of several groups each group hands on, for each distinct beginning of a suffix, its number and how many
streams hold it; a host's numbers are dealt into parts, summed there over all groups, and each group gets back its own numbers
that are repeated. So the result is that of the host's whole suffix array, while neither a task nor what it sends grows with a host.

Markup is evidence beside the runs: what is in menus, footers, forms, adverts or comments goes even where it is unique; in an
article, runs that would take more than `COVER` of it are those of a copied article, not boilerplate, and it stays whole.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import attach, cut, table
from siltstone.llm.tokens import slices

#: The html of a host that makes one group on average, and the groups whose numbers are summed in one part.
GROUP_BYTES, PART_GROUPS = 4 << 20, 8
#: Tokens of a run, distinct pages that must hold it (all, on a host of two), and the share of an article from which repeated runs are a copy of it.
LEAST, PAGES, COVER = 10, 3, 0.5
KEEP, OPEN, DROP, NAMED = 0, 1, 2, 3
#: Bits of a window's number on hosts of up to so many pages; each doubling takes one more, so that numbers meet by chance as rarely.
BITS, BITS_PAGES = 40, 4096
#: `stream` tells the token streams apart, `body` is the blocks, packed; `copies` are the pages of a stream that came in one batch.
PARSED = "host string, groups int, bits int, stream bigint, body binary, copies array<struct<page_id:bigint,url:string>>"
COUNTED = "host string, group int, part int, streams bigint, runs binary"
TEXTS = "copies array<struct<page_id:bigint,url:string>>, text string"

#: A tag with its attributes, a value in quotes only after an equals sign. Nothing is tried twice, so time follows length.
_TAG = re.compile(r"<(/?)([A-Za-z][^\t\n\f\r />]*+)((?:[^>=]++|=[\t\n\f\r ]*+(?:\"[^\"]*+\"|'[^']*+'|[^\t\n\f\r >]*+))*+)>")
_ATTRIBUTE = re.compile(r"([^\t\n\f\r =/]++)(?:[\t\n\f\r ]*+=[\t\n\f\r ]*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\t\n\f\r ]*+)))?")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold isn't markup; none of it is text of the page.
_RAW = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in "script style title textarea iframe xmp noembed noframes".split()}
_CHROME = frozenset("nav footer aside form menu dialog button label fieldset search select datalist template".split())
_MAIN = frozenset("article main".split())
_DRAWN = frozenset("title desc metadata".split())
#: An element that ends when one of the same row begins, unless a list or table (the last of its row) began in between.
_SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dd": (("dd", "dt"), ("dl",)), "dt": (("dd", "dt"), ("dl",)), "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)),
    "tr": (("tr",), ("table",)), "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
_CELLS = ("td", "th", "caption")
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: Words of classes, ids and roles of what is around an article, and words that say where or how such a thing is.
_CHROME_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget widgets ad ads advert adverts advertisement advertising sponsored sponsor promo promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments commentlist disqus respond replies popup modal search searchbox pagination pager toolbar complementary contentinfo skiplink".split()
)
_BESIDE_WORDS = frozenset(
    "left right top bottom main site page global primary secondary container wrapper wrap box list item items block section area link links bar inner outer header head body content icon icons button buttons btn form field input post posts entry article articles blog text unit slot zone group row col column panel module holder large small mobile desktop wide sticky fixed first last".split()
)


def _is_chrome(name: str) -> bool:
    """Whether a name says that it is of the page, not of its subject: all its words do, or say where that is. So
    `social-share` and `main-nav` are, `share-price`, `related-work` and `comments-about-law` aren't."""
    words = [w for w in re.split(r"[_\-]+", name.lower()) if w]
    if "".join(words) in _CHROME_WORDS:
        return True
    return any(w in _CHROME_WORDS for w in words) and all(w in _CHROME_WORDS or w in _BESIDE_WORDS or w.isdigit() for w in words)


_HEAD_NAME = re.compile(r"(?:^|[_\-])(?:header|masthead|site-header|topbar)(?:$|[_\-])", re.I)
_MAIN_NAME = re.compile(r"(?:^|[_\-])(?:article|article-body|articlebody|post-content|entry-content|main-content)(?:$|[_\-])", re.I)
#: Names of layouts, such as has-sidebar, which say what is elsewhere on the page.
_LAYOUT = re.compile(r"^(?:has|with|no|without|is)-|-(?:with|has|no|without)-", re.I)


def _kind(tag: str, attributes: str, inside: int, drawing: bool) -> int:
    """What an element makes of its content, `inside` being what its parent makes of it. What a name alone drops (NAMED)
    may hold the page's main element; an article goes by a name only if that is the whole of it."""
    if inside == DROP or tag in _CHROME or drawing and tag in _DRAWN:
        return DROP
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    if given and ("hidden" in given or "style" in given and re.search(r"display\s*+:\s*+none", given["style"], re.I)):
        return DROP
    if tag == "main":
        return KEEP
    if inside == NAMED:
        return NAMED
    names = [x for k in ("class", "id", "role", "aria-label") if k in given for x in given[k].split() if not _LAYOUT.search(x)]
    if tag in ("html", "body"):
        names = []
    if any(x.lower() in _CHROME_WORDS if tag == "article" else _is_chrome(x) for x in names):
        return NAMED
    if inside != KEEP and tag == "header":
        return DROP
    if inside != KEEP and any(map(_HEAD_NAME.search, names)):
        return NAMED
    return KEEP if inside == KEEP or tag in _MAIN or any(map(_MAIN_NAME.search, names)) else OPEN


class _Stack:
    """The open elements, for each tag where they are, and where blocks are."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.kinds: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.outer: list[int] = []

    def kind(self) -> int:
        return self.kinds[-1] if self.kinds else OPEN

    def last(self, *tags: str) -> int:
        best = -1
        for tag in tags:
            if (places := self.at.get(tag)) and places[-1] > best:
                best = places[-1]
        return best

    def push(self, tag: str, kind: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in _BLOCKS:
            self.outer.append(len(self.tags))
        self.tags.append(tag)
        self.kinds.append(kind)

    def close(self, place: int) -> None:
        while len(self.tags) > place:
            self.at[self.tags.pop()].pop()
            self.kinds.pop()
        while self.outer and self.outer[-1] >= place:
            self.outer.pop()


def blocks(page: str) -> list[tuple[int, str]]:
    """The blocks of a page in order: KEEP, OPEN or DROP, and the text in single spaces. Empty blocks are left out.

    Elements end where HTML lets their end tag be left out. A tag that never ends takes the rest of the page with it,
    as in browsers; a quote that never ends is part of a value without quotes."""
    found: list[tuple[int, str]] = []
    held: list[str] = []
    stack = _Stack()
    at, size = 0, len(page)

    def end() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                found.append((min(stack.kind(), DROP), text))
            held.clear()

    def say(text: str) -> None:
        held.append(entities.unescape(text) if "&" in text else text)

    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            say(page[at:])
            break
        if sign > at:
            say(page[at:sign])
        match = _TAG.match(page, sign)
        if match is None:
            after = page[sign + 1 : sign + 3]
            if after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha():
                break
            if after[:1] in ("!", "?", "/") and after:
                mark = "-->" if page.startswith("<!--", sign) else ">"
                close = page.find(mark, sign + 2)
                at = close + len(mark) if close >= 0 else size
            else:
                held.append("<")
                at = sign + 1
            continue
        at = match.end()
        tag = match[2].lower()
        if tag == "br":
            held.append(" ")
            continue
        if match[1]:
            place = stack.last(tag)
            if tag in _BLOCKS:
                end()
            # What ends inside a block or a cell doesn't end what is around it.
            inner = stack.last(*_CELLS) if tag in _BLOCKS else stack.outer[-1] if stack.outer else -1
            if place >= 0 and (tag in _TABLE or place > inner):
                if stack.kind() != (stack.kinds[place - 1] if place else OPEN):
                    end()
                stack.close(place)
            continue
        empty = match[3].endswith("/")
        if tag in _RAW and not (tag in _DRAWN and stack.last("svg") >= 0):
            close = None if empty else _RAW[tag].search(page, at)
            at = at if empty else close.start() if close else size
            continue
        if tag in _BLOCKS:
            end()
            if (place := stack.last("p")) > stack.last("button", "table", *_CELLS):
                stack.close(place)
            if tag in _SIBLINGS:
                same, around = _SIBLINGS[tag]
                if (place := stack.last(*same)) > stack.last(*around):
                    stack.close(place)
        if tag not in _VOID and not empty:
            kind = _kind(tag, match[3], stack.kind(), stack.last("svg") >= 0)
            if kind != stack.kind():
                end()
            stack.push(tag, kind)
    end()
    return found


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _packed(found: list[tuple[int, str]]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress("\n".join(f"{s}{t}" for s, t in found).encode("utf-8"))


def _unpacked(body: bytes) -> list[tuple[int, list[str]]]:
    import zstandard

    lines = zstandard.ZstdDecompressor().decompress(body).decode("utf-8")
    return [(int(line[0]), line[1:].split()) for line in lines.split("\n")] if lines else []


def suffix_order(tokens: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of `tokens` sorted by their first `least` tokens, by doubling, and for each place its class:
    places of one class begin with the same `least` tokens (fewer at the end)."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    length = 1
    order = np.argsort(rank, kind="stable")
    while length < least:
        step = min(length, least - length)
        further = np.zeros_like(rank)
        further[:-step] = rank[step:]
        both = rank * (len(rank) + 1) + further
        order = np.argsort(both)
        both = both[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[1], 1 + np.cumsum(both[1:] != both[:-1])])
        length += step
    return order, rank


@dataclass
class Streams:
    """Token streams as one row of tokens: `tokens` by number, negative where a stream ends, `owner` the stream of each
    place, and a number for each word. No window reaches over the end of a stream."""

    words: np.ndarray
    tokens: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, streams: list[list[str]]) -> Streams:
        sizes = np.array([len(s) + 1 for s in streams], np.int64)
        ends = np.cumsum(sizes) - 1
        flat = np.empty(int(sizes.sum()), object)
        if len(streams):
            flat[:] = [t for s in streams for t in (*s, "")]
        tokens, words = pd.factorize(flat)
        tokens = tokens.astype(np.int64)
        tokens[ends] = -1 - np.arange(len(streams))
        return cls(pd.util.hash_array(words.astype(object), categorize=False) if len(words) else np.zeros(1, np.uint64), tokens, np.repeat(np.arange(len(streams)), sizes))

    def windows(self, least: int) -> np.ndarray:
        """Whether a window of `least` tokens begins at each place."""
        ends = np.flatnonzero(self.tokens < 0)
        at = np.arange(len(self.tokens))
        return at + least <= ends[np.searchsorted(ends, at)]

    def numbers(self, least: int, bits: int) -> np.ndarray:
        """For each place the upper `bits` of a number of its window's words, which is the same wherever they stand."""
        words = self.words[np.maximum(self.tokens, 0)]
        factors = np.random.default_rng(29).integers(0, 1 << 64, least, np.uint64) | np.uint64(1)
        total = np.zeros(len(words), np.uint64)
        for j in range(min(least, len(words))):
            total[: len(words) - j] += words[j:] * factors[j]
        return total >> np.uint64(64 - bits)

    def counted(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place the class of its window, from the sorted suffixes, and for each class the streams that hold it."""
        order, rank = suffix_order(self.tokens, least)
        pairs = np.unique(rank[order] * len(rank) + self.owner[order])
        return rank, np.bincount(pairs // len(rank), minlength=rank.max(initial=0) + 1)

    def inside(self, starts: np.ndarray, least: int) -> np.ndarray:
        """Whether one of the windows that begin at `starts` covers each token."""
        change = np.zeros(len(self.tokens) + least + 1, np.int64)
        change[: len(self.tokens)] += starts
        change[least : len(self.tokens) + least] -= starts
        return np.cumsum(change)[: len(self.tokens)] > 0


def pack_runs(runs: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers and a small count of each: steps, byte by byte, compress best."""
    import zstandard

    steps = np.diff(runs, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(steps.tobytes() + counts.astype(np.uint8).tobytes())


def unpack_runs(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = len(raw) // 9
    return np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64), raw[8 * n :].astype(np.int64)


def needed(streams: int, pages: int) -> int:
    """The distinct streams that must hold a run on a host that has `streams`."""
    return max(2, min(pages, streams))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    page = pa.struct([("page_id", pa.int64()), ("url", pa.string())])
    names = ["host", "groups", "bits", "stream", "body", "copies"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(page)]
    for batch in batches:
        for begin, texts in slices(batch.column("html"), 16 << 20):
            seen: dict[tuple[str, bytes], list] = {}
            for row in batch.slice(begin, len(texts)).to_pylist():
                body = _packed(found := blocks(row["html"]))
                own = seen.setdefault((row["host"], body), [row["host"], row["groups"], row["bits"], _number(" ".join(t for _, t in found)), body, []])
                own[5].append({"page_id": row["page_id"], "url": row["url"]})
            columns = zip(*seen.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


class Group:
    """The pages of a group: their blocks, and their distinct streams as one row of tokens."""

    def __init__(self, rows: pa.Table, least: int) -> None:
        self.pages = [_unpacked(body) for body in rows["body"].to_pylist()]
        self.least, self.at = least, []
        streams: dict[int, int] = {}
        distinct = []
        for page, stream in zip(self.pages, rows["stream"].to_pylist(), strict=True):
            if stream not in streams:
                streams[stream] = len(distinct)
                distinct.append([t for _, tokens in page for t in tokens])
            self.at.append(streams[stream])
        self.streams = len(distinct)
        self.flat = Streams.of(distinct)
        self.whole = self.flat.windows(least)

    def runs(self, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The sorted numbers of its windows and the streams that hold each, counted up to `most`."""
        rank, count = self.flat.counted(self.least)
        place = np.flatnonzero(self.whole)
        classes, first = np.unique(rank[place], return_index=True)
        numbers, which = np.unique(self.flat.numbers(self.least, bits)[place[first]], return_inverse=True)
        return numbers, np.minimum(np.bincount(which, count[classes], len(numbers)).astype(np.int64), most)

    def texts(self, starts: np.ndarray, cover: float) -> list[str]:
        """Each page's text without what the windows at `starts` cover."""
        inside = np.split(self.flat.inside(starts & self.whole, self.least), np.flatnonzero(self.flat.tokens < 0) + 1)
        return [uncovered(page, inside[at][:-1], cover) for page, at in zip(self.pages, self.at, strict=True)]


def count_runs(rows: pa.Table, least: int, pages: int) -> pa.Table:
    """What a group of a host of several groups hands on: for each part of the numbers those that its windows have."""
    host, group, groups, bits = (rows[k][0].as_py() for k in ("host", "group", "groups", "bits"))
    parts = -(-groups // PART_GROUPS) if groups > 1 else 0
    packed, streams = [], 0
    if parts:
        held = Group(rows, least)
        numbers, counts = held.runs(bits, max(2, pages))
        streams = held.streams
        part = numbers % np.uint64(parts)
        packed = [pack_runs(numbers[part == k], counts[part == k]) for k in range(parts)]
    columns = [[host] * parts, [group] * parts, list(range(parts)), [streams] * parts, packed]
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()], strict=True)], names=["host", "group", "part", "streams", "runs"])


def sum_runs(rows: pa.Table, pages: int) -> pa.Table:
    """For each group its numbers that enough streams of the host hold, among those of one part."""
    own = [unpack_runs(packed) for packed in rows["runs"].to_pylist()]
    numbers, which = np.unique(np.concatenate([n for n, _ in own]), return_inverse=True)
    total = np.bincount(which, np.concatenate([c for _, c in own]), len(numbers))
    often = numbers[total >= needed(sum(rows["streams"].to_pylist()), pages)]
    held = [n[np.isin(n, often)] for n, _ in own]
    return pa.table([rows["host"], rows["group"], pa.array([pack_runs(n, np.ones(len(n))) for n in held], pa.binary())], names=["host", "group", "runs"])


def judge(rows: pa.Table, often: pa.Table, least: int, pages: int, cover: float) -> pa.Table:
    """The texts of a group's pages, by its own suffixes or, on a host of several groups, by the numbers that are repeated."""
    if not len(rows):
        return pa.table([pa.array([], pa.list_(pa.struct([("page_id", pa.int64()), ("url", pa.string())]))), pa.array([], pa.string())], names=["copies", "text"])
    group = Group(rows, least)
    if rows["groups"][0].as_py() > 1:
        runs = np.concatenate([np.zeros(0, np.uint64), *(unpack_runs(packed)[0] for packed in often["runs"].to_pylist())])
        starts = np.isin(group.flat.numbers(least, rows["bits"][0].as_py()), runs)
    else:
        rank, count = group.flat.counted(least)
        starts = count[rank] >= needed(group.streams, pages)
    return pa.table([rows["copies"], pa.array(group.texts(starts, cover), pa.string())], names=["copies", "text"])


def uncovered(blocks: list[tuple[int, list[str]]], covered: np.ndarray, cover: float) -> str:
    """The text of a page without the tokens that are covered and what markup drops, a block to a line."""
    gone = np.split(covered, np.cumsum([len(t) for _, t in blocks])[:-1]) if blocks else []
    main = [g for (s, _), g in zip(blocks, gone, strict=True) if s == KEEP]
    copy = bool(main) and np.concatenate(main).mean() > cover
    lines = []
    for (s, tokens), g in zip(blocks, gone, strict=True):
        if s != DROP and (left := tokens if s == KEEP and copy else [t for t, x in zip(tokens, g, strict=True) if not x]):
            lines.append(" ".join(left))
    return "\n".join(lines)


def extract(pages: DataFrame, least: int = LEAST, least_pages: int = PAGES, cover: float = COVER, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """For each row of `pages` its page_id, url and text: what stays of the blocks in page order, one to a line.

    A null or empty html gives an empty text; a null url is a host of its own. Pages of the same token stream count as
    one, so that copies of a page are no evidence; rows that repeat are all kept. An empty table gives no rows; other
    columns are ignored. How pages are dealt into groups and parts changes nothing."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?([^/:?#]*+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    groups, doublings = F.ceil(F.sum(F.octet_length("html")) / group_bytes).cast("int"), F.ceil(F.log2(F.count("*") / BITS_PAGES)).cast("int")
    sizes = rows.groupBy("host").agg(groups.alias("groups"), F.greatest(F.lit(BITS), F.least(F.lit(64), BITS + doublings)).alias("bits"))
    large = cut(sizes.where("groups > 1"))
    rows = attach(rows, "host", large, large.count(), F.col("page_id"))
    rows = rows.withColumns({"groups": F.coalesce("groups", F.lit(1)), "bits": F.coalesce("bits", F.lit(BITS))})
    parsed = rows.select("page_id", "url", "host", "groups", "bits", "html").mapInArrow(_parse, PARSED)
    # Both uses of the groups read one exchange.
    dealt = parsed.withColumn("group", F.pmod(F.xxhash64(F.lit(3), "stream"), F.col("groups")).cast("int")).groupBy("host", "group")

    def counted(group: pa.Table) -> pa.Table:
        return count_runs(group, least, least_pages)

    def summed(part: pa.Table) -> pa.Table:
        return sum_runs(part, least_pages)

    def judged(group: pa.Table, often: pa.Table) -> pa.Table:
        return judge(group, often, least, least_pages, cover)

    often = dealt.applyInArrow(counted, COUNTED).groupBy("host", "part").applyInArrow(summed, "host string, group int, runs binary")
    texts = dealt.cogroup(often.groupBy("host", "group")).applyInArrow(judged, TEXTS)
    return texts.select(F.explode("copies").alias("page"), "text").select("page.page_id", "page.url", "text")


def op8_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op8_extraction": op8_extraction}
ORACLE_SQL: dict[str, str] = {}
