"""URL scalars as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import SPACE, has_text

#: Parameters that follow a visitor and name no page.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gh_src", "source", "src", "ref", "referrer", "referral", "fbclid", "gclid", "msclkid", "dclid", "igshid", "mc_cid", "mc_eid", "campaign", "trk", "trackingid", "tracking_id", "lever_source", "recruiter", "channel", "medium"]


def normalize_url(url: Column, most: int = 500) -> Column:
    """The page that a URL names: no fragment, scheme and host in lower case (all of it, where no scheme is told), no
    trailing slash, no tracking or blank parameters, the others decoded, with lower-case names, sorted. Null or blank gives the empty text."""
    plain = F.split(F.regexp_replace(url, f"^{SPACE}+|{SPACE}+$", ""), "#", 2)[0]
    parts = F.split(plain, r"\?", 2)
    base = F.regexp_replace(parts[0], "(.)/$", "$1")
    origin = F.regexp_extract(base, "^[^/?]*://[^/]*", 0)
    base = F.when(origin == "", F.lower(base)).otherwise(F.concat(F.lower(origin), F.substring(base, F.length(origin) + 1, F.length(base))))
    pairs = F.transform(F.split(F.coalesce(F.get(parts, 1), F.lit("")), "&"), lambda p: F.struct(F.lower(F.split(p, "=", 2)[0]).alias("name"), F.coalesce(F.get(F.split(p, "=", 2), 1), F.lit("")).alias("value")))
    kept = F.filter(pairs, lambda p: (p["name"] != "") & has_text(p["value"]) & ~p["name"].isin(TRACKING))
    query = F.array_join(F.array_sort(F.transform(kept, lambda p: F.concat(p["name"], F.lit("="), F.coalesce(F.try_url_decode(p["value"]), p["value"])))), "&")
    whole = F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))
    return F.coalesce(F.substring(whole, 1, most), F.lit(""))


def host(url: Column) -> Column:
    """The host in lower case, without user or port; null where there is none."""
    found = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def host_suffixes(name: Column) -> Column:
    """A host name and all names above it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


#: Hosts that no posting is at.
RESERVED_HOSTS = ["localhost", "example.com", "example.org", "example.net"]
RESERVED_SUFFIXES = [".example", ".invalid", ".test", ".localhost", ".local"]
#: How boards of known services are addressed; the group is the employer's token there.
_TOKEN = "([a-z0-9_-]{2,60})"
BOARD_HOSTS = {
    "GREENHOUSE": rf"(?:(?:boards|job-boards)\.greenhouse\.io/(?:embed/job_board(?:/js)?\?for=)?|boards-api\.greenhouse\.io/v1/boards/){_TOKEN}",
    "LEVER": rf"(?:jobs\.(?:eu\.)?lever\.co/|api\.lever\.co/v0/postings/){_TOKEN}",
    "ASHBY": r"(?:jobs\.ashbyhq\.com/|api\.ashbyhq\.com/posting-api/job-board/)([a-z0-9_.-]{2,60})",
    "JAZZHR": r"([a-z0-9-]{2,60})\.applytojob\.com",
    "ICIMS": r"([a-z0-9-]{2,60})\.icims\.com",
}
_JOB_PATH = "(?i)(job|position|opening|vacanc|requisition|posting)"
_INDIA_PATH = r"(?i)/(?:[a-z]{2}[-_]in|in[-_][a-z]{2}|in|india)(?=/|$|[-_.])"
_ASSET = r"(?i)\.(css|js|png|jpe?g|gif|svg|ico|woff2?|pdf|zip|xml)$"


def _part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def valid_apply_url(url: Column) -> Column:
    """An absolute http address whose host has a dot inside and isn't reserved."""
    host = F.lower(_part(F.trim(url), "HOST"))
    kept = ~host.isin(RESERVED_HOSTS) & ~host.rlike("(" + "|".join(x.replace(".", r"\.") for x in RESERVED_SUFFIXES) + ")$")
    return F.coalesce(F.lower(_part(F.trim(url), "PROTOCOL")).isin("http", "https") & kept & host.rlike(r"^[^.].*\..*[^.]$"), F.lit(False))


def canonical_url(url: Column, most: int = 2048) -> Column:
    """Scheme and host in lower case, the port and the query as they are, no fragment and no slash at the end of the path;
    null if it is no http address or too long."""
    scheme, host, port = F.lower(_part(url, "PROTOCOL")), F.lower(_part(url, "HOST")), F.regexp_extract(_part(url, "AUTHORITY"), r"(:\d+)$", 1)
    path = F.coalesce(_part(url, "PATH"), F.lit(""))
    path = F.when(path == "/", "/").otherwise(F.regexp_replace(path, "/$", ""))
    out = F.concat(scheme, F.lit("://"), host, port, path, F.coalesce(F.concat(F.lit("?"), _part(url, "QUERY")), F.lit("")))
    return F.when(scheme.isin("http", "https") & (F.length(out) <= most), out)


def board_of(text: Column) -> Column:
    """The first address of a known board in a text: a struct of provider and token, null if there is none."""
    found = []
    for provider, pattern in BOARD_HOSTS.items():
        whole = rf"(?i)(?<![a-z0-9.-]){pattern}"
        at, token = F.regexp_instr(text, F.lit(whole)), F.lower(F.regexp_extract(text, whole, 1))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(provider).alias("provider"), token.alias("token"))))
    first = reduce(lambda a, b: F.least(a, b), found)
    return F.when(first.isNotNull(), F.struct(first["provider"].alias("provider"), first["token"].alias("token")))


def is_board(url: Column) -> Column:
    """Whether an address is one of a known board's own."""
    return F.coalesce(url.rlike("(?i)^https?://(?:" + "|".join(BOARD_HOSTS.values()) + ")"), F.lit(False))


def is_job_page(url: Column) -> Column:
    return F.coalesce(_part(url, "PATH").rlike(_JOB_PATH), F.lit(False))


def is_for_india(url: Column) -> Column:
    return F.coalesce(F.lower(_part(url, "HOST")).endswith(".in"), F.lit(False)) | F.coalesce(_part(url, "PATH").rlike(_INDIA_PATH), F.lit(False))


def links_of(html: Column, base: Column) -> Column:
    """The distinct addresses on the page's own host that its links lead to, in their order, without assets and fragments.
    Links are taken as absolute, from the host or from the page's folder."""
    hrefs = F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"'#\\s]+)"), F.lit(1))
    origin = F.concat(_part(base, "PROTOCOL"), F.lit("://"), _part(base, "AUTHORITY"))
    folder = F.concat(origin, F.coalesce(F.nullif(F.regexp_replace(_part(base, "PATH"), "[^/]*$", ""), F.lit("")), F.lit("/")))

    def whole(x: Column) -> Column:
        return F.when(x.rlike("^(?i)https?://"), x).when(x.startswith("//"), F.concat(_part(base, "PROTOCOL"), F.lit(":"), x)).when(x.startswith("/"), F.concat(origin, x)).when(~x.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.concat(folder, x))

    own = F.filter(F.transform(hrefs, whole), lambda x: x.isNotNull() & x.startswith(F.concat(origin, F.lit("/"))) & ~F.regexp_replace(x, r"\?.*$", "").rlike(_ASSET))
    return F.array_distinct(own)


def board_tokens(host: Column) -> Column:
    """What a board of a host's owner may be called: its first label that says something, with and without hyphens."""
    said = F.filter(F.split(F.lower(host), r"\."), lambda x: ~x.isin("www", "jobs", "careers", "career", "boards", "com", "org", "net", "io", "in", "co"))
    return F.when(F.size(said) > 0, F.array_distinct(F.array(said[0], F.replace(said[0], F.lit("-"), F.lit("")))))
