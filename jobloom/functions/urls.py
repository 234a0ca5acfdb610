"""Board and posting addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, clean, column, slug


def quoted(c) -> Column:
    """Percent-encoding with %20 for a space."""
    return F.replace(F.url_encode(column(c)), F.lit("+"), F.lit("%20"))


def host(url) -> Column:
    return F.lower(F.regexp_extract(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def listing_api_url(board_url, tenant, site) -> Column:
    """Listing endpoint of a tenant's site, on the board's host or the default one."""
    found = F.regexp_extract(blank(board_url), "^https://([^/]+)/", 1)
    where = F.when(found != "", found).otherwise(F.concat(column(tenant), F.lit(".wd1.myworkdayjobs.com")))
    return F.concat(F.lit("https://"), where, F.lit("/wday/cxs/"), quoted(tenant), F.lit("/"), quoted(site), F.lit("/jobs"))


def detail_url(board_url, path) -> Column:
    """Board prefix (cut at its last /jobs) and the posting's path."""
    board, tail = blank(board_url), clean(path)
    prefix = F.when(board.contains("/jobs"), F.regexp_extract(board, r"(?s)^(.*)/jobs", 1)).otherwise(F.regexp_replace(board, "/+$", ""))
    return F.when(tail == "", board).otherwise(F.concat(prefix, F.when(tail.startswith("/"), "").otherwise("/"), tail))


def detail_route(board_url, path) -> Column:
    last = F.element_at(F.split(F.regexp_replace(clean(path), "/+$", ""), "/"), -1)
    return F.when(last == "", blank(board_url)).otherwise(F.concat(F.regexp_replace(blank(board_url), "/+$", ""), F.lit("/details/"), last))


def job_page_url(search_url, job_id, title) -> Column:
    base = F.regexp_extract(blank(search_url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(blank(search_url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)", 2), "/+$", "")
    prefix = F.when(path.contains("/search-results"), F.regexp_extract(path, "(?s)^(.*)/search-results", 1)).otherwise(path)
    return F.concat(base, prefix, F.lit("/job/"), quoted(job_id), F.lit("/"), slug(title, "-"))


def is_board_url(url, suffix: str) -> Column:
    return host(url).endswith(suffix)


def normal_url(url, board_suffix: str) -> Column:
    """Board addresses: scheme and host in lower case, no trailing slash, query or fragment; others: no trailing slash."""
    parts = lambda k: F.regexp_extract(blank(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)", k)
    bare = F.concat(F.lower(parts(1)), F.regexp_replace(parts(2), "/+$", ""))
    return F.when(is_board_url(url, board_suffix), bare).otherwise(F.regexp_replace(blank(url), "/+$", ""))


def query_value(url, key: str) -> Column:
    return F.regexp_extract(blank(url), rf"[?&]{key}=([^&#]*)", 1)


def board_and_job(url, board_suffix: str) -> Column:
    """struct(board, job_id): from the path, else the query's for and token, else id or gh_jid with the host's slug."""
    path = F.regexp_extract(blank(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    direct = host(url).endswith(board_suffix) & path.rlike(r"^/[^/]+/jobs/\d+")
    named = (query_value(url, "for") != "") & query_value(url, "token").rlike(r"^\d+$")
    number = F.when(query_value(url, "id").rlike(r"^\d+$"), query_value(url, "id")).otherwise(query_value(url, "gh_jid"))
    labels = F.filter(F.split(host(url), r"\."), lambda x: (x != "") & (x != "www"))
    owner = F.when(F.get(labels, F.lit(0)).isin("careers", "jobs") & (F.size(labels) > 1), F.get(labels, F.lit(1))).otherwise(F.get(labels, F.lit(0)))
    pair = lambda a, b: F.struct(a.alias("board"), b.alias("job_id"))
    return (
        F.when(direct, pair(F.regexp_extract(path, r"^/([^/]+)/jobs/(\d+)", 1), F.regexp_extract(path, r"^/([^/]+)/jobs/(\d+)", 2)))
        .when(named, pair(query_value(url, "for"), query_value(url, "token")))
        .when(number.rlike(r"^\d+$"), pair(owner, number))
    )


#: Scheme, authority, path, query and fragment of an address, each with its marks.
_ADDRESS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(path: Column) -> Column:
    """A path whose "." and ".." segments are carried out; it begins with a slash."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def absolute_url(base, link) -> Column:
    """A link joined with the address of its page; a link with a scheme stays as it is, a missing one is the page itself."""
    page, to = blank(base), blank(link)
    scheme, authority, path, query, _ = (F.regexp_extract(page, _ADDRESS, k) for k in range(1, 6))
    own, at, way, asks, mark = (F.regexp_extract(to, _ADDRESS, k) for k in range(1, 6))
    folder = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, "[^/]*$", ""), way), "/+", "/")
    found = F.when(way == "", path).when(F.startswith(way, F.lit("/")), _without_dots(way)).otherwise(_without_dots(folder))
    search = F.when((way == "") & (asks == ""), query).otherwise(asks)
    joined = F.concat(scheme, authority, found, search, mark)
    return F.when((page == "") | (own != ""), to).when(to == "", page).when(at != "", F.concat(scheme, to)).otherwise(joined)
