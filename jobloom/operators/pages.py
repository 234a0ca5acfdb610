"""Extraction from landed pages: text, head tags, embedded objects and listing tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.markup import page_text, unescaped, unescaped_json  # noqa: F401
from ..functions.text import blank, clean, first_filled
from ..functions.urls import absolute_url  # noqa: F401

#: Patterns of the address, the graph tags, the JSON-LD scripts and the state object of a page.
CANONICAL = r'(?i)<link\s+rel="canonical"\s+href="([^"]+)"'
GRAPH = r'(?i)<meta\s+name="[^"]*"\s+property="{name}"\s+content="([^"]*)"'
POSTING = r'(?is)<script\s+type="application/ld\+json">\s*(.*?)\s*</script>'
STATE = r"(?s)phApp\.ddo\s*=\s*(\{.*?\});\s*phApp\."


def canonical_url(page) -> Column:
    return clean(unescaped(F.regexp_extract(blank(page), CANONICAL, 1)))


def open_graph(page, name: str) -> Column:
    return clean(unescaped(F.regexp_extract(blank(page), GRAPH.format(name=name.replace(":", "\\:")), 1)))


def job_posting(page) -> Column:
    """The first JSON-LD object of type JobPosting as VARIANT; broken scripts are passed over."""
    scripts = F.regexp_extract_all(blank(page), F.lit(POSTING), F.lit(1))
    parsed = F.transform(scripts, lambda s: F.try_parse_json(s))
    return F.get(F.filter(parsed, lambda v: F.try_variant_get(v, "$['@type']", "string") == "JobPosting"), F.lit(0))


def state_object(page) -> Column:
    """The embedded page state as VARIANT; NULL if it is missing or broken."""
    return F.try_parse_json(F.regexp_extract(blank(page), STATE, 1))


def description(posting: Column, state: Column, text, title: str, ends: tuple, graph) -> Column:
    """First of: JSON-LD description, four state keys, the text between title and an end marker, Open Graph."""
    from_state = [F.try_variant_get(state, f"$.jobDetail.data.job.{k}", "string") for k in ("description", "jobDescription", "ml_Description", "descriptionTeaser")]
    start = F.locate(title, blank(text))
    stops = [F.instr(F.substring(blank(text), start + F.length(F.lit(title)), F.length(blank(text))), e) for e in ends]
    cut = F.array_min(F.filter(F.array(*stops), lambda x: x > 0))
    body = F.when((start > 0) & cut.isNotNull(), F.substring(blank(text), start + F.length(F.lit(title)), cut - 1)).otherwise("")
    return first_filled(*[clean(c) for c in (F.try_variant_get(posting, "$.description", "string"), *from_state, body, graph)])


TILE = r'(?is)<div class="tile">(.*?)</div>'


def tiles(page) -> Column:
    """array<struct<title, link, job_id, place, work_type>> of listing tiles; those without title or link are dropped."""
    cards = F.regexp_extract_all(blank(page), F.lit(TILE), F.lit(1))
    field = lambda card, name: clean(F.regexp_extract(card, rf'(?is)<span class="{name}">(.*?)</span>', 1))
    rows = F.transform(cards, lambda c: F.struct(clean(F.regexp_extract(c, r"(?is)<a[^>]*>(.*?)</a>", 1)).alias("title"), F.regexp_extract(c, r'(?i)<a[^>]*href="([^"]*)"', 1).alias("link"), field(c, "jobId").alias("job_id"), first_filled(field(c, "location"), field(c, "country")).alias("place"), field(c, "workType").alias("work_type")))
    return F.filter(rows, lambda r: (r["title"] != "") & (r["link"] != ""))
