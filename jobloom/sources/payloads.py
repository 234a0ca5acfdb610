"""Landed listing payloads of three shapes as rows, page sizes and missing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank

PATHS = {"jobs": "$.jobs", "postings": "$.jobPostings", "embedded": "$.eagerLoadRefineSearch.data.jobs"}


def listing_rows(pages: DataFrame, kind: str = "kind", payload: str = "payload") -> DataFrame:
    """One row per listed job: the page's other columns and `job` (VARIANT); elements that are not objects are dropped."""
    v = F.try_parse_json(payload)
    items = F.lit(None).cast("array<variant>")
    for name, path in PATHS.items():
        items = F.when(F.col(kind) == name, F.try_variant_get(v, path, "array<variant>")).otherwise(items)
    rest = [c for c in pages.columns if c != payload]
    return pages.select(*rest, F.explode(items).alias("job")).where(F.schema_of_variant("job").startswith("OBJECT"))


def page_facts(pages: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds n_rows, total_hits (else n_rows) and page_size (a number or its text, else n_rows, else 10)."""
    v = F.try_parse_json(payload)
    rows = F.coalesce(*[F.size(F.try_variant_get(v, p, "array<variant>")) for p in PATHS.values()], F.lit(0))
    total = F.coalesce(F.try_variant_get(v, "$.total", "int"), F.try_variant_get(v, "$.eagerLoadRefineSearch.totalHits", "int"), rows)
    size = F.coalesce(F.try_variant_get(v, "$.siteConfig.data.size", "int"), F.nullif(rows, F.lit(0)), F.lit(10))
    return pages.withColumn("n_rows", rows).withColumn("total_hits", total).withColumn("page_size", size)


def missing_pages(pages: DataFrame, board: str, offset: str, total: str, size: str) -> DataFrame:
    """(board, offset) of pages below the total that have not landed."""
    wanted = pages.groupBy(board).agg(F.max(total).alias("t"), F.min(size).alias("s"))
    wanted = wanted.select(board, F.explode(F.when(F.col("t") > 0, F.sequence(F.lit(0).cast("long"), F.col("t") - 1, F.col("s"))).otherwise(F.array().cast("array<bigint>"))).alias(offset))
    return wanted.join(pages.select(board, F.col(offset).cast("long").alias(offset)), [board, offset], "left_anti")


TILES_PER_PAGE = 12  # a listing of tiles that shows none


def tile_facts(pages: DataFrame, tiles: str, hits: str) -> DataFrame:
    """Adds n_rows, total_hits and page_size of tile listings: tiles (array) found on the page, hits (the count it states, may be null)."""
    rows = F.coalesce(F.size(tiles), F.lit(0))
    rows = F.when(rows < 0, 0).otherwise(rows)
    return pages.withColumn("n_rows", rows).withColumn("total_hits", F.coalesce(F.col(hits), rows)).withColumn("page_size", F.coalesce(F.nullif(rows, F.lit(0)), F.lit(TILES_PER_PAGE)))


def short_page_gaps(pages: DataFrame, board: str, offset: str, rows: str, size: int = 20) -> DataFrame:
    """Paging by offset that ends at the first short page: (board, offset, state) of pages that are missing or beyond the end.

    pages (board, offset, rows), offsets being multiples of size. A page with fewer than `size` rows is the last, so all pages up to it are
    expected, and pages after it are `beyond`. As long as every landed page is full, the page after the last one is expected too.
    A board's pages are counted where they land; nothing but its last offset is spread out again.
    """
    own = pages.select(board, F.col(offset).cast("long").alias(offset), F.coalesce(F.col(rows), F.lit(0)).alias("__rows"))
    ends = own.groupBy(board).agg(F.min(F.when(F.col("__rows") < size, F.col(offset))).alias("__short"), F.max(offset).alias("__top"))
    last = F.coalesce("__short", F.col("__top") + size)
    wanted = ends.select(board, F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(size).cast("long"))).alias(offset))
    missing = wanted.join(own.select(board, offset), [board, offset], "left_anti").withColumn("state", F.lit("missing"))
    beyond = own.select(board, offset).distinct().join(ends.where("__short is not null"), board).where(F.col(offset) > F.col("__short"))
    return missing.unionByName(beyond.select(board, offset, F.lit("beyond").alias("state")))


def detail_record(identifier, bullets, path, title, detail_title, url, detail_url):
    """struct(job_id, title, url): id from the identifier, the first bullet or the path's last segment."""
    last = F.element_at(F.split(F.regexp_replace(blank(path), "/+$", ""), "/"), -1)
    pick = lambda *cs: F.coalesce(*[F.nullif(F.trim(blank(c)), F.lit("")) for c in cs], F.lit(""))
    return F.struct(pick(identifier, F.get(bullets, F.lit(0)), last).alias("job_id"), pick(detail_title, title).alias("title"), pick(detail_url, url).alias("url"))
