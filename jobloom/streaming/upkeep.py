"""A crawl run's results into all state tables at once: snapshot, search cache, known negatives and tracking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.overlays import pending_reviews, refresh_snapshot, update_negatives, upsert_cache
from .state import StateStore

SNAPSHOT, CACHE, NEGATIVES, TRACKING = "snapshot", "search_cache", "negatives", "tracking"


def apply_run(store: StateStore, listings: DataFrame, checked: DataFrame, company: str, keys: list[str], run_date: str) -> list[int]:
    """Refresh the buckets of the companies that a run has checked, in one commit; returns those buckets.

    listings (company, other keys, job_url, seq, ...) are the jobs found; checked (company, last_scraped, seq, not_found, ...) has a row for
    each company that was looked at, jobs or not. Of a checked company the snapshot keeps what the run found, the cache its latest
    check, the negatives whether it has a board, and tracking gains a review for every job that is new to it. What other buckets hold is neither read nor
    written, and readers see all four tables before the run or all four after it.
    """
    touched = store.touched(checked, company)
    if not touched:
        return []
    manifest = store.manifest()

    def old(table: str, like: DataFrame) -> DataFrame:
        found = store.read(table, touched, manifest)
        return like.where(F.lit(False)) if found is None else found

    who = checked.select(company).distinct()
    own = listings.join(who, company, "left_semi")
    snapshot = refresh_snapshot(old(SNAPSHOT, listings), own, who, company, keys)
    cache_row = checked.drop("not_found")
    cache = upsert_cache(old(CACHE, cache_row), cache_row, [company])
    negative = checked.select(company)
    negatives = update_negatives(old(NEGATIVES, negative), checked.select(company, "not_found").distinct(), company)
    empty = listings.select(*keys, "job_url", *[F.lit("").alias(c) for c in ("status", "review_date", "application_date", "next_action_date")])
    tracking = old(TRACKING, empty)
    reviews = pending_reviews(snapshot, tracking, keys, run_date)
    tracked = tracking.unionByName(reviews.select(*tracking.columns))
    store.commit({name: (rows, company, touched) for name, rows in ((SNAPSHOT, snapshot), (CACHE, cache), (NEGATIVES, negatives), (TRACKING, tracked))})
    return touched
