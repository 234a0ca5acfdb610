"""Micro-batch upkeep of the snapshot: every batch of landed listings refreshes the companies it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.overlays import refresh_snapshot
from .state import BUCKETS, KEEP_MS, StateStore

TABLE = "snapshot"


def refresh_stream(listings: DataFrame, path: str, company: str, keys: list[str], checkpoint: str, trigger: dict | None = None, buckets: int = BUCKETS, keep_ms: int = KEEP_MS):
    """Start a query that keeps the snapshot in the store under `path` current.

    The snapshot lies in buckets of the company. A batch reads and rewrites only the buckets of its companies and makes them
    valid in one step (state.py), so readers never see half a batch and a repeated batch writes the same rows again.
    """

    def apply(batch: DataFrame, _epoch: int) -> None:
        rows = batch.persist()
        store = StateStore(batch.sparkSession, path, buckets, keep_ms)
        touched = store.touched(rows, company)
        if touched:
            old = store.read(TABLE, touched)
            new = refresh_snapshot(rows.limit(0) if old is None else old, rows, rows, company, keys)
            store.commit({TABLE: (new, company, touched)})
        rows.unpersist()

    return listings.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The valid snapshot, None before the first batch."""
    return StateStore(spark, path).read(TABLE)


def counts(df: DataFrame, company: str) -> DataFrame:
    return df.groupBy(company).agg(F.count("*").alias("jobs"))
