"""Reports as tables: one row per section and entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .overlays import tracked_in_snapshot


def tracking_report(tracking: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """(section, n): tracked jobs by status, those in the snapshot and those missing from it."""
    found, missing = tracked_in_snapshot(tracking, snapshot, keys)
    size = lambda df, name: df.agg(F.lit(name).alias("section"), F.count("*").alias("n")).select("section", "n")
    by = tracking.groupBy(F.concat(F.lit("status "), "status").alias("section")).agg(F.count("*").alias("n"))
    return by.unionByName(size(found, "tracked")).unionByName(size(missing, "missing"))


def counts_by(df: DataFrame, names: dict) -> DataFrame:
    """One row: the number of rows that meet each condition."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in names.items()])


def section(df: DataFrame, name: str, entry) -> DataFrame:
    """Rows of a report section in long form: (section, entry)."""
    return df.select(F.lit(name).alias("section"), entry.alias("entry"))
