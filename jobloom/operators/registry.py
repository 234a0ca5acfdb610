"""The company registry: statuses, decisions, buckets and the build from six state tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, clean, column, first_filled

PROVIDERS = ("board1", "board2", "other")
#: The status text that means a provider knows no board, and what it becomes.
ABSENT = {"board1": ("Greenhouse board not found", "not_found"), "board2": ("Workday board not configured", "unknown"), "other": ("Phenom board not configured", "unknown")}


def provider_status(status, provider: str) -> Column:
    """Outcome of a board check; anything that is neither absent, a network error nor skipped counts as confirmed."""
    text, outcome = ABSENT[provider]
    s = blank(status)
    return F.when(s == text, outcome).when(s.startswith("Network error"), "needs_retry").when(s.startswith("Skipped"), "unknown").otherwise("confirmed")


def decide(df: DataFrame, has_revisit="has_revisit") -> DataFrame:
    """Adds primary and next_action from the three provider statuses."""
    one, two, other = F.col("board1_status"), F.col("board2_status"), F.col("other_status")
    primary = F.when(one == "confirmed", "board1").when(two == "confirmed", "board2").when(other == "confirmed", "other").when((one == "not_found") & (two == "not_found"), "none").otherwise("unknown")
    action = (
        F.when(F.col("primary") == "board1", "no_action")
        .when(F.col("primary") == "board2", "review_board2")
        .when(F.col("primary") == "other", "review_other")
        .when((one == "not_found") & (two == "unknown"), "check_board2")
        .when(column(has_revisit), "check_other")
        .otherwise("no_action")
    )
    return df.withColumn("primary", primary).withColumn("next_action", action)


def bucket() -> Column:
    one, two, other = F.col("board1_status"), F.col("board2_status"), F.col("other_status")
    return (
        F.when(one == "confirmed", "confirmed_board1")
        .when(two == "confirmed", "confirmed_board2")
        .when(other == "confirmed", "confirmed_other")
        .when((one == "not_found") & (two == "unknown"), "board1_not_found_board2_unchecked")
        .when((one == "not_found") & (two == "not_found"), "neither_confirmed")
        .otherwise("unknown")
    )


def review_queue(registry: DataFrame, action: str, limit: int) -> DataFrame:
    """The first `limit` records with an action, by check date and name in lower case: a report's top-k."""
    return registry.where(F.col("next_action") == action).orderBy("last_overall_check", F.lower("company_name")).limit(limit)


def build(existing: DataFrame, search: DataFrame, negatives: DataFrame, revisits: DataFrame, defaults: DataFrame, hints: DataFrame, assessments: DataFrame, key: str, run_date: str) -> DataFrame:
    """One record for each company in any of the tables.

    existing (key, company_name, *_status, last_overall_check), search (key, company_name, source, status,
    last_scraped), negatives / revisits / defaults (key, company_name), hints (key), assessments (key, provider,
    status, company_name, seq). Assessments are reduced to the last of each provider, then applied in the order
    board1, board2, other; their check date is the record's, or the run date if it has none.

    The tables are one union of rows with a slot for each table, merged by a single grouping: one exchange by key, into which
    each task sends one row for each key that it holds. Rows without a key are no company and are left out. The other tables have
    a row for each key; of several, one is taken.
    """
    slot = lambda df, name: df.select(key, F.struct(F.lit(True).alias("present"), *[c for c in df.columns if c != key]).alias(name))
    tables = {"e": existing, "s": search, "n": negatives, "r": revisits, "d": defaults, "h": hints, "a": assessments}
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [slot(t, name) for name, t in tables.items()])
    last = [F.max_by(F.when(F.col("a.provider") == p, F.col("a")), F.when(F.col("a.provider") == p, F.col("a.seq"))).alias(f"a_{p}") for p in PROVIDERS]
    merged = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.any_value(t, True).alias(t) for t in "esnrd"], *last)
    flat = [F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "esnrd" for c in tables[t].columns if c != key]
    df = merged.select(key, *flat, *[F.coalesce(f"{t}.present", F.lit(False)).alias(f"in_{t}") for t in "snr"], *[f"a_{p}" for p in PROVIDERS])
    name = first_filled("s_company_name", "r_company_name", "n_company_name", "e_company_name", F.col(key).cast("string"))
    for p in PROVIDERS:
        name = first_filled(clean(F.col(f"a_{p}.company_name")), name)
    for p in PROVIDERS:
        value = F.coalesce(F.col(f"e_{p}_status"), F.lit("unknown"))
        if p == "board1":
            value = F.when(F.col("in_n") & (value == "unknown"), "not_found").otherwise(value)
        value = F.when(F.col("in_s") & (F.coalesce("s_source", F.lit("board1")) == p), provider_status("s_status", p)).otherwise(value)
        df = df.withColumn(f"{p}_status", F.when(F.col(f"a_{p}").isNotNull(), provider_status(F.col(f"a_{p}.status"), p)).otherwise(value))
    assessed = F.col("a_board1").isNotNull() | F.col("a_board2").isNotNull() | F.col("a_other").isNotNull()
    checked = first_filled("s_last_scraped", "e_last_overall_check")
    df = df.withColumn("company_name", name).withColumn("last_overall_check", F.when(assessed & (checked == ""), F.lit(run_date)).otherwise(checked)).withColumn("has_revisit", F.col("in_r"))
    return decide(df).select(key, "company_name", *[f"{p}_status" for p in PROVIDERS], "last_overall_check", "has_revisit", "primary", "next_action")
