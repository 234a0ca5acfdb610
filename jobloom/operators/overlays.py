"""State tables that are kept up to date: latest wins, field-wise merges, refreshes and patches.

Tables carry `seq` wherever order decides. All operators are functions from DataFrames to DataFrames; grouping
uses max_by / min_by, so partial results are combined before the shuffle and no key's rows are gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import blank, clean, filled, first_filled, iso_date

#: Statuses of a tracked job.
TRACKING_STATUSES = ("pending_review", "reviewed", "applied", "rejected", "skipped")
STATUS_RANK = {"unknown": 0, "needs_retry": 1, "not_found": 2, "confirmed": 3}
REVISIT_DAYS = 30


def last_by(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """The last row of each key (max_by over the order)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order) if isinstance(order, str) else order).alias("__r")).select(*keys, "__r.*")


def last_keyed(df: DataFrame, keys: list[str], order: str | Column) -> DataFrame:
    """last_by() of the rows that have a key: rows with a null or blank key column are dropped."""
    has_key = reduce(lambda a, b: a & b, [clean(F.col(k).cast("string")) != "" for k in keys])
    return last_by(df.where(has_key), keys, order)


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, and how many rows there were (seen)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r"), F.count("*").alias("seen")).select(*keys, "__r.*", "seen")


def latest_by_date(df: DataFrame, keys: list[str], *dates: str) -> DataFrame:
    """The record with the largest date text (the first filled of `dates`); ties go to the later row (seq)."""
    return last_by(df, keys, F.struct(first_filled(*[clean(d) for d in dates]), F.col("seq")))


def status_rank(c: Column) -> Column:
    out = F.lit(0)
    for s, r in STATUS_RANK.items():
        out = F.when(c == s, r).otherwise(out)
    return out


def _detail_step(detail: str, date: str):
    def step(acc, r):
        kept = (acc["date"] != "") & (acc["date"] > r[date])
        return F.struct(F.when(kept, acc["detail"]).otherwise(first_filled(r[detail], acc["detail"])).alias("detail"), first_filled(r[date], acc["date"]).alias("date"))

    return step


def merge_records(df: DataFrame, key: str, fields: list[str], ranked: list[str], dated: dict[str, str] | None = None) -> DataFrame:
    """Field-wise merge of a key's rows in seq order.

    fields: the last non-empty value wins. ranked: the status of highest rank wins, ties to the later row. dated
    (detail -> date field): fold in order; the detail is kept while the merged date is later than the new row's,
    else it is the new row's value or, if that is empty, the old one. One array of a key's rows is folded, which
    state tables with a few records for each company allow.
    """
    dated = dated or {}
    aggs = [F.max_by(F.when(blank(f) != "", F.col(f)), F.when(blank(f) != "", F.col("seq"))).alias(f) for f in fields]
    for s in ranked:
        value = F.coalesce(filled(clean(s)), F.lit("unknown"))
        aggs.append(F.max_by(value, F.struct(status_rank(value), F.col("seq"))).alias(s))
    if dated:
        aggs.append(F.array_sort(F.collect_list(F.struct("seq", *[blank(c).alias(c) for c in {*dated, *dated.values()}]))).alias("__rows"))
    out = df.groupBy(key).agg(*aggs)
    for f in fields:
        out = out.withColumn(f, F.coalesce(f, F.lit("")))
    for detail, date in dated.items():
        start = F.struct(F.lit("").alias("detail"), F.lit("").alias("date"))
        fold = F.aggregate("__rows", start, _detail_step(detail, date))
        out = out.withColumn(detail, fold["detail"])
    return out.drop("__rows")


def refresh_snapshot(existing: DataFrame, refreshed: DataFrame, companies: DataFrame, company: str, keys: list[str]) -> DataFrame:
    """Existing rows of companies that were not refreshed, and the last refreshed row of each key."""
    kept = existing.join(companies.select(company).distinct(), company, "left_anti")
    new = last_by(refreshed, keys, "seq")
    return kept.unionByName(new.select(*kept.columns))


def tracked_in_snapshot(tracking: DataFrame, snapshot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tracked jobs with their snapshot row, tracked jobs missing from the snapshot)."""
    return tracking.join(snapshot, keys), tracking.join(snapshot.select(*keys), keys, "left_anti")


def pending_reviews(snapshot: DataFrame, tracking: DataFrame, keys: list[str], run_date: str) -> DataFrame:
    """New pending_review rows for snapshot jobs that are not tracked."""
    new = snapshot.join(tracking.select(*keys), keys, "left_anti").select(*keys, "job_url").dropDuplicates(keys)
    return new.select("*", F.lit("pending_review").alias("status"), F.lit(run_date).alias("review_date"), F.lit("").alias("application_date"), F.lit("").alias("next_action_date"))


def new_revisits(companies: DataFrame, revisits: DataFrame, cache: DataFrame, key: str, run_date: str, days: int = REVISIT_DAYS) -> DataFrame:
    """Revisit rows for companies without one: last check from the cache else the run date, due `days` later."""
    fresh = companies.join(revisits.select(key), key, "left_anti").join(cache.select(key, "last_scraped"), key, "left")
    checked = first_filled(clean("last_scraped"), F.lit(run_date))
    due = F.date_add(F.coalesce(iso_date(checked), F.to_date(F.lit(run_date))), days)
    return fresh.select(key, "company_name", checked.alias("last_checked"), due.cast("string").alias("next_revisit"))


def due_revisits(revisits: DataFrame, today: str) -> DataFrame:
    """Rows with due: true up to today, false after; dates that cannot be read are in neither and left out."""
    day = iso_date("next_revisit")
    return revisits.where(day.isNotNull()).withColumn("due", day <= F.lit(today).cast("date"))


def patch_tracking(tracking: DataFrame, patches: DataFrame, snapshot: DataFrame, keys: list[str], run_date: str, statuses: tuple = TRACKING_STATUSES) -> tuple[DataFrame, DataFrame]:
    """Apply patches, one for each key: (the new tracking table, rejected patches with a reason).

    A NULL argument keeps the stored value, an empty one clears it. Unknown statuses and jobs that are neither
    tracked nor in the snapshot are rejected; applied sets the application date; new rows take the snapshot's url.
    """
    fields = ["review_date", "application_date", "next_action_date", "notes"]
    old = tracking.select(*keys, F.lit(True).alias("__tracked"), F.col("job_url").alias("o_url"), F.col("status").alias("o_status"), *[F.col(f).alias(f"o_{f}") for f in fields])
    new = patches.select(*keys, F.lit(True).alias("__patched"), "status", *fields)
    both = new.join(old, keys, "full").join(snapshot.select(*keys, F.col("job_url").alias("s_url"), F.lit(True).alias("__known")), keys, "left")
    patched = F.col("__patched").isNotNull()
    reason = F.when(patched & ~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "status").when(patched & F.col("__tracked").isNull() & F.col("__known").isNull(), "job")
    both = both.withColumn("reason", reason)
    ok = patched & F.col("reason").isNull()
    value = lambda f: F.when(ok, F.coalesce(f, blank(f"o_{f}"))).otherwise(blank(f"o_{f}"))
    review = F.when(ok & F.col("review_date").isNull(), first_filled("o_review_date", F.lit(run_date))).otherwise(value("review_date"))
    applied = F.when(ok & (F.col("status") == "applied") & (value("application_date") == ""), F.lit(run_date)).otherwise(value("application_date"))
    kept = both.where(F.col("__tracked").isNotNull() | F.col("reason").isNull())
    table = kept.select(*keys, F.when(ok, first_filled("o_url", "s_url")).otherwise(blank("o_url")).alias("job_url"), F.when(ok, F.col("status")).otherwise(F.coalesce("o_status", F.lit("pending_review"))).alias("status"), review.alias("review_date"), applied.alias("application_date"), value("next_action_date").alias("next_action_date"), value("notes").alias("notes"))
    return table, both.where("reason is not null").select(*keys, "reason")


def apply_discoveries(registry: DataFrame, results: DataFrame, key: str, run_date: str, days: int = REVISIT_DAYS) -> tuple[DataFrame, DataFrame]:
    """(registry with discovered statuses, revisit rows of every result); results (key, outcome, board_url)."""
    seen = results.where(F.col("outcome").isin("confirmed", "not_found"))
    joined = registry.join(seen.select(key, "outcome", F.col("board_url").alias("found_url")), key, "left")
    hit = F.col("outcome").isNotNull()
    updated = joined.select(key, F.when(hit, F.col("outcome")).otherwise(F.col("status")).alias("status"), F.when(F.col("outcome") == "confirmed", first_filled("found_url", "board_url")).otherwise(F.col("board_url")).alias("board_url"), F.when(hit, F.lit(run_date)).otherwise(F.col("last_checked")).alias("last_checked"))
    due = F.date_add(F.lit(run_date).cast("date"), days).cast("string")
    return updated, seen.select(key, "outcome", F.lit(run_date).alias("last_checked"), due.alias("next_revisit"))


def hint_rows(hints: DataFrame, results: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The hint table after a discovery run: a confirmed result replaces its company's hint, others leave it.

    hints (key, tenant, site_id, board_url), results (the same, outcome, seq). A confirmed result without a tenant, site or
    address is no hint, as the next run could not use it. Of several confirmed results the last counts.
    """
    parts = ["tenant", "site_id", "board_url"]
    whole = reduce(lambda a, b: a & b, [clean(F.col(c)) != "" for c in parts])
    new = results.where((F.col("outcome") == "confirmed") & whole).select(key, *[clean(F.col(c)).alias(c) for c in parts], F.col(seq).alias("__seq"))
    both = hints.select(key, *parts, F.lit(None).cast(new.schema["__seq"].dataType).alias("__seq")).unionByName(new)
    return last_by(both, [key], F.struct(F.col("__seq").isNotNull(), F.col("__seq"))).drop("__seq")


def upsert_cache(cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Search cache with new records: the latest date wins, then the later row."""
    return latest_by_date(cache.unionByName(new), keys, "last_scraped")


def update_negatives(negatives: DataFrame, assessed: DataFrame, key: str) -> DataFrame:
    """Known-negative companies: those assessed are replaced by those assessed as not found."""
    kept = negatives.join(assessed.select(key), key, "left_anti")
    return kept.unionByName(assessed.where("not_found").select(*kept.columns)).distinct()


def backfill_details(snapshot: DataFrame, details: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Snapshot with filled details and `changed`: whether any field differs from before."""
    new = details.select(*keys, *[F.col(f).alias(f"n_{f}") for f in fields])
    out, changed = snapshot.join(new, keys, "left"), F.lit(False)
    for f in fields:
        changed = changed | ~first_filled(f"n_{f}", f).eqNullSafe(F.col(f))
    out = out.withColumn("changed", changed)
    for f in fields:
        out = out.withColumn(f, first_filled(f"n_{f}", f))
    return out.drop(*[f"n_{f}" for f in fields])


def normalise(df: DataFrame, required: list[str], defaults: dict[str, str]) -> DataFrame:
    """Typed records: known columns only, cleaned, defaults for missing values; rows without their key dropped."""
    have = set(df.columns)
    cells = [clean(c if c in have else F.lit(None).cast("string")).alias(c) for c in required]
    cells += [first_filled(clean(c if c in have else F.lit(None).cast("string")), F.lit(d)).alias(c) for c, d in defaults.items()]
    out = df.select(*cells)
    for c in required:
        out = out.where(F.col(c) != "")
    return out


def prefix_ids(df: DataFrame, doc: str, idx: str, mark: str, width: int) -> DataFrame:
    """Sequential ids in (document, position) order: sums of blocks, of documents in a block, then ranks inside.

    A block is 10,000 document numbers, or the documents whose name begins with the same four characters; one row for each
    block takes part in the only sum over all.
    """
    name = isinstance(df.schema[doc].dataType, StringType)
    block = F.substring(doc, 1, 4) if name else F.floor(F.col(doc) / 10_000)
    counts = df.groupBy(doc).agg(F.count("*").alias("__n")).withColumn("__block", block)
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy("__block").agg(F.sum("__n").alias("__n")).select("__block", before(Window.orderBy("__block")).alias("__first"))
    inside = counts.select(doc, "__block", before(Window.partitionBy("__block").orderBy(doc)).alias("__own"))
    offsets = inside.join(blocks, inside["__block"].eqNullSafe(blocks["__block"])).select(doc, (F.col("__first") + F.col("__own")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(doc).orderBy(idx))
    number = F.col("__before") + rank
    return df.join(offsets, doc).withColumn("id", F.concat(F.lit(mark), F.when(F.length(number.cast("string")) >= width, number.cast("string")).otherwise(F.lpad(number.cast("string"), width, "0")))).drop("__before")


def by_priority(candidates: DataFrame, key: str, priority: str = "priority") -> DataFrame:
    """The usable candidate of lowest priority number for each key."""
    rest = [c for c in candidates.columns if c != key]
    return candidates.groupBy(key).agg(F.min_by(F.struct(*rest), priority).alias("__r")).select(key, "__r.*")


def preferred_text(evidence: DataFrame, wanted: DataFrame, key: str, ref: str, text: str) -> tuple[DataFrame, DataFrame]:
    """((key, ref, text): the first wanted piece with a text, (key): those for which there is none, which is an error to report).

    evidence (ref, text), one or more rows for a reference (an id, or a file and location as a struct); wanted (key,
    pos, ref).
    """
    full = evidence.where(F.coalesce(F.trim(F.col(text)), F.lit("")) != "").groupBy(ref).agg(F.min(text).alias(text))
    found = wanted.join(full, ref).groupBy(key).agg(F.min_by(F.struct(ref, text), "pos").alias("__r")).select(key, f"__r.{ref}", f"__r.{text}")
    return found, wanted.select(key).distinct().join(found.select(key), key, "left_anti")
