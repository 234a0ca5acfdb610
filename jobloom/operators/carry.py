"""Carrying the last value of a document forward, without gathering a document in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 10_000


def carry_forward(rows: DataFrame, doc: str, idx: str, values: dict[str, str], block: int = BLOCK) -> DataFrame:
    """Adds, for each new name, the last non-null value of a column up to and with each row, in idx order of its document.

    Rows are dealt by document and block of `block` places, and filled inside their block. What a block starts with is the last
    value of the blocks before it: a scan over one short row for each block. So a document that holds a third of all lines is
    spread over as many tasks as it has blocks. Rows of equal doc and idx see each other's values in no fixed order; a null doc is a document
    of its own, and null places come first.
    """
    at = F.floor(F.col(idx) / block)
    marked = rows.withColumn("__block", at)
    last = {out: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(idx))).alias(f"__last_{out}") for out, c in values.items()}
    ends = marked.groupBy(doc, "__block").agg(*last.values())
    before = Window.partitionBy(doc).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select(F.col(doc).alias("__doc"), F.col("__block").alias("__start"), *[F.last(f"__last_{out}", ignorenulls=True).over(before).alias(f"__from_{out}") for out in values])
    inside = Window.partitionBy(doc, "__block").orderBy(idx)
    for out, c in values.items():
        marked = marked.withColumn(out, F.last(c, ignorenulls=True).over(inside))
    both = marked.join(starts, marked[doc].eqNullSafe(starts["__doc"]) & marked["__block"].eqNullSafe(starts["__start"]), "left")
    for out in values:
        both = both.withColumn(out, F.coalesce(out, f"__from_{out}"))
    return both.drop("__block", "__doc", "__start", *[f"__from_{out}" for out in values])
