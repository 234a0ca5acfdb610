"""Text lists of companies: (seq, line) rows, where order decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, company_fingerprint


def scan(spark, path: str) -> DataFrame:
    """Lines of text files in file order: seq is (file, start of the block, position in the block)."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")]
    return spark.read.text(path).select(F.struct(*place).alias("seq"), F.col("value").alias("line"))


def first_wins(lines: DataFrame) -> DataFrame:
    """One name per company key, the first spelling; blank lines and # comments are skipped."""
    named = lines.select("seq", clean("line").alias("name")).where("name <> '' and not startswith(name, '#')")
    return named.groupBy(company_fingerprint("name").alias("company_key")).agg(F.min_by("name", "seq").alias("name"))


def last_wins(lines: DataFrame) -> DataFrame:
    """One name per company key, the last spelling."""
    named = lines.select("seq", clean("line").alias("name")).withColumn("company_key", company_fingerprint("name")).where("company_key <> ''")
    return named.groupBy("company_key").agg(F.max_by("name", "seq").alias("name"))
