"""JSON Lines: tolerant and strict scans, the canonical sink, and hint tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, company_fingerprint


def parse_tolerant(lines: DataFrame, schema: str, line: str = "value", counts: Observation | None = None) -> DataFrame:
    """Records of lines that hold a JSON object; blank, broken and other lines are dropped.

    An observation gets the numbers taken, blank and rejected of the same pass, once the records have been written or counted.
    """
    parsed = lines.withColumn("__v", F.try_parse_json(F.trim(line)))
    good = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    if counts is not None:
        blank = F.coalesce(F.trim(line) == "", F.lit(False))
        parsed = parsed.withColumn("__good", good).observe(counts, F.count_if("__good").alias("taken"), F.count_if(blank).alias("blank"), F.count_if(~F.col("__good") & ~blank).alias("rejected"))
        good = F.col("__good")
    return parsed.where(good).withColumn("__r", F.from_json(line, schema)).select(*[c for c in lines.columns if c != line], "__r.*")


def count_rejects(lines: DataFrame, line: str = "value") -> DataFrame:
    """How many lines parse_tolerant takes, skips as blank, and rejects."""
    v = F.try_parse_json(F.trim(line))
    good = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    blank = F.trim(line) == ""
    return lines.agg(F.count_if(good).alias("taken"), F.count_if(blank).alias("blank"), F.count_if(~good & ~blank).alias("rejected"))


def scan_tolerant(spark: SparkSession, path: str, schema: str, counts: Observation | None = None) -> DataFrame:
    """A tolerant scan of files; a path that does not exist is an empty table, unless write_canonical() has its old table aside."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    there = [p for p in (path, f"{path}.old") if jvm.Path(p).getFileSystem(conf).globStatus(jvm.Path(p))]
    return parse_tolerant(spark.read.text(there[0]), schema, counts=counts) if there else spark.createDataFrame([], schema)


def scan_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """One JSON line per row, fields sorted by name, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_canonical(df: DataFrame, path: str, keys: list[str]) -> int:
    """Sorted canonical lines, written beside the target; the old table is moved aside first and deleted last; returns the row count, which the write itself has taken.

    A crash at any point leaves the old or the new table, at `path` or beside it as `path.old` until the next write.
    """
    spark = df.sparkSession
    staging = f"{path}.{uuid.uuid4().hex}"
    written = Observation()
    canonical_lines(df.orderBy(*keys)).observe(written, F.count("*").alias("rows")).write.text(staging)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    target, old = hadoop(path), hadoop(f"{path}.old")
    if fs.exists(target):
        fs.delete(old, True)
        if not fs.rename(target, old):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(hadoop(staging), target):
        fs.rename(old, target)
        raise OSError(f"could not move {staging} to {path}")
    fs.delete(old, True)
    return written.get["rows"]


def hints_from_json(df: DataFrame, fields: str, required: list[str], text: str = "value") -> DataFrame:
    """Rows of JSON objects {company: {field: ...}}: keyed by fingerprint, incomplete entries dropped, last key wins.

    df has seq and the JSON text; `fields` is the struct's DDL.
    """
    entries = df.select("seq", F.posexplode(F.map_entries(F.from_json(text, f"map<string,struct<{fields}>>"))).alias("pos", "e"))
    rows = entries.select("seq", "pos", company_fingerprint("e.key").alias("company_key"), "e.value.*")
    for c in required:
        rows = rows.where(clean(c) != "")
    rest = [c for c in rows.columns if c not in ("seq", "pos", "company_key")]
    return rows.where("company_key <> ''").groupBy("company_key").agg(F.max_by(F.struct(*rest), F.struct("seq", "pos")).alias("r")).select("company_key", "r.*")


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of every table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out
