"""Reading the given tables, shared scratch tables and the label fold used by several operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: Spark bounds batches by rows alone, and one document can have over 100 KB.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Batches of the session are made smaller if they have Spark's default size of 10,000 rows."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only in local mode, where all is one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def drop_written(df: DataFrame) -> None:
    """Delete a table made by written() that no later plan reads, through Hadoop's file system interface."""
    path = df.__dict__.get("_written_to")
    if path is None:
        raise ValueError("not a table made by written()")
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fold(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 4; fold 2 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def below_share(key, share: float, seed: int):
    """Rows whose hashed key falls into the first `share` of the hash range: a deterministic sample."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


CHUNK_BYTES = 1 << 19


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without copying; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK_BYTES):
    """Yield (first row, last row, bytes, offsets) for runs of rows of about `limit` bytes, so arrays stay small."""
    raw, off = utf8_column(batch.column(batch.schema.get_field_index(name)))
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi
    _give_back(len(raw))


GIVE_BACK_BYTES = 1 << 23
_read = 0


def _give_back(size: int) -> None:
    """Return freed memory to the system now and then: Python workers live on, and add to their executor's memory."""
    global _read
    _read += size
    if _read > GIVE_BACK_BYTES:
        _read = 0
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


#: Only the GNU C library has it.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


BITMAP_MAX_BITS = 1 << 27


def maybe_in(df: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """Add a boolean column: false only where df's key is certainly not among ids (one long column).

    The ids become a bitmap over a hash of at most 2**27 bits (16 MB, whatever their number), which is
    broadcast in slices of 4 KB; a bit that two ids share only costs a row that a later join drops.
    """
    (name,) = ids.columns
    n = ids.count()
    bits = 1 << 20
    while bits < 64 * n and bits < BITMAP_MAX_BITS:
        bits *= 2
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    slices = ids.select(spot(F.col(name)).alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("__slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("__bits"))
    at = F.bitmap_bit_position(spot(F.col(key)))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return df.join(F.broadcast(slices), F.bitmap_bucket_number(spot(F.col(key))) == F.col("__slice"), "left").withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("__slice", "__bits")


def without_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """df without the rows whose key is among ids; only rows that the bitmap cannot clear are shuffled."""
    (name,) = ids.columns
    flagged = maybe_in(df, key, ids, "__maybe")
    doubtful = flagged.where("__maybe").drop("__maybe")
    gone = ids.select(F.col(name).alias("__gone"))
    return flagged.where("not __maybe").drop("__maybe").unionByName(doubtful.join(gone, doubtful[key] == gone["__gone"], "left_anti"))
