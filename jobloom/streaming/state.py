"""State tables kept by buckets of a key, several tables under one commit.

A store is a folder. Each commit writes the touched buckets of its tables into folders of their own, then a manifest that names
the valid folder of every bucket of every table, and then replaces the file CURRENT, one line with the manifest's name, by one atomic
rename. Readers take one manifest and so see all tables of one commit; whoever dies before the rename leaves the old set
valid, and a repeated commit writes the same rows again. Buckets that a commit does not touch are neither read nor written.

The driver handles names of buckets only: at most `buckets` for each table. Folders and manifests that the valid manifest does
not name are deleted once they are older than `keep_ms`, so that slow readers keep their files.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
KEEP_MS = 24 * 3600 * 1000
_BUCKET = "__bucket"


class StateStore:
    """Tables of one folder; `key` names the column that decides a row's bucket, for each table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, keep_ms: int = KEEP_MS):
        self.spark, self.path, self.buckets, self.keep_ms = spark, path.rstrip("/"), buckets, keep_ms

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop, hadoop.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def _create(self, name: str, text: str) -> None:
        hadoop, fs = self._fs()
        out = fs.create(hadoop.Path(f"{self.path}/{name}"), False)
        out.write(bytearray(text, "utf-8"))
        out.close()

    def manifest(self) -> dict:
        """{"buckets": number, "tables": {table: {"schema": ..., "parts": {bucket: folder}}}} of the valid commit."""
        hadoop, fs = self._fs()
        if not fs.exists(hadoop.Path(f"{self.path}/CURRENT")):
            return {"buckets": self.buckets, "tables": {}}
        found = json.loads(self._read(self._read("CURRENT").strip()))
        self.buckets = found["buckets"]  # a store keeps the number that it began with
        return found

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key)), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows of a table, of some buckets only if they are named; None if no commit has made the table."""
        entry = (manifest or self.manifest())["tables"].get(table)
        if entry is None:
            return None
        reader = self.spark.read.schema(entry["schema"])
        paths = [f"{self.path}/{p}" for b, p in entry["parts"].items() if buckets is None or int(b) in buckets]
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], entry["schema"])

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """Buckets that hold the keys of some rows: at most as many numbers as there are buckets."""
        self.manifest()
        return [r[0] for r in rows.select(self.bucket(key)).distinct().collect()]

    def commit(self, changes: dict[str, tuple[DataFrame, str, list[int] | None]]) -> str:
        """Make tables valid together: {table: (rows, key, touched buckets, or None for the whole table)}; returns the manifest's name.

        The rows are all that the touched buckets hold from now on; rows of other buckets are an error.
        """
        manifest = self.manifest()
        for table, (rows, key, touched) in changes.items():
            folder = f"{table}-{uuid.uuid4().hex}"
            marked = rows.withColumn(_BUCKET, self.bucket(key))
            marked.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
            hadoop, fs = self._fs()
            names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(f"{self.path}/{folder}"))]
            new = {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith(f"{_BUCKET}=")}
            if touched is not None and not {int(b) for b in new} <= set(touched):
                raise ValueError(f"rows of {table} lie in buckets that are not named as touched")
            old = manifest["tables"].get(table, {"parts": {}})["parts"] if touched is not None else {}
            kept = {b: p for b, p in old.items() if int(b) not in (touched or [])}
            manifest["tables"][table] = {"schema": rows._jdf.schema().toDDL(), "parts": kept | new}
        name = f"manifest-{int(time.time() * 1000)}-{uuid.uuid4().hex}.json"
        self._create(name, json.dumps(manifest))
        self._point_to(name)
        self._clean(manifest, name)
        return name

    def _point_to(self, name: str) -> None:
        hadoop, fs = self._fs()
        staged = f"_{uuid.uuid4().hex}"
        self._create(staged, f"{name}\n")
        over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        over[0] = hadoop.Options.Rename.OVERWRITE
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(hadoop.Path(f"{self.path}/{staged}"), hadoop.Path(f"{self.path}/CURRENT"), over)

    def _clean(self, manifest: dict, name: str) -> None:
        hadoop, fs = self._fs()
        named = {p for t in manifest["tables"].values() for p in t["parts"].values()}
        folders, oldest = {p.partition("/")[0] for p in named} | {name, "CURRENT"}, time.time() * 1000 - self.keep_ms
        for entry in fs.listStatus(hadoop.Path(self.path)):
            own = entry.getPath().getName()
            if own not in folders and entry.getModificationTime() < oldest:
                fs.delete(entry.getPath(), True)
            elif own in folders and entry.isDirectory():  # of a folder in use, the buckets that later commits replaced
                for part in fs.listStatus(entry.getPath()):
                    if part.isDirectory() and f"{own}/{part.getPath().getName()}" not in named and part.getModificationTime() < oldest:
                        fs.delete(part.getPath(), True)
