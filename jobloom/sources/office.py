"""Office-XML documents as paragraph tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "source_file string, idx int, text string"
#: Bytes of rows that a task of documents hands on at once.
FLUSH = 1 << 20


def paragraphs_of(data: bytes) -> list[tuple[int, str]]:
    """(index, text) of the non-empty paragraphs of a document, white space collapsed."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for i, p in enumerate(root.iter(f"{_W}p")):
        text = " ".join("".join(t.text or "" for t in p.iter(f"{_W}t")).split())
        if text:
            out.append((i, text))
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per paragraph of every .docx below path; lock files are skipped, an empty document is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return parse_files(files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")))


def in_batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about FLUSH bytes, so that a task holds the rows of a few files, however many come to it at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if size >= FLUSH or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def parse_files(files: DataFrame) -> DataFrame:
    """Paragraphs of documents given as (path, content) rows."""

    def rows(batches):
        for batch in batches:
            for name, data in zip(*batch.columns):
                found = paragraphs_of(data.as_py())
                if not found:
                    raise ValueError(f"empty document: {name}")
                yield from ((name.as_py(), i, t) for i, t in found)

    shape = pa.schema([("source_file", pa.string()), ("idx", pa.int32()), ("text", pa.string())])
    return files.select("path", "content").mapInArrow(lambda batches: in_batches(rows(batches), shape), PARAGRAPHS)


def build_files(texts: DataFrame) -> DataFrame:
    """Documents (path, content) of (path, text) rows: one paragraph for each line."""

    def rows(batches):
        for batch in batches:
            yield from ((name.as_py(), build_file((text.as_py() or "").split("\n"))) for name, text in zip(*batch.columns))

    shape = pa.schema([("path", pa.string()), ("content", pa.binary())])
    return texts.select("path", "text").mapInArrow(lambda batches: in_batches(rows(batches), shape), "path string, content binary")


def build_file(paragraphs: list[str]) -> bytes:
    """A minimal document with one paragraph per text."""
    root = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(root, f"{_W}body")
    for text in paragraphs:
        run = ElementTree.SubElement(ElementTree.SubElement(body, f"{_W}p"), f"{_W}r")
        ElementTree.SubElement(run, f"{_W}t").text = text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", ElementTree.tostring(root, "utf-8"))
    return out.getvalue()
