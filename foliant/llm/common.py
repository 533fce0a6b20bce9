"""What the operators of this package share: tables, batches, hashing, lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separator of words everywhere in this package.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers once a session, wherever they start."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="foliant-code-")) / "foliant.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(to))
    _SHIPPED.add(sc.applicationId)


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Spark's batches, so that what Python makes of one stays small."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def utf8(column: str | Column) -> Column:
    """Text as bytes, null as none: Python then need not decode it."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def lower_words(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words of a UTF-8 text; bytes.split() has exactly the six ASCII blanks."""
    return text.lower().split()


word_hash = xxhash.xxh3_64_intdigest


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def learns(doc_id: str | Column = "doc_id", modulus: int = 3, held: int = 1) -> Column:
    """False on the held-out fold: crc32 of the id as text leaves ``held``."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus)) != held


def chunked(it: Iterator, size: int) -> Iterator[list]:
    part = []
    for x in it:
        part.append(x)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
