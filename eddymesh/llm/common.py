"""What the operators of this folder share: words, the shared folder, tables written between stages."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIBC = ctypes.CDLL(None)
#: A word, as Java's and DuckDB's patterns read it.
WORD = r"[^\x20\x09-\x0D]+"
#: A-Z to a-z on UTF-8 bytes; bytes.split() then cuts at exactly 0x20 and 0x09-0x0D.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and all tasks run on this
    machine (tests), a local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file://{tempfile.gettempdir()}/eddymesh-shared").rstrip("/")


#: The tables written inside the innermost `scratch`.
_TABLES: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("_TABLES", default=None)


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    if (tables := _TABLES.get()) is not None:
        tables.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def removed(tables: list[tuple[SparkSession, str]]) -> None:
    """Deletes written tables."""
    for spark, path in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables stored inside go at the end, but for those put into the list that it gives: what comes out reads them.
    Only tables whose readers are all written may be left out of it."""
    kept: list[DataFrame] = []
    tables: list[tuple[SparkSession, str]] = []
    token = _TABLES.set(tables)
    try:
        yield kept
    finally:
        _TABLES.reset(token)
        stay = {df.stored_at for df in kept}
        if (outer := _TABLES.get()) is not None:
            outer += [t for t in tables if t[1] in stay]
        removed([t for t in tables if t[1] not in stay])


@contextmanager
def gathered() -> Iterator[list[tuple[SparkSession, str]]]:
    """The tables stored inside that a `scratch` there doesn't remove; for `removed`, once what reads them is written."""
    tables: list[tuple[SparkSession, str]] = []
    token = _TABLES.set(tables)
    try:
        yield tables
    finally:
        _TABLES.reset(token)


def numbered(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """row (a number of its own for each row) and of (a struct of the columns of docs, or of these): a written table, so
    that whoever reads it again finds the same numbers, whatever docs is."""
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("of")), "numbered")


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tidied(rows: Iterator[pa.RecordBatch], keep_encoder: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows; before and after them the worker gives back memory that nothing uses. Workers outlive tasks and
    operators, so an encoder that an earlier operator left in the worker goes too, unless it is needed again."""
    try:
        given_back(keep_encoder)
        yield from rows
    finally:
        given_back(keep_encoder)


def given_back(keep_encoder: bool) -> None:
    if not keep_encoder and (tokens := sys.modules.get("eddymesh.llm.tokens")):
        tokens.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    if hasattr(LIBC, "malloc_trim"):
        LIBC.malloc_trim(0)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of these columns, in the order and of the types of the schema."""
    arrays = [c.cast(f.type) if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def column(b: pa.RecordBatch, name: str) -> pa.Array:
    found = b.column(b.schema.get_field_index(name))
    return found.cast(pa.string()) if pa.types.is_large_string(found.type) else found
