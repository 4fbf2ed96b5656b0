"""What the operators of this subpackage share: shared-folder tables, folds, Arrow helpers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and about how many bytes, handed to Python at once. Texts and shingle sets can be long, so batches are small.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20
#: Words: maximal runs of characters other than space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)


def prepare(df: DataFrame) -> SparkSession:
    """Session of ``df`` with Arrow batches small enough for long texts."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def named(name: str) -> Column:
    """The column of exactly that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **work: Column) -> DataFrame:
    """Whole rows as one column ``__tm_row``, so that no name of theirs meets those of the work columns beside it."""
    return df.select(F.struct(*map(named, df.columns)).alias("__tm_row"), *[c.alias(k) for k, c in work.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``packed`` rows."""
    return df.select(*[F.col("__tm_row").getField(c).alias(c) for c in columns])


def shared_root(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``. Where that is unset, as in tests, a local session gets a
    folder of its own; on a cluster executors would each write to their own disk, so there it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    root = f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


_scratch: list[list[DataFrame]] = []


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends there, and its size is known. Within
    ``scratch`` it lasts as long, unless it is to be kept."""
    spark = df.sparkSession
    at = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    table = spark.read.schema(df.schema).parquet(at)
    table._tm_path = at  # for drop()
    if _scratch and not keep:
        _scratch[-1].append(table)
    return table


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are cut meanwhile are deleted at the end; whatever is still to be read by then is cut to be kept."""
    _scratch.append([])
    try:
        yield
    finally:
        drop(*_scratch.pop())


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more; one that is gone already is no fault."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._tm_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null ids are in fold 0."""
    return F.coalesce(F.crc32(named(doc_id).cast("string").cast("binary")) % 3, F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 1


def sample_by_hash(df: DataFrame, key: Column, rows: int, count: int) -> DataFrame:
    """About ``rows`` of the ``count`` rows of ``df``, the same ones each time: those whose hash is lowest."""
    if count <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / count))


_owner: list[tuple[str, Callable[[], None]]] = []


@contextmanager
def worker_memory(name: str, clear: Callable[[], None], collect: bool = False) -> Iterator[None]:
    """In a Python worker, which outlives its tasks: what another operator remembers there is dropped first, so a
    worker holds one operator's memory at a time. Without ``collect`` the cycle collector rests meanwhile."""
    if _owner and _owner[0][0] != name:
        _owner.pop()[1]()
        gc.collect()
        pa.default_memory_pool().release_unused()
    if not _owner:
        _owner.append((name, clear))
    if not collect:
        gc.disable()
    try:
        yield
    finally:
        gc.enable()
