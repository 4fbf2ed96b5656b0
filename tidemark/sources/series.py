"""Signals as rows: series_id, idx (from 0), value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "series_id string, idx long, value double"
#: Bytes of a raw file that one task reads.
PART_BYTES = 64 << 20


def series(df: DataFrame, key: str, order: list[str], value: str, splits: list | None = None) -> DataFrame:
    """Rows numbered in order within each key. Null values are dropped first: a signal has no gaps.

    A signal is numbered in one task, unless ``splits`` gives ascending limits on the first order column (``split_points``
    finds some): then each part between limits is numbered by itself and moved by the rows before it, of which only a
    count for each part is shuffled, so one signal of any length is numbered by many tasks."""
    kept = df.filter(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("series_id"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.col(value).cast("double").alias("value"))
    by = [f"_o{k}" for k in range(len(order))]
    if not splits:
        place = F.row_number().over(Window.partitionBy("series_id").orderBy(*by)) - 1
        return kept.select("series_id", place.cast("long").alias("idx"), "value")
    # nulls come first, as in a sort
    kept = kept.withColumn("_part", F.coalesce(sum((F.col("_o0") >= F.lit(s)).cast("int") for s in splits), F.lit(-1)))
    counts = kept.groupBy("series_id", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("series_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("series_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = kept.withColumn("_no", F.row_number().over(Window.partitionBy("series_id", "_part").orderBy(*by)))
    return within.join(counts, ["series_id", "_part"]).select("series_id", (F.col("_before") + F.col("_no") - 1).cast("long").alias("idx"), "value")


def split_points(df: DataFrame, order: str, parts: int) -> list:
    """At most ``parts`` - 1 limits that cut a numeric or time column into parts of about equal size."""
    kind = df.schema[order].dataType.simpleString()
    at = df.select(F.percentile_approx(order, [n / parts for n in range(1, parts)], 10 * parts).alias("at")).first()["at"] if parts > 1 else None
    return [F.lit(x).cast(kind) for x in sorted(set(at or []))]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signal a user, ordered by event_id, which is unique."""
    return series(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["event_id"], "value")


class Part(InputPartition):
    def __init__(self, path: str, name: str, start: int, size: int) -> None:
        super().__init__((path, start))
        self.path, self.name, self.start, self.size = path, name, start, size


class RawReader(DataSourceReader):
    """A part of a file is a task: samples have a fixed width, so it begins where it likes."""

    def __init__(self, path: str, part_bytes: int) -> None:
        self.path, self.part_bytes = path, part_bytes // 8 * 8

    def _place(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")

    def partitions(self) -> list[Part]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = self._place()
        info = fs.get_file_info(root)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(root, recursive=True))
        files = sorted((f.path, f.size // 8 * 8) for f in found if f.type == FileType.File and f.size >= 8 and not f.base_name.startswith((".", "_")))
        return [Part(p, p, at, min(self.part_bytes, size - at)) for p, size in files for at in range(0, size, self.part_bytes)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        fs, _ = self._place()
        with fs.open_input_file(partition.path) as f:
            for at in range(partition.start, partition.start + partition.size, 8 << 16):
                y = np.frombuffer(f.read_at(min(8 << 16, partition.start + partition.size - at), at), "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(y), pa.string()), pa.array(np.arange(at // 8, at // 8 + len(y))), pa.array(y)], ["series_id", "idx", "value"])


class RawSource(DataSource):
    """``spark.read.format("tidemark_raw").load(path)``: headerless float64 files below a path, each a signal."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_raw"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def read_raw(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Headerless little-endian float64 files, one series each, named by path; a partial last sample is left out. A file is
    read in parts of ``part_bytes``, by the file systems that Arrow can open (local or mounted, HDFS, S3)."""
    spark.dataSource.register(RawSource)
    return spark.read.format("tidemark_raw").option("part_bytes", str(part_bytes)).load(path)
