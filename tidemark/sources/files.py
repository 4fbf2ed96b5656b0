"""Containers and raw files: packed a bounded run of blocks a row, written by a sink that commits whole jobs.

A file holds consecutive blocks of one signal; its name has the signal and the place of its first sample, so no task
ever holds a whole signal. Reading goes through Spark's binary source, a file a row.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.functions import blocks, codec, config as C
from tidemark.operators.windows import as_window

#: Blocks of one container: payloads stay far below the 4 GiB that its size field can tell.
BLOCKS = 64
#: Samples of one raw file.
RAW_SAMPLES = 1 << 22
CONTAINERS = "series_id string, start_idx long, n long, content binary"


def pack_containers(windows: DataFrame, chunk: int = C.CHUNK, blocks: int = BLOCKS, precision: int = C.PRECISION) -> DataFrame:
    """A row per container of at most ``blocks`` blocks: series_id, start_idx, n, content."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start_idx").to_pylist()
        records = [as_window(r) for r in rows]
        return pa.table(
            [pa.array([rows[0]["series_id"]], pa.string()), pa.array([rows[0]["start_idx"]], pa.int64()), pa.array([sum(r["length"] for r in records)], pa.int64()), pa.array([codec.pack_container(records, precision, chunk)], pa.binary())],
            names=["series_id", "start_idx", "n", "content"],
        )

    kept = windows.select("series_id", F.expr(f"block_no div {blocks}").alias("part"), "start_idx", "window_length", "model_id", "encoding_id", "precision_bits", "model_params", "residuals")
    return kept.groupBy("series_id", "part").applyInArrow(run, CONTAINERS)


def _samples(series_id: str, start: int, y: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([series_id] * len(y), pa.string()), pa.array(np.arange(start, start + len(y))), pa.array(y, pa.float64())], ["series_id", "idx", "value"])


def unpack_containers(containers: DataFrame) -> DataFrame:
    """series_id, idx, value; a damaged container raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                part, size = [], 0
                for w in [*codec.unpack_container(data), None]:  # many windows at once, never a whole container's samples
                    if part and (w is None or size >= 1 << 18):
                        y = blocks.decode_windows(part)
                        for k in range(0, len(y), 65_536):
                            yield _samples(name, at + k, y[k : k + 65_536])
                        at += len(y)
                        part, size = [], 0
                    if w:
                        part.append(w)
                        size += w["length"]

    return containers.select("series_id", "start_idx", "content").mapInArrow(run, "series_id string, idx long, value double")


def pack_raw(series: DataFrame, samples: int = RAW_SAMPLES) -> DataFrame:
    """A row per run of at most ``samples`` samples, as little-endian float64."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        data = table.column("value").to_numpy().astype("<f8").tobytes()
        return pa.table([pa.array([table.column("series_id")[0].as_py()]), pa.array([table.column("idx")[0].as_py()], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([data], pa.binary())], names=["series_id", "start_idx", "n", "content"])

    return series.select("series_id", "idx", "value", F.expr(f"idx div {samples}").alias("part")).groupBy("series_id", "part").applyInArrow(run, CONTAINERS)


def unpack_raw(parts: DataFrame) -> DataFrame:
    """series_id, idx, value; a partial last sample is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                y = np.frombuffer(data, "<f8", count=len(data) // 8)
                for at in range(0, len(y), 65_536):
                    yield _samples(name, start + at, y[at : at + 65_536])

    return parts.select("series_id", "start_idx", "content").mapInArrow(run, "series_id string, idx long, value double")


def read_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """series_id, start_idx, content of the files that the sink wrote below ``path``."""

    parts = F.split("path", "/")
    unquoted = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))  # noqa: E731  the path itself is a quoted one
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)
    return found.select(unquoted(unquoted(F.element_at(parts, -2))).alias("series_id"), F.split_part(F.element_at(parts, -1), F.lit("."), F.lit(1)).cast("long").alias("start_idx"), "content")


def list_files(spark: SparkSession, path: str, suffix: str = "bin") -> DataFrame:
    """path, length of the files of one kind below ``path``, sorted by path."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length").orderBy("path")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    """Every task writes under a name of its own; the job's commit puts the files in place, an abort removes them, so
    tasks that run twice leave nothing twice."""

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix, self.job = path, suffix, uuid.uuid4().hex

    def _place(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("/") else f"file://{self.path}")

    def write(self, iterator: Iterator) -> Written:
        fs, root = self._place()
        files = []
        for row in iterator:
            folder = f"{root}/{quote(row['series_id'], safe='')}"
            own = f"{root}/_staged-{self.job}/{uuid.uuid4().hex}"
            fs.create_dir(f"{root}/_staged-{self.job}", recursive=True)
            with fs.open_output_stream(own) as out:
                out.write(bytes(row["content"]))
            files.append((own, f"{folder}/{row['start_idx']:020d}.{self.suffix}"))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = self._place()
        for own, to in (f for m in messages if m for f in m.files):
            fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
            fs.move(own, to)
        self._clear(fs, root)

    def abort(self, messages: list) -> None:
        self._clear(*self._place())

    def _clear(self, fs, root: str) -> None:
        from pyarrow.fs import FileType

        staged = f"{root}/_staged-{self.job}"
        if fs.get_file_info(staged).type == FileType.Directory:
            fs.delete_dir(staged)


class FileSink(DataSource):
    """``df.write.format("tidemark_files").option("suffix", "tmk").mode("append").save(path)`` for rows of ``CONTAINERS``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_files"

    def schema(self) -> str:
        return CONTAINERS

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are only added: choose mode append and a new folder")
        return FileWriter(self.options["path"], self.options.get("suffix", "tmk"))


def write_files(parts: DataFrame, path: str, suffix: str) -> None:
    parts.sparkSession.dataSource.register(FileSink)
    parts.write.format("tidemark_files").option("suffix", suffix).mode("append").save(path)
