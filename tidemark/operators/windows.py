"""The window table: compress, decompress, and what is measured on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import blocks, codec, config as C
from tidemark.functions.columns import finite

WINDOWS = (
    "series_id string, block_no long, window_no int, start_idx long, window_length int, model_id int, encoding_id int, precision_bits int, "
    "model_params array<double>, residuals binary, n_bytes int, vmin double, vmax double, n_odd int"
)
#: Samples that are decoded, or of short blocks that are coded, at once.
AT_ONCE = 1 << 18


def window_rows(blocks_: list[tuple[str, int, np.ndarray]], chunk: int, precision: int, enforce: bool, bound: float) -> pa.Table:
    """Rows of ``WINDOWS`` of blocks, each given by its signal, its first place and its samples. vmin and vmax are those of
    the finite samples, n_odd counts the others."""
    rows = []
    for (series_id, first, y), windows in zip(blocks_, blocks.encode_blocks([y for _, _, y in blocks_], precision, enforce, bound), strict=True):
        sizes = np.array([w["length"] for w in windows], np.int64)
        at = np.cumsum(sizes) - sizes
        fine = np.isfinite(y)
        low, high, odd = (f.reduceat(v, at) for f, v in ((np.minimum, np.where(fine, y, np.inf)), (np.maximum, np.where(fine, y, -np.inf)), (np.add, (~fine).astype(np.int64))))
        none = odd == sizes
        for n, (w, a, lo, hi, bad, empty) in enumerate(zip(windows, at.tolist(), low.tolist(), high.tolist(), odd.tolist(), none.tolist(), strict=True)):
            rows.append((series_id, first // chunk, n, first + a, w["length"], w["model"], w["encoding"], w["precision"], w["params"], w["body"], codec.record_size(w), None if empty else lo, None if empty else hi, bad))
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.float64()), pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int32()]
    names = [x.split()[0] for x in WINDOWS.split(", ")]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)


def by_block(series: DataFrame, chunk: int, f: Callable[[list[tuple[str, int, np.ndarray]]], pa.Table], schema: str) -> DataFrame:
    """f([(signal, first place, samples), ...]) -> rows of ``schema``, for blocks of ``chunk`` samples, some at a time. Blocks
    are dealt out by signal and number and come sorted, so a task holds one long block or some short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, list[np.ndarray]]] = []  # in order; the last one may go on
        size = 0

        def done(part: list[tuple[str, int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            if part:
                yield from f([(name, at, np.concatenate(ys)) for name, at, ys in part]).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            names, idx, y = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            codes = names.dictionary_encode().indices.to_numpy()
            cuts = (np.flatnonzero((codes[1:] != codes[:-1]) | (idx[1:] // chunk != idx[:-1] // chunk)) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(idx)], strict=True):
                name, at = names[a].as_py(), int(idx[a])
                if held and held[-1][0] == name and held[-1][1] // chunk == at // chunk:
                    held[-1][2].append(y[a:b])
                else:
                    if size >= AT_ONCE:
                        yield from done(held)
                        held, size = [], 0
                    held.append((name, at, [y[a:b]]))
                size += b - a
        yield from done(held)

    dealt = series.select("series_id", "idx", "value").withColumn("block_no", F.expr(f"idx div {chunk}")).repartition("series_id", "block_no")
    return dealt.sortWithinPartitions("series_id", "idx").drop("block_no").mapInArrow(run, schema)


def compress(series: DataFrame, chunk: int = C.CHUNK, precision: int = C.PRECISION, enforce: bool = True, bound: float = C.BOUND) -> DataFrame:
    """A row per window. A task never holds a whole signal, and the bytes of a block don't depend on what is coded beside it."""
    return by_block(series, chunk, lambda part: window_rows(part, chunk, precision, enforce, bound), WINDOWS)


SWEEP = "series_id string, requested int, enforced boolean, n long, bytes long, max_error double, abs_sum double, square_sum double, bits_sum long"


def sweep(series: DataFrame, settings: list[tuple[int, bool]], chunk: int = C.CHUNK, bound: float = C.BOUND) -> DataFrame:
    """A row per block and setting (precision asked for, whether the bound is held): bytes of its records, and what makes up
    errors and mean precision. Each block is dealt out once for all settings; errors are those of finite samples."""

    def f(part: list[tuple[str, int, np.ndarray]]) -> pa.Table:
        rows = []
        for requested, enforced in settings:
            for (name, _, y), windows in zip(part, blocks.encode_blocks([y for _, _, y in part], requested, enforced, bound), strict=True):
                with np.errstate(all="ignore"):
                    d = np.abs(blocks.decode_windows(windows) - y)
                d = d[np.isfinite(d)]
                rows.append((name, requested, enforced, len(y), sum(map(codec.record_size, windows)), float(d.max(initial=0)), float(d.sum()), float(d @ d), sum(w["precision"] * w["length"] for w in windows)))
        kinds = [pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SWEEP.split(", ")])

    return by_block(series, chunk, f, SWEEP)


def decompress(windows: DataFrame) -> DataFrame:
    """series_id, idx, value: rows are independent, so no shuffle. Many windows are decoded at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for r in batch.to_pylist():
                part.append(r)
                size += r["window_length"]
                if size >= AT_ONCE:
                    yield from _samples(part)
                    part, size = [], 0
            if part:
                yield from _samples(part)

    wanted = windows.select("series_id", "start_idx", "window_length", "model_id", "encoding_id", "precision_bits", "model_params", "residuals")
    return wanted.mapInArrow(run, "series_id string, idx long, value double")


def as_window(r: dict) -> dict:
    """A row of the window table as the codec has it."""
    return {"length": r["window_length"], "model": r["model_id"], "encoding": r["encoding_id"], "precision": r["precision_bits"], "params": r["model_params"], "body": r["residuals"]}


def _samples(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    y = blocks.decode_windows([as_window(r) for r in rows])
    n = np.array([r["window_length"] for r in rows], np.int64)
    ends = np.cumsum(n)
    idx = np.repeat(np.array([r["start_idx"] for r in rows], np.int64) - (ends - n), n) + np.arange(len(y))
    names = pa.array([r["series_id"] for r in rows], pa.string()).take(pa.array(np.repeat(np.arange(len(rows)), n)))
    whole = pa.RecordBatch.from_arrays([names, pa.array(idx), pa.array(y)], ["series_id", "idx", "value"])
    for at in range(0, len(y), 65_536):
        yield whole.slice(at, 65_536)


def scan(windows: DataFrame, start: int, stop: int, lowest: float | None = None, highest: float | None = None) -> DataFrame:
    """Samples of places start to stop (exclusive), of values lowest to highest. Only windows that can hold some are
    decoded; the conditions on start_idx, vmin and vmax reach the Parquet statistics. Windows hold values before coding,
    so value limits are widened by the error bound. A NaN lies in no range of values, an infinite one in a range open to
    its side."""
    kept = windows.filter((F.col("start_idx") < stop) & (F.col("start_idx") + F.col("window_length") > start))
    if lowest is not None:
        kept = kept.filter((F.col("vmax") >= lowest - C.BOUND) | (F.col("n_odd") > 0))
    if highest is not None:
        kept = kept.filter((F.col("vmin") <= highest + C.BOUND) | (F.col("n_odd") > 0))
    found = decompress(kept).filter((F.col("idx") >= start) & (F.col("idx") < stop))
    if lowest is not None:
        found = found.filter((F.col("value") >= lowest) & ~F.isnan("value"))
    return found if highest is None else found.filter(F.col("value") <= highest)


def errors(original: DataFrame, recovered: DataFrame) -> DataFrame:
    """Per series: samples of either side, samples that one side lacks, largest and mean absolute error and root mean
    square error over pairs of finite samples. Errors are null if a sample is missing, 0 if no pair is finite."""
    a = original.select("series_id", "idx", "value", F.lit(True).alias("has_a"))
    b = recovered.select("series_id", "idx", F.col("value").alias("back"), F.lit(True).alias("has_b"))
    both = a.join(b, ["series_id", "idx"], "full")
    d = F.when(finite(F.col("value")) & finite(F.col("back")), F.abs(F.col("value") - F.col("back")))
    missing = F.count_if(F.col("has_a").isNull() | F.col("has_b").isNull())
    told = lambda c: F.when(missing == 0, F.coalesce(c, F.lit(0.0)))
    return both.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), missing.alias("missing"), told(F.max(d)).alias("max_error"), told(F.avg(d)).alias("mae"), told(F.sqrt(F.avg(d * d))).alias("rmse")
    )


def per_block(series: DataFrame, chunk: int, f: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """f(samples) -> tuple, once a block: series_id, block_no and the columns of ``schema``."""
    columns = [x.split() for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}

    def run(part: list[tuple[str, int, np.ndarray]]) -> pa.Table:
        rows = [f(y) for _, _, y in part]
        head = {"series_id": pa.array([name for name, _, _ in part], pa.string()), "block_no": pa.array([at // chunk for _, at, _ in part], pa.int64())}
        return pa.table(head | {name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(columns)})

    return by_block(series, chunk, run, "series_id string, block_no long, " + schema)


def per_series(series: DataFrame, f, schema: str) -> DataFrame:
    """f(values in order) -> tuple, once a series. For codecs that carry state over a whole signal, which one task then holds."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        return pa.table({n: [v] for n, v in zip(["series_id", *names], (table.column("series_id")[0].as_py(), *f(table.column("value").to_numpy())), strict=True)})

    return series.groupBy("series_id").applyInArrow(run, "series_id string, " + schema)
