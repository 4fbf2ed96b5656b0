"""Compression of streams: blocks are coded as they fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import config as C
from tidemark.operators.windows import WINDOWS, window_rows


def compress_stream(series: DataFrame, chunk: int = C.CHUNK, precision: int = C.PRECISION, enforce: bool = True, bound: float = C.BOUND, patience_ms: int | None = None) -> DataFrame:
    """Rows of the window table of a stream of series_id, idx, value, for append mode.

    State is one open block a key (series and block), at most ``chunk`` samples; a full block is coded and its state
    dropped. With ``patience_ms``, a block that gets nothing for so long is coded as it is, each run of samples that follow
    one another apart; such a stream never ends by itself, so an available-now trigger wants it left out. A sample that comes twice while its block is open counts once, the later value; one that comes after
    that opens the block anew."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, y = (np.frombuffer(b, t) for b, t in zip(state.get, ("<i8", "<f8"), strict=True)) if state.exists else (np.zeros(0, "<i8"), np.zeros(0))
        for f in frames:
            idx, y = np.concatenate([idx, f["idx"].to_numpy("<i8")]), np.concatenate([y, f["value"].to_numpy("<f8")])
        last = len(idx) - 1 - np.unique(idx[::-1], return_index=True)[1]
        idx, y = idx[last], y[last]
        if len(idx) < chunk and not state.hasTimedOut:
            state.update((idx.astype("<i8").tobytes(), y.astype("<f8").tobytes()))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)
            return
        if state.exists:
            state.remove()
        starts = np.flatnonzero(np.diff(idx, prepend=idx[:1] - 2) != 1)
        for a, b in zip(starts, [*starts[1:], len(idx)], strict=True):
            yield window_rows([(key[0], int(idx[a]), y[a:b])], chunk, precision, enforce, bound).to_pandas()

    rows = series.filter(F.col("value").isNotNull()).withColumn("block_no", F.expr(f"idx div {chunk}"))
    return rows.groupBy("series_id", "block_no").applyInPandasWithState(run, WINDOWS, "idx binary, y binary", "append", GroupStateTimeout.NoTimeout if patience_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
