"""Synthetic signals as rows, made in parallel: series_id, idx, value.

Noise is a function of the place and a seed, so it does not depend on how rows are dealt out. Sums along a signal are
prefix sums over parts of ``PART`` samples, so no task holds a whole signal; a Lorenz path alone is made by one task, as
each of its steps needs the one before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = 1 << 16


def uniform(seed: int, salt: int = 0) -> Column:
    """Between 0 and 1, neither included."""
    return (F.shiftrightunsigned(F.xxhash64(F.col("idx"), F.lit(seed), F.lit(salt)), 11) + 0.5) / float(1 << 53)


def normal(seed: int, deviation: float = 1.0) -> Column:
    return deviation * F.sqrt(-2 * F.log(uniform(seed, 1))) * F.cos(2 * math.pi * uniform(seed, 2))


def _line(low: float, high: float, n: int) -> Column:
    """From ``low`` to ``high``, both included."""
    return F.lit(float(low)) + F.col("idx") * ((high - low) / max(n - 1, 1))


def _walk(rows: DataFrame) -> DataFrame:
    """Running sums of ``value``."""
    parts = rows.withColumn("part", F.expr(f"idx div {PART}"))
    sums = parts.groupBy("part").agg(F.sum("value").alias("sum"))
    before = sums.select("part", F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    within = F.sum("value").over(Window.partitionBy("part").orderBy("idx"))
    return parts.withColumn("value", within).join(before, "part").select("idx", (F.col("value") + F.col("before")).alias("value"))


def _lorenz(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in batches):
            return
        x, y, z, step = 1.0, 1.0, 1.0, 0.001
        for at in range(0, n, PART):
            out = np.empty(min(PART, n - at))
            for k in range(len(out)):
                out[k] = x
                x, y, z = x + step * 10.0 * (y - x), y + step * (x * (28.0 - z) - y), z + step * (x * y - 8.0 / 3.0 * z)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(out))), pa.array(out)], ["idx", "value"])

    return rows.sparkSession.range(1).coalesce(1).mapInArrow(run, "idx long, value double")


def _edge_cases() -> Column:
    odd = {0: "NaN", 1: "Infinity", 2: "-Infinity", 3: "2.2250738585072014E-308", 4: "4.9E-324", 5: "-4.9E-324"}
    v = F.lit(0.0)
    for k, x in odd.items():
        v = F.when(F.col("idx") == k, F.lit(x).cast("double")).otherwise(v)
    return v


def _bumps(period: int) -> Column:
    """Narrow bumps of a heart beat: a small, a tall and a middle one."""
    at = (F.col("idx") % period) / period
    bump = lambda place, width, height: height * F.exp(-(((at - place) / width) ** 2))
    return bump(0.2, 0.025, 0.15) + bump(0.4, 0.012, 1.2) + bump(0.7, 0.04, 0.3)


def _sine(turns: float, n: int, height: float = 1.0) -> Column:
    return height * F.sin(_line(0.0, 2 * math.pi * turns, n))


#: Usual length, and the value from place, length and seed. ``random_walk`` is the running sum of its value; ``sensor`` and
#: ``industrial_ramp`` add a slow walk to theirs; a Lorenz path has steps of its own.
SIGNALS: dict[str, tuple[int, Callable[[int, int], Column]]] = {
    "small": (200, lambda n, s: _sine(2, n)),
    "step": (10_000, lambda n, s: F.when(F.col("idx") < n // 2, 1.0).otherwise(100.0)),
    "ramp": (1_000_000, lambda n, s: _line(0, 10_000, n)),
    "sine": (1_000_000, lambda n, s: _sine(50, n)),
    "edge_cases": (100, lambda n, s: _edge_cases()),
    "noisy_ramp": (100_000, lambda n, s: _line(0, 1000, n) + normal(s, 0.01)),
    "random_walk": (1_000_000, lambda n, s: normal(s)),
    "noisy_sine": (1_000_000, lambda n, s: 50 + _sine(0.75, n, 15) + _sine(17.5, n, 5) + _sine(125, n, 1.5) + _line(0, 10, n) + normal(s, 1.5)),
    "sensor": (3_000_000, lambda n, s: 20 + 8 * F.sin(F.col("idx") * (2 * math.pi / 86_400)) + 2 * F.sin(F.col("idx") * (2 * math.pi / 3600)) + 0.3 * F.sin(F.col("idx") * (2 * math.pi / 60)) + normal(s, 0.1) + F.when(uniform(s, 9) < 1e-4, 10.0).otherwise(0.0)),
    "vibration": (1_000_000, lambda n, s: (1 + 0.3 * F.sin(F.col("idx") * 1e-4)) * (F.sin(F.col("idx") * 0.31) + 0.5 * F.sin(F.col("idx") * 0.77) + 0.25 * F.sin(F.col("idx") * 1.9) + 0.1 * F.sin(F.col("idx") * 2.7)) + normal(s, 0.05)),
    "industrial_ramp": (1_000_000, lambda n, s: (F.col("idx") % 5000) * 0.02 + normal(s, 0.05)),
    "heartbeat": (1_000_000, lambda n, s: _bumps(800) + 0.05 * F.sin(F.col("idx") * 5e-4) + normal(s, 0.02)),
    "lorenz": (500_000, lambda n, s: F.lit(0.0)),
}


def signal(spark: SparkSession, name: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """One signal of ``SIGNALS``; ``n`` samples, or as many as usual."""
    usual, value = SIGNALS[name]
    n = usual if n is None else n
    rows = spark.range(n).select(F.col("id").alias("idx"))
    if name == "lorenz":
        rows = _lorenz(rows, n)
    else:
        rows = rows.withColumn("value", value(n, seed).cast("double"))
        if name == "random_walk":
            rows = _walk(rows)
        if name in ("sensor", "industrial_ramp"):  # a slow walk beside it
            walk = _walk(spark.range(n).select(F.col("id").alias("idx")).withColumn("value", normal(seed + 1, 0.001))).withColumnRenamed("value", "walk")
            rows = rows.join(walk, "idx").select("idx", (F.col("value") + F.col("walk")).alias("value"))
    return rows.select(F.lit(name).alias("series_id"), "idx", "value")


def signals(spark: SparkSession, names: list[str] | None = None, n: int | None = None, seed: int = 42) -> DataFrame:
    """Some signals, or all of them, one after another."""
    out = None
    for name in names or list(SIGNALS):
        own = signal(spark, name, n, seed)
        out = own if out is None else out.unionByName(own)
    return out
