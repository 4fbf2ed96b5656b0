"""Exact byte sizes of the integer encodings as aggregates: no bytes are made to compare them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import config as C
from tidemark.functions.columns import LARGEST, bit_length, finite, quantize, quantize_all, varint_length, zigzag


def quantized(series: DataFrame, window: int, bits: int = C.PRECISION) -> DataFrame:
    """series_id, window_no, x, q: fixed windows of quantized values."""
    return series.select(
        "series_id", F.expr(f"idx div {window}").alias("window_no"), F.expr(f"idx % {window}").alias("x"), "value", quantize(F.col("value"), bits).alias("q")
    )


def sizes(q: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row per window: n, and the size of encodings 0, 1, 2, 4 and 5, null where a sample has no integer (``quantize``).
    One shuffle, by window."""
    keys = keys or ["series_id", "window_no"]
    w = Window.partitionBy(*keys).orderBy("x")
    before = F.lag("q", 1).over(w)
    rows = q.withColumns({"z": zigzag(F.col("q")), "d": F.col("q") - F.coalesce(before, F.lit(0))})
    rows = rows.withColumns({"change": F.coalesce(before != F.col("q"), F.lit(True)).cast("long")})
    rows = rows.withColumns({"dd": F.when(F.col("x") < 2, F.col("d")).otherwise(F.col("d") - F.lag("d", 1).over(w)), "run": F.sum("change").over(w)})
    # the length of a run is known at its last row
    last = F.lead("run", 1).over(w)
    run_length = F.row_number().over(w) - F.coalesce(F.max(F.when(F.col("change") == 1, F.row_number().over(w) - 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("length", F.when(last.isNull() | (last != F.col("run")), run_length))
    ends = F.col("length").isNotNull()
    known = lambda size: F.when(F.count("q") == F.count(F.lit(1)), size)
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        known(F.sum(varint_length(F.col("z")))).alias("size_0"),
        known((1 + F.ceil(F.count(F.lit(1)) * F.max(bit_length(F.col("z"))) / 8)).cast("long")).alias("size_1"),
        known(F.sum(varint_length(zigzag(F.col("d"))))).alias("size_2"),
        known(varint_length(F.max("run")) + F.sum(F.when(ends, varint_length(F.col("z")) + varint_length(F.col("length").cast("long"))))).alias("size_4"),
        known(F.sum(varint_length(zigzag(F.col("dd"))))).alias("size_5"),
    )


def outlier_sizes(q: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A row per window: size of encoding 3, null where a sample has no integer or the count of outliers might not fit its
    two bytes. Exact medians, so two groupings."""
    keys = keys or ["series_id", "window_no"]
    w = Window.partitionBy(*keys)
    rows = q.withColumn("z", zigzag(F.col("q"))).withColumn("off", F.abs(F.col("q") - F.median("q").over(w)))
    rows = rows.withColumn("mad", F.median("off").over(w))
    out = (F.col("mad") > 0) & (F.col("off") > C.MAD_FACTOR * F.col("mad"))
    inner = F.max(F.when(out, 1).otherwise(bit_length(F.col("z"))))
    size = (3 + F.sum(F.when(out, 4 + varint_length(F.col("z"))).otherwise(0)) + F.ceil(F.count(F.lit(1)) * inner / 8)).cast("long")
    n = F.count(F.lit(1))
    return rows.groupBy(*keys).agg(F.when((F.count("q") == n) & (n < 65_536), size).alias("size_3"))


def alp_grid() -> list[tuple[int, int, int, float]]:
    """(place, exponent, divisor, scale) of the decimal codec; of equal costs the first place wins."""
    pairs = [(e, f) for e in C.ALP_EXPONENTS for f in C.ALP_FACTORS]
    return [(k, e, f, 10.0**e / f) for k, (e, f) in enumerate(pairs)]


def alp_sizes(series: DataFrame) -> DataFrame:
    """series_id, n, raw_chunks, bytes of the decimal codec. The grid is a column of fixed length, not a join, and what is
    shuffled is one row per chunk and grid place."""
    grid = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("scale")) for k, _, _, s in alp_grid()])
    rows = series.select("series_id", F.expr(f"idx div {C.ALP_CHUNK}").alias("chunk"), "value", F.explode(grid).alias("g"))
    q = F.rint(F.col("value") * F.col("g.scale"))
    fits = (F.abs(q) < C.ALP_LIMIT) & (q / F.col("g.scale") == F.col("value"))
    rows = rows.select("series_id", "chunk", F.col("g.k").alias("k"), fits.alias("fits"), F.when(fits, zigzag(q.cast("long"))).alias("z"))
    each = rows.groupBy("series_id", "chunk", "k").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("fits").alias("fits"), F.max(bit_length(F.col("z"))).alias("width"), F.sum(varint_length(F.col("z"))).alias("body")
    )
    cost = F.struct(F.ceil(F.col("width") * F.col("n") / 8).alias("cost"), "k", "body")
    chunks = each.groupBy("series_id", "chunk").agg(F.first("n").alias("n"), F.min(F.when(F.col("fits"), cost)).alias("best"))
    raw = 5 + 8 * F.col("n")
    packed = F.coalesce(8 + F.col("best.body"), raw)
    return chunks.groupBy("series_id").agg(
        F.sum("n").alias("n"), F.count_if(packed >= raw).alias("raw_chunks"), (4 + F.sum(F.least(packed, raw))).cast("long").alias("bytes")
    )


def closed_forms(series: DataFrame) -> DataFrame:
    """series_id, n, and bytes and largest error of the codecs whose sizes are sums over neighbouring samples: second
    differences at 12 and 16 bits, runs of equal values, blocks of 64 in steps of the bound. One shuffle, by signal."""
    w = Window.partitionBy("series_id").orderBy("idx")
    block = Window.partitionBy("series_id", "block")
    v = F.col("value")
    rows = series.withColumn("block", F.expr("idx div 64")).withColumns({f"q{bits}": quantize_all(v, bits) for bits in (12, 16)})
    rows = rows.withColumn("mean", F.coalesce(F.avg(F.when(finite(v), v)).over(block), F.lit(0.0)))
    rows = rows.withColumns({f"d{bits}": F.col(f"q{bits}") - F.lag(f"q{bits}", 1).over(w) for bits in (12, 16)} | {"same": F.coalesce(F.lag("value", 1).over(w) == v, F.lit(False)) & ~F.isnan(v)})
    rows = rows.withColumns({f"dd{bits}": F.col(f"d{bits}") - F.coalesce(F.lag(f"d{bits}", 1).over(w), F.lit(0)) for bits in (12, 16)})
    step = F.rint((F.when(finite(v), v).otherwise(F.col("mean")) - F.col("mean")) / C.BOUND)
    rows = rows.withColumn("qz", F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), step)).cast("long"))
    out = [F.count(F.lit(1)).alias("n")]
    for bits in (12, 16):
        dd = F.col(f"dd{bits}")
        out.append((F.lit(8) + F.coalesce(F.sum(F.when(dd.isNotNull(), varint_length(zigzag(dd)))), F.lit(0))).alias(f"dod{bits}"))
        out.append(F.max(F.when(finite(v), F.abs(v - F.col(f"q{bits}") / float(1 << bits)))).alias(f"dod{bits}_error"))
    out.append((12 * F.sum((~F.col("same")).cast("long"))).alias("rle"))
    # 16 bytes for length, step and size of a block, and 12 a block for its mean and length
    out.append((16 + 12 * F.countDistinct("block") + F.sum(varint_length(zigzag(F.col("qz"))))).alias("zfp"))
    out.append(F.max(F.when(finite(v), F.abs(v - F.col("mean") - F.col("qz") * C.BOUND))).alias("zfp_error"))
    return rows.groupBy("series_id").agg(*out)
