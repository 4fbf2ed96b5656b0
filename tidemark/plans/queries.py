"""The engine's queries by name, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.functions import blocks, codec, config as C
from tidemark.functions.columns import error_text, finite, quantize, ratio_text, size_text, varint_length, zigzag
from tidemark.operators import sizes as S
from tidemark.operators import windows as T
from tidemark.sources import synthetic
from tidemark.sources.files import pack_containers, unpack_containers
from tidemark.sources.series import events

# Where a rounded value may end in exactly 5, both sides add 1e-7 first: engines sum in different orders.
#: Samples in a fixed window, and in a block, of the queries over the short test signals.
FIXED, BLOCK = 16, 1000

_SERIES = "WITH s AS (SELECT user_id::VARCHAR AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value FROM events WHERE value IS NOT NULL)"
_ZZ = lambda e: f"(CASE WHEN {e} >= 0 THEN 2 * ({e}) ELSE -2 * ({e}) - 1 END)"
_LEN = lambda z: f"greatest(1, CASE WHEN {z} = 0 THEN 1 ELSE length(ltrim(bin({z}), '0')) END)"
_VL = lambda z: f"CAST(ceil({_LEN(z)} / 7.0) AS BIGINT)"
_Q = _SERIES + f", q AS (SELECT series_id, idx // {FIXED} AS window_no, idx % {FIXED} AS x, value, CASE WHEN isfinite(value) AND abs(value * 65536) < pow(2, 59) THEN CAST(round_even(value * 65536, 0) AS BIGINT) END AS q FROM s)"
_Z = _Q + f", d AS (SELECT *, q - coalesce(lag(q) OVER w, 0) AS d, {_ZZ('q')} AS z, coalesce(lag(q) OVER w <> q, true)::INT AS c FROM q WINDOW w AS (PARTITION BY series_id, window_no ORDER BY x))"
_Z += f", e AS (SELECT *, CASE WHEN x < 2 THEN d ELSE d - lag(d) OVER w END AS dd, sum(c) OVER w AS run FROM d WINDOW w AS (PARTITION BY series_id, window_no ORDER BY x)), f AS (SELECT *, {_ZZ('d')} AS zd, {_ZZ('dd')} AS zdd FROM e)"
#: A window in which a sample has no integer has no integer encoding.
_KNOWN = lambda e: f"CASE WHEN count(q) = count(*) THEN {e} END"
_RUNS = f", r AS (SELECT series_id, window_no, run, min(z) AS z, min(q) AS q, count(*) AS n FROM f GROUP BY ALL), size4 AS (SELECT series_id, window_no, {_KNOWN(_VL('max(run)::BIGINT') + ' + sum(' + _VL('z') + ' + ' + _VL('n') + ')')} AS size_4 FROM r GROUP BY ALL)"
_SIZES = _Z + _RUNS + f""", a AS (SELECT series_id, window_no, count(*) AS n, {_KNOWN('sum(' + _VL('z') + ')::BIGINT')} AS size_0, {_KNOWN('CAST(1 + ceil(count(*) * max(' + _LEN('z') + ') / 8.0) AS BIGINT)')} AS size_1,
  {_KNOWN('sum(' + _VL('zd') + ')::BIGINT')} AS size_2, {_KNOWN('sum(' + _VL('zdd') + ')::BIGINT')} AS size_5 FROM f GROUP BY ALL)"""
_MAD = _Z + f""", m AS (SELECT *, abs(q - median(q) OVER w) AS off FROM f WINDOW w AS (PARTITION BY series_id, window_no)), m2 AS (SELECT *, median(off) OVER (PARTITION BY series_id, window_no) AS mad FROM m),
 m3 AS (SELECT *, mad > 0 AND off > 4.5 * mad AS o FROM m2), b AS (SELECT series_id, window_no, CASE WHEN count(q) = count(*) THEN CAST(3 + sum(CASE WHEN o THEN 4 + {_VL('z')} ELSE 0 END) + ceil(count(*) * max(CASE WHEN o THEN 1 ELSE {_LEN('z')} END) / 8.0) AS BIGINT) END AS size_3 FROM m3 GROUP BY ALL)"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quantized(events(spark, sf_dir), FIXED)


def _dod(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    """Second differences of each whole series: first value in 8 bytes, varints after it."""
    return S.closed_forms(events(spark, sf_dir)).select(
        "series_id", "n", F.col(f"dod{bits}").alias("bytes"), F.round(8 * F.col("n") / F.col(f"dod{bits}"), 6).alias("ratio"), F.round(f"dod{bits}_error", 9).alias("max_error")
    )


_WHOLE = lambda scale: f"CAST(round_even(greatest(-pow(2, 59), least(pow(2, 59), CASE WHEN isfinite(value) THEN value ELSE 0 END * {scale})), 0) AS BIGINT)"


def _dod_sql(bits: int) -> str:
    return _SERIES + f""", q AS (SELECT *, {_WHOLE(1 << bits)} AS q FROM s), d AS (SELECT *, q - lag(q) OVER (PARTITION BY series_id ORDER BY idx) AS d FROM q),
 e AS (SELECT *, d - coalesce(lag(d) OVER (PARTITION BY series_id ORDER BY idx), 0) AS dd FROM d), g AS (SELECT *, {_ZZ('dd')} AS z FROM e)
 SELECT series_id, count(*) AS n, 8 + coalesce(sum(CASE WHEN dd IS NULL THEN NULL ELSE {_VL('z')} END), 0)::BIGINT AS bytes, round(8 * count(*) / (8 + coalesce(sum(CASE WHEN dd IS NULL THEN NULL ELSE {_VL('z')} END), 0)::BIGINT), 6) AS ratio,
 round(max(CASE WHEN isfinite(value) THEN abs(value - q / {1 << bits}.0) END), 9) AS max_error FROM g GROUP BY series_id"""


@query(_dod_sql(16))
def dod16(spark, sf_dir):
    return _dod(spark, sf_dir, 16)


@query(_dod_sql(12))
def dod12(spark, sf_dir):
    return _dod(spark, sf_dir, 12)


flagship = dod16


@query(_SERIES + f" SELECT series_id, idx // {BLOCK} AS block_no, count(*) AS n FROM s GROUP BY ALL")
def chunk_counts(spark, sf_dir):
    return events(spark, sf_dir).groupBy("series_id", F.expr(f"idx div {BLOCK}").alias("block_no")).agg(F.count(F.lit(1)).alias("n"))


@query(_Q + " SELECT series_id, window_no, count(*) AS n, round(var_pop(value) + 1e-7, 3) AS variance FROM q GROUP BY ALL")
def fixed_windows_variance(spark, sf_dir):
    return _fixed(spark, sf_dir).groupBy("series_id", "window_no").agg(F.count(F.lit(1)).alias("n"), F.round(F.var_pop("value") + 1e-7, 3).alias("variance"))


@query(_SERIES + " SELECT series_id, count(*) AS n, CASE WHEN count(*) < 5000 THEN 512 WHEN count(*) < 100000 THEN 1024 ELSE 4096 END AS cap FROM s GROUP BY series_id")
def adaptive_cap(spark, sf_dir):
    n = F.count(F.lit(1))
    return events(spark, sf_dir).groupBy("series_id").agg(n.alias("n"), F.when(n < 5000, 512).when(n < 100_000, 1024).otherwise(4096).alias("cap"))


@query(_Q + " SELECT series_id, window_no, round(avg(value), 6) AS mean, round(sum(value * value) - sum(value) * avg(value), 4) AS ssr FROM q GROUP BY ALL")
def fit_constant(spark, sf_dir):
    v = F.col("value")
    return _fixed(spark, sf_dir).groupBy("series_id", "window_no").agg(F.round(F.avg(v), 6).alias("mean"), F.round(F.sum(v * v) - F.sum(v) * F.avg(v), 4).alias("ssr"))


@query(_Q + " SELECT series_id, window_no, round(CASE WHEN count(*) < 2 THEN 0 ELSE regr_slope(value, x) END + 1e-7, 4) AS slope, round(coalesce(regr_intercept(value, x), min(value)) + 1e-7, 4) AS intercept FROM q GROUP BY ALL")
def fit_linear(spark, sf_dir):
    return _fixed(spark, sf_dir).groupBy("series_id", "window_no").agg(
        F.round(F.coalesce(F.regr_slope("value", "x"), F.lit(0.0)) + 1e-7, 4).alias("slope"), F.round(F.coalesce(F.regr_intercept("value", "x"), F.min("value")) + 1e-7, 4).alias("intercept")
    )


_QUAD = """ , u AS (SELECT *, x - avg(x) OVER w AS t, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY series_id, window_no)),
 m AS (SELECT series_id, window_no, count(*)::DOUBLE AS n, sum(t*t) AS s2, sum(t*t*t) AS s3, sum(t*t*t*t) AS s4, sum(value) AS y0, sum(t*value) AS y1, sum(t*t*value) AS y2 FROM u WHERE n >= 4 GROUP BY ALL)
 SELECT series_id, window_no, round((y2 * n * s2 - y1 * n * s3 - y0 * s2 * s2) / (s4 * n * s2 - n * s3 * s3 - s2 * s2 * s2), 5) AS a FROM m"""


@query(_Q + _QUAD)
def fit_quadratic(spark, sf_dir):
    """Leading coefficient by moments of centred x, so that the equations stay well conditioned."""
    w = Window.partitionBy("series_id", "window_no")
    u = _fixed(spark, sf_dir).withColumns({"t": F.col("x") - F.avg("x").over(w), "n": F.count(F.lit(1)).over(w)}).filter("n >= 4")
    m = u.groupBy("series_id", "window_no").agg(
        F.count(F.lit(1)).cast("double").alias("n"), *[F.expr(f"sum({e})").alias(k) for k, e in {"s2": "t*t", "s3": "t*t*t", "s4": "t*t*t*t", "y0": "value", "y1": "t*value", "y2": "t*t*value"}.items()]
    )
    return m.select("series_id", "window_no", F.expr("round((y2*n*s2 - y1*n*s3 - y0*s2*s2) / (s4*n*s2 - n*s3*s3 - s2*s2*s2), 5)").alias("a"))


@F.pandas_udf(LongType())
def _set_bits(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bits in which two values differ."""
    return pd.Series(np.bitwise_count(codec.bits(a.to_numpy()) ^ codec.bits(b.to_numpy())).astype(np.int64))


@query(_SERIES + ", l AS (SELECT *, lag(value) OVER (PARTITION BY series_id ORDER BY idx) AS p FROM s) SELECT series_id, coalesce(sum(bit_count(xor(value::BIT, p::BIT))), 0)::BIGINT AS bits, count(*) AS n FROM l GROUP BY series_id")
def xor_delta_popcount(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("idx")
    s = events(spark, sf_dir).withColumn("p", F.lag("value", 1).over(w)).withColumn("b", F.when(F.col("p").isNotNull(), _set_bits("value", "p")))
    return s.groupBy("series_id").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bits"), F.count(F.lit(1)).alias("n"))


@query(_SERIES + ", l AS (SELECT *, lag(value) OVER w AS p, lag(value, 2) OVER w AS pp FROM s WINDOW w AS (PARTITION BY series_id ORDER BY idx)) SELECT series_id, coalesce(sum(CASE WHEN pp IS NOT NULL THEN bit_count(xor(value::BIT, (2.0::DOUBLE * p - pp)::BIT)) END), 0)::BIGINT AS bits, count(*) AS n FROM l GROUP BY series_id")
def pred_xor_popcount(spark, sf_dir):
    w = Window.partitionBy("series_id").orderBy("idx")
    s = events(spark, sf_dir).withColumn("g", 2.0 * F.lag("value", 1).over(w) - F.lag("value", 2).over(w)).withColumn("b", F.when(F.col("g").isNotNull(), _set_bits("value", "g")))
    return s.groupBy("series_id").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("bits"), F.count(F.lit(1)).alias("n"))


_SELECT = f""", l AS (SELECT *, lag(value) OVER v AS p, lag(value, 2) OVER v AS pp, avg(value) OVER w AS m, x - avg(x) OVER w AS t, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY series_id, window_no), v AS (PARTITION BY series_id, window_no ORDER BY x)),
 l2 AS (SELECT *, t * t - avg(t * t) OVER w AS sq FROM l WINDOW w AS (PARTITION BY series_id, window_no)),
 l3 AS (SELECT *, coalesce(sum(t * value) OVER w / nullif(sum(t * t) OVER w, 0), 0) AS slope, CASE WHEN n >= 4 THEN sum(sq * value) OVER w / sum(sq * sq) OVER w END AS a FROM l2 WINDOW w AS (PARTITION BY series_id, window_no)),
 l4 AS (SELECT series_id, window_no, n, sum((value - m) ** 2) AS c, sum((value - m - slope * t) ** 2) AS l, coalesce(sum((value - m - slope * t - a * sq) ** 2), 'inf'::DOUBLE) AS q,
  coalesce(sum(bit_count(xor(value::BIT, p::BIT))), 0) AS one, CASE WHEN n >= 3 THEN coalesce(sum(CASE WHEN pp IS NOT NULL THEN bit_count(xor(value::BIT, (2.0::DOUBLE * p - pp)::BIT)) END), 0) END AS two FROM l3 GROUP BY series_id, window_no, n),
 l5 AS (SELECT *, least(c, l, q) AS best, CASE WHEN two < one THEN two ELSE one END AS bits FROM l4), l6 AS (SELECT *, CASE WHEN c <= {C.CONSTANT_PREFERENCE} * best THEN c ELSE best END AS chosen FROM l5)
 SELECT series_id, window_no, CASE WHEN bits <= {C.XOR_PREFERENCE} * chosen THEN CASE WHEN two < one THEN {C.PRED_XOR} ELSE {C.XOR} END WHEN c <= {C.CONSTANT_PREFERENCE} * best THEN {C.CONSTANT} WHEN l <= q THEN {C.LINEAR} ELSE {C.QUADRATIC} END AS model_id FROM l6"""


@query(_Q + _SELECT)
def model_select(spark, sf_dir):
    """Model of each fixed window; these are too short for a sinusoid."""

    def f(part):
        n = np.array([len(y) for _, _, y in part])
        model, _, _ = blocks.choose_models(np.concatenate([y for _, _, y in part]), np.cumsum(n) - n, n)
        return pa.table({"series_id": [name for name, _, _ in part], "window_no": [at // FIXED for _, at, _ in part], "model_id": pa.array(model, pa.int32())})

    return T.by_block(events(spark, sf_dir), FIXED, f, "series_id string, window_no long, model_id int")


#: Samples of the windows in which frequencies are looked for.
WAVE = 32
_WAVE = _SERIES + f""", w AS (SELECT series_id, idx // {WAVE} AS block_no, idx % {WAVE} AS x, value, count(*) OVER (PARTITION BY series_id, idx // {WAVE}) AS n FROM s), k AS (SELECT unnest(range(1, {WAVE // 2 + 1})) AS k),
 p AS (SELECT series_id, block_no, k, sum(value * cos(2 * pi() * k * x / {WAVE})) ** 2 + sum(value * sin(2 * pi() * k * x / {WAVE})) ** 2 AS power FROM w, k WHERE n = {WAVE} GROUP BY ALL)
 SELECT series_id, block_no, arg_max(k, power)::INT AS cycles FROM p GROUP BY ALL"""


@query(_WAVE)
def dominant_frequency(spark, sf_dir):
    """Cycles of the strongest wave in each full window of 32 samples."""
    return T.per_block(events(spark, sf_dir), WAVE, lambda y: (round(codec.dominant_frequency(y) * WAVE) if len(y) == WAVE else None,), "cycles int").filter("cycles is not null")


@query()
def fit_sinusoid(spark, sf_dir):
    def f(y: np.ndarray) -> tuple:
        p = codec.fit_sinusoid(y) if len(y) >= C.SINUSOID_WINDOW else None
        return ([] if p is None else [round(float(v), 6) for v in p],)

    return T.per_block(events(spark, sf_dir), WAVE, f, "params array<double>")


@query()
def adaptive_segmentation(spark, sf_dir):
    return T.per_block(events(spark, sf_dir), BLOCK, lambda y: ([n for _, n in codec.segment(y)], len(y)), "lengths array<long>, n long")


_PREC = "CASE WHEN r < 1e-15 THEN 8 ELSE CAST(least(20, greatest({floor}, least(least(20, greatest(8, {req})), CASE WHEN r < 1 THEN greatest(8, ceil(-log2(r + 1e-30)) + 4) ELSE greatest({req}, 16) END))) AS INT) END"
_RES = _Q + ", g AS (SELECT series_id, window_no, max(abs(value - m)) AS r, count(*) AS n FROM (SELECT *, avg(value) OVER (PARTITION BY series_id, window_no) AS m FROM q) GROUP BY ALL)"


def _residual(spark, sf_dir):
    w = Window.partitionBy("series_id", "window_no")
    r = _fixed(spark, sf_dir).withColumn("r", F.abs(F.col("value") - F.avg("value").over(w)))
    return r.groupBy("series_id", "window_no").agg(F.max("r").alias("r"), F.count(F.lit(1)).alias("n"))


@query(_RES + f" SELECT series_id, window_no, {_PREC.format(floor=16, req=16)} AS precision_bits FROM g")
def select_precision(spark, sf_dir):
    return _residual(spark, sf_dir).select("series_id", "window_no", F.expr(_PREC.format(floor=16, req=16)).cast("int").alias("precision_bits"))


@query(_RES + f" SELECT precision_bits, count(*) AS windows, sum(n)::BIGINT AS samples FROM (SELECT n, {_PREC.format(floor=8, req=12)} AS precision_bits FROM g) GROUP BY precision_bits")
def precision_histogram(spark, sf_dir):
    p = _residual(spark, sf_dir).select("n", F.expr(_PREC.format(floor=8, req=12)).cast("int").alias("precision_bits"))
    return p.groupBy("precision_bits").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("samples"))


@query(_RES + f" SELECT round(sum(n * precision_bits) / sum(n), 6) AS mean_precision FROM (SELECT n, {_PREC.format(floor=8, req=12)} AS precision_bits FROM g)")
def mean_precision(spark, sf_dir):
    p = _residual(spark, sf_dir).select("n", F.expr(_PREC.format(floor=8, req=12)).cast("int").alias("precision_bits"))
    return p.agg(F.round(F.sum(F.col("n") * F.col("precision_bits")) / F.sum("n"), 6).alias("mean_precision"))


@query(_SERIES + " SELECT p, count(*) AS n, round(max(abs(value - round_even(value * pow(2, p), 0) / pow(2, p))), 9) AS max_error FROM s, (SELECT unnest([8,10,12,14,16,18,20]) AS p) WHERE isfinite(value) AND abs(value * pow(2, p)) < pow(2, 59) GROUP BY p")
def precision_sweep(spark, sf_dir):
    """Seven precisions against all samples: the sweep is a column of seven values, not a join."""
    s = events(spark, sf_dir).withColumn("p", F.explode(F.array(*map(F.lit, (8, 10, 12, 14, 16, 18, 20)))))
    s = s.withColumn("q", quantize(F.col("value"), F.col("p"))).filter("q is not null")
    return s.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("value") - F.col("q") / F.pow(F.lit(2.0), "p"))), 9).alias("max_error"))


@query()
def codec_sweep(spark, sf_dir):
    """Precisions asked for, with the bound held (16 bits) and without it: bytes, ratio, errors and mean precision."""
    rows = T.sweep(events(spark, sf_dir), [(C.PRECISION, True), *((p, False) for p in range(C.MIN_PRECISION, C.MAX_PRECISION + 1, 2))], BLOCK)
    n, size = F.sum("n"), F.sum("bytes")
    return rows.groupBy("requested", "enforced").agg(
        n.alias("n"), size.alias("bytes"), F.round(8 * n / size, 6).alias("ratio"), F.max("max_error").alias("max_error"), (F.sum("abs_sum") / n).alias("mae"), F.sqrt(F.sum("square_sum") / n).alias("rmse"), F.round(F.sum("bits_sum") / n, 6).alias("mean_precision")
    ).orderBy("requested", "enforced")


for _k, _name in ((0, "size_zigzag_varint"), (1, "size_bitpack"), (2, "size_delta"), (4, "size_rle"), (5, "size_dod")):

    def _one(spark, sf_dir, k=_k):
        return S.sizes(_fixed(spark, sf_dir)).select("series_id", "window_no", F.col(f"size_{k}").cast("long").alias("bytes"))

    _one.__name__ = _name
    query(_SIZES + (f" SELECT series_id, window_no, size_{_k}::BIGINT AS bytes FROM {'size4' if _k == 4 else 'a'}"))(_one)


@query(_MAD + " SELECT series_id, window_no, size_3 AS bytes FROM b")
def size_mad_outlier(spark, sf_dir):
    return S.outlier_sizes(_fixed(spark, sf_dir)).select("series_id", "window_no", F.col("size_3").alias("bytes"))


_ALL = _MAD + _RUNS + _SIZES[len(_Z + _RUNS) :]
_BEST = " SELECT series_id, window_no, n, bytes::BIGINT AS bytes, encoding_id FROM (SELECT a.series_id, a.window_no, n, unnest([size_0, size_1, size_2, CASE WHEN n >= 8 THEN size_3 END, size_4, size_5, CASE WHEN size_0 IS NULL THEN 8 * n - 7 END]) AS bytes, unnest([0,1,2,3,4,5,-1]) AS encoding_id FROM a JOIN b USING (series_id, window_no) JOIN size4 USING (series_id, window_no)) QUALIFY row_number() OVER (PARTITION BY series_id, window_no ORDER BY bytes NULLS LAST, encoding_id) = 1"


def _trial(spark, sf_dir):
    """The smallest encoding of each window; -1 stands for XOR words, where a sample has no integer."""
    q = _fixed(spark, sf_dir)
    both = S.sizes(q).join(S.outlier_sizes(q), ["series_id", "window_no"])
    size = {k: F.col(f"size_{k}") for k in (0, 1, 2, 4, 5)} | {3: F.when(F.col("n") >= C.MAD_LENGTH, F.col("size_3")), -1: F.when(F.col("size_0").isNull(), 8 * F.col("n") - 7)}
    options = [F.when(v.isNotNull(), F.struct(v.cast("long").alias("bytes"), F.lit(k).alias("encoding_id"))) for k, v in size.items()]
    return both.withColumn("best", F.array_min(F.array_compact(F.array(*options)))).select("series_id", "window_no", "n", "best.bytes", "best.encoding_id")


@query(_ALL + _BEST)
def trial_encode(spark, sf_dir):
    return _trial(spark, sf_dir)


@query(_ALL + f", t AS ({_BEST}) SELECT encoding_id, count(*) AS windows, sum(bytes)::BIGINT AS bytes FROM t GROUP BY encoding_id")
def encoding_histogram(spark, sf_dir):
    return _trial(spark, sf_dir).groupBy("encoding_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("bytes").alias("bytes"))


@query(_SERIES + " SELECT series_id, idx, value FROM s")
def full_round_trip(spark, sf_dir):
    """Decoded samples, rounded to four decimals: half a unit there is six times the error bound, and the source has two."""
    return T.decompress(T.compress(events(spark, sf_dir), BLOCK)).select("series_id", "idx", F.round("value", 4).alias("value"))


@query()
def error_metrics(spark, sf_dir):
    s = events(spark, sf_dir)
    return T.errors(s, T.decompress(T.compress(s, BLOCK)))


@query(_SERIES + " SELECT series_id, count(*) AS n, 0::BIGINT AS missing, true AS within_bound FROM s GROUP BY series_id")
def error_bound(spark, sf_dir):
    return error_metrics(spark, sf_dir).select("series_id", "n", "missing", (F.col("max_error") < C.BOUND).alias("within_bound"))


_CHOICE = _SERIES + f""", m AS (SELECT *, idx // {BLOCK} AS block_no, value - avg(value) OVER (PARTITION BY series_id, idx // {BLOCK}) AS r FROM s), g AS (SELECT *, max(abs(r)) OVER (PARTITION BY series_id, block_no) AS top FROM m),
 p AS (SELECT *, {_PREC.format(floor=16, req=16).replace('r < ', 'top < ').replace('(r + ', '(top + ')} AS bits FROM g), q AS (SELECT *, CAST(round_even(r * pow(2, bits), 0) AS BIGINT) AS q FROM p),
 d AS (SELECT *, q - coalesce(lag(q) OVER w, 0) AS d FROM q WINDOW w AS (PARTITION BY series_id, block_no ORDER BY idx)), e AS (SELECT *, CASE WHEN idx % {BLOCK} < 2 THEN d ELSE d - lag(d) OVER w END AS dd FROM d WINDOW w AS (PARTITION BY series_id, block_no ORDER BY idx)), z AS (SELECT *, {_ZZ('dd')} AS z, abs(r - q / pow(2, bits)) AS e FROM e)
 SELECT series_id, block_no, count(*) AS n, (19 + sum({_VL('z')}))::BIGINT AS bytes, any_value(bits) AS precision_bits, round(max(e), 9) AS max_error, round(avg(e), 9) AS mae, round(sqrt(avg(e * e)), 9) AS rmse FROM z GROUP BY ALL"""


@query(_CHOICE)
def block_dod(spark, sf_dir):
    """The record of a whole block by second differences from its mean: exact bytes and errors, without coding it."""
    w = Window.partitionBy("series_id", "block_no")
    line = w.orderBy("idx")
    s = events(spark, sf_dir).withColumn("block_no", F.expr(f"idx div {BLOCK}"))
    s = s.withColumn("r", F.col("value") - F.avg("value").over(w)).withColumn("top", F.max(F.abs("r")).over(w))
    s = s.withColumn("bits", F.expr(_PREC.format(floor=16, req=16).replace("r < ", "top < ").replace("(r + ", "(top + ")).cast("int"))
    s = s.withColumn("q", quantize(F.col("r"), F.col("bits"))).withColumn("d", F.col("q") - F.coalesce(F.lag("q", 1).over(line), F.lit(0)))
    s = s.withColumn("dd", F.when(F.expr(f"idx % {BLOCK}") < 2, F.col("d")).otherwise(F.col("d") - F.lag("d", 1).over(line)))
    e = F.abs(F.col("r") - F.col("q") / F.pow(F.lit(2.0), "bits"))
    return s.groupBy("series_id", "block_no").agg(
        F.count(F.lit(1)).alias("n"), (19 + F.sum(varint_length(zigzag(F.col("dd"))))).alias("bytes"), F.first("bits").alias("precision_bits"), F.round(F.max(e), 9).alias("max_error"), F.round(F.avg(e), 9).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 9).alias("rmse")
    )


@query()
def model_histogram(spark, sf_dir):
    return T.compress(events(spark, sf_dir), BLOCK).groupBy("model_id", "encoding_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("n_bytes").alias("bytes"))


_FINE = "value) FILTER (isfinite(value)"


@query(_SERIES + f" SELECT series_id, count(*) AS n, round(avg({_FINE}), 6) AS mean, round(stddev_pop({_FINE}), 6) AS std, min({_FINE}) AS lo, max({_FINE}) AS hi, count(*) FILTER (NOT isfinite(value)) AS odd FROM s GROUP BY series_id")
def signal_stats(spark, sf_dir):
    """Over finite samples; the others are counted."""
    v = F.when(finite(F.col("value")), F.col("value"))
    return events(spark, sf_dir).groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(~finite(F.col("value"))).alias("odd"))


@query(_SERIES + ", e AS (SELECT abs(value * 65536 - round_even(value * 65536, 0)) AS e FROM s WHERE isfinite(value)) SELECT least(99, floor(e * 200))::INT AS bin, count(*) AS n FROM e GROUP BY ALL")
def error_histogram(spark, sf_dir):
    e = F.abs(F.col("value") * 65536 - F.rint(F.col("value") * 65536))
    fine = events(spark, sf_dir).filter(finite(F.col("value")))
    return fine.groupBy(F.least(F.lit(99), F.floor(e * 200)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(_SERIES + ", r AS (SELECT series_id, value - avg(value) OVER (PARTITION BY series_id) AS r FROM s WHERE isfinite(value)) SELECT series_id, round(avg(r) + 1e-7, 4) AS mean, round(stddev_pop(r), 4) AS std, round(median(r), 4) AS middle, round(quantile_cont(r, 0.99), 4) AS p99 FROM r GROUP BY series_id")
def residual_percentiles(spark, sf_dir):
    r = events(spark, sf_dir).filter(finite(F.col("value"))).withColumn("r", F.col("value") - F.avg("value").over(Window.partitionBy("series_id")))
    return r.groupBy("series_id").agg(F.round(F.avg("r") + 1e-7, 4).alias("mean"), F.round(F.stddev_pop("r"), 4).alias("std"), F.round(F.median("r"), 4).alias("middle"), F.round(F.percentile("r", 0.99), 4).alias("p99"))


_RLE = _SERIES + ", c AS (SELECT series_id, CASE WHEN lag(value) OVER (PARTITION BY series_id ORDER BY idx) = value AND NOT isnan(value) THEN 0 ELSE 1 END AS c FROM s) SELECT series_id, sum(c)::BIGINT AS runs, 12 * sum(c)::BIGINT AS bytes FROM c GROUP BY series_id"


@query(_RLE)
def float_rle(spark, sf_dir):
    """Runs of equal values, 12 bytes each; a NaN never continues a run."""
    w = Window.partitionBy("series_id").orderBy("idx")
    same = F.coalesce(F.lag("value", 1).over(w) == F.col("value"), F.lit(False)) & ~F.isnan("value")
    c = events(spark, sf_dir).withColumn("c", F.when(same, 0).otherwise(1))
    return c.groupBy("series_id").agg(F.sum("c").alias("runs"), (12 * F.sum("c")).alias("bytes"))


@query(_SERIES + f", m AS (SELECT *, idx // 64 AS block, coalesce(avg(value) FILTER (isfinite(value)) OVER (PARTITION BY series_id, idx // 64), 0) AS mean FROM s), b AS (SELECT *, CAST(round_even(greatest(-pow(2, 59), least(pow(2, 59), (CASE WHEN isfinite(value) THEN value ELSE mean END - mean) / 8e-6)), 0) AS BIGINT) AS q FROM m), z AS (SELECT *, {_ZZ('q')} AS z FROM b) SELECT series_id, (16 + 12 * count(DISTINCT block) + sum({_VL('z')}))::BIGINT AS bytes FROM z GROUP BY series_id")
def zfp_style(spark, sf_dir):
    """Blocks of 64 as steps of the bound from their mean; samples that aren't finite count as the mean."""
    return S.closed_forms(events(spark, sf_dir)).select("series_id", F.col("zfp").alias("bytes"))


@query()
def gorilla(spark, sf_dir):
    return T.per_series(events(spark, sf_dir), lambda y: ((codec.gorilla_bits(y) + 7) // 8, len(y)), "bytes long, n long")


@query()
def sz3_style(spark, sf_dir):
    def f(y):
        data, back = codec.sz3_style(y)
        fine = np.isfinite(y)
        return len(data), bool(np.abs(back[fine] - y[fine]).max(initial=0) <= C.BOUND / 2 + 1e-12)

    return T.per_series(events(spark, sf_dir), f, "bytes long, within boolean")


@query()
def gzip_zlib(spark, sf_dir):
    return T.per_series(events(spark, sf_dir), lambda y: (len(gzip.compress(y.astype("<f8").tobytes(), 6, mtime=0)), len(zlib.compress(y.astype("<f8").tobytes(), 9))), "gzip_bytes long, zlib_bytes long")


@query(_SERIES + f" SELECT DISTINCT series_id, idx // {BLOCK} AS block_no, true AS intact, true AS damage_found FROM s")
def container_round_trip(spark, sf_dir):
    """Written and read again, and with a byte changed."""

    def f(y):
        data = codec.pack_container(codec.encode_block(y), C.PRECISION, BLOCK)
        back = blocks.decode_windows(codec.unpack_container(data))
        bad = bytearray(data)
        bad[len(bad) // 2] ^= 255
        try:
            codec.unpack_container(bytes(bad))
            found = False
        except ValueError:
            found = True
        return bool(np.abs(back - y).max() < C.BOUND), found

    return T.per_block(events(spark, sf_dir), BLOCK, f, "intact boolean, damage_found boolean")


@query()
def elf_style(spark, sf_dir):
    """The same bit stream written and read again."""

    def f(y):
        data = codec.xor_pack(y)
        return len(data), len(y), bool(np.array_equal(codec.bits(codec.xor_unpack(data, len(y))), codec.bits(y)))

    return T.per_series(events(spark, sf_dir), f, "bytes long, n long, intact boolean")


def _alp_sql() -> str:
    grid = ", ".join(f"({k}, '{s!r}'::DOUBLE)" for k, _, _, s in S.alp_grid())
    return _SERIES + f""", g(k, scale) AS (VALUES {grid}), x AS (SELECT series_id, idx // {C.ALP_CHUNK} AS chunk, k, value, scale, round_even(value * scale, 0) AS r FROM s CROSS JOIN g),
 y AS (SELECT series_id, chunk, k, abs(r) < pow(2, 62) AND r / scale = value AS fits, CASE WHEN abs(r) < pow(2, 62) THEN CAST(r AS BIGINT) END AS q FROM x),
 z AS (SELECT *, CASE WHEN fits THEN {_ZZ('q')} END AS z FROM y), e AS (SELECT series_id, chunk, k, count(*) AS n, bool_and(fits) AS fits, ceil(count(*) * max({_LEN('z')}) / 8.0) AS cost, sum({_VL('z')}) AS body FROM z GROUP BY ALL),
 c AS (SELECT series_id, chunk, any_value(n) AS n, 5 + 8 * any_value(n) AS raw, 8 + arg_min(body, (cost, k)) FILTER (fits) AS packed FROM e GROUP BY ALL)
 SELECT series_id, sum(n)::BIGINT AS n, count(*) FILTER (coalesce(packed, raw) >= raw) AS raw_chunks, (4 + sum(least(coalesce(packed, raw), raw)))::BIGINT AS bytes FROM c GROUP BY series_id"""


@query(_alp_sql())
def alp_style(spark, sf_dir):
    return S.alp_sizes(events(spark, sf_dir))


@query(_SERIES + " SELECT series_id, idx, value FROM s WHERE idx >= 5 AND idx < 40 AND value >= 100")
def range_scan(spark, sf_dir):
    """Samples of a range of places and values, from the windows that can hold them."""
    found = T.scan(T.compress(events(spark, sf_dir), BLOCK), 5, 40, lowest=100 - C.BOUND)
    return found.withColumn("value", F.round("value", 4)).filter("value >= 100")


@query(_SERIES + " SELECT series_id, idx, value FROM s")
def container_files(spark, sf_dir):
    """Signals packed into containers, a row each, and unpacked."""
    packed = pack_containers(T.compress(events(spark, sf_dir), BLOCK), BLOCK)
    return unpack_containers(packed).withColumn("value", F.round("value", 4))


#: Codecs whose bytes are sums in SQL; all others are measured by coding.
CLOSED = ("dod12", "dod16", "rle", "zfp", "alp")
CODECS = (*CLOSED, "gorilla", "elf", "sz3", "gzip", "zlib", "zstd", "snappy", "tidemark")


def _closed(series: DataFrame) -> DataFrame:
    """series_id, codec, n, bytes, max_error of the codecs of ``CLOSED``; errors of lossless ones are 0."""
    both = S.closed_forms(series).join(S.alp_sizes(series).select("series_id", F.col("bytes").alias("alp")), "series_id")
    error = {"dod12": F.col("dod12_error"), "dod16": F.col("dod16_error"), "zfp": F.col("zfp_error")}
    each = F.array(*[F.struct(F.lit(c).alias("codec"), F.col(c).cast("long").alias("bytes"), F.coalesce(error.get(c, F.lit(0.0)), F.lit(0.0)).alias("max_error")) for c in CLOSED])
    return both.select("series_id", "n", F.explode(each).alias("c")).select("series_id", "c.codec", "n", "c.bytes", "c.max_error")


def measured(y: np.ndarray) -> dict[str, tuple[int, float]]:
    """(bytes, largest error over finite samples) of the codecs that carry state over a whole signal."""
    raw = y.astype("<f8").tobytes()
    packed, back = codec.sz3_style(y)
    fine = np.isfinite(y)
    return {
        "gorilla": ((codec.gorilla_bits(y) + 7) // 8, 0.0), "elf": (len(codec.xor_pack(y)), 0.0), "sz3": (len(packed), float(np.abs(back[fine] - y[fine]).max(initial=0))),
        "gzip": (len(gzip.compress(raw, 6, mtime=0)), 0.0), "zlib": (len(zlib.compress(raw, 9)), 0.0),
        "zstd": (len(pa.Codec("zstd", 19).compress(raw, asbytes=True)), 0.0), "snappy": (len(pa.Codec("snappy").compress(raw, asbytes=True)), 0.0),
    }


def compare(series: DataFrame, chunk: int = C.CHUNK) -> DataFrame:
    """series_id, codec, n, bytes, max_error of all of ``CODECS``. The engine's own bytes are those of its containers."""

    def f(y: np.ndarray) -> tuple:
        return (len(y), [{"codec": k, "bytes": b, "max_error": e} for k, (b, e) in measured(y).items()])

    other = T.per_series(series, f, "n long, c array<struct<bytes:long,codec:string,max_error:double>>")
    other = other.select("series_id", "n", F.explode("c").alias("c")).select("series_id", "c.codec", "n", "c.bytes", "c.max_error")
    windows = T.compress(series, chunk)
    own = pack_containers(windows, chunk).groupBy("series_id").agg(F.sum("n").alias("n"), F.sum(F.octet_length("content")).alias("bytes"))
    own = own.join(T.errors(series, T.decompress(windows)).select("series_id", "max_error"), "series_id")
    return _closed(series).unionByName(other).unionByName(own.withColumn("codec", F.lit("tidemark")))


@query()
def codec_comparison(spark, sf_dir):
    return compare(events(spark, sf_dir), BLOCK).withColumns({"ratio": F.round(8 * F.col("n") / F.col("bytes"), 6), "max_error": F.round("max_error", 9)})


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("series_id").agg(F.min_by("codec", F.struct("bytes", "codec")).alias("winner"), F.min("bytes").alias("bytes"))


def _rates(rows: DataFrame) -> DataFrame:
    won = _winners(rows).groupBy("winner").agg(F.count(F.lit(1)).alias("wins"))
    return won.withColumn("rate", F.round(F.col("wins") / F.sum("wins").over(Window.partitionBy()), 6))  # a row a codec


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("codec").agg(F.sum("bytes").alias("bytes"), F.round(8 * F.sum("n") / F.sum("bytes"), 6).alias("ratio"))


def _pivot(rows: DataFrame, codecs: tuple[str, ...]) -> DataFrame:
    return rows.groupBy("series_id").pivot("codec", list(codecs)).agg(F.first("bytes"))


@query()
def scoreboard(spark, sf_dir):
    """The codec of fewest bytes for each signal, of equal ones the first name; of all codecs, the engine's own among them."""
    return _winners(compare(events(spark, sf_dir), BLOCK))


@query()
def win_rate(spark, sf_dir):
    return _rates(compare(events(spark, sf_dir), BLOCK))


@query()
def overall_ratio(spark, sf_dir):
    return _totals(compare(events(spark, sf_dir), BLOCK))


@query()
def technique_pivot(spark, sf_dir):
    return _pivot(compare(events(spark, sf_dir), BLOCK), CODECS)


def _closed_sql() -> str:
    of = {"dod12": "dod12", "dod16": "dod16", "rle": "float_rle", "zfp": "zfp_style", "alp": "alp_style"}
    return "WITH t AS (" + " UNION ALL ".join(f"SELECT series_id, '{n}' AS codec, bytes::BIGINT AS bytes FROM ({SQL[q]})" for n, q in of.items()) + ")"


@query(_closed_sql() + " SELECT series_id, arg_min(codec, (bytes, codec)) AS winner, min(bytes) AS bytes FROM t GROUP BY series_id")
def scoreboard_closed_forms(spark, sf_dir):
    return _winners(_closed(events(spark, sf_dir)))


@query(_closed_sql() + ", w AS (SELECT series_id, arg_min(codec, (bytes, codec)) AS winner FROM t GROUP BY series_id) SELECT winner, count(*) AS wins, round(count(*) / sum(count(*)) OVER (), 6) AS rate FROM w GROUP BY winner")
def win_rate_closed_forms(spark, sf_dir):
    return _rates(_closed(events(spark, sf_dir)))


@query(_closed_sql() + " SELECT codec, sum(bytes)::BIGINT AS bytes, round(8 * (SELECT count(*) FROM events WHERE value IS NOT NULL) / sum(bytes)::BIGINT, 6) AS ratio FROM t GROUP BY codec")
def overall_ratio_closed_forms(spark, sf_dir):
    return _totals(_closed(events(spark, sf_dir)))


@query(_closed_sql() + " SELECT series_id, " + ", ".join(f"max(bytes) FILTER (codec = '{c}') AS {c}" for c in CLOSED) + " FROM t GROUP BY series_id")
def technique_pivot_closed_forms(spark, sf_dir):
    return _pivot(_closed(events(spark, sf_dir)), CLOSED)


#: Rows of the report of the best signals.
BEST = 10


@query(f"WITH x AS ({SQL['dod16']}) SELECT series_id, n, CASE WHEN bytes < 1024 THEN printf('%dB', bytes) WHEN bytes < 1048576 THEN printf('%.1fKB', bytes / 1024 + 1e-9) ELSE printf('%.2fMB', bytes / 1048576 + 1e-9) END AS size, printf('%.1fx', 8 * n / bytes + 1e-9) AS ratio, CASE WHEN max_error = 0 THEN '0 (exact)' ELSE printf('%.2e', max_error) END AS max_error FROM x ORDER BY 8 * n / bytes DESC, series_id LIMIT {BEST}")
def best_signals(spark, sf_dir):
    """The signals that second differences shorten most, best first, as text."""
    x = dod16(spark, sf_dir)
    raw = 8 * F.col("n")
    top = x.orderBy((raw / F.col("bytes")).desc(), "series_id").limit(BEST)
    return top.select("series_id", "n", size_text(F.col("bytes")).alias("size"), ratio_text(raw, F.col("bytes")).alias("ratio"), error_text(F.col("max_error")).alias("max_error"))


@query(_SERIES + f", n AS (SELECT *, CASE WHEN idx % 7 = 0 THEN 'NaN'::DOUBLE WHEN idx % 11 = 0 THEN 'Infinity'::DOUBLE ELSE value END AS v FROM s) SELECT series_id, count(*) FILTER (isfinite(v)) AS finite, round(sum(CASE WHEN isnan(v) THEN 0 ELSE v END) FILTER (NOT isinf(v)), 4) AS sum FROM n GROUP BY series_id")
def odd_values(spark, sf_dir):
    """The finite filter, and NaN taken as 0, on signals in which some samples are made NaN or infinite."""
    v = F.when(F.col("idx") % 7 == 0, float("nan")).when(F.col("idx") % 11 == 0, float("inf")).otherwise(F.col("value"))
    s = events(spark, sf_dir).withColumn("v", v)
    zero = F.nanvl("v", F.lit(0.0))
    return s.groupBy("series_id").agg(F.count_if(finite(F.col("v"))).alias("finite"), F.round(F.sum(F.when(F.abs(zero) < float("inf"), zero)), 4).alias("sum"))


#: Samples of each synthetic signal that has a closed form.
SHORT = 2000


@query(f"""WITH x AS (SELECT unnest(range({SHORT})) AS idx), y AS (SELECT 'small' AS series_id, idx, sin(4 * pi() * idx / {SHORT - 1}) AS value FROM x UNION ALL SELECT 'step', idx, CASE WHEN idx < {SHORT // 2} THEN 1.0 ELSE 100.0 END FROM x
 UNION ALL SELECT 'ramp', idx, idx * (10000 / {SHORT - 1}) FROM x UNION ALL SELECT 'sine', idx, sin(100 * pi() * idx / {SHORT - 1}) FROM x) SELECT series_id, idx, round(value + 1e-9, 6) AS value FROM y""")
def synthetic_signals(spark, sf_dir):
    return synthetic.signals(spark, ["small", "step", "ramp", "sine"], SHORT).withColumn("value", F.round(F.col("value") + 1e-9, 6))


#: Samples of each signal of the comparison that no table has; long enough for blocks of the usual size.
LONG = 100_000


@query()
def synthetic_comparison(spark, sf_dir):
    """The engine's own bytes and errors on long synthetic signals, in blocks of the usual size."""
    s = synthetic.signals(spark, ["ramp", "sine", "noisy_ramp", "random_walk", "noisy_sine", "vibration", "heartbeat"], LONG)
    rows = T.sweep(s, [(C.PRECISION, True)])
    return rows.groupBy("series_id").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("max_error").alias("max_error"), (F.sum("abs_sum") / F.sum("n")).alias("mae"), F.sqrt(F.sum("square_sum") / F.sum("n")).alias("rmse"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
