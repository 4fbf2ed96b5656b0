from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from tidemark.functions import codec, config as C
from tidemark.plans import queries as Q

SF = "/root/testdata/sf0.001"
#: Their SQL states a bound, or compares values, that hold for finite samples of usual size alone.
USUAL = {"error_bound", "container_round_trip", "range_scan", "fit_constant", "fit_linear", "fit_quadratic", "fixed_windows_variance", "model_select", "dominant_frequency", "block_dod", "select_precision", "precision_histogram", "mean_precision", "full_round_trip", "container_files"}


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Events with NaN, infinite, huge, tiny, missing and single samples."""
    rng = np.random.default_rng(3)
    tiny = 4.9e-324
    signals = {
        1: [math.nan, math.inf, -math.inf, 2.2250738585072014e-308, tiny, -tiny, *[0.0] * 40],
        2: [1e300, -1e300, 1e18, 5.0, *rng.integers(0, 9, 20).astype(float)],
        3: [7.25],
        4: [3.5] * 17,
        5: [*np.round(rng.normal(size=50), 2), math.nan, *np.round(rng.normal(size=50), 2)],
        6: [None, None],
    }
    rows = [(n, user, None if v is None else float(v)) for n, (user, v) in enumerate((u, v) for u, y in signals.items() for v in y)]
    at = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{at}/events.parquet")
    return str(at)


def same_as_sql(spark, name, folder):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet{'' if folder == SF else '/*.parquet'}'")
    a, b = Q.QUERIES[name](spark, folder).toPandas(), con.sql(Q.SQL[name]).df()
    assert sorted(a) == sorted(b) and len(a) == len(b)
    k = sorted(a)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    for c in k:
        assert (a[c].astype(str) == b[c].astype(str)).all() if a[c].dtype == object else np.array_equal(a[c].to_numpy(float), b[c].to_numpy(float), equal_nan=True), (c, a[c], b[c])


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    same_as_sql(spark, name, SF)


@pytest.mark.parametrize("name", sorted(set(Q.SQL) - USUAL))
def test_query_equals_its_sql_on_odd_signals(spark, odd_dir, name):
    same_as_sql(spark, name, odd_dir)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL) - {"synthetic_comparison"} | USUAL))
def test_query_runs_on_odd_signals(spark, odd_dir, name):
    Q.QUERIES[name](spark, odd_dir).collect()


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL) - {"synthetic_comparison"}))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_odd_signals_survive(spark, odd_dir):
    """Values that aren't finite come back as they are, all others within the bound or what doubles can tell."""
    from tidemark.operators import windows as T
    from tidemark.sources.series import events

    s = events(spark, odd_dir)
    rows = s.join(T.decompress(T.compress(s, 50)).withColumnRenamed("value", "back"), ["series_id", "idx"]).collect()
    assert len(rows) == s.count()
    for r in rows:
        assert r.value == r.back or math.isnan(r.value) and math.isnan(r.back) or abs(r.value - r.back) <= max(C.BOUND, abs(r.value) * 2e-16), r
    got = {r.series_id: r for r in T.errors(s, T.decompress(T.compress(s, 50))).collect()}
    assert all(r.missing == 0 for r in got.values()) and got["4"].max_error == 0.0 and got["5"].n == 101


def test_comparison_of_all_codecs(spark):
    """Every codec's row against bytes made for one signal at a time; winners, rates and totals against plain Python."""
    from tidemark.sources.series import events

    rows = Q.codec_comparison(spark, SF).collect()
    signals = {}
    for r in events(spark, SF).orderBy("series_id", "idx").collect():
        signals.setdefault(r.series_id, []).append(r.value)
    by = {}
    for r in rows:
        by.setdefault(r.series_id, {})[r.codec] = r
    assert set(by) == set(signals) and all(set(v) == set(Q.CODECS) for v in by.values())
    for name, y in signals.items():
        y = np.array(y)
        want = {k: b for k, (b, _) in Q.measured(y).items()} | {"tidemark": len(codec.pack_container(codec.encode_block(y), C.PRECISION, Q.BLOCK)), "alp": len(codec.alp_pack(y))}
        assert {k: by[name][k].bytes for k in want} == want
        assert by[name]["tidemark"].max_error < C.BOUND and by[name]["sz3"].max_error <= C.BOUND / 2 + 1e-9
        assert all(by[name][k].max_error == 0 for k in ("gorilla", "elf", "gzip", "zlib", "zstd", "snappy", "rle", "alp"))
    winner = {name: min((r.bytes, c) for c, r in v.items()) for name, v in by.items()}
    assert {r.series_id: (r.bytes, r.winner) for r in Q.scoreboard(spark, SF).collect()} == winner
    assert {r.winner: r.wins for r in Q.win_rate(spark, SF).collect()} == {c: sum(w[1] == c for w in winner.values()) for c in {w[1] for w in winner.values()}}
    assert {r.codec: r.bytes for r in Q.overall_ratio(spark, SF).collect()} == {c: sum(v[c].bytes for v in by.values()) for c in Q.CODECS}
    assert all(r[c] == by[r.series_id][c].bytes for r in Q.technique_pivot(spark, SF).collect() for c in Q.CODECS)


def test_sweep_through_the_codec(spark):
    rows = {(r.requested, r.enforced): r for r in Q.codec_sweep(spark, SF).collect()}
    assert set(rows) == {(16, True), *((p, False) for p in range(8, 21, 2))}
    assert rows[16, True].max_error < C.BOUND and rows[8, False].max_error > C.BOUND
    sizes = [rows[p, False].bytes for p in range(8, 21, 2)]
    assert sizes == sorted(sizes) and all(rows[p, False].mean_precision <= p for p in range(8, 21, 2))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
