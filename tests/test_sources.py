from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.__main__ import main
from tidemark.functions import codec, config as C
from tidemark.operators import sizes, windows
from tidemark.sources import csv, files, synthetic
from tidemark.sources.series import SCHEMA, read_raw, series, split_points
from tidemark.streaming.compressor import compress_stream

RNG = np.random.default_rng(5)


def rows(spark, **signals):
    return spark.createDataFrame([(k, n, float(v)) for k, y in signals.items() for n, v in enumerate(y)], SCHEMA)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.floats(), st.sampled_from([0.0, 1.5, -1.5, 20.25])), max_size=80))
def test_xor_stream_is_lossless(y):
    y = np.array(y, float)
    data = codec.xor_pack(y)
    assert np.array_equal(codec.bits(codec.xor_unpack(data, len(y))), codec.bits(y))
    if len(y):
        assert len(data) == (codec.gorilla_bits(y) + 7) // 8


@pytest.mark.parametrize("y", [[], [0.0], [0.01, 7.25, -3.5], [np.pi, 1.0], [np.nan, 1.0], [1e300], RNG.integers(0, 10**6, 3000) / 100, RNG.normal(size=1500)])
def test_decimal_codec_round_trips(spark, y):
    y = np.array(y, float)
    data = codec.alp_pack(y)
    assert np.array_equal(codec.alp_unpack(data), y, equal_nan=True)
    if len(y):
        assert sizes.alp_sizes(rows(spark, a=y)).first()["bytes"] == len(data)


def test_files_and_command_line(spark, tmp_path):
    y = np.round(RNG.normal(size=2500).cumsum(), 3)
    (tmp_path / "in.bin").write_bytes(y.astype("<f8").tobytes() + b"odd")
    main(["compress", str(tmp_path / "in.bin"), str(tmp_path / "packed"), "--chunk", "500"])
    main(["decompress", str(tmp_path / "packed"), str(tmp_path / "raw")])
    found = [p for p in (tmp_path / "raw").rglob("*") if p.is_file() and not p.name.startswith(".")]
    assert [p.suffix for p in found] == [".bin"]
    assert np.abs(np.frombuffer(found[0].read_bytes(), "<f8") - y).max() < C.BOUND
    back = files.unpack_raw(files.read_files(spark, str(tmp_path / "raw"), "bin")).orderBy("idx").toPandas()
    assert len(back) == len(y) and back["series_id"].str.endswith("in.bin").all()


def test_containers_of_few_blocks_keep_places(spark):
    s = rows(spark, a=np.arange(230.0), b=[np.nan, 1.0, np.inf])
    packed = files.pack_containers(windows.compress(s, 50), 50, blocks=2)
    assert packed.count() == 4
    back = {(r[0], r[1]): r[2] for r in files.unpack_containers(packed).collect()}
    assert len(back) == 233 and all(abs(back["a", n] - n) < C.BOUND for n in range(230)) and back["b", 2] == np.inf


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text("t;v\n2;5.5\n1;4\n3;?\n4;\n5;999\n")
    got = csv.read_csv(spark, str(tmp_path / "x.csv"), "v", ["t"], sep=";", highest=100).orderBy("idx").collect()
    assert [(r["idx"], r["value"]) for r in got] == [(0, 4.0), (1, 5.5)]
    csv.write_csv(rows(spark, a=[1.0]), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1


def test_stream_codes_full_blocks(spark, tmp_path):
    y = np.round(RNG.normal(size=250), 3)
    s = rows(spark, a=y)
    s.filter("idx < 120").write.parquet(str(tmp_path / "in" / "1"))
    s.filter("idx >= 110").write.parquet(str(tmp_path / "in" / "2"))  # ten samples come twice
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = compress_stream(stream, 100).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    q.awaitTermination()
    back = windows.decompress(spark.read.parquet(str(tmp_path / "out"))).orderBy("idx").toPandas()
    assert back["idx"].tolist() == list(range(200)) and np.abs(back["value"] - y[:200]).max() < C.BOUND


def test_raw_files_are_read_in_parts(spark, tmp_path):
    y = RNG.normal(size=1000)
    (tmp_path / "a.bin").write_bytes(y.astype("<f8").tobytes() + b"odd")
    (tmp_path / "b.bin").write_bytes(b"tiny")
    (tmp_path / "c.bin").write_bytes(y[:1].astype("<f8").tobytes())
    df = read_raw(spark, str(tmp_path), part_bytes=807)
    assert df.rdd.getNumPartitions() == 11
    got = {}
    for r in df.orderBy("series_id", "idx").collect():
        got.setdefault(r.series_id[-5:], []).append(r.value)
    assert got == {"a.bin": y.tolist(), "c.bin": y[:1].tolist()}
    assert [r.length for r in files.list_files(spark, str(tmp_path)).collect()] == [8003, 4, 8]


def test_numbering_in_parts_is_the_same(spark):
    rows_ = [(int(k), None if at % 13 == 0 else int(at), int(v)) for k, at, v in zip(RNG.integers(0, 3, 500), RNG.integers(0, 60, 500), range(500), strict=True)]
    df = spark.createDataFrame(rows_, "k int, at int, v int")
    whole = sorted(map(tuple, series(df, "k", ["at", "v"], "v").collect()))
    cut = split_points(df, "at", 5)
    assert len(cut) == 4 and sorted(map(tuple, series(df, "k", ["at", "v"], "v", cut).collect())) == whole


def test_synthetic_signals(spark, monkeypatch):
    """Lengths, and the same noise and sums however rows are dealt out."""
    assert {r.series_id: r["count"] for r in synthetic.signals(spark, n=300).groupBy("series_id").count().collect()} == dict.fromkeys(synthetic.SIGNALS, 300)
    walk = [r.value for r in synthetic.signal(spark, "random_walk", 300).orderBy("idx").collect()]
    monkeypatch.setattr(synthetic, "PART", 64)
    assert np.allclose([r.value for r in synthetic.signal(spark, "random_walk", 300).orderBy("idx").collect()], walk)
    steps = np.diff(walk, prepend=0)
    assert abs(steps.mean()) < 0.2 and 0.85 < steps.std() < 1.15
    edge = [r.value for r in synthetic.signal(spark, "edge_cases").orderBy("idx").collect()]
    assert len(edge) == 100 and np.isnan(edge[0]) and edge[1] == -edge[2] == np.inf and 0 < edge[4] < edge[3] and edge[5] == -edge[4] and not any(edge[6:])


def test_range_scans_lose_no_rows(spark):
    """A window with values that aren't finite is looked into."""
    y = np.arange(100.0)
    y[7], y[50], y[51] = np.nan, np.inf, -np.inf
    t = windows.compress(rows(spark, a=y), 100)
    near = lambda df: sorted(round(r.value) if np.isfinite(r.value) else r.value for r in df.collect())
    assert near(windows.scan(t, 0, 100, 0, 20)) == [v for v in range(21) if v != 7]
    assert near(windows.scan(t, 0, 100, lowest=98)) == [98, 99, np.inf] and near(windows.scan(t, 0, 100, highest=1)) == [-np.inf, 0, 1]
    assert near(windows.scan(t, 5, 9)) == sorted([5, 6, np.nan, 8], key=lambda v: (v != v, v)) or windows.scan(t, 5, 9).count() == 4


def test_lost_samples_are_seen(spark):
    a = rows(spark, x=np.arange(100.0), y=np.arange(5.0), z=[np.nan])
    got = {r.series_id: r for r in windows.errors(a, a.filter("idx < 10")).collect()}
    assert (got["x"].n, got["x"].missing, got["x"].max_error) == (100, 90, None)
    assert (got["y"].missing, got["y"].max_error, got["y"].mae) == (0, 0.0, 0.0) and (got["z"].missing, got["z"].max_error) == (0, 0.0)
    more = {r.series_id: r for r in windows.errors(a.filter("idx < 10"), a).collect()}
    assert (more["x"].missing, more["x"].rmse) == (90, None)


def test_errors_by_hand(spark):
    a, b = rows(spark, x=[1.0, 2.0, np.nan, 4.0]), rows(spark, x=[1.0, 2.5, 0.0, 3.0])
    r = windows.errors(a, b).first()
    assert (r.n, r.missing, r.max_error, r.mae) == (4, 0, 1.0, 0.5) and abs(r.rmse - np.sqrt(1.25 / 3)) < 1e-12


def test_command_line_without_bound(spark, tmp_path):
    y = np.round(RNG.normal(size=400).cumsum() * 100, 3)
    (tmp_path / "in.bin").write_bytes(y.astype("<f8").tobytes())
    for name, more in (("held", []), ("free", ["--precision", "8", "--no-bound"])):
        main(["compress", str(tmp_path / "in.bin"), str(tmp_path / name), *more])
        back = files.unpack_containers(files.read_files(spark, str(tmp_path / name), "tmk")).orderBy("idx").toPandas()["value"]
        assert (np.abs(back - y).max() < C.BOUND) == (name == "held")
