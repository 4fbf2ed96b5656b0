"""``python -m tidemark compress IN OUT`` and ``decompress IN OUT``: raw float64 files to containers and back."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidemark.functions import config as C
from tidemark.operators.windows import compress
from tidemark.sources import files
from tidemark.sources.series import read_raw


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    to = parser.add_subparsers(dest="to", required=True)
    for name in ("compress", "decompress"):
        one = to.add_parser(name)
        one.add_argument("source")
        one.add_argument("target")
        if name == "compress":
            one.add_argument("--precision", type=int, default=C.PRECISION, help="fraction bits, held to 8 to 20")
            one.add_argument("--chunk", type=int, default=C.CHUNK)
            one.add_argument("--bound", type=float, default=C.BOUND, help="largest error to hold")
            one.add_argument("--no-bound", action="store_true", help="take the precision as it is, whatever the error")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    if a.to == "compress":
        precision = min(max(a.precision, C.MIN_PRECISION), C.MAX_PRECISION)
        windows = compress(read_raw(spark, a.source), a.chunk, precision, not a.no_bound, a.bound)
        files.write_files(files.pack_containers(windows, a.chunk, precision=precision), a.target, "tmk")
    else:
        files.write_files(files.pack_raw(files.unpack_containers(files.read_files(spark, a.source, "tmk"))), a.target, "bin")


if __name__ == "__main__":
    main()
