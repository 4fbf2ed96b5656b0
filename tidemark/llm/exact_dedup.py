"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be frequent. Their groups are then counted
exactly; the winners (at most ``counters`` rows) are broadcast, so copies of a frequent text never meet in one
task. All other digests, each at most a ``counters``-th part of a partition's rows, take an ordinary shuffle.

Defined results: a null text counts as empty; equal means the same characters (SHA-256, with length and a second
64-bit hash verified for frequent digests); the row with the largest id stays, ids that are null come last; of
rows that repeat both id and text exactly one stays; an empty table gives an empty table. Columns of the input keep
their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, named, packed, prepare, scratch, unpacked

#: Counters of a Misra-Gries summary, and the most winners that are broadcast.
COUNTERS = 512


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for digest in batch.column(0).to_pylist():
                if digest in held:
                    held[digest] += 1
                elif len(held) < counters:
                    held[digest] = 1
                else:
                    held = {k: n - 1 for k, n in held.items() if n > 1}
        # a count of one is no sign of a copy, wherever it comes from
        rows = list(held.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())], ["__tm_sha", "__tm_n"]
        )

    return run


def _text(text: str) -> Column:
    return F.coalesce(named(text).cast("string"), F.lit(""))


def digests(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, digest, second check) of every row, as a table in the shared folder."""
    t = _text(text)
    rows = df.select(
        named(doc_id).alias("__tm_id"),
        F.unhex(F.sha2(t, 256)).alias("__tm_sha"),
        F.struct(F.xxhash64(t).alias("h"), F.octet_length(t).alias("n")).alias("__tm_check"),
    )
    return cut(rows, "digests")


def frequent(rows: DataFrame, counters: int) -> DataFrame:
    """At most ``counters`` digests with their exact group size and winner, each verified by the second check."""
    found = (
        rows.select("__tm_sha")
        .mapInArrow(_summaries(counters), "__tm_sha binary, __tm_n long")
        .groupBy("__tm_sha")
        .agg(F.sum("__tm_n").alias("__tm_n"))
        .filter("__tm_n > 1")
        .orderBy(F.desc("__tm_n"), "__tm_sha")
        .limit(counters)
        .select("__tm_sha")
    )
    exact = (
        rows.join(F.broadcast(cut(found, "frequent")), "__tm_sha")
        .groupBy("__tm_sha")
        .agg(
            F.max("__tm_id").alias("__tm_keep"),
            F.count(F.lit(1)).alias("__tm_size"),
            F.min("__tm_check").alias("__tm_lo"),
            F.max("__tm_check").alias("__tm_hi"),
        )
        .filter("__tm_lo = __tm_hi and __tm_size > 1")
        .select("__tm_sha", "__tm_keep", "__tm_size")
    )
    return cut(exact, "winners", keep=True)


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    prepare(df)
    rows = digests(df, doc_id, text)
    marked = rows.join(F.broadcast(frequent(rows, counters)), "__tm_sha", "left")
    copy = F.col("__tm_size").isNotNull() & F.coalesce(F.col("__tm_id") != F.col("__tm_keep"), F.col("__tm_keep").isNotNull())
    gone = marked.filter(copy).select(
        F.col("__tm_id"), "__tm_keep", "__tm_size", F.lit(False).alias("__tm_kept"), "__tm_sha"
    )
    same = Window.partitionBy("__tm_sha")
    rest = marked.filter(~copy).select(
        "__tm_id",
        F.coalesce("__tm_keep", F.max("__tm_id").over(same)).alias("__tm_keep"),
        F.coalesce("__tm_size", F.count(F.lit(1)).over(same)).alias("__tm_size"),
        (F.row_number().over(same.orderBy(F.col("__tm_id").desc_nulls_last())) == 1).alias("__tm_kept"),
        "__tm_sha",
    )
    return gone.unionByName(rest).select(
        F.col("__tm_id").alias(doc_id),
        F.col("__tm_keep").alias("keep_id"),
        F.col("__tm_size").alias("group_size"),
        F.col("__tm_kept").alias("kept"),
        F.lower(F.hex("__tm_sha")).alias("text_sha256"),
    )


def exact_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``df`` that stay, with their columns unchanged."""
    prepare(df)
    with scratch():
        winners = frequent(digests(df, doc_id, text), counters)
    marked = packed(df, __tm_id=named(doc_id), __tm_sha=F.unhex(F.sha2(_text(text), 256))).join(F.broadcast(winners), "__tm_sha", "left")
    left = marked.filter(F.col("__tm_size").isNull() | F.col("__tm_id").eqNullSafe(F.col("__tm_keep")))
    order = Window.partitionBy("__tm_sha").orderBy(F.col("__tm_id").desc_nulls_last())
    return unpacked(left.withColumn("__tm_no", F.row_number().over(order)).filter("__tm_no = 1"), df.columns)
