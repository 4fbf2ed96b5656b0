"""Secret scans over an incremental blob ledger.

Every version of a text is a blob named by its SHA-256. A ledger in the shared folder lists which rule versions
have seen which blob, and what they found. A scan takes the blobs of a table, drops the (blob, rule version) pairs
that the ledger has, scans the rest once each, adds them to the ledger, and joins the findings back to all rows. An
entry is one commit of a table, so a scan that fails adds nothing; of entries that two scans at once have made for one
blob, one is read.

Copies are first dropped inside each partition, so a text that fills a third of the table arrives at the scan once
per ``REMEMBERED`` rows of a partition at most, not once per row; there copies lie side by side, and one is scanned.

Rules: ``assign``, ``access``, ``hex`` (see RULES); ``pem`` and ``jwt`` are the method's own additions. A rule finds
leftmost non-overlapping matches; those that are too short are dropped after matching. Spans are code points, end
exclusive.

Defined results: a null text counts as empty and has no findings; repeated rows each get their row; texts of any
length are scanned whole; other columns, whatever their names, are not read; an empty table gives an empty table and
adds nothing to the ledger.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import cut, named, prepare, shared_root

RULE_VERSION = "2"
#: Kind, pattern, group whose length counts, least length. The first three are the base.
RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
)
BASE = 3
_COMPILED = [(kind, re.compile(pattern), group, least) for kind, pattern, group, least in RULES]
#: A text with no such character has no match of the rule; a quick look before the pattern runs.
_NEEDS = {"assign": re.compile("[:=]"), "pem": re.compile("-----BEGIN "), "jwt": re.compile("eyJ")}


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the rule, end) of every finding, in order."""
    out = []
    for n, (kind, pattern, group, least) in enumerate(_COMPILED):
        if kind in _NEEDS and not _NEEDS[kind].search(text):
            continue
        out += [(m.start(), n, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _shown(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{RULES[n][0]}:{start}:{end}" for start, n, end in found)


#: Digests that a task remembers to drop copies before texts are dealt out.
REMEMBERED = 100_000


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose digest is none of the last ones of this partition."""
    seen: set[bytes] = set()
    for batch in batches:
        if len(seen) > REMEMBERED:
            seen.clear()
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep, pa.bool_()))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings of blobs that come sorted: copies follow one another."""
    last = None
    for batch in batches:
        rows = []
        for blob, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if blob == last:
                continue
            last = blob
            found = find(text)
            base = [x for x in found if x[1] < BASE]
            n = [sum(x[1] == k for x in found) for k in range(BASE)]
            rows.append((blob, RULE_VERSION, *n, hashlib.sha256(_shown(base).encode()).hexdigest(), _shown(found)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_LEDGER)], [f.name for f in _LEDGER])


_LEDGER = [
    pa.field("blob", pa.binary()), pa.field("rule_version", pa.string()), pa.field("n_assign", pa.int64()), pa.field("n_access", pa.int64()),
    pa.field("n_hex", pa.int64()), pa.field("base_sha256", pa.string()), pa.field("spans", pa.string()),
]
LEDGER_SCHEMA = "blob binary, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def seen_blobs(spark: SparkSession, ledger: str) -> DataFrame | None:
    """The ledger's entries under this rule version, one for each blob; None if there is no ledger yet."""
    known = read_ledger(spark, ledger)
    return None if known is None else known.filter(F.col("rule_version") == RULE_VERSION).drop("rule_version").dropDuplicates(["blob"])


def update_ledger(df: DataFrame, ledger: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what the ledger at ``ledger`` has not seen under this rule version and append it; (__tm_id, blob) of every row."""
    spark = prepare(df)
    t = F.coalesce(named(text).cast("string"), F.lit(""))
    blobs = df.select(F.unhex(F.sha2(t, 256)).alias("blob"), t.alias("text"))
    paths = cut(df.select(named(doc_id).alias("__tm_id"), F.unhex(F.sha2(t, 256)).alias("blob")), "paths")
    # unseen texts meet by digest: each is scanned once
    todo = blobs.mapInArrow(_distinct, "blob binary, text string")
    known = seen_blobs(spark, ledger)
    if known is not None:
        todo = todo.join(known.select("blob"), "blob", "left_anti")
    todo.repartition(F.col("blob")).sortWithinPartitions("blob").mapInArrow(_scan, LEDGER_SCHEMA).write.mode("append").parquet(ledger)
    return paths


def scan(df: DataFrame, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, blob, n_assign, n_access, n_hex, base_sha256, spans. Without a ledger it begins a new one."""
    spark = prepare(df)
    ledger = ledger or f"{shared_root(spark)}/ledger-{uuid.uuid4().hex}"
    paths = update_ledger(df, ledger, doc_id, text)
    found = paths.join(seen_blobs(spark, ledger), "blob")
    return found.select(F.col("__tm_id").alias(doc_id), F.lower(F.hex("blob")).alias("blob"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
