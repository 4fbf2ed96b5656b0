"""MinHash near-dedup by tensored banding, each link verified on full shingle sets.

Banding with tables of 2 r minhashes needs L tables for its recall, so 2 r L minhashes. Tensored banding computes two
collections, A and B, of m half-keys of r minhashes each, and takes every pair (A_i, B_j) as a table key: m * m
tables from 2 r m minhashes. Two sets meet in a table if some A_i and some B_j agree; m follows from the chance of a
miss at the threshold, ``MISS``.

1. Equal sets count once, whatever their number: a representative stands for them.
2. Half-keys that only one representative has cannot meet anything and are dropped before pairs are formed.
3. In each table key every member is held against one member by their sketches, a byte of each minhash: pairs at the
   threshold agree in at least ``least_shared`` bytes, pairs that share a passage alone seldom do. So the pairs looked at
   are at most as many as table rows, however many sets share a key, and common passages don't chain sets into one
   family. Sets that are alike, directly or over others, need no more meetings among themselves. All others that were
   held against the same member meet in full: each pair that has a half-key in common with that member and isn't of one
   family already is held against each other, in crowds of about ``CROWD`` x ``CROWD`` sets, each in a task of its own,
   and a crowd gives a spanning forest of what is alike. Bytes that differ are a metric, so a pair whose distances from
   that member are further apart than alike sets can be is settled without a look.
4. Sets that are alike, directly or over others, form a family (connected components). In each family the member with
   most shared half-keys is the hub; all members are verified against it. Those not linked to it are verified against
   the whole family in blocks of about ``BLOCK`` x ``BLOCK`` sets, each block in a task of its own; a block gives a
   spanning forest of its links, not all of them. Members linked to the hub need no more checks among themselves: they
   are one component already.
5. Links form the components that are returned.

No table, family or group is capped, and no pairs of a group are emitted. What can be lost: a pair at the threshold
that meets in no table (``MISS``), or whose sketches agree in fewer bytes than ``least_shared`` (a tenth of that).

Defined results: letters A-Z are lowered, words are runs of characters other than ASCII white space; a text of fewer
words than a shingle is one shingle; null, empty and blank texts have no shingles and link with nothing; rows that
repeat id or text are linked as equal sets; a null id never names a component unless all ids in it are null; an
empty table gives an empty table. Columns of the input keep their names, whatever they are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, drop, named, packed, prepare, scratch, unpacked, worker_memory
from tidemark.llm.components import connected_components

#: Chance to miss a pair exactly at the threshold.
MISS = 1e-4
#: Minhashes of a half-key.
HALF = 4
#: Sets of a block of full sets, and of a crowd of sketches.
BLOCK, CROWD = 48, 4096
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def half_keys(similarity: float, half: int = HALF, miss: float = MISS) -> int:
    """Half-keys in each collection: neither may be without agreement more often than miss / 2."""
    return max(1, math.ceil(math.log(miss / 2) / math.log(1 - similarity**half)))


def least_shared(similarity: float, n: int, miss: float = MISS) -> int:
    """The most bytes, of a sketch of ``n``, in which all but a share of miss / 10 of pairs at the threshold agree."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > miss / 10:
            return k
    return n


def _scatter(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[str, int] = {}

    def _code(self, word: str) -> int:
        return int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "little")

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        known, k = self.known, self.words
        parts = [WORD.findall(t.encode("utf-8").lower().decode("utf-8")) if t else [] for t in texts]
        if len(known) > 250_000:
            known.clear()
        for w in {w for p in parts for w in p}.difference(known):
            known[w] = self._code(w)
        out = []
        for p in parts:
            if not p:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.fromiter(map(known.__getitem__, p), np.uint64, len(p))
            n = max(len(h) - k + 1, 1)
            code = np.full(n, min(len(h), k), np.uint64)
            for j in range(min(k, len(h))):
                code = _scatter(code * np.uint64(_MIX[1]) + h[j : j + n])
            out.append(np.unique(code))
        return out


_shinglers: dict[int, Shingler] = {}


def shingler(words: int) -> Shingler:
    return _shinglers.setdefault(words, Shingler(words))


def forget() -> None:
    """Drop what this worker remembers of words."""
    _shinglers.clear()


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def minhash_half_keys(sets: list[np.ndarray], m: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, 2 m) half-keys, each of ``half`` minhashes, and (sets, 2 m half) sketches, a byte of each minhash. Minhashes
    are of the upper 32 bits of the shingles' hashes. Sets must not be empty."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    rng = np.random.default_rng(20240601)
    keys, sketch = np.zeros((len(sets), 2 * m), np.uint64), np.zeros((len(sets), 2 * m * half), np.uint8)
    for j in range(2 * m):
        keys[:, j] = j + 1
        for k in range(half):
            factor, salt = rng.integers(0, 1 << 32, 2, dtype=np.uint32)
            low = np.minimum.reduceat((flat ^ salt) * (factor | np.uint32(1)), starts)
            keys[:, j] = _scatter(keys[:, j] * np.uint64(_MIX[0]) + low)
            sketch[:, j * half + k] = low.astype(np.uint8)
    return keys, sketch


def _signatures(words: int, m: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("shingles", forget, collect=True):
            own = shingler(words)
            for batch in batches:
                sets = own.sets(batch.column(1).to_pylist())
                keys: list[bytes | None] = [None] * len(sets)
                sketches: list[bytes | None] = [None] * len(sets)
                full = [n for n, s in enumerate(sets) if len(s)]
                lo = 0
                while lo < len(full):  # about a hundred thousand shingles at once
                    hi, held = lo, 0
                    while hi < len(full) and (hi == lo or held < 100_000):
                        held += len(sets[full[hi]])
                        hi += 1
                    got, short = minhash_half_keys([sets[n] for n in full[lo:hi]], m, half)
                    for n, row, sketch in zip(full[lo:hi], got, short, strict=True):
                        keys[n], sketches[n] = row.tobytes(), sketch.tobytes()
                    lo = hi
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), batch.column(2)],
                    ["__tm_id", "__tm_n", "__tm_set", "__tm_keys", "__tm_sketch", "__tm_hash"],
                )

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per half-key: set, side and number, value."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([np.frombuffer(b, np.int64) for b in batch.column(1).to_pylist()])
        width = keys.shape[1]
        at = np.repeat(np.arange(len(keys)), width)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(width), len(keys)), pa.int16()), pa.array(keys.ravel())], ["__tm_set", "__tm_side", "__tm_key"])


def _table_keys(m: int):
    """A row per pair of half-keys (A_i, B_j) that a set still has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets, keys = [], []
            for name, sides, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                side, value = np.array(sides), np.array(values, np.int64).view(np.uint64)
                one, two = value[side < m] * np.uint64(_MIX[2]), value[side >= m] * np.uint64(_MIX[3])
                if len(one) and len(two):
                    pair = _scatter((one[:, None] * np.uint64(_MIX[0])) ^ two[None, :]).ravel()
                    sets.append((name, len(pair)))
                    keys.append(pair)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            at = np.repeat(np.arange(len(sets)), [n for _, n in sets]) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in sets], pa.binary()).take(pa.array(at)), pa.array(flat.view(np.int64))], ["__tm_set", "__tm_key"])

    return run


def _compared(least: int):
    """Bytes in which two sketches differ, and in how many those of alike sets may."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (3, 4))
                reach = np.full(batch.num_rows, one.shape[1] - least, np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array((one != two).sum(axis=1).astype(np.int32)), pa.array(reach)], ["a", "b", "__tm_halves", "__tm_apart", "__tm_reach"])

    return run


def _crowds(least: int):
    """Links that join the families of one crowd: of each half-key, all sets outside its largest family against all."""

    def run(table: pa.Table) -> pa.Table:
        names, families = table.column("a").to_pylist(), table.column("__tm_family").to_pylist()
        low, high = table.column("__tm_one")[0].as_py(), table.column("__tm_two")[0].as_py()
        block, apart = (table.column(c).to_numpy() for c in ("__tm_block", "__tm_apart"))
        sketch = np.frombuffer(b"".join(table.column("__tm_sketch").to_pylist()), np.uint8).reshape(len(names), -1)
        reach = sketch.shape[1] - least
        number = {f: n for n, f in enumerate(dict.fromkeys(families))}
        label = np.array([number[f] for f in families])
        halves = table.column("__tm_halves").to_pylist()
        at, value = np.repeat(np.arange(len(names)), [len(h) for h in halves]), np.array([v for h in halves for v in h], np.int64)
        order = np.lexsort((apart[at], value))
        at, value = at[order], value[order]
        links = []
        for rows in np.split(at, np.flatnonzero(np.diff(value)) + 1):
            kinds, sizes = np.unique(label[rows], return_counts=True)
            if len(kinds) < 2:
                continue
            far, done = apart[rows], np.zeros(len(names), bool)
            for x in rows[label[rows] != kinds[sizes.argmax()]].tolist():
                done[x] = True
                lo, hi = np.searchsorted(far, [apart[x] - reach, apart[x] + reach + 1])
                y = rows[lo:hi]
                y = y[(label[y] != label[x]) & ~done[y] & ((block[y] != block[x]) | (low == high))]
                for z in y[(sketch[y] != sketch[x]).sum(axis=1) <= reach].tolist():
                    if label[z] != label[x]:
                        links.append((names[x], names[z]))
                        label[label == label[z]] = label[x]
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return run


def _alike(tables: DataFrame, held: DataFrame, least: int) -> DataFrame:
    """(a, b) that span the families of sets which share a table and at least ``least`` bytes of their sketches.
    tables: (set, key); held: (set, sketch, half-keys), of which sets that share a table have one in common."""
    tables = cut(tables, "rows")
    # one member for each table; which one, differs between tables, so that one odd set does not stand in all of them
    turn = F.xxhash64("__tm_set", F.pmod("__tm_key", F.lit(2)))
    first = tables.groupBy("__tm_key").agg(F.min(F.struct(turn, "__tm_set")).alias("__tm_first"), F.count(F.lit(1)).alias("__tm_met"))
    first = cut(first.filter("__tm_met > 1").select("__tm_key", F.col("__tm_first.__tm_set").alias("b")), "tables")
    met = tables.join(first, "__tm_key").filter("__tm_set != b").select(F.col("__tm_set").alias("a"), "b").distinct()
    sketch = held.select("__tm_set", "__tm_sketch", "__tm_values")
    pairs = met.join(sketch.toDF("a", "__tm_sa", "__tm_va"), "a").join(sketch.toDF("b", "__tm_sb", "__tm_vb"), "b")
    pairs = pairs.select("a", "b", F.array_intersect("__tm_va", "__tm_vb").alias("__tm_halves"), "__tm_sa", "__tm_sb")
    pairs = cut(pairs.mapInArrow(_compared(least), "a binary, b binary, __tm_halves array<long>, __tm_apart int, __tm_reach int"), "pairs")
    drop(tables, first)
    family = connected_components(pairs.filter("__tm_apart <= __tm_reach").select("a", "b")).select("node", "label")
    rest = pairs.join(family.toDF("a", "__tm_family"), "a", "left").join(family.toDF("b", "__tm_other"), "b", "left")
    rest = rest.withColumn("__tm_family", F.coalesce("__tm_family", "a")).withColumn("__tm_other", F.coalesce("__tm_other", "b"))
    rest = cut(rest, "rest")
    # of b's own family those stay that may be alike to the nearest set of another one
    near = rest.filter("__tm_family != __tm_other").groupBy("b").agg(F.min("__tm_apart").alias("__tm_near"))
    rest = rest.join(near, "b").filter("__tm_family != __tm_other or __tm_apart + __tm_reach >= __tm_near")
    rest = cut(rest.select("a", "b", "__tm_family", "__tm_apart", "__tm_halves"), "rest")
    sizes = rest.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("__tm_crowds"), (F.min("__tm_family") != F.max("__tm_family")).alias("__tm_mixed"))
    dealt = rest.join(sizes.filter("__tm_mixed").select("b", "__tm_crowds"), "b").join(held.select(F.col("__tm_set").alias("a"), "__tm_sketch"), "a")
    dealt = dealt.withColumn("__tm_block", F.pmod(F.xxhash64("a"), "__tm_crowds").cast("int")).withColumn("__tm_partner", F.explode(F.sequence(F.lit(0), F.col("__tm_crowds") - 1)))
    dealt = dealt.select(
        "b", F.least("__tm_block", "__tm_partner").alias("__tm_one"), F.greatest("__tm_block", "__tm_partner").alias("__tm_two"), "a", "__tm_block", "__tm_family", "__tm_apart", "__tm_halves", "__tm_sketch"
    )
    more = cut(dealt.groupBy("b", "__tm_one", "__tm_two").applyInArrow(_crowds(least), "a binary, b binary"), "met")
    return family.filter("node != label").toDF("a", "b").unionByName(more)


def _full_sets(words: int):
    """The rows whose text still gives the set that is looked for, with the set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("shingles", forget, collect=True):
            own = shingler(words)
            for batch in batches:
                sets = own.sets(batch.column(3).to_pylist())
                fits = pa.array([_digest(s) == d for s, d in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
                full = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.tobytes() for s in sets], pa.binary())], ["__tm_set", "__tm_family", "__tm_degree", "__tm_full"])
                yield full.filter(fits)

    return run


def _linked(both: float | np.ndarray, a: float | np.ndarray, b: float | np.ndarray, percent: int):
    return 100 * both >= percent * (a + b - both)


def _against_hub(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hub, same = None, []
            for mine, other in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if hub is None or other != hub[0]:
                    hub = (other, np.frombuffer(other, np.uint64))
                s = np.frombuffer(mine, np.uint64)
                at = np.minimum(np.searchsorted(hub[1], s), len(hub[1]) - 1)
                same.append(bool(_linked(int((hub[1][at] == s).sum()), len(s), len(hub[1]), percent)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(same, pa.bool_()), batch.column(3)], ["__tm_set", "__tm_family", "__tm_linked", "__tm_hub"])

    return run


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two blocks of sets, by products of 0/1 matrices a slice of the shingles at a time."""
    out = np.zeros((len(one), len(two)), np.int64)
    a, b = np.concatenate(one), np.concatenate(two)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (one, two))
    both = np.intersect1d(a, b)
    ia, ib = (np.minimum(np.searchsorted(both, x), max(len(both) - 1, 0)) for x in (a, b))
    if not len(both):
        return out
    oka, okb = both[ia] == a, both[ib] == b
    ia, ra, ib, rb = ia[oka], ra[oka], ib[okb], rb[okb]
    for lo in range(0, len(both), 8192):
        x, y = np.zeros((len(one), 8192), np.float32), np.zeros((len(two), 8192), np.float32)
        ka, kb = (ia >= lo) & (ia < lo + 8192), (ib >= lo) & (ib < lo + 8192)
        x[ra[ka], ia[ka] - lo] = 1
        y[rb[kb], ib[kb] - lo] = 1
        out += np.rint(x @ y.T).astype(np.int64)
    return out


def _blocks(percent: int):
    def run(table: pa.Table) -> pa.Table:
        names, block = table.column("__tm_set").to_pylist(), table.column("__tm_block").to_pylist()
        low, high = table.column("__tm_one")[0].as_py(), table.column("__tm_two")[0].as_py()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("__tm_full").to_pylist()]
        one, two = [n for n, b in enumerate(block) if b == low], [n for n, b in enumerate(block) if b == high]
        links = []
        if one and two:
            size = np.array([len(s) for s in sets])
            ok = _linked(_common([sets[n] for n in one], [sets[n] for n in two]), size[one][:, None], size[two][None, :], percent)
            parent = list(range(len(sets)))

            def root(n: int) -> int:
                while parent[n] != n:
                    parent[n] = n = parent[parent[n]]
                return n

            for i, j in np.argwhere(ok).tolist():
                a, b = root(one[i]), root(two[j])
                if a != b:
                    parent[b] = a
                    links.append((names[one[i]], names[two[j]]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.binary()), "b": pa.array([x for _, x in links], pa.binary())})

    return run


def _links(texts: DataFrame, rows: DataFrame, words: int, percent: int, m: int) -> DataFrame:
    """(a, b) of verified links between distinct sets that span their components; texts: (id, text), rows: signatures."""
    # one row stands for equal sets
    reps = rows.filter("__tm_set is not null").groupBy("__tm_set").agg(F.first("__tm_keys").alias("__tm_keys"), F.first("__tm_sketch").alias("__tm_sketch"), F.min(F.struct("__tm_id", "__tm_hash")).alias("__tm_row"))
    reps = cut(reps, "representatives")
    halves = reps.select("__tm_set", "__tm_keys").mapInArrow(_unpack, "__tm_set binary, __tm_side smallint, __tm_key long")
    shared = cut(halves.groupBy("__tm_side", "__tm_key").agg(F.count(F.lit(1)).alias("__tm_met")).filter("__tm_met > 1").select("__tm_side", "__tm_key"), "shared")
    kept = halves.join(shared, ["__tm_side", "__tm_key"])
    # at most 2 m half-keys a set
    first = F.when(F.col("__tm_side") < m, F.col("__tm_key"))  # sets that share a table share one of collection A
    own = cut(kept.groupBy("__tm_set").agg(F.collect_list("__tm_side").alias("__tm_sides"), F.collect_list("__tm_key").alias("__tm_values"), F.collect_list(first).alias("__tm_first")), "half-keys")
    tables = own.select("__tm_set", "__tm_sides", "__tm_values").mapInArrow(_table_keys(m), "__tm_set binary, __tm_key long")
    held = own.select("__tm_set", F.col("__tm_first").alias("__tm_values")).join(reps.select("__tm_set", "__tm_sketch"), "__tm_set")
    family = connected_components(_alike(tables, held, least_shared(percent / 100, 2 * m * HALF)))
    degree = own.select("__tm_set", F.size("__tm_sides").alias("__tm_degree"))
    members = family.select(F.col("node").alias("__tm_set"), F.col("label").alias("__tm_family"))
    members = members.join(degree, "__tm_set").join(reps.select("__tm_set", "__tm_row"), "__tm_set")
    members = cut(members.select("__tm_set", "__tm_family", "__tm_degree", "__tm_row"), "members")
    # the members' texts are read again; the small side is hashed, so texts aren't sorted
    row = F.col("__tm_id").eqNullSafe(F.col("__tm_row.__tm_id")) & (F.xxhash64("__tm_text") == F.col("__tm_row.__tm_hash"))
    found = texts.join(members.hint("shuffle_hash"), row)
    full = found.select("__tm_set", "__tm_family", "__tm_degree", "__tm_text").mapInArrow(_full_sets(words), "__tm_set binary, __tm_family binary, __tm_degree int, __tm_full binary")
    full = cut(full, "sets")
    if full.count() > members.count():  # rows that repeat id and text
        full = cut(full.dropDuplicates(["__tm_set"]), "sets")
    hubs = cut(full.groupBy("__tm_family").agg(F.max_by("__tm_set", F.struct("__tm_degree", "__tm_set")).alias("__tm_hub")), "hub-names")
    hubs = cut(full.select(F.col("__tm_set").alias("__tm_hub"), F.col("__tm_full").alias("__tm_hubset")).join(hubs, "__tm_hub").dropDuplicates(["__tm_family"]), "hubs")
    star = full.join(hubs, "__tm_family").select("__tm_set", "__tm_family", "__tm_full", "__tm_hub", "__tm_hubset")
    star = cut(star.mapInArrow(_against_hub(percent), "__tm_set binary, __tm_family binary, __tm_linked boolean, __tm_hub binary"), "stars")
    # blocks by hash: 0, 1, ... hold the members linked to the hub, -1, -2, ... the others
    sizes = star.groupBy("__tm_family").agg(F.ceil(F.sum(F.col("__tm_linked").cast("int")) / BLOCK).cast("int").alias("__tm_in"), F.ceil(F.sum((~F.col("__tm_linked")).cast("int")) / BLOCK).cast("int").alias("__tm_out"))
    sizes = cut(sizes.filter("__tm_out > 0"), "blocks")
    place = F.pmod(F.xxhash64("__tm_set"), F.greatest(F.lit(1), F.when(F.col("__tm_linked"), F.col("__tm_in")).otherwise(F.col("__tm_out")))).cast("int")
    placed = star.join(sizes, "__tm_family").withColumn("__tm_block", F.when(F.col("__tm_linked"), place).otherwise(-1 - place))
    others = F.transform(F.sequence(F.lit(1), F.col("__tm_out")), lambda n: -n)
    inner = F.when(F.col("__tm_in") > 0, F.sequence(F.lit(0), F.col("__tm_in") - 1)).otherwise(F.array().cast("array<int>"))
    partners = F.when(F.col("__tm_linked"), others).otherwise(F.concat(others, inner))
    pairs = placed.withColumn("__tm_partner", F.explode(partners)).join(full.select("__tm_set", "__tm_full"), "__tm_set")
    pairs = pairs.select(
        "__tm_family", F.least("__tm_block", "__tm_partner").alias("__tm_one"), F.greatest("__tm_block", "__tm_partner").alias("__tm_two"), "__tm_block", "__tm_set", "__tm_full"
    )
    rest = pairs.groupBy("__tm_family", "__tm_one", "__tm_two").applyInArrow(_blocks(percent), "a binary, b binary")
    return star.filter("__tm_linked").select(F.col("__tm_set").alias("a"), F.col("__tm_hub").alias("b")).unionByName(rest)


def _labelled(df: DataFrame, doc_id: str, text: str, words: int, percent: int) -> DataFrame:
    """Per input row: id, number of shingles, digest of the shingle set, hash of the text, label and smallest id of its component."""
    prepare(df)
    m = half_keys(percent / 100)
    source = df.select(named(doc_id).alias("__tm_id"), named(text).cast("string").alias("__tm_text"))
    kind = df.schema[doc_id].dataType.simpleString()
    rows = source.withColumn("__tm_hash", F.xxhash64("__tm_text"))
    rows = cut(rows.mapInArrow(_signatures(words, m, HALF), f"__tm_id {kind}, __tm_n long, __tm_set binary, __tm_keys binary, __tm_sketch binary, __tm_hash long"), "signatures")
    with scratch():
        labels = connected_components(_links(source, rows, words, percent, m)).withColumnRenamed("node", "__tm_set")
        sets = cut(rows.filter("__tm_set is not null").groupBy("__tm_set").agg(F.min("__tm_id").alias("__tm_least")), "set-ids")
        marked = cut(sets.join(labels, "__tm_set", "left").select("__tm_set", "__tm_least", F.coalesce("label", "__tm_set").alias("__tm_label")), "named")
        least = cut(marked.groupBy("__tm_label").agg(F.min("__tm_least").alias("__tm_component")), "components")
        final = cut(marked.join(least, "__tm_label").select("__tm_set", "__tm_label", "__tm_component"), "final", keep=True)
    return rows.select("__tm_id", "__tm_n", "__tm_set", "__tm_hash").join(final, "__tm_set", "left")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """Per input row: id, n_shingles, component_id (smallest id reachable), set (digest of the shingle set)."""
    return _labelled(df, doc_id, text, words, percent).select(
        F.col("__tm_id").alias(doc_id),
        F.col("__tm_n").alias("n_shingles"),
        F.when(F.col("__tm_set").isNull(), F.col("__tm_id")).otherwise(F.col("__tm_component")).alias("component_id"),
        F.col("__tm_set").alias("set"),
    )


def near_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stay: of each component the row with the smallest id, with its columns unchanged.

    A null id comes last; ties go to the smaller digest of the shingle set, then the smaller hash of the text. A row is
    told by its id and its text, so other texts under the same id stay; of rows equal in both one stays."""
    rows = _labelled(df, doc_id, text, words, percent).filter("__tm_set is not null")
    rows = cut(rows.select("__tm_label", F.struct(F.col("__tm_id").isNull().alias("none"), F.col("__tm_id").alias("id"), F.col("__tm_set").alias("set"), F.col("__tm_hash").alias("hash")).alias("__tm_row")), "labelled")
    first = rows.groupBy("__tm_label").agg(F.min("__tm_row").alias("__tm_first"))
    lost = rows.join(first, "__tm_label").filter(F.col("__tm_row") != F.col("__tm_first"))
    lost = cut(lost.select(F.col("__tm_row.id").alias("__tm_doc"), F.col("__tm_row.hash").alias("__tm_text")).distinct(), "lost")
    key = {"__tm_id": named(doc_id), "__tm_hash": F.xxhash64(named(text).cast("string"))}
    whole = packed(df, **key)
    same = F.col("__tm_id").eqNullSafe(F.col("__tm_doc")) & (F.col("__tm_hash") == F.col("__tm_text"))
    left = whole.join(lost.hint("shuffle_hash"), same, "left_anti")
    hashed = df.select(*[c.alias(k) for k, c in key.items()])
    twice = cut(hashed.groupBy("__tm_id", "__tm_hash").count().filter("count > 1").select(F.col("__tm_id").alias("__tm_doc"), F.col("__tm_hash").alias("__tm_text")), "repeated")
    if twice.isEmpty():
        return unpacked(left, df.columns)
    again, once = left.join(twice, same, "left_semi"), left.join(twice, same, "left_anti")
    order = Window.partitionBy("__tm_id", "__tm_hash").orderBy(F.lit(0))
    again = again.withColumn("__tm_no", F.row_number().over(order)).filter("__tm_no = 1").drop("__tm_no")
    return unpacked(once.unionByName(again), df.columns)
