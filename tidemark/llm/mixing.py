"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: sources in code point order (null last) weigh ``WEIGHTS`` in turn and share ``share`` of all words; no
target exceeds ``most`` times its source, the excess is reshared by weight. A source is cut into shards of about
``SHARD_DOCS`` documents by a seeded hash, and the words of a shard, in seeded order, into blocks of ``BLOCK_WORDS``
words, the last one of a shard with what is left. Seats (blocks to take) go to sources, then to groups of shards, then
to shards, each time by the highest quotients w / (2k + 1). Inside a shard a seeded systematic draw picks exactly its
quota of blocks, some of them once more than others, none more than ``most`` times. So a source misses its target by
half a block, and by what its shards' last blocks lack.

No task ever needs a whole source: shards are small, and a level apportions at most ``FAN`` children of a parent, the
uppermost one at most a ``FAN * FAN``-th of a source's shards. Sources, of which there may be many, are ranked and
summed up in parts by range (``ordered``).

Defined results: a null text has 0 words; a null source is a source of its own; documents of 0 words take nothing;
repeated rows each count, and lie in one shard; an empty table gives an empty table. Other columns keep their names,
whatever they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_PATTERN, cut, named, packed, prepare

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Words in a block.
BLOCK_WORDS = 32
SHARD_DOCS, FAN = 64, 64
SEED = 20240601


def _placed(doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    """Work columns of a row: id, source, words, and its place in the seeded order. Rows without an id are told by text."""
    return {
        "__tm_id": named(doc_id),
        "__tm_source": named(source),
        "__tm_words": F.coalesce(F.regexp_count(named(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long"),
        "__tm_place": F.xxhash64(named(doc_id), named(text), F.lit(seed)),
        "__tm_tie": F.xxhash64(named(text)),
    }


def ordered(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``__tm_rank`` (from 1) in an order of all rows and, for each column of ``sums``, its sum over the rows
    before as ``__tm_before_*``. Rows are dealt out by range; what a range adds to the later ones is a row a partition."""
    placed = cut(df.repartitionByRange(*order).withColumn("__tm_part", F.spark_partition_id()), "ordered")
    each = placed.groupBy("__tm_part").agg(F.count(F.lit(1)).alias("__tm_rank0"), *[F.sum(c).alias(f"{c}0") for c in sums])
    line = Window.orderBy("__tm_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("__tm_part", *[F.coalesce(F.sum(c).over(line), F.lit(0)).alias(c) for c in ("__tm_rank0", *(f"{c}0" for c in sums))])
    own = Window.partitionBy("__tm_part").orderBy(*order)
    prior = own.rowsBetween(Window.unboundedPreceding, -1)
    work = {"__tm_rank": F.row_number().over(own) + F.col("__tm_rank0")}
    work |= {f"__tm_before_{c}": F.coalesce(F.sum(c).over(prior), F.lit(0)) + F.col(f"{c}0") for c in sums}
    return placed.join(F.broadcast(each), "__tm_part").withColumns(work).drop("__tm_part", *each.columns)


def targets(rows: DataFrame, share: float, most: int, weights: tuple[int, ...]) -> DataFrame:
    """A row per source: number, words, target, shards. As many rows as sources; all sums are of whole numbers."""
    s = rows.groupBy("__tm_source").agg(F.sum("__tm_words").alias("__tm_total"), F.count(F.lit(1)).alias("__tm_docs"))
    s = ordered(s, [F.col("__tm_source").asc_nulls_last()]).withColumnRenamed("__tm_rank", "__tm_no")
    s = s.withColumn("__tm_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("__tm_no") - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("__tm_cap", F.col("__tm_total") * most)
    # the level at which a source reaches its cap; all sources whose level is below the common one are capped
    limit = F.col("__tm_cap") / F.col("__tm_weight")
    s = cut(ordered(s, [limit, F.col("__tm_no")], ("__tm_cap", "__tm_weight")), "levels")
    all_ = s.agg(F.sum("__tm_total").alias("__tm_words"), F.sum("__tm_weight").alias("__tm_weights"))
    level = (F.lit(float(share)) * F.col("__tm_words") - F.col("__tm_before___tm_cap")) / (F.col("__tm_weights") - F.col("__tm_before___tm_weight"))
    levels = s.crossJoin(F.broadcast(all_)).select(level.alias("__tm_level"), limit.alias("__tm_limit"), "__tm_rank")  # one row
    common = levels.filter("__tm_level <= __tm_limit").agg(F.coalesce(F.min_by("__tm_level", "__tm_rank"), F.lit(float("inf"))).alias("__tm_common"))
    s = s.crossJoin(F.broadcast(common)).withColumn("__tm_target", F.least(F.col("__tm_cap").cast("double"), F.col("__tm_common") * F.col("__tm_weight")))
    return s.select("__tm_no", "__tm_source", "__tm_total", "__tm_target", F.ceil(F.col("__tm_docs") / SHARD_DOCS).cast("long").alias("__tm_shards"))


def apportion(children: DataFrame, parent: list[str], child: str, weight: str, seats: str) -> DataFrame:
    """Sainte-Lague: gives the ``seats`` of each parent to its children by the highest quotients; without a parent, those
    of any row to all of them.

    ``children`` has a row per child with its weight and its parent's seats. With n children of total weight W the
    common divisor lies between W / (seats + n / 2) and W / (seats - n / 2): below that range every seat is sure,
    above it none is possible, so at most about 2 n quotients are ranked.
    """
    group = Window.partitionBy(*parent)

    def beside(rows: DataFrame, **of_group: Column) -> DataFrame:
        """Rows with aggregates of their group."""
        if parent:
            return rows.withColumns({k: c.over(group) for k, c in of_group.items()})
        return rows.crossJoin(F.broadcast(rows.agg(*[c.alias(k) for k, c in of_group.items()])))  # one row

    c = beside(children, __tm_sum=F.sum(weight), __tm_n=F.count(F.lit(1)))
    half = F.col("__tm_n") / 2.0
    share = lambda add: F.when(F.col("__tm_sum") > 0, F.col(weight) * F.greatest(F.lit(0.0), F.col(seats) + add) / F.col("__tm_sum")).otherwise(0.0)
    c = c.withColumns({"__tm_sure": F.greatest(F.lit(0), F.ceil(share(-half) - 0.5)).cast("long"), "__tm_upto": F.floor(share(half) + 0.5).cast("long")})
    c = beside(c, __tm_given=F.sum("__tm_sure")).withColumn("__tm_open", F.col(seats) - F.col("__tm_given"))
    k = F.explode(F.when(F.col("__tm_upto") > F.col("__tm_sure"), F.sequence("__tm_sure", F.col("__tm_upto") - 1)).otherwise(F.array(F.lit(-1).cast("long"))))
    q = c.withColumn("__tm_k", k).withColumn("__tm_q", F.when(F.col("__tm_k") >= 0, F.col(weight) / (2.0 * F.col("__tm_k") + 1)).otherwise(-1.0))
    q = q.select(*parent, child, "__tm_sure", "__tm_open", "__tm_k", "__tm_q")
    order = [F.desc("__tm_q"), F.col(child).asc()]
    q = q.withColumn("__tm_rank", F.row_number().over(group.orderBy(*order))) if parent else ordered(q, order)
    won = ((F.col("__tm_rank") <= F.col("__tm_open")) & (F.col("__tm_k") >= 0)).cast("long")
    return q.groupBy(*parent, child).agg((F.max("__tm_sure") + F.sum(won)).alias("__tm_seats"))


def quotas(rows: DataFrame, sources: DataFrame, most: int, block: int, seed: int) -> DataFrame:
    """A row per shard: source number, shard, blocks, quota, and where its draw begins."""
    shards = rows.groupBy("__tm_no", "__tm_shard").agg(F.sum("__tm_words").alias("__tm_words")).filter("__tm_words > 0")
    shards = shards.withColumn("__tm_blocks", F.ceil(F.col("__tm_words") / block).cast("long"))
    shards = cut(shards.select("__tm_no", "__tm_shard", "__tm_blocks", F.expr(f"__tm_shard div {FAN}").alias("__tm_mid"), F.expr(f"__tm_shard div {FAN * FAN}").alias("__tm_top")), "shards")
    # the seats a source would have if seats could be split; their whole number goes out by quotients
    per = shards.groupBy("__tm_no").agg(F.sum("__tm_blocks").alias("__tm_blocks"))
    per = per.join(sources, "__tm_no").withColumn("__tm_want", F.col("__tm_target") / F.col("__tm_total") * F.col("__tm_blocks"))
    per = cut(per.select("__tm_no", "__tm_blocks", "__tm_want"), "wants")
    # summed in whole millionths, so that the order of rows does not matter
    due = per.agg(F.round(F.sum(F.round(F.col("__tm_want") * 1e6).cast("long")) / 1e6).cast("long").alias("__tm_due"))
    won = apportion(per.crossJoin(F.broadcast(due)), [], "__tm_no", "__tm_want", "__tm_due")  # one row
    held = per.join(won, "__tm_no").select("__tm_no", F.least("__tm_seats", F.col("__tm_blocks") * most).alias("__tm_due"))
    keys = ["__tm_no"]
    for part in ("__tm_top", "__tm_mid", "__tm_shard"):
        level = shards.groupBy(*keys, part).agg(F.sum("__tm_blocks").alias("__tm_weight"))
        won = apportion(level.join(held, keys), keys, part, "__tm_weight", "__tm_due")
        keys = [*keys, part]
        held = cut(won.select(*keys, F.col("__tm_seats").alias("__tm_due")), "quotas")
    quota = held.select("__tm_no", "__tm_shard", F.col("__tm_due").alias("__tm_quota"))
    turn = F.pmod(F.xxhash64("__tm_no", "__tm_shard", F.lit(seed)), "__tm_blocks")
    return cut(shards.join(quota, ["__tm_no", "__tm_shard"]).select("__tm_no", "__tm_shard", "__tm_blocks", "__tm_quota", turn.alias("__tm_turn")), "shares")


def _times(block: Column) -> Column:
    """How often a block of its shard is taken: the quota spread evenly, some blocks once more than others."""
    n, q, j = F.col("__tm_blocks"), F.col("__tm_quota"), block + F.col("__tm_turn")
    odd = q % n  # that many blocks are taken once more
    return (F.floor(q / n) + F.floor((j + 1) * odd / n) - F.floor(j * odd / n)).cast("long")


def _pieces(block: int) -> Column:
    """The blocks that a document meets: array of (start, end, times) in words of the document."""
    at, size = F.col("__tm_start"), F.col("__tm_words")

    def piece(i: Column) -> Column:
        return F.struct(F.greatest(F.lit(0), i * block - at).cast("long").alias("start"), F.least(size, (i + 1) * block - at).cast("long").alias("end"), _times(i).alias("times"))

    met = F.sequence(F.expr(f"__tm_start div {block}"), F.expr(f"(__tm_start + __tm_words - 1) div {block}"))
    return F.when(size > 0, F.transform(met, piece)).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,times:bigint>>"))


def _laid(df: DataFrame, whole: bool, doc_id: str, text: str, source: str, share: float, most: int, weights: tuple[int, ...], block: int, seed: int) -> DataFrame:
    """The rows of ``df``, as work columns or ``whole`` ones packed beside them, each with its source's figures and its pieces."""
    prepare(df)
    placed = _placed(doc_id, text, source, seed)
    sized = cut(df.select(*[c.alias(k) for k, c in placed.items()]), "sizes")
    rows = packed(df, **placed) if whole else sized
    sources = cut(targets(sized, share, most, weights), "sources")
    of = sources.withColumnRenamed("__tm_source", "__tm_name")
    near = lambda x: x.join(of, F.col("__tm_source").eqNullSafe(F.col("__tm_name"))).withColumn("__tm_shard", F.pmod("__tm_place", "__tm_shards"))
    shares = quotas(near(sized), sources, most, block, seed)
    line = Window.partitionBy("__tm_no", "__tm_shard").orderBy("__tm_place", "__tm_id", "__tm_tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = near(rows).join(shares, ["__tm_no", "__tm_shard"], "left").withColumn("__tm_start", F.coalesce(F.sum("__tm_words").over(line), F.lit(0)))
    return laid.withColumn("__tm_pieces", _pieces(block))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """A row per input row: id, source, size, source_size, target, taken, pieces (the blocks met and how often each is taken)."""
    rows = _laid(df, False, doc_id, text, source, share, most, weights, block, seed)
    taken = F.aggregate("__tm_pieces", F.lit(0).cast("long"), lambda a, p: a + (p["end"] - p["start"]) * p["times"])
    return rows.select(
        F.col("__tm_id").alias(doc_id),
        F.col("__tm_source").alias(source),
        F.col("__tm_words").alias("size"),
        F.col("__tm_total").alias("source_size"),
        F.col("__tm_target").alias("target"),
        taken.alias("taken"),
        F.col("__tm_pieces").alias("pieces"),
    )


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", length: str | None = "n_chars", share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixture itself: each input row once for every pass that takes words of it, its text cut to those words.

    A document taken whole keeps its text as it is; a document of which some blocks are taken has these blocks'
    words, each with the white space that follows it. ``length``, if the table has that column, is set to the
    characters of the new text. Documents of 0 words are not part of any block and go.
    """
    met = _laid(df, True, doc_id, text, source, share, most, weights, block, seed)
    words = lambda fits: F.aggregate("__tm_pieces", F.lit(0).cast("long"), lambda a, p: a + F.when(fits(p), p["end"] - p["start"]).otherwise(0))
    passes = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.struct(k.alias("no"), words(lambda p: p["times"] >= k).alias("got")))
    met = met.withColumn("__tm_pass", F.explode(passes)).filter("__tm_pass.got > 0")
    of = lambda c: F.col("__tm_row").getField(c)
    # a document is cut into words once, and each word asks its block: nothing is looked up for every block
    all_ = F.regexp_extract_all(of(text), F.lit(f"{WORD_PATTERN}[\\x20\\x09-\\x0D]*"), F.lit(0))
    some = F.filter(all_, lambda _, n: _times(F.floor((F.col("__tm_start") + n) / block)) >= F.col("__tm_pass.no"))
    met = met.withColumn("__tm_text", F.when(F.col("__tm_pass.got") == F.col("__tm_words"), of(text)).otherwise(F.array_join(some, "")))
    return met.select(*[(F.col("__tm_text") if c == text else F.char_length("__tm_text").cast(df.schema[c].dataType) if c == length else of(c)).alias(c) for c in df.columns])
