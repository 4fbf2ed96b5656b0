"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of up to ``ORDER`` bytes gives each next byte a probability: seen bytes
by their counts, unseen ones through an escape to the shorter context (method C, with exclusion). The statistics
are frozen after training, so the code length of a byte depends on nothing but the bytes before it: it is a table
entry, or an escape and an entry of a shorter context, and a text's exact code length in every language is a sum of
entries over the whole text.

Training counts the (ORDER + 1)-grams of a bounded sample: about ``SAMPLE_DOCS`` documents a language, those whose
id hashes lowest. Contexts seen fewer than ``LEAST`` times fall back to shorter ones; that limit is doubled until the
tables, which hold seen grams and contexts alone, take at most ``TABLE_BYTES``, so what is broadcast has a bound.

Defined results: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; without training
rows every text is; rows with a null language are never learned from; repeated rows each count; other columns, whatever
their names, are not read; an empty table gives an empty table. The language with the shortest code wins, of equal ones
the first in code point order; the score is its share of 2 ** -(bits a byte times ``SHARP``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, named, prepare

ORDER = 3
SAMPLE_DOCS = 1000
LEAST, TABLE_BYTES = 3, 64 << 20
SHARP = 24.0
CHUNK = 1 << 18
LETTER = regex.compile(r"\p{L}")
#: Symbols: 0 stands for the start of a text, others for bytes.
BASE = 257


def _codes(text: np.ndarray) -> np.ndarray:
    """Symbols of a text that follows ORDER starts."""
    return np.concatenate([np.zeros(ORDER, np.uint64), text.astype(np.uint64) + np.uint64(1)])


def _grams(text: np.ndarray) -> np.ndarray:
    """All (ORDER + 1)-grams of a text, as numbers."""
    padded = _codes(text)
    code = np.zeros(len(text), np.uint64)
    for n in range(ORDER + 1):
        code = code * np.uint64(BASE) + padded[n : n + len(text)]
    return code


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of grams by language, handed on before they grow: the aggregation that follows adds them up."""
    for batch in batches:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(_grams(np.frombuffer((text or "").encode("utf-8"), np.uint8)))
        for lang, codes in by.items():
            seen, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(seen), np.int64))), pa.array(seen.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])


class Lookup:
    """Rows of floats by number: a hash table with open addressing, all numbers of a query at once."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys, self.rows = keys, np.ascontiguousarray(rows, np.float32)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._first(keys)
        while len(left):
            free = self.slots[at] < 0
            _, one = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.slots[at[won]] = left[won]
            stays = np.ones(len(left), bool)
            stays[won] = False
            left, at = left[stays], (at[stays] + 1) & (len(self.slots) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each number, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._first(keys)
        row = self.slots[at]
        open_ = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            row[open_] = self.slots[at[open_]]
            now = row[open_]
            open_ = open_[(now >= 0) & (self.keys[now] != keys[open_])]
        return row

    def size(self) -> int:
        return self.keys.nbytes + self.rows.nbytes + self.slots.nbytes


class Ppm:
    """Frozen code lengths. ``seen[k]``: bits of the last symbol of a (k + 1)-gram that any language has seen, by language;
    ``escapes[k]``: bits that are added where a context of k symbols is known and the symbol after it was not seen."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int = LEAST) -> None:
        self.langs = sorted(counts)
        while True:
            self._tables(counts, least)
            if sum(t.size() for t in (*self.seen, *self.escapes)) <= TABLE_BYTES:
                break
            least *= 2

    def _tables(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], least: int) -> None:
        base, lowest = np.uint64(BASE), np.log2(256.0)  # below the empty context all bytes are alike
        self.seen, self.escapes = [], []
        for k in range(ORDER + 1):
            own = []
            for lang in self.langs:
                gram, at = np.unique(counts[lang][0].astype(np.uint64) % np.uint64(BASE ** (k + 1)), return_inverse=True)
                n = np.bincount(at, counts[lang][1], len(gram)) if len(gram) else np.zeros(0)
                context, where = np.unique(gram // base, return_inverse=True)
                total, kinds = (np.bincount(where, x, len(context)) if len(context) else np.zeros(0) for x in (n, None))
                known = total >= (least if k else 0)
                keep = known[where] if len(where) else np.zeros(0, bool)
                own.append((gram[keep], n[keep], where[keep], context, total, kinds, known))
            grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *[o[0] for o in own]]))
            contexts = np.unique(np.concatenate([np.zeros(0, np.uint64), *[o[3][o[6]] for o in own]]))
            # what a shorter context says of the same symbols, in every language
            below = np.full((len(grams), len(self.langs)), lowest)
            if k:
                short = self._resolved(grams % np.uint64(BASE**k), k - 1)
                below = short.astype(np.float64)
            bits, escape = below.copy(), np.zeros((len(contexts), len(self.langs)))
            for j, (gram, n, where, context, total, kinds, known) in enumerate(own):
                at = np.searchsorted(grams, gram)
                # mass of the shorter context that is left for symbols not seen here
                left = np.maximum(1 - np.bincount(where, np.exp2(-below[at, j]), len(context)) if len(context) else np.zeros(0), 1e-12)
                cost = -np.log2(np.maximum(kinds / np.maximum(total + kinds, 1) / left, 1e-300))
                escape[np.searchsorted(contexts, context[known]), j] = cost[known]
                of = np.minimum(np.searchsorted(contexts, grams // base), max(len(contexts) - 1, 0))
                if len(contexts):
                    bits[:, j] += np.where(contexts[of] == grams // base, escape[of, j], 0.0)
                bits[at, j] = -np.log2(n / (total + kinds)[where])
            self.seen.append(Lookup(grams, bits))
            self.escapes.append(Lookup(contexts, escape))

    def _resolved(self, grams: np.ndarray, k: int) -> np.ndarray:
        """(grams, languages): bits of the last symbol of (k + 1)-grams, by the longest contexts that know it."""
        out = np.zeros((len(grams), len(self.langs)), np.float32)
        todo = np.arange(len(grams))
        for j in range(k, -1, -1):
            row = self.seen[j].find(grams)
            hit = row >= 0
            out[todo[hit]] += self.seen[j].rows[row[hit]]
            todo, grams = todo[~hit], grams[~hit]
            if not len(todo):
                return out
            row = self.escapes[j].find(grams // np.uint64(BASE))
            hit = row >= 0
            out[todo[hit]] += self.escapes[j].rows[row[hit]]
            grams = grams % np.uint64(BASE ** max(j, 1)) if j else grams
        out[todo] += np.float32(np.log2(256.0))
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        start = 0
        while start < len(texts):
            end, held = start, 0
            while end < len(texts) and (end == start or held + len(texts[end]) <= CHUNK):
                held += len(texts[end]) + ORDER
                end += 1
            pad = b"\0" * ORDER
            sizes = np.array([len(t) for t in texts[start:end]])
            flat = np.frombuffer(b"".join(pad + t for t in texts[start:end]), np.uint8).astype(np.uint64) + np.uint64(1)
            first = np.concatenate([[0], np.cumsum(sizes + ORDER)])[:-1]
            for n in range(ORDER):
                flat[first + n] = 0
            for lo in range(0, len(flat), CHUNK):  # a very long text goes in parts; sums add up
                c = flat[max(0, lo - ORDER) : lo + CHUNK]
                if len(c) <= ORDER:
                    continue
                gram = np.zeros(len(c) - ORDER, np.uint64)
                for n in range(ORDER + 1):
                    gram = gram * np.uint64(BASE) + c[n : len(c) - ORDER + n]
                at = max(0, lo - ORDER) + ORDER + np.arange(len(gram))
                doc = np.searchsorted(first, at, "right") - 1
                real = at - first[doc] >= ORDER
                cost = self._resolved(gram[real], ORDER)
                for j in range(len(self.langs)):
                    out[start:end, j] += np.bincount(doc[real], cost[:, j], end - start)
            start = end
        return out


def train(df: DataFrame, doc_id: str, text: str, lang: str, train_rows: Column, docs: int = SAMPLE_DOCS) -> Ppm:
    """Model of a bounded sample of the rows for which ``train_rows`` holds: one pass counts the languages' rows, a second
    one takes from each language its share."""
    rows = df.filter(train_rows & named(lang).isNotNull()).select(named(lang).cast("string").alias("lang"), named(doc_id).alias("__tm_id"), named(text).cast("string").alias("text"))
    rate = rows.groupBy("lang").agg((F.lit(float(docs)) / F.count(F.lit(1))).alias("__tm_rate"))  # a row a language
    place = F.pmod(F.xxhash64("__tm_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    some = rows.join(rate, "lang").filter(place < F.col("__tm_rate"))
    grams = some.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
    table = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # bounded by the sample
    return Ppm({name: (own["gram"].to_numpy(np.int64), own["n"].to_numpy(np.float64)) for name, own in table.groupby("lang")})


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Ppm = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            raw = [t.encode("utf-8") for t in texts]
            langs, scores = ["und"] * len(texts), [0.0] * len(texts)
            if model.langs:
                bits = model.lengths(raw)
                size = np.maximum([len(r) for r in raw], 1)[:, None]
                power = np.exp2(-SHARP * (bits - bits.min(1, keepdims=True)) / size)
                share = power.max(1) / power.sum(1)
                for n, best in enumerate(bits.argmin(1)):
                    if LETTER.search(texts[n]):
                        langs[n], scores[n] = model.langs[best], float(share[n])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def identify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = SAMPLE_DOCS) -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Learns from the rows that aren't held out; predicts from the text alone."""
    spark = prepare(df)
    model = train(df, doc_id, text, lang, ~held_out(doc_id), docs)
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(named(doc_id), held_out(doc_id).alias("held_out"), named(text).cast("string"))
    return rows.mapInArrow(_predict(shared), f"`{doc_id}` {kind}, held_out boolean, lang_pred string, score double")
