"""Toxicity by Levenshtein automata intersected with a lexicon trie.

Learning, on a bounded sample of labelled rows (about ``SAMPLE_ROWS``, those whose id hashes lowest):
1. Words, and beginnings of words, that occur almost only in toxic documents become the lexicon. An entry is
   either a whole word, or a stem with which words begin. Entries that clean documents use too, but almost only toxic
   ones twice, are weak: one hit of theirs says nothing, two are hits.
2. The lexicon is a trie; the Levenshtein automaton of a word, intersected with it, finds all entries within one or
   two edits, stems within as many of some beginning of the word; weak entries allow none. The sets of (trie node, edits)
   that arise are the states of one automaton over letters, which is determined lazily, so a word is read letter by letter
   and most words end after two or three. It begins anew after ``MEMORY_STATES`` states.
3. A window of ``WINDOW`` characters about each hit tells quotation (quote marks around it, or a word of reporting)
   from abuse. How often a document is toxic is counted for its strongest kind of hit: exact or misspelt, plain or
   quoted. Misspelt forms that clean documents of the sample use are not hits, and a stem has no edits if its near
   spellings in the sample, with the prior of misspelt hits, would score below ``THRESHOLD``.

The score is 1 - (1 - p) ** (1 + ln(hits)), with p the smoothed rate of the strongest kind, and the smoothed rate of
hitless documents if there is no hit. The whole text is read.

Defined results: null and empty texts score as hitless ones; without labelled rows there is no lexicon, and every
document scores ``NO_HIT``; labels that are null or neither 0 nor 1 do not count, of several for an id the highest does;
repeated rows each get their row; other columns, whatever their names, are kept or not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fold, held_out, named, prepare, sample_by_hash, scratch, worker_memory

SAMPLE_ROWS = 8000
THRESHOLD = 0.7
WINDOW = 24
STEM, LONGEST, MOST_ENTRIES = 4, 16, 2000
#: Least share of toxic documents of those with an entry, least share of toxic documents that have it, and in how many
#: surroundings it must occur: copies of one document are no evidence that its words are toxic.
PURE, SUPPORT, VARIED, EVIDENCE = 0.9, 0.02, 8, 16
MEMORY_WORDS, MEMORY_STATES = 250_000, 100_000
#: Features that a task counts before it hands its counts on; the sums are made by the aggregation that follows.
MEMORY_FEATURES = 100_000
TOKEN = re.compile(r"[\w@$]+")
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("0134578@$", "oieastbas")
QUOTES = "\"'«»“”„‘’‹›`"
#: Words by which a writer reports another's words.
REPORTING = re.compile(r"\b(said|says|called|word|term|quote[sd]?|wrote|mot|terme|wort|palabra|dijo|sagte)\b")
KINDS = ("plain", "plain misspelt", "quoted", "quoted misspelt")
#: Prior rate of each kind, worth PRIOR documents.
PRIORS, PRIOR, NO_HIT = (0.97, 0.8, 0.35, 0.2), 4.0, 0.02


def edits_for(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


class Lexicon:
    """Trie of entries and the lazily determined automaton over it."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], exempt: Iterable[str] = (), rates: tuple[float, ...] = PRIORS, no_hit: float = NO_HIT, strict: Iterable[str] = (), weak: tuple[Iterable[str], Iterable[str]] = ((), ())) -> None:
        self.words, self.stems, self.exempt = sorted(set(words)), sorted(set(stems)), frozenset(exempt)
        self.rates, self.no_hit = rates, no_hit
        self.strict = sorted(set(strict))  # entries without edits
        #: Words and stems of which a text needs two.
        self.weak = tuple(tuple(sorted(set(w))) for w in weak)
        self.light = Lexicon(*self.weak, strict=[*self.weak[0], *self.weak[1]]) if any(self.weak) else None
        self.prepare()

    def __reduce__(self):
        return Lexicon, (self.words, self.stems, self.exempt, self.rates, self.no_hit, self.strict, self.weak)

    def prepare(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}  # node: edits allowed for the word that ends there
        self.begun: dict[int, int] = {}  # node at which a stem ends: edits allowed for the beginning of a word
        self.allow: list[int] = [0]  # most edits of any entry through the node
        for entries, is_stem in ((self.words, False), (self.stems, True)):
            for entry in entries:
                at, k = 0, 0 if entry in self.strict else edits_for(len(entry))
                self.allow[0] = max(self.allow[0], k)
                for letter in entry:
                    if letter not in self.children[at]:
                        self.children[at][letter] = len(self.children)
                        self.children.append({})
                        self.allow.append(0)
                    at = self.children[at][letter]
                    self.allow[at] = max(self.allow[at], k)
                if is_stem:
                    self.begun[at] = k
                else:
                    self.whole[at] = k
        self.memory: dict[str, int] = {}
        self.begin()

    def begin(self) -> None:
        """An automaton of no more than its first states."""
        self.steps: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        #: Numbers: 0 is the dead state, 1 the state in which a stem has been read exactly. Node -1: a stem has been read.
        self._state(frozenset())
        self._state(frozenset([(-1, 0)]))
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, low: dict[int, int], read: int = 99) -> frozenset:
        """With the letters of the entry that are skipped (deletions) at one edit each; ``read``: least edits to a stem so far."""
        todo = list(low)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                n = low[node] + 1
                if n <= self.allow[child] and n < low.get(child, 99):
                    low[child] = n
                    todo.append(child)
        read = min([read, *(n for node, n in low.items() if n <= self.begun.get(node, -1))])
        # whatever is not better than the stem that has been read can't become better
        return frozenset([*((node, n) for node, n in low.items() if n < read), *([(-1, read)] if read < 99 else [])])

    def _state(self, members: frozenset) -> int:
        if members not in self.numbers:
            self.numbers[members] = len(self.sets)
            self.sets.append(members)
            self.steps.append({})
            found = [n for node, n in members if node == -1 or n <= self.whole.get(node, -1)]
            self.ends.append(-1 if not found else min(found))
        return self.numbers[members]

    def _step(self, state: int, letter: str) -> int:
        """Next state: letters of the word match, replace one of the entry, or are added."""
        low: dict[int, int] = {}
        read = 99
        for node, n in self.sets[state]:
            if node == -1:
                read = n
                continue
            if n + 1 <= self.allow[node]:
                low[node] = min(low.get(node, 99), n + 1)
            for own, child in self.children[node].items():
                m = n + (own != letter)
                if m <= self.allow[child] and m < low.get(child, 99):
                    low[child] = m
        to = self.steps[state][letter] = self._state(self._closed(low, read))
        return to

    def edits(self, word: str) -> int:
        """Least edits to an entry within its allowance; -1 if there is none."""
        if len(self.sets) > MEMORY_STATES:
            self.begin()
        state, steps = self.start, self.steps
        for letter in word:
            to = steps[state].get(letter)
            if to is None:
                to = self._step(state, letter)
            if to < 2:
                return -1 if to == 0 else 0
            state = to
        return self.ends[state]

    def look(self, word: str) -> int:
        """As edits(), reading disguised letters too; a disguise is an edit. -2: an entry of the weak ones."""
        known = self.memory.get(word)
        if known is None:
            if len(self.memory) > MEMORY_WORDS:
                self.memory.clear()
            known = -1 if word in self.exempt else self.edits(word)
            if known and (plain := word.translate(DISGUISE)) != word and any(c.isalpha() for c in word):
                n = self.edits(plain)
                known = max(1, n) if n >= 0 else known
            if known == -1 and self.light and self.light.edits(word) == 0:
                known = -2
            self.memory[word] = known
        return known

    def hits(self, text: str) -> list[tuple[int, int, int, str]]:
        """(start, end, kind, form) of every hit in a text."""
        low = text.lower()
        look = self.look
        found = {w: n for w in set(TOKEN.findall(low)) if (n := look(w)) != -1}
        if not found:
            return []
        out = []
        for m in TOKEN.finditer(low):
            n = found.get(m[0])
            if n is not None:
                before, after = low[max(0, m.start() - WINDOW) : m.start()], low[m.end() : m.end() + WINDOW]
                quoted = (before.rstrip()[-1:] or " ") in QUOTES and (after.lstrip(" .,!?")[:1] or " ") in QUOTES or bool(REPORTING.search(before))
                out.append((m.start(), m.end(), n, 2 * quoted + (n > 0), m[0]))
        weak = sum(n == -2 for _, _, n, _, _ in out) >= 2
        return [(a, b, kind, form) for a, b, n, kind, form in out if weak or n != -2]

    def score(self, text: str) -> float:
        return self.score_of(self.hits(text))

    def score_of(self, hits: list[tuple[int, int, int, str]]) -> float:
        if not hits:
            return self.no_hit
        best = max(hits, key=lambda h: self.rates[h[2]])[2]
        return 1 - (1 - self.rates[best]) ** (1 + math.log(sum(h[2] == best for h in hits)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by label in which a word, or a beginning of a word, occurs (a whole word ends with a blank), and in which
    it occurs twice, and a sketch of the words before it in toxic ones: a bit for each of 63 hash values. A document adds
    the surroundings of its first occurrence alone, so that copies of a document that repeats a word do not look varied."""
    count: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0, 0])

    def counted() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), *[pa.array([own[k] for own in count.values()], pa.int64()) for k in range(5)]], ["f", "clean", "toxic", "clean2", "toxic2", "around"])
        count.clear()
        return rows

    with worker_memory("toxicity", forget):
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = TOKEN.findall((text or "").lower())
                times = Counter(words)
                before: dict[str, int] = {}
                for one, two in zip(["", *words], words, strict=False):
                    if two not in before:
                        before[two] = 1 << zlib.crc32(one.encode()) % 63
                seen: dict[str, int] = {}
                often: dict[str, int] = {}
                for w, bits in before.items():
                    if len(w) >= STEM:
                        for f in (w + " ", *(w[:k] for k in range(STEM, min(len(w), LONGEST) + 1))):
                            if f in seen:
                                often[f] += times[w]
                            else:
                                seen[f], often[f] = bits, times[w]
                for f, bits in seen.items():
                    own = count[f]
                    own[toxic] += 1
                    own[2 + toxic] += often[f] > 1
                    if toxic:
                        own[4] |= bits
                if len(count) > MEMORY_FEATURES:
                    yield counted()
        yield counted()


def choose(features: dict[str, tuple[int, int]]) -> tuple[list[str], list[str]]:
    """Words and stems from features that are nearly pure: of a line of beginnings the shortest that is pure, made
    longer as long as hardly any document is lost."""
    words, stems = [], []
    beginnings = sorted((f for f in features if not f.endswith(" ")), key=lambda f: (len(f), f))
    longer: dict[str, list[str]] = defaultdict(list)
    for f in beginnings:
        longer[f[:-1]].append(f)
    taken: list[str] = []
    for f in beginnings:
        if any(f.startswith(t) for t in taken):
            continue
        taken.append(f)
        while True:
            n = features[f][1]
            more = next((g for g in longer[f] if features[g][1] >= 0.95 * n), None)
            if more is None:
                break
            f = more
        # a beginning that is cut at the longest length is the stem of whatever follows
        whole = features.get(f + " ", (0, 0))[1] >= 0.8 * features[f][1]
        (words if whole else stems).append(f)
    return words, stems


def sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int) -> DataFrame:
    """(id, toxic, text) of about ``rows`` labelled rows that aren't held out, as a table."""
    own = labels.select(named(doc_id).alias("__tm_id"), F.col("toxic").cast("int").alias("__tm_toxic"))
    own = own.filter((fold("__tm_id") != 1) & F.col("__tm_toxic").isin(0, 1)).groupBy("__tm_id").agg(F.max("__tm_toxic").alias("__tm_toxic"))
    own = cut(sample_by_hash(own, F.col("__tm_id"), rows, own.count()), "labels")
    texts = df.select(named(doc_id).alias("__tm_id"), named(text).cast("string").alias("__tm_text"))
    return cut(texts.join(F.broadcast(own), "__tm_id").select("__tm_toxic", "__tm_text"), "sample")  # at most about ``rows`` labels


def learn(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> Lexicon:
    with scratch():  # the sample's tables
        return _learned(df, labels, doc_id, text, rows)


def _learned(df: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int) -> Lexicon:
    some = sample(df, labels, doc_id, text, rows)
    n = {r[0]: r[1] for r in some.groupBy("__tm_toxic").count().collect()}
    # a small sample asks for as many documents as a large one, as far as it has them: chance and copies make a few
    least = max(4, SUPPORT * n.get(1, 0), min(EVIDENCE, n.get(1, 0) / 8))
    # how often a document with the feature is toxic, against how often one is
    counts = some.mapInArrow(_features, "f string, clean long, toxic long, clean2 long, toxic2 long, around long").groupBy("f")
    counts = counts.agg(*[F.sum(c).alias(c) for c in ("clean", "toxic", "clean2", "toxic2")], F.bit_count(F.bit_or("around")).alias("around"))
    varied = F.col("around") >= min(VARIED, int(least) - 1)
    pure = lambda toxic, clean: (F.col(toxic) >= least) & (F.col(toxic) >= PURE * (F.col(toxic) + F.col(clean)))
    rows_ = counts.filter(varied & (pure("toxic", "clean") | pure("toxic2", "clean2"))).withColumn("strong", pure("toxic", "clean"))
    rows_ = rows_.orderBy(F.desc("strong"), F.desc("toxic"), F.length("f"), "f").limit(MOST_ENTRIES).collect()
    words, stems = choose({r["f"]: (r["clean"], r["toxic"]) for r in rows_ if r["strong"]})
    weak = choose({r["f"]: (r["clean2"], r["toxic2"]) for r in rows_})
    known = lambda f: any(f.startswith(t) for t in (*words, *stems))
    return calibrate(Lexicon(words, stems, weak=([f for f in weak[0] if not known(f)], [f for f in weak[1] if not known(f)])), some, n)


def calibrate(lexicon: Lexicon, some: DataFrame, n: dict[int, int]) -> Lexicon:
    """Rates of the kinds of hits, and the misspelt forms that clean documents use."""

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: Counter = Counter()
        with worker_memory("toxicity", forget):
            for batch in batches:
                for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    hits = lexicon.hits(text or "")
                    rows.update({("f", form, toxic) for _, _, kind, form in hits if kind % 2})
                    plain = {kind for _, _, kind, _ in hits if kind % 2 == 0}
                    rows[("k", str(min(plain) if plain else -1 if not hits else 9), toxic)] += 1
        keys = list(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int32()), pa.array([rows[k] for k in keys], pa.int64())],
            ["what", "name", "toxic", "n"],
        )

    found = some.mapInArrow(forms, "what string, name string, toxic int, n long").groupBy("what", "name", "toxic").agg(F.sum("n").alias("n")).collect()  # bounded by the sample
    by: dict[tuple[str, str], list[int]] = defaultdict(lambda: [0, 0])
    for what, name, toxic, count in found:
        by[what, name][toxic] += count
    # a stem whose near spellings are too often clean documents' words to pass for toxic is taken exactly; rates are counted anew
    near = [(name, clean, toxic) for (what, name), (clean, toxic) in by.items() if what == "f"]
    strict = []
    for stem in set(lexicon.stems).difference(lexicon.strict):
        alone = Lexicon([], [stem])
        mine = [(clean, toxic) for name, clean, toxic in near if alone.look(name) > 0]
        c, t = sum(c for c, _ in mine), sum(t for _, t in mine)
        if t + PRIOR * PRIORS[1] < THRESHOLD * (c + t + PRIOR):
            strict.append(stem)
    if strict:
        return calibrate(Lexicon(lexicon.words, lexicon.stems, strict=[*lexicon.strict, *strict], weak=lexicon.weak), some, n)
    # a form is exempt if documents with it are about as seldom toxic as others
    exempt = [name for (what, name), (clean, toxic) in by.items() if what == "f" and clean > toxic]
    rate = lambda k, kind: (by["k", str(kind)][1] + PRIOR * PRIORS[k]) / (sum(by["k", str(kind)]) + PRIOR)
    rates = (rate(0, 0), PRIORS[1], rate(2, 2), PRIORS[3])
    clean, toxic = by["k", "-1"]
    return Lexicon(lexicon.words, lexicon.stems, exempt, rates, (toxic + PRIOR * NO_HIT) / (clean + toxic + PRIOR), lexicon.strict, lexicon.weak)


_here: dict[str, Lexicon] = {}


def _held(shared) -> Lexicon:
    """The worker's own copy, with what it has learned of words so far."""
    lexicon = shared.value
    key = repr((lexicon.words, lexicon.stems, sorted(lexicon.exempt), lexicon.rates, lexicon.no_hit, lexicon.strict, lexicon.weak))
    if key not in _here:
        _here.clear()
        _here[key] = lexicon
    return _here[key]


def forget() -> None:
    """Drop the worker's copy; a named function, so that workers act on their own module and not on a copy of it."""
    _here.clear()


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted, hits (start, end, kind, form)."""
    spark = prepare(df)
    shared = spark.sparkContext.broadcast(learn(df, labels, doc_id, text, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("toxicity", forget):
            lexicon = _held(shared)
            for batch in batches:
                scores, hits = [], []
                for t in batch.column(2).to_pylist():
                    own = lexicon.hits(t or "")
                    scores.append(lexicon.score_of(own))
                    hits.append([{"start": a, "end": b, "kind": KINDS[k], "form": f} for a, b, k, f in own])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("form", pa.string())]))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, kind)],
                    [doc_id, "held_out", "score", "predicted", "hits"],
                )

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(named(doc_id), held_out(doc_id).alias("held_out"), named(text).cast("string")).mapInArrow(
        run, f"`{doc_id}` {kind}, held_out boolean, score double, predicted int, hits array<struct<start:int,end:int,kind:string,form:string>>"
    )


def keep_clean(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that score below the threshold, with their columns unchanged."""
    spark = prepare(df)
    shared = spark.sparkContext.broadcast(learn(df, labels, doc_id, text, rows))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("toxicity", forget):
            lexicon = _held(shared)
            for batch in batches:
                yield batch.filter(pa.array([lexicon.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    plain = df.toDF(*[f"c{n}" for n in range(len(df.columns))])  # names may hold any characters
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)
