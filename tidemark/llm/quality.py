"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing. Expectation-maximisation (votes independent given the
class) estimates each labeller's accuracy and the share of good documents, without any true label; the posterior
labels then train a linear scorer over hashed features by gradient descent. Labellers look at shape and repetition,
never at lang, source or id.

Fitting uses a bounded sample: about ``SAMPLE_ROWS`` documents, those whose id hashes lowest. Scoring reads every
whole text.

Defined results: null and empty texts are scored as the empty text; without rows to fit, every score is 0.5, and every
row is kept; repeated rows each get their row; other columns, whatever their names, are not read; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, named, prepare, sample_by_hash

SAMPLE_ROWS = 6000
BUCKETS = 1 << 12
ROUNDS, STEPS = 60, 800
GOOD, SURE = 0.5, 40.0
MEMORY_WORDS = 300_000
_RUNS = (("A", re.compile(r"[A-Z]+")), ("0", re.compile(r"[0-9]+")), ("a", re.compile(r"[^\W\d_A0]+")))
STATS = ("mean word", "letters", "capitals", "repeats", "distinct", "top word", "marks in words", "marks", "digits", "lines", "repeated lines", "sentence ends")


class Shapes:
    """What is remembered of distinct words: hashed shape, letters, capitals, marks, digits."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int, int, int]] = {}

    def __call__(self, word: str) -> tuple[int, int, int, int, int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > MEMORY_WORDS:
                self.known.clear()
            shape = word
            for to, run in _RUNS:
                shape = run.sub(to, shape)
            letters = sum(map(str.isalpha, word))
            digits = sum(map(str.isdigit, word))
            capitals = sum(map(str.isupper, word))
            found = self.known[word] = (zlib.crc32(shape.encode()) % BUCKETS, letters, capitals, len(word) - letters - digits, digits)
        return found


shapes = Shapes()


def features(text: str) -> tuple[list[float], dict[int, float]]:
    """Statistics of a whole text, and its hashed features with their weights."""
    words = WORD.findall(text)
    n = max(len(words), 1)
    count = Counter(words)
    chars = max(sum(map(len, words)), 1)
    hashed: Counter = Counter()
    letters = capitals = marks = digits = odd = 0
    for word, k in count.items():
        shape, a, b, c, d = shapes(word)
        hashed[shape] += k
        letters += a * k
        capitals += b * k
        marks += c * k
        digits += d * k
        odd += k * (c > 1 or c == 1 and len(word) == 1)
    lines = [x for x in text.split("\n") if x.strip()]
    repeats = sum(map(str.__eq__, words, words[1:]))
    top = max(count.values(), default=0)
    stats = [
        chars / n, letters / chars, capitals / max(letters, 1), repeats / n, len(count) / n, (top / n) if n > 20 else 0.0, odd / n, marks / chars, digits / chars,
        len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1), text.count(".") / n,
    ]
    weights = {k: v / n for k, v in hashed.items()}
    # ten steps of each statistic are hashed features too; a text of few words has no meaningful rates of repetition
    for k, x in enumerate(stats):
        weights[zlib.crc32(f"{k}:{min(int(x * (1 if k == 0 else 20)), 20)}".encode()) % BUCKETS] = 1.0
    return stats, weights


def votes(stats: list[float]) -> list[int]:
    """1 good, -1 bad, 0 no opinion, of each labeller. Most look for one fault and have no opinion otherwise."""
    mean, letters, capitals, repeats, distinct, top, odd, marks, digits, lines, again, ends = stats
    fault = lambda x, most: -1 if x > most else 0
    return [
        fault(abs(mean - 6), 4.0), fault(1 - letters, 0.15), fault(capitals, 0.3), fault(repeats, 0.1), fault(1 - distinct, 0.95), fault(top, 0.25), fault(odd, 0.15),
        fault(marks, 0.12), fault(digits, 0.15), fault(again, 0.4), fault(lines, 0.5),
        1 if letters > 0.9 and odd < 0.08 and capitals < 0.2 else 0, 1 if repeats < 0.04 and top < 0.2 and again < 0.2 else 0, 1 if ends > 0.02 and lines < 0.2 else 0,
    ]


def expectation_maximisation(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each row, P(vote | class) of each labeller, share of good rows).

    A labeller has, for either class, rates of the votes bad, none, good. Votes that were cast are evidence; having no
    opinion is none, for a row has one fault or another, seldom many. Rows with any fault start as bad, and bounds keep
    EM from taking one kind of fault for the class: a fault vote is at least ``SURE`` times as likely on bad rows as on
    good ones, a good vote at most twice as likely on good rows as on bad ones."""
    share, one = 0.8, np.stack([v == k for k in (-1, 0, 1)], axis=2).astype(float)
    post = np.where((v < 0).any(axis=1), 0.1, 0.95)
    rates = np.zeros((v.shape[1], 2, 3))
    for n in range(ROUNDS):
        if n:
            odds = np.log(share / (1 - share)) + (one[:, :, (0, 2)] * np.log(rates[:, 1] / rates[:, 0])[None, :, (0, 2)]).sum(axis=(1, 2))
            post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        share = float(np.clip(post.mean(), 0.02, 0.98))
        for c, weight in enumerate((1 - post, post)):
            rates[:, c] = (np.einsum("n,nlv->lv", weight, one) + 1) / (weight.sum() + 3)
        rates[:, 1, 0] = np.minimum(rates[:, 1, 0], rates[:, 0, 0] / SURE)
        rates[:, 0, 2] = np.maximum(rates[:, 0, 2], rates[:, 1, 2] / 2)
    return post, rates, share


def fit_features(rows: list[tuple[list[float], dict[int, float]]]) -> np.ndarray:
    """Weights of the hashed features, the last for the constant, from (statistics, hashed features) of a sample."""
    if not rows:
        return np.zeros(BUCKETS + 1)
    post, _, _ = expectation_maximisation(np.array([votes(s) for s, _ in rows]))
    at = np.repeat(np.arange(len(rows)), [len(w) for _, w in rows])
    col = np.array([c for _, w in rows for c in w])
    val = np.array([x for _, w in rows for x in w.values()])
    w, b, g2 = np.zeros(BUCKETS), 0.0, np.full(BUCKETS + 1, 1e-8)
    for _ in range(STEPS):
        z = np.bincount(at, val * w[col], len(rows)) + b
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - post
        grad = np.append(np.bincount(col, val * err[at], BUCKETS), err.sum()) / len(rows) + np.append(1e-5 * w, 0)
        g2 += grad**2
        step = 0.5 * grad / np.sqrt(g2)
        w -= step[:-1]
        b -= step[-1]
    return np.append(w, b)


def classify(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: id, score (0 to 1, higher is better), kept (score of at least 0.5), votes_good, votes_bad."""
    spark = prepare(df)
    some = sample_by_hash(df.select(named(doc_id), named(text).cast("string").alias("t")), named(doc_id), rows, df.count())

    def compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in got], pa.list_(pa.float64())), pa.array([list(w) for _, w in got], pa.list_(pa.int32())), pa.array([list(w.values()) for _, w in got], pa.list_(pa.float64()))], ["s", "c", "x"])

    # features of a bounded sample, not its texts, come to the driver
    held = some.mapInArrow(compact, "s array<double>, c array<int>, x array<double>").collect()
    shared = spark.sparkContext.broadcast(fit_features([(r[0], dict(zip(r[1], r[2], strict=True))) for r in held]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores, good, bad = [], [], []
            for t in batch.column(1).to_pylist():
                stats, own = features(t or "")
                z = w[-1] + sum(w[c] * x for c, x in own.items())
                scores.append(float(1 / (1 + np.exp(-z))))
                v = votes(stats)
                good.append(v.count(1))
                bad.append(v.count(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([s >= GOOD for s in scores], pa.bool_()), pa.array(good, pa.int32()), pa.array(bad, pa.int32())], [doc_id, "score", "kept", "votes_good", "votes_bad"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(named(doc_id), named(text).cast("string")).mapInArrow(run, f"`{doc_id}` {kind}, score double, kept boolean, votes_good int, votes_bad int")
