"""Token counts of a unigram segmentation, shared along a trie of pre-tokens.

The pieces of a vocabulary file are the tokens; a piece's log probability is -ln(2 + its rank in the file), Zipf's law, as
the file has ranks and no probabilities, and tokenizers are not trained here. A text is cut at white space, each word led by the word mark; its best
segmentation has the greatest sum. Distinct pre-tokens go into a trie, and the forward score (best sum, and the
tokens in it) of a prefix is computed once for all words that begin with it; the node at which a word ends stores
its count. A character that no piece covers counts as its UTF-8 bytes, each at the log probability of the last rank.

Ties: of equal sums the fewer tokens, then the longer last token. Defined results: a null or empty text has 0
tokens; texts of any length are counted whole; repeated rows each get their row; other columns, whatever their names, are
not read; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import WORD, named, prepare, worker_memory

MARK = "▁"
MEMORY_WORDS = 250_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Unigram:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(n) for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))]
        self.setup({p: -math.log(2 + n) for n, p in enumerate(pieces)})

    def setup(self, scores: dict[str, float]) -> None:
        self.byte = -math.log(2 + len(scores))
        self.scores = scores
        #: Trie of the vocabulary: [children, log probability or None].
        self.root: list = [{}, None]
        for piece, score in scores.items():
            at = self.root
            for letter in piece:
                at = at[0].setdefault(letter, [{}, None])
            at[1] = score
        self.counts: dict[str, int] = {}
        self.fresh()

    def fresh(self) -> None:
        #: A node: (children, best sum of its prefix, tokens in it, runs). A run: (sum, tokens) before it, and where it is in the vocabulary's trie.
        self.trie: tuple = ({}, 0.0, 0, ())
        self.nodes = 0

    def learn(self, words: Iterable[str]) -> None:
        if self.nodes > MEMORY_WORDS:
            self.fresh()
        for word in sorted(words):  # in this order the walk is depth first
            node = self.trie
            for letter in MARK + word:
                child = node[0].get(letter)
                if child is None:
                    n = len(letter.encode("utf-8"))
                    best, tokens = -math.inf, 0
                    runs = []
                    for score, used, entry in (*node[3], (node[1], node[2], self.root)):
                        entry = entry[0].get(letter)
                        if entry is not None:
                            runs.append((score, used, entry))
                            if entry[1] is not None and (s := score + entry[1], -used - 1) > (best, -tokens):
                                best, tokens = s, used + 1
                    if best == -math.inf:
                        best, tokens = node[1] + n * self.byte, node[2] + n
                    child = node[0][letter] = ({}, best, tokens, tuple(runs))
                    self.nodes += 1
                node = child
            self.counts[word] = node[2]

    def count_batch(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        parts = [WORD.findall(t) for t in texts]
        if len(self.counts) > MEMORY_WORDS:
            self.counts.clear()
        self.learn({w for p in parts for w in p}.difference(self.counts))
        return [(sum(map(self.counts.__getitem__, p)), len(p)) for p in parts]


@lru_cache(maxsize=4)
def load(path: str) -> Unigram:
    return Unigram(path)


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, n_pretokens."""
    prepare(df)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("token counts", load.cache_clear):
            model = load(path)
            for batch in batches:
                rows = model.count_batch([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], [doc_id, "n_tokens", "n_pretokens"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(named(doc_id), named(text)).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, n_pretokens long")
