"""BPE encoding and decoding by a prefix-sharing trie.

The distinct words of a batch go into a trie of symbols; a depth-first walk gives every node the last token of its
prefix's encoding, so the encoding of a prefix that many words share is found once. Which token is last follows
from pairs alone: a sequence of tokens is the encoding of its text exactly if each token and each two neighbours
encode to themselves, since merges never cross a boundary that survives.

Words end with a symbol of their own (its character and the end-of-word mark), so the walk knows prefixes that are
inside a word and ends that are not. Texts are cut into words as the vocabulary file says: added tokens first, then
NFC and lower case, then the words of its pattern; white space is dropped.

Decoding takes ids alone: their names, joined by a space.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; texts of any
length are encoded whole; repeated rows each get their row; other columns, whatever their names, are not read; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import named, prepare, worker_memory

NEVER = 1 << 60
#: Texts within these characters need no look at the table of unassigned ones.
COMMON = re.compile("[^\x00-\u0377]")
#: Words that a worker remembers in each of two generations, and nodes of their trie; beyond that the older
#: generation goes, or the trie starts anew.
MEMORY_WORDS, MEMORY_NODES = 60_000, 100_000
#: Characters of texts that are encoded at once; a text is never cut.
SLICE = 500_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> re.Pattern:
    """Characters that this Python's Unicode tables leave unassigned."""
    free = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn"]
    first = [c for n, c in enumerate(free) if n == 0 or free[n - 1] != c - 1]
    last = [c for n, c in enumerate(free) if n == len(free) - 1 or free[n + 1] != c + 1]
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last, strict=True)) + "]")


class WordBpe:
    """A word-level BPE vocabulary with end-of-word symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end: str = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: n for n, pair in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {n: k for k, n in [*self.vocab.items(), *self.added.items()]}
        #: By id; the file's ids have no gaps to speak of.
        self.shown = [self.names.get(n, "") for n in range(max(self.names) + 1)]
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.letters = byte_letters()
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        # for ASCII texts the same pattern in the standard library's faster engine
        self.ascii_words = re.compile(split.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9").replace(r"\s", r" \t\n\r\x0b\x0c"))
        #: Trie of the vocabulary: [children, id inside a word, id at a word's end], -1 where there is none.
        self.entries: list = [{}, -1, -1]
        for token, number in self.vocab.items():
            body, at = token.removesuffix(self.end), self.entries
            for letter in body:
                at = at[0].setdefault(letter, [{}, -1, -1])
            at[1 + (body != token)] = number
        self.trie: tuple = ({}, -1, ())
        self.nodes = 0
        #: By pair of ids, the left one shifted by 20 bits: whether the second may follow the first.
        self.firm: dict[int, bool] = {}
        self.spines: dict[str, tuple[list[tuple[str, int]], list[tuple[str, int]]] | None] = {}
        self._library = path
        self.ids: dict[str, bytes] = {}
        #: The same of the generation before: words that are met again move on.
        self.before: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a few symbols: the pair of lowest rank first, from the left."""
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, NEVER), n) for n, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        body = token.removesuffix(self.end)
        return [*body[:-1], token[len(body) - 1 :]]

    def edges(self, token: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]] | None:
        """Pieces at the left and at the right edge of a token while it is merged, each with the rank at which it
        is used up; None if the token doesn't encode to itself."""
        if token in self.spines:
            return self.spines[token]
        symbols = self._symbols(token)
        left, right, first, last = [], [], symbols[0], symbols[-1]
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, NEVER), n) for n, pair in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == NEVER:
                self.spines[token] = None
                return None
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
            if symbols[0] != first:
                left.append((first, rank))
                first = symbols[0]
            if symbols[-1] != last:
                right.append((last, rank))
                last = symbols[-1]
        found = self.spines[token] = ([*left, (first, NEVER)], [*right, (last, NEVER)])
        return found

    def stands(self, token: str) -> bool:
        """Whether a token encodes to itself."""
        return self.edges(token) is not None

    def neighbours(self, one: str, two: str) -> bool:
        """Whether two tokens that stand alone also stand side by side: no merge across their boundary comes before
        the merges that use up its two pieces. Merges only join pieces of lower rank, so ranks tell the order."""
        xs, ys, rank = self.edges(one)[1], self.edges(two)[0], self.rank
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            across = rank.get((x, y))
            # of equal ranks the left pair is merged first
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends == NEVER and y_ends == NEVER:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _follows(self, before: int, token: int) -> bool:
        """Whether a token may follow the encoding that ends with ``before`` (-1: at the start of the word)."""
        name = self.names[token]
        return self.stands(name) and (before < 0 or self.neighbours(self.names[before], name))

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words, as pre-tokens are. In sorted order, inserting them walks the trie depth first;
        only nodes that no earlier word has passed get a last token. The trie stays for later batches.

        A node is (children, last token, runs): a run is a start and the place in the vocabulary's own trie that
        the text from there has reached. The longest token that may follow what stands before it is the last one.
        """
        if self.nodes > MEMORY_NODES:
            self.trie, self.nodes = ({}, -1, ()), 0
        if len(self.firm) > 2 * MEMORY_NODES:
            self.firm.clear()
        firm, root, ids, names = self.firm, self.entries, self.ids, self.names
        for word in sorted(words):
            path = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode("utf-8")))
            node, lasts = self.trie, [-1]
            end = len(path) - 1
            for depth in range(end):
                letter = path[depth]
                child = node[0].get(letter)
                if child is None:
                    runs, last = [], -1
                    for start, entry in (*node[2], (depth, root)):
                        if (entry := entry[0].get(letter)) is not None:
                            runs.append((start, entry))
                            if last < 0 and (token := entry[1]) >= 0:
                                pair = lasts[start] << 20 | token
                                if (fits := firm.get(pair)) is None:
                                    fits = firm[pair] = self._follows(lasts[start], token)
                                if fits:
                                    last = token
                    child = node[0][letter] = ({}, last, tuple(runs))
                    self.nodes += 1
                node = child
                lasts.append(node[1])
            letter = path[end]
            for start, entry in (*node[2], (end, root)):
                if (entry := entry[0].get(letter)) is not None and (token := entry[2]) >= 0:
                    pair = lasts[start] << 20 | token
                    if (fits := firm.get(pair)) is None:
                        fits = firm[pair] = self._follows(lasts[start], token)
                    if fits:
                        break
            if not start:
                ids[word] = token.to_bytes(4, "little")
                continue
            tokens = [token]
            while start:
                token = lasts[start]
                tokens.append(token)
                start -= len(names[token])
            tokens.reverse()
            ids[word] = array("I", tokens).tobytes()

    def cut(self, text: str) -> list[str]:
        """Words of a text without added tokens."""
        if text.isascii():
            return self.ascii_words.findall(text.lower())
        if COMMON.search(text) and unassigned().search(text):
            return self._cut_by_library(text)
        # lower case character by character: the final form of sigma does not depend on its place
        return self.words.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _cut_by_library(self, text: str) -> list[str]:
        """The same for texts with characters that Unicode tables of different years class differently."""
        from tokenizers import Tokenizer

        if isinstance(self._library, str):
            self._library = Tokenizer.from_file(self._library)
            self.bytes_of = {c: b for b, c in enumerate(self.letters)}
        words = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes_of.__getitem__, w)).decode("utf-8") for w, _ in words]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of each text."""
        parts = []
        for text in texts:
            if self.added_pattern and "<|" in text:
                pieces = [[p] if p in self.added else self.cut(p) for p in self.added_pattern.split(text) if p]
                parts.append([(w, len(p) == 1 and w in self.added) for p in pieces for w in p])
            else:
                parts.append(self.cut(text))
        plain = [p if not p or isinstance(p[0], str) else [w for w, special in p if not special] for p in parts]
        if len(self.ids) > MEMORY_WORDS:
            self.before, self.ids = self.ids, {}
        unknown = {w for p in plain for w in p}.difference(self.ids)
        for w in unknown.intersection(self.before):
            self.ids[w] = self.before[w]
        self.learn(unknown.difference(self.ids))
        ids = self.ids
        return [b"".join(map(ids.__getitem__, p)) if not p or isinstance(p[0], str) else b"".join(struct.pack("<I", self.added[w]) if special else ids[w] for w, special in p) for p in parts]

    def decode(self, ids: bytes) -> str:
        """Names of the tokens, joined by a space: the file has no decoder of its own."""
        return " ".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, about ``SLICE`` characters at once."""
    lo = held = 0
    for n, text in enumerate(texts):
        held += len(text)
        if held >= SLICE:
            yield texts[lo : n + 1]
            lo, held = n + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def _over(path: str, fill: Callable[[WordBpe, list[bytes]], list[pa.Array]], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("bpe", load.cache_clear):  # millions of small objects, none of them in cycles
            bpe = load(path)
            for batch in batches:
                at = 0
                for texts in _slices([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                    kept = batch.slice(at, len(texts)).columns[:-1]
                    at += len(texts)
                    yield pa.RecordBatch.from_arrays([*kept, *fill(bpe, bpe.encode_batch(texts))], [*batch.schema.names[:-1], *names])

    return run


def _ids_column(rows: list[bytes]) -> pa.ListArray:
    """The ids as a list column over their bytes, without an object for each."""
    ends = np.cumsum([0, *(len(ids) // 4 for ids in rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), "<i4")))


def encode(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: id, token_ids (array of int), n_tokens, decoded (the text that ``decode`` makes of the ids)."""
    prepare(df)

    def fill(bpe: WordBpe, rows: list[bytes]) -> list[pa.Array]:
        return [_ids_column(rows), pa.array([len(ids) // 4 for ids in rows], pa.int64()), pa.array(map(bpe.decode, rows), pa.string())]

    kind = df.schema[doc_id].dataType.simpleString()
    run = _over(vocabulary or default_vocabulary(), fill, ["token_ids", "n_tokens", "decoded"])
    return df.select(named(doc_id), named(text)).mapInArrow(run, f"`{doc_id}` {kind}, token_ids array<int>, n_tokens long, decoded string")


def decode(df: DataFrame, doc_id: str = "doc_id", ids: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """Per row: id, decoded. Null ids decode to the empty text; an id that the vocabulary lacks raises."""
    prepare(df)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with worker_memory("bpe", load.cache_clear):
            bpe = load(path)
            for batch in batches:
                texts = [bpe.decode(np.array(row, "<u4").tobytes()) if row else "" for row in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [batch.schema.names[0], "decoded"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(named(doc_id), named(ids)).mapInArrow(run, f"`{doc_id}` {kind}, decoded string")


def encode_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; the last of the text that ``decode`` makes of the ids."""
    prepare(df)

    def fill(bpe: WordBpe, rows: list[bytes]) -> list[pa.Array]:
        digests = ([hashlib.sha256(ids).hexdigest() for ids in rows], [hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest() for ids in rows])
        return [pa.array([len(ids) // 4 for ids in rows], pa.int64()), *[pa.array(d, pa.string()) for d in digests]]

    kind = df.schema[doc_id].dataType.simpleString()
    run = _over(vocabulary or default_vocabulary(), fill, ["n_tokens", "ids_sha256", "decoded_sha256"])
    return df.select(named(doc_id), named(text)).mapInArrow(run, f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
