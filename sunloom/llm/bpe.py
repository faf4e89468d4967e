"""Encoding of whole texts with a public byte-level BPE vocabulary.

Texts are split into words by the vocabulary's pattern.  Distinct words that a task
has not met yet are encoded together in batched NumPy merge rounds: the symbols of
many words stand in one flat array; in each round the keys of all neighbouring pairs
are found by binary search among the sorted pair keys of the vocabulary, each word's
pairs of lowest rank are merged, and the array is compacted.  A task keeps the ids of
the words that it met, so most words are a lookup; texts become Arrow lists without
passing through rows of Python objects.

Defined results
* null and empty texts: an empty list;
* very long texts are cut only where the pattern can't join (before white space that
  follows something else), so whole texts are encoded and memory stays bounded;
* text that spells a special token is ordinary text; repeated rows are encoded alike;
* an empty table gives an empty table; extra columns are kept out of the workers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.session import ship

#: Folder of the public vocabulary files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Pattern of the words of byte_bpe_50k.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text whose words are in memory at once, and words that a task remembers.
CHUNK_CHARS, REMEMBERED = 1 << 20, 400_000
#: Longest word that is merged with many others; longer ones (a text without spaces) go through the same rounds alone.
NO_PAIR = np.iinfo(np.int32).max


class Vocabulary:
    """Byte symbols, and the sorted keys of all pairs that merge, with the rank of the result (its id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_to_id = np.full(256, -1, np.int32)
        for b in range(256):
            self.bytes_to_id[b] = ranks[bytes([b])]
        keys, ids = [], []
        self.size = max(ranks.values()) + 1
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.ids = np.array(keys, np.int64)[order], np.array(ids, np.int32)[order]

    @classmethod
    def load(cls, name: str = VOCABULARY, folder: str = TOKENIZERS) -> Vocabulary:
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, ``NO_PAIR`` where the vocabulary has none."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], NO_PAIR)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word), by merge rounds over all words at once."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.bytes_to_id[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        counts = sizes.copy()
        done: list[tuple[np.ndarray, np.ndarray]] = []
        # Ranks of the pairs (i, i + 1); a pair across words never merges.
        rank = np.full(len(sym), NO_PAIR, np.int32)
        if len(sym) > 1:
            rank[:-1] = np.where(word[1:] == word[:-1], self.pair_ranks(sym[:-1], sym[1:]), NO_PAIR)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            spread = np.diff(np.r_[starts, len(sym)])
            alive = lowest != NO_PAIR
            if not alive.all():
                # Words without a pair left are done and leave the array.
                keep = np.repeat(alive, spread)
                done.append((word[~keep], sym[~keep]))
                sym, word, rank, lowest, spread = sym[keep], word[keep], rank[keep], lowest[alive], spread[alive]
                if not len(sym):
                    break
            hit = rank == np.repeat(lowest, spread)
            # Of overlapping hits (aaa) the first, third, ... merge: positions in a stretch of neighbouring hits alternate.
            at = np.flatnonzero(hit)
            if len(at) > 1:
                new = np.r_[True, at[1:] != at[:-1] + 1]
                first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
                at = at[(at - first) % 2 == 0]
            sym[at] = rank[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            np.subtract.at(counts, word[at], 1)
            kept = ~gone
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            sym, word, rank, touched = sym[kept], word[kept], rank[kept], touched[kept]
            # Only pairs next to a merged symbol have new ranks.
            redo = np.flatnonzero(touched | np.r_[touched[1:], False])
            inner = redo[redo < len(sym) - 1]
            fresh = np.where(word[inner + 1] == word[inner], self.pair_ranks(sym[inner], sym[inner + 1]), NO_PAIR)
            rank[inner] = fresh
            if len(redo) and redo[-1] == len(sym) - 1:
                rank[-1] = NO_PAIR
        if not done:
            return np.zeros(0, np.int32), counts
        words_of, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return ids[np.argsort(words_of, kind="stable")], counts


class _Words(dict):
    """Numbers of words; asking for an unknown one gives it the next number."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        self.new.append(word)
        return n


class Encoder:
    """Encodes texts and remembers the words that it met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.words = _Words()
        self.flat, self.start, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.used = 0

    def _learn(self) -> None:
        """Encode the stretches met since the last call, all their words together."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        words = [self.find(stretch) for stretch in new]
        ids, counts = self.vocabulary.encode_words([w.encode("utf-8", "surrogatepass") for ws in words for w in ws])
        of_stretch = np.repeat(np.arange(len(new)), [len(ws) for ws in words])
        counts = np.bincount(of_stretch, weights=counts, minlength=len(new)).astype(np.int64)
        n = len(self.words)
        if n > len(self.start):
            self.start, self.count = (np.resize(a, 2 * n) for a in (self.start, self.count))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        first = n - len(new)
        self.count[first:n] = counts
        self.start[first:n] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def word_numbers(self, text: str) -> np.ndarray:
        """Numbers of a text's stretches: words with the spaces before and the marks around them, or the pattern's words where those would be long."""
        spaced = text.count(" ") * 15 > len(text) and not _RARE_SPACE.search(text)
        found = _STRETCH.findall(text) if spaced else self.find(text)
        return np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))

    def encode(self, texts: list[str | None], counts_only: bool = False) -> tuple[np.ndarray | None, np.ndarray]:
        """(ids of all texts in order or None, number of ids of each text)."""
        if len(self.words) > REMEMBERED:
            self._forget()
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for piece in safe_pieces(text or ""):
                pieces.append(self.word_numbers(piece))
                owner.append(i)
        self._learn()
        sizes = np.zeros(len(texts), np.int64)
        if not pieces:
            return np.zeros(0, np.int32), sizes
        numbers = np.concatenate(pieces)
        of_text = np.repeat(np.array(owner), [len(p) for p in pieces])
        counts = self.count[numbers]
        sizes += np.bincount(of_text, weights=counts, minlength=len(texts)).astype(np.int64)
        if counts_only:
            return None, sizes
        # Gather each word's ids: positions count up from its start.
        ends = np.cumsum(counts)
        offset = np.repeat(self.start[numbers] - (ends - counts), counts)
        return self.flat[offset + np.arange(len(offset))], sizes


#: The pattern can't join a white space to what stands before it, so text may be cut there; only the common spaces are looked for.
_STRETCH = re.compile(r"[ \n\r\t]*[^ \n\r\t]+|[ \n\r\t]+")
_RARE_SPACE = re.compile("[\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_BREAK = regex.compile(r"\S(?=\s)")


def safe_pieces(text: str) -> Iterator[str]:
    """The text in pieces of about ``CHUNK_CHARS``, cut where no word can span the cut."""
    at = 0
    while len(text) - at > CHUNK_CHARS:
        cut = _BREAK.search(text, at + CHUNK_CHARS)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    if at < len(text):
        yield text[at:]


@lru_cache(maxsize=4)
def _encoder(name: str, folder: str) -> Encoder:
    """One encoder a worker process, with what it remembers."""
    return Encoder(Vocabulary.load(name, folder))


def _groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS`` characters together."""
    a, chars = 0, 0
    for i, text in enumerate(texts):
        chars += len(text or "")
        if chars >= CHUNK_CHARS:
            yield a, i + 1
            a, chars = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids array<int>) of each row, without special tokens."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, folder)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _groups(texts):
                ids, sizes = encoder.encode(texts[a:b])
                for x, y in _list_ranges(sizes):
                    done = int(sizes[:x].sum())
                    offsets = np.r_[0, np.cumsum(sizes[x:y])]
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[done : done + offsets[-1]], pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(a + x, y - x), lists], [id_col, "ids"])

    ship(documents.sparkSession)
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>")


def _list_ranges(sizes: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about ``most`` ids together."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield a, i
            a, total = i, 0
        total += int(n)
    if a < len(sizes):
        yield a, len(sizes)


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and ``n_tokens long`` of each row."""
    types = {f.name: f.dataType.simpleString() for f in documents.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, folder)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            sizes = [encoder.encode(texts[a:b], counts_only=True)[1] for a, b in _groups(texts)]
            total = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(total, pa.int64())], [*keep, "n_tokens"])

    ship(documents.sparkSession)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_tokens long"
    return documents.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, schema)
