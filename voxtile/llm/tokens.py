"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 6).

Method: speculate and verify. A greedy longest match proposes the tokens of each word.
The sequence is the exact encoding if and only if every token encodes as itself and every
pair of neighbours is compatible, i.e. the merges of the pair's bytes give the pair back;
all pairs of a batch are tested at once against sorted arrays of pairs whose answer is
known, and only pairs never met before are worked out. Only the words that fail undergo
exact merging.

Scale: a narrow map over Arrow batches without any shuffle. Words are encoded once per
worker; its memory of words and pairs is bounded and is emptied when full, which changes
the time but not the result. The vocabulary is a file of fixed size that each worker
reads from a path given as a parameter.

Defined results: null and empty texts give the empty list; every other text, blank ones
included, is encoded whole without special tokens, and the strings of special tokens are
ordinary text; very long texts are encoded word by word; lone surrogates cannot occur in
Arrow strings; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from voxtile.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts texts into words for this vocabulary.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY = 500_000
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    def __init__(self, path: str, pattern: str = WORD_PATTERN, memory: int = MEMORY):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.words = regex.compile(pattern)
        self.memory = memory
        self.ids: dict[str, list[int]] = {}
        # longest token by its first three bytes: the greedy match starts no longer than that
        self.reach: dict[bytes, int] = {}
        for t in self.rank:
            k = t[:3]
            if len(t) > self.reach.get(k, 0):
                self.reach[k] = len(t)
        self.good = np.array([_NONE], dtype=np.int64)
        self.bad = np.array([_NONE], dtype=np.int64)
        self.stats = {"words": 0, "failed": 0, "pairs": 0}

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost of equals, until no pair merges."""
        n = len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        if n < 48:
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = self.rank.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [self.rank[p] for p in parts]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := self.rank.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[k])))
            if (h := before[i]) >= 0 and (r := self.rank.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, len(parts[h]) + len(parts[i])))
        return [self.rank[p] for p in parts if p is not None]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.reach.get(word[at : at + 3], 2))
            while (r := self.rank.get(word[at:end])) is None:
                end -= 1
            out.append(r)
            at = end
        return out

    def _learn(self, codes: np.ndarray) -> None:
        """Work out pairs (or single tokens, coded with -1 as the second) that no batch has met."""
        good, bad = [], []
        for c in codes.tolist():
            a, b = divmod(c, 1 << 20)
            b -= 1
            bytes_ = self.token[a] + (self.token[b] if b >= 0 else b"")
            (good if self.merge(bytes_) == ([a, b] if b >= 0 else [a]) else bad).append(c)
        self.stats["pairs"] += len(good) + len(bad)
        if good:
            self.good = np.union1d(self.good, np.array(good, dtype=np.int64))
        if bad:
            self.bad = np.union1d(self.bad, np.array(bad, dtype=np.int64))

    @staticmethod
    def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes

    def encode_words(self, words: Iterable[str]) -> None:
        """Put the encodings of words not yet known into memory."""
        fresh = [w for w in set(words) if w not in self.ids]
        if not fresh:
            return
        raw = [w.encode("utf-8") for w in fresh]
        guesses = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, guesses), dtype=np.int64, count=len(guesses))
        flat = np.fromiter((t for g in guesses for t in g), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        # the code of a pair; a word's last token is paired with nothing, which tests the token itself
        second = np.zeros_like(flat)
        second[:-1] = flat[1:] + 1
        second[starts + sizes - 1] = 0
        codes = (flat << 20) + second
        unknown = ~(self._among(codes, self.good) | self._among(codes, self.bad))
        if unknown.any():
            self._learn(np.unique(codes[unknown]))
        fails = np.logical_or.reduceat(~self._among(codes, self.good), starts)
        self.stats["words"] += len(fresh)
        self.stats["failed"] += int(fails.sum())
        for w, b, g, failed in zip(fresh, raw, guesses, fails.tolist()):
            self.ids[w] = self.merge(b) if failed else g
        if len(self.good) + len(self.bad) > 4 * self.memory:
            self.good = self.bad = np.array([_NONE], dtype=np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.ids) > self.memory:
            self.ids.clear()
        cut = [self.words.findall(t) if t else [] for t in texts]
        self.encode_words(w for ws in cut for w in ws)
        ids = self.ids
        return [[t for w in ws for t in ids[w]] for ws in cut]

    def count_batch(self, texts: list[str | None]) -> list[int]:
        if len(self.ids) > self.memory:
            self.ids.clear()
        cut = [self.words.findall(t) if t else [] for t in texts]
        self.encode_words(w for ws in cut for w in ws)
        ids = self.ids
        return [sum(len(ids[w]) for w in ws) for ws in cut]


def vocabulary(path: str) -> Vocabulary:
    """The worker's own copy, kept between the tasks of one Python process."""
    kept = sys.modules.setdefault("_voxtile_vocabularies", types.ModuleType("_voxtile_vocabularies"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Vocabulary(path)
    return kept.__dict__[path]


def _slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` characters, so that very long texts don't gather."""
    sizes = [len(t) if t else 0 for t in batch.column(1).to_pylist()]
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    yield batch.slice(begin)


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the token ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for b in _slices(whole):
                ids = v.encode_batch(b.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))]).astype(np.int32)
                flat = np.fromiter((t for x in ids for t in x), dtype=np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "ids"])

    return spread(documents.select(documents["doc_id"].cast("long"), "text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for whole in batches:
            for b in _slices(whole):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v.count_batch(b.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return spread(documents.select(documents["doc_id"].cast("long"), "text")).mapInArrow(run, "doc_id long, n_tokens long")
