"""Byte-level BPE by speculation: propose greedily, verify in bulk, merge only failures.

A sequence of tokens is the BPE encoding of its bytes exactly when every token
alone, and every adjacent pair, is left unmerged by the merges. So greedy longest
match proposes the tokens of a word, all adjacent pairs of a batch's new words
are looked up at once among the pairs known to be compatible, and only words
with an incompatible pair are merged exactly.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

#: Where the public vocabularies lie; a parameter of every operator.
VOCABULARIES = os.environ.get("LATHE_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct words whose ids a worker keeps; beyond it the store starts anew.
KEPT_WORDS = 200_000
#: Pairs of tokens that a task remembers as checked.
PAIRS = 500_000


class SpeculativeBpe:
    """Encoder of one rank file (token in base64, rank) whose ranks are the ids."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.token = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.good = np.empty(0, np.int64)  # sorted codes of compatible pairs
        self.bad = np.empty(0, np.int64)
        self.alone: dict[int, bool] = {}  # whether a token is its own encoding

    def merge(self, word: bytes) -> list[int]:
        """Exact merging, lowest rank first, leftmost on ties; n log n in the word's length."""
        n = len(word)
        if n < 2:
            return [self.ranks[word]] if n else []
        end = list(range(1, n + 1))  # part starting at i is word[i:end[i]]; end[i] == 0: swallowed
        before = list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            r = ranks.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(word[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            h = before[i]
            if h >= 0:
                r = ranks.get(word[h:stop])
                if r is not None:
                    heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, ranks, longest = [], 0, len(word), self.ranks, self.longest
        while i < n:
            for j in range(min(n, i + longest), i, -1):
                r = ranks.get(word[i:j])
                if r is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """Which pair codes (left << 20 | right) stay apart under the merges."""
        if len(self.good) + len(self.bad) > PAIRS:
            self.good = self.bad = np.empty(0, np.int64)
        new = np.setdiff1d(codes, np.concatenate([self.good, self.bad]))
        if len(new):
            token = self.token
            fine = np.fromiter((self.merge(token[c >> 20] + token[c & 0xFFFFF]) == [c >> 20, c & 0xFFFFF] for c in new.tolist()), bool, len(new))
            self.good, self.bad = np.union1d(self.good, new[fine]), np.union1d(self.bad, new[~fine])
        return np.isin(codes, self.good)

    def _canonical(self, i: int) -> bool:
        if i not in self.alone:
            self.alone[i] = self.merge(self.token[i]) == [i]
        return self.alone[i]

    def learn(self, words: list[str]) -> None:
        """Encode words not met before: propose all, verify all pairs, merge the failures."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        inside = np.ones(max(len(flat) - 1, 0), bool)
        inside[ends[:-1] - 1] = False  # pairs across words
        failed = np.zeros(len(words), bool)
        if inside.any():
            at = np.flatnonzero(inside)
            wrong = at[~self._compatible(flat[at] << 20 | flat[at + 1])]
            failed[np.searchsorted(ends, wrong, side="right")] = True
        lone = np.fromiter((self._canonical(t) for t in np.unique(flat).tolist()), bool)
        if not lone.all():
            odd = np.unique(flat)[~lone]
            failed[np.searchsorted(ends, np.flatnonzero(np.isin(flat, odd)), side="right")] = True
        for k in np.flatnonzero(failed).tolist():
            proposed[k] = self.merge(raw[k])
        self.words.update(zip(words, proposed, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty give the empty list."""
        if len(self.words) > KEPT_WORDS:
            self.words.clear()
        parts = [self.split(t) if t else [] for t in texts]
        new = {w for p in parts for w in p if w not in self.words}
        if new:
            self.learn(sorted(new))
        words = self.words
        return [[i for w in p for i in words[w]] for p in parts]


@lru_cache(maxsize=4)
def encoder(path: str) -> SpeculativeBpe:
    """One encoder per worker and file."""
    return SpeculativeBpe(path)


def rank_file(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    """Path of a public rank file, the same on every executor."""
    return os.path.join(folder or VOCABULARIES, f"{name}.tiktoken")


def _udf(kind, each, path: str):
    @pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for texts in batches:
            values, out, size, at = texts.tolist(), [], 0, 0
            for k, t in enumerate(values):  # long texts in groups of bounded size
                size += len(t or "")
                if size > 2_000_000 or k + 1 == len(values):
                    out += [each(x) for x in enc.encode_batch(values[at : k + 1])]
                    at, size = k + 1, 0
            yield pd.Series(out, dtype=object if kind != IntegerType() else "int32")

    return run


def token_ids(text: Column | str, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Ids (array<int>) of a text without special tokens; null and empty texts give []."""
    return _udf(ArrayType(IntegerType()), list, rank_file(name, folder))(text)


def token_count(text: Column | str, name: str = "byte_bpe_50k", folder: str | None = None) -> Column:
    """Number of ids of a text; null and empty texts have 0."""
    return _udf(IntegerType(), len, rank_file(name, folder))(text)


def encode_documents(documents: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row of ``documents``; a map-only pass without a shuffle.

    Repeated doc_ids keep their rows; strings of special tokens are ordinary text.
    """
    return documents.select("doc_id", token_ids(F.col("text"), name, folder).alias("ids"))
