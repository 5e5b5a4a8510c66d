"""Token counts of documents under a public vocabulary, and budgets by slice (problem 6).

A trie over the vocabulary with failure links and precomputed emissions (as in the linear maximum-matching tokenizer of
Song et al., 2021) splits each pre-token into longest matches in one pass over its bytes.  For a vocabulary that is
itself a longest-match one, these are the exact tokens.  For a byte-pair vocabulary the longest matches are the exact
tokens whenever every two neighbours are a pair that byte-pair merging would also leave apart, as the encoding with that
property is unique; where a pair fails the test, the pre-token is encoded by the rank queue.  ``exact=False`` keeps the
longest-match estimate.

Defined results: null and empty texts have 0 tokens; null slice fields form slices of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexwarden.llm.bpe import Encoder, load_encoder
from lexwarden.session import spread

#: Pre-token counts kept per worker, and the longest pre-token kept; bounds on memory, not on the result.
CACHE_SIZE, CACHE_CHARS = 1 << 18, 24
ROOT = 0


class MatchTrie:
    """Longest-match trie of a vocabulary in which every single byte is a token."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.goto: dict[int, int] = {}  # node << 8 | byte -> node
        token = [-1]
        parent, edge = [0], [0]
        for text, number in vocabulary.items():
            node = ROOT
            for byte in text:
                key = node << 8 | byte
                nxt = self.goto.get(key)
                if nxt is None:
                    nxt = self.goto[key] = len(token)
                    token.append(-1)
                    parent.append(node)
                    edge.append(byte)
                node = nxt
            token[node] = number
        depth = [0] * len(token)
        for node in range(1, len(token)):
            depth[node] = depth[parent[node]] + 1  # parents are made before their children
        self.fail = [-1] * len(token)
        self.emit: list[tuple[int, ...]] = [()] * len(token)
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            if token[node] >= 0:
                self.fail[node], self.emit[node] = ROOT, (token[node],)
                continue
            up, byte = parent[node], edge[node]
            at, given = self.fail[up], self.emit[up]
            while at >= 0 and (step := self.goto.get(at << 8 | byte)) is None:
                given, at = given + self.emit[at], self.fail[at]
            if at >= 0:
                self.fail[node], self.emit[node] = step, given

    def tokens(self, word: bytes) -> list[int]:
        """Longest-match tokens of the bytes, left to right."""
        goto, fail, emit, node, out = self.goto.get, self.fail, self.emit, ROOT, []
        for byte in word:
            while (step := goto(node << 8 | byte)) is None:
                out += emit[node]
                node = fail[node]
            node = step
        while node > ROOT:
            out += emit[node]
            node = fail[node]
        return out


class TokenCounter:
    """Counts of tokens per text under one vocabulary."""

    def __init__(self, encoder: Encoder, exact: bool = True) -> None:
        self.encoder, self.exact = encoder, exact
        self.trie = MatchTrie(encoder.ranks)
        self.halves = {rank: (key >> 20, key & 0xFFFFF) for key, rank in encoder.pair.items()}
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, int] = {}

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether byte-pair merging leaves the two tokens as they are side by side.

        Undoes the merges of both from the latest to the earliest; the border falls if, at some time, the two parts that
        touch it had a merge that came before the one that used up either.
        """
        key = left << 20 | right
        known = self.apart.get(key)
        if known is None:
            pair, halves, limit = self.encoder.pair, self.halves, 1 << 40
            while True:
                made = pair.get(left << 20 | right)
                if made is not None and made < limit:
                    known = False
                    break
                if left > right:
                    if left not in halves:
                        if right not in halves:
                            known = True
                            break
                        limit, right = right + 1, halves[right][0]
                    else:
                        limit, left = left, halves[left][1]
                elif right not in halves:
                    if left not in halves:
                        known = True
                        break
                    limit, left = left, halves[left][1]
                else:
                    limit, right = right + 1, halves[right][0]
            self.apart[key] = known
        return known

    def count_words(self, words: Sequence[str]) -> list[int]:
        """Tokens of each pre-token."""
        out, hard = [], []
        match, apart = self.trie.tokens, self.apart
        for i, word in enumerate(words):
            ids = match(word.encode())
            out.append(len(ids))
            if self.exact:
                for a, b in zip(ids, ids[1:]):
                    ok = apart.get(a << 20 | b)
                    if not (self.stays_apart(a, b) if ok is None else ok):
                        hard.append(i)
                        break
        if hard:
            for i, ids in zip(hard, self.encoder.encode_words([words[i].encode() for i in hard]), strict=True):
                out[i] = len(ids)
        return out

    def count_batch(self, texts: Sequence[str | None]) -> list[int]:
        """Tokens of each text."""
        split, cache = self.encoder.split, self.cache
        cut = [split(t) if t else [] for t in texts]
        fresh = list({w for words in cut for w in words if w not in cache})
        if len(cache) + len(fresh) > CACHE_SIZE:
            cache.clear()
            fresh = list({w for words in cut for w in words})
        cache.update(zip(fresh, self.count_words(fresh), strict=True))
        get = cache.__getitem__
        out = [sum(map(get, words)) for words in cut]
        for word in fresh:
            if len(word) > CACHE_CHARS:
                del cache[word]
        return out


@lru_cache(maxsize=4)
def load_counter(path: str, exact: bool) -> TokenCounter:
    """The counter of a ``.tiktoken`` file, once per worker."""
    return TokenCounter(load_encoder(path), exact)


def token_counts(df: DataFrame, text: str | Column, vocabulary: str, keep: Sequence[Column | str], exact: bool = True) -> DataFrame:
    """The columns ``keep`` of ``df`` and ``n_tokens`` of each row; narrow, whole texts."""
    text = F.col(text) if isinstance(text, str) else text
    source = df.select(*keep, text.cast("string").alias("__text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(vocabulary, exact)
        for batch in batches:
            numbers: list[int] = []
            texts = batch.column(batch.num_columns - 1)
            for low in range(0, batch.num_rows, 512):
                numbers += counter.count_batch(texts.slice(low, 512).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(numbers, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    out = source.drop("__text").schema.add("n_tokens", "long")
    return spread(source).mapInArrow(count, out)


def token_budget(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """Totals by slice; partial sums are made before the shuffle, so a hot slice is one row per task."""
    return counted.groupBy(*by).agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest"))
