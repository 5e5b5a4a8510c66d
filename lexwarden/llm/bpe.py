"""Byte-level BPE of a corpus by a rank queue (problem 7).

All pre-tokens of a batch lie in one linked list of byte positions.  One bucket per merge rank holds the positions at
which the pair of that rank starts; a hierarchical bitmap over the ranks finds the next bucket that is not empty by
find-first-set.  A position is merged unless it is stale, i.e. its pair has changed since it was queued.  As a merge
only makes pairs that were learned later, ranks are taken in rising order and each bucket once; the cost per pre-token is
linear in its merges, however long it is.

The vocabulary file is read where it lies, once per Python worker; its path is a parameter.  Ids are ranks, as in the
public ``.tiktoken`` files.  Special tokens are not known here, so their strings are ordinary text.

Defined results: null and empty texts give an empty list; lone surrogates cannot occur in Arrow strings.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwarden.session import spread

#: Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-token ids kept per worker; a bound on memory, not on the result.
CACHE_SIZE = 1 << 17
_WORD = 6  # bits per bitmap level


class RankQueue:
    """Buckets of positions by rank, with a three-level bitmap over the ranks that hold any."""

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.levels = [[0] * ((ranks >> (_WORD * (k + 1))) + 1) for k in range(3)]

    def add(self, rank: int, position: int) -> None:
        """Queues a position."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            for level in self.levels:
                word, bit = rank >> _WORD, 1 << (rank & 63)
                if level[word] & bit:
                    break
                level[word] |= bit
                rank = word
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank that holds positions, and these; None when the queue is empty."""
        low, mid, top = self.levels
        for word, bits in enumerate(top):
            if bits:
                break
        else:
            return None
        word = (word << _WORD) | ((bits & -bits).bit_length() - 1)
        bits = mid[word]
        word = (word << _WORD) | ((bits & -bits).bit_length() - 1)
        bits = low[word]
        rank = (word << _WORD) | ((bits & -bits).bit_length() - 1)
        at = rank
        for level in self.levels:
            level[at >> _WORD] &= ~(1 << (at & 63))
            if level[at >> _WORD]:
                break
            at >>= _WORD
        return rank, self.buckets.pop(rank)


class Encoder:
    """A byte-level BPE vocabulary given as token bytes by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pair: dict[int, int] = {}  # left << 20 | right -> rank of the merged token
        self._learn_pairs()
        self.start = np.full((256, 256), -1, np.int64)  # ranks of byte pairs
        for a in range(256):
            for b in range(256):
                self.start[a, b] = self.pair.get(int(self.byte_id[a]) << 20 | int(self.byte_id[b]), -1)
        self.cache: dict[str, list[int]] = {}

    def _learn_pairs(self) -> None:
        """The merge that makes each token: its bytes are encoded with the tokens of lower rank, which leaves two parts."""
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) < 2:
                continue
            parts = [self.ranks[bytes([b])] for b in token]
            while len(parts) > 2:
                found = [(self.pair.get(a << 20 | b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
                best, i = min(found)
                if best >= rank:
                    break
                parts[i : i + 2] = [best]
            if len(parts) == 2:
                self.pair[parts[0] << 20 | parts[1]] = rank

    def encode_words(self, words: Sequence[bytes]) -> list[list[int]]:
        """Ids of each non-empty pre-token."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        if n == 0:
            return [[] for _ in words]
        ends = np.cumsum([len(w) for w in words])
        first = np.zeros(n + 1, bool)
        first[ends] = True  # a pre-token starts here
        ids = self.byte_id[data].tolist()
        follow = np.arange(1, n + 1)
        follow[first[1:]] = -1
        before = np.arange(-1, n - 1)
        before[0] = -1
        before[first[:-1]] = -1
        nxt, prv = follow.tolist(), before.tolist()
        queue = RankQueue(len(self.ranks) + 1)
        start = self.start[data[:-1], data[1:]]
        start[first[1:-1]] = -1
        where = np.flatnonzero(start >= 0)
        where = where[np.argsort(start[where], kind="stable")]
        ranks = start[where]
        edges = np.flatnonzero(np.diff(ranks)) + 1
        for positions in np.split(where, edges) if len(where) else ():
            positions = positions.tolist()
            queue.add(int(start[positions[0]]), positions[0])
            queue.buckets[int(start[positions[0]])] = positions
        pair, add = self.pair.get, queue.add
        buckets = queue.buckets
        while (popped := queue.pop()) is not None:
            rank, positions = popped
            positions.sort()
            for i in positions:
                left = ids[i]
                if left < 0:
                    continue
                j = nxt[i]
                if j < 0 or pair(left << 20 | ids[j]) != rank:
                    continue  # stale
                ids[i], ids[j] = rank, -1
                k = nxt[i] = nxt[j]
                if k >= 0:
                    prv[k] = i
                    new = pair(rank << 20 | ids[k])
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            add(new, i)
                h = prv[i]
                if h >= 0:
                    new = pair(ids[h] << 20 | rank)
                    if new is not None:
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            add(new, h)
        left_over = np.array(ids, np.int64)
        alive = left_over >= 0
        flat = left_over[alive].tolist()
        stops = np.cumsum(alive)[ends - 1].tolist()
        out, low = [], 0
        for stop in stops:
            out.append(flat[low:stop])
            low = stop
        return out

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[list[int], list[int]]:
        """Flat ids of the texts and the offsets of each text in them."""
        cut = [self.split(t) if t else [] for t in texts]
        cache = self.cache
        fresh = list({w for words in cut for w in words if w not in cache})
        if len(cache) + len(fresh) > CACHE_SIZE:
            cache.clear()
            fresh = list({w for words in cut for w in words})
        cache.update(zip(fresh, self.encode_words([w.encode() for w in fresh]), strict=True))
        flat: list[int] = []
        offsets = [0]
        for words in cut:
            for w in words:
                flat += cache[w]
            offsets.append(len(flat))
        return flat, offsets


@lru_cache(maxsize=4)
def load_encoder(path: str) -> Encoder:
    """The encoder of a ``.tiktoken`` file, once per worker."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return Encoder(ranks)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str, rows_per_batch: int = 256) -> DataFrame:
    """(``key``, ``ids`` array<int>) of every row of ``df``; narrow, whole texts.

    ``vocabulary``: path of a ``.tiktoken`` file that every worker can read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(vocabulary)
        for whole in batches:
            for low in range(0, whole.num_rows, rows_per_batch):  # bounds the memory of one linked list
                batch = whole.slice(low, rows_per_batch)
                flat, offsets = encoder.encode_batch(batch.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = df.select(key).schema[0].dataType.simpleString()
    return spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
