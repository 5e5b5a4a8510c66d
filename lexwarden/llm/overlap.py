"""Same and near-same records across splits (problem 4).

Prompts are reduced to normal forms; equal forms are one text, so that copies cost nothing more.  The evaluation forms are
put into shards by script and length, and each shard gets a full-text index once: a compressed suffix array, searched
backwards.  Training forms are streamed through the shards whose texts can be near-same by length and script.

A training text is cut into ``m`` short pieces.  ``k`` edits spoil at most ``k`` of them, so that ``m - k`` stand unchanged in any
near-same text, and at a like place: whoever moves a piece by ``s`` puts in or leaves out ``|s|`` characters before it and
``|d - s|`` behind it, if the lengths differ by ``d``, so that ``|2 s - d| <= k``.  Each shard lists where every short gram stands,
by the place from the middle of its text; a piece takes one stretch of a list, and texts that stand in enough of the stretches
are candidates.  Where the stretches of a text hold more than comparing it with each text of fit length costs, as in texts
of one character repeated, that is done by bit sets of 3-character grams: ``k`` edits spoil at most ``3 k`` grams.  Neither way
loses a pair.  Candidates of both pass through the gram count and an exact edit distance.  Backward search of the whole text
then gives the maximal matches with each partner, merged into spans.

Defined results: null prompts and prompts without letters or digits match nothing; repeated rows give one pair each;
an empty side gives no pairs.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexwarden.llm.wording import marked
from lexwarden.session import spread, stored

#: A pair is near-same if at most one of so many characters of the longer text differs.
ONE_OF = 8
#: Shorter matches are not reported as spans.
LEAST_MATCH = 10
#: Grams of the exact filter: length in characters, and bits of the second look; the first has four a character.
GRAM, LEAST_BITS, MORE_BITS = 3, 1024, 8192
#: Characters of evaluation texts in a shard, of training texts in a task and in a search, about.
SHARD_CHARS, TASK_CHARS, BUFFER_CHARS = 1 << 22, 1 << 23, 1 << 24
#: Tasks a core, at least, where there are texts enough; more only as they would exceed ``TASK_CHARS``.
TASKS_PER_CORE = 4
#: Length bands: so many to a factor of e.  A shard spans at most ``SHARD_BANDS``, unless it is one band.
BANDS, SHARD_BANDS = 32, 24
#: Counting a place of a list costs about as much as comparing this many words of gram sets.
PLACE_COST = 1
#: Characters of a piece, at most: shorter ones stand in more texts, but more of them must.
PIECE = 5
#: One of so many suffixes has its place kept.
SAMPLE = 4
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _points(texts: Sequence[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


class TextIndex:
    """Compressed suffix array of a set of texts.

    Of the suffix array only ``psi`` is kept, the row of the next suffix: it rises within the rows of one symbol, so that
    its differences are small numbers, and a step of backward search is a binary search among them.  Every ``SAMPLE``-th
    suffix keeps its place; the place of another is found by following ``psi`` to such a one.
    """

    def __init__(self, texts: Sequence[str]) -> None:
        points = _points(["\x00".join([*texts, ""])])
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        n = self.size = len(symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet)))))
        rank = self._ranks(symbols.astype(np.int64))
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self._keep(rank[(order + 1) % n], order % SAMPLE == 0, order[order % SAMPLE == 0].astype(np.int32), np.flatnonzero(points == 0))

    def _ranks(self, symbols: np.ndarray) -> np.ndarray:
        """The row of each suffix, by prefix doubling; only suffixes that still share a row are sorted again.

        Suffixes that are alike so far share the row at which their group begins.
        """
        n, base, width = self.size, len(self.alphabet) + 1, 1
        padded, key = np.concatenate((symbols + 1, np.zeros(4, np.int64))), symbols + 1
        while width < 4 and base ** (width + 1) < 1 << 62:
            key, width = key * base + padded[width : width + n], width + 1
        rank, open_ones = np.zeros(n, np.int64), np.arange(n)
        while len(open_ones):
            order = np.argsort(key)
            at, key, index = open_ones[order], key[order], np.arange(len(order))
            group = rank[at]
            first = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, index, 0))
            fresh = np.diff(key, prepend=-1) != 0
            rank[at] = group + np.maximum.accumulate(np.where(fresh, index, 0)) - first
            open_ones = at[~(fresh & np.append(fresh[1:], True))]
            ahead = open_ones + width
            key = rank[open_ones] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
            width *= 2
        return rank

    def _keep(self, psi: np.ndarray, kept: np.ndarray, places: np.ndarray, ends: np.ndarray) -> None:
        symbol = np.repeat(np.arange(len(self.alphabet), dtype=np.int64), np.diff(self.first))
        self.psi = psi + symbol * self.size  # one rising sequence over all symbols
        self.kept, self.places = np.packbits(np.concatenate((kept, np.zeros(-len(kept) % 64, bool))), bitorder="little").view(np.uint64), places
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.kept), dtype=np.int64)))
        self.starts = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)

    def parts(self) -> dict[str, bytes]:
        """What :meth:`from_parts` needs; the differences of ``psi`` and of the text starts, as they compress well."""
        psi = self.psi % self.size
        return {
            "alphabet": self.alphabet.tobytes(), "first": self.first.tobytes(), "psi": np.diff(psi, prepend=0).astype(np.int32).tobytes(),
            "kept": self.kept.tobytes(), "places": self.places.tobytes(), "lengths": np.diff(self.starts, append=self.size).astype(np.int32).tobytes(),
        }

    @classmethod
    def from_parts(cls, parts: dict[str, bytes]) -> TextIndex:
        """The index of :meth:`parts`."""
        out = cls.__new__(cls)
        out.alphabet, out.first = np.frombuffer(parts["alphabet"], np.uint32), np.frombuffer(parts["first"], np.int64)
        psi = np.cumsum(np.frombuffer(parts["psi"], np.int32), dtype=np.int64)
        out.size = len(psi)
        kept = np.unpackbits(np.frombuffer(parts["kept"], np.uint8), bitorder="little")[: out.size].astype(bool)
        ends = np.cumsum(np.frombuffer(parts["lengths"], np.int32), dtype=np.int64) - 1
        out._keep(psi, kept, np.frombuffer(parts["places"], np.int32), ends)
        return out

    def codes(self, points: np.ndarray) -> np.ndarray:
        """The symbol number of each character, -1 for one the texts do not have."""
        found = np.searchsorted(self.alphabet, points)
        found[found == len(self.alphabet)] = 0
        return np.where((self.alphabet[found] == points) & (points > 0), found, -1)

    def _step(self, symbol: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first row of those that start with ``symbol`` and go on from row ``bound`` or later."""
        key = symbol * self.size + bound
        order = np.argsort(key)  # neighbouring searches read the same memory
        out = np.empty(len(key), np.int64)
        out[order] = np.searchsorted(self.psi, key[order])
        return out

    def intervals(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``low:high`` that start with each piece ``codes[start:end]``, by backward search of all in step."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), self.size, np.int64)
        live, at = np.flatnonzero(end > start), end - 1
        while len(live):
            symbol = codes[at[live]]
            a, b = self._step(symbol, low[live]), self._step(symbol, high[live])
            b = np.where(symbol < 0, a, b)
            low[live], high[live] = a, b
            at[live] -= 1
            live = live[(a < b) & (at[live] >= start[live])]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place of each row's suffix in the joined texts."""
        row, out, live, step = rows.copy(), np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            at = row[live]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (self.kept[word] >> bit & _ONE).astype(bool)
            done = live[here]
            nth = self.before[word[here]] + np.bitwise_count(self.kept[word[here]] & ((_ONE << bit[here]) - _ONE))
            out[done] = self.places[nth] - step
            live = live[~here]
            row[live] = self.psi[row[live]] % self.size
            step += 1
        return out % self.size

    def text_of(self, rows: np.ndarray) -> np.ndarray:
        """The text in which each row's suffix starts."""
        return np.searchsorted(self.starts, self.locate(rows), side="right") - 1

    def matches(self, queries: Sequence[str], least: int) -> list[list[tuple[int, int, int, int]]]:
        """Maximal matches of each query, found by backward search of all queries in step.

        Each is (query from, query to, low, high): the rows ``low:high`` start with the match.  A query's matches are the
        greedy factors from its end.
        """
        m = len(queries)
        size = np.array([len(q) for q in queries], np.int64)
        codes = self.codes(_points(queries))
        base = np.concatenate(([0], np.cumsum(size)))[:-1]
        at, end = size - 1, size.copy()  # the character to take next, and where the match ends
        low, high = np.zeros(m, np.int64), np.full(m, self.size, np.int64)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(m)]
        live = np.flatnonzero(at >= 0)
        while len(live):
            symbol = codes[base[live] + at[live]]
            a, b = self._step(symbol, low[live]), self._step(symbol, high[live])
            grows = (symbol >= 0) & (a < b)
            go = live[grows]
            low[go], high[go] = a[grows], b[grows]
            at[go] -= 1
            stop = live[~grows]
            for q in stop[end[stop] - at[stop] - 1 >= least].tolist():
                out[q].append((int(at[q]) + 1, int(end[q]), int(low[q]), int(high[q])))
            alone = at[stop] == end[stop] - 1  # a character that the shard does not have
            at[stop[alone]] -= 1
            end[stop] = at[stop] + 1
            low[stop], high[stop] = 0, self.size
            done = live[at[live] < 0]
            for q in done[end[done] - at[done] - 1 >= least].tolist():
                out[q].append((0, int(end[q]), int(low[q]), int(high[q])))
            live = live[at[live] >= 0]
        return out


def edit_distance_within(a: str, b: str, limit: int) -> bool:
    """Whether at most ``limit`` characters are put in, left out or changed; a column of the table is two bit vectors."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b or not a or not b:
        return True
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    score, left = len(a), len(b)
    full, top = (1 << score) - 1, 1 << score - 1
    up, down = full, 0  # where the table rises and falls from row to row
    for c in b:
        equal = at.get(c, 0)
        level = equal | down
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(across | up)), up & across
        score += bool(rise & top) - bool(fall & top)
        left -= 1
        if score - left > limit:
            return False
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(level | rise)) & full, rise & level & full
    return score <= limit


def near_same(train: str, held: str) -> bool:
    """Whether at most one of eight characters of the longer text differs."""
    return edit_distance_within(train, held, max(len(train), len(held)) // ONE_OF)


#: Longer texts are compared one by one, as their tables are wide.
_TABLE_LENGTH = 2000


def near_same_many(train: Sequence[str], held: Sequence[str]) -> np.ndarray:
    """:func:`near_same` of each pair; the bands of many tables are filled row by row together."""
    size = np.array([max(len(a), len(b)) for a, b in zip(train, held, strict=True)], np.int64)
    out, order, at = np.zeros(len(size), bool), np.argsort(size, kind="stable"), 0
    while at < len(order):
        if size[order[at]] > _TABLE_LENGTH:
            for i in order[at:].tolist():
                out[i] = near_same(train[i], held[i])
            break
        fits = order[at : at + max(1, (1 << 18) // (2 * int(size[order[at]]) // ONE_OF + 3))]
        fits = fits[size[fits] <= min(_TABLE_LENGTH, 1.3 * size[fits[0]] + 8)]
        out[fits] = _banded([train[i] for i in fits], [held[i] for i in fits], size[fits] // ONE_OF)
        at += len(fits)
    return out


def _banded(a: Sequence[str], b: Sequence[str], limit: np.ndarray) -> np.ndarray:
    """Whether the edit distance of each pair is within its limit; a row holds the diagonals up to the largest limit."""
    wide, rows = int(limit.max()), np.arange(len(a))
    long_a, long_b = (np.array([len(t) for t in texts], np.int64) for texts in (a, b))

    def padded(texts: Sequence[str], lengths: np.ndarray, before: int, after: int, fill: int) -> np.ndarray:
        out = np.full((len(texts), before + int(lengths.max()) + after), fill, np.int32)
        out[np.repeat(rows, lengths), before + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = _points(texts)
        return out

    left, right = padded(a, long_a, 0, 0, -1), padded(b, long_b, wide, wide + max(0, int(long_a.max() - long_b.max())) + 1, -2)
    shift = np.arange(-wide, wide + 1, dtype=np.int16)
    far = np.int16(10_000)
    row = np.tile(np.where(shift >= 0, shift, far).astype(np.int16), (len(a), 1))
    found = np.where(long_a == 0, long_b, far).astype(np.int64)
    for i in range(int(long_a.max())):
        best = row + (right[:, i : i + 2 * wide + 1] != left[:, i : i + 1])
        np.minimum(best[:, :-1], row[:, 1:] + 1, out=best[:, :-1])
        row = np.minimum.accumulate(best - shift, axis=1) + shift  # from the left at one a step
        done = np.flatnonzero(long_a == i + 1)
        if len(done):
            across = long_b[done] - long_a[done]
            inside = np.abs(across) <= wide
            found[done[inside]] = row[done[inside], wide + across[inside]]
    return found <= limit


def gram_sets(texts: Sequence[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of the bit sets of each text's grams, how many bits are set)."""
    m = len(texts)
    length = np.array([len(t) for t in texts], np.int64)
    points = _points(texts).astype(np.uint64)
    owner = np.repeat(np.arange(m), length)
    left = np.cumsum(length)[owner] - np.arange(len(owner))
    padded = np.concatenate((points, np.zeros(GRAM, np.uint64)))
    code = np.zeros(len(owner), np.uint64)
    for i in range(GRAM):
        code = code * _MULTIPLIER + padded[i : i + len(owner)]
    whole = left >= GRAM
    cell = (_mixed(code[whole]) % np.uint64(bits)).astype(np.int64)
    words = np.zeros((m, bits // 64), np.uint64)
    np.bitwise_or.at(words, (owner[whole], cell >> 6), _ONE << (cell & 63).astype(np.uint64))
    return words, np.bitwise_count(words).sum(axis=1, dtype=np.int64)


def gram_bits(longest: int) -> int:
    """Bits of the gram sets of texts of up to that length."""
    return max(LEAST_BITS, 1 << (4 * longest - 1).bit_length())


class PlaceLists:
    """Where each gram of ``width`` characters stands in a set of texts, sorted by gram and place.

    A place is twice its distance from the middle of the text, so that texts of different length are laid middle on middle.
    """

    def __init__(self, texts: Sequence[str], length: np.ndarray, width: int) -> None:
        self.width, self.longest = width, int(length.max())
        for_text, self.for_place = (len(texts) - 1).bit_length(), (2 * self.longest).bit_length()
        self.shift = np.uint64(for_text + self.for_place)
        owner = np.repeat(np.arange(len(texts)), length)
        at = np.arange(len(owner)) - (np.cumsum(length) - length)[owner]
        whole = at + width <= length[owner]
        place = (2 * at - length[owner] + self.longest)[whole].astype(np.uint64)
        keys = self._grams(texts)[whole] << self.shift | place << np.uint64(for_text) | owner[whole].astype(np.uint64)
        keys.sort()
        self.owners = (keys & np.uint64((1 << for_text) - 1)).astype(np.uint16 if for_text <= 16 else np.int32)
        self.keys = keys >> np.uint64(for_text)

    def _grams(self, texts: Sequence[str]) -> np.ndarray:
        """The hash of the gram at each place, with as many bits as the keys have left; grams that meet only add candidates."""
        points = _points(texts).astype(np.uint64)
        padded, code = np.concatenate((points, np.zeros(self.width, np.uint64))), np.zeros(len(points), np.uint64)
        for i in range(self.width):
            code = code * _MULTIPLIER + padded[i : i + len(points)]
        return _mixed(code) >> self.shift

    def stretches(self, texts: Sequence[str], length: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """How many pieces each text has, and for each piece the stretch of its gram's list in reach of ``most`` edits."""
        pieces = length // self.width
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = length[owner] * nth // pieces[owner]
        gram = self._grams(texts)[(np.cumsum(length) - length)[owner] + start] << np.uint64(self.for_place)
        place = 2 * start - length[owner] + self.longest
        order = np.argsort(gram)  # neighbouring searches read the same memory
        out = []
        for side, bound in (("left", np.maximum(place - most[owner], 0)), ("right", np.minimum(place + most[owner], 2 * self.longest))):
            found = np.empty(len(owner), np.int64)
            # A text longer than all of these may have pieces beyond their ends.
            key = gram | np.clip(bound, 0, 2 * self.longest).astype(np.uint64)
            found[order] = np.searchsorted(self.keys, key[order], side)
            out.append(found)
        return pieces, (out[0], np.maximum(out[0], out[1]))


class Shard:
    """Evaluation texts in order of length, their index, gram sets and lists of places."""

    def __init__(self, ids: Sequence[bytes], texts: Sequence[str], parts: dict[str, bytes] | None = None, words: bytes | None = None) -> None:
        self.ids, self.texts, self._parts = list(ids), list(texts), parts
        self.length = np.array([len(t) for t in self.texts], np.int64)
        self.longest = int(self.length[-1])
        self.bits = gram_bits(self.longest)
        self.words = gram_sets(self.texts, self.bits)[0] if words is None else np.frombuffer(words, np.uint64).reshape(len(self.texts), -1)
        self.set_bits = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self._lists: dict[int, PlaceLists] = {}

    @cached_property
    def index(self) -> TextIndex:
        """The full-text index, which only texts with a partner need."""
        return TextIndex(self.texts) if self._parts is None else TextIndex.from_parts(self._parts)

    @cached_property
    def columns(self) -> np.ndarray:
        """The gram sets word by word."""
        return np.ascontiguousarray(self.words.T)

    def lists(self, width: int) -> PlaceLists:
        """The places of all grams of ``width`` characters."""
        if width not in self._lists:
            self._lists[width] = PlaceLists(self.texts, self.length, width)
        return self._lists[width]

    def near(self, texts: Sequence[str]) -> list[tuple[int, int]]:
        """(number of the training text, number of the shard's text) of all near-same pairs."""
        length = np.array([len(t) for t in texts], np.int64)
        low = np.searchsorted(self.length, length - length // ONE_OF)
        high = np.searchsorted(self.length, length * ONE_OF // (ONE_OF - 1), "right")
        fit = np.flatnonzero(low < high)
        if not len(fit):
            return []
        texts, length, low, high = [texts[i] for i in fit], length[fit], low[fit], high[fit]
        most = np.maximum(length, self.length[high - 1]) // ONE_OF  # edits of any near-same text
        width = np.minimum(length // (most + 1), PIECE)
        found = []
        for w in np.unique(width).tolist():
            of_width = np.flatnonzero(width == w)
            for at in range(0, len(of_width), 1 << 12):
                found += self._candidates(of_width[at : at + (1 << 12)], w, texts, length, low, high, most)
        if not found:
            return []
        x, y = (np.concatenate(side) for side in zip(*found))
        for bits in dict.fromkeys((self.bits, max(self.bits, MORE_BITS))):
            x, y = self._alike(x, y, texts, length, bits)
        near = near_same_many([texts[i] for i in x.tolist()], [self.texts[j] for j in y.tolist()])
        return list(zip(fit[x[near]].tolist(), y[near].tolist()))

    def _candidates(self, which: np.ndarray, width: int, texts: Sequence[str], length, low, high, most) -> list[tuple[np.ndarray, np.ndarray]]:
        """The pairs of the texts ``which`` that agree in enough pieces, or in enough grams."""
        lists = self.lists(width)
        pieces, (first, last) = lists.stretches([texts[i] for i in which], length[which], most[which])
        owner, some = np.repeat(np.arange(len(which)), pieces), last > first
        places, filled = np.bincount(owner, last - first, len(which)), np.bincount(owner, some, len(which))
        counted = places * PLACE_COST <= (high - low)[which] * self.words.shape[1]
        eighth, found = self.length // ONE_OF, []
        # ``pieces - most`` must stand in any near-same text, more in one that is not the longest.
        counted_ones = np.flatnonzero(counted & (filled >= pieces - most[which]))
        use = some & np.isin(owner, counted_ones)
        owner, first, size = owner[use], first[use], (last - first)[use]
        upto, at = np.cumsum(places[counted_ones]).astype(np.int64), 0
        while at < len(counted_ones):  # a few hundred thousand places at once
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + (1 << 18), "right")))
            p, q = np.searchsorted(owner, (counted_ones[at], counted_ones[stop - 1] + 1))
            ends = np.cumsum(size[p:q])
            stands = lists.owners[np.repeat(first[p:q] - ends + size[p:q], size[p:q]) + np.arange(ends[-1])]
            bounds = (upto[at:stop] - (upto[at - 1] if at else 0)).tolist()
            for k, begin, end in zip(counted_ones[at:stop].tolist(), [0, *bounds], bounds):
                i = int(which[k])
                a, b = int(low[i]), int(high[i])
                times = np.bincount(stands[begin:end], minlength=b)[a:b]
                near = (times >= int(pieces[k] - most[i])).nonzero()[0]
                if len(near):
                    near = near[times[near] + np.maximum(eighth[near + a], length[i] // ONE_OF) >= pieces[k]] + a
                    found.append((np.full(len(near), i), near))
            at = stop
        for i in which[~counted & (places > 0)].tolist():
            a, b = low[i], high[i]
            own, own_bits = gram_sets([texts[i]], self.bits)
            common = np.bitwise_count(self.columns[:, a:b] & own[0][:, None]).sum(axis=0, dtype=np.uint32)
            at = np.flatnonzero(common >= np.maximum(self.set_bits[a:b], own_bits[0]) - GRAM * (np.maximum(self.length[a:b], length[i]) // ONE_OF)) + a
            found.append((np.full(len(at), i), at))
        return found

    def _alike(self, x: np.ndarray, y: np.ndarray, texts: Sequence[str], length: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that share as many grams as near-same texts must, by sets of ``bits`` bits."""
        (mine, a), theirs = np.unique(x, return_inverse=True), np.unique(y)
        own, own_bits = gram_sets([texts[i] for i in mine.tolist()], bits)
        b, words, set_bits = y, self.words, self.set_bits
        if bits != self.bits:
            b, (words, set_bits) = np.searchsorted(theirs, y), gram_sets([self.texts[j] for j in theirs.tolist()], bits)
        keep = np.zeros(len(x), bool)
        step = max(1, (1 << 22) // bits)
        for at in range(0, len(x), step):
            p, q = a[at : at + step], b[at : at + step]
            common = np.bitwise_count(own[p] & words[q]).sum(axis=1, dtype=np.int64)
            limit = np.maximum(length[x[at : at + step]], self.length[y[at : at + step]]) // ONE_OF
            keep[at : at + step] = common >= np.maximum(own_bits[p], set_bits[q]) - GRAM * limit
        return x[keep], y[keep]

    def search(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int, float]]:
        """(training text, shard's text, spans, share of the training text in spans) of all near-same pairs."""
        wanted: dict[int, set[int]] = defaultdict(set)
        for i, j in self.near(texts):
            wanted[i].add(j)
        names = sorted(wanted)
        for i, parts in zip(names, self.index.matches([texts[i] for i in names], LEAST_MATCH), strict=True):
            text, want = texts[i], wanted[i]
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for low_at, high_at, low, high in parts:
                if high - low <= 4 * len(want) + 16:
                    among = set(self.index.text_of(np.arange(low, high)).tolist()) & want
                else:
                    piece = text[low_at:high_at]
                    among = {w for w in want if piece in self.texts[w]}
                for w in among:
                    spans[w].append((low_at, high_at))
            for w in want:
                # A longer match with one text hides the shorter one with another, which is looked up.
                have = spans.get(w, [])
                if sum(b - a for a, b in have) < len(text) // 2:
                    have = have + [(a, b) for a, b in _shared(text, self.texts[w], LEAST_MATCH) if all(b <= c or a >= d for c, d in have)]
                yield i, w, len(have), sum(b - a for a, b in have) / max(1, len(text))


def _shared(a: str, b: str, width: int) -> list[tuple[int, int]]:
    """Stretches of ``a`` made of grams of ``b``."""
    grams = {b[i : i + width] for i in range(len(b) - width + 1)}
    out: list[tuple[int, int]] = []
    for i in range(len(a) - width + 1):
        if a[i : i + width] in grams:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + width)
            else:
                out.append((i, i + width))
    return out


def _script(code: int) -> int:
    """A number for the script of a character; Han and kana are one, so are the Latin letters."""
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return 0
    return 0x30 if 0x3040 <= code <= 0x30FF or 0x3400 <= code <= 0x9FFF else 0xAC if 0xAC00 <= code <= 0xD7A3 else code >> 8


def text_scripts(text: str) -> list[int]:
    """The scripts under which a text is sought; two near-same texts have one in common.

    A script with three quarters of one text has at least half of the other (3/4 * 7/8 - 1/8); texts without such a script meet in -1.
    """
    count: dict[int, int] = defaultdict(int)
    for c, n in Counter(text).items():
        count[_script(ord(c))] += n
    scripts = [k for k, n in count.items() if 2 * n >= len(text)]
    return scripts if any(4 * n >= 3 * len(text) for n in count.values()) else [*scripts, -1]


def length_band(length: int) -> int:
    """The band of a text's length."""
    return int(math.log(length) * BANDS)


#: Near-same texts are at most so many bands apart.
_BANDS_APART = int(math.log(ONE_OF / (ONE_OF - 1)) * BANDS) + 1


@dataclass(frozen=True)
class _Place:
    """Where texts of a script and band go: the first of the parts, and how many there are."""

    script: int
    band: int
    first: int
    parts: int


def plan_shards(cells: Sequence[tuple[int, int, int]], chars: int = SHARD_CHARS) -> list[_Place]:
    """The shards of the (script, band, characters): neighbouring bands share one up to ``chars``, a larger band has several."""
    out, shard = [], -1
    script, begun, room = None, 0, 0
    for s, band, n in sorted(cells):
        if n > chars:
            parts = -(-n // chars)
            out.append(_Place(s, band, shard + 1, parts))
            shard, script = shard + parts, None
            continue
        if s != script or band - begun >= SHARD_BANDS or n > room:
            shard, script, begun, room = shard + 1, s, band, chars
        out.append(_Place(s, band, shard, 1))
        room -= n
    return out


def plan_tasks(cells: Sequence[tuple[int, int, int]], shards: Sequence[_Place], least: int, chars: int = TASK_CHARS) -> tuple[list[_Place], int]:
    """The tasks that search the training texts of each (script, band, characters), and how many tasks there are.

    Work is characters times shards to search; neighbouring bands go to one task, a band with more work to several.  As each
    task reads its shards anew, a task is as large as its texts allow and not smaller where there are more shards.
    """
    reach = {(s, b): {k for p in shards if p.script == s and abs(p.band - b) <= _BANDS_APART for k in range(p.first, p.first + p.parts)} for s, b, _ in cells}
    work = [(s, b, n * len(reach[s, b])) for s, b, n in sorted(cells) if reach[s, b]]
    unit = max(1, min(chars * max((len(k) for k in reach.values()), default=1), sum(w for _, _, w in work) // max(1, least)))
    out, done = [], 0
    for s, b, w in work:
        first, last = done // unit, max(done, done + w - 1) // unit
        out.append(_Place(s, b, first, last - first + 1))
        done += w
    return out, max((p.first + p.parts for p in out), default=0)


def normal_texts(df: DataFrame, text: str | Column, held: Column, keep: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with the id of their normal form, and the distinct forms with the sides they stand on.

    Rows: ``keep``, ``is_held``, ``text_id`` (128 bits of a cryptographic hash of the form).  Forms: ``text_id``,
    ``plain``, ``in_train``, ``in_held``, ``band``, ``scripts``.  Both are written once to the shared folder.
    """
    text = F.col(text) if isinstance(text, str) else text
    source = df.select(*keep, held.cast("boolean").alias("is_held"), text.cast("string").alias("plain")).where("plain is not null and is_held is not null")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = [marked(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            ids = [blake2b(p.encode(), digest_size=16).digest() for p in plain]
            columns = [*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(plain, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "text_id", "plain"]).filter(pa.array([bool(p) for p in plain]))

    out = T.StructType([*source.schema.fields[:-1], T.StructField("text_id", T.BinaryType()), T.StructField("plain", T.StringType())])
    rows, _ = stored(spread(source).mapInArrow(normalise, out))
    sides = [F.max((F.col("is_held") == side).cast("int")).alias(name) for side, name in ((False, "in_train"), (True, "in_held"))]
    forms, _ = stored(rows.groupBy("text_id").agg(F.first("plain").alias("plain"), *sides).mapInArrow(_placed, "text_id binary, plain string, in_train int, in_held int, band int, scripts array<int>"))
    return rows.drop("plain"), forms


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the length band and the scripts."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        bands, scripts = pa.array([length_band(len(t)) for t in texts], pa.int32()), pa.array([text_scripts(t) for t in texts], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, bands, scripts], ["text_id", "plain", "in_train", "in_held", "band", "scripts"])


_PARTS = ("alphabet", "first", "psi", "kept", "places", "lengths")
_INDEX_SCHEMA = "shard int, ids binary, texts binary, words binary, " + ", ".join(f"{p} binary" for p in _PARTS)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index of each shard; a task gets whole shards."""
    shards: dict[int, list[tuple[int, bytes, str]]] = defaultdict(list)
    for batch in batches:
        for shard, key, plain in zip(*(batch.column(k).to_pylist() for k in range(3))):
            shards[shard].append((len(plain), key, plain))
    for shard, held in shards.items():
        held.sort()
        texts = [t for _, _, t in held]
        words, _ = gram_sets(texts, gram_bits(len(texts[-1])))
        row = {"shard": shard, "ids": b"".join(k for _, k, _ in held), "texts": "".join(texts).encode(), "words": words.tobytes()} | TextIndex(texts).parts()
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == "shard" else pa.binary()) for k, v in row.items()], list(row))


def load_shard(place: str, shard: int) -> Shard:
    """A shard that was written below ``place``, from the shared folder."""
    system, root = pafs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (pafs.LocalFileSystem(), place)
    files = [f.path for f in system.get_file_info(pafs.FileSelector(f"{root}/shard={shard}")) if f.base_name.endswith(".parquet")]
    row = {k: v for f in files for k, v in pq.read_table(f, filesystem=system, partitioning=None).slice(0, 1).to_pylist()[0].items()}
    joined, bounds = row["texts"].decode(), np.cumsum(np.frombuffer(row["lengths"], np.int32).astype(np.int64) - 1).tolist()
    texts = [joined[a:b] for a, b in zip([0, *bounds], bounds)]
    return Shard([row["ids"][i : i + 16] for i in range(0, len(row["ids"]), 16)], texts, row, row["words"])


def _searcher(place: str, shards: Sequence[_Place]):
    """A ``mapInArrow`` function: training texts against all shards of their script and of like length."""

    def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes, str]]]:
        rows, chars = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows.append(row)
                chars += len(row[3])
                if chars >= BUFFER_CHARS:
                    yield rows
                    rows, chars = [], 0
        if rows:
            yield rows

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buffers(batches):
            by_shard: dict[int, list[int]] = defaultdict(list)
            for (script, band), group in _grouped(rows).items():
                for k in {k for p in shards if p.script == script and abs(p.band - band) <= _BANDS_APART for k in range(p.first, p.first + p.parts)}:
                    by_shard[k] += group
            for k in sorted(by_shard):
                shard, wanted = load_shard(place, k), by_shard[k]
                found = [(rows[wanted[i]][2], shard.ids[j], n, share) for i, j, n, share in shard.search([rows[w][3] for w in wanted]) if rows[wanted[i]][2] != shard.ids[j]]
                columns = list(zip(*found)) or [(), (), (), ()]
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["train_id", "held_id", "spans", "covered"])

    return search


def _grouped(rows: Sequence[tuple[int, int, bytes, str]]) -> dict[tuple[int, int], list[int]]:
    out: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, (script, band, _, _) in enumerate(rows):
        out[script, band].append(i)
    return out


def near_pairs(forms: DataFrame) -> DataFrame:
    """(``train_id``, ``held_id``, ``spans``, ``covered``) of different forms that are near-same across the sides.

    The driver reads characters by script and length band, a number that does not grow with the rows.  Shards are built
    once and written to the shared folder; the tasks read those they need from there, so no text is sent twice.
    """
    spark = forms.sparkSession
    schema = "train_id binary, held_id binary, spans long, covered double"
    sized = forms.select("text_id", "plain", "in_train", "in_held", "band", F.explode("scripts").alias("script"))
    chars = sized.groupBy("script", "band").agg(*[F.sum(F.col(side) * (F.length("plain") + 1)).alias(side) for side in ("in_train", "in_held")]).collect()
    shards = plan_shards([(r["script"], r["band"], r["in_held"]) for r in chars if r["in_held"]])
    tasks, n_tasks = plan_tasks([(r["script"], r["band"], r["in_train"]) for r in chars if r["in_train"]], shards, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    if not tasks:
        return spark.createDataFrame([], schema)

    def sent(side: str, places: Sequence[_Place], columns: Sequence[str]) -> DataFrame:
        where = F.broadcast(spark.createDataFrame([(p.script, p.band, p.first, p.parts) for p in places], "script int, band int, first int, parts int"))  # as few as ``chars``
        part = F.expr("first + cast(pmod(xxhash64(text_id), parts) as int)")
        return sized.where(f"{side} = 1").join(where, ["script", "band"]).select(part.alias("part"), *columns)

    n_shards = max(p.first + p.parts for p in shards)
    built = sent("in_held", shards, ["text_id", "plain"]).repartitionById(n_shards, "part").mapInArrow(_build, _INDEX_SCHEMA)
    _, place = stored(built, by="shard")
    train = sent("in_train", tasks, ["script", "band", "text_id", "plain"]).repartitionById(n_tasks, "part").drop("part")
    found = train.mapInArrow(_searcher(place, shards), schema)
    return found.dropDuplicates(["train_id", "held_id"])  # texts of mixed scripts may meet twice


def linked_forms(forms: DataFrame) -> DataFrame:
    """(``train_id``, ``held_id``) of all same or near-same forms across the sides."""
    same = forms.where("in_train = 1 and in_held = 1").select(F.col("text_id").alias("train_id"), F.col("text_id").alias("held_id"))
    return near_pairs(forms).select("train_id", "held_id").unionByName(same)


def row_pairs(rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs of rows behind the linked forms, the smaller key first."""
    train = rows.where("not is_held").select(F.col("text_id").alias("train_id"), F.col(key).alias("a"))
    held = rows.where("is_held").select(F.col("text_id").alias("held_id"), F.col(key).alias("b"))
    pairs = links.join(train, "train_id").join(held, "held_id")
    return pairs.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b"))


def overlap_report(rows: DataFrame, links: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts by the fields ``by`` of the held rows and by ``dataset_source`` of the training rows, without the pairs.

    Rows are counted per form before the links are joined: ``n_held`` held rows have a partner, in ``n_pairs`` pairs.
    """
    train = rows.where("not is_held").groupBy(F.col("text_id").alias("train_id"), F.col("dataset_source").alias("train_source")).agg(F.count("*").alias("n_train"))
    held = rows.where("is_held").groupBy(F.col("text_id").alias("held_id"), *by).agg(F.count("*").alias("n"))
    partners = links.join(train, "train_id").groupBy("held_id", "train_source").agg(F.sum("n_train").alias("n_train"))
    return partners.join(held, "held_id").groupBy(*by, "train_source").agg(F.sum("n").alias("n_held"), F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"))
