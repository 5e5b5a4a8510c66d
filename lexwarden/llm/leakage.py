"""Documents that hold evaluation passages (problem 8).

One Aho-Corasick automaton over pieces of the normalised items scans each normalised document once; hits are chained
along the item, and the passage is given in offsets of the original text.  Pieces stand at every ``STRIDE`` characters of
an item, so that any common run of ``piece + STRIDE - 1`` characters is hit.  Every piece leads to every item that has it,
so what a document holds does not depend on which or how many other items there are.

A document holds an item if one passage in it, in the item's order, matches at least half of the item's characters, gaps
of a few changed words included.

Defined results: null and empty documents or items match nothing; items without letters or digits match nothing; items
of the same wording are found together; items of a few letters must stand as words of their own; repeated documents are
each reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexwarden.llm.wording import bare, bare_offsets, dense_script
from lexwarden.session import spread, stored

STRIDE = 4
#: Piece length for alphabetic and for dense scripts, and the short grams that confirm a candidate.
PIECE, DENSE_PIECE, GRAM, DENSE_GRAM = 16, 8, 6, 3
#: One of so many pieces of an item must be hit near one diagonal before the passage is looked at.
HIT_ONE_OF = 4
#: Changed wording that one passage may bridge, in characters of the normal form.
BRIDGE = 48
#: What a bridged character of the item costs, in matched ones; a passage begins anew where bridging costs more than it brings.
GAP_COST = 2
#: How much of a passage must match, a share of the passage and one of the item: 0.92 of a passage of half an item, 0.85 of
#: one of the whole.  What the passage bridges then counts as wording too.
SURE, EXTRA = 0.78, 0.07
#: Characters of items in one automaton, which takes about 400 bytes for each; more items are several automata.
MAX_CHARS = 500_000
#: Characters of documents that a task holds while it goes through the automata.
BUFFER_CHARS = 8_000_000


class LeakIndex:
    """The automaton over the pieces of some items."""

    def __init__(self, items: Sequence[tuple[int, str]]) -> None:
        same: dict[str, list[int]] = defaultdict(list)
        for number, text in items:
            if text and (plain := bare(text)):
                same[plain].append(number)
        self.texts = list(same)
        self.numbers = [sorted(same[t]) for t in self.texts]
        self.dense = [dense_script(t) for t in self.texts]
        self.grams: dict[int, dict[str, list[int]]] = {}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.least = []
        for i, text in enumerate(self.texts):
            size = min(len(text), DENSE_PIECE if self.dense[i] else PIECE)
            starts = list(range(0, len(text) - size + 1, STRIDE))
            if starts[-1] != len(text) - size:
                starts.append(len(text) - size)
            for p in starts:
                at[text[p : p + size]].append((i, p))
            self.least.append(max(1, len(starts) // HIT_ONE_OF))
        self.machine = ahocorasick.Automaton()
        for piece, places in at.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def search(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, share of the item, first and last original offset of the passage) for each item the text holds."""
        if not len(self.machine):
            return []
        plain = bare(text)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, leads) in self.machine.iter(plain):
            for i, p in leads:
                found[i].append((end - size + 1, p))
        out, offsets = [], None
        for i, hits in found.items():
            if len(hits) < self.least[i] or self._banded(hits) < self.least[i]:
                continue
            if len(self.texts[i]) <= (DENSE_GRAM if self.dense[i] else GRAM):
                offsets = bare_offsets(text) if offsets is None else offsets
                hits = hits if self.dense[i] else [h for h in hits if self._stands_alone(text, offsets, h[0], len(self.texts[i]))]
                if not hits:
                    continue
            share, low, high = self._passage(plain, i, hits)
            if share >= 0.5:
                if offsets is None:
                    offsets = bare_offsets(text)
                out += [(n, share, int(offsets[low]), int(offsets[high - 1]) + 1) for n in self.numbers[i]]
        return out

    @staticmethod
    def _stands_alone(text: str, offsets, at: int, size: int) -> bool:
        """Whether no letter or digit stands beside the stretch of the original text."""
        low, high = int(offsets[at]), int(offsets[at + size - 1]) + 1
        return not text[max(0, low - 1) : low].isalnum() and not text[high : high + 1].isalnum()

    @staticmethod
    def _banded(hits: list[tuple[int, int]]) -> int:
        """The most hits whose diagonals lie within one bridge."""
        shifts = sorted(x - p for x, p in hits)
        best = low = 0
        for high, shift in enumerate(shifts):
            while shift - shifts[low] > BRIDGE:
                low += 1
            best = max(best, high - low + 1)
        return best

    def _passage(self, plain: str, i: int, hits: list[tuple[int, int]]) -> tuple[float, int, int]:
        """(share of the item, from, to) of its best passage: common stretches near the diagonals of the hits, chained in order."""
        item = self.texts[i]
        gram = DENSE_GRAM if self.dense[i] else GRAM
        if len(item) <= gram:
            return 1.0, hits[0][0], hits[0][0] + len(item)
        places = self.grams.get(i)
        if places is None:
            places = defaultdict(list)
            for p in range(len(item) - gram + 1):
                places[item[p : p + gram]].append(p)
            self.grams[i] = places
        best = (0.0, 0, 1)
        # Groups of hits on near diagonals are the passages to look at.
        shifts = sorted(x - p for x, p in hits)
        groups, first = [], shifts[0]
        for a, b in zip(shifts, [*shifts[1:], None]):
            if b is None or b - a > BRIDGE:
                groups.append((first - BRIDGE, a + BRIDGE))
                first = b
        for low, high in groups:
            share, at, end = self._chain(plain, places, gram, len(item), low, high)
            if share > best[0]:
                best = (share, at, end)
        return best

    @staticmethod
    def _chain(plain: str, places: dict[str, list[int]], gram: int, size: int, low: int, high: int) -> tuple[float, int, int]:
        """The share of an item of ``size`` that the best chain of its common stretches has, and where the chain lies.

        Stretches on the diagonals ``low`` to ``high`` follow each other in the document and in the item, with at most
        ``BRIDGE`` characters between them in either.
        """
        stretches: list[list[int]] = []  # document from, item from, length
        going: dict[int, list[int]] = {}
        for x in range(max(0, low), min(len(plain), high + size) - gram + 1):
            spots = places.get(plain[x : x + gram])
            now = {}
            for p in spots or ():
                if low <= x - p <= high:
                    run = going.get(x - p)
                    if run is None:
                        run = [x, p, gram - 1]
                        stretches.append(run)
                    run[2] += 1
                    now[x - p] = run
            going = now
        reach = BRIDGE + max((n for _, _, n in stretches), default=0)
        matched, start, value, best, begin = [], [], [], (0.0, 0, 1), 0
        for j, (x, p, n) in enumerate(stretches):  # in order of place in the document
            while x - stretches[begin][0] > reach:
                begin += 1
            worth, came, new = n, j, n
            for i in range(begin, j):
                a, b, m = stretches[i]
                gap_x, gap_p = x - a - m, p - b - m
                over = max(0, -gap_x, -gap_p)
                if over < n and gap_x <= BRIDGE and gap_p <= BRIDGE and p > b and value[i] + n - over - GAP_COST * max(0, gap_p) > worth:
                    worth, came, new = value[i] + n - over - GAP_COST * max(0, gap_p), i, n - over
            value.append(worth)
            matched.append(new + (matched[came] if came < j else 0))
            start.append(start[came] if came < j else j)
            whole = p + n - stretches[start[j]][1]
            if matched[j] >= SURE * whole + EXTRA * size and whole > best[0] * size:
                best = (whole / size, stretches[start[j]][0], x + n)
        return best


@lru_cache(maxsize=2)
def _index(place: str, shard: int) -> LeakIndex:
    """The automaton of a shard of items that was written below ``place``; built once per worker."""
    system, root = pafs.FileSystem.from_uri(place)
    files = [f.path for f in system.get_file_info(pafs.FileSelector(f"{root}/shard={shard}", allow_not_found=True)) if f.base_name.endswith(".parquet")]
    return LeakIndex([(r["item_key"], r["item_text"]) for f in files for r in pq.read_table(f, filesystem=system, partitioning=None).to_pylist()])


def _buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches joined up to ``BUFFER_CHARS`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BUFFER_CHARS:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def leaked_items(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``key``, ``item_key``, ``share``, ``passage_from``, ``passage_to``): documents and the items they hold.

    The items are written to the shared folder in shards of about ``MAX_CHARS`` characters.  A task reads its documents
    once and holds some of them while it goes through the automata of all shards, so that neither the corpus is read again
    nor any memory grows with the items.  Narrow over the documents.
    """
    plain = items.select(F.col(item_key).cast("long").alias("item_key"), F.col(item_text).cast("string").alias("item_text")).where("item_text is not null")
    shards = max(1, -(-(plain.agg(F.sum(F.length("item_text"))).first()[0] or 0) // MAX_CHARS))
    _, place = stored(plain.withColumn("shard", F.pmod(F.xxhash64("item_key"), F.lit(shards)).cast("int")).repartition(shards, "shard"), by="shard")
    kind = df.select(key).schema[0].dataType.simpleString()
    source = spread(df.select(F.col(key), F.col(text).cast("string").alias("__text")).where("__text is not null"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _buffers(batches):
            texts = table.column(1).to_pylist()
            for shard in range(shards):
                index = _index(place, shard)
                found = [(i, *hit) for i, value in enumerate(texts) for hit in index.search(value)]
                rows, *columns = list(zip(*found)) or [(), (), (), (), ()]
                kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
                keys = table.column(0).take(pa.array(rows, pa.int64())).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys, *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], [key, item_key, "share", "passage_from", "passage_to"])

    return source.mapInArrow(scan, f"`{key}` {kind}, `{item_key}` long, share double, passage_from long, passage_to long")
