"""Several values packed in one field: one row per value, with its position.

The operator works on the Arrow string buffers of a batch.  All fields of a batch are one byte array;
vectorised masks over it give quote parity and delimiters, from which child offsets, the list array and the
flattened rows with parent ordinals are derived.  No Python code runs per row or per character.

Defined results:

* null and empty fields have no values; a field of blanks only has none either;
* delimiters are ``, ; |`` and their full-width forms, the ideographic comma, the bullet, tabs, line breaks and a
  slash between blanks; a delimiter inside quotes belongs to the value;
* a field in brackets is a list (``[...]``); the first quote character in it is the list's quote;
* a field that opens with a list mark (``1.  1)  (1)  -  *``) is an enumeration: its marks are no part of the
  values, and numbered marks also separate values that stand in one line;
* a doubled or backslash-escaped quote inside a quoted value is one quote;
* quotes that do not pair up in a field are ordinary characters;
* empty values are dropped and not counted, repeated values stay, ``pos`` counts from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Single-byte delimiters, and the UTF-8 forms of the longer ones.
ASCII_DELIMITERS = b",;|\n\r\t"
WIDE_DELIMITERS = ("，", "；", "、", "｜", "•")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _running_parity(flags: np.ndarray, starts: np.ndarray, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, whether an odd number of flags lies before or at it in its row; for each row, its count of flags."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    inside = (total[1:] - total[starts[:-1]][row_of]) & 1
    return inside.astype(bool), total[starts[1:]] - total[starts[:-1]]


def _next_where(flags: np.ndarray) -> np.ndarray:
    """For each index, the first flagged index at or after it (the length if none)."""
    n = len(flags)
    out = np.where(flags, np.arange(n), n)
    return np.concatenate((np.minimum.accumulate(out[::-1])[::-1], [n]))


def _last_where(flags: np.ndarray) -> np.ndarray:
    """For each index, the last flagged index before it (-1 if none)."""
    out = np.where(flags, np.arange(len(flags)), -1)
    return np.concatenate(([-1], np.maximum.accumulate(out)))


def split_batch(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent ordinals, positions (from 1) and values of all fields in an Arrow string array."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    empty = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    if len(column) == 0 or offsets[0] == offsets[-1]:
        return empty
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    n, rows = len(data), len(column)
    row_of = np.repeat(np.arange(rows), np.diff(starts))
    index = np.arange(n)

    solid = ~_BLANK[data]
    next_solid, last_solid = _next_where(solid), _last_where(solid)
    head = np.minimum(next_solid[starts[:-1]], starts[1:])  # first solid byte of each row; its end if blank
    tail = last_solid[starts[1:]]
    alive = head < starts[1:]
    safe = np.minimum(head, n - 1)

    # Which character quotes in each row: the first one in a bracketed list, the double quote elsewhere.
    bracket = alive & (data[safe] == ord("[")) & (data[np.maximum(tail, 0)] == ord("]")) & (tail > head)
    inner = np.minimum(next_solid[np.minimum(safe + 1, n - 1)], n - 1)
    single = bracket & (data[inner] == ord("'"))
    mark = np.where(single, ord("'"), ord('"')).astype(np.uint8)
    quote = data == mark[row_of]
    before = np.concatenate(([0], data[:-1]))
    quote &= ~((before == ord("\\")) & (index > starts[:-1][row_of]))
    inside, quotes = _running_parity(quote, starts, row_of)
    paired = quotes % 2 == 0
    quote &= paired[row_of]
    outside = ~(inside & paired[row_of])

    # Delimiters: (first byte, width) masks.
    width = np.zeros(n, np.int8)
    for byte in ASCII_DELIMITERS:
        width[(data == byte)] = 1
    for text in WIDE_DELIMITERS:
        raw = text.encode()
        hit = np.zeros(n, bool)
        if n >= len(raw):
            hit[: n - len(raw) + 1] = np.logical_and.reduce([data[i : n - len(raw) + 1 + i] == b for i, b in enumerate(raw)])
        width[hit] = len(raw)
    after = np.concatenate((data[1:], [0]))
    width[(data == ord("/")) & _BLANK[before] & _BLANK[after]] = 1
    # A slash at the end of a field, after a blank, also separates (an empty last value).
    at_end = index == tail[row_of]
    width[(data == ord("/")) & _BLANK[before] & at_end] = 1
    width[~outside] = 0
    for edge in (head[bracket], tail[bracket]):  # the brackets of a list bound its first and last value
        width[edge] = 1

    # Numbered marks: "(" digits ")" or digits "." / ")" followed by a blank, after the start, a blank or a delimiter.
    digit = _DIGIT[data]
    not_digit = _next_where(~digit)
    begins = digit & ~_DIGIT[before] | (digit & (index == starts[:-1][row_of]))
    run_end = np.minimum(not_digit[:-1], n - 1)
    closing = ((data[run_end] == ord(".")) | (data[run_end] == ord(")"))) & (row_of[run_end] == row_of)
    end_row = np.minimum(run_end + 1, n - 1)
    followed = (_BLANK[data[end_row]] & (row_of[end_row] == row_of)) & (run_end + 1 < n)
    opens = np.where((before == ord("(")) & (index > starts[:-1][row_of]), index - 1, index)
    at_row_start = opens == starts[:-1][row_of]
    prior = data[np.maximum(opens - 1, 0)]
    led = at_row_start | _BLANK[prior] | (np.concatenate(([0], width))[opens] > 0)
    numbered = begins & closing & followed & led & outside
    where = np.flatnonzero(numbered)
    first_mark = np.zeros(rows, bool)
    first_mark[row_of[where[opens[where] == head[row_of[where]]]]] = True
    where = where[first_mark[row_of[where]]]
    mark_from, mark_to = opens[where], run_end[where] + 1

    cut_at = np.flatnonzero(width > 0)
    lo = np.concatenate((starts[:-1], cut_at + width[cut_at], mark_to))
    hi = np.concatenate((cut_at, mark_from, starts[1:]))
    # Segments: from each boundary to the next cut.  Sorting both sides pairs them, as cuts never overlap.
    lo.sort(kind="stable")
    hi.sort(kind="stable")
    keep = lo < hi
    lo, hi = lo[keep], hi[keep]
    # Blanks outside, then bullets, blanks, and one pair of enclosing quotes.
    lo = np.minimum(next_solid[lo], hi)
    hi = last_solid[hi] + 1
    keep = lo < hi
    lo, hi = lo[keep], hi[keep]
    if len(lo) == 0:
        return empty
    parent = row_of[lo]
    bullet = ((data[lo] == ord("-")) | (data[lo] == ord("*"))) & (lo + 1 < hi) & _BLANK[data[np.minimum(lo + 1, n - 1)]]
    lo = np.where(bullet, np.minimum(next_solid[np.minimum(lo + 1, n - 1)], hi), lo)
    lone = (hi - lo == 1) & ((data[np.minimum(lo, n - 1)] == ord("-")) | (data[np.minimum(lo, n - 1)] == ord("*")))
    quoted = (hi - lo >= 2) & quote[np.minimum(lo, n - 1)] & quote[hi - 1]
    lo, hi = lo + quoted, hi - quoted
    # A quoted value keeps no outer blanks either.
    lo = np.minimum(next_solid[np.minimum(lo, n - 1)], hi)
    hi = np.maximum(last_solid[hi] + 1, lo)
    keep = (lo < hi) & ~lone
    lo, hi, parent, quoted = lo[keep], hi[keep], parent[keep], quoted[keep]
    if len(lo) == 0:
        return empty

    # Child array: gather the kept bytes, offsets from the segment lengths.
    size = hi - lo
    child = np.concatenate(([0], np.cumsum(size)))
    gather = np.repeat(lo - child[:-1], size) + np.arange(child[-1])
    values = pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(child.astype(np.int64)), pa.py_buffer(data[gather].tobytes()))
    if quoted.any():
        plain = pc.replace_substring(pc.replace_substring(values, '""', '"'), '\\"', '"')
        plain = pc.replace_substring(plain, "\\'", "'")
        values = pc.if_else(pa.array(quoted), plain, values)
    first = np.concatenate(([True], parent[1:] != parent[:-1]))
    at = np.arange(len(parent))
    pos = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
    return parent, pos, values


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent, pos, values = split_batch(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(parent)), pa.array(pos, pa.int64()), values.cast(pa.string())], ["row_key", "pos", "value"]
        )


def packed_values(df: DataFrame, key: str | Column, field: str | Column) -> DataFrame:
    """(``row_key`` bigint, ``pos`` bigint, ``value`` string): one row per value of ``field``.

    Narrow: no shuffle; only the two columns reach Python.  Clashing or further columns of ``df`` do not matter, as
    both are projected by expression.  Rows with a null field give no row; a null key is kept.
    """
    key = F.col(key) if isinstance(key, str) else key
    field = F.col(field) if isinstance(field, str) else field
    source = df.select(key.cast("long").alias("row_key"), field.cast("string").alias("packed")).where(F.col("packed").isNotNull())
    return source.mapInArrow(_explode, "row_key long, pos long, value string")


def _explode_multi(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parent, pos, values = split_batch(batch.column(1))
        keep = np.bincount(parent, minlength=batch.num_rows)[parent] >= 2 if len(parent) else np.zeros(0, bool)
        chosen = pa.array(np.flatnonzero(keep))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(parent[keep])), pa.array(pos[keep], pa.int64()), values.take(chosen).cast(pa.string())],
            ["row_key", "pos", "value"],
        )


def packed_multi(df: DataFrame, key: str | Column, field: str | Column) -> DataFrame:
    """As :func:`packed_values`, but only for fields that hold two or more values; still narrow.

    Two values and a delimiter take three characters, so shorter fields are left out before they reach Python.
    """
    key = F.col(key) if isinstance(key, str) else key
    field = F.col(field) if isinstance(field, str) else field
    source = df.select(key.cast("long").alias("row_key"), field.cast("string").alias("packed")).where(F.length("packed") > 2)
    return source.mapInArrow(_explode_multi, "row_key long, pos long, value string")
