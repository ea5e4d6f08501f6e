"""Helpers shared by the text operators: reading, slicing by document order, hashing of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes between words: blank and the controls 9 to 13.  Letters outside A-Z are never folded.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The whole text, with null read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


#: Tables of at most so many rows or values are sent to every task; larger ones are joined by a shuffle.
MOST_SENT = 2_000_000


def sent(small: DataFrame, values: Column | None = None) -> DataFrame:
    """A written table, marked for sending to every task if its rows (or the values in them) are few enough."""
    found = small.agg(F.sum(values) if values is not None else F.count("*")).first()[0] or 0
    return F.broadcast(small) if found <= MOST_SENT else small


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most_bytes`` of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(sizes, dtype=np.int64) // most_bytes
        cuts = np.flatnonzero(np.diff(piece)) + 1
        for start, stop in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(start, stop - start)


def order_bounds(df: DataFrame, key: str, rows_per_slice: int, most_slices: int = 4096) -> list[int]:
    """Ascending distinct keys that cut ``df`` into slices of about ``rows_per_slice`` rows.

    Only the key column is read, and at most ``most_slices`` numbers reach the driver; beyond
    that, slices grow, and they are only ever streamed.  Each bound is a key that occurs.
    Slice 0 holds keys below the first bound, and null keys.
    """
    slices = min(most_slices, -(-df.select(key).count() // rows_per_slice))
    if slices <= 1:
        return []
    marks = [i / slices for i in range(1, slices)]
    return sorted(set(df.select(F.percentile_approx(key, marks, 10 * slices)).first()[0] or []))


def slice_numbers(keys: pa.Array, bounds: list[int]) -> np.ndarray:
    """Slice of each key; null keys are in slice 0."""
    known = keys.cast(pa.int64())
    place = np.searchsorted(np.array(bounds, dtype=np.int64), known.fill_null(0).to_numpy(zero_copy_only=False), "right")
    return np.where(known.is_null().to_numpy(zero_copy_only=False), 0, place).astype(np.int32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED = _BYTE[_FOLD]
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, dtype=np.uint64)]
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of an odd number, modulo 2**64; kept for the next call."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            size = 1 << int(n - 1).bit_length()
            _POWERS[0] = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _STEP)]).cumprod(dtype=np.uint64)
    return _POWERS[0]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and first byte of every word of a UTF-8 buffer, A-Z folded to a-z.

    A word's hash depends on its bytes alone: the sum of byte codes times a power of the
    place in the word, then scrambled.
    """
    gap = _GAP[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    lengths = ends - starts
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if place is None:
        place = np.arange(len(data)) - np.concatenate([
            np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(data))))])
    power = _powers(int(lengths.max()) + 1)
    value = np.where(gap, np.uint64(0), _FOLDED[data] * power[np.minimum(place, len(power) - 1)])
    return mix64(np.add.reduceat(value, starts) + lengths.astype(np.uint64)), starts


def shingle_hashes(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``size`` words.

    A text of fewer words has one shingle, its whole sequence; a text without words has none.
    """
    array = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64)[array.offset:array.offset + len(array) + 1]
    whole = array.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offsets[0]:offsets[-1]] if whole is not None else np.empty(0, np.uint8)
    # A gap between texts keeps the last word of one apart from the first of the next.
    bounds = offsets - offsets[0] + np.arange(len(offsets))
    joined = np.full(len(data) + len(offsets) - 1, 32, dtype=np.uint8)
    keep = np.ones(len(joined), dtype=bool)
    keep[bounds[1:] - 1] = False
    joined[keep] = data
    words, starts = word_hashes(joined)
    first = np.searchsorted(starts, bounds)
    odd = np.arange(1, 2 * size, 2, dtype=np.uint64) * _STEP
    runs = words[: max(0, len(words) - size + 1)] * odd[0]
    for i in range(1, size):
        runs = mix64(runs) + words[i: i + len(runs)] * odd[i]
    runs = mix64(runs)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(runs[a: b - size + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                short = mix64(short) + words[i:i + 1] * odd[0]
            yield mix64(short)
        else:
            yield np.empty(0, np.uint64)
