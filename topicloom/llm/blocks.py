"""Texts of Arrow batches as byte arrays, words and hashed shingles, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_LANE_SEED = np.uint64(0xD6E8FEB86659FD93)
_SHINGLE_BASE = np.uint64(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = x + _ODD
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))



def lower_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A"):ord("Z") + 1] += 32
    return table


def bytes_in(*ranges: tuple[int, int]) -> np.ndarray:
    """Byte table that is true inside the given inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


def blocks(
    batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = BLOCK_BYTES
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Yield (rows, bytes, offsets): slices of the batches with about ``max_bytes`` of text.

    A text is never cut, so one row longer than the bound is a block of its own. A null
    text counts as empty.
    """
    for batch in batches:
        column = pc.fill_null(batch.column(text).cast(pa.large_string()), "")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
            column.offset:column.offset + len(column) + 1
        ]
        buffer = column.buffers()[2]
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)
        start = 0
        while start < len(column):
            stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), len(column))
            low, high = offsets[start], offsets[stop]
            yield batch.slice(start, stop - start), data[low:high], offsets[start:stop + 1] - low
            start = stop


@dataclass(frozen=True)
class Words:
    """Words of a block: byte ranges, 64-bit hashes, and the first word of every text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes within each text."""
    inside = is_word[data]
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return Words(none, none, np.empty(0, dtype=np.uint64), np.zeros(len(offsets), np.int64))
    # Words are runs, so the lengths follow from the number of word bytes between starts.
    places = np.cumsum(inside)[starts] - 1
    total = int(inside.sum())
    lengths = np.diff(np.append(places, total))
    # Eight bytes at a time, each mixed with its place: no structure of the word survives.
    rows = (lengths + 7) >> 3
    head = np.cumsum(rows) - rows
    padded = np.zeros(8 * int(rows.sum()), dtype=np.uint8)
    target = np.repeat(8 * head - places, lengths)
    target += np.arange(total)
    padded[target] = data[inside]
    number = (np.arange(len(padded) // 8) - np.repeat(head, rows)).astype(np.uint64)
    with np.errstate(over="ignore"):
        lanes = mix(padded.view("<u8") ^ mix(number + _LANE_SEED))
        sums = np.add.reduceat(lanes, head)
        hashes = mix(sums + lengths.astype(np.uint64) * _ODD)
    return Words(starts, starts + lengths, hashes, np.searchsorted(starts, offsets))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): hashed runs of ``size`` words, and where each text's runs begin.

    A text with fewer words, but not none, has its whole word sequence as the one run.
    """
    counts = np.diff(words.first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(runs)])
    out = np.empty(first[-1], dtype=np.uint64)
    n = len(words.hashes)
    with np.errstate(over="ignore"):
        if n >= size:
            rolled = np.zeros(n - size + 1, dtype=np.uint64)
            for j in range(size):
                rolled = rolled * _SHINGLE_BASE + words.hashes[j:n - size + 1 + j]
            long = counts >= size
            begin = words.first[:-1][long]
            lengths = runs[long]
            inner = np.arange(int(lengths.sum())) - np.repeat(
                np.cumsum(lengths) - lengths, lengths
            )
            source = np.repeat(begin, lengths) + inner
            target = np.repeat(first[:-1][long], lengths) + inner
            out[target] = mix(rolled[source])
        for m in range(1, size):
            short = np.flatnonzero(counts == m)
            if len(short):
                rolled = np.full(len(short), np.uint64(m), dtype=np.uint64)
                for j in range(m):
                    rolled = rolled * _SHINGLE_BASE + words.hashes[words.first[short] + j]
                out[first[short]] = mix(rolled)
    return out, first
