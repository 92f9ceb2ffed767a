"""Vectorised splitting of Arrow text columns into words, on UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once by the kernels; bounds their temporaries, not what they cover.
BLOCK_BYTES = 4 << 20


def byte_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: White space as in ``[\x20\x09-\x0D]``; every other byte is part of a word.
SPACE_WORDS = byte_table(b" \t\n\x0b\x0c\r")
#: Digits, a-z and everything beyond ASCII, as in ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
ALNUM_WORDS = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """Words of consecutive documents.

    ``codes[i]`` is the index in ``vocab`` of word i; document d has words ``first[d]:first[d + 1]``.
    ``start`` and ``end`` are byte offsets into ``data``, the concatenated texts.
    """

    codes: np.ndarray
    vocab: pa.Array
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated UTF-8 of a string column (nulls empty) and the n + 1 offsets into it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def split_words(column: pa.Array, table: np.ndarray, lower: bool = False) -> Words:
    """Words of every text, dictionary-encoded. Null and empty texts have none."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = table[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    opens[begins] = inside[begins]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[begins[1:] - 1] = inside[begins[1:] - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    coded = slices(data[inside], bounds).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(start, offsets), start, end, data)


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of ``column`` each, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    if not len(size):
        return
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def give_back() -> None:
    """Return freed memory to the system: workers live on, and their next task may need none of it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def then_give_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, after which the task's memory goes back."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def by_block(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], limit: int = BLOCK_BYTES):
    """A function for ``mapInArrow`` that applies ``work`` to slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, column, limit):
                out = work(part)
                if out is not None and out.num_rows:
                    yield out

    return then_give_back(run)


def segments(counts: np.ndarray) -> np.ndarray:
    """0 .. c - 1 for each count c, joined."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each of the slices ``first[d]:first[d + 1]``, empty ones 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]
