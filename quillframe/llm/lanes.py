"""Running byte automata over Arrow text columns in lockstep.

Texts are laid out as lanes of LANE bytes, so that one numpy step advances every lane by a byte and
a long text is many short lanes instead of many steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LANE = 512
#: Bytes handled at a time; a longer single text is handled alone.
BLOCK_BYTES = 4 << 20


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), offsets


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about BLOCK_BYTES each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
        yield at, to
        at = to


def layout(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte classes as an array (step, lane), padded with pad, and the row of each lane."""
    lengths = np.diff(offsets)
    lanes = -(-lengths // LANE)
    first = np.concatenate([[0], np.cumsum(lanes)])
    flat = np.full(int(first[-1]) * LANE, pad, dtype=np.uint8)
    codes = lut[data[offsets[0] : offsets[-1]]]
    base = offsets[0]
    for i in np.flatnonzero(lengths):
        flat[first[i] * LANE : first[i] * LANE + lengths[i]] = codes[offsets[i] - base : offsets[i + 1] - base]
    return np.ascontiguousarray(flat.reshape(-1, LANE).T), np.repeat(np.arange(len(lengths)), lanes)
