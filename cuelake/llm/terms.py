"""Runs of bytes as words, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
#: A-Z to a-z; every other byte stays.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: ASCII letters and all bytes of other characters: what `[^\x00-\x40\x5B-\x60\x7B-\x7F]` matches in UTF-8.
LETTER = (_BYTES >= 128) | ((LOWER >= 97) & (LOWER <= 122))


def runs(solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, text) of the longest runs of True; none crosses a place where a text starts."""
    if not len(solid):
        return (np.zeros(0, np.int64),) * 3
    inner = starts[(starts > 0) & (starts < len(solid))]
    fresh = np.ones(len(solid), bool)
    fresh[1:] = ~solid[:-1]
    fresh[inner] = True
    begin = np.flatnonzero(solid & fresh)
    last = np.ones(len(solid), bool)
    last[:-1] = ~solid[1:]
    last[inner - 1] = True
    end = np.flatnonzero(solid & last) + 1
    return begin, end, np.searchsorted(starts, begin, "right") - 1


def distinct(data: np.ndarray, solid: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each run's number and the distinct runs by number, compared by their bytes. The runs are all of ``solid``."""
    offsets = np.zeros(len(begin) + 1, np.int32)
    np.cumsum(end - begin, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[solid]))])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def in_order(codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same with the distinct runs in the order of their bytes."""
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[codes], words.take(pa.array(order))


def lengths(words: pa.Array) -> np.ndarray:
    return pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)


def numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's number and the distinct values; there are no nulls."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
