"""Polynomial hashes of stretches of UTF-8 text, for whole Arrow batches at once.

With S the running sum of table[byte] * R**position modulo 2**64, the stretch from a to b has the hash
(S[b] - S[a]) * R**-a: it depends on its bytes only, wherever it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
#: Another table and base, for a second hash that has nothing in common with the first.
SECOND_TABLE = np.random.default_rng(20250611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND_R = 0xD1342543DE82EF95
#: Odd factors that tell apart the words of a shingle by their place.
PLACES = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all 64 (the finaliser of a public 64-bit generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of a base and of its inverse, as far as asked for."""

    def __init__(self, base: int):
        self.bases = (("up", base), ("down", pow(base, -1, 1 << 64)))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, base in self.bases:
                out, have = np.ones(size, np.uint64), 1
                while have < size:
                    out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 1 << 64))
                    have *= 2
                setattr(self, name, out)
        return self.up, self.down


POWERS, SECOND_POWERS = Powers(_R), Powers(_SECOND_R)


def running_sums(data: np.ndarray, table: np.ndarray = TABLE, powers: Powers = POWERS) -> np.ndarray:
    up, _ = powers.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=out[1:])
    return out


def stretch_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Unmixed hashes of the stretches from a to b."""
    _, down = powers.upto(len(sums))
    return (sums[b] - sums[a]) * down[a]


def text_slices(batch: pa.RecordBatch, column: str = "text", size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch of about ``size`` bytes of text each, or of one text where that is longer:
    (slice, bytes, where each text starts and the last ends). Null texts are empty."""
    texts = batch.column(column)
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    at = 0
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingles(data: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of each text, repeats included, and where each text's begin and end.

    A-Z count as a-z. Words are runs of bytes other than 0x20 and 0x09-0x0D. A text of fewer words than
    ``n`` but at least one has its whole sequence as its one shingle.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    edge = np.zeros(len(low) + 1, bool)
    edge[starts] = True
    opens = solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]]))
    closes = solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    words = mix(stretch_hashes(running_sums(low), a, b) + (b - a).astype(np.uint64))
    first = np.searchsorted(a, starts)
    count = np.diff(first)
    if n > len(PLACES):
        raise ValueError(f"at most {len(PLACES)} words make a shingle")
    total = len(words)
    grams = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n):
        grams += words[k : total - n + 1 + k] * PLACES[k]
    grams = mix(grams + np.uint64(n))
    doc_of = np.repeat(np.arange(len(count)), count)
    whole = np.flatnonzero(doc_of[: len(grams)] == doc_of[n - 1 : n - 1 + len(grams)]) if len(grams) else np.zeros(0, np.int64)
    grams, gram_doc = grams[whole], doc_of[whole]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            own[has] += words[first[short[has]] + k] * PLACES[k]
        own = mix(own + count[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = np.searchsorted(gram_doc, short)
        grams, gram_doc = np.insert(grams, at, own), np.insert(gram_doc, at, short)
    return grams, np.searchsorted(gram_doc, np.arange(len(count) + 1))
