"""Hashes of many byte spans at once, in numpy: eight bytes at a time, each step mixed before the next."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD1342543DE82EF95)
#: The bytes of a word of eight that lie before place 0 to 8.
_BEFORE = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one by ``blake2b``.
LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    at = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
    return mix(at * _MULTIPLIER)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place of ``data`` as one integer; zeros follow its end."""
    held = np.zeros(len(data) + 8, np.uint8)
    held[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", held.data, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal bytes have equal hashes wherever they stand."""
    eights, lengths = _eights(data), ends - starts
    out = mix((lengths.astype(np.uint64) + np.uint64(seed << 40)) * _MULTIPLIER)
    out = mix(out ^ (eights[starts] & _BEFORE[np.minimum(lengths, 8)]))
    more, at = np.flatnonzero((lengths > 8) & (lengths <= LONG)), 8
    while len(more):
        now = eights[starts[more] + at] & _BEFORE[np.minimum(lengths[more] - at, 8)]
        out[more] = mix(out[more] * _ODD ^ now)
        at += 8
        more = more[lengths[more] > at]
    for i in np.flatnonzero(lengths > LONG).tolist():
        out[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8)).digest())
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, other: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the ``lengths`` bytes at ``starts`` of ``data`` are those at ``others`` of ``other``."""
    left, right = _eights(data), _eights(other)
    out, more, at = np.ones(len(starts), bool), np.arange(len(starts)), 0
    while len(more := more[out[more] & (lengths[more] > at)]):
        apart = left[starts[more] + at] ^ right[others[more] + at]
        out[more] = apart & _BEFORE[np.minimum(lengths[more] - at, 8)] == 0
        at += 8
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every span, end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)
