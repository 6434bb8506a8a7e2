"""SHA-256 of many rows at once in numpy, by its states between blocks, which can be kept and resumed.

A state is eight 32-bit words, a row of an array; hexadecimal digests are 64 bytes, which is one block of SHA-256, so
that the state after any number of digests needs no rest of a block beside it.
"""

from __future__ import annotations

from math import isqrt

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(x: int) -> int:
    """The floor of the cube root."""
    low, high = 0, 1 << -(-x.bit_length() // 3)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if middle**3 <= x else (low, middle - 1)
    return low


#: The first 32 bits of the fractions of square roots of 8 primes, and of cube roots of 64, as FIPS 180-4 defines them.
START = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], np.uint32)
_ROUNDS = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], np.uint32)
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
DIGEST = 32


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def start(n: int) -> np.ndarray:
    """The state before any block, n times."""
    return np.repeat(START[None], n, axis=0)


def after_block(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The states (n, 8) after one block each; blocks: (n, 64) bytes."""
    w = list(np.ascontiguousarray(blocks).view(">u4").astype(np.uint32).T.copy())
    a, b, c, d, e, f, g, h = states.T.copy()
    for i in range(64):
        if i >= 16:
            x, y = w[i - 15], w[i - 2]
            w.append(w[i - 16] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _ROUNDS[i] + w[i]
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return states + np.stack([a, b, c, d, e, f, g, h], axis=1)


def after_digest(states: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The states after one digest each in hexadecimal; digests: (n, 32) bytes."""
    blocks = np.empty((len(digests), 64), np.uint8)
    blocks[:, 0::2] = _HEX[digests >> 4]
    blocks[:, 1::2] = _HEX[digests & 15]
    return after_block(states, blocks)


def finish(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests (n, 32) of messages of so many whole blocks."""
    last = np.zeros((len(states), 64), np.uint8)
    last[:, 0] = 0x80
    last[:, 56:] = (blocks.astype(np.uint64) * np.uint64(512)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return after_block(states, last).astype(">u4").view(np.uint8).reshape(-1, DIGEST)
