r"""Words ``[^\x20\x09-\x0D]+`` of many texts at once, and hashes of runs of words."""

from __future__ import annotations

import numpy as np

from cauceda.llm.hashing import _ODD, constants, mix, span_hashes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = constants(128, 2).reshape(2, 64)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the data, and each text's number of words."""
    n = len(data)
    held = np.zeros(n + 2, bool)
    held[1:-1] = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    now = held[1:]
    starts = np.flatnonzero(now & (~held[:-1] | edge))
    ends = np.flatnonzero(held[:-1] & (~now | edge))
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """64-bit hashes of the words; ``lower`` reads A-Z as a-z; ``second`` takes another seed."""
    return span_hashes(_LOWER[data] if lower else data, starts, ends, int(second))


def run_hashes(hashes: np.ndarray, length: int, second: bool = False) -> np.ndarray:
    """Hashes of all runs of ``length`` hashes; run i starts at hash i. Runs may cross texts: see ``inside``.

    A run is made of two that are up to half as long, which may overlap; the right one is mixed before it is added,
    so that no sum of places cancels. ``second`` gives other hashes of the same runs.
    """
    out, have, steps = hashes, 1, _STEPS[int(second)]
    if len(out) < length:
        return np.empty(0, np.uint64)
    for step_constant in steps:
        if have == length:
            break
        step = min(have, length - have)
        out = out[: len(out) - step] * _ODD + mix(out[step:] ^ step_constant)
        have += step
    return mix(out)


def inside(counts: np.ndarray, length: int) -> np.ndarray:
    """For every word, whether a run of ``length`` words that starts there stays in its text."""
    ends = np.repeat(np.cumsum(counts), counts)
    return np.arange(len(ends)) + length <= ends
