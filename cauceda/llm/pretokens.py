"""Splitting texts into pre-tokens and turning those into ids, many texts at a time.

The split follows ``public_tokenizers.PATTERN`` over character classes held in arrays; any other pattern
goes through the ``regex`` library. Pre-tokens repeat, so each distinct one is encoded once and kept in a
memo of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import public_tokenizers
import regex

from cauceda.llm.hashing import ragged, same_spans, span_hashes

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Bytes that are split at once, and bytes in which a place to cut is looked for at once.
PART, WINDOW = 4 << 20, 1 << 16


@lru_cache(1)
def character_classes() -> np.ndarray:
    """The class of every code point."""
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    table = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            table[points[m.start()] : points[m.end() - 1] + 1] = kind
    return table


def split(data: np.ndarray, offsets: np.ndarray, pattern: str = public_tokenizers.PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which pre-tokens start (with the end of the data last), and each text's count."""
    if pattern != public_tokenizers.PATTERN:
        return _split_by(data, offsets, regex.compile(pattern))
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    kind = character_classes()[points]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[at]  # characters that begin a text
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after = np.flatnonzero(run & (kind != _SPACE) & ~first)
    after = after[kind[after - 1] == _SPACE]
    start[after - 1] = True
    start[after] = points[after - 1] != 32
    _contractions(points, start, first)
    bounds = np.append(at[start], len(data))
    counts = np.diff(np.searchsorted(bounds[:-1], offsets))
    return bounds, counts


def sure_splits(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places past ``low``, up to about ``high``, before which ``PATTERN`` ends a pre-token whatever is around: kinds of characters
    change there, and the character before is neither white space nor an apostrophe."""
    while low < high and data[low] & 0xC0 == 0x80:
        low += 1
    while high < len(data) and data[high] & 0xC0 == 0x80:
        high += 1
    points = np.frombuffer(data[low:high].tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = low + np.flatnonzero((data[low:high] & 0xC0) != 0x80)
    kind = character_classes()[points]
    return at[1:][(kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & (points[:-1] != 39)]


def cuts(data: np.ndarray, part: int) -> list[int]:
    """Places that cut one text into parts of about ``part`` bytes without cutting a pre-token. A longer pre-token stays whole."""
    out, start, step = [], 0, WINDOW - 8  # windows share two characters, so that no place falls between them
    while len(data) - start > part:
        end = start + part
        before = (sure_splits(data, max(start, high - WINDOW), high)[-1:] for high in range(end, start, -step))
        after = (sure_splits(data, low, min(low + WINDOW, len(data)))[:1] for low in range(max(start, end - 8), len(data), step))
        found = next((x for x in chain(before, after) if len(x)), None)
        if found is None:
            break
        start = int(found[0])
        out.append(start)
    return out


def _contractions(points: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """An apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll with it."""
    n = len(points)
    quote = np.flatnonzero((points == 39) & start)
    quote = quote[quote + 1 < n]
    quote = quote[~first[quote + 1]]
    padded = np.append(points, 0)
    one, two = padded[quote + 1], padded[quote + 2]
    alone = np.append(first, True)[quote + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    is_e, is_l = two == ord("e"), two == ord("l")
    long = ~alone & ((np.isin(one, [ord("r"), ord("v")]) & is_e) | ((one == ord("l")) & is_l))
    for chosen, length in ((quote[short], 2), (quote[long], 3)):
        start[chosen + 1] = False
        rest = chosen + length
        start[rest[rest < n]] = True


def _split_by(data: np.ndarray, offsets: np.ndarray, pattern) -> tuple[np.ndarray, np.ndarray]:
    """Any pattern whose matches cover the text."""
    bounds, counts, raw = [], [], data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at, n = a, 0
        for piece in pattern.findall(raw[a:b].decode("utf-8")):
            bounds.append(at)
            at += len(piece.encode("utf-8"))
            n += 1
        if at != b:
            raise ValueError("the pattern must cover every character")
        counts.append(n)
    return np.array([*bounds, len(data)], np.int64), np.array(counts, np.int64)


class Encoder:
    """Ids of texts. ``whole`` resolves pre-tokens, given as hashes, data, starts and lengths, to an id or -1; ``rest`` encodes
    distinct misses. Hashes only propose: bytes are compared wherever two pre-tokens are taken for one."""

    def __init__(self, rest: Callable[[list[bytes]], list[list[int]]], whole: Callable | None = None, pattern: str = public_tokenizers.PATTERN, memo: int = 500_000):
        self.rest, self.whole, self.pattern, self.most = rest, whole, pattern, memo
        self.memo: dict[bytes, bytes] = {}  # ids as packed 32-bit integers

    def encode(self, data: np.ndarray, offsets: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and each text's count. Texts longer than ``part`` bytes go in parts, so what is held beside texts
        and ids does not grow with them; a pattern of one's own has no known places to cut, so there they go whole."""
        if len(data) <= part or self.pattern != public_tokenizers.PATTERN:
            return self._encode(data, offsets)
        ids, counts = [], []
        at, last = 0, len(offsets) - 1
        while at < last:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + part, side="right")) - 1)
            some = data[offsets[at] : offsets[end]]
            if end > at + 1 or len(some) <= part:
                own, n = self._encode(some, offsets[at : end + 1] - offsets[at])
                counts.append(n)
            else:
                edges = [0, *cuts(some, part), len(some)]
                made = [self._encode(some[a:b], np.array([0, b - a], np.int64))[0] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                own = np.concatenate(made)
                counts.append(np.array([len(own)], np.int64))
            ids.append(own)
            at = end
        return np.concatenate(ids), np.concatenate(counts)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds, counts = split(data, offsets, self.pattern)
        starts, ends = bounds[:-1], bounds[1:]
        if not len(starts):
            return np.empty(0, np.uint32), counts
        hashes = span_hashes(data, starts, ends)
        ids = self.whole(hashes, data, starts, ends - starts) if self.whole else np.full(len(starts), -1, np.int64)
        missed = np.flatnonzero(ids < 0)
        lengths = np.ones(len(starts), np.int64)
        if len(missed):
            _, at, which = np.unique(hashes[missed], return_index=True, return_inverse=True)
            raw, at, spans = data.tobytes(), missed[at], ends - starts
            apart = (spans[missed] != spans[at][which]) | ~same_spans(data, starts[missed], data, starts[at][which], np.minimum(spans[missed], spans[at][which]))
            other = np.flatnonzero(apart)  # of one hash but not of one text: each on its own
            which[other] = len(at) + np.arange(len(other))
            at = np.append(at, missed[other])
            found = self._lookup([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            flat = np.frombuffer(b"".join(found), np.uint32)
            begins = np.cumsum(sizes) - sizes
            lengths[missed] = sizes[which]
        begin = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        hit = ids >= 0
        out[begin[hit]] = ids[hit]
        if len(missed):
            out[ragged(begin[missed], lengths[missed])] = flat[ragged(begins[which], sizes[which])]
        sums = np.append(0, np.cumsum(lengths))
        edges = np.append(0, np.cumsum(counts))
        return out, np.diff(sums[edges])

    def _lookup(self, pieces: list[bytes]) -> list[bytes]:
        memo = self.memo
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > self.most:
            memo.clear()
            new = pieces
        memo.update(zip(new, (pack(f"={len(x)}I", *x) for x in self.rest(new)), strict=True))
        return [memo[p] for p in pieces]
