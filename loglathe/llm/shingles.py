"""Five-word shingle sets of whole texts as sorted 64-bit hashes, vectorised over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed together.
STRIDE = 1 << 20

_random = np.random.Generator(np.random.PCG64(20250101))
_BYTE = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_STEP = int(_random.integers(0, 1 << 62)) * 2 + 1
_PLACE = _random.integers(0, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _random.integers(0, 1 << 63, WIDTH + 1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the constants are those of the 64-bit MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(64, 2 * n), _STEP, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers


def _words(raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts raw[cuts[i]:cuts[i + 1]], and how many each text has."""
    solid = ~_SPACE[raw]
    edge = np.empty(len(raw), bool)
    edge[:1] = True
    edge[1:] = ~solid[:-1]
    edge[cuts[:-1][cuts[:-1] < len(raw)]] = True
    starts = np.flatnonzero(solid & edge)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(cuts) - 1, np.int64)
    at = np.flatnonzero(solid)
    # each solid byte's word, and its place there
    word = np.cumsum(edge[at] & solid[at]) - 1
    place = at - starts[word]
    value = _BYTE[raw[at]] * _power(int(place.max()) + 1)[place]
    first = np.searchsorted(at, starts)
    sums = np.add.reduceat(value, first)
    return mix(sums), np.diff(np.searchsorted(starts, cuts))


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingle set of each text, sorted; a null text has the empty set."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STRIDE, "right")) - 1)
        last = min(last, len(texts))
        base = offsets[first]
        words, counts = _words(data[base : offsets[last]], offsets[first : last + 1] - base)
        total = np.zeros(max(0, len(words) - WIDTH + 1), np.uint64)
        for k in range(WIDTH if len(total) else 0):
            total += words[k : k + len(total)] * _PLACE[k]
        total = mix(total)
        ends = np.cumsum(counts)
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            if n >= WIDTH:
                got = total[end - n : end - WIDTH + 1].copy()
                got.sort()
                if n > WIDTH:
                    got = got[np.r_[True, got[1:] != got[:-1]]]
                yield got
            elif n:
                yield mix((words[end - n : end] * _PLACE[:n]).sum(keepdims=True) + _SHORT[n])
            else:
                yield np.empty(0, np.uint64)
        first = last


def set_id(shingles: np.ndarray) -> int:
    """One 64-bit name of a set, signed."""
    total = int(mix(shingles ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)) + len(shingles) * int(_PLACE[0])
    return int(mix(np.array([total & ((1 << 64) - 1)], np.uint64)).view(np.int64)[0])
