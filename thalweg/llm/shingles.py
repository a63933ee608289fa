"""Word hashes and shingle sets of whole texts, vectorised over the bytes."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i below n or more."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (BASE, inverse))
        _powers.clear()
        _powers[size] = up, down
    return _powers[size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of (byte + 1) * BASE ** position; entry i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _word_hashes(data: np.ndarray) -> np.ndarray:
    solid = ~SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = prefix_hash(data)
    return mixed((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words (runs without white space), in pieces of bounded size."""
    if len(data) <= PIECE:
        return _word_hashes(np.frombuffer(data, np.uint8))
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not SPACE[data[end]]:
            end += 1
        out.append(_word_hashes(np.frombuffer(data, np.uint8, end - at, at)))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes (signed) of the shingles; fewer words than width make one shingle, none none."""
    if not len(words):
        return np.zeros(0, np.int64)
    n = min(width, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mixed(h * BASE + words[k : len(words) - n + 1 + k])
    return np.unique(h.view(np.int64))


def shingle_set(text: str | None, width: int) -> set:
    """The shingles themselves, for exact checks."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(width))))
