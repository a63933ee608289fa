"""FTRL-proximal logistic regression over hashed features, and the hashed features of texts."""

from __future__ import annotations

import numpy as np

from .shingles import BASE, PIECE, SPACE, mixed, powers, prefix_hash

#: Anything but ASCII letters, digits and bytes of other scripts ends a word.
MARKS = np.ones(256, bool)
MARKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def tokens(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of bytes outside ends, and a code of its last three bytes; long texts in pieces."""
    hashes, tails, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and not ends[data[end]]:
            end += 1
        part = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ~ends[part], [False]]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        sums = prefix_hash(part)
        hashes.append(mixed((sums[last] - sums[first]) * powers(len(part) + 1)[1][first] + (last - first).astype(np.uint64)))
        wide = part.astype(np.uint64)
        tail = wide[last - 1]
        for k in (2, 3):
            tail = tail * np.uint64(256) + np.where(last - k >= first, wide[np.maximum(last - k, 0)], 0)
        tails.append(tail)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(hashes), np.concatenate(tails)


def slots(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Slot of each hash; every part is salted by its place in the list."""
    salted = [mixed(p + np.uint64((k + 1) * int(BASE) % (1 << 64))) for k, p in enumerate(parts)]
    return (np.concatenate(salted) >> np.uint64(64 - bits)).astype(np.int32) if salted else np.zeros(0, np.int32)


def grams(words: np.ndarray, skips: int) -> list[np.ndarray]:
    """Single words, pairs of neighbours, and pairs with 1..skips words between."""
    out = [words]
    for gap in range(1, skips + 2):
        out.append(mixed(words[:-gap] * BASE + words[gap:]) if len(words) > gap else np.zeros(0, np.uint64))
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate learning rates; L1 leaves most weights at exactly zero. The bias is free of L1."""

    def __init__(self, bits: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == len(self.z) - 1, 0.0, self.l1)
        w = -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def fit(self, rows: list[np.ndarray], labels: np.ndarray, epochs: int, seed: int = 1, scale: np.ndarray | None = None) -> Ftrl:
        bias = len(self.z) - 1
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                at = np.append(rows[k], bias)
                w = self.weights(at)
                g = (float(sigmoid(w.sum())) - labels[k]) * (1.0 if scale is None else scale[k])
                n = self.n[at]
                self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[at] = n + g * g
        return self

    def step(self, g: np.ndarray) -> Ftrl:
        """One update by a summed gradient, for all slots and the bias; it counts as one row's, so no weight moves far."""
        at = np.flatnonzero(g)
        w, n, g = self.weights(at), self.n[at], g[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        return self

    def compact(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(slots, weights, bias) of the weights that are not zero."""
        w = self.weights(np.arange(len(self.z)))
        at = np.flatnonzero(w[:-1])
        return at.astype(np.int32), w[at].astype(np.float32), float(w[-1])


class Sparse:
    """A compact model as a dense table, made where it is used."""

    def __init__(self, bits: int, at: np.ndarray, w: np.ndarray, bias: float):
        self.table, self.bias = np.zeros(1 << bits, np.float32), bias
        self.table[at] = w

    def margin(self, found: np.ndarray) -> float:
        hit = found[self.table[found] != 0]
        return float(self.table[np.unique(hit)].sum(dtype=np.float64)) + self.bias if len(hit) else self.bias


__all__ = ["Ftrl", "MARKS", "SPACE", "Sparse", "grams", "sigmoid", "slots", "tokens"]
