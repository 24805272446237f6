"""Hashed word shingles of texts, many texts at a time."""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every bit of the result depends on every bit of ``h``."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Hasher:
    """64-bit hashes of the words of UTF-8 texts, A-Z lower-cased: polynomials of random byte values, so that one running sum serves all words."""

    def __init__(self) -> None:
        values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
        values[65:91] = values[97:123]
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        values[self.space] = 0
        self.values = values
        self._grow(_PIECE + 4096)

    def _grow(self, n: int) -> None:
        power = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))])
        self.powers, self.inverse = power(_BASE), power(pow(_BASE, -1, 1 << 64))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start offsets of the words of ``data``."""
        if len(data) > _PIECE:  # cut before a space, in pieces of bounded memory
            out, at = [], 0
            while at < len(data):
                to = min(len(data), at + _PIECE)
                while to < len(data) and data[to] not in b" \t\n\v\f\r":
                    to += 1
                h, s = self._words(data[at:to])
                out.append((h, s + at))
                at = to
            return np.concatenate([h for h, _ in out]), np.concatenate([s for _, s in out])
        return self._words(data)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        a = np.frombuffer(data, np.uint8)
        if len(a) > len(self.powers):
            self._grow(len(a))
        gap = np.concatenate([[True], self.space[a], [True]])
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = turn[::2], turn[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[a] * self.powers[: len(a)])])
        return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)), starts

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Word hashes of each text, computed over groups of texts together."""
        out: list[np.ndarray] = []
        group: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                h, s = self.words(b" ".join(group))
                ends = np.cumsum([len(t) + 1 for t in group])
                out.extend(np.split(h, np.searchsorted(s, ends[:-1])))
            group, held = [], 0

        for t in texts:
            if held + len(t) >= _PIECE - len(group):
                flush()
            group.append(t)
            held += len(t) + 1
        flush()
        return out


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; of fewer words the whole sequence is the one shingle; of none, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _U(0xD6E8FEB86659FD93) + words[i : len(words) - n + 1 + i]
    return np.unique(mix(h))
