"""Words of many texts at once: their places in the UTF-8 bytes and 64-bit hashes, by numpy."""

from __future__ import annotations

import numpy as np

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers.get("base", ())) < n:
        size = max(n, 1 << 16)
        for name, x in (("base", _BASE), ("inverse", _INVERSE)):
            step = np.full(size, x, np.uint64)
            step[0] = 1
            _powers[name] = np.cumprod(step)
    return _powers["base"][:n], _powers["inverse"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by a line feed; start, end and hash of each word in it; and the number of words before each text, with the total at the end."""
    joined = b"\n".join(texts)
    buf = np.frombuffer(joined, np.uint8)
    edges = np.zeros(len(buf) + 2, bool)
    edges[1:-1] = ~_IS_SPACE[buf]
    turns = np.flatnonzero(edges[1:] != edges[:-1])
    starts, ends = turns[::2], turns[1::2]
    base, inverse = _upto(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * base[:-1], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return joined, starts, ends, hashes, np.searchsorted(starts, begins)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, from each place on; of the whole where there are fewer."""
    n = min(n, len(hashes))
    if not n:
        return hashes[:0]
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k])
    return out
