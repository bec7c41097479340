"""Word shingles as 64-bit hashes, computed over whole texts by array operations."""

from __future__ import annotations

import numpy as np
import xxhash

_M = (1 << 64) - 1
#: A byte's value in the hash of a word: A-Z count as a-z. Bytes that end words: the space and U+0009 to U+000D.
_VALUE = np.array([xxhash.xxh3_64_intdigest(bytes([b + 32 if 65 <= b <= 90 else b]), seed=11) | 1 for b in range(256)], np.uint64)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = xxhash.xxh3_64_intdigest(b"base", seed=11) & ~7 | 5
#: Texts are hashed in pieces of about this many bytes, cut between words.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest piece has needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)]), dtype=np.uint64)


_POWERS = _Powers()
_ODD = [np.uint64(xxhash.xxh3_64_intdigest(j.to_bytes(8, "little"), seed=77) | 1) for j in range(64)]


def words(text: str) -> list[bytes]:
    """Maximal runs of anything but space and U+0009 to U+000D, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _piece(x: np.ndarray) -> np.ndarray:
    edge = np.ones(len(x) + 2, bool)
    edge[1:-1] = _SPACE[x]
    change = np.flatnonzero(edge[1:] != edge[:-1])
    first, last = change[0::2], change[1::2]
    _POWERS.reach(len(x) + 1)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_VALUE[x] * _POWERS.up[: len(x)], out=sums[1:])
    return mix((sums[last] - sums[first]) * _POWERS.down[first])


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of UTF-8 bytes: a polynomial over its bytes, by sums over the piece that it stands in."""
    x = np.frombuffer(data, np.uint8)
    if len(x) <= 2 * PIECE:
        return _piece(x)
    ends = np.flatnonzero(_SPACE[x])
    out, at = [], 0
    while at < len(x):
        k = np.searchsorted(ends, at + PIECE)
        end = int(ends[k]) + 1 if k < len(ends) else len(x)
        out.append(_piece(x[at:end]))
        at = end
    return np.concatenate(out)


def hashes(data: bytes | str, size: int) -> np.ndarray:
    """Of each run of `size` words in order; with fewer words, of the whole sequence; without words, none."""
    one = word_hashes(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data)
    if not len(one):
        return one
    k = min(size, len(one))
    n = len(one) - k + 1
    total = np.full(n, np.uint64(k * int(_ODD[-1]) & _M), np.uint64)
    for j in range(k):
        total += one[j : j + n] * _ODD[j]
    return mix(total)
