"""Numpy kernels over the UTF-8 bytes of many texts at once: words, their 64-bit hashes, hashes of word runs.

All of them take whole texts. They run inside Spark's Python workers, on a bounded chunk of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
MASK64 = (1 << 64) - 1
#: Bytes that are hashed at once.
SLAB = 1 << 18

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at white space, and of words made of letters, digits and whatever is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LETTERS = ALNUM.copy()
LETTERS[48:58] = False


def chunks(sizes: Sequence[int | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes, from the texts' sizes; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + (n or 0) > limit:
            yield begin, i
            begin, held = i, 0
        held += n or 0
    if begin < len(sizes):
        yield begin, len(sizes)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(SLAB, BASE, np.uint64), np.full(SLAB, BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Sweep:
    """The words of some texts.

    data: all bytes, lower-cased in ASCII, texts parted by a blank. start, end: byte ranges of words. first: index of
    each text's first word, and the number of words last.
    """

    def __init__(self, texts: Sequence[str | bytes | None], word_bytes: np.ndarray):
        raw = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
        inside = word_bytes[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        self.n_bytes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.offset = 1 + np.concatenate(([0], np.cumsum(self.n_bytes + 1)))
        self.first = np.searchsorted(self.start, self.offset)

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def words(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """For each word the text it is in."""
        return np.repeat(np.arange(len(self)), self.words)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of its bytes, from sums up to its end and its start, slab by slab."""
        up, down = _powers()
        upto_end, upto_start, inverse = (np.zeros(len(self.start), np.uint64) for _ in range(3))
        total, power, power_inverse = 0, 1, 1  # the sum before the slab, and the powers of the base and its inverse there
        for lo in range(0, len(self.data), SLAB):
            hi = min(lo + SLAB, len(self.data))
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=sums[1:])
            sums = sums * np.uint64(power) + np.uint64(total)
            i, j = np.searchsorted(self.end, (lo, hi))
            upto_end[i:j] = sums[self.end[i:j] - lo]
            i, j = np.searchsorted(self.start, (lo, hi))
            upto_start[i:j] = sums[self.start[i:j] - lo]
            inverse[i:j] = down[self.start[i:j] - lo] * np.uint64(power_inverse)
            total = int(sums[-1])
            power, power_inverse = power * pow(BASE, SLAB, 1 << 64) & MASK64, power_inverse * pow(BASE_INVERSE, SLAB, 1 << 64) & MASK64
        return mix((upto_end - upto_start) * inverse + (self.end - self.start).astype(np.uint64))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every `k` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(BASE) + words[j : j + n]
    return mix(out)
