"""Words of a text and hashes of word windows, a block of numpy work per text."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_ONE = np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(14, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


@cache
def _power(step: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(step), n, 1 << 64))


_SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
_FACTORS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit hashes (the splitmix finaliser)."""
    x = x ^ (x >> _SHIFTS[0])
    x *= _FACTORS[0]
    x ^= x >> _SHIFTS[1]
    x *= _FACTORS[1]
    x ^= x >> _SHIFTS[2]
    return x


class Words:
    """The words of a text, A-Z lower-cased: byte places, and a hash of each.

    Words are runs of bytes other than the six ASCII white-space characters.
    """

    __slots__ = ("data", "starts", "ends", "hashes")

    def __init__(self, text: str | None):
        self.data = (text or "").encode("utf-8", "surrogatepass").lower()
        raw = np.frombuffer(self.data, np.uint8)
        word = np.zeros(len(raw) + 2, bool)
        np.logical_not(_SPACE[raw], out=word[1:-1])
        turns = np.flatnonzero(word[1:] != word[:-1])
        self.starts, self.ends = turns[::2].copy(), turns[1::2].copy()
        up, down = _grown(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        own = sums[1:]
        np.add(raw, _ONE, out=own)
        own *= up[: len(raw)]
        np.cumsum(own, out=own)
        hashes = sums[self.ends]
        hashes -= sums[self.starts]
        hashes *= down[self.starts]
        self.hashes = mixed(hashes)

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of every window of ``k`` words; two salts give unrelated hashes.
        Windows are doubled, and grown by one word where ``k`` has a binary one."""
        if len(self) < k:
            return np.zeros(0, np.uint64)
        out, size, step = self.hashes, 1, _STEP[salt]
        for bit in bin(k)[3:]:
            one = out[:-size] * _power(step, size)
            one += out[size:]
            out, size = one, 2 * size
            if bit == "1":
                one = out[:-1] * step
                one += self.hashes[size:]
                out, size = one, size + 1
        return mixed(out)

    def spans(self, first: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hash of the words from each ``first`` to before its ``end``; two salts
        give unrelated hashes."""
        up, down = _grown(len(self) + 1)
        own = mixed(self.hashes + _STEP[1]) if salt else self.hashes
        sums = np.zeros(len(self) + 1, np.uint64)
        np.cumsum(own * up[: len(self)], out=sums[1:])
        out = sums[end]
        out -= sums[first]
        out *= down[first]
        out += (end - first).view(np.uint64)
        return mixed(out)

    def window(self, i: int, k: int) -> bytes:
        return b" ".join(self.data[s:e] for s, e in zip(self.starts[i : i + k].tolist(), self.ends[i : i + k].tolist(), strict=True))

    def window_set(self, k: int) -> set[bytes]:
        """The distinct windows themselves; fewer words are one window."""
        if 0 < len(self) < k:
            k = len(self)
        return {self.window(i, k) for i in range(len(self) - k + 1)} if len(self) else set()

    def code_points(self) -> np.ndarray:
        """Code points before every byte, and in all."""
        raw = np.frombuffer(self.data, np.uint8)
        out = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
        return out
