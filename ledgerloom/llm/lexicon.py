"""Numbers for the distinct words of many texts, found a buffer at a time with numpy.

Words are places in a byte buffer. Their hashes come from one running sum over the buffer, an
open-addressed table turns hashes into numbers, and the bytes are compared afterwards, so equal
numbers always mean equal words.
"""

from __future__ import annotations

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_SEED = np.random.default_rng(2718281828).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``P ** i`` and ``P ** -i`` modulo 2**64, for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(16, n.bit_length())
        _POWERS[:] = [
            np.concatenate((np.ones(1, np.uint64), np.full(size, base, np.uint64).cumprod(dtype=np.uint64)))
            for base in (_P, pow(_P, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all elements of the runs ``starts[k] .. starts[k] + sizes[k]``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - ends + sizes, sizes)


class Lexicon:
    """Grows by the words it has not seen; ``new`` is the first number since the last ``mark``."""

    def __init__(self, slots: int = 1 << 16):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes = np.zeros(0, np.uint64)
        self.bytes, self.starts, self.sizes = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.hashes)

    def words(self, first: int = 0) -> list[bytes]:
        """The words from number ``first`` on."""
        if first >= len(self):
            return []
        base = int(self.starts[first])
        data = self.bytes[base:].tobytes()
        return [data[a:a + n] for a, n in zip((self.starts[first:] - base).tolist(), self.sizes[first:].tolist())]

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, or -1."""
        found = np.full(len(hashes), -1, np.int64)
        left, at = np.arange(len(hashes)), self._place(hashes)
        while len(left):
            held = self.slots[at]
            used = held >= 0
            same = used.copy()
            same[used] = self.hashes[held[used]] == hashes[left[used]]
            found[left[same]] = held[same]
            go = used & ~same
            left, at = left[go], (at[go] + 1) & (len(self.slots) - 1)
        return found

    def _insert(self, numbers: np.ndarray) -> None:
        left, at = numbers, self._place(self.hashes[numbers])
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _append(self, buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        self.starts = np.concatenate((self.starts, len(self.bytes) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.hashes = np.concatenate((self.hashes, hashes))
        self.bytes = np.concatenate((self.bytes, buffer[flat(starts, sizes)]))

    def index(self, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word ``buffer[starts[k]:ends[k]]``; unknown words get new ones."""
        sizes = ends - starts
        up, down = _powers(len(buffer))
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_SEED[buffer] * up[:len(buffer)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
        found = self._find(hashes)
        if (found < 0).any():
            missing = np.flatnonzero(found < 0)
            first = np.unique(hashes[missing], return_index=True)[1]
            first = missing[np.sort(first)]
            before = len(self)
            self._append(buffer, starts[first], sizes[first], hashes[first])
            if 2 * len(self) > len(self.slots):
                self.slots = np.full(4 << len(self).bit_length(), -1, np.int64)
                self._insert(np.arange(len(self)))
            else:
                self._insert(np.arange(before, len(self)))
            found[missing] = self._find(hashes[missing])
        # Words of one hash and other bytes: each occurrence gets a number of its own.
        odd = sizes != self.sizes[found]
        same = np.flatnonzero(~odd)
        places = flat(starts[same], sizes[same])
        differ = buffer[places] != self.bytes[flat(self.starts[found[same]], sizes[same])]
        if differ.any():
            odd[same[np.searchsorted(np.cumsum(sizes[same]), np.flatnonzero(differ), side="right")]] = True
        if odd.any():
            k = np.flatnonzero(odd)
            before = len(self)
            self._append(buffer, starts[k], sizes[k], hashes[k])
            found[k] = np.arange(before, len(self))
        return found


_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, a line break after each, and the place after each line break."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
    return buffer, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)


def word_places(buffer: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are no gap; the buffer ends in a gap."""
    inside = np.concatenate(([False], ~gap[buffer])).view(np.int8)
    edges = np.flatnonzero(np.diff(inside))
    # The buffer's last byte is a gap, so starts and ends alternate and come in pairs.
    return edges[::2], edges[1::2]
