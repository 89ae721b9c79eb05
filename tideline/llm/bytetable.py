"""Numbers of byte strings that lie in one buffer, looked up all at once.

A string of up to ``LONGEST`` bytes is told by two 64-bit sums of its bytes, each weighted by random numbers of its place, which
stand for it: 128 bits in all. Sums and look-ups are numpy operations over the whole buffer; only strings met for the first
time are cut out one by one. Longer strings are new each time. No string is kept unless the caller keeps it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LONGEST = 64
_WEIGHTS = np.random.default_rng(20).integers(0, 1 << 64, (2, LONGEST), np.uint64, endpoint=False) | np.uint64(1)


def sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two sums for each of the strings, which lie one after the other, with gaps or without; none is empty."""
    total = int(sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(firsts, sizes)
    values = data[place + np.repeat(starts, sizes)].astype(np.uint64) + np.uint64(1)
    np.minimum(place, LONGEST - 1, out=place)
    return np.stack([np.add.reduceat(weights[place] * values, firsts) for weights in _WEIGHTS]) if total else np.zeros((2, 0), np.uint64)


class ByteTable:
    """From strings to numbers, in order of their first time; ``new`` is called with the strings that get the next numbers."""

    def __init__(self, new: Callable[[list[bytes]], None], slots: int = 1 << 20):
        self.new, self.first_slots = new, slots
        self.clear()

    def clear(self) -> None:
        self.count, self.slots = 0, self.first_slots
        self.keys, self.held = np.zeros((self.slots, 2), np.uint64), np.full(self.slots, -1, np.int32)

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The numbers of the strings, none of them empty."""
        keys = sums(data, starts, sizes)
        found = self._find(keys)
        found[sizes > LONGEST] = -1
        missing = np.flatnonzero((found < 0) & (sizes <= LONGEST))
        added: list[np.ndarray] = []
        while len(missing):
            _, first = np.unique(keys[0, missing], return_index=True)
            chosen = missing[np.sort(first)]
            self._insert(keys[:, chosen])
            added.append(chosen)
            found[missing] = self._find(keys[:, missing])
            missing = missing[found[missing] < 0]
        long = np.flatnonzero(sizes > LONGEST)
        found[long] = self.count + np.arange(len(long))
        self.count += len(long)
        added.append(long)
        rows = np.concatenate(added)
        if len(rows):
            raw = data.tobytes()
            self.new([raw[s : s + n] for s, n in zip(starts[rows].tolist(), sizes[rows].tolist())])
        return found.astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape[1], -1, np.int32)
        rows, slot = np.arange(keys.shape[1]), (keys[0] >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(rows):
            held = self.held[slot]
            own = self.keys[slot]
            hit = (held >= 0) & (own[:, 0] == keys[0, rows]) & (own[:, 1] == keys[1, rows])
            out[rows[hit]] = held[hit]
            on = (held >= 0) & ~hit
            rows, slot = rows[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, keys: np.ndarray) -> None:
        """Keys that are not there, each once, get the next numbers."""
        numbers = np.arange(self.count, self.count + keys.shape[1], dtype=np.int32)
        if 2 * (self.count + len(numbers)) > self.slots:
            used = np.flatnonzero(self.held >= 0)
            old, held = self.keys[used].T, self.held[used]
            while 2 * (self.count + len(numbers)) > self.slots:
                self.slots *= 2
            self.keys, self.held = np.zeros((self.slots, 2), np.uint64), np.full(self.slots, -1, np.int32)
            self._place(old, held)
        self._place(keys, numbers)
        self.count += len(numbers)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        rows, slot = np.arange(keys.shape[1]), (keys[0] >> np.uint64(20)).astype(np.int64) & (self.slots - 1)
        while len(rows):
            free = np.flatnonzero(self.held[slot] < 0)
            # Of keys that want one slot the last written has it; the others go on.
            self.held[slot[free]] = numbers[rows[free]]
            mine = self.held[slot] == numbers[rows]
            self.keys[slot[mine]] = keys[:, rows[mine]].T
            rows, slot = rows[~mine], (slot[~mine] + 1) & (self.slots - 1)
