"""Units of texts (words, or what a tokenizer's cuts leave of them) remembered in arrays, a whole slice of texts at a time.

Texts repeat their units, so what is costly to find for a unit is found once and remembered by the unit's
bytes: a bounded hash table over numpy arrays, which starts anew when it is full. Units of more than
``UNIT_BYTES`` bytes are not remembered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from tidewatch.llm.common import mix64

UNIT_BYTES = 24


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and where each text begins, with the end; null is the empty text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``counts`` of them, one range after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def unit_keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What identifies each unit of at most UNIT_BYTES bytes: its bytes as three words, and its length."""
    padded = np.concatenate([raw, np.zeros(UNIT_BYTES, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(raw) + UNIT_BYTES - 7,), (1,))
    keys = np.empty((len(starts), 4), np.uint64)
    for k in range(3):
        keep = np.clip(lengths - 8 * k, 0, 8).astype(np.uint64) * np.uint64(8)
        mask = np.where(keep == 64, np.uint64(2**64 - 1), (np.uint64(1) << keep) - np.uint64(1))
        keys[:, k] = words[starts + 8 * k] & mask
    keys[:, 3] = lengths
    return keys


class UnitTable:
    """Entry numbers of units, counted from 0 in the order in which they were entered."""

    def __init__(self, size: int):
        self.size, self.n = size, 0
        self.bits = max(10, (2 * size - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.empty((size, 4), np.uint64)

    def clear(self) -> None:
        self.n = 0
        self.slots.fill(-1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = mix64(keys[:, 0] + np.uint64(0x9E3779B97F4A7C15) * keys[:, 3])
        h = mix64(h ^ keys[:, 1])
        return (mix64(h + keys[:, 2]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each row of keys, -1 if there is none."""
        out = np.full(len(keys), -1, np.int64)
        left, slot, last = np.arange(len(keys)), self._slot(keys), len(self.slots) - 1
        while len(left):
            e = self.slots[slot]
            some = e >= 0
            left, slot, e = left[some], slot[some], e[some]
            there, own = np.take(self.keys, e, axis=0), np.take(keys, left, axis=0)
            same = there[:, 0] == own[:, 0]
            for k in (1, 2, 3):
                same &= there[:, k] == own[:, k]
            out[left[same]] = e[same]
            left, slot = left[~same], (slot[~same] + 1) & last
        return out

    def _enter(self, keys: np.ndarray) -> None:
        new = np.arange(self.n, self.n + len(keys))
        self.keys[new] = keys
        self.n += len(new)
        slot, last = self._slot(keys), len(self.slots) - 1
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            left = self.slots[slot] != new
            new, slot = new[left], (slot[left] + 1) & last

    def look_up(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, learn: Callable[[list[bytes]], None], forget: Callable[[], None]) -> np.ndarray:
        """The entry of each unit. ``learn`` is told the units that get the next numbers, ``forget`` that none has a number any more."""
        keys = unit_keys(raw, starts, lengths)
        found = self.find(keys)
        new = np.flatnonzero(found < 0)
        if self.n + len(new) > self.size:
            forget()
            if len(starts) > self.size:
                self.__init__(len(starts))
            self.clear()
            new = np.arange(len(starts))
        if len(new):  # each distinct one once
            order = new[np.lexsort(keys[new].T)]
            first = np.ones(len(order), bool)
            first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
            distinct, base, whole = order[first], self.n, raw.tobytes()
            learn([whole[a : a + n] for a, n in zip(starts[distinct].tolist(), lengths[distinct].tolist(), strict=True)])
            self._enter(keys[distinct])
            found[order] = base + np.cumsum(first) - 1
        return found


class Rows:
    """Growing arrays of one length, by name."""

    def __init__(self, **kinds: type):
        self.n, self.arrays = 0, {k: np.empty(1_024, v) for k, v in kinds.items()}

    def lay(self, **values: np.ndarray) -> None:
        """Values behind those in use, which do not count yet."""
        for name, v in values.items():
            a = self.arrays[name]
            if self.n + len(v) > len(a):
                a = self.arrays[name] = np.concatenate([a[: self.n], np.empty(max(len(v), self.n), a.dtype)])
            a[self.n : self.n + len(v)] = v

    def add(self, **values: np.ndarray) -> None:
        self.lay(**values)
        self.n += len(next(iter(values.values())))

    def __getitem__(self, name: str) -> np.ndarray:
        return self.arrays[name]

    def clear(self) -> None:
        self.n = 0
