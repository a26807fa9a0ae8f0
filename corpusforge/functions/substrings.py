"""Which of many strings stand in texts, letter for letter.

Texts are one array of bytes. At each place the next eight bytes, or as many as a shorter
string has, are one number, which is looked up among the first numbers of the strings;
where it is one, the string's last eight bytes and then all of them are compared. Strings
may overlap and hold one another; all are found. UTF-8 has no letter within another, so
bytes that are equal are letters that are equal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Places that are looked up at once.
PLACES = 1 << 17
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Substrings:
    """Strings, each given once, to be looked for together."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.length = np.array([len(s) for s in strings], np.int64)
        self.last = np.array([int.from_bytes(s[-8:], "little") for s in strings], np.uint64)
        self.groups = []
        width = np.minimum(self.length, 8)
        for w in np.unique(width[width > 0]):
            some = np.flatnonzero(width == w)
            key = np.array([int.from_bytes(strings[i][:w], "little") for i in some], np.uint64)
            order = np.argsort(key, kind="stable")
            keys, first, count = np.unique(key[order], return_index=True, return_counts=True)
            known = np.zeros(1 << 16, bool)
            known[(keys * _MIX) >> np.uint64(48)] = True
            self.groups.append((np.uint64((1 << (8 * int(w))) - 1), known, keys, first, count, some[order]))

    def held(self, texts: pa.Array) -> np.ndarray:
        """A table, strings by texts, of what stands in what; the empty string stands in all."""
        out = np.zeros((len(self.strings), len(texts)), bool)
        out[self.length == 0] = True
        flat = texts.cast(pa.large_binary())
        ends = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        size = int(ends[-1] - ends[0])
        if not size:
            return out
        data = np.zeros(size + 8, np.uint8)
        data[:size] = np.frombuffer(flat.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        eight = np.ndarray((size,), "<u8", data, 0, (1,))  # at each place, the bytes from there on
        for low in range(0, size, PLACES):
            for mask, known, keys, first, count, which in self.groups:
                key = eight[low : low + PLACES] & mask
                at = np.flatnonzero(known[(key * _MIX) >> np.uint64(48)])
                k = np.minimum(np.searchsorted(keys, key[at]), len(keys) - 1)
                same = keys[k] == key[at]
                at, k = at[same] + low, k[same]
                n = count[k]
                place = np.repeat(at, n)
                nth = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n)
                string = which[np.repeat(first[k], n) + nth]
                text = np.searchsorted(ends, place, "right") - 1
                length = self.length[string]
                good = place + length <= ends[text + 1]
                good &= (length <= 8) | (eight[np.minimum(np.maximum(place + length - 8, 0), size - 1)] == self.last[string])
                place, string, text, length = place[good], string[good], text[good], length[good]
                sure = length <= 16
                out[string[sure], text[sure]] = True
                for p, s, t in zip(place[~sure].tolist(), string[~sure].tolist(), text[~sure].tolist(), strict=True):
                    if not out[s, t] and data[p : p + len(self.strings[s])].tobytes() == self.strings[s]:
                        out[s, t] = True
        return out
