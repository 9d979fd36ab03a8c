"""Vectorised splitting for byte-level BPE, and a table of what its matches encode to.

split() gives the matches of the usual pattern (contractions, an optional space before letters, digits or other marks,
white space up to the last before a word), from classes of characters and where they change. Equal matches of a piece
are encoded once, and remembered in sorted arrays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from .common import byte_hash

OTHER, LETTER, DIGIT, WHITE = 0, 1, 2, 3
#: The pattern that split() follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Matches remembered, at most.
REMEMBERED = 2_000_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    text = every.astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, text):
            out[every[m.start() : m.end()]] = kind
    return out


def split(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The first byte of each match, over documents one after the other."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero(data & 0xC0 != 0x80)
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    kind = char_classes()[chars]
    n = len(chars)
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(lead, off)] = True
    start = opens[:-1].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of white space before something else stands apart, and a space goes with what follows
    last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~opens[1:-1])
    start[last] = True
    spaced = last[chars[last] == 0x20]
    start[spaced + 1] = False
    # contractions
    at = np.flatnonzero((chars[:-1] == 0x27) & start[:-1] & ~opens[1:-1])
    if len(at):
        far = np.append(chars, 0)
        far_open = opens
        one, two = far[at + 1], far[at + 2]
        two = np.where(far_open[at + 2], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for chosen, size in ((at[short], 2), (at[long], 3)):
            start[chosen + 1] = False
            after = chosen + size
            start[after[after < n]] = True
    return lead[np.flatnonzero(start)]


class Remembering:
    """Encodes whole pieces; encode_new gets matches that are not remembered, and gives how
    many ids each has, and these."""

    def __init__(self, encode_new: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode_new = encode_new
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        #: Bytes of the matches, and where each one's begin: hashes that agree are not taken for equality.
        self.bytes, self.filled = np.zeros(1 << 16, np.uint8), 0
        self.begins, self.widths = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, keys: np.ndarray, matches: list[bytes]) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:
            raise OverflowError
        sizes, ids = self.encode_new(matches)
        total = len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
        self.pool[self.used : self.used + total] = ids
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += total
        raw, widths = np.frombuffer(b"".join(matches), np.uint8), np.array([len(m) for m in matches], np.int64)
        while self.filled + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros(len(self.bytes), np.uint8)])
        self.bytes[self.filled : self.filled + len(raw)] = raw
        begins = self.filled + np.cumsum(widths) - widths
        self.filled += len(raw)
        at = np.searchsorted(self.keys, keys)
        self.begins, self.widths = np.insert(self.begins, at, begins), np.insert(self.widths, at, widths)
        self.keys, self.starts, self.sizes = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each document's begin."""
        start = split(data, off)
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        end = np.append(start[1:], len(data))
        keys, first, back = np.unique(byte_hash(data)(start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = data.tobytes()
            matches = [raw[s:e] for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            try:
                self.learn(keys[new], matches)
            except OverflowError:
                self.forget()
                self.learn(keys, [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        at = np.searchsorted(self.keys, keys)
        # matches stand one after the other, so that all bytes are compared with those remembered for their hashes
        width, known = end - start, self.widths[at][back]
        if (width != known).any() or (data != self.bytes[np.repeat(self.begins[at][back] - start, width) + np.arange(len(data))]).any():
            return self._apart(data, off, start, end)
        size = self.sizes[at][back]
        total = np.cumsum(size)
        where = np.repeat(self.starts[at][back] - (total - size), size) + np.arange(total[-1])
        bounds = np.concatenate([[0], total])[np.searchsorted(start, off)]
        return self.pool[where], bounds

    def _apart(self, data: np.ndarray, off: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same without hashes, for the piece in which two matches have one."""
        raw = data.tobytes()
        matches = [raw[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)]
        number = {m: i for i, m in enumerate(dict.fromkeys(matches))}
        sizes, ids = self.encode_new(list(number))
        item = np.array([number[m] for m in matches])
        size, first = sizes[item], (np.cumsum(sizes) - sizes)[item]
        total = np.cumsum(size)
        where = np.repeat(first - (total - size), size) + np.arange(total[-1])
        return np.asarray(ids, np.int32)[where], np.concatenate([[0], total])[np.searchsorted(start, off)]
