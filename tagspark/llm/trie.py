"""Elias-Fano sequences and a two-level n-gram trie made of them, read in place from any buffer.

A sorted sequence of n numbers below u keeps the low log2(u / n) bits of each
number as they are and the high bits as unary differences: about two bits more
per number than the least possible. `EliasFano` and `Trie` read bytes, a row's
buffer or a memory-mapped file alike and unpack only the unary part.
"""

from __future__ import annotations

import struct
from functools import cached_property

import numpy as np

_HEAD = struct.Struct("<QBQQ")
_PAD = b"\0" * 8
_ROWS = 1 << 16
U = np.uint64


def ef_encode(values: np.ndarray) -> bytes:
    """A non-decreasing sequence of unsigned 64-bit numbers."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0) + _PAD
    width = max(0, min(56, ((int(values[-1]) + 1) // n).bit_length() - 1))
    high = (values >> U(width)).astype(np.int64)
    unary = np.zeros(n + int(high[-1]) + 1, np.uint8)
    unary[high + np.arange(n)] = 1
    top = np.packbits(unary).tobytes()
    low = []
    for at in range(0, n if width else 0, _ROWS):
        part = values[at:at + _ROWS].astype(">u8").view(np.uint8).reshape(-1, 8)
        low.append(np.packbits(np.unpackbits(part, axis=1)[:, 64 - width:].ravel()).tobytes())
    rest = b"".join(low)
    return _HEAD.pack(n, width, len(top), len(rest)) + top + rest + _PAD


class EliasFano:
    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        self.n, self.width, top, rest = _HEAD.unpack(raw[:_HEAD.size].tobytes())
        self.top = raw[_HEAD.size:_HEAD.size + top]
        self.low_bytes = raw[_HEAD.size + top:_HEAD.size + top + rest + 8]
        self.bytes = _HEAD.size + top + rest + 8

    @cached_property
    def high(self) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.top))[:self.n] - np.arange(self.n)

    def low(self, at: np.ndarray) -> np.ndarray:
        """Low bits of the numbers at these places, read where they lie."""
        if not self.width:
            return np.zeros(len(at), np.uint64)
        words = np.ndarray((len(self.low_bytes) - 7,), ">u8", self.low_bytes, strides=(1,))
        bit = at.astype(np.int64) * self.width
        return (words[bit >> 3].astype(np.uint64) << (bit & 7).astype(np.uint64)) >> U(64 - self.width)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.high[at].astype(np.uint64) << U(self.width)) | self.low(at)

    def all(self) -> np.ndarray:
        return self.get(np.arange(self.n)) if self.n else np.zeros(0, np.uint64)

    def find(self, keys: np.ndarray, least: np.ndarray | None = None, most: np.ndarray | None = None) -> np.ndarray:
        """Place of the first number equal to each key, or -1; only places from `least` up to, not including, `most` count.

        The key's high bits give a run of places, the successor of its low bits is searched in it.
        """
        if not self.n or not len(keys):
            return np.full(len(keys), -1)
        top = (keys >> U(self.width)).astype(np.int64)
        wanted = keys & ((U(1) << U(self.width)) - U(1))
        low, end = np.searchsorted(self.high, top), np.searchsorted(self.high, top, "right")
        if least is not None:
            low, end = np.maximum(low, least), np.minimum(end, most)
        high = np.maximum(end, low)
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            less = self.low(middle) < wanted[active]
            low[active[less]] = middle[less] + 1
            high[active[~less]] = middle[~less]
            active = active[low[active] < high[active]]
        ok = low < end
        ok[ok] = self.low(low[ok]) == wanted[ok]
        return np.where(ok, low, -1)


def trie_encode(contexts: np.ndarray, of: np.ndarray, words: np.ndarray, payload: np.ndarray) -> bytes:
    """Levels: sorted `contexts`, a pointer to each one's first word, `words` (32 bits) sorted within their context `of`, and two bytes per word.

    `of` counts contexts from 0; words are stored relative to their context.
    """
    starts = np.searchsorted(of, np.arange(len(contexts) + 1)).astype(np.uint64)
    levels = [ef_encode(contexts), ef_encode(starts), ef_encode((of.astype(np.uint64) << U(32)) | words.astype(np.uint64)),
              payload.astype("<u2").tobytes()]
    return struct.pack("<4Q", *map(len, levels)) + b"".join(levels)


class Trie:
    def __init__(self, buffer):
        raw = np.frombuffer(buffer, np.uint8)
        sizes = struct.unpack("<4Q", raw[:32].tobytes())
        ends = 32 + np.cumsum((0, *sizes))
        parts = [raw[a:b] for a, b in zip(ends, ends[1:])]
        self.contexts, self.starts, self.words = (EliasFano(p) for p in parts[:3])
        self.payload = np.ndarray((len(parts[3]) // 2,), "<u2", parts[3])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All contexts and words, in order."""
        keys = self.words.all()
        return self.contexts.all()[(keys >> U(32)).astype(np.int64)] if len(keys) else keys, keys & U(0xFFFFFFFF)

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The payload of each (context, word), 0 where the trie has none: the context is found first, then its word among its own."""
        out = np.zeros(len(contexts), "<u2")
        at = self.contexts.find(contexts)
        known = np.flatnonzero(at >= 0) if len(self.payload) else np.zeros(0, np.int64)
        if len(known):
            c = at[known]
            place = self.words.find((c.astype(np.uint64) << U(32)) | words[known].astype(np.uint64),
                                    self.starts.get(c).astype(np.int64), self.starts.get(c + 1).astype(np.int64))
            out[known] = np.where(place >= 0, self.payload[np.maximum(place, 0)], 0)
        return out
