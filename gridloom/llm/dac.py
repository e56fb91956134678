"""Directly addressable codes for token ids.

An id is split into chunks of ``bits`` bits, lowest first. Level 0 holds the
first chunk of every id, level 1 the second chunk of those ids that go on, and
so forth. A bitmap at each level says which ids go on, and its rank directory
(a 32-bit count for every 1,024 bits, a 16-bit count within for every 64) leads
to their places on the next level, so any id is read in a fixed number of steps
without decoding others.

Layout, little-endian: magic ``GDAC``, byte version, byte bits, byte levels,
byte 0; uint64 number of documents, uint64 how many of them (the first) have
no id, their ids as int64 and where each begins as uint64; and for each level:
uint64 number of chunks, the chunks (one byte each), and but for the last level
the bitmap as uint64 words and both directories.
"""

from __future__ import annotations

import struct

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

MAGIC = b"GDAC"
VERSION = 2
SUPER = 16  # words of a superblock


def _directory(going_on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.zeros(-(-len(going_on) // 64) * 8, np.uint8)
    bits = np.packbits(going_on, bitorder="little")
    words[: len(bits)] = bits
    words = words.view("<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[: len(words)]
    high = before[::SUPER]
    return words, high.astype("<u4"), (before - np.repeat(high, SUPER)[: len(before)]).astype("<u2")


def encode(ids: np.ndarray, bits: int = 8, docs: list[int] | np.ndarray = (), starts: list[int] | np.ndarray = (), nulls: int = 0) -> bytes:
    """The file for these ids (each below 2**32) of documents that begin at ``starts``."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        chunk, above = (rest & np.uint32((1 << bits) - 1)).astype(np.uint8), rest >> np.uint32(bits)
        on = above > 0
        more = bool(on.any())
        levels.append((chunk, on if more else None))
        if not more:
            break
        rest = above[on]
    out = [MAGIC, struct.pack("<BBBB", VERSION, bits, len(levels), 0), struct.pack("<QQ", len(docs), nulls), np.asarray(docs, "<i8").tobytes(), np.asarray(starts, "<u8").tobytes()]
    for chunk, on in levels:
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes()]
        if on is not None:
            out += [part.tobytes() for part in _directory(on)]
    return b"".join(out)


@dataclass
class Level:
    """Where a level's parts begin in the file; the last level has chunks only."""

    count: int
    chunks: int
    words: int
    high: int
    low: int


def layout(fetch: Callable[[int, int], bytes]) -> tuple[int, int, int, list[Level]]:
    """Bits of a chunk, numbers of documents and of those without an id, and the levels; reads the counts alone."""
    head = bytes(fetch(0, 24))
    if head[:4] != MAGIC or head[4] != VERSION:
        raise ValueError("not a token file")
    docs, nulls = struct.unpack_from("<QQ", head, 8)
    at, levels = 24 + 16 * docs, []
    for level in range(head[6]):
        (n,) = struct.unpack("<Q", bytes(fetch(at, 8)))
        words = -(-n // 64) if level < head[6] - 1 else 0
        chunks = at + 8
        high = chunks + n + 8 * words
        low = high + 4 * -(-words // SUPER)
        levels.append(Level(n, chunks, chunks + n, high, low))
        at = low + 2 * words
    return head[5], docs, nulls, levels


def token(fetch: Callable[[int, int], bytes], at: int) -> int:
    """The id at place ``at`` of a file that ``fetch(offset, length)`` reads by range: at most four small reads a level."""
    bits, _, _, levels = layout(fetch)
    if not 0 <= at < levels[0].count:
        raise IndexError(at)
    out = 0
    for nth, level in enumerate(levels):
        out |= bytes(fetch(level.chunks + at, 1))[0] << (nth * bits)
        if nth == len(levels) - 1:
            break
        word, bit = at >> 6, at & 63
        (held,) = struct.unpack("<Q", bytes(fetch(level.words + 8 * word, 8)))
        if not held >> bit & 1:
            break
        (high,) = struct.unpack("<I", bytes(fetch(level.high + 4 * (word // SUPER), 4)))
        (low,) = struct.unpack("<H", bytes(fetch(level.low + 2 * word, 2)))
        at = high + low + (held & ((1 << bit) - 1)).bit_count()
    return out


class Reader:
    """Random access to the ids of one file in memory."""

    def __init__(self, blob: bytes):
        self.bits, docs, self.nulls, levels = layout(lambda at, n: blob[at : at + n])
        self.docs = np.frombuffer(blob, "<i8", docs, 24)
        self.starts = np.frombuffer(blob, "<u8", docs, 24 + 8 * docs).astype(np.int64)
        self.levels = []
        for level in levels:
            words = (level.high - level.words) // 8
            maps = [np.frombuffer(blob, "<u8", words, level.words), np.frombuffer(blob, "<u4", -(-words // SUPER), level.high), np.frombuffer(blob, "<u2", words, level.low)]
            self.levels.append((np.frombuffer(blob, np.uint8, level.count, level.chunks), maps if level is not levels[-1] else None))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def read(self, at: np.ndarray) -> np.ndarray:
        """The ids at these places."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        todo = np.arange(len(at))
        for level, (chunks, maps) in enumerate(self.levels):
            out[todo] |= chunks[at].astype(np.uint32) << np.uint32(level * self.bits)
            if maps is None:
                break
            words, high, low = maps
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            held = words[word]
            on = (held >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(held & ((np.uint64(1) << bit) - np.uint64(1)))
            ranks = high[word // SUPER].astype(np.int64) + low[word] + below
            at, todo = ranks[on], todo[on]
            if not len(at):
                break
        return out

    def _rank(self, maps: list[np.ndarray], at: int) -> int:
        """How many of a level's first ``at`` ids go on to the next level."""
        words, high, low = maps
        word, bit = at >> 6, at & 63
        if word == len(words):
            word, bit = word - 1, 64
        return int(high[word // SUPER]) + int(low[word]) + (int(words[word]) & ((1 << bit) - 1)).bit_count()

    def slice(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to before ``end``; the directories give the stretch of each level that they lie in."""
        start, end = max(0, start), min(len(self), end)
        out = np.zeros(max(0, end - start), np.uint32)
        todo = None
        for level, (chunks, maps) in enumerate(self.levels):
            if end <= start:
                break
            part = chunks[start:end].astype(np.uint32) << np.uint32(level * self.bits)
            if todo is None:
                out |= part
            else:
                out[todo] |= part
            if maps is None:
                break
            on = np.unpackbits(maps[0][start >> 6 : -(-end // 64)].view(np.uint8), bitorder="little")[start & 63 :][: end - start].view(bool)
            todo = np.flatnonzero(on) if todo is None else todo[on]
            start = self._rank(maps, start)
            end = start + int(np.count_nonzero(on))
        return out
