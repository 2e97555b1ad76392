"""Simple-8b: runs of small integers in 64-bit words, coded and decoded with numpy.

A word's top four bits select how many ids of how many bits its other sixty hold.
Ids come in blocks of a fixed number; every block starts a new word and its place
is kept, so all blocks are coded and decoded side by side.

One image (all numbers little-endian):
``S8B1`` | u32 ids in a block | u64 ids | u64 words | u32 escapes | u32 crc32 of
what follows | u32 first word of each block | u64 words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"S8B1"
_HEAD = struct.Struct("<4sIQQII")

# Fixed values of the format: (ids in a word, bits of an id) by selector.
# Selector 0 is the escape: the id is the whole next word.
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_WIDEST = 120


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id takes; 0 for 0."""
    if not ids.size or int(ids.max()) < 1 << 52:  # exact as doubles: the exponent counts the bits
        return np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    out = np.zeros(ids.shape, np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        out[big] += step
        rest[big] >>= np.uint64(step)
    return out + (rest > 0)


def encode(ids: np.ndarray, block: int = 512) -> bytes:
    """The image of ids from 0 to 2**64 - 1; none give an image without words."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    grid = np.zeros((blocks, block + _WIDEST), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = ids
    grid[:, :block] = flat.reshape(blocks, block)
    width = _widths(grid)
    # selector by first id: the one that takes most ids, found from short runs to long ones; a longer
    # run has narrower ids, so a block in which no run of a length fits has none that are longer
    choice = np.zeros((blocks, block), np.uint8)
    spans, left = {1: width}, np.arange(blocks)
    for s in sorted(range(1, len(SELECTORS)), key=lambda s: SELECTORS[s][0]):
        count, bits = SELECTORS[s]
        if count not in spans:
            a = max(spans)
            most = spans[a].copy()
            while a < count:
                step = max(c for c in spans if c <= count - a)
                np.maximum(most[:, :-a], spans[step][:, a:], out=most[:, :-a])
                a += step
            spans[count] = most
        fits = spans[count][:, :block] <= bits
        choice[left] = np.where(fits, np.uint8(s), choice[left])
        some = fits.any(1)
        if some.sum() < 0.7 * len(left):
            left, spans = left[some], {c: v[some] for c, v in spans.items()}
        if not len(left):
            break
    counts = np.array([c for c, _ in SELECTORS], np.int64)
    # walk all blocks at once, a word a step
    at, rows, starts, picked = np.zeros(blocks, np.int64), [], [], []
    words_of, offsets = np.zeros(blocks, np.int64), []  # words that a block has so far
    live = np.arange(blocks)
    while len(live):
        s = choice[live, at[live]]
        rows.append(live)
        starts.append(at[live])
        picked.append(s)
        offsets.append(words_of[live])
        words_of[live] += np.where(s == 0, 2, 1)
        at[live] += counts[s]
        live = live[at[live] < block] if n % block == 0 else live[at[live] < np.where(live == blocks - 1, n % block, block)]
    if not rows:
        body, words, escapes = b"", np.zeros(0, np.uint64), 0
        first = np.zeros(0, np.uint32)
    else:
        row, start, sel = np.concatenate(rows), np.concatenate(starts), np.concatenate(picked)
        opens = np.cumsum(words_of) - words_of
        place = opens[row] + np.concatenate(offsets)
        words = np.zeros(int(words_of.sum()), np.uint64)
        for s, (count, bits) in enumerate(SELECTORS):
            here = np.flatnonzero(sel == s)
            if not len(here):
                continue
            if s == 0:
                words[place[here] + 1] = grid[row[here], start[here]]
                continue
            word = np.full(len(here), s << 60, np.uint64)
            if bits:
                for j in range(count):
                    word |= grid[row[here], start[here] + j] << np.uint64(bits * j)
            words[place[here]] = word
        escapes = int((sel == 0).sum())
        first = opens.astype(np.uint32)
    body = first.astype("<u4").tobytes() + words.astype("<u8").tobytes()
    return _HEAD.pack(MAGIC, block, n, len(words), escapes, zlib.crc32(body)) + body


def decode(image: bytes) -> np.ndarray:
    """The ids of an image as unsigned 64-bit; a damaged image raises ValueError."""
    if len(image) < _HEAD.size:
        raise ValueError("not a Simple-8b image")
    magic, block, n, count, escapes, crc = _HEAD.unpack_from(image)
    body = memoryview(image)[_HEAD.size :]
    blocks = -(-n // block) if block else 0
    if magic != MAGIC or len(body) != 4 * blocks + 8 * count or zlib.crc32(body) != crc:
        raise ValueError("not a Simple-8b image")
    first = np.frombuffer(body, "<u4", blocks).astype(np.int64)
    words = np.frombuffer(body, "<u8", count, 4 * blocks)
    out = np.zeros((blocks, block + _WIDEST), np.uint64)
    if not n:
        return out.reshape(-1)[:0]
    raw = np.zeros(count, bool)
    if escapes:  # a word after an escape is an id, whatever its top bits say
        i = 0
        for i in np.flatnonzero(words >> np.uint64(60) == 0):
            if not raw[i]:
                raw[i + 1] = True
    head = np.flatnonzero(~raw)
    sel = (words[head] >> np.uint64(60)).astype(np.int64)
    takes = np.array([c for c, _ in SELECTORS], np.int64)[sel]
    row = np.searchsorted(first, head, "right") - 1
    before = np.cumsum(takes) - takes
    opens = np.flatnonzero(np.diff(row, prepend=-1))
    start = before - before[opens][row]
    for s, (c, bits) in enumerate(SELECTORS):
        here = np.flatnonzero(sel == s)
        if not len(here):
            continue
        if s == 0:
            out[row[here], start[here]] = words[head[here] + 1]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for j in range(c):
                out[row[here], start[here] + j] = (words[head[here]] >> np.uint64(bits * j)) & mask
    return np.ascontiguousarray(out[:, :block]).reshape(-1)[:n]
