"""Simple-8b: unsigned ids in 64-bit words, each word led by a 4-bit selector.

A block of ids is a run of words; blocks start at known words, so they are
packed and unpacked side by side. Selectors 1 to 14 say how many ids a word
holds and their width; selector 0 is the escape: its word holds 0 and the next
word a whole 64-bit id. Shorter rests are filled up by zeros, which the count
in the header cuts off.

Bytes of a frame: magic, u32 ids a block, u64 ids, u32 blocks, u32 words, then
u32 block offsets (in words, one more than blocks), padding to 8, u64 words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIQII")
BLOCK = 1024
# Ids in a word and bits of each, by selector from 1.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNTS
ESCAPE = 0
LARGEST = (1 << 60) - 1


#: Width class by bit length; longer ids than 60 bits need the escape.
_CLASS = np.array([int(BITS[np.searchsorted(BITS, n)]) if n <= 60 else 61 for n in range(66)], np.uint8)
_NARROW = _CLASS[np.frexp(np.arange(65536.0))[1]]


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 61 for those that need the escape."""
    if ids.dtype.itemsize <= 2:
        return _NARROW[ids]
    return _CLASS[np.frexp(ids.astype(np.float64))[1]]


def _window_max(widths: np.ndarray) -> dict[int, np.ndarray]:
    """For each count n: the largest width among the next n ids; ids beyond the block count as narrow."""
    power, span, at = {1: widths}, widths, 1
    while at < 60:
        moved = np.zeros_like(span)
        moved[:, :-at] = span[:, at:]
        span = np.maximum(span, moved)
        at *= 2
        power[at] = span
    out = {}
    for n in COUNTS.tolist():
        low = 1 << (n.bit_length() - 1)
        out[n] = power[low].copy()
        if n > low:
            out[n][:, : -(n - low)] = np.maximum(out[n][:, : -(n - low)], power[low][:, n - low :])
    return out


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    ids = np.ascontiguousarray(ids)
    n = len(ids)
    blocks = -(-n // block)
    pad = block + 60
    grid = np.zeros((blocks, pad), ids.dtype)  # what a last word reads beyond its block is zero
    full = n // block
    grid[:full, :block] = ids[: full * block].reshape(full, block)
    if blocks > full:
        grid[full, : n - full * block] = ids[full * block :]
    words, offsets = np.zeros(0, np.uint64), np.zeros(blocks + 1, "<u4")
    if blocks:
        selector = np.zeros(grid.shape, np.uint8)
        windows = _window_max(_widths(grid))
        for s in range(len(COUNTS), 0, -1):
            np.copyto(selector, s, where=windows[int(COUNTS[s - 1])] <= BITS[s - 1])
        # All blocks step from word to word together.
        taken = np.append(1, COUNTS)
        at, rows, word_at = np.zeros(blocks, np.int64), np.arange(blocks), np.zeros(blocks, np.int64)
        steps = []
        while len(rows):
            sel = selector[rows, at]
            steps.append((rows, at, sel, word_at[rows]))
            word_at[rows] += 1 + (sel == ESCAPE)
            at = at + taken[sel]
            left = at < block
            if not left.all():
                rows, at = rows[left], at[left]
        offsets[1:] = np.cumsum(word_at)
        row, start, sel, place = (np.concatenate(x) for x in zip(*steps, strict=True))
        place += offsets[row]
        words = np.zeros(int(offsets[-1]), np.uint64)
        flat, base = grid.reshape(-1), row * pad + start
        for s in range(1, len(COUNTS) + 1):
            k = np.flatnonzero(sel == s)
            if len(k):
                word = np.full(len(k), s << 60, np.uint64)
                for j in range(int(COUNTS[s - 1])):
                    word |= flat[base[k] + j].astype(np.uint64) << np.uint64(j * int(BITS[s - 1]))
                words[place[k]] = word
        k = np.flatnonzero(sel == ESCAPE)
        words[place[k] + 1] = flat[base[k]]
    head = HEADER.pack(MAGIC, block, n, blocks, len(words)) + offsets.tobytes()
    return head + bytes(-len(head) % 8) + words.astype("<u8", copy=False).tobytes()


def decode(data: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """ids as u64; with a range of blocks, those blocks' ids alone, found by the offsets."""
    magic, block, n, blocks, words_n = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b frame")
    offsets = np.frombuffer(data, "<u4", blocks + 1, HEADER.size)
    at = HEADER.size + 4 * (blocks + 1)
    words = np.frombuffer(data, "<u8", words_n, at + (-at % 8))
    last_block = blocks if last_block is None else min(last_block, blocks)
    words = words[offsets[first_block] : offsets[last_block]]
    asked = last_block - first_block
    if asked <= 0 or not len(words):
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is an id, whatever its upper bits say.
    whole = []
    for k in np.flatnonzero(words == 0).tolist():
        if not whole or whole[-1] != k:
            whole.append(k + 1)
    sel[whole] = 0
    counts = np.append(0, COUNTS)[sel]
    counts[whole] = 1
    bounds = (offsets[first_block : last_block + 1] - offsets[first_block]).astype(np.int64)
    row = np.repeat(np.arange(asked), np.diff(bounds))
    before = np.cumsum(counts) - counts
    pad = block + 60
    place = before - before[bounds[row]] + row * pad
    out = np.zeros(asked * pad, np.uint64)
    for s in range(1, len(COUNTS) + 1):
        k = np.flatnonzero(sel == s)
        if len(k):
            bits, held, to = int(BITS[s - 1]), words[k], place[k]
            for j in range(int(COUNTS[s - 1])):
                out[to + j] = (held >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    out[place[whole]] = words[whole]
    return out.reshape(asked, pad)[:, :block].reshape(-1)[: min(n, last_block * block) - first_block * block]
