"""Column-wise construction of the Burrows-Wheeler transform of many strings, with common prefixes.

In round j the j-th last symbol of every string that is long enough is put in front of that string's
suffix (Bauer, Cox and Rosone, 2013; with prefixes, Cox and others, 2016). The places of the new suffixes
follow from the transform so far by counting symbols, their common prefixes from the least common
prefix between two occurrences of a symbol. The transform, the prefixes and the suffixes' owners are
files that each round reads once from the start and writes anew in order. Callers bound a collection's
size, so the files are kept in the worker's memory and need no disk.
"""

from __future__ import annotations

import io

import numpy as np

_BLOCK = 64


class Columns:
    """The collection's columns as sequential files in memory: symbol before, common prefix with the row above, suffix."""

    KINDS = (np.int32, np.uint8, np.int32)

    def __init__(self):
        self.files: list[io.BytesIO] = []

    def write(self, *arrays: np.ndarray) -> None:
        self.files = [io.BytesIO(memoryview(np.ascontiguousarray(a, kind)).cast("B")) for a, kind in zip(arrays, self.KINDS)]

    def read(self) -> list[np.ndarray]:
        return [np.frombuffer(f.getbuffer(), kind) for f, kind in zip(self.files, self.KINDS)]


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) for each pair with lo < hi."""
    out = np.full(len(lo), 255, np.uint8)
    size = hi - lo

    def gather(which: np.ndarray, a: np.ndarray, n: np.ndarray) -> None:
        full = n > 0
        which, a, n = which[full], a[full], n[full]
        if len(which):
            first = np.cumsum(n) - n
            at = np.repeat(a - first, n) + np.arange(int(n.sum()))
            out[which] = np.minimum(out[which], np.minimum.reduceat(values[at], first))

    short = np.flatnonzero(size <= 2 * _BLOCK)
    gather(short, lo[short], size[short])
    long = np.flatnonzero(size > 2 * _BLOCK)
    if len(long):
        first, last = -(-lo[long] // _BLOCK), hi[long] // _BLOCK
        gather(long, lo[long], first * _BLOCK - lo[long])
        gather(long, last * _BLOCK, hi[long] - last * _BLOCK)
        blocks = np.minimum.reduceat(values, np.arange(0, len(values), _BLOCK))
        level, table, span = 0, blocks, 1
        count = last - first
        power = np.frexp(count.astype(float))[1] - 1  # 2**power <= count
        while True:
            here = power == level
            if here.any():
                best = np.minimum(table[first[here]], table[last[here] - span])
                out[long[here]] = np.minimum(out[long[here]], best)
            if level >= power.max():
                break
            table = np.minimum(table[: len(table) - span], table[span:])
            level, span = level + 1, span * 2
    return out


def sorted_order(values: np.ndarray, bits: int) -> np.ndarray:
    """A stable sort's order of integers below 2**bits, sixteen bits at a time."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, bits, 16):
        digit = ((values >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def ranks(values: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Each value's rank among the different ones, from 1, and their number."""
    order = sorted_order(values, bits)
    v = values[order]
    fresh = np.append(True, v[1:] != v[:-1]) if len(v) else np.zeros(0, bool)
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(fresh)
    return out, int(fresh.sum())


def block_codes(buf: np.ndarray, block: int) -> tuple[np.ndarray, int]:
    """A code for the `block` bytes from each place on, equal for equal bytes only; the end counts as zeros."""
    wide = np.concatenate([buf, np.zeros(block, np.uint8)])
    n = len(buf)
    code, bits, have = np.zeros(n, np.int64), 0, 0
    while have < block:
        take = min(block - have, 4)
        part = np.zeros(n, np.int64)
        for k in range(take):
            part = part << 8 | wide[have + k : have + k + n]
        code, count = ranks(code << (8 * take) | part, bits + 8 * take)
        bits, have = max(count.bit_length(), 1), have + take
    return code, bits


def equal_windows(strings: list[bytes], width: int, block: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of every window of `width` bytes; equal classes mean equal bytes.

    A symbol is a block of bytes, of which a window holds a whole number; a string takes part once for each
    offset at which blocks may begin, so a larger block means fewer rounds over as many suffixes. Strings
    may have at most 127 symbols, and 2**24 suffixes in all. The end of a string equals nothing.
    """
    if width % block:
        raise ValueError("a window must be made of whole blocks")
    size = np.array([len(s) for s in strings], np.int64)
    buf = np.frombuffer(b"".join(strings), np.uint8)
    begin = np.cumsum(size) - size
    offsets = np.maximum(np.minimum(size - width + 1, block), 0)
    owner = np.repeat(np.arange(len(strings)), offsets)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(offsets) - offsets, offsets)
    symbols = (size[owner] - offset) // block
    if len(symbols) and (symbols.max() > 127 or len(owner) >= 1 << 24):
        raise ValueError("too long or too many strings")
    code, bits = block_codes(buf, block)
    at = np.repeat(begin[owner] + offset, symbols) + block * (np.arange(int(symbols.sum())) - np.repeat(np.cumsum(symbols) - symbols, symbols))
    which, start, group = equal_runs(code[at].astype(np.int32), symbols, width // block, bits)
    return owner[which], offset[which] + block * start, group


def equal_runs(text: np.ndarray, size: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, class) of the runs of `width` symbols in strings of the given sizes, laid end to end in text.

    Symbols are 1 and more, below 2**bits; 0 marks ends. This is the column-wise construction.
    """
    m = len(size)
    if not m:
        z = np.zeros(0, np.int64)
        return z, z, z
    end = np.cumsum(size)
    columns = Columns()
    columns.write(np.where(size > 0, text[np.maximum(end - 1, 0)] if len(text) else 0, 0), np.zeros(m, np.uint8), np.arange(m, dtype=np.int64) << 7)
    place = np.arange(m)  # of each string's last inserted suffix
    for j in range(1, int(size.max()) + 1):
        before, prefix, suffix = columns.read()
        active = np.flatnonzero(size >= j)
        p = place[active]
        # a stable sort of the symbols gives each occurrence's rank behind the end marks
        order = sorted_order(before, bits)
        marks = int(np.count_nonzero(before == 0))
        rank = np.empty(len(before), np.int64)
        rank[order] = np.arange(len(before))
        r = rank[p]
        target = m + r - marks
        # neighbours among the occurrences of the same symbol
        above, below = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, len(order) - 1)]
        has_above = (r > 0) & (before[above] == before[p])
        has_below = (r + 1 < len(order)) & (before[below] == before[p])
        up, down = np.zeros(len(p), np.uint8), np.zeros(len(p), np.uint8)
        if has_above.any():
            up[has_above] = 1 + range_minima(prefix, above[has_above] + 1, p[has_above] + 1)
        if has_below.any():
            down[has_below] = 1 + range_minima(prefix, p[has_below] + 1, below[has_below] + 1)
        n = len(before) + len(active)
        fresh = np.zeros(n, bool)
        fresh[target] = True
        kept = np.flatnonzero(~fresh)
        left = size[active] - j
        new_before, new_prefix, new_suffix = np.empty(n, np.int32), np.empty(n, np.uint8), np.empty(n, np.int32)
        new_before[kept], new_prefix[kept], new_suffix[kept] = before, prefix, suffix
        new_before[target] = np.where(left > 0, text[np.maximum(end[active] - j - 1, 0)], 0)
        new_prefix[target], new_suffix[target] = up, active << 7 | j
        inside = target + 1 < n
        new_prefix[target[inside] + 1] = np.where(fresh[target[inside] + 1], new_prefix[target[inside] + 1], down[inside])
        place[active] = target
        columns.write(new_before, new_prefix, new_suffix)
    _, prefix, suffix = columns.read()
    which, length = (suffix >> 7).astype(np.int64), (suffix & 127).astype(np.int64)
    group = np.cumsum(prefix < width)
    long = length >= width
    return which[long], size[which[long]] - length[long], group[long]
