"""Arithmetic coding of many frames side by side.

Coding a frame is a fold over its symbols, so the loop runs over positions, and each step narrows the intervals of all frames of a batch
at once with array operations. All bits that settle in a step are taken together: the leading bits on which both ends agree, then the run of
positions where the ends straddle the middle, which are owed until the next settled bit.
"""

from __future__ import annotations

import numpy as np

WIDTH = 32
_ALL, _TOP, _REST = (1 << WIDTH) - 1, 1 << (WIDTH - 1), (1 << (WIDTH - 1)) - 1
#: Totals above this could overflow the interval arithmetic.
LARGEST_TOTAL = 1 << 30


def _length(x: np.ndarray) -> np.ndarray:
    """Bits of each non-negative integer below 2^53."""
    return np.frexp(x.astype(float))[1].astype(np.int64)


def _checked(cumulative: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    cum = np.asarray(cumulative, np.int64)
    if cum.ndim != 2 or not len(tables) or any(len(t) == 0 for t in tables):
        raise ValueError("cumulative tables are two-dimensional, and no frame is empty")
    if (cum[:, -1] <= 0).any() or (cum[:, -1] > LARGEST_TOTAL).any():
        raise ValueError("a table's total must be above 0 and at most 2^30")
    if any(t.min() < 0 or t.max() >= len(cum) for t in tables):
        raise ValueError("there is no such table")
    return cum


def _settled(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(agreed, straddled, low, high) after shifting out the bits that agree and those that straddle the middle."""
    agreed = WIDTH - _length(low ^ high)
    low, high = (low << agreed) & _ALL, ((high << agreed) & _ALL) | ((np.int64(1) << agreed) - 1)
    # below the top bit: positions where low has 1 and high has 0
    straddled = WIDTH - 1 - _length(~(low & ~high) & _REST)
    low, high = (low << straddled) & _REST, (((high << straddled) & _REST) | _TOP) | ((np.int64(1) << straddled) - 1)
    return agreed, straddled, low, high


class _Bits:
    """Growing rows of bits."""

    def __init__(self, rows: int, room: int):
        self.bits, self.used = np.zeros((rows, room), np.uint8), np.zeros(rows, np.int64)

    def append(self, rows: np.ndarray, head: np.ndarray, owed: np.ndarray, word: np.ndarray, count: np.ndarray) -> None:
        """To each row: its bit ``head``, ``owed`` opposite bits, then the bits of ``word`` after its first, ``count`` with that one."""
        lengths = count + owed
        if (self.used[rows] + lengths).max(initial=0) > self.bits.shape[1]:
            self.bits = np.concatenate((self.bits, np.zeros((len(self.bits), max(self.bits.shape[1], int(lengths.max()))), np.uint8)), axis=1)
        at = np.repeat(np.arange(len(rows)), lengths)
        j = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        tail = (word[at] >> np.maximum(WIDTH - 1 - (j - owed[at]), 0)) & 1
        self.bits[rows[at], self.used[rows[at]] + j] = np.where(j == 0, head[at], np.where(j <= owed[at], 1 - head[at], tail))
        self.used[rows] += lengths


def encode_frames(frames: list, cumulative, tables: list) -> list[bytes]:
    """The payload of each frame of symbols; tables[i][j] is the table of frames[i][j]."""
    frames, tables = [np.asarray(f, np.int64) for f in frames], [np.asarray(t, np.int64) for t in tables]
    if not frames:
        return []
    cum = _checked(cumulative, tables)
    if any(len(f) != len(t) for f, t in zip(frames, tables, strict=True)):
        raise ValueError("symbols and tables differ in length")
    if any(f.min() < 0 or f.max() >= cum.shape[1] - 1 for f in frames):
        raise ValueError(f"symbols must lie in [0, {cum.shape[1] - 1})")
    order = sorted(range(len(frames)), key=lambda i: -len(frames[i]))
    sizes = np.array([len(frames[i]) for i in order])
    longest = sizes[0]
    syms, tabs = np.zeros((longest, len(order)), np.int64), np.zeros((longest, len(order)), np.int64)
    for k, i in enumerate(order):
        syms[: sizes[k], k], tabs[: sizes[k], k] = frames[i], tables[i]
    low, high, owed = np.zeros(len(order), np.int64), np.full(len(order), _ALL, np.int64), np.zeros(len(order), np.int64)
    out, totals = _Bits(len(order), int(longest) * 4 + 64), cum[:, -1]
    for step in range(longest):
        n = int(np.searchsorted(-sizes, -step, "left"))
        s, t = syms[step, :n], tabs[step, :n]
        l0, span, total = low[:n], high[:n] - low[:n] + 1, totals[t]
        new_low, new_high = l0 + span * cum[t, s] // total, l0 + span * cum[t, s + 1] // total - 1
        agreed, straddled, low[:n], high[:n] = _settled(new_low, new_high)
        rows = np.flatnonzero(agreed)
        out.append(rows, new_high[rows] >> (WIDTH - 1), owed[rows], new_high[rows], agreed[rows])
        owed[rows] = 0
        owed[:n] += straddled
    rows = np.arange(len(order))
    out.append(rows, (low >= 1 << (WIDTH - 2)).astype(np.int64), owed + 1, np.zeros_like(low), np.ones_like(low))
    payloads: list[bytes] = [b""] * len(order)
    for k, i in enumerate(order):
        payloads[i] = np.packbits(out.bits[k, : out.used[k]]).tobytes()
    return payloads


def decode_frames(payloads: list[bytes], cumulative, tables: list) -> list[np.ndarray]:
    """The symbols of each payload, as many as its list of tables is long."""
    tables = [np.asarray(t, np.int64) for t in tables]
    if not payloads:
        return []
    cum = _checked(cumulative, tables)
    order = sorted(range(len(payloads)), key=lambda i: -len(tables[i]))
    sizes = np.array([len(tables[i]) for i in order])
    longest, totals = sizes[0], cum[:, -1]
    tabs = np.zeros((longest, len(order)), np.int64)
    for k, i in enumerate(order):
        tabs[: sizes[k], k] = tables[i]
    room = max(len(p) for p in payloads) + 16
    data = np.zeros((len(order), room), np.uint64)
    for k, i in enumerate(order):
        data[k, : len(payloads[i])] = np.frombuffer(payloads[i], np.uint8)
    # eight bytes from each place on; past the end there are zeroes
    window = np.zeros((len(order), room), np.uint64)
    for b in range(8):
        window[:, : room - b] |= data[:, b:] << np.uint64(56 - 8 * b)
    value = (window[:, 0] >> np.uint64(64 - WIDTH)).astype(np.int64)
    read = np.full(len(order), WIDTH, np.int64)
    low, high = np.zeros(len(order), np.int64), np.full(len(order), _ALL, np.int64)
    # one sorted array of all tables, each lifted above the one before
    lift = int(totals.max()) + 1
    flat, width = (cum[:, :-1] + lift * np.arange(len(cum))[:, None]).ravel(), cum.shape[1] - 1
    out = np.zeros((longest, len(order)), np.int64)
    for step in range(longest):
        n = int(np.searchsorted(-sizes, -step, "left"))
        t, v = tabs[step, :n], value[:n]
        l0, span, total = low[:n], high[:n] - low[:n] + 1, totals[t]
        scaled = ((v - l0 + 1) * total - 1) // span
        s = np.searchsorted(flat, scaled + lift * t, "right") - 1 - t * width
        out[step, :n] = s
        new_low, new_high = l0 + span * cum[t, s] // total, l0 + span * cum[t, s + 1] // total - 1
        agreed, straddled, low[:n], high[:n] = _settled(new_low, new_high)
        bits = agreed + straddled
        at = read[:n]
        word = window[np.arange(n), np.minimum(at >> 3, room - 1)] << (at & 7).astype(np.uint64)
        fresh = np.where(bits > 0, word >> (64 - np.maximum(bits, 1)).astype(np.uint64), 0).astype(np.int64)
        v = ((v << agreed) & _ALL) | (fresh >> straddled)
        value[:n] = np.where(straddled > 0, (v & _TOP) | ((v << straddled) & _REST) | (fresh & ((np.int64(1) << straddled) - 1)), v)
        read[:n] += bits
    result: list[np.ndarray] = [np.empty(0, np.int64)] * len(order)
    for k, i in enumerate(order):
        result[i] = out[: sizes[k], k].copy()
    return result
