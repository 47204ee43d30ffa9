"""JPEG images to pixels and back: sequential and progressive Huffman-coded files of 8 bits a sample.

Decoding is bit by bit only where the format is: codes are looked up by 16-bit windows, in tables that give a coefficient's code, run and
value at once; everything after that (dequantising, the inverse cosine transform, upsampling, colour) is one array operation an image.
"""

from __future__ import annotations

import heapq
import struct
from collections import Counter
from functools import lru_cache

import numpy as np

# Fixed values of the JPEG format: the order of coefficients, the example tables of steps for quality 50, and its colour weights.
ZIGZAG = [
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
]
LUMA_STEPS = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA_STEPS = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
#: Codes that motion-JPEG streams may leave out, as (codes of each length, symbols); symbols of 16 bits are those that are left, in their order.
DC_COUNTS, DC_COLOUR_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1)
AC_COUNTS, AC_COLOUR_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
AC_FIRST = "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"
AC_COLOUR_FIRST = "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"
TO_RGB = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

_AT = np.arange(8)
#: Row u holds the cosine of frequency u at 8 places, scaled to length one.
COSINES = np.cos((2 * _AT[None, :] + 1) * _AT[:, None] * np.pi / 16) * np.where(_AT == 0, np.sqrt(1 / 8), 0.5)[:, None]


class PixelError(ValueError):
    """An image that can't be decoded; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


# -- codes ----------------------------------------------------------------------------------------------------------------------------

#: What a window's entry packs: bits used in all (5), run before the coefficient (6), the coefficient. No bits: look at the code alone.
_END = 63


@lru_cache(maxsize=64)
def _windows(counts: bytes, symbols: bytes) -> tuple[memoryview, memoryview]:
    """For each 16-bit window that starts with a code: (packed coefficient, code length << 8 | symbol). Windows without a code have 0."""
    if len(symbols) < sum(counts):
        raise PixelError("DAMAGED")
    plain = np.zeros(1 << 16, np.int64)
    at = n = 0
    for length, count in enumerate(counts, 1):
        for symbol in symbols[n : n + count]:
            span = 1 << (16 - length)
            if at + span > 1 << 16:
                raise PixelError("DAMAGED")
            plain[at : at + span] = length << 8 | symbol
            at += span
        n += count
    w = np.arange(1 << 16)
    length, run, size = plain >> 8, plain >> 4 & 15, plain & 15
    used = length + size
    short = (plain > 0) & (used <= 16)
    raw = w >> np.clip(16 - used, 0, 16) & (1 << size) - 1
    value = np.where(raw < 1 << np.maximum(size - 1, 0), raw - (1 << size) + 1, raw)
    value = np.where(size == 0, 0, value)
    run = np.where((size == 0) & (run < 15), _END, run)
    packed = np.where(short, used | run << 5 | value << 11, 0)
    return memoryview(packed), memoryview(plain)


def _usual_codes() -> dict[int, tuple[bytes, bytes]]:
    """(counts, symbols) by table: those that a stream without tables means."""
    ac = {run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0}
    out = {0: (DC_COUNTS, range(12)), 1: (DC_COLOUR_COUNTS, range(12))}
    for key, counts, first in ((16, AC_COUNTS, AC_FIRST), (17, AC_COLOUR_COUNTS, AC_COLOUR_FIRST)):
        listed = list(bytes.fromhex(first))
        out[key] = counts, listed + sorted(ac - set(listed))
    return {key: (bytes(counts).ljust(16, b"\0"), bytes(symbols)) for key, (counts, symbols) in out.items()}


class _Bits:
    """The bits of one interval of entropy-coded data, stuffing removed. Beyond its end there are zeros, for one block at most."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        raw = np.frombuffer(data + bytes(1 << 10), np.uint8).astype(np.uint32)
        self.words = memoryview(raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:])
        self.end, self.at = 8 * len(data), 0

    def take(self, n: int) -> int:
        """The next n bits, up to 16, as a number."""
        at = self.at
        self.at = at + n
        return self.words[at >> 3] >> 32 - (at & 7) - n & (1 << n) - 1

    def symbol(self, plain: memoryview) -> int:
        at = self.at
        found = plain[self.words[at >> 3] >> 16 - (at & 7) & 0xFFFF]
        if not found:
            raise PixelError("DAMAGED")
        self.at = at + (found >> 8)
        return found & 255

    def extended(self, size: int) -> int:
        if size > 15:
            raise PixelError("DAMAGED")
        raw = self.take(size)
        return raw if not size or raw >> size - 1 else raw - (1 << size) + 1


class _Part:
    """A component: its sampling, its steps and its coefficients, a row of 64 for each block of the padded grid."""

    def __init__(self, key: int, h: int, v: int, table: int):
        self.key, self.h, self.v, self.table = key, h, v, table


# -- scans ----------------------------------------------------------------------------------------------------------------------------


def _sequential(bits: _Bits, out: memoryview, base: int, dc: tuple, ac: tuple, last: int) -> int:
    """One block of a sequential scan; the new DC value."""
    packed, plain = ac
    last += bits.extended(bits.symbol(dc[1]))
    out[base] = last
    words, at, k = bits.words, bits.at, 1
    while k < 64:
        p = packed[words[at >> 3] >> 16 - (at & 7) & 0xFFFF]
        if p:
            at += p & 31
            k += p >> 5 & 63
            value = p >> 11
        else:
            bits.at = at
            symbol = bits.symbol(plain)
            k += symbol >> 4
            value = bits.extended(symbol & 15)
            at = bits.at
        if value:
            out[base + ZIGZAG[k]] = value
        k += 1
    bits.at = at
    return last


def _first(bits: _Bits, out: memoryview, base: int, plain: memoryview, low: int, high: int, shift: int, run: int) -> int:
    """First pass over coefficients low..high of a block; how many further blocks have none."""
    if run:
        return run - 1
    k = low
    while k <= high:
        symbol = bits.symbol(plain)
        r, s = symbol >> 4, symbol & 15
        if s:
            k += r
            out[base + ZIGZAG[k]] = bits.extended(s) << shift
        elif r < 15:
            return (1 << r) - 1 + bits.take(r)
        else:
            k += 15
        k += 1
    return 0


def _refined(bits: _Bits, out: memoryview, base: int, plain: memoryview, low: int, high: int, shift: int, run: int) -> int:
    """One more bit of coefficients low..high of a block; how many further blocks get none but for those that they have."""
    k, one = low, 1 << shift

    def correct(at: int) -> None:
        if bits.take(1) and not abs(out[at]) & one:
            out[at] += one if out[at] > 0 else -one

    if not run:
        while k <= high:
            symbol = bits.symbol(plain)
            r, s = symbol >> 4, symbol & 15
            value = 0
            if s:
                value = one if bits.take(1) else -one
            elif r < 15:
                run = (1 << r) + bits.take(r)
                break
            while k <= high:
                at = base + ZIGZAG[k]
                if out[at]:
                    correct(at)
                elif r:
                    r -= 1
                else:
                    if value:
                        out[at] = value
                    break
                k += 1
            k += 1
    if run:
        while k <= high:
            at = base + ZIGZAG[k]
            if out[at]:
                correct(at)
            k += 1
        return run - 1
    return 0


class _Image:
    """The state that markers build up."""

    def __init__(self):
        self.steps: dict[int, np.ndarray] = {}
        self.codes = {key: _windows(*own) for key, own in _usual_codes().items()}
        self.interval, self.parts, self.adobe, self.turn = 0, [], None, 1
        self.width = self.height = 0
        self.progressive = False

    def tables(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            symbols = body[at + 17 : at + 17 + sum(counts)]
            self.codes[body[at]] = _windows(counts, symbols)
            at += 17 + len(symbols)

    def quantisers(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide = body[at] >> 4
            own = np.frombuffer(body[at + 1 : at + 65 + 64 * wide], ">u2" if wide else np.uint8)
            flat = np.zeros(64)
            flat[ZIGZAG] = own
            self.steps[body[at] & 15] = flat
            at += 65 + 64 * wide

    def frame(self, body: bytes, length: int) -> None:
        depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        if self.parts or not self.height or not self.width or not n:
            raise PixelError("BAD_HEADER")
        if depth != 8 or n not in (1, 3):
            raise PixelError("UNSUPPORTED")
        self.parts = [_Part(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        if not all(0 < p.h < 5 and 0 < p.v < 5 for p in self.parts):
            raise PixelError("BAD_HEADER")
        self.h, self.v = max(p.h for p in self.parts), max(p.v for p in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        if self.across * self.down > 8 * length:  # a block takes a bit at least
            raise PixelError("TRUNCATED")
        for p in self.parts:
            p.stride, p.rows = self.across * p.h, self.down * p.v
            p.wide, p.high = -(-self.width * p.h // self.h), -(-self.height * p.v // self.v)
            p.own = np.zeros(p.stride * p.rows * 64, np.int32)
            p.out = memoryview(p.own)

    def exif(self, body: bytes) -> None:
        """The turn that a camera asks for."""
        order = {b"II": "<", b"MM": ">"}.get(body[6:8])
        if body[:6] != b"Exif\0\0" or order is None or len(body) < 14:
            return
        tiff = body[6:]
        at = struct.unpack(order + "I", tiff[4:8])[0]
        count = struct.unpack(order + "H", tiff[at : at + 2])[0] if at + 2 <= len(tiff) else 0
        for i in range(count):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
                self.turn = struct.unpack(order + "H", entry[8:10])[0]

    def scan(self, head: bytes, data: bytes) -> None:
        n = head[0]
        chosen = []
        for i in range(n):
            part = next((p for p in self.parts if p.key == head[1 + 2 * i]), None)
            if part is None:
                raise PixelError("DAMAGED")
            chosen.append((part, self.codes.get(head[2 + 2 * i] >> 4), self.codes.get(16 | head[2 + 2 * i] & 15)))
        low, high, passes = head[1 + 2 * n : 4 + 2 * n]
        before, shift = passes >> 4, passes & 15
        if not self.progressive:
            low, high, before, shift = 0, 63, 0, 0
        if not n or high > 63 or low > high or low and n > 1 or shift > 13 or self.progressive and not low and high:
            raise PixelError("DAMAGED")
        if any(dc is None and not low and not before or ac is None and (low or not self.progressive) for _, dc, ac in chosen):
            raise PixelError("DAMAGED")
        # units of a scan: blocks of each part in an MCU, or single blocks of the image itself where a part is alone
        if n > 1:
            units = [[(p, dc, ac, (y * p.v + dy) * p.stride + x * p.h + dx) for p, dc, ac in chosen for dy in range(p.v) for dx in range(p.h)] for y in range(1) for x in range(1)]
            total, wide = self.across * self.down, self.across
        else:
            p, dc, ac = chosen[0]
            wide, units = -(-p.wide // 8), [[(p, dc, ac, 0)]]
            total = wide * -(-p.high // 8)
        pieces = _intervals(data) if self.interval else [data]
        step = self.interval or total
        if len(pieces) < -(-total // step):
            raise PixelError("TRUNCATED")
        for piece, start in zip(pieces, range(0, total, step)):
            bits, last, run = _Bits(piece), dict.fromkeys((p.key for p, _, _ in chosen), 0), 0
            for unit in range(start, min(start + step, total)):
                y, x = divmod(unit, wide)
                for p, dc, ac, offset in units[0]:
                    block = 64 * (y * p.stride + x if n == 1 else y * p.v * p.stride + x * p.h + offset)
                    if not self.progressive:
                        last[p.key] = _sequential(bits, p.out, block, dc, ac, last[p.key])
                    elif low:
                        run = (_refined if before else _first)(bits, p.out, block, ac[1], low, high, shift, run)
                    elif before:
                        if bits.take(1):
                            p.out[block] |= 1 << shift
                    else:
                        last[p.key] += bits.extended(bits.symbol(dc[1]))
                        p.out[block] = last[p.key] << shift
                if bits.at > bits.end:
                    raise PixelError("TRUNCATED")

    def pixels(self) -> np.ndarray:
        planes = []
        for p in self.parts:
            if p.table not in self.steps:
                raise PixelError("DAMAGED")
            blocks = (p.own.reshape(-1, 64) * self.steps[p.table]).reshape(-1, 8, 8)
            spread = COSINES.T @ blocks @ COSINES
            plane = spread.reshape(p.rows, p.stride, 8, 8).swapaxes(1, 2).reshape(8 * p.rows, 8 * p.stride)
            plane = np.clip(np.rint(plane + 128), 0, 255)[: p.high, : p.wide]
            across, down = self.h / p.h, self.v / p.v
            smooth = across == 2 and down in (1, 2) and plane.shape[1] > 2
            plane = _wider(_wider(plane.T, down, smooth).T, across, smooth)
            planes.append(plane[: self.height, : self.width])
        if len(planes) == 1:
            out = np.repeat(planes[0][:, :, None], 3, axis=2)
        elif self.adobe == 0 or self.adobe is None and bytes(p.key for p in self.parts) == b"RGB":
            out = np.stack(planes, axis=2)
        else:
            out = (np.stack(planes, axis=2) - [0, 128, 128]) @ TO_RGB.T
        return _turned(np.clip(np.rint(out), 0, 255).astype(np.uint8), self.turn)


def _wider(plane: np.ndarray, factor: float, smooth: bool) -> np.ndarray:
    """Columns at ``factor`` as many places: three parts of the nearer to one of the farther, or copies."""
    if factor == 1:
        return plane
    if smooth and factor == 2:
        left, right = np.hstack([plane[:, :1], plane[:, :-1]]), np.hstack([plane[:, 1:], plane[:, -1:]])
        return np.stack([(3 * plane + left) / 4, (3 * plane + right) / 4], axis=2).reshape(len(plane), -1)
    at = (np.arange(int(np.ceil(plane.shape[1] * factor))) / factor).astype(int)
    return plane[:, at]


def _turned(image: np.ndarray, turn: int) -> np.ndarray:
    """The image as a viewer shows it, for the eight orientations that a camera may note."""
    if turn in (5, 6, 7, 8):
        image = image.swapaxes(0, 1)
    if turn in (2, 3, 6, 7):
        image = image[:, ::-1]
    if turn in (3, 4, 7, 8):
        image = image[::-1]
    return np.ascontiguousarray(image)


def _intervals(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers."""
    raw = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((raw[:-1] == 255) & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)).tolist()
    return [data[a:b] for a, b in zip([0, *(m + 2 for m in marks)], [*marks, len(data)], strict=True)]


def _scan_end(raw: np.ndarray, at: int) -> int:
    """Where the data from ``at`` on meets a marker that isn't a restart."""
    chunk = 1 << 16
    while at < len(raw) - 1:
        own, after = raw[at : at + chunk], raw[at + 1 : at + chunk + 1]
        own = own[: len(after)]
        found = np.flatnonzero((own == 255) & (after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7)))
        if len(found):
            return at + int(found[0])
        at += chunk
    return len(raw)


def decode_jpeg(data: bytes | None) -> np.ndarray:
    """height x width x 3 of bytes, RGB, turned as the file's Exif orientation asks. PixelError for what isn't such a JPEG file, or damaged."""
    data = bytes(data or b"")
    if data[:2] != b"\xff\xd8":
        raise PixelError("NOT_JPEG")
    try:
        return _decoded(data)
    except (IndexError, ValueError, struct.error, OverflowError) as e:
        raise e if isinstance(e, PixelError) else PixelError("DAMAGED") from None


def _decoded(data: bytes) -> np.ndarray:
    image, at, scans, raw = _Image(), 2, 0, np.frombuffer(data, np.uint8)
    while True:
        while at < len(data) and data[at] == 255:
            at += 1
        if at + 3 > len(data) and not (at < len(data) and data[at] == 0xD9):
            raise PixelError("TRUNCATED")
        marker = data[at]
        if marker == 0xD9:
            break
        size = data[at + 1] << 8 | data[at + 2]
        body = data[at + 3 : at + 1 + size]
        if len(body) != size - 2:
            raise PixelError("TRUNCATED" if size >= 2 else "DAMAGED")
        at += 1 + size
        if marker == 0xC4:
            image.tables(body)
        elif marker == 0xDB:
            image.quantisers(body)
        elif marker == 0xDD:
            image.interval = body[0] << 8 | body[1]
        elif marker in (0xC0, 0xC1, 0xC2):
            image.progressive = marker == 0xC2
            image.frame(body, len(data))
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise PixelError("UNSUPPORTED")  # lossless, hierarchical or arithmetic
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) > 11:
            image.adobe = body[11]
        elif marker == 0xE1:
            image.exif(body)
        elif marker == 0xDA:
            if not image.parts:
                raise PixelError("DAMAGED")
            end = _scan_end(raw, at)
            image.scan(body, data[at:end])
            at, scans = end, scans + 1
            if at >= len(data) and not image.progressive:
                break  # the end marker alone is missing
    if not scans:
        raise PixelError("TRUNCATED")
    return image.pixels()


# -- writing --------------------------------------------------------------------------------------------------------------------------


def _lengths(counts: Counter) -> dict[int, int]:
    """Code lengths up to 16, none all ones: Huffman's, and where those are longer, of counts that are flattened until they fit."""
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate([(-1, 0), *sorted(counts.items())])]  # -1 takes the code of ones
        heapq.heapify(heap)
        lengths, fresh = Counter(), len(heap)
        while len(heap) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            lengths.update(left + right)
            heapq.heappush(heap, (a + b, fresh, left + right))
            fresh += 1
        if max(lengths.values()) <= 16:
            deepest = max(lengths.values())
            own = {s: n for s, n in lengths.items() if s >= 0}
            if lengths[-1] < deepest:  # the longest code has to be the one left out
                own[max(own, key=lambda s: (own[s], s))] = lengths[-1]
            return own
        counts = Counter({s: n // 2 + 1 for s, n in counts.items()})


def _coded(counts: Counter) -> tuple[bytes, dict[int, tuple[int, int]]]:
    """(body of the table's segment, symbol -> (code, length))."""
    order = sorted(_lengths(counts).items(), key=lambda x: (x[1], x[0]))
    body, codes, code, before = bytes(sum(n == k for _, n in order) for k in range(1, 17)) + bytes(s for s, _ in order), {}, 0, 0
    for symbol, n in order:
        code <<= n - before
        codes[symbol], before, code = (code, n), n, code + 1
    return body, codes


def _symbols(blocks: np.ndarray) -> list[tuple[bool, int, int, int]]:
    """(DC, symbol, value's bits, how many) of blocks of quantised coefficients in zigzag order, DC being differences."""
    out = []
    for block in blocks:
        filled = np.flatnonzero(block[1:]) + 1
        for k, before in zip([0, *filled.tolist()], [0, 0, *filled.tolist()]):
            value, run = int(block[k]), k - before - 1 if k else 0
            while run > 15:
                out.append((False, 0xF0, 0, 0))
                run -= 16
            size = abs(value).bit_length()
            out.append((k == 0, run << 4 | size, value if value > 0 else value + (1 << size) - 1, size))
        if not len(filled) or filled[-1] < 63:
            out.append((False, 0, 0, 0))
    return out


def steps_for(quality: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps of brightness and colour; 100: all ones."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    return tuple(np.clip((np.array(s) * scale + 50) // 100, 1, 255) for s in (LUMA_STEPS, CHROMA_STEPS))


def encode_jpeg(pixels: np.ndarray, *, quality: int = 90, halved: bool = False, grey: bool = False) -> bytes:
    """A sequential JPEG file of height x width x 3 bytes, with codes made for it. halved: colour at half the width and height; grey: red only."""
    height, width, _ = pixels.shape
    planes = pixels[:, :, :1].astype(float) if grey else pixels.astype(float) @ TO_YCC.T + [0, 128, 128]
    steps, step, units = steps_for(quality), 16 if halved and not grey else 8, []
    down, across = -(-height // step), -(-width // step)
    for c in range(planes.shape[2]):
        plane = np.pad(planes[:, :, c], ((0, down * step - height), (0, across * step - width)), mode="edge")
        if step == 16 and c:
            plane = plane.reshape(down * 8, 2, across * 8, 2).mean((1, 3))
        per = step // 8 if not c else 1
        blocks = plane.reshape(-1, 8, plane.shape[1] // 8, 8).swapaxes(1, 2) - 128
        flat = np.rint((COSINES @ blocks @ COSINES.T).reshape(*blocks.shape[:2], 64) / steps[c > 0])[:, :, ZIGZAG].astype(int)
        own = flat.reshape(down, per, across, per, 64).swapaxes(1, 2).reshape(down * across, per * per, 64)
        own[:, :, 0] = np.diff(own[:, :, 0].ravel(), prepend=0).reshape(own.shape[:2])
        units.append(own)
    rows = [[(c > 0, *s) for s in _symbols(own[i])] for i in range(down * across) for c, own in enumerate(units)]
    counts = {key: Counter(s[2] for row in rows for s in row if (s[0], s[1]) == key) for key in ((False, True), (False, False), (True, True), (True, False))}
    coded = {key: _coded(n) for key, n in counts.items() if n}
    text = "".join(f"{code:0{n}b}" + (f"{value:0{size}b}" if size else "") for row in rows for part, dc, symbol, value, size in row for code, n in [coded[part, dc][1][symbol]])
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda marker, body: bytes([255, marker]) + struct.pack(">H", len(body) + 2) + body
    n = len(units)
    head = struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c + 1, 0x22 if step == 16 and not c else 0x11, int(c > 0)]) for c in range(n))
    tables = b"".join(segment(0xC4, bytes([(not dc) << 4 | part]) + body) for (part, dc), (body, _) in coded.items())
    quant = b"".join(segment(0xDB, bytes([i]) + bytes(steps[i][ZIGZAG].astype(np.uint8))) for i in range(min(n, 2)))
    scan = segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, 0x11 * (c > 0)]) for c in range(n)) + bytes([0, 63, 0]))
    return b"\xff\xd8" + quant + segment(0xC0, head) + tables + scan + data + b"\xff\xd9"
