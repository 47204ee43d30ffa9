"""Frames as pixels: PNG and JPEG in, PNG out, resizing, and tensors.

A frame is a row with height, width and pixels: RGB bytes, row by row. What is done to a frame is a function of its bytes alone; frames are
handed on as soon as they fill a few megabytes. Geometry, names, sampling and everything about tables are column expressions elsewhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ingest import resize_geometry
from .jpeg import PixelError, decode_jpeg, encode_jpeg

# Fixed values of the PNG format: its signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}

FRAME = "height int, width int, pixels binary, error_code string"


#: Bytes of made columns that a task holds before it hands rows on, and rows of an image that are unfiltered at once.
HELD_BYTES, BAND_ROWS = 1 << 24, 256


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise PixelError("NOT_PNG")
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4:
            raise PixelError("TRUNCATED")
        if zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise PixelError("DAMAGED")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise PixelError("TRUNCATED")


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes from rows that start with their filter's number. Left neighbours are ``step`` bytes away."""
    kinds, rows = raw[:, 0], raw[:, 1:].copy()
    if kinds.max() > 4:
        raise PixelError("BAD_FILTER")
    if kinds.max() > 2:
        above = np.zeros(rows.shape[1], np.uint8)
        for at in range(0, len(rows), BAND_ROWS):
            rows[at : at + BAND_ROWS] = _diagonals(kinds[at : at + BAND_ROWS], rows[at : at + BAND_ROWS], above, step)
            above = rows[min(at + BAND_ROWS, len(rows)) - 1]
        return rows
    above = np.zeros(rows.shape[1], np.uint8)
    for kind, row in zip(kinds.tolist(), rows, strict=True):
        if kind == 1:
            for c in range(step):
                np.cumsum(row[c::step], dtype=np.uint8, out=row[c::step])
        elif kind == 2:
            row += above
        above = row
    return rows


def _diagonals(kinds: np.ndarray, rows: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """``_unfiltered`` for all filters: what a place needs lies on the two diagonals before its own, so a diagonal is one operation."""
    height, wide = len(rows), -(-rows.shape[1] // step)
    lanes = np.zeros((height + 1, wide + 1, step), np.int16)  # a row above, a column before
    lanes[0, 1:].reshape(-1)[: len(above)] = above
    lanes[1:, 1:].reshape(height, -1)[:, : rows.shape[1]] = rows
    skewed = np.zeros((height + wide + 1, height + 1, step), np.int16)  # by diagonal and row
    y, x = np.mgrid[0 : height + 1, 0 : wide + 1]
    skewed[(y + x), y] = lanes
    k = kinds[:, None]
    paeth, mean, left_only, none = k == 4, k == 3, k == 1, k == 0
    mixed = not paeth.all()
    for d in range(2, height + wide + 1):
        first, last = max(1, d - wide), min(height, d - 1) + 1  # rows whose place on this diagonal is within the image
        a, b, c = skewed[d - 1, first:last], skewed[d - 1, first - 1 : last - 1], skewed[d - 2, first - 1 : last - 1]
        p, q = b - c, a - c
        pa, pb, pc = np.abs(p), np.abs(q), np.abs(p + q)
        guess = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))
        if mixed:
            own = slice(first - 1, last - 1)
            guess = np.where(paeth[own], guess, np.where(mean[own], a + b >> 1, np.where(left_only[own], a, np.where(none[own], 0, b))))
        skewed[d, first:last] = skewed[d, first:last] + guess & 255
    out = skewed[(y + x)[1:, 1:], y[1:, 1:]].astype(np.uint8)
    return out.reshape(height, -1)[:, : rows.shape[1]]


def decode_png(data: bytes | None) -> np.ndarray:
    """height x width x 3 of bytes, RGB; alpha is dropped, 16 bits become 8. Interlaced images and what isn't PNG raise PixelError."""
    head, palette, body = None, None, []
    for kind, chunk in _chunks(bytes(data or b"")):
        if kind == b"IHDR":
            if len(chunk) != 13:
                raise PixelError("BAD_HEADER")
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            if len(chunk) % 3 or not chunk:
                raise PixelError("BAD_PALETTE")
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
    if head is None or head[3] not in CHANNELS or head[2] not in (1, 2, 4, 8, 16) or not head[0] or not head[1]:
        raise PixelError("BAD_HEADER")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise PixelError("INTERLACED")
    wide = (width * CHANNELS[colour] * depth + 7) // 8
    packed, most = b"".join(body), height * (wide + 1)
    if most > 1100 * len(packed):  # deflate shrinks by less, so the header claims more than there can be
        raise PixelError("TRUNCATED")
    try:
        raw = np.frombuffer(zlib.decompressobj().decompress(packed, most), np.uint8)
    except zlib.error:
        raise PixelError("DAMAGED") from None
    if len(raw) != most:
        raise PixelError("TRUNCATED")
    rows = _unfiltered(raw.reshape(height, wide + 1), max(1, CHANNELS[colour] * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)[:, : width * CHANNELS[colour]]
        rows = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)
        if colour == 0:
            rows = (rows.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    out = rows.reshape(height, width, CHANNELS[colour])
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise PixelError("BAD_PALETTE")
        return palette[out[:, :, 0]]
    return np.repeat(out[:, :, :1], 3, axis=2) if colour in (0, 4) else out[:, :, :3].copy()


def encode_png(pixels: np.ndarray) -> bytes:
    """A PNG file of height x width x 3 bytes; rows are differences from the row above, which flat areas make small."""
    height, width, _ = pixels.shape
    rows = pixels.reshape(height, -1)
    raw = np.empty((height, rows.shape[1] + 1), np.uint8)
    raw[:, 0], raw[0, 1:], raw[1:, 1:] = 2, rows[0], rows[1:] - rows[:-1]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def _area(old: int, new: int) -> np.ndarray:
    """new x old weights: each new place averages the old ones that it covers."""
    edges = np.arange(new + 1) * (old / new)
    cells = np.arange(old)
    return np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None) * (new / old)


def _linear(old: int, new: int) -> np.ndarray:
    """new x old weights: each new place's centre lies between two old centres; beyond the outer ones, the outer one counts."""
    at = np.clip((np.arange(new) + 0.5) * (old / new) - 0.5, 0, old - 1)
    low = np.minimum(at.astype(np.int64), max(old - 2, 0))
    out = np.zeros((new, old))
    out[np.arange(new), low] = 1 - (at - low)
    if old > 1:
        out[np.arange(new), low + 1] += at - low
    return out


def resize(pixels: np.ndarray, width: int, height: int, how: str) -> np.ndarray:
    """Pixels at another size, by ``area`` or ``linear``; rounded to even at ties."""
    weights = {"area": _area, "linear": _linear}[how]
    rows, columns = weights(pixels.shape[0], height), weights(pixels.shape[1], width)
    return np.clip(np.rint(np.einsum("yh,hwc,xw->yxc", rows, pixels.astype(float), columns, optimize=True)), 0, 255).astype(np.uint8)


def decode_image(data: bytes | None) -> np.ndarray:
    """The RGB pixels of a PNG or JPEG file, told apart by their first bytes. PixelError: NOT_IMAGE for anything else."""
    start = bytes(data[:8]) if data else b""
    if start == SIGNATURE:
        return decode_png(data)
    if start[:2] == b"\xff\xd8":
        return decode_jpeg(data)
    raise PixelError("NOT_IMAGE")


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    """df with further columns: each(row of the pandas frame as a namedtuple) -> their values. Rows go on when HELD_BYTES of them are made."""
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(part: pd.DataFrame, made: list[tuple]) -> pd.DataFrame:
        return part.drop(columns=[n for n in names if n in part]).assign(**{n: pd.Series([m[i] for m in made], dtype=object, index=part.index) for i, n in enumerate(names)})

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made, held, start = [], 0, 0
            for at, row in enumerate(part.itertuples(index=False), 1):
                made.append(each(row))
                held += sum(getattr(v, "nbytes", 0) or (len(v) if isinstance(v, bytes) else 0) for v in made[-1])
                if held >= HELD_BYTES or at == len(part):
                    yield rows(part.iloc[start:at], made)
                    made, held, start = [], 0, at

    kept = [f for f in df.schema.fields if f.name not in names]
    return df.mapInPandas(task, T.StructType(kept + T.StructType.fromDDL(schema).fields))


def decode_frames(df: DataFrame, *, data_col: str = "data") -> DataFrame:
    """df with height, width and pixels of the PNG and JPEG files in ``data_col``, or error_code: a bad file is a row with a code, not a failed job."""

    def each(row):
        try:
            got = decode_image(getattr(row, data_col))
        except PixelError as e:
            return None, None, None, e.code
        return got.shape[0], got.shape[1], got.tobytes(), None

    return _mapped(df, FRAME, each)


def resize_frames(df: DataFrame, target_width: int, target_height: int, *, preserve_aspect_ratio: bool = True) -> DataFrame:
    """Frames at the target size: scaled to cover it and cropped at the centre, or else stretched. Rows without pixels stay as they are."""
    if preserve_aspect_ratio:
        shaped = resize_geometry(df, width="width", height="height", target_width=target_width, target_height=target_height)
    else:
        shrinks = (F.lit(target_width) <= F.col("width")) & (F.lit(target_height) <= F.col("height"))
        shaped = df.withColumns({"new_width": F.lit(target_width), "new_height": F.lit(target_height), "left": F.lit(0), "top": F.lit(0), "interpolation": F.when(shrinks, "area").otherwise("linear")})

    def each(row):
        if row.pixels is None:
            return None, None, None
        own = np.frombuffer(row.pixels, np.uint8).reshape(int(row.height), int(row.width), 3)
        own = resize(own, int(row.new_width), int(row.new_height), row.interpolation)
        left, top = int(row.left), int(row.top)
        return target_height, target_width, own[top : top + target_height, left : left + target_width].tobytes()

    return _mapped(shaped, "height int, width int, pixels binary", each).drop("new_width", "new_height", "left", "top", "interpolation").select(*df.columns)


def encode_frames(df: DataFrame, *, to: str = "data", kind: str = "png", **how) -> DataFrame:
    """df with the PNG file of each frame in ``to``, or its JPEG file, made as ``how`` says (quality, halved, grey); null without pixels."""
    if kind not in ("png", "jpeg"):
        raise ValueError(f"no image kind {kind!r}")
    write = encode_png if kind == "png" else lambda p: encode_jpeg(p, **how)
    return _mapped(df, f"{to} binary", lambda r: (None if r.pixels is None else write(np.frombuffer(r.pixels, np.uint8).reshape(int(r.height), int(r.width), 3)),))


def to_planes(df: DataFrame, *, to: str = "planes") -> DataFrame:
    """df with the array of floats ``to``: three planes, red, green and blue, of values from 0 to 1."""
    return _mapped(df, f"{to} array<float>", lambda r: (None if r.pixels is None else (np.frombuffer(r.pixels, np.uint8).reshape(-1, 3).T.astype(np.float32) / np.float32(255)).ravel(),))


def from_planes(df: DataFrame, *, planes_col: str = "planes") -> DataFrame:
    """df with pixels of the planes: clamped to 0 to 1, times 255, rounded to even at ties."""

    def each(row):
        planes = getattr(row, planes_col)
        if planes is None:
            return (None,)
        own = np.asarray(planes, np.float32)
        if own.size != 3 * int(row.height) * int(row.width):
            raise ValueError(f"{own.size} values aren't three planes of {row.height} x {row.width}")
        return (np.rint(np.clip(own, 0, 1) * np.float32(255)).astype(np.uint8).reshape(3, -1).T.tobytes(),)

    return _mapped(df, "pixels binary", each)
