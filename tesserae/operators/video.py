"""Video containers without a decoder: what a file says about itself, where its frames lie, and the pixels of those that are images.

ISO base media (.mp4, .mov), RIFF (.avi) and EBML (.mkv, .webm) files are walked by their boxes' headers with ranged reads. Frames of
uncompressed and motion-JPEG streams can be decoded; of all others the bytes can be had, and asking for pixels gives a code.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from .jpeg import PixelError, decode_jpeg
from .pixels import FRAME, _mapped

#: What a stream's code stands for, where its frames can be decoded.
JPEG_CODECS = ("MJPG", "mjpg", "jpeg", "mjpa", "AVRn", "dmb1", "V_MJPEG")
RAW_CODECS = {"raw-bgr": 3, "raw-bgrx": 4, "raw-rgb": 3, "I420": 1.5, "IYUV": 1.5, "YV12": 1.5, "YUY2": 2, "UYVY": 2}


class VideoError(ValueError):
    """A file that isn't a sound video of a known container; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


class Ranges:
    """Reads of byte ranges, a few kilobytes at least at a time; ``taken`` counts the bytes asked of the file."""

    AHEAD = 4096

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at, self.size, self.taken, self.at, self.held = read_at, size, 0, 0, b""

    def __call__(self, at: int, n: int) -> bytes:
        if at < 0 or n < 0 or at + n > self.size:
            raise VideoError("TRUNCATED")
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.at, self.held = at, self.read_at(at, min(max(n, self.AHEAD), self.size - at))
            self.taken += len(self.held)
            if len(self.held) < n:
                raise VideoError("TRUNCATED")
        return self.held[at - self.at : at - self.at + n]

    def number(self, at: int, n: int, order: str = "big") -> int:
        return int.from_bytes(self(at, n), order)


@dataclass
class Video:
    """A file's first video stream. ``locate`` gives the frames' places: arrays of offsets and sizes."""

    container: str
    codec: str
    width: int
    height: int
    fps: float | None
    frame_count: int | None
    locate: Callable[[], tuple[np.ndarray, np.ndarray]] = field(repr=False)
    top_down: bool = True


# -- ISO base media -------------------------------------------------------------------------------------------------------------------

_MASTERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"moof", b"traf", b"mvex"}


def _boxes(read: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of the boxes between two places."""
    while at + 8 <= end:
        size, kind = read.number(at, 4), read(at + 4, 4)
        body = at + 8
        if size == 1:
            size, body = read.number(at + 8, 8), at + 16
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise VideoError("TRUNCATED" if at + size > end else "CORRUPT")
        yield kind, body, at + size
        at += size


def _tree(read: Ranges, at: int, end: int) -> dict:
    """Boxes by kind: a list of trees where they hold others, of (start, end) where not."""
    out: dict = {}
    for kind, body, stop in _boxes(read, at, end):
        out.setdefault(kind, []).append(_tree(read, body, stop) | {"moof": body - 8} if kind in _MASTERS else (body, stop))
    return out


def _table(read: Ranges, box: tuple[int, int], at: int, count: int, fields: str) -> np.ndarray:
    kind = np.dtype(fields)
    if box[0] + at + count * kind.itemsize > box[1]:
        raise VideoError("CORRUPT")
    return np.frombuffer(read(box[0] + at, count * kind.itemsize), kind)


def _iso(read: Ranges) -> Video:
    top = _tree(read, 0, read.size)
    if b"moov" not in top:
        raise VideoError("CORRUPT")
    for trak in top[b"moov"][0].get(b"trak", []):
        media = trak.get(b"mdia", [{}])[0]
        handler = media.get(b"hdlr")
        if handler and read(handler[0][0] + 8, 4) == b"vide":
            break
    else:
        raise VideoError("NO_VIDEO")
    try:
        head, stbl = media[b"mdhd"][0], media[b"minf"][0][b"stbl"][0]
        entry, sizes = stbl[b"stsd"][0][0] + 8, stbl[b"stsz"][0]
    except (KeyError, IndexError):
        raise VideoError("CORRUPT") from None
    wide = read.number(head[0], 1) == 1
    scale, length = read.number(head[0] + (20 if wide else 12), 4), read.number(head[0] + (24 if wide else 16), 8 if wide else 4)
    codec = read(entry + 4, 4).decode("latin-1")
    width, height, depth = read.number(entry + 32, 2), read.number(entry + 34, 2), read.number(entry + 82, 2)
    if codec == "raw ":
        codec = {24: "raw-rgb"}.get(depth, codec)
    track = read.number(trak[b"tkhd"][0][0] + (20 if read.number(trak[b"tkhd"][0][0], 1) == 1 else 12), 4) if b"tkhd" in trak else 0
    count = read.number(sizes[0] + 8, 4)
    pieces = [f for moof in top.get(b"moof", []) for f in _fragments(read, moof, track)] if not count else []
    if pieces:
        count, length = sum(len(p[1]) for p in pieces), sum(p[2] for p in pieces)
    fps = count * scale / length if count and scale and length else None

    def locate() -> tuple[np.ndarray, np.ndarray]:
        if pieces:
            return np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        alike = read.number(sizes[0] + 4, 4)
        own = np.full(count, alike, np.int64) if alike else _table(read, sizes, 12, count, ">u4").astype(np.int64)
        box, kind = next(((stbl[k][0], t) for k, t in ((b"stco", ">u4"), (b"co64", ">u8")) if k in stbl), (None, None))
        if box is None or b"stsc" not in stbl:
            raise VideoError("CORRUPT")
        chunks = _table(read, box, 8, read.number(box[0] + 4, 4), kind).astype(np.int64)
        runs = _table(read, stbl[b"stsc"][0], 8, read.number(stbl[b"stsc"][0][0] + 4, 4), ">u4,>u4,>u4")
        firsts = runs["f0"].astype(np.int64) - 1
        spans = np.diff(np.append(firsts, len(chunks)))
        if len(firsts) and (firsts[0] != 0 or (spans < 0).any()):
            raise VideoError("CORRUPT")
        per = np.repeat(runs["f1"].astype(np.int64), spans)
        if per.sum() < count:
            raise VideoError("CORRUPT")
        chunk = np.repeat(np.arange(len(per)), np.minimum(per, count))[:count]
        before = np.cumsum(own) - own
        first_of = np.concatenate([[0], np.cumsum(per)[:-1]])[chunk]
        return chunks[chunk] + before - before[np.minimum(first_of, max(count - 1, 0))], own

    return Video("iso", codec, width, height, fps, count or None, locate)


def _fragments(read: Ranges, moof: dict, track: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(offsets, sizes, ticks) of a track's runs in a movie fragment."""
    for traf in moof.get(b"traf", []):
        at = traf[b"tfhd"][0][0]
        flags, own = read.number(at, 4) & 0xFFFFFF, read.number(at + 4, 4)
        if track and own != track:
            continue
        at += 8
        base = moof["moof"]
        fixed = {}
        for bit, n in ((1, 8), (2, 4), (8, 4), (16, 4), (32, 4)):
            if flags & bit:
                fixed[bit] = read.number(at, n)
                at += n
        base, next_at = fixed.get(1, base), None
        for run in traf.get(b"trun", []):
            flags, count, at = read.number(run[0], 4) & 0xFFFFFF, read.number(run[0] + 4, 4), run[0] + 8
            start = next_at if next_at is not None else base
            if flags & 1:
                start = base + struct.unpack(">i", read(at, 4))[0]
                at += 4
            at += 4 * bool(flags & 4)
            wide = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            rows = _table(read, run, at - run[0], count * len(wide), ">u4").reshape(count, -1).astype(np.int64) if wide else np.zeros((count, 0), np.int64)
            sizes = rows[:, wide.index(0x200)] if 0x200 in wide else np.full(count, fixed.get(16, 0))
            ticks = int(rows[:, wide.index(0x100)].sum()) if 0x100 in wide else count * fixed.get(8, 0)
            yield start + np.cumsum(sizes) - sizes, sizes, ticks
            next_at = start + int(sizes.sum())


# -- RIFF -----------------------------------------------------------------------------------------------------------------------------


def _chunks(read: Ranges, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start of the body, end) of RIFF chunks; a list's kind is that of its contents."""
    while at + 8 <= end:
        kind, size = read(at, 4), read.number(at + 4, 4, "little")
        stop = min(at + 8 + size, end)
        if kind in (b"LIST", b"RIFF") and size >= 4:
            yield kind + b":" + read(at + 8, 4), at + 12, stop
        else:
            yield kind, at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def _avi(read: Ranges) -> Video:
    stream, found, movies, index, riffs = -1, None, [], None, 0
    for kind, body, stop in _chunks(read, 0, read.size):
        if kind not in (b"RIFF:AVI ", b"RIFF:AVIX"):
            continue
        riffs += 1
        for part, start, end in _chunks(read, body, stop):
            if part == b"LIST:hdrl":
                for own, a, b in _chunks(read, start, end):
                    if own == b"LIST:strl":
                        stream += 1
                        parts = {k: (x, y) for k, x, y in _chunks(read, a, b)}
                        if found is None and b"strh" in parts and b"strf" in parts and read(parts[b"strh"][0], 4) == b"vids":
                            found = stream, parts[b"strh"][0], parts[b"strf"][0]
            elif part == b"LIST:movi":
                movies.append((start, end))
            elif part == b"idx1":
                index = start, end
    if found is None:
        raise VideoError("CORRUPT" if stream < 0 else "NO_VIDEO")
    number, head, form = found
    scale, rate, length = (read.number(head + i, 4, "little") for i in (20, 24, 32))
    width, height = struct.unpack("<ii", read(form + 4, 8))
    depth, compression = read.number(form + 14, 2, "little"), read(form + 16, 4)
    codec = {24: "raw-bgr", 32: "raw-bgrx"}.get(depth, "raw") if compression in (b"\0\0\0\0", b"DIB ", b"RGB ", b"RAW ") else compression.decode("latin-1")

    def own(kind: bytes) -> bool:
        return kind[:2] == f"{number:02d}".encode() and kind[2:4] in (b"db", b"dc")

    def walked(start: int, end: int) -> Iterator[tuple[int, int]]:
        for kind, body, stop in _chunks(read, start, end):
            if kind == b"LIST:rec ":
                yield from walked(body, stop)
            elif own(kind):
                yield body, stop - body

    def locate() -> tuple[np.ndarray, np.ndarray]:
        places: np.ndarray
        if index and riffs == 1 and movies:
            rows = np.frombuffer(read(index[0], (index[1] - index[0]) // 16 * 16), "S4,<u4,<u4,<u4")
            rows = rows[[own(k) for k in rows["f0"].tolist()]]
            offsets, sizes = rows["f2"].astype(np.int64), rows["f3"].astype(np.int64)
            # places count from the list's name, in some files from the start
            base = 0 if len(offsets) and offsets[0] >= movies[0][0] else movies[0][0] - 4
            places = np.stack([offsets + base + 8, sizes], axis=1)
        else:
            places = np.array([p for m in movies for p in walked(*m)], np.int64).reshape(-1, 2)
        places = places[places[:, 1] > 0]  # frames of no bytes repeat the one before
        return places[:, 0], places[:, 1]

    return Video("riff", codec, width, abs(height), rate / scale if rate and scale else None, length or None, locate, height < 0)


# -- EBML -----------------------------------------------------------------------------------------------------------------------------

# Fixed values of the Matroska format: elements by id. Those of _OPEN hold others and are walked into.
_SEGMENT, _CLUSTER, _TRACK_ENTRY = 0x18538067, 0x1F43B675, 0xAE
_OPEN = {_SEGMENT, _CLUSTER, 0x1549A966, 0x1654AE6B, _TRACK_ENTRY, 0xE0, 0xA0}
_NAMES = {0x2AD7B1: "scale", 0x4489: "length", 0xD7: "number", 0x83: "type", 0x86: "codec", 0x23E383: "each", 0xB0: "width", 0xBA: "height", 0x2EB524: "fourcc"}
_BLOCKS = {0xA3, 0xA1}


def _vint(read: Ranges, at: int, keep: bool) -> tuple[int, int]:
    """(number, bytes) of a number of variable length; with its marker bit if keep is set."""
    first = read.number(at, 1)
    n = 9 - first.bit_length()
    if n > 8:
        raise VideoError("CORRUPT")
    value = read.number(at, n)
    return (value if keep else value & (1 << 7 * n) - 1), n


def _elements(read: Ranges, at: int, until_cluster: bool) -> Iterator[tuple[int, int, int]]:
    """(id, start of the body, size) in file order, those that hold others before what they hold."""
    while at + 2 <= read.size:
        key, n = _vint(read, at, True)
        size, m = _vint(read, at + n, False)
        body = at + n + m
        if key == _CLUSTER and until_cluster:
            return
        yield key, body, size
        at = body if key in _OPEN else body + size


def _ebml(read: Ranges) -> Video:
    tracks: list[dict] = []
    info = {"scale": 1_000_000}
    for key, body, size in _elements(read, 0, True):
        if key == _TRACK_ENTRY:
            tracks.append({})
        elif key in _NAMES:
            if body + size > read.size or size > 1 << 16:
                raise VideoError("TRUNCATED")
            raw, name = read(body, size), _NAMES[key]
            value = raw.rstrip(b"\0").decode("latin-1") if name in ("codec", "fourcc") else struct.unpack({4: ">f", 8: ">d"}[size], raw)[0] if name == "length" and size in (4, 8) else int.from_bytes(raw, "big")
            (info if name in ("scale", "length") or not tracks else tracks[-1])[name] = value
    track = next((t for t in tracks if t.get("type") == 1), None)
    if track is None:
        raise VideoError("NO_VIDEO" if tracks else "CORRUPT")
    codec = track.get("codec", "")
    if codec == "V_UNCOMPRESSED":
        codec = {"RGB\x18": "raw-rgb", "BGR\x18": "raw-bgr"}.get(track.get("fourcc", ""), track.get("fourcc", codec))
    fps = 1e9 / track["each"] if track.get("each") else None
    seconds = info["length"] * info["scale"] / 1e9 if info.get("length") else None
    count = int(seconds * fps + 0.5) if seconds and fps else None

    def locate() -> tuple[np.ndarray, np.ndarray]:
        places = []
        for key, body, size in _elements(read, 0, False):
            if key in _BLOCKS:
                own, n = _vint(read, body, False)
                if own != track.get("number", 1):
                    continue
                if read.number(body + n + 2, 1) & 6:
                    raise VideoError("UNSUPPORTED")  # several frames in a block
                places.append((body + n + 3, size - n - 3))
        both = np.array(places, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    return Video("ebml", codec, track.get("width", 0), track.get("height", 0), fps, count, locate)


# -- all ------------------------------------------------------------------------------------------------------------------------------


def open_video(read: Ranges) -> Video:
    """The container's first video stream; VideoError with NOT_VIDEO, NO_VIDEO, CORRUPT or TRUNCATED."""
    try:
        start = read(0, min(12, read.size))
        if start[:4] == b"RIFF" and start[8:12] == b"AVI ":
            video = _avi(read)
        elif start[:4] == b"\x1a\x45\xdf\xa3":
            video = _ebml(read)
        elif start[4:8] in (b"ftyp", b"moov", b"mdat", b"wide", b"free", b"skip"):
            video = _iso(read)
        else:
            raise VideoError("NOT_VIDEO")
    except (struct.error, IndexError, ValueError, OverflowError, KeyError, MemoryError, RecursionError) as e:
        raise e if isinstance(e, VideoError) else VideoError("CORRUPT") from None
    if video.width <= 0 or video.height <= 0:
        raise VideoError("CORRUPT")
    return video


def places(read: Ranges, video: Video) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and sizes of all frames; VideoError where they aren't within the file, or there are none."""
    try:
        offsets, sizes = video.locate()
    except (struct.error, IndexError, ValueError, OverflowError, KeyError, MemoryError) as e:
        raise e if isinstance(e, VideoError) else VideoError("CORRUPT") from None
    if not len(offsets):
        raise VideoError("CORRUPT")
    if offsets.min() < 0 or sizes.min() < 0 or (offsets + sizes).max() > read.size:
        raise VideoError("TRUNCATED")
    return offsets, sizes


def decode_sample(data: bytes, codec: str, width: int, height: int, top_down: bool = True) -> np.ndarray:
    """A frame's RGB pixels. PixelError: UNSUPPORTED_CODEC for streams that need more than their own frame's bytes, TRUNCATED, and JPEG's."""
    if codec in JPEG_CODECS:
        return decode_jpeg(data)
    if codec not in RAW_CODECS:
        raise PixelError("UNSUPPORTED_CODEC")
    raw = np.frombuffer(data, np.uint8)
    if codec.startswith("raw-"):
        per = RAW_CODECS[codec]
        line = width * per if codec == "raw-rgb" else -(-width * per // 4) * 4  # rows of bitmaps fill whole words
        if len(raw) < line * height:
            raise PixelError("TRUNCATED")
        own = raw[: line * height].reshape(height, line)[:, : width * per].reshape(height, width, per)[:, :, :3]
        own = own if codec == "raw-rgb" else own[:, :, ::-1]
        return np.ascontiguousarray(own if top_down or codec == "raw-rgb" else own[::-1])
    half_w, half_h = -(-width // 2), -(-height // 2)
    if codec in ("YUY2", "UYVY"):
        if len(raw) < 4 * half_w * height:
            raise PixelError("TRUNCATED")
        pairs = raw[: 4 * half_w * height].reshape(height, half_w, 4)
        at = (0, 1, 2, 3) if codec == "YUY2" else (1, 0, 3, 2)
        y = pairs[:, :, [at[0], at[2]]].reshape(height, -1)[:, :width]
        u, v = (np.repeat(pairs[:, :, at[i]], 2, axis=1)[:, :width] for i in (1, 3))
    else:
        cuts = np.cumsum([width * height, half_w * half_h, half_w * half_h])
        if len(raw) < cuts[2]:
            raise PixelError("TRUNCATED")
        y = raw[: cuts[0]].reshape(height, width)
        planes = [np.repeat(np.repeat(raw[a:b].reshape(half_h, half_w), 2, axis=0), 2, axis=1)[:height, :width] for a, b in ((cuts[0], cuts[1]), (cuts[1], cuts[2]))]
        u, v = planes[::-1] if codec == "YV12" else planes
    # studio range: black is 16, white 235
    y, u, v = 1.164383 * (y.astype(float) - 16), u.astype(float) - 128, v.astype(float) - 128
    return np.clip(np.rint(np.stack([y + 1.596027 * v, y - 0.391762 * u - 0.812968 * v, y + 2.017232 * u], axis=2)), 0, 255).astype(np.uint8)


def decode_samples(df: DataFrame) -> DataFrame:
    """df (data, codec, width, height, top_down, and error_code of the source) with height, width, pixels and error_code."""

    def each(row):
        if row.data is None:
            return None, None, None, row.error_code
        try:
            got = decode_sample(bytes(row.data), row.codec, int(row.width), int(row.height), bool(row.top_down))
        except PixelError as e:
            return None, None, None, e.code
        return got.shape[0], got.shape[1], got.tobytes(), None

    return _mapped(df, FRAME, each)


def write_avi(samples: list[bytes], *, codec: str, width: int, height: int, rate: int = 25, scale: int = 1) -> bytes:
    """An AVI file of frames that are encoded already: MJPG, or raw-bgr with its rows from the bottom up and filled to whole words."""
    part = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    listed = lambda kind, body: part(b"LIST", kind + body)
    four, name = (b"\0\0\0\0", b"00db") if codec == "raw-bgr" else (codec.encode(), b"00dc")
    most = max(map(len, samples), default=0)
    main = struct.pack("<14I", 1_000_000 * scale // rate, 0, 0, 16, len(samples), 0, 1, most, width, height, 0, 0, 0, 0)
    head = b"vids" + four + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, scale, rate, 0, len(samples), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, four, most, 0, 0, 0, 0)
    movie, index, at = [], [], 4
    for s in samples:
        index.append(name + struct.pack("<III", 16, at, len(s)))
        movie.append(part(name, s))
        at += len(movie[-1])
    body = listed(b"hdrl", part(b"avih", main) + listed(b"strl", part(b"strh", head) + part(b"strf", form))) + listed(b"movi", b"".join(movie)) + part(b"idx1", b"".join(index))
    return part(b"RIFF", b"AVI " + body)


def bitmap_rows(pixels: np.ndarray) -> bytes:
    """RGB pixels as a raw-bgr frame."""
    height, width, _ = pixels.shape
    return np.pad(pixels[::-1, :, ::-1].reshape(height, -1), ((0, 0), (0, -3 * width % 4))).tobytes()
