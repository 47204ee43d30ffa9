import struct

import numpy as np
import pytest

from tesserae.operators import jpeg, pixels, video
from tesserae.sources import video as source


def solid(i, height=48, width=64):
    """The i-th frame of a synthetic video."""
    return np.full((height, width, 3), i * 20 % 256, np.uint8)


def picture(i, height=48, width=64):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([(x * 3 + i) % 256, (y * 4 + i) % 256, (x + y + 5 * i) % 256], axis=2).astype(np.uint8)


def avi(n=10, codec="MJPG", make=solid, **how):
    frames = [make(i) for i in range(n)]
    coded = [jpeg.encode_jpeg(f, quality=100) if codec == "MJPG" else video.bitmap_rows(f) for f in frames]
    return video.write_avi(coded, codec=codec, height=frames[0].shape[0], width=frames[0].shape[1], **({"rate": 10} | how))


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *parts):
    return box(kind, bytes(4), *parts)


def entry(codec, width, height, depth=24):
    return full(b"stsd", struct.pack(">I", 1), box(codec, bytes(24), struct.pack(">HH", width, height), bytes(46), struct.pack(">H", depth), b"\xff\xff"))


def track(tables, *, ticks, scale=600, kind=b"vide", number=1):
    head = full(b"mdhd", struct.pack(">IIII", 0, 0, scale, ticks), bytes(4))
    return box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, number), bytes(68)), box(b"mdia", head, full(b"hdlr", bytes(4), kind, bytes(12)), box(b"minf", box(b"stbl", *tables))))


def mp4(samples, *, codec=b"jpeg", width=64, height=48, per=(3, 2), first=False, wide=False, ticks=None, depth=24):
    """Samples in chunks of per[0], the last of those left, behind or before the index; a sound track comes first."""
    groups, at = [], 0
    while at < len(samples):
        n = per[len(groups) % len(per)]
        groups.append(samples[at : at + n])
        at += n

    def index(start):
        offsets, runs, at = [], [], start
        for k, g in enumerate(groups):
            offsets.append(at)
            at += sum(map(len, g)) + 5  # other data between chunks
            if not runs or runs[-1][1] != len(g):
                runs.append((k + 1, len(g)))
        alike = len({len(s) for s in samples}) == 1
        sizes = full(b"stsz", struct.pack(">II", len(samples[0]) if alike else 0, len(samples)), b"" if alike else b"".join(struct.pack(">I", len(s)) for s in samples))
        chunk = full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), b"".join(struct.pack(">Q" if wide else ">I", o) for o in offsets))
        tables = [entry(codec, width, height, depth), sizes, full(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", a, b, 1) for a, b in runs)), chunk]
        return box(b"moov", full(b"mvhd", bytes(96)), track([], ticks=1, kind=b"soun"), track(tables, ticks=60 * len(samples) if ticks is None else ticks))

    data = b"".join(b"".join(g) + b"audio" for g in groups)
    start = box(b"ftyp", b"isom", bytes(4))
    if first:
        return start + index(len(start) + len(index(0)) + 8) + box(b"mdat", data)
    return start + box(b"mdat", data) + index(len(start) + 8)


def fragmented(samples, codec=b"jpeg"):
    out = box(b"ftyp", b"iso5", bytes(4)) + box(b"moov", full(b"mvhd", bytes(96)), track([entry(codec, 64, 48), full(b"stsz", bytes(8)), full(b"stsc", bytes(4)), full(b"stco", bytes(4))], ticks=0), box(b"mvex"))
    for k in range(0, len(samples), 4):
        own = samples[k : k + 4]
        rows = b"".join(struct.pack(">II", 60, len(s)) for s in own)

        def moof(at, own=own, rows=rows):
            run = box(b"trun", struct.pack(">II", 0x301, len(own)), struct.pack(">i", at), rows)
            return box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", box(b"tfhd", struct.pack(">II", 0x020000, 1)), run))

        out += moof(len(moof(0)) + 8) + box(b"mdat", b"".join(own))
    return out


def element(key, *parts, unknown=False):
    body = b"".join(parts)
    name = key.to_bytes((key.bit_length() + 7) // 8, "big")
    return name + (b"\x01" + b"\xff" * 7 if unknown else struct.pack(">Q", len(body) | 1 << 56)) + body


def number(key, value):
    return element(key, value.to_bytes(4, "big"))


def mkv(samples, *, codec=b"V_MJPEG", width=64, height=48, unknown=False, each=100_000_000, more=b""):
    info = element(0x1549A966, number(0x2AD7B1, 1_000_000), element(0x4489, struct.pack(">d", len(samples) * 100.0)))
    sound = element(0xAE, number(0xD7, 2), number(0x83, 2), element(0x86, b"A_PCM"))
    own = element(0xAE, number(0xD7, 1), number(0x83, 1), element(0x86, codec), number(0x23E383, each), element(0xE0, number(0xB0, width), number(0xBA, height), more))
    clusters = []
    for k in range(0, len(samples), 3):
        blocks = [element(0xA3, b"\x82\0\0\0sound")]
        for i, s in enumerate(samples[k : k + 3]):
            blocks.append(element(0xA3, b"\x81\0\0\x80" + s) if i % 2 == 0 else element(0xA0, element(0xA1, b"\x81\0\0\0" + s)))
        clusters.append(element(0x1F43B675, number(0xE7, k), *blocks, unknown=unknown))
    return element(0x1A45DFA3, element(0x4282, b"matroska")) + element(0x18538067, info, element(0x1654AE6B, sound, own), *clusters, unknown=unknown)


def opened(data):
    read = video.Ranges(lambda at, n: data[at : at + n], len(data))
    return read, video.open_video(read)


SAMPLES = [jpeg.encode_jpeg(picture(i), quality=100) + bytes(20_000) for i in range(10)]  # what follows the image's end doesn't matter
FILES = {
    "avi": video.write_avi(SAMPLES, codec="MJPG", width=64, height=48, rate=10), "mp4": mp4(SAMPLES), "first": mp4(SAMPLES, first=True), "wide": mp4(SAMPLES, wide=True, per=(1,)), "one": mp4(SAMPLES, per=(10,)), "fragments": fragmented(SAMPLES),
    "mkv": mkv(SAMPLES), "webm": mkv(SAMPLES, unknown=True),
}


@pytest.mark.parametrize("name", FILES)
def test_every_container(name):
    data = FILES[name]
    read, found = opened(data)
    assert (found.width, found.height, found.frame_count) == (64, 48, 10) and abs(found.fps - 10) < 1e-9
    assert read.taken < 50_000 < len(data)  # headers, not frames
    offsets, sizes = video.places(read, found)
    assert [data[o : o + s] for o, s in zip(offsets.tolist(), sizes.tolist())] == SAMPLES
    got = video.decode_sample(data[offsets[7] : offsets[7] + sizes[7]], found.codec, 64, 48)
    assert np.abs(got.astype(int) - jpeg.decode_jpeg(SAMPLES[7])).max() == 0


def test_walked_and_indexed_avi_agree():
    data = avi(7)
    at = data.rindex(b"idx1")
    bare = data[:at]
    bare = b"RIFF" + struct.pack("<I", len(bare) - 8) + bare[8:]
    twice = bare + b"RIFF" + struct.pack("<I", 4 + 12 + 8 + 4) + b"AVIX" + b"LIST" + struct.pack("<I", 4 + 8 + 4) + b"movi" + b"00dc" + struct.pack("<I", 4) + b"more"
    places = [video.places(*opened(x)) for x in (data, bare, twice)]
    assert (places[0][0] == places[1][0]).all() and (places[0][1] == places[1][1]).all()
    assert len(places[2][0]) == 8 and twice[places[2][0][-1] :][:4] == b"more"


@pytest.mark.parametrize("width", [1, 3, 64])
def test_uncompressed_frames(width):
    frames = [picture(i, 5, width) for i in range(3)]
    data = video.write_avi([video.bitmap_rows(f) for f in frames], codec="raw-bgr", width=width, height=5)
    read, found = opened(data)
    for f, o, s in zip(frames, *video.places(read, found)):
        assert (video.decode_sample(data[o : o + s], found.codec, width, 5, found.top_down) == f).all()
    raw = mp4([f.tobytes() for f in frames], codec=b"raw ", width=width, height=5)
    read, found = opened(raw)
    o, s = video.places(read, found)
    assert found.codec == "raw-rgb" and (video.decode_sample(raw[o[2] : o[2] + s[2]], "raw-rgb", width, 5) == frames[2]).all()


def test_luma_and_chroma_streams():
    grey = np.repeat(np.arange(16, 236, 20, dtype=np.uint8), 2)[None, :].repeat(4, axis=0)
    want = np.rint((grey.astype(float) - 16) * 255 / 219)
    planar = grey.tobytes() + bytes([128]) * (2 * 2 * 11)
    packed = np.stack([grey[:, ::2], np.full((4, 11), 128, np.uint8), grey[:, 1::2], np.full((4, 11), 128, np.uint8)], axis=2)
    for codec, data in (("I420", planar), ("YV12", planar), ("YUY2", packed.tobytes()), ("UYVY", packed[:, :, [1, 0, 3, 2]].tobytes())):
        assert np.abs(video.decode_sample(data, codec, 22, 4) - want[:, :, None]).max() <= 1
    red = bytes([81]) * 16 + bytes([90]) * 4 + bytes([240]) * 4  # red in studio range
    assert np.abs(video.decode_sample(red, "I420", 4, 4)[0, 0].astype(int) - [255, 0, 0]).max() <= 2


def test_codes_of_bad_files():
    for data, code in (
        (b"", "NOT_VIDEO"), (b"not a real video file" * 10, "NOT_VIDEO"), (box(b"ftyp", b"isom"), "CORRUPT"), (FILES["first"][:200], "TRUNCATED"), (mp4(SAMPLES, width=0), "CORRUPT"),
        (box(b"ftyp", b"isom") + box(b"moov", track([], ticks=1, kind=b"soun")), "NO_VIDEO"), (b"RIFF\4\0\0\0AVI ", "CORRUPT"), (element(0x1A45DFA3, b"") + element(0x18538067, b""), "CORRUPT"),
    ):
        with pytest.raises(video.VideoError) as e:
            video.places(*opened(data))
        assert e.value.code == code, data[:40]
    for name in ("first", "one", "mkv"):  # an index that promises more than there is
        with pytest.raises(video.VideoError):
            data = FILES[name][: len(FILES[name]) * 3 // 4] if name != "one" else FILES[name][:100]
            video.places(*opened(data))
    for codec, data, code in (("avc1", b"x", "UNSUPPORTED_CODEC"), ("raw-bgr", b"x", "TRUNCATED"), ("YUY2", b"x", "TRUNCATED"), ("I420", b"x", "TRUNCATED"), ("MJPG", b"x", "NOT_JPEG")):
        with pytest.raises(jpeg.PixelError) as e:
            video.decode_sample(data, codec, 8, 8)
        assert e.value.code == code


@pytest.mark.parametrize("name", ["avi", "mp4", "fragments", "mkv", "webm"])
def test_any_byte_of_a_header_may_be_wrong(name):
    data = FILES[name]
    small = {"mp4": range(len(data) - 700, len(data))}.get(name, range(700))
    for at in small:
        for bad in (data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :], data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]):
            try:
                video.places(*opened(bad))
            except video.VideoError:
                pass


def test_streams_without_code_tables():
    """Frames of cameras leave the usual tables out."""
    usual = jpeg._usual_codes()
    assert [len(s) for _, s in usual.values()] == [12, 12, 162, 162] and all(sum(c) == len(s) == len(set(s)) for c, s in usual.values())
    plane = picture(3)[:, :, 0]
    blocks = np.rint(plane.reshape(6, 8, 8, 8).swapaxes(1, 2).reshape(-1, 64).mean(1)).astype(int) - 128  # flat blocks: DC only
    codes, code, at = {}, 0, 0
    for n, count in enumerate(usual[0][0], 1):
        for s in usual[0][1][at : at + count]:
            codes[s] = f"{code:0{n}b}"
            code += 1
        at, code = at + count, code << 1
    text, last = "", 0
    for v in blocks * 8:
        d, last = int(v) - last, int(v)
        size = abs(d).bit_length()
        text += codes[size] + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "") + "1010"  # 1010: no more in the block
    text += "1" * (-len(text) % 8)
    seg = lambda m, b: bytes([255, m]) + struct.pack(">H", len(b) + 2) + b
    head = seg(0xDB, b"\0" + bytes([1] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, 48, 64, 1) + bytes([1, 0x11, 0])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    got = jpeg.decode_jpeg(b"\xff\xd8" + head + int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9")
    assert (got.reshape(6, 8, 8, 8, 3)[:, 0, :, 0, 0] == (blocks + 128).reshape(6, 8)).all()


def test_probing_a_folder(spark, tmp_path):
    made = {"a.avi": FILES["avi"], "b.MP4": FILES["mp4"], "c.mkv": FILES["mkv"], "d.mp4": b"not a real video file" * 10, "e.txt": FILES["avi"], "f.mov": FILES["first"][:300], "g.mp4": mp4(SAMPLES, ticks=0), "h.webm": mkv(SAMPLES, each=0)}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    paths = spark.createDataFrame([(f"{tmp_path}/{n}",) for n in [*made, "absent.mp4"]] + [(None,)], "path string")
    got = {r.filename: r for r in source.probe_videos(paths).collect()}
    assert {k: r.error_code for k, r in got.items()} == {"a.avi": None, "b.MP4": None, "c.mkv": None, "d.mp4": "NOT_VIDEO", "e.txt": "UNSUPPORTED_FORMAT", "f.mov": "TRUNCATED", "g.mp4": None, "h.webm": None, "absent.mp4": "NOT_FOUND", None: "NOT_FOUND"}
    for name in ("a.avi", "b.MP4", "c.mkv"):
        r = got[name]
        assert (r.width, r.height, r.frame_count, round(r.fps, 6), round(r.duration_seconds, 6), r.file_size_bytes) == (64, 48, 10, 10.0, 1.0, len(made[name])) and r.header_bytes < 50_000
    assert (got["g.mp4"].fps, got["g.mp4"].frame_count, got["g.mp4"].duration_seconds) == (None, 10, None) and got["h.webm"].frame_count is None


def test_a_long_file_is_shared_out(spark, tmp_path):
    (tmp_path / "long.avi").write_bytes(avi(60))
    (tmp_path / "short.mp4").write_bytes(FILES["mp4"])
    (tmp_path / "bad.mkv").write_bytes(b"bad")
    (tmp_path / "readme.txt").write_bytes(b"ignored")
    source.register(spark)
    read = spark.read.format("video").option("path", str(tmp_path)).option("taskBytes", 8_000)
    rows = read.option("every", 7).load()
    assert rows.rdd.getNumPartitions() > 3
    got = rows.select("item", "frame_index", "sample_index", "error_code").collect()
    shares = rows.select("item").rdd.mapPartitions(lambda part: [{r.item for r in part}]).collect()
    assert sorted((r.item, r.frame_index, r.sample_index) for r in got if r.item != "bad") == [("long", 7 * k, k + 1) for k in range(9)] + [("short", 0, 1), ("short", 7, 2)]
    assert [(r.item, r.error_code) for r in got if r.error_code] == [("bad", "NOT_VIDEO")] and sum("long" in s for s in shares) > 2
    assert read.option("every", 1).option("payload", "false").load().where("data is null and item = 'long'").count() == 60


def test_bounds_on_the_frame_reach_the_reader(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    (tmp_path / "x.avi").write_bytes(avi(20))
    reader = source.VideoSource({"path": str(tmp_path)}).reader(None)
    list(reader.pushFilters([GreaterThanOrEqual(("frame_index",), 5), LessThan(("frame_index",), 8)]))
    assert [row[2] for part in reader.partitions() for row in reader.read(part)] == [5, 6, 7]


@pytest.mark.parametrize("keep", [True, False])
def test_extraction(spark, tmp_path, keep):
    """Ten frames of 64x48, each of one shade, every third, to 32x32; a broken file beside."""
    (tmp_path / "clip.avi").write_bytes(avi(10))
    (tmp_path / "raw.avi").write_bytes(avi(4, codec="raw-bgr"))
    (tmp_path / "h264.mp4").write_bytes(mp4(SAMPLES[:2], codec=b"avc1"))
    (tmp_path / "broken.mov").write_bytes(b"not a real video file" * 10)
    frames = source.extract_frames(spark, str(tmp_path), target_width=32, target_height=32, every=3, preserve_aspect_ratio=keep)
    got = {(r.item, r.frame_index): r for r in frames.collect()}
    assert sorted(r.name for r in got.values() if r.name) == [f"clip_{i:06d}.png" for i in (1, 2, 3, 4)] + ["raw_000001.png", "raw_000002.png"]
    for (item, at), r in got.items():
        if item in ("clip", "raw"):
            assert (r.height, r.width) == (32, 32) and np.abs(pixels.decode_png(r.data).astype(int) - at * 20 % 256).max() <= 1
    report = {r.item: (r.extracted_frames, r.failed_frames, r.error_code, r.output_bytes > 0) for r in source.extraction_summary(frames).collect()}
    assert report == {"clip": (4, 0, None, True), "raw": (2, 0, None, True), "h264": (0, 1, "UNSUPPORTED_CODEC", False), "broken": (0, 1, "NOT_VIDEO", False)}


