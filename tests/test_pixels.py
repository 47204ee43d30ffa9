import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import ingest, pixels
from tesserae.sources import bitstream


def png(rows, depth, colour, palette=None, filters=None):
    """A PNG of rows of bytes with the given filters' raw output."""
    height, width = len(rows), len(rows[0]) * 8 // (pixels.CHANNELS[colour] * depth)
    raw = b"".join(bytes([f]) + bytes(r) for f, r in zip(filters or [0] * height, rows, strict=True))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = part(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    return pixels.SIGNATURE + head + (part(b"PLTE", bytes(palette)) if palette else b"") + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def filtered(image, kind):
    """Rows of an RGB image after a filter, by its definition, byte by byte."""
    flat = image.reshape(image.shape[0], -1).astype(int)
    out = np.zeros_like(flat)
    for y, row in enumerate(flat):
        for x, v in enumerate(row):
            a, b = (row[x - 3] if x >= 3 else 0), (flat[y - 1][x] if y else 0)
            c = flat[y - 1][x - 3] if y and x >= 3 else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            out[y, x] = (v - [0, a, b, (a + b) // 2, near][kind]) % 256
    return out.astype(np.uint8)


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    image = np.random.default_rng(kind).integers(0, 256, (5, 7, 3), np.uint8)
    data = png(list(filtered(image, kind)), 8, 2, filters=[kind] * 5)
    assert (pixels.decode_png(data) == image).all() and (pixels.decode_png(pixels.encode_png(image)) == image).all()


def test_colour_types():
    assert (pixels.decode_png(png([[0b10100000]], 1, 0))[0, :3, 0] == [255, 0, 255]).all()
    assert pixels.decode_png(png([[1, 0]], 8, 3, palette=[1, 2, 3, 4, 5, 6])).tolist() == [[[4, 5, 6], [1, 2, 3]]]
    assert pixels.decode_png(png([[9, 8, 7, 255]], 8, 6)).tolist() == [[[9, 8, 7]]] and pixels.decode_png(png([[5, 255]], 8, 4)).tolist() == [[[5, 5, 5]]]
    assert pixels.decode_png(png([[1, 99, 2, 99, 3, 99]], 16, 2)).tolist() == [[[1, 2, 3]]]


def test_bad_files():
    good = pixels.encode_png(np.zeros((2, 2, 3), np.uint8))
    flipped = bytearray(good)
    flipped[45] ^= 1
    for data, code in ((None, "NOT_PNG"), (b"not a picture", "NOT_PNG"), (good[:-6], "TRUNCATED"), (good[:20], "TRUNCATED"), (bytes(flipped), "DAMAGED"), (png([[1, 2, 3]], 8, 2, filters=[7]), "BAD_FILTER")):
        with pytest.raises(pixels.PixelError) as e:
            pixels.decode_png(data)
        assert e.value.code == code


def test_malformed_chunks_have_codes():
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = lambda w, h, depth=8, colour=2, more=b"": part(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0) + more)
    end = part(b"IEND", b"")
    data = part(b"IDAT", zlib.compress(bytes(7)))
    for chunks, code in (
        (part(b"IHDR", b"short") + data, "BAD_HEADER"), (head(2, 1, more=b"x") + data, "BAD_HEADER"), (head(0, 1) + data, "BAD_HEADER"), (head(2, 1, 3) + data, "BAD_HEADER"), (data, "BAD_HEADER"),
        (head(7, 1, 8, 3) + part(b"PLTE", b"four") + data, "BAD_PALETTE"), (head(6, 1, 8, 3) + data, "BAD_PALETTE"), (head(1 << 30, 1 << 30) + data, "TRUNCATED"), (head(3, 1) + data, "TRUNCATED"),
        (head(2, 1) + part(b"IDAT", b"no deflate"), "DAMAGED"), (head(2, 1), "TRUNCATED"),
    ):
        with pytest.raises(pixels.PixelError) as e:
            pixels.decode_png(pixels.SIGNATURE + chunks + end)
        assert e.value.code == code
    assert pixels.decode_png(pixels.SIGNATURE + head(2, 1) + data + end).shape == (1, 2, 3)


def test_any_byte_may_be_wrong():
    """Flipped and cut files give pixels or a code."""
    rng = np.random.default_rng(0)
    good = pixels.encode_png(rng.integers(0, 256, (6, 5, 3), np.uint8))
    for at in range(len(good)):
        for data in (good[:at], good[:at] + bytes([good[at] ^ 1 << at % 8]) + good[at + 1 :]):
            with pytest.raises(pixels.PixelError):
                pixels.decode_image(data)


@pytest.mark.parametrize("shape", [(1, 1), (1, 9), (9, 1), (300, 4), (513, 7)])
def test_filters_change_from_row_to_row(shape):
    image = np.random.default_rng(3).integers(0, 256, (*shape, 3), np.uint8)
    kinds = [(y * 7 + y // 3) % 5 for y in range(shape[0])]
    rows = [filtered(image, k) for k in range(5)]
    assert (pixels.decode_png(png([rows[k][y] for y, k in enumerate(kinds)], 8, 2, filters=kinds)) == image).all()


def test_rows_go_on_before_a_batch_is_done(spark, monkeypatch):
    monkeypatch.setattr(pixels, "HELD_BYTES", 100)
    frames = spark.createDataFrame([(i, pixels.encode_png(np.full((4, 4, 3), i, np.uint8)) if i % 3 else None) for i in range(50)], "id int, data binary").coalesce(1)
    got = pixels.to_planes(pixels.decode_frames(frames)).orderBy("id").collect()
    assert [r.id for r in got] == list(range(50))
    assert all((r.error_code, r.planes) == ("NOT_IMAGE", None) if r.id % 3 == 0 else abs(r.planes[5] - r.id / 255) < 1e-6 for r in got)


def test_resizing():
    image = np.random.default_rng(0).integers(0, 256, (8, 12, 3), np.uint8)
    means = image.reshape(4, 2, 4, 3, 3).mean((1, 3))
    assert (pixels.resize(image, 4, 4, "area") == np.rint(means)).all() and (pixels.resize(image, 12, 8, "linear") == image).all()
    line = np.array([[[0] * 3, [100] * 3]], np.uint8)
    assert pixels.resize(line, 4, 1, "linear")[0, :, 0].tolist() == [0, 25, 75, 100]


def test_a_folder_of_frames(spark, tmp_path):
    """Sequences of PNG files to sampled, resized frames and back: one good folder, one with a frame of another size, one with a broken file."""
    bitstream.register(spark)
    made = []
    for item, count in (("bear", 8), ("camel", 3), ("dog", 2)):
        for i in range(count):
            image = np.full((24 if item != "camel" or i < 2 else 10, 32, 3), i * 15, np.uint8)
            made.append((f"{item}/{i:05d}", pixels.encode_png(image) if item != "dog" or i == 0 else b"broken"))
    for item in ("bear", "camel", "dog"):
        (tmp_path / "raw" / item).mkdir(parents=True)
    spark.createDataFrame(made, "name string, data binary").write.format("bitstream").option("path", f"{tmp_path}/raw").option("suffix", ".png").mode("append").save()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{tmp_path}/raw")
    files = files.select(F.element_at(F.split("path", "/"), -2).alias("item"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("content").alias("data"))
    frames = pixels.decode_frames(ingest.sample_every(files, 2, item="item", order="file"))
    sound, errors = frames.where("error_code is null"), frames.where("error_code is not null")
    assert frames.count() == 4 + 2 + 1 and errors.count() == 0
    assert {(r.item, r.n) for r in sound.groupBy("item").agg(F.count_distinct("height", "width").alias("n")).collect()} == {("bear", 1), ("camel", 2), ("dog", 1)}
    small = pixels.resize_frames(sound.where("item = 'bear'"), 16, 16)
    assert [(r.height, r.width, set(r.pixels)) for r in small.orderBy("frame_index").collect()] == [(16, 16, {i * 30}) for i in range(4)]
    named = pixels.encode_frames(small).select(ingest.frame_name(F.col("item"), F.col("frame_index")).alias("name"), "data")
    back = pixels.decode_frames(named)
    assert {r.name for r in back.where("height = 16 and error_code is null").collect()} == {f"bear_{i:06d}.png" for i in range(1, 5)}
    every = pixels.decode_frames(files).where("error_code is not null").collect()
    assert [(r.item, r.error_code, r.pixels) for r in every] == [("dog", "NOT_IMAGE", None)]


def test_planes_are_red_green_blue(spark):
    red = np.zeros((20, 20, 3), np.uint8)
    red[:, :, 0] = 255
    frames = pixels.decode_frames(spark.createDataFrame([(1, pixels.encode_png(red))], "id int, data binary"))
    planes = pixels.to_planes(frames)
    own = np.array(planes.first().planes).reshape(3, -1)
    assert own.mean(1).tolist() == [1, 0, 0]
    again = pixels.from_planes(planes.withColumn("planes", F.transform("planes", lambda x: (x * 2 - 0.25).cast("float")))).first()
    assert np.frombuffer(again.pixels, np.uint8).reshape(20, 20, 3)[0, 0].tolist() == [255, 0, 0]
    assert pixels.encode_frames(frames).first().data == bytearray(pixels.encode_png(red))
