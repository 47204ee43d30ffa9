import struct

import numpy as np
import pytest

from tesserae.operators import jpeg, pixels


def smooth(height, width):
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([x * min(2, 200 / width), y * min(2, 200 / height), 255 - (x + y) * min(1, 200 / (width + height))], axis=2).round().astype(np.uint8)


def segment(marker, body):
    return bytes([255, marker]) + struct.pack(">H", len(body) + 2) + body


class Writer:
    """Scans with codes of eight bits: a symbol's code is the symbol."""

    TABLE = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits.append(f"{value:0{n}b}" if n else "")

    def value(self, v):
        size = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << size) - 1, size)

    def data(self):
        text = "".join(self.bits)
        text += "1" * (-len(text) % 8)
        return int(text or "0", 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")


def coefficients(plane, steps):
    """Quantised blocks, in zigzag order, of a plane padded to whole blocks."""
    high, wide = -(-plane.shape[0] // 8), -(-plane.shape[1] // 8)
    plane = np.pad(plane, ((0, high * 8 - plane.shape[0]), (0, wide * 8 - plane.shape[1])), mode="edge")
    k = np.arange(8)
    basis = np.sqrt(2 / 8) * np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16)
    basis[0] /= np.sqrt(2)
    blocks = plane.reshape(high, 8, wide, 8).swapaxes(1, 2) - 128.0
    return np.rint((basis @ blocks @ basis.T).reshape(high, wide, 64)[:, :, jpeg.ZIGZAG] / steps).astype(int)


def progressive(image, step=2):
    """A progressive grey file: DC in two passes, low and high AC in three, runs of blocks without coefficients."""
    blocks = coefficients(image[:, :, 0], np.full(64, step)).reshape(-1, 64)
    out = b"\xff\xd8" + segment(0xDB, b"\0" + bytes([step] * 64)) + segment(0xC2, struct.pack(">BHHB", 8, *image.shape[:2], 1) + bytes([1, 0x11, 0]))
    out += segment(0xC4, b"\0" + Writer.TABLE) + segment(0xC4, b"\x10" + Writer.TABLE)
    scan = lambda low, high, before, shift, w: segment(0xDA, bytes([1, 1, 0, low, high, before << 4 | shift])) + w.data()
    w, last = Writer(), 0
    for b in blocks:
        v = int(b[0]) >> 1
        w.put(abs(v - last).bit_length(), 8), w.value(v - last)
        last = v
    out += scan(0, 0, 0, 1, w)
    cut = lambda v, s: (abs(v) >> s) * (1 if v > 0 else -1)
    for low, high in ((1, 5), (6, 63)):
        w, empty = Writer(), 0

        def flush(w, empty):
            while empty:
                n = min(empty.bit_length() - 1, 14)
                w.put(n << 4, 8), w.put(empty - (1 << n) if empty < 2 << n else (1 << n) - 1, n)
                empty -= min(empty, (2 << n) - 1)

        for b in blocks:
            run = 0
            own = [(k, cut(int(b[k]), 2)) for k in range(low, high + 1)]
            filled = [k for k, v in own if v]
            if filled:
                flush(w, empty)
                empty = 0
            for k, v in own:
                if filled and k <= filled[-1]:
                    if not v:
                        run += 1
                        continue
                    while run > 15:
                        w.put(0xF0, 8)
                        run -= 16
                    w.put(run << 4 | abs(v).bit_length(), 8), w.value(v)
                    run = 0
            if not filled or filled[-1] < high:
                empty += 1
        flush(w, empty)
        out += scan(low, high, 0, 2, w)
    w = Writer()
    for b in blocks:
        w.put(int(b[0]) & 1, 1)
    out += scan(0, 0, 1, 0, w)
    for shift in (1, 0):
        w = Writer()
        for b in blocks:
            own = [abs(int(b[k])) >> shift for k in range(64)]
            fresh = [k for k in range(1, 64) if own[k] == 1]
            run, late = 0, []
            for k in range(1, 64):
                if own[k] > 1:
                    late.append(own[k] & 1)
                    continue
                if fresh and k <= fresh[-1]:
                    if own[k] == 1:
                        w.put(run << 4 | 1, 8), w.put(int(b[k] > 0), 1)
                        for bit in late:
                            w.put(bit, 1)
                        run, late = 0, []
                    elif run == 15:
                        w.put(0xF0, 8)
                        for bit in late:
                            w.put(bit, 1)
                        run, late = 0, []
                    else:
                        run += 1
            if not fresh or fresh[-1] < 63:
                w.put(0, 8)
                for bit in late:
                    w.put(bit, 1)
        out += scan(1, 63, shift + 1, shift, w)
    return out + b"\xff\xd9"


@pytest.mark.parametrize("size", [(8, 8), (1, 1), (17, 40), (97, 131)])
@pytest.mark.parametrize("how", [{}, {"halved": True}, {"grey": True}])
def test_known_pixels(size, how):
    image = smooth(*size)
    got = jpeg.decode_jpeg(jpeg.encode_jpeg(image, quality=100, **how)).astype(int)
    want = np.repeat(image[:, :, :1], 3, axis=2) if how.get("grey") else image
    off = np.abs(got - want)
    assert got.shape == image.shape and off.max() <= 4 and (off > 2).mean() < (0.05 if how.get("halved") else 0.002)


def test_noise_and_every_run_length():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (40, 56, 3), np.uint8)
    assert np.abs(jpeg.decode_jpeg(jpeg.encode_jpeg(image, quality=100)).astype(int) - image).max() <= 4
    for k in range(1, 64):  # one coefficient far out, after a run of k - 1
        flat = np.zeros(64)
        flat[jpeg.ZIGZAG[k]] = 200
        tile = np.clip(np.rint(jpeg.COSINES.T @ flat.reshape(8, 8) @ jpeg.COSINES + 128), 0, 255).astype(np.uint8)
        own = np.repeat(tile[:, :, None], 3, axis=2)
        assert np.abs(jpeg.decode_jpeg(jpeg.encode_jpeg(own, quality=100, grey=True)).astype(int) - own).max() <= 1


@pytest.mark.parametrize("size", [(8, 8), (16, 24), (50, 70)])
def test_progressive(size):
    rng = np.random.default_rng(size[0])
    plane = np.clip(np.cumsum(rng.normal(0, 9, size), axis=1) + 128, 0, 255).astype(np.uint8)
    plane[: size[0] // 2, : size[1] // 2] = 77  # blocks without coefficients
    image = np.repeat(plane[:, :, None], 3, axis=2)
    assert np.abs(jpeg.decode_jpeg(progressive(image)).astype(int) - image).max() <= 5
    blocks = coefficients(image[:, :, 0], np.full(64, 2))
    flat = np.zeros(blocks.shape)
    flat[:, :, jpeg.ZIGZAG] = blocks * 2
    exact = (jpeg.COSINES.T @ flat.reshape(*blocks.shape[:2], 8, 8) @ jpeg.COSINES).swapaxes(1, 2).reshape(blocks.shape[0] * 8, -1)[: size[0], : size[1]]
    assert np.abs(jpeg.decode_jpeg(progressive(image))[:, :, 0] - np.clip(exact + 128, 0, 255)).max() <= 0.5 + 1e-9


def sequential(image, *, restart=0, factors=((1, 1),), ids=(1, 2, 3), extra=b""):
    """A sequential file of given sampling factors, from full planes that are averaged; 8-bit codes, steps of one."""
    n, (h, v) = len(factors), (max(f[0] for f in factors), max(f[1] for f in factors))
    high, wide = -(-image.shape[0] // (8 * v)) * 8 * v, -(-image.shape[1] // (8 * h)) * 8 * h
    full = np.pad(image.astype(float), ((0, high - image.shape[0]), (0, wide - image.shape[1]), (0, 0)), mode="edge")
    grids = []
    for c, (fh, fv) in enumerate(factors):
        own = full[:, :, c].reshape(high * fv // v, v // fv, wide * fh // h, h // fh).mean((1, 3))
        grids.append(coefficients(own, np.ones(64)))
    out = b"\xff\xd8" + extra + segment(0xDB, b"\0" + bytes([1] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, *image.shape[:2], n) + b"".join(bytes([ids[c], fh << 4 | fv, 0]) for c, (fh, fv) in enumerate(factors)))
    out += segment(0xC4, b"\0" + Writer.TABLE + b"\x10" + Writer.TABLE) + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")
    out += segment(0xDA, bytes([n]) + b"".join(bytes([ids[c], 0]) for c in range(n)) + bytes([0, 63, 0]))
    w, last, units = Writer(), [0] * n, 0
    for y in range(high // (8 * v)):
        for x in range(wide // (8 * h)):
            if restart and units and units % restart == 0:
                out += w.data() + bytes([255, 0xD0 + (units // restart - 1) % 8])
                w, last = Writer(), [0] * n
            units += 1
            for c, (fh, fv) in enumerate(factors):
                for dy in range(fv):
                    for dx in range(fh):
                        b = grids[c][y * fv + dy, x * fh + dx]
                        d = int(b[0]) - last[c]
                        last[c] = int(b[0])
                        w.put(abs(d).bit_length(), 8), w.value(d)
                        run = 0
                        for k in range(1, 64):
                            if b[k]:
                                while run > 15:
                                    w.put(0xF0, 8)
                                    run -= 16
                                w.put(run << 4 | abs(int(b[k])).bit_length(), 8), w.value(int(b[k]))
                                run = 0
                            else:
                                run += 1
                        if run:
                            w.put(0, 8)
    return out + w.data() + b"\xff\xd9"


@pytest.mark.parametrize("factors", [((1, 1),) * 3, ((2, 1), (1, 1), (1, 1)), ((2, 2), (1, 1), (1, 1)), ((1, 2), (1, 1), (1, 1)), ((4, 1), (1, 1), (1, 1)), ((2, 2), (2, 1), (1, 1))])
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_sampling_and_restarts(factors, restart):
    rgb = smooth(60, 75)
    ycc = rgb @ jpeg.TO_YCC.T + [0, 128, 128]
    got = jpeg.decode_jpeg(sequential(ycc, restart=restart, factors=factors)).astype(int)
    assert got.shape == rgb.shape and np.abs(got - rgb).max() <= (10 if factors[0] == (4, 1) else 7 if factors != ((1, 1),) * 3 else 2)


def test_colour_of_other_kinds():
    rgb = smooth(16, 16)
    assert np.abs(jpeg.decode_jpeg(sequential(rgb, factors=((1, 1),) * 3, ids=b"RGB")).astype(int) - rgb).max() <= 1
    adobe = segment(0xEE, b"Adobe" + bytes([0, 100, 0, 0, 0, 0, 0]))
    assert np.abs(jpeg.decode_jpeg(sequential(rgb, factors=((1, 1),) * 3, extra=adobe)).astype(int) - rgb).max() <= 1


@pytest.mark.parametrize("turn", range(1, 9))
@pytest.mark.parametrize("order", ["<", ">"])
def test_orientation(turn, order):
    image = smooth(16, 24)
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IHHHIHH", 8, 1, 0x0112, 3, 1, turn, 0)
    got = jpeg.decode_jpeg(sequential(image, factors=((1, 1),) * 3, ids=b"RGB", extra=segment(0xE1, b"Exif\0\0" + tiff)))
    # where the stored first row and column are to be shown, by the orientation's number
    shown = {1: image, 2: image[:, ::-1], 3: image[::-1, ::-1], 4: image[::-1], 5: image.swapaxes(0, 1), 6: np.rot90(image, -1), 7: np.rot90(image, 2).swapaxes(0, 1), 8: np.rot90(image)}[turn]
    assert got.shape == shown.shape and np.abs(got.astype(int) - shown).max() <= 1


def test_bad_files():
    good = jpeg.encode_jpeg(smooth(40, 40), quality=80)
    at = good.index(b"\xff\xc0")
    header = lambda **k: good[: at + 4] + struct.pack(">BHHB", *({"depth": 8, "height": 40, "width": 40, "n": 3} | k).values()) + good[at + 10 :]
    for data, code in (
        (None, "NOT_JPEG"), (b"", "NOT_JPEG"), (b"\xff\xd8", "TRUNCATED"), (good[:100], "TRUNCATED"), (good[: len(good) * 2 // 3], "TRUNCATED"), (header(depth=12), "UNSUPPORTED"), (header(n=4), "UNSUPPORTED"),
        (header(height=65535, width=65535), "TRUNCATED"), (header(height=0), "BAD_HEADER"), (good.replace(b"\xff\xc0", b"\xff\xc9"), "UNSUPPORTED"), (b"\xff\xd8\xff\xd9", "TRUNCATED"),
    ):
        with pytest.raises(jpeg.PixelError) as e:
            jpeg.decode_jpeg(data)
        assert e.value.code == code


def test_any_byte_may_be_wrong():
    """Whatever is cut or flipped, there are pixels or a code, never another error."""
    for good in (jpeg.encode_jpeg(smooth(20, 20), quality=60, halved=True), progressive(smooth(16, 16))):
        codes = set()
        for at in range(len(good)):
            for data in (good[:at], good[:at] + bytes([good[at] ^ 1 << at % 8]) + good[at + 1 :], good[:at] + b"\xff" + good[at + 1 :]):
                try:
                    jpeg.decode_jpeg(data)
                except jpeg.PixelError as e:
                    codes.add(e.code)
        assert codes <= {"NOT_JPEG", "TRUNCATED", "DAMAGED", "UNSUPPORTED", "BAD_HEADER"} and "TRUNCATED" in codes


def test_a_table_of_both_kinds(spark):
    image = smooth(24, 32)
    made = [(1, jpeg.encode_jpeg(image, quality=100)), (2, pixels.encode_png(image)), (3, b"\xff\xd8\xff"), (4, None), (5, b"GIF89a")]
    got = {r.id: r for r in pixels.decode_frames(spark.createDataFrame(made, "id int, data binary")).collect()}
    assert {k: (r.height, r.width, r.error_code) for k, r in got.items()} == {1: (24, 32, None), 2: (24, 32, None), 3: (None, None, "TRUNCATED"), 4: (None, None, "NOT_IMAGE"), 5: (None, None, "NOT_IMAGE")}
    assert bytes(got[2].pixels) == image.tobytes() and np.abs(np.frombuffer(got[1].pixels, np.uint8).astype(int) - image.ravel()).max() <= 2
