import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import half_even, lower_median, psnr
from tesserae.operators import coder, container, entropy, model
from tesserae.operators import quantize as qz
from tesserae.sources import bitstream


def fold(symbols, cumulative, tables):
    """One frame, a bit at a time."""
    low, high, owed, bits = 0, 2**32 - 1, 0, []

    def put(bit):
        nonlocal owed
        bits.extend([bit] + [1 - bit] * owed)
        owed = 0

    for s, t in zip(symbols, tables, strict=True):
        row, span = cumulative[t], high - low + 1
        low, high = low + span * int(row[s]) // int(row[-1]), low + span * int(row[s + 1]) // int(row[-1]) - 1
        while True:
            if high < 2**31 or low >= 2**31:
                put(int(low >= 2**31))
                low, high = low % 2**31, high % 2**31
            elif low >= 2**30 and high < 3 * 2**30:
                owed += 1
                low, high = low - 2**30, high - 2**30
            else:
                break
            low, high = 2 * low, 2 * high + 1
    owed += 1
    put(int(low >= 2**30))
    return np.packbits(np.array(bits, np.uint8)).tobytes()


def tables_of(freq):
    freq = np.asarray(freq)
    return np.concatenate((np.zeros((len(freq), 1), np.int64), np.cumsum(freq, axis=1)), axis=1)


@pytest.mark.parametrize("bits", [1, 4, 8])
@pytest.mark.parametrize("skew", [0, 8])
def test_coder_equals_the_scalar_fold_and_inverts(bits, skew):
    rng = np.random.default_rng(bits + skew)
    p = rng.random((3, 2**bits)) ** (1 + skew) + 1e-6
    cum = tables_of(np.maximum(1, np.floor(p / p.sum(1, keepdims=True) * 60_000)).astype(int))
    frames = [np.where(rng.random(n) < 0.8, p[0].argmax(), rng.integers(0, 2**bits, n)) for n in (1, 2, 3, 7, 100, 900)]
    which = [rng.integers(0, 3, len(f)) for f in frames]
    coded = coder.encode_frames(frames, cum, which)
    assert coded == [fold(f, cum, w) for f, w in zip(frames, which, strict=True)]
    assert all((a == b).all() for a, b in zip(coder.decode_frames(coded, cum, which), frames, strict=True))


def test_coder_is_near_the_ideal_length():
    symbols = np.random.default_rng(42).integers(0, 256, 16_384)
    (coded,) = coder.encode_frames([symbols], tables_of([[256] * 256]), [np.zeros(16_384, int)])
    assert abs(8 * len(coded) / 16_384 - 8) < 0.001


@pytest.mark.parametrize("frames,cum,which", [([[]], [[0, 1]], [[]]), ([[2]], [[0, 1, 2]], [[0]]), ([[0]], [[0, 1]], [[1]]), ([[0]], [[0, 2**31]], [[0]]), ([[0]], [[0, 1]], [[0, 0]])])
def test_coder_refuses(frames, cum, which):
    with pytest.raises(ValueError):
        coder.encode_frames(frames, np.array(cum), which)


def scalar_frequencies(counts):
    share = (np.asarray(counts, float) + 1) / (np.asarray(counts, float) + 1).sum()
    freq = np.maximum(np.floor(share * 65_536), 1).astype(int)
    order = sorted(range(len(freq)), key=lambda i: (-freq[i], i))
    rest = 65_536 - freq.sum()
    for k in range(max(rest, 0)):
        freq[order[k % len(order)]] += 1
    for i in order:
        take = min(freq[i] - 1, max(0, freq.sum() - 65_536))
        freq[i] -= take
    return freq.tolist()


def test_frequencies_reach_their_total(spark):
    rng = np.random.default_rng(0)
    cases = {
        "one": [10_000] + [0] * 255, "skew": [1] * 7 + [1_000_000] + [1] * 248, "flat": [3] * 256, "rand": rng.integers(0, 50, 256).tolist(), "none": [0] * 256,
        "steep": (2 ** np.minimum(np.arange(256), 40)).tolist(),
    }
    rows = spark.createDataFrame([(t, i, int(n)) for t, c in cases.items() for i, n in enumerate(c)], "table string, symbol int, n long")
    freq = entropy.frequencies(rows)
    got = {}
    for r in freq.orderBy("table", "symbol").collect():
        got.setdefault(r.table, []).append(r.freq)
    assert got == {t: scalar_frequencies(c) for t, c in cases.items()} and entropy.violations(freq).count() == 0


def test_model_id_is_that_of_the_json(spark):
    rows = [(t, s, 16_384) for t in range(2) for s in range(4)]
    text = json.dumps({"name": "empirical_per_channel_static_v1", "version": 1, "bits": 2, "frequencies": [[16_384] * 4] * 2}, sort_keys=True)
    assert entropy.model_id(spark.createDataFrame(rows, "table int, symbol int, freq long"), 2).first()[0] == hashlib.sha256(text.encode()).hexdigest()[:16]


HEADER = dict(bits=8, mode="per_channel", image_width=256, image_height=256, image_channels=3, latent_channels=2, latent_height=4, latent_width=4, symbol_count=32, payload_length=5,
              model_id="0102030405060708", scales=[0.5, 0.25], zero_points=[10.0, -3.0])


def test_header_round_trip():
    data = container.join(HEADER, b"abcde")
    assert len(data) == 37 + 16 + 5 == container.header_size(2) + 5 and container.split(data) == (HEADER, b"abcde")


@pytest.mark.parametrize("at,value,code", [
    (0, b"X", "magic"), (4, b"\x09", "version"), (5, b"\0", "bits"), (5, b"\x11", "bits"), (6, b"\x07", "mode"), (7, b"\x02", "coder"), (8, b"\0\0", "dimensions"), (13, b"\0\0", "dimensions"),
    (19, b"\x01\0\0\0", "symbol_count"), (23, b"\x01\0", "parameter_count"), (37, b"\0\0\0\0", "scale"), (25, b"\x09", "payload_cut"), (25, b"\x01", "trailing"),
])
def test_damaged_containers_are_refused(at, value, code):
    data = container.join(HEADER, b"abcde")
    with pytest.raises(container.FormatError) as e:
        container.split(data[:at] + value + data[at + len(value) :])
    assert e.value.code == code


@pytest.mark.parametrize("change,code", [({"mode": "x"}, "mode"), ({"model_id": "00"}, "model_id"), ({"scales": [1.0]}, "parameter_count"), ({"image_width": 70_000}, "field_range"), ({"payload_length": 4}, "payload_length")])
def test_headers_that_dont_fit(change, code):
    with pytest.raises(container.FormatError) as e:
        container.join(HEADER | change, b"abcde")
    assert e.value.code == code


def test_cut_headers():
    data = container.join(HEADER, b"abcde")
    for n, code in ((10, "short"), (40, "parameter_block"), (55, "payload_cut")):
        with pytest.raises(container.FormatError) as e:
            container.split(data[:n])
        assert e.value.code == code


def test_files_of_containers(spark, tmp_path):
    bitstream.register(spark)
    blob = container.join(HEADER, b"abcde")
    spark.createDataFrame([("a", blob), ("b", blob[:-1])], "name string, data binary").coalesce(1).write.format("bitstream").mode("append").save(str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.bits, r.symbol_count, r.error) for r in spark.read.format("bitstream").load(str(tmp_path)).collect()}
    a, b = (f"{n}{container.SUFFIX}" for n in "ab")
    assert got == {a: (8, 32, None), b: (None, None, "payload_cut")} and (tmp_path / a).read_bytes() == blob


def latent(spark, values):
    return spark.createDataFrame([(0, c, i, float(x)) for c, row in enumerate(values) for i, x in enumerate(row)], "frame_id long, channel int, pos int, x double")


def test_single_precision_gives_127(spark):
    """0.5 over the unit range: 127.4999 in single precision, a tie in double precision."""
    rows = latent(spark, [[0, 0.5, 1]])
    for single, middle in ((True, 127), (False, 128)):
        table = qz.params(qz.minmax_ranges(rows, "global"), 8, float32=single)
        assert [r.q for r in qz.quantize(rows, table, 8, "global", float32=single).orderBy("pos").collect()] == [0, middle, 255]


def test_constant_and_far_ranges(spark):
    for x in (0, 0.5, 5, -3):
        rows = latent(spark, [[x] * 4])
        for mode in qz.MODES:
            table = qz.params(qz.minmax_ranges(rows, mode), 8)
            assert table.first().scale > 0 and qz.errors(qz.quantize(rows, table, 8, mode)).first().max_abs <= 0.01
    far = latent(spark, [np.linspace(1000, 1001, 16)])
    table = qz.params(qz.minmax_ranges(far, "global"), 8)
    assert table.first().zero_point < -1000 and qz.errors(qz.quantize(far, table, 8, "global")).first().max_abs < 0.01


def test_more_bits_and_own_channels_err_less(spark):
    rng = np.random.default_rng(1)
    rows = latent(spark, [rng.uniform(-100, 100, 200), rng.uniform(-0.01, 0.01, 200)])
    err = {(r["mode"], r.bits): r.mse for r in qz.experiment(rows).collect()}
    assert err["global", 8] < err["global", 6] < err["global", 4] and all(err["per_channel", b] < err["global", b] for b in (8, 6, 4))
    a, b = qz.params(qz.percentile_ranges(rows, "per_channel", 0, 100), 8), qz.params(qz.minmax_ranges(rows, "per_channel"), 8)
    assert a.orderBy("channel").collect() == b.orderBy("channel").collect()
    direct = qz.errors(qz.quantize(rows, b, 8)).first().mse
    assert direct == pytest.approx(err["per_channel", 8])


@pytest.mark.parametrize("bits,mode", [(0, "global"), (17, "global"), (True, "global"), (8.0, "global"), (8, "other")])
def test_quantizer_arguments(bits, mode):
    with pytest.raises(ValueError):
        qz.check(bits, mode)


def test_rounding_medians_and_psnr(spark):
    row = spark.range(1).select(half_even(F.lit(-76.5)), half_even(F.lit(126.5)), psnr(F.lit(0.0)), psnr(F.lit(0.01))).first()
    assert tuple(row) == (-76.0, 126.0, float("inf"), pytest.approx(20.0))
    assert spark.createDataFrame([(float(i),) for i in range(1, 5)], "x double").agg(lower_median("x")).first()[0] == 2.0


def test_frozen_codec_runs_on_a_stream(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(40)], "frame_id long, x array<double>")
    frames.write.parquet(f"{tmp_path}/in")
    rows = frames.select("frame_id", F.posexplode("x").alias("pos", "x")).withColumn("channel", F.col("pos"))
    codec = container.fit_codec(rows, bits=6)
    stream = container.encode(spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in"), codec, array_col="x")
    query = stream.writeStream.format("memory").queryName("coded").start()
    query.processAllAvailable()
    query.stop()
    want = {r.frame_id: bytes(r.data) for r in container.encode(frames, codec, array_col="x").collect()}
    assert {r.frame_id: bytes(r.data) for r in spark.sql("select * from coded").collect()} == want
    other = container.Codec(**{**vars_of(codec), "model_id": "00" * 8})
    with pytest.raises(container.FormatError):
        other.decode(list(want.values()))


def vars_of(c):
    return dict(bits=c.bits, mode=c.mode, shape=c.shape, image=c.image, scales=c.scales, zero_points=c.zero_points, frequencies=np.diff(c.cumulative, axis=1), model_id=c.model_id)


def test_convolutions():
    assert model.parameter_count() == 593_411
    weights = model.random_weights(3, in_channels=3, latent=5, base=2)
    assert sum(w.size for w in weights.values()) == model.parameter_count(3, 5, 2)
    x = np.random.default_rng(0).random((2, 3, 32, 48))
    z = model.encode(x, weights)
    y = model.decode(z, weights)
    assert z.shape == (2, 5, 2, 3) and y.shape == x.shape and 0 < y.min() and y.max() < 1
    # a transposed convolution is the adjoint of the convolution
    w, zero = np.random.default_rng(1).random((4, 3, 4, 4)), np.zeros(4)
    g = np.random.default_rng(2).random((2, 4, 16, 24))
    assert np.sum(model.conv(x, w, zero) * g) == pytest.approx(np.sum(x * model.conv_transposed(g, w, np.zeros(3))))
    for bad in (x[:, :2], x[:, :, :30]):
        with pytest.raises(ValueError):
            model.encode(bad, weights)
