import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import container, latents, percentiles, pixels
from tesserae.operators import quantize as qz
from tesserae.sources import frames


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    """Items of 3, 0, 5 and 2 frames of 8x8 in train, one in val; the last item's second file is absent."""
    home = tmp_path_factory.mktemp("prepared")
    items = []
    for name, split, count in (("ant", "train", 3), ("bee", "train", 0), ("cat", "train", 5), ("dog", "val", 1), ("elk", "train", 2)):
        (home / split / name).mkdir(parents=True)
        items.append({"source_name": name, "split": split, "frame_count": count, "frame_directory": f"{split}/{name}", "frame_filename_pattern": name + "_{index:06d}.png"})
        for i in range(1, count + 1):
            if (name, i) != ("elk", 2):
                (home / split / name / f"{name}_{i:06d}.png").write_bytes(pixels.encode_png(np.full((8, 8, 3), 20 * i + ord(name[0]) % 16, np.uint8)))
    (home / "manifest.json").write_text(json.dumps({"items": items, "errors": []}))
    return f"{home}/manifest.json"


ORDER = [("ant", 1), ("ant", 2), ("ant", 3), ("cat", 1), ("cat", 2), ("cat", 3), ("cat", 4), ("cat", 5), ("elk", 1), ("elk", 2)]


def test_ordinals_without_opening_files(dataset):
    index = frames.load_index(dataset, "train")
    assert len(index) == 10 and [index.locate(k)[:2] for k in range(10)] == ORDER and frames.missing_folders(index) == []
    for bad in (-1, 10):
        with pytest.raises(IndexError):
            index.locate(bad)
    for low in range(10):
        for high in range(low + 1, 11):
            part, start = index.part(low, high)
            assert [part.locate(k - start)[:2] for k in range(low, high)] == ORDER[low:high] and len(part.items) <= len({n for n, _ in ORDER[low:high]}) + 0
    with pytest.raises(ValueError):
        frames.load_index(dataset, "test")
    with pytest.raises(ValueError):
        frames.load_index(dataset, "holdout")


def test_one_ordinal_reads_one_file(dataset):
    index, opened = frames.load_index(dataset, "train"), []

    def read(path):
        opened.append(path)
        return frames.read_file(path)

    got = frames.frame(index, 6, height=8, width=8, read=read)
    assert opened == [index.locate(6)[2]] and got.shape == (8, 8, 3) and got[0, 0, 0] == 80 + ord("c") % 16
    with pytest.raises(ValueError, match="8x8"):
        frames.frame(index, 6, height=16)
    with pytest.raises(FileNotFoundError):
        frames.frame(index, 9)


def test_what_is_asked_for_decides_what_is_planned(dataset):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    def read(*filters, **options):
        reader = frames.FrameSource({"manifest": dataset, "split": "train", "framesPerTask": "2"} | options).reader(None)
        list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        return [(r[0], r[2], r[3]) for p in parts for r in reader.read(p)], len(parts)

    every = [(k, *o) for k, o in enumerate(ORDER)]
    assert read() == (every, 5)
    assert read(EqualTo(("ordinal",), 4)) == ([every[4]], 1) and read(In(("ordinal",), (1, 9, 99, None))) == ([every[1], every[9]], 2)
    assert read(GreaterThan(("ordinal",), 2), LessThanOrEqual(("ordinal",), 5))[0] == every[3:6] and read(EqualTo(("source_name",), "cat"))[0] == every[3:8]
    assert read(In(("source_name",), ("elk", "nobody")), LessThanOrEqual(("ordinal",), 8))[0] == [every[8]] and read(EqualTo(("source_name",), "nobody"))[0] == []


def test_a_split_as_a_table(spark, dataset):
    table = frames.read_split(spark, dataset, "train")
    got = pixels.decode_frames(table.drop("error_code")).orderBy("ordinal").collect()
    assert [(r.source_name, r.frame_index) for r in got] == ORDER and [r.height for r in got] == [8] * 9 + [None]
    assert [(r.ordinal, r.error_code) for r in table.where("error_code is not null").collect()] == [(9, "NOT_FOUND")]
    assert [r.source_name for r in table.where("source_name = 'elk' and ordinal = 8").collect()] == ["elk"]


def test_sortable_floats():
    values = [-math.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.5, 1e300, math.inf]
    for bits, own in ((64, values), (32, [-math.inf, -1.5, -1e-45, 0.0, 1e-45, 1.5, 3e38, math.inf])):
        keys = percentiles.sortable(np.array(own, np.float32 if bits == 32 else float), bits)
        assert (np.diff(keys) > 0).all() and [percentiles.unsorted_value(int(k), bits) for k in keys] == [float(np.float32(v)) if bits == 32 else v for v in own]
    assert percentiles.sortable(np.array([-0.0]))[0] == percentiles.sortable(np.array([0.0]))[0] and percentiles.sortable(np.array([math.nan]))[0] > keys[-1]


@pytest.mark.parametrize("kind", ["double", "float"])
def test_percentiles_equal_those_of_sorted_values(spark, kind):
    rng = np.random.default_rng(5)
    rows = [("wide", float(v)) for v in np.exp(rng.normal(0, 20, 3000)) * rng.choice([-1, 1], 3000)] + [("ties", float(v)) for v in rng.integers(-2, 3, 500)]
    rows += [("one", 7.5), ("two", 1.0), ("two", 2.0), ("none", None), (None, 3.0), (None, None), ("ends", -math.inf), ("ends", math.inf), ("ends", 0.0), ("zero", -0.0), ("zero", 0.0)]
    df = spark.createDataFrame(rows, f"g string, x {kind}").repartition(5)
    fractions = [0.0, 0.001, 0.25, 0.5, 0.999, 1.0]
    got, names = percentiles.exact_percentiles(df, ["g"], "x", fractions)
    want = {r.g: r.p for r in df.where("x is not null").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, fractions))).alias("p")).collect()}
    assert names == ["g"] and {r.g for r in got.collect()} == set(want)
    for r in got.collect():
        assert all(a == b or math.isnan(a) and math.isnan(b) or abs(a - b) <= 1e-12 * abs(b) for a, b in zip(r.p, want[r.g])), r.g


def test_percentiles_of_nothing(spark):
    empty = spark.createDataFrame([], "channel int, x double")
    assert qz.percentile_ranges(empty, "per_channel").collect() == [] and qz.percentile_ranges(empty, "global").collect() == []


def test_a_codec_of_planes(spark):
    """64 x 16 x 16 latents, one table and one scale a channel, through containers and back."""
    rng = np.random.default_rng(0)
    shape = (64, 16, 16)
    latent = rng.normal(0, 1, (3, *shape)) * np.arange(1, 65)[None, :, None, None] + np.arange(64)[None, :, None, None]
    frame = spark.createDataFrame([(i, z.ravel().tolist()) for i, z in enumerate(latent)], "frame_id long, z array<double>")
    codec = container.fit_codec(latents.to_long(frame, id_col="frame_id", array_col="z", plane=256), bits=8, plane=(16, 16), image=(3, 256, 256))
    assert codec.shape == shape and len(codec.scales) == 64
    lo, hi = (np.percentile(latent.transpose(1, 0, 2, 3).reshape(64, -1), p, axis=1) for p in (0.1, 99.9))
    assert np.allclose(codec.scales, (hi - lo) / 255)
    want = np.clip(np.rint(latent / codec.scales[None, :, None, None]) + np.asarray(codec.zero_points)[None, :, None, None], 0, 255)
    coded = container.encode(frame, codec, array_col="z").select("frame_id", "data")
    back = container.decode(coded, codec).orderBy("frame_id").collect()
    assert all((np.array(r.symbols).reshape(shape) == want[r.frame_id]).all() for r in back)
    head = container.split(bytes(back[0].data))[0] if "data" in back[0] else container.split(bytes(coded.first().data))[0]
    assert (head["symbol_count"], len(head["scales"])) == (64 * 256, 64)
    values = codec.values(np.array(back[1].symbols)).reshape(shape)
    inside = np.abs(want[1] - 127.5) < 127.5
    assert (np.abs(values - latent[1]) <= codec.scales[:, None, None] / 2 + 1e-9)[inside].all()
