import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators import ingest, latents, metrics
from tesserae.sources import media


def test_detects_what_a_folder_holds(spark, tmp_path):
    for name in ("a.mp4", "seq/1.JPG", "seq/2.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = media.named(media.list_files(spark, str(tmp_path), recursive=True)).withColumn("depth", F.when(F.col("directory") == "seq", 1).otherwise(0))
    found = lambda f: ingest.detect_source_type(f, list(media.VIDEO_SUFFIXES), list(media.IMAGE_SUFFIXES)).first()[0]
    assert found(files) == "video" and found(files.where("depth = 1")) == "image_sequence"
    with pytest.raises(Exception, match="neither"):
        found(files.where("suffix = '.txt'"))
    assert {r.stem for r in files.collect()} == {"a", "1", "2"} and media.list_files(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("n", [0, 1, 7, 10, 101])
def test_splits_are_exact_disjoint_and_repeatable(spark, n):
    items = spark.range(n).select(F.col("id").alias("k"))
    got = lambda seed: {r.item_key: r.split for r in ingest.assign_splits(items, key="k", train=0.8, val=0.1, test=0.1, seed=seed).collect()}
    one = got(1)
    sizes = [list(one.values()).count(s) for s in ingest.SPLITS]
    train = min(round(n * 0.8), n)
    assert len(one) == n and sizes == [train, min(round(n * 0.1), n - train), n - train - min(round(n * 0.1), n - train)] and one == got(1)
    if n > 50:
        assert one != got(2)


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.2), (1.2, -0.1, -0.1)])
def test_ratios_are_checked(ratios):
    with pytest.raises(ValueError):
        ingest.check_ratios(*ratios)


def test_sampling_renumbers(spark):
    frames = spark.range(10).select(F.lit("v").alias("item"), F.format_string("%05d.jpg", "id").alias("name"))
    got = ingest.sample_every(frames, 3, item="item", order="name").orderBy("frame_index").collect()
    assert [(r.source_index, r.frame_index) for r in got] == [(0, 1), (3, 2), (6, 3), (9, 4)]
    with pytest.raises(ValueError):
        ingest.sample_every(frames, 0, item="item", order="name")


def test_odd_frames_and_unreadable_ones(spark):
    rows = [("good", i, 64, 48, 10) for i in range(3)] + [("odd", 0, 64, 48, 10), ("odd", 1, 999, 999, 10), ("bad", 0, 1, 1, None)]
    frames = spark.createDataFrame(rows, "item string, n int, w int, h int, size long")
    assert [tuple(r) for r in ingest.inconsistent(frames, item="item", order="n", width="w", height="h").collect()] == [("odd", 64, 48, 1, 1)]
    assert {r.item: r.error_code for r in ingest.probe_items(frames, item="item", size="size").collect()} == {"good": None, "odd": None, "bad": "corrupt"}
    sound, bad = ingest.quarantine(frames, F.when(F.col("size").isNull(), "corrupt"))
    assert (sound.count(), bad.count()) == (5, 1)


def test_collisions(spark):
    items = spark.createDataFrame([("clip", "clip.mp4"), ("clip", "clip.avi"), ("x", "x.mp4")], "key string, path string")
    assert [tuple(r) for r in ingest.key_collisions(items, key="key", path="path").collect()] == [("clip", 2, "clip.avi", "clip.mp4")]


def test_geometry_covers_the_target(spark):
    sizes = spark.createDataFrame([(1920, 1080), (256, 256), (100, 400), (300, 257)], "w int, h int")
    for r in ingest.resize_geometry(sizes, width="w", height="h", target_width=256, target_height=256).collect():
        assert min(r.new_width, r.new_height) == 256 and r.left == (r.new_width - 256) // 2 and r.interpolation == ("area" if min(r.w, r.h) >= 256 else "linear")


def test_manifest_round_trip(spark, tmp_path):
    items = [dict(source_type="video", source_name=s, split=p, frame_count=n, frame_directory=f"frames/{s}", frame_filename_pattern=f"{s}_{{index:06d}}.png", output_bytes=5) for s, p, n in (("a", "train", 2), ("b", "val", 1), ("c", "train", 0))]
    (tmp_path / "m.json").write_text(json.dumps({"generated_at": "now", "source_type": "video", "items": items, "errors": []}, indent=2))
    got = [r.path for r in media.frames_of(spark, str(tmp_path / "m.json"), "train").orderBy("path").collect()]
    assert got == ["frames/a/a_000001.png", "frames/a/a_000002.png"]
    table = spark.createDataFrame([(i["split"], i["frame_count"], 5) for i in items], "split string, frame_count long, output_bytes long")
    assert {r.split: (r["items"], r.frames, r.average_frames) for r in ingest.manifest_summary(table).collect()} == {"train": (2, 2, 1.0), "val": (1, 1, 1.0), "test": (0, 0, 0.0)}
    with pytest.raises(ValueError):
        media.frames_of(spark, "x", "other")


def test_calibration_documents(spark, tmp_path):
    doc = {"calibration_metadata": {"method": "p"}, "quantization": {"bits": 8, "mode": "global", "scale": [0.5], "zero_point": [3.0]}, "entropy_model": {"version": 1, "bits": 8, "frequencies": [[1]]}}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert media.read_calibration(spark, str(tmp_path / "c.json")).first().quantization.bits == 8
    del doc["entropy_model"]
    (tmp_path / "d.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="entropy_model"):
        media.read_calibration(spark, str(tmp_path / "d.json"))


def test_batches_and_means(spark):
    rows = spark.range(0, 19, 1, 5).select("id", (F.col("id") * 1.0).alias("v"))
    got = {r.id: r.batch_id for r in ingest.batches(rows, 4, order=["id"]).collect()}
    assert got == {i: i // 4 for i in range(19)}
    mean = metrics.mean_of_batches(ingest.batches(rows, 4, order=["id"]), "v").first().batch_mean_loss
    assert mean == pytest.approx((1.5 + 5.5 + 9.5 + 13.5 + 17) / 5)


def test_best_so_far(spark):
    h = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 2.0), (4, 1.0)], "epoch int, loss double")
    assert [r.is_best for r in metrics.running_best(h, epoch="epoch", loss="loss").orderBy("epoch").collect()] == [True, True, False, True]
    assert [r.epoch for r in metrics.resumed(h, h, epoch="epoch").orderBy("epoch").collect()] == list(range(1, 9))


def test_statistics_and_shapes(spark):
    rows = spark.createDataFrame([(f, c, c * 4 + i, float(v)) for f in range(4) for c, v in enumerate((1, -1, 0)) for i in range(4)], "frame_id long, channel int, pos int, x double")
    one = latents.statistics(rows).first()
    assert (one["mean"], one.n) == (0.0, 48) and one.zero_percent == pytest.approx(100 / 3)
    assert latents.statistics_rollup(rows).count() == 4
    wide = latents.to_wide(rows.orderBy(F.rand(1)))
    assert wide.first().x == [1.0] * 4 + [-1.0] * 4 + [0.0] * 4
    back = latents.to_long(wide, id_col="frame_id", array_col="x", plane=4)
    assert back.select("frame_id", "channel", "pos", "x").exceptAll(rows).count() == 0
    bad = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0]), (3, [0.0, float("nan")]), (4, [0.0, 2.0]), (5, None)], "id long, a array<double>")
    got = latents.validation_errors(bad, id_col="id", array_col="a", length=2, low=0, high=1)
    assert {r.frame_id: r.error for r in got.collect()} == {1: None, 2: "length", 3: "not_finite", 4: "range", 5: "missing"}
    centre = latents.flip_crop(spark.createDataFrame([(1, [float(i) for i in range(16)])], "id long, a array<double>"), id_col="id", array_col="a", height=4, width=4, crop=2, seed=0, train=False)
    assert centre.first().x == [5.0, 6.0, 9.0, 10.0]
