import json
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from tesserae.jobs import coding, plots, prepare
from tesserae.jobs.__main__ import main
from tesserae.operators import drawing, jpeg, model, pixels
from tesserae.operators import video as containers
from tesserae.sources import frames as frame_source
from tesserae.sources import media


def shade(i, height=48, width=64):
    return np.full((height, width, 3), i * 15 % 256, np.uint8)


def sequences(root, counts, odd=None, broken=None):
    """Folders of JPEG and PNG images; one image of another size, one that isn't an image."""
    for name, count in counts.items():
        (root / name).mkdir(parents=True)
        for i in range(count):
            image = shade(i, 10) if odd == (name, i) else shade(i)
            data = b"broken" if broken == (name, i) else jpeg.encode_jpeg(image, quality=100) if i % 2 == 0 else pixels.encode_png(image)
            (root / name / f"{i:05d}.{'jpg' if i % 2 == 0 else 'png'}").write_bytes(data)
        (root / name / "readme.txt").write_text("ignored")


def run(spark, capsys, *argv):
    code = main([str(a) for a in argv], spark)
    said = capsys.readouterr()
    return code, said.out, said.err


def test_sequences_to_splits(spark, tmp_path, capsys):
    sequences(tmp_path / "raw", {"bear": 8, "camel": 6, "dog": 6, "goat": 4, "hen": 3, "ibis": 3}, odd=("hen", 1), broken=("ibis", 2))
    (tmp_path / "raw" / "empty").mkdir()
    args = ["prepare", "--input", tmp_path / "raw", "--output", tmp_path / "frames", "--manifest", tmp_path / "manifest.json", "--width", 32, "--height", 32, "--every-n-frames", 2, "--train-ratio", 0.5, "--val-ratio", 0.25, "--test-ratio", 0.25]
    code, out, err = run(spark, capsys, *args)
    assert code == 0 and "image_sequence: 6 items found, 4 prepared, 2 left out" in out, (out, err)
    doc = json.loads((tmp_path / "manifest.json").read_text())
    assert {e["source_name"]: e["message"] for e in doc["errors"]} == {"ibis": "NOT_IMAGE", "hen": "INCONSISTENT_SIZE"}
    assert {i["source_name"]: i["frame_count"] for i in doc["items"]} == {"bear": 4, "camel": 3, "dog": 3, "goat": 2} and doc["source_type_auto_detected"] and doc["summary"]["total_frames_extracted"] == 12
    item = doc["items"][0]
    assert (item["original_resolution"], item["processed_resolution"], item["frame_directory"], item["frame_filename_pattern"]) == ([64, 48], [32, 32], f"frames/{item['split']}", "bear_{index:06d}.png")
    written = sorted(p.name for p in (tmp_path / "frames").glob("*/*.png"))
    assert len(written) == 12 and written[:2] == ["bear_000001.png", "bear_000002.png"]
    for split in {i["split"] for i in doc["items"]}:
        index = frame_source.load_index(str(tmp_path / "manifest.json"), split)
        for k in range(len(index)):
            got = frame_source.frame(index, k, height=32, width=32)
            assert np.abs(got.astype(int) - (index.locate(k)[1] - 1) * 30).max() <= 2
    # nothing to do again, and nothing is decoded again where only the manifest is missing
    stamp = {p: p.stat().st_mtime_ns for p in (tmp_path / "frames" / "_work").glob("*/part-*")}
    assert run(spark, capsys, *args)[0] == 0 and json.loads((tmp_path / "manifest.json").read_text()) == doc
    (tmp_path / "manifest.json").unlink()
    assert run(spark, capsys, *args)[0] == 0 and json.loads((tmp_path / "manifest.json").read_text())["items"] == doc["items"]
    assert stamp and {p: p.stat().st_mtime_ns for p in (tmp_path / "frames" / "_work").glob("*/part-*")} == stamp


def test_an_odd_frame_that_is_not_sampled_leaves_the_item(spark, tmp_path):
    sequences(tmp_path / "raw", {"hen": 4, "owl": 2}, odd=("hen", 2))
    doc = prepare.prepare_dataset(spark, str(tmp_path / "raw"), str(tmp_path / "frames"), str(tmp_path / "m.json"), target_width=16, target_height=16)
    assert [i["source_name"] for i in doc["items"]] == ["owl"] and doc["errors"] == [{"source_name": "hen", "message": "INCONSISTENT_SIZE"}]


def test_videos_to_splits(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    clip = containers.write_avi([jpeg.encode_jpeg(shade(i), quality=100) for i in range(10)], codec="MJPG", width=64, height=48, rate=10)
    for name in ("a.avi", "b.avi"):
        (tmp_path / "raw" / name).write_bytes(clip)
    (tmp_path / "raw" / "c.mp4").write_bytes(b"not a real video file" * 10)
    args = ["prepare", "--input", tmp_path / "raw", "--output", tmp_path / "frames", "--manifest", tmp_path / "m.json", "--width", 32, "--height", 32, "--every-n-frames", 3]
    code, out, err = run(spark, capsys, *args)
    assert code == 0, err
    doc = json.loads((tmp_path / "m.json").read_text())
    assert [(i["source_name"], i["frame_count"], i["original_fps"], i["original_frame_count"]) for i in doc["items"]] == [("a", 4, 10.0, 10), ("b", 4, 10.0, 10)] and doc["errors"] == [{"source_name": "c", "message": "NOT_VIDEO"}]
    (tmp_path / "raw" / "a.mov").write_bytes(clip)
    code, _, err = run(spark, capsys, *args)
    assert code == 1 and "a.avi" in err and "a.mov" in err


def test_what_cannot_be_prepared(spark, tmp_path, capsys):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "x.txt").write_text("x")
    args = ["prepare", "--input", tmp_path / "raw", "--output", tmp_path / "f", "--manifest", tmp_path / "m.json"]
    for more, said in (([], "neither"), (["--source-type", "video"], "no video items"), (["--every-n-frames", 0], "positive"), (["--train-ratio", 0.9], "ratios")):
        code, _, err = run(spark, capsys, *args, *more)
        assert code == 1 and said in err, err
    assert run(spark, capsys, *args[:1], "--input", tmp_path / "absent", *args[3:])[0] == 1
    with pytest.raises(SystemExit) as e:
        main(["prepare"], spark)
    assert e.value.code == 2


def test_from_frames_to_containers_and_back(spark, tmp_path, capsys):
    """Prepare, train, calibrate, encode, decode, reconstruct, and the drawings on the way."""
    sequences(tmp_path / "raw", {n: 4 for n in ("ant", "bee", "cat", "dog")})
    at = lambda name: str(tmp_path / name)
    assert run(spark, capsys, "prepare", "--input", at("raw"), "--output", at("frames"), "--manifest", at("m.json"), "--width", 32, "--height", 16, "--train-ratio", 0.5, "--val-ratio", 0.25, "--test-ratio", 0.25)[0] == 0
    small = ["--latent-channels", 4, "--base-channels", 2]
    code, out, err = run(spark, capsys, "train", "--manifest", at("m.json"), "--checkpoints", at("runs"), "--epochs", 2, "--batch-size", 4, *small)
    assert code == 0 and out.count("epoch") == 2, err
    assert run(spark, capsys, "train", "--manifest", at("m.json"), "--checkpoints", at("runs"), "--batch-size", 4, "--resume", at("runs/latest.npz"), *small)[0] == 0
    assert [r["epoch"] for r in json.loads((tmp_path / "runs" / "history.json").read_text())] == [1, 2, 3]
    assert run(spark, capsys, "train", "--manifest", at("m.json"), "--checkpoints", at("runs"), "--resume", at("runs/latest.npz"), "--latent-channels", 5, "--base-channels", 2)[0] == 1
    code, out, err = run(spark, capsys, "calibrate", "--manifest", at("m.json"), "--checkpoint", at("runs/best.npz"), "--output", at("cal/q.json"), "--plots", at("plots"))
    assert code == 0 and "4 scales, 4 tables" in out, err
    (tmp_path / "test").mkdir()
    for i in range(3):
        (tmp_path / "test" / f"f{i}.png").write_bytes(pixels.encode_png(shade(i, 16, 32)))
    (tmp_path / "test" / "wide.png").write_bytes(pixels.encode_png(shade(1, 32, 48)))
    paths = ["--checkpoint", at("runs/best.npz"), "--calibration", at("cal/q.json")]
    code, out, err = run(spark, capsys, "encode", "--input", at("test"), "--output", at("coded"), *paths)
    assert code == 0 and "4 files, 0 failed" in out, err
    code, out, err = run(spark, capsys, "decode", "--input", at("coded"), "--output", at("back"), "--reference", at("test"), *paths)
    assert code == 0 and "4 files, 0 failed" in out and "psnr" in out, err
    weights = coding.load_model(at("runs/best.npz"))
    code, out, _ = run(spark, capsys, "reconstruct", "--input", at("test"), "--output", at("again"), "--checkpoint", at("runs/best.npz"))
    assert code == 0
    x = shade(2, 16, 32).transpose(2, 0, 1)[None] / 255.0
    want = np.rint(model.decode(model.encode(x, weights), weights)[0].transpose(1, 2, 0) * 255)
    assert np.abs(pixels.decode_png((tmp_path / "again" / "f2.png").read_bytes()) - want).max() <= 1
    assert pixels.decode_png((tmp_path / "back" / "wide.png").read_bytes()).shape == (32, 48, 3)
    # files that can't be coded are reported, and the others are done
    (tmp_path / "test" / "bad.png").write_bytes(b"bad")
    (tmp_path / "test" / "size.png").write_bytes(pixels.encode_png(shade(1, 20, 20)))
    code, out, err = run(spark, capsys, "encode", "--input", at("test"), "--output", at("coded"), *paths)
    assert code == 1 and "6 files, 2 failed" in out and "bad: NOT_IMAGE" in err and "size: BAD_SIZE" in err
    assert run(spark, capsys, "encode", "--input", at("test"), "--output", at("coded"), "--checkpoint", at("none.npz"), "--calibration", at("cal/q.json"))[0] == 1
    # the test split's figures, by hand for one frame
    assert run(spark, capsys, "calibrate", "--manifest", at("m.json"), "--checkpoint", at("runs/best.npz"), "--output", at("cal/q4.json"), "--bits", 4)[0] == 0
    code, out, err = run(spark, capsys, "benchmark", "--manifest", at("m.json"), "--checkpoint", at("runs/best.npz"), "--calibration", at("cal/q4.json"), at("cal/q.json"), "--output", at("cal/report.json"))
    assert code == 0 and [line[:6] for line in out.splitlines()] == ["8 bits", "4 bits"], err
    report = json.loads((tmp_path / "cal" / "report.json").read_text())
    index, codec = frame_source.load_index(at("m.json"), "test"), media.load_codec(spark, at("cal/q.json"), shape=(4, 1, 2), image=(3, 16, 32))
    x = np.stack([frame_source.frame(index, k) for k in range(len(index))]).transpose(0, 3, 1, 2) / 255.0
    z = model.encode(x, weights).reshape(len(x), -1)
    sizes = np.array([len(b) for b in codec.encode(list(z))])
    error = ((model.decode(codec.values(codec.symbols(z)).reshape(-1, 4, 1, 2), weights) - x) ** 2).mean()
    r = report[0]
    assert (r["frames"], r["symbols_per_frame"], r["mean_total_bytes"], r["max_total_bytes"]) == (len(x), 8, sizes.mean(), sizes.max()) and abs(r["mse"] - error) < 1e-12 and abs(r["psnr_db"] + 10 * np.log10(error)) < 1e-9
    assert abs(r["mean_compression_ratio"] - (3 * 16 * 32 / sizes).mean()) < 1e-9 and r["entropy_coding_lossless"] and 0 <= r["clipped_percent"] < 50
    q = np.bincount(codec.symbols(z).ravel()) / z.size
    assert abs(r["test_empirical_entropy_bits_per_symbol"] + (q[q > 0] * np.log2(q[q > 0])).sum()) < 1e-9
    assert run(spark, capsys, "environment")[0] == 0
    # drawings
    assert run(spark, capsys, "inspect", "--manifest", at("m.json"), "--output", at("look"))[0] == 0 and pixels.decode_png((tmp_path / "look" / "samples.png").read_bytes()).ndim == 3
    assert run(spark, capsys, "plot-history", "--history", at("runs/history.json"), "--output", at("plots"))[0] == 0 and run(spark, capsys, "plot-history", "--history", at("no.json"), "--output", at("plots"))[0] == 1
    names = {p.name for p in (tmp_path / "plots").iterdir()}
    assert names == {"latent_histogram.svg", "latent_histogram_log.svg", "channel_mean_std.svg", "channel_range.svg", "channels.png", "loss.svg", "psnr.svg"}
    for name in names - {"channels.png"}:
        ET.parse(tmp_path / "plots" / name)
    originals = coding.read_images(spark, at("test")).where("name like 'f%'")
    made = plots.comparison_grid(originals, [coding.read_images(spark, at("back")), coding.read_images(spark, at("again"))], at("plots/compare.png"), 3)
    assert pixels.decode_png(open(made, "rb").read()).shape == (3 * 18 + 2, 3 * 34 + 2, 3)


def test_ticks_and_axes():
    assert drawing.ticks(0, 10) == [0, 2, 4, 6, 8, 10] and drawing.ticks(-0.3, 0.31) == [-0.2, 0, 0.2] and drawing.ticks(3, 3) == [3]
    axis = drawing.Axis(0, 50, 100, 200)
    assert (axis(0), axis(25), axis(50), axis(99)) == (100, 150, 200, 200)
    log = drawing.Axis(3, 900, 0, 300, log=True)
    assert log.marks() == [1, 10, 100, 1000] and abs(log(10) - 100) < 1e-9 and log(0) == 0
    assert drawing.Axis(5, 5, 0, 10)(5) == 5 and drawing.Axis(0, 0, 0, 1, log=True)(0) == 0


def heights(svg):
    return [float(r.get("height")) for r in ET.fromstring(svg).iter("{http://www.w3.org/2000/svg}rect")][1:]


def test_bars_are_as_high_as_their_counts():
    made = heights(drawing.bars([0, 1, 2, 3], [10, 0, 5], title="a < b & c", across="x"))
    assert len(made) == 2 and abs(made[0] / made[1] - 2) < 1e-3
    logged = heights(drawing.bars([0, 1, 2, 3], [1000, 1, 10], title="t", across="x", log=True))
    assert abs(logged[0] - 3 * logged[2]) < 0.05 and logged[1] == 0
    with pytest.raises(ValueError):
        drawing.bars([0, 1], [1, 2], title="", across="")


def test_lines_break_where_there_is_no_value():
    svg = ET.fromstring(drawing.lines([1, 2, 3, 4, 5], {"a": [1, 2, float("nan"), 3, None], "b": [5, 4, 3, 2, 1]}, band=([0] * 5, [1] * 5), title="t", across="x"))
    tag = lambda t: list(svg.iter("{http://www.w3.org/2000/svg}" + t))
    assert len(tag("polyline")) == 2 and len(tag("circle")) == 1 and len(tag("polygon")) == 1
    with pytest.raises(ValueError):
        drawing.lines([], {}, title="", across="")


def test_colours_and_grids():
    made = drawing.coloured(np.array([[0.0, 1.0], [0.5, float("nan")]]))
    assert made[0, 0].tolist() == drawing.STOPS[0].tolist() and made[0, 1].tolist() == drawing.STOPS[-1].tolist() and made[1, 0].tolist() == drawing.STOPS[2].tolist() and made[1, 1].tolist() == [128] * 3
    assert (drawing.coloured(np.ones((2, 2))) == drawing.STOPS[0]).all()
    tiles = [np.full((2, 3, 3), k, np.uint8) for k in range(5)]
    out = drawing.grid(tiles, gap=1, zoom=2)
    assert out.shape == (3 * 5 + 1, 2 * 7 + 1, 3) and (out[6:10, 8:14] == 3).all() and (out[0] == 255).all() and (out[11:15, 1:7] == 4).all()
    with pytest.raises(ValueError):
        drawing.grid([])
    assert pixels.decode_png(drawing.heatmaps([np.eye(4)] * 3)).shape == (36, 4 * 34 + 2, 3)
