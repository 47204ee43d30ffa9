import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.config import Config
from tesserae.operators import container, model
from tesserae.sources import media, reports
from tesserae.streaming import encode_stream


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"seed": 7, "raw_dir": "x/y"}))
    got = Config.from_json(tmp_path / "c.json")
    assert (got.seed, got.raw_dir.name, got.batch_size) == (7, "y", 8) and got.to_dict()["raw_dir"] == "x/y"
    (tmp_path / "c.json").write_text(json.dumps({"sed": 7}))
    with pytest.raises(ValueError, match="sed"):
        Config.from_json(tmp_path / "c.json")


def test_checkpoints_and_reports(spark, tmp_path):
    weights = model.random_weights(0, in_channels=1, latent=2, base=1)
    reports.save_checkpoint(tmp_path / "w.npz", weights=weights, epoch=3, history=[{"epoch": 3}], config={"base": 1})
    back, meta = reports.load_checkpoint(tmp_path / "w.npz")
    assert all((back[k] == v).all() for k, v in weights.items()) and reports.next_epoch(meta) == 4
    table = spark.createDataFrame([(8, 1.5, "x")], "bits int, bpp double, note string")
    reports.write_csv(table, f"{tmp_path}/r", ["bpp", "bits"])
    assert [f.read_text().split() for f in (tmp_path / "r").glob("*.csv")] == [["bpp,bits", "1.5,8"]]
    reports.write_json(table, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().note == "x"


def test_calibration_gives_the_codec_back(spark, tmp_path):
    rng = np.random.default_rng(0)
    frames = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(60)], "frame_id long, x array<double>")
    rows = frames.select("frame_id", F.posexplode("x").alias("channel", "x")).withColumn("pos", F.col("channel"))
    for mode in ("per_channel", "global"):
        codec = container.fit_codec(rows, bits=5, mode=mode)
        media.write_calibration(codec, f"{tmp_path}/{mode}.json", frames=60)
        again = media.load_codec(spark, f"{tmp_path}/{mode}.json", shape=codec.shape, image=codec.image)
        assert again.model_id == codec.model_id
        x = [np.array(r.x) for r in frames.limit(9).collect()]
        assert again.encode(x) == codec.encode(x) and all((a == b).all() for a, b in zip(again.decode(codec.encode(x)), codec.symbols(np.stack(x)), strict=True))
        assert np.abs(codec.values(codec.symbols(np.stack(x))) - np.clip(np.stack(x), *np.percentile(np.stack(x), [0, 100]))).max() < 2
    doc = json.loads((tmp_path / "global.json").read_text())
    for change in ({"scale": [0.0]}, {"scale": [1.0, 1.0]}):
        (tmp_path / "bad.json").write_text(json.dumps(doc | {"quantization": doc["quantization"] | change}))
        with pytest.raises(ValueError):
            media.load_codec(spark, f"{tmp_path}/bad.json", shape=codec.shape, image=codec.image)


def test_stream_of_files(spark, tmp_path):
    frames = spark.createDataFrame([(i, [float(i % 5), 1.0 - i]) for i in range(30)], "frame_id long, x array<double>")
    frames.write.parquet(f"{tmp_path}/in")
    rows = frames.select("frame_id", F.posexplode("x").alias("channel", "x")).withColumn("pos", F.col("channel"))
    codec = container.fit_codec(rows, bits=4)
    encode_stream(spark, f"{tmp_path}/in", frames.schema, codec, array_col="x", to=f"{tmp_path}/out", checkpoint=f"{tmp_path}/state").awaitTermination()
    got = container.decode(spark.read.parquet(f"{tmp_path}/out"), codec)
    assert got.count() == 30 and got.where(F.size("symbols") != 2).count() == 0
