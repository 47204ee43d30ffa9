"""Pixels. An embedding stands for an 8x8 frame: its values, shifted and cut to bytes, are red and blue, their complements green."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import model, pixels, training, video
from ..sources import bitstream, media
from ..sources import frames as frame_source
from ..sources import video as video_source
from ..sources.scratch import scratch_path
from .ingestion import table

SIDE, SMALL, CLIP, EVERY = 8, 4, 16, 3
SEED, EPOCHS, TRAIN_BATCH, RATE = 42, 3, 512, 0.05


def _values(spark, sf_dir):
    """(vec_id, v): the frame's values; embeddings of other sizes have another side and no place here."""
    value = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 64) + 128)).cast("int")
    return table(spark, sf_dir, "embeddings").where(F.size("embedding") == SIDE * SIDE).select("vec_id", F.transform("embedding", value).alias("v"))


def _byte(v):
    return F.lpad(F.hex(v), 2, "0")


def colour_frames(spark, sf_dir):
    rgb = F.transform("v", lambda v: F.concat(_byte(v), _byte(255 - v), _byte(v)))
    return _values(spark, sf_dir).select("vec_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.unhex(F.array_join(rgb, "")).alias("pixels"))


def _by_place(frames, side):
    """A row per pixel: (vec_id, y, x, red, green, blue)."""
    planes = F.transform("planes", lambda v: F.rint(v * 255).cast("int"))
    each = pixels.to_planes(frames).select("vec_id", planes.alias("p")).select("vec_id", F.posexplode(F.slice("p", 1, side * side)).alias("at", "red"), "p")
    return each.select(
        "vec_id", F.expr(f"at div {side}").cast("int").alias("y"), (F.col("at") % side).alias("x"), "red",
        F.element_at("p", F.col("at") + 1 + side * side).alias("green"), F.element_at("p", F.col("at") + 1 + 2 * side * side).alias("blue"),
    )


def png_round_trip(spark, sf_dir):
    files = pixels.encode_frames(colour_frames(spark, sf_dir)).select("vec_id", "data")
    return _by_place(pixels.decode_frames(files), SIDE)


def resized_frames(spark, sf_dir):
    return _by_place(pixels.resize_frames(colour_frames(spark, sf_dir), SMALL, SMALL), SMALL)


def jpeg_frames(spark, sf_dir):
    """Each value as a flat block of 8x8 in a grey JPEG file, which keeps it exactly; read again and averaged by block."""
    line = lambda y: F.repeat(F.array_join(F.transform(F.slice("v", y * SIDE + 1, SIDE), lambda v: F.repeat(_byte(v), 24)), ""), 8)
    wide = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), line), ""))
    frames = _values(spark, sf_dir).select("vec_id", F.lit(8 * SIDE).alias("height"), F.lit(8 * SIDE).alias("width"), wide.alias("pixels"))
    files = pixels.encode_frames(frames, kind="jpeg", quality=95, grey=True).select("vec_id", "data")
    return _by_place(pixels.resize_frames(pixels.decode_frames(files), SIDE, SIDE), SIDE)


def _clips(spark, sf_dir):
    """A folder of videos: an uncompressed AVI file of each CLIP embeddings by id, in the order of their ids."""
    frames = colour_frames(spark, sf_dir).withColumn("clip", F.floor(F.col("vec_id") / CLIP))
    grouped = frames.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("vec_id", "pixels"))).alias("frames"))  # CLIP frames at most

    def muxed(row):
        rows = [video.bitmap_rows(np.frombuffer(f["pixels"], np.uint8).reshape(SIDE, SIDE, 3)) for f in row.frames]
        return (video.write_avi(rows, codec="raw-bgr", width=SIDE, height=SIDE, rate=25),)

    files = pixels._mapped(grouped, "data binary", muxed).select(F.format_string("%08d", "clip").alias("name"), "data")
    bitstream.register(spark)
    folder = scratch_path(spark, "clips")
    files.write.format("bitstream").option("path", folder).option("suffix", ".avi").mode("append").save()
    return folder


def video_probe(spark, sf_dir):
    """What the headers of the clips say."""
    files = spark.read.format("binaryFile").load(_clips(spark, sf_dir)).select("path")
    got = video_source.probe_videos(files).select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("clip"), "container", "codec", "width", "height", "fps", "frame_count", "duration_seconds", "file_size_bytes", "error_code")
    return got


def video_frames(spark, sf_dir):
    """Every third frame of each clip, through the container, resizing (to its own size) and PNG."""
    frames = video_source.extract_frames(spark, _clips(spark, sf_dir), target_width=SIDE, target_height=SIDE, every=EVERY)
    read = pixels.decode_frames(frames.select(F.col("item").cast("long").alias("vec_id"), "frame_index", "name", "data"))
    each = read.select((F.col("vec_id") * 1000 + F.col("frame_index")).alias("vec_id"), "height", "width", "pixels")
    placed = _by_place(each, SIDE)
    return placed.select(F.expr("vec_id div 1000").alias("clip"), (F.col("vec_id") % 1000).alias("frame_index"), "y", "x", "red", "green", "blue")


def frame_access(spark, sf_dir):
    """The frames of a prepared folder by ordinal, through its manifest: items of CLIP frames each, every one in split train."""
    frames = colour_frames(spark, sf_dir).withColumns({"clip": F.format_string("%08d", F.floor(F.col("vec_id") / CLIP))})
    numbered = frames.withColumn("number", F.row_number().over(Window.partitionBy("clip").orderBy("vec_id")))
    home = scratch_path(spark, "dataset")
    bitstream.register(spark)
    files = pixels.encode_frames(numbered).select(F.format_string("clip_%s_%06d", "clip", "number").alias("name"), "data")
    files.write.format("bitstream").option("path", f"{home}/frames").option("suffix", ".png").mode("append").save()
    items = numbered.groupBy("clip").agg(F.count("*").alias("frame_count")).select(
        F.col("clip").alias("source_name"), F.lit("train").alias("split"), "frame_count", F.lit("frames").alias("frame_directory"), F.concat(F.lit("clip_"), "clip", F.lit("_{index:06d}.png")).alias("frame_filename_pattern")
    )
    media.write_manifest(items, items.limit(0).select("source_name", F.lit("").alias("message")), f"{home}/manifest")
    read = pixels.decode_frames(frame_source.read_split(spark, f"{home}/manifest", "train").select("ordinal", "source_name", "frame_index", "data"))
    placed = _by_place(read.withColumn("vec_id", F.struct("ordinal", "source_name", "frame_index")).select("vec_id", "height", "width", "pixels"), SIDE)
    return placed.select("vec_id.*", "y", "x", "red", "green", "blue")


def training_curve(spark, sf_dir):
    """Losses by epoch of a small autoencoder over all frames, each value being 2x2 pixels. All weights start at zero, so that the gradient
    reaches the last layer's biases only, whose course SQL can follow; tests train from random weights."""
    pixel = lambda v: F.concat(_byte(v), _byte(255 - v), _byte(v))
    line = lambda y: F.repeat(F.array_join(F.transform(F.slice("v", y * SIDE + 1, SIDE), lambda v: F.repeat(pixel(v), 2)), ""), 2)
    wide = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), line), ""))
    frames = _values(spark, sf_dir).select(F.col("vec_id").alias("frame_id"), wide.alias("pixels"))
    weights = {k: np.zeros_like(v) for k, v in model.random_weights(0, latent=2, base=2).items()}
    run = training.train(frames, frames, training.Run(weights, training.Adam(RATE)), shape=(3, 2 * SIDE, 2 * SIDE), epochs=EPOCHS, batch_size=TRAIN_BATCH, seed=SEED)
    rows = [(r["epoch"], round(r["train_loss"], 9), round(r["val_loss"], 9), round(r["val_psnr"], 7)) for r in run.history]
    return spark.createDataFrame(rows, "epoch int, train_loss double, val_loss double, val_psnr double")


QUERIES = {f.__name__: f for f in (png_round_trip, resized_frames, jpeg_frames, video_probe, video_frames, frame_access, training_curve)}

VALUES = f"""v AS (SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS k, greatest(0, least(255, floor(unnest(embedding)::DOUBLE * 64) + 128))::INT AS v
 FROM embeddings WHERE len(embedding) = {SIDE * SIDE})"""
ORACLES = {
    "png_round_trip": f"WITH {VALUES} SELECT vec_id, k // {SIDE} AS y, k % {SIDE} AS x, v AS red, 255 - v AS green, v AS blue FROM v",
    "resized_frames": f"""WITH {VALUES} SELECT vec_id, k // {SIDE} // 2 AS y, k % {SIDE} // 2 AS x, round_even(sum(v) / 4.0, 0)::INT AS red, round_even(sum(255 - v) / 4.0, 0)::INT AS green, round_even(sum(v) / 4.0, 0)::INT AS blue
 FROM v GROUP BY ALL""",
    "jpeg_frames": f"WITH {VALUES} SELECT vec_id, k // {SIDE} AS y, k % {SIDE} AS x, v AS red, v AS green, v AS blue FROM v",
    "video_probe": f"""SELECT vec_id // {CLIP} AS clip, 'riff' AS container, 'raw-bgr' AS codec, {SIDE} AS width, {SIDE} AS height, 25.0::DOUBLE AS fps, count(*) AS frame_count, count(*) / 25.0::DOUBLE AS duration_seconds,
 232 + count(*) * ({3 * SIDE * SIDE} + 8 + 16) AS file_size_bytes, NULL::VARCHAR AS error_code FROM embeddings WHERE len(embedding) = {SIDE * SIDE} GROUP BY ALL""",
    "video_frames": f"""WITH {VALUES}, n AS (SELECT *, dense_rank() OVER (PARTITION BY vec_id // {CLIP} ORDER BY vec_id) - 1 AS frame_index FROM v)
SELECT vec_id // {CLIP} AS clip, frame_index, k // {SIDE} AS y, k % {SIDE} AS x, v AS red, 255 - v AS green, v AS blue FROM n WHERE frame_index % {EVERY} = 0""",
    "frame_access": f"""WITH {VALUES}, n AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS ordinal, row_number() OVER (PARTITION BY vec_id // {CLIP} ORDER BY vec_id)::INT AS frame_index FROM (SELECT DISTINCT vec_id FROM v))
SELECT ordinal, lpad((vec_id // {CLIP})::VARCHAR, 8, '0') AS source_name, frame_index, k // {SIDE} AS y, k % {SIDE} AS x, v AS red, 255 - v AS green, v AS blue FROM v JOIN n USING (vec_id)""",
    "training_curve": f"""WITH RECURSIVE {VALUES},
 f AS (SELECT vec_id, c, avg(x) AS x, avg(x * x) AS xx FROM (SELECT vec_id, unnest([0, 1, 2]) AS c, unnest([v / 255.0::DOUBLE, (255 - v) / 255.0::DOUBLE, v / 255.0::DOUBLE]) AS x FROM v) GROUP BY ALL),
 o AS (SELECT vec_id, e, (row_number() OVER (PARTITION BY e ORDER BY md5('{SEED}:' || e || ':' || vec_id), vec_id) - 1) // {TRAIN_BATCH} AS b FROM (SELECT DISTINCT vec_id FROM v), range(1, {EPOCHS + 1}) r(e)),
 k AS (SELECT e, b, c, avg(x) AS x, avg(xx) AS xx, row_number() OVER (PARTITION BY c ORDER BY e, b) AS t FROM o JOIN f USING (vec_id) GROUP BY e, b, c),
 s AS (SELECT DISTINCT c, 0::BIGINT AS t, 0.0::DOUBLE AS bias, 0.0::DOUBLE AS m, 0.0::DOUBLE AS q, 0.0::DOUBLE AS loss FROM f
   UNION ALL SELECT c, t, bias - {RATE}::DOUBLE * (m / (1 - pow(0.9::DOUBLE, t))) / (sqrt(q / (1 - pow(0.999::DOUBLE, t))) + 1e-8::DOUBLE), m, q, loss
   FROM (SELECT c, t, bias, loss, 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g AS m, 0.999::DOUBLE * q + (1 - 0.999::DOUBLE) * g * g AS q
     FROM (SELECT s.c, k.t, s.bias, s.m, s.q, k.xx - 2 * y * k.x + y * y AS loss, 2.0::DOUBLE / 3 * (y - k.x) * y * (1 - y) AS g
       FROM (SELECT *, 1 / (1 + exp(-bias)) AS y FROM s) s JOIN k ON k.c = s.c AND k.t = s.t + 1))),
 l AS (SELECT e, avg(loss) AS train_loss FROM (SELECT k.e, k.b, avg(s.loss) AS loss FROM s JOIN k USING (c, t) GROUP BY k.e, k.b) GROUP BY e),
 h AS (SELECT c, b, avg(x) AS x, avg(xx) AS xx FROM (SELECT *, (dense_rank() OVER (ORDER BY vec_id) - 1) // {TRAIN_BATCH} AS b FROM f) GROUP BY c, b),
 z AS (SELECT k.e, k.c, 1 / (1 + exp(-s.bias)) AS y FROM (SELECT e, c, max(t) AS t FROM k GROUP BY e, c) k JOIN s USING (c, t)),
 w AS (SELECT e, b, avg(xx - 2 * y * x + y * y) AS mse FROM z JOIN h USING (c) GROUP BY e, b)
SELECT l.e::INT AS epoch, round(train_loss, 9) AS train_loss, round(avg(mse), 9) AS val_loss, round(avg(10 * log10(1 / mse)), 7) AS val_psnr FROM l JOIN w USING (e) GROUP BY l.e, train_loss""",
}
