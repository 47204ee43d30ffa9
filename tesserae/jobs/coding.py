"""Images to containers and back, and through the model alone: folders of files in, folders of files out, a report per file."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import psnr
from ..operators import container, model, pixels
from ..sources import bitstream, media
from ..sources.reports import load_checkpoint
from .files import make_folder


def load_model(path: str, **sizes) -> dict[str, np.ndarray]:
    """The weights of a checkpoint, their shapes checked against the configuration stored beside them (or the given sizes). ValueError else."""
    weights, meta = load_checkpoint(path)
    wanted = {k: v.shape for k, v in model.random_weights(0, **(meta["config"].get("sizes", {}) | sizes)).items()}
    odd = sorted(k for k in wanted.keys() | weights.keys() if wanted.get(k) != getattr(weights.get(k), "shape", None))
    if odd:
        raise ValueError(f"{path}: {', '.join(odd)} don't fit the model")
    return weights


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, pixels, error_code) of an image file, or of those directly in a folder."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").alias("data"))
    named = media.named(files).where(F.col("suffix").isin(*media.IMAGE_SUFFIXES))
    return pixels.decode_frames(named.select(F.col("stem").alias("name"), "data"))


def _names(spark: SparkSession, path: str) -> DataFrame:
    return media.named(media.list_files(spark, path)).select(F.col("stem").alias("name")).distinct()


def _by_size(frames: DataFrame, each: Callable[[DataFrame, int, int], DataFrame]) -> DataFrame | None:
    """each(frames of one size, height, width), all together. Sizes are few: those of the files' cameras."""
    out = None
    for r in frames.where("pixels is not null").select("height", "width").distinct().orderBy("height", "width").collect():
        own = each(frames.where((F.col("height") == r.height) & (F.col("width") == r.width)), r.height, r.width)
        out = own if out is None else out.unionByName(own)
    return out


def _with(frames: DataFrame, columns: str, weights: dict[str, np.ndarray], each) -> DataFrame:
    """frames with the columns of each(row, weights); weights come by broadcast, once a worker."""
    shared = frames.sparkSession.sparkContext.broadcast(weights)
    return pixels._mapped(frames, columns, lambda row: each(row, shared.value))


def _plane_values(row) -> np.ndarray:
    return np.frombuffer(row.pixels, np.uint8).reshape(1, int(row.height), int(row.width), 3).transpose(0, 3, 1, 2) / 255.0


def _as_bytes(y: np.ndarray) -> bytes:
    return np.rint(np.clip(y[0], 0, 1) * 255).astype(np.uint8).transpose(1, 2, 0).tobytes()


def check_size(frames: DataFrame) -> DataFrame:
    """frames, those whose sides aren't multiples of the model's step being rows with the code BAD_SIZE."""
    fits = (F.col("height") % model.DOWN == 0) & (F.col("width") % model.DOWN == 0)
    bad = F.col("pixels").isNotNull() & ~fits
    return frames.withColumns({"error_code": F.when(bad, "BAD_SIZE").otherwise(F.col("error_code")), "pixels": F.when(~bad, F.col("pixels"))})


def latents_of(frames: DataFrame, weights: dict[str, np.ndarray], *, to: str = "latent") -> DataFrame:
    """frames with the encoder's output as a flat array of doubles."""
    return _with(frames, f"{to} array<double>", weights, lambda row, w: (None if row.pixels is None else model.encode(_plane_values(row), w).ravel(),))


def pixels_of(frames: DataFrame, weights: dict[str, np.ndarray], channels: int, *, array_col: str = "values") -> DataFrame:
    """frames (height, width, an array of a latent's values) with the decoder's pixels."""

    def each(row, w):
        z = np.asarray(getattr(row, array_col), float).reshape(1, channels, int(row.height) // model.DOWN, int(row.width) // model.DOWN)
        return (_as_bytes(model.decode(z, w)),)

    return _with(frames, "pixels binary", weights, each)


def encode_images(spark: SparkSession, path: str, output: str, *, checkpoint: str, calibration: str) -> DataFrame:
    """Write a container per image; (name, height, width, total_bytes, payload_bytes, compression_ratio, total_bpp, error_code), a row per image."""
    weights = load_model(checkpoint)
    channels = weights["up0.weight"].shape[0]
    frames = check_size(read_images(spark, path))
    bitstream.register(spark)
    make_folder(output)

    def each(own: DataFrame, height: int, width: int) -> DataFrame:
        codec = media.load_codec(spark, calibration, shape=(channels, height // model.DOWN, width // model.DOWN), image=(3, height, width))
        coded = container.encode(latents_of(own, weights), codec, array_col="latent").select("name", "height", "width", "data")
        coded.select("name", "data").write.format("bitstream").option("path", output).mode("append").save()
        written = spark.read.format("bitstream").option("path", output).load().select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), F.octet_length("data").alias("total_bytes"), F.col("payload_length").alias("payload_bytes"))
        return own.select("name", "height", "width").join(written, "name")

    made = _by_size(frames, each)
    bad = frames.where("error_code is not null").select("name", "error_code")
    if made is None:
        return bad.select("name", *(F.lit(None).cast(t).alias(c) for c, t in (("height", "int"), ("width", "int"), ("total_bytes", "int"), ("payload_bytes", "long"), ("compression_ratio", "double"), ("total_bpp", "double"))), "error_code")
    area = F.col("height") * F.col("width")
    made = made.withColumns({"compression_ratio": area * 3.0 / F.col("total_bytes"), "total_bpp": F.col("total_bytes") * 8.0 / area})
    return made.withColumn("error_code", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def decode_containers(spark: SparkSession, path: str, output: str, *, checkpoint: str, calibration: str, reference: str | None = None) -> DataFrame:
    """Write a PNG file per container; (name, height, width, mse, psnr, error_code), the errors against the image of that name in ``reference``."""
    weights = load_model(checkpoint)
    channels = weights["up0.weight"].shape[0]
    bitstream.register(spark)
    make_folder(output)
    parsed = spark.read.format("bitstream").option("path", path).load()
    head = container.parse(F.col("data"))["header"]
    read = parsed.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"), "data", F.col("error").alias("error_code"), head["image_height"].alias("height"), head["image_width"].alias("width"))
    frames = read.withColumn("pixels", F.when(F.col("error_code").isNull(), F.col("data")))

    def each(own: DataFrame, height: int, width: int) -> DataFrame:
        codec = media.load_codec(spark, calibration, shape=(channels, height // model.DOWN, width // model.DOWN), image=(3, height, width))

        @F.pandas_udf("array<double>")
        def values(symbols: pd.Series) -> pd.Series:
            return pd.Series([codec.values(np.asarray(q)) for q in symbols], dtype=object)

        z = container.decode(own.select("name", "height", "width", "data"), codec).withColumn("values", values("symbols"))
        return pixels_of(z.select("name", "height", "width", "values"), weights, channels).drop("values")

    made = _by_size(frames, each)
    bad = frames.where("error_code is not null").select("name", "error_code")
    return _written(spark, made, bad, _names(spark, path), output, reference)


def reconstruct_images(spark: SparkSession, path: str, output: str, *, checkpoint: str) -> DataFrame:
    """Write each image as the model gives it back; (name, height, width, mse, psnr, error_code) against the image itself."""
    weights = load_model(checkpoint)
    frames = check_size(read_images(spark, path))
    make_folder(output)

    def both(row, w):
        return (None if row.pixels is None else _as_bytes(model.decode(model.encode(_plane_values(row), w), w)),)

    made = _with(frames.where("pixels is not null").drop("error_code"), "again binary", weights, both).select("name", "height", "width", F.col("again").alias("pixels"))
    return _written(spark, made, frames.where("error_code is not null").select("name", "error_code"), _names(spark, path), output, path)


def _written(spark: SparkSession, made: DataFrame | None, bad: DataFrame, names: DataFrame, output: str, reference: str | None) -> DataFrame:
    """made (name, height, width, pixels) as PNG files, then read again and compared with the reference's images of the same names."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("height", "int"), ("width", "int"), ("mse", "double"), ("psnr", "double"))]
    if made is None:
        return bad.select("name", *empty, "error_code")
    bitstream.register(spark)
    pixels.encode_frames(made).select("name", "data").write.format("bitstream").option("path", output).option("suffix", ".png").mode("append").save()
    back = read_images(spark, output).where("error_code is null").drop("error_code").join(names, "name", "left_semi").join(bad, "name", "left_anti")
    if reference is None:
        out = back.select("name", "height", "width", *empty[2:])
    else:
        other = read_images(spark, reference).select("name", F.col("pixels").alias("other"))

        def off(row):
            if row.other is None or len(row.other) != len(row.pixels):
                return (None,)
            d = np.frombuffer(row.pixels, np.uint8).astype(float) - np.frombuffer(row.other, np.uint8)
            return (float((d * d).mean() / 255**2),)

        out = pixels._mapped(back.join(other, "name", "left"), "mse double", off).select("name", "height", "width", "mse", F.when(F.col("mse").isNotNull(), psnr(F.col("mse"))).alias("psnr"))
    return out.withColumn("error_code", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)
