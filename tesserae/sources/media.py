"""Listings of media files and the manifest's JSON forms."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The suffixes of videos and images.
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".webm")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png")

# The keys of the manifest's and the calibration's documents.
_RES = T.ArrayType(T.IntegerType())
ITEM = T.StructType([
    T.StructField("source_type", T.StringType()), T.StructField("source_name", T.StringType()), T.StructField("split", T.StringType()), T.StructField("frame_count", T.LongType()),
    T.StructField("original_resolution", _RES), T.StructField("processed_resolution", _RES), T.StructField("frame_directory", T.StringType()),
    T.StructField("frame_filename_pattern", T.StringType()), T.StructField("every_n_frames", T.IntegerType()), T.StructField("preserve_aspect_ratio", T.BooleanType()),
    T.StructField("original_fps", T.DoubleType()), T.StructField("original_frame_count", T.LongType()), T.StructField("output_bytes", T.LongType()),
])
MANIFEST = T.StructType([
    T.StructField("generated_at", T.StringType()), T.StructField("source_type", T.StringType()), T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("errors", T.ArrayType(T.StructType([T.StructField("source_name", T.StringType()), T.StructField("message", T.StringType())]))),
])
CALIBRATION = T.StructType([
    T.StructField("calibration_metadata", T.MapType(T.StringType(), T.StringType())),
    T.StructField("quantization", T.StructType([T.StructField("bits", T.IntegerType()), T.StructField("mode", T.StringType()), T.StructField("scale", T.ArrayType(T.DoubleType())), T.StructField("zero_point", T.ArrayType(T.DoubleType()))])),
    T.StructField("entropy_model", T.StructType([T.StructField("version", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("frequencies", T.ArrayType(T.ArrayType(T.LongType())))])),
])


def list_files(spark: SparkSession, root: str, *, recursive: bool = False) -> DataFrame:
    """(path, length) of the files under a root; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length")


def named(files: DataFrame) -> DataFrame:
    """files with directory, file, stem and suffix (lower-cased, with its dot)."""
    return files.withColumns({
        "directory": F.element_at(F.split("path", "/"), -2), "file": F.element_at(F.split("path", "/"), -1),
        "stem": F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), "suffix": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)),
    })


def write_manifest(items: DataFrame, errors: DataFrame, path: str, **settings) -> None:
    """One JSON document, as Spark writes it; items and errors are rows of the manifest."""
    one = items.agg(F.array_sort(F.collect_list(F.struct(*items.columns))).alias("items")).crossJoin(errors.agg(F.array_sort(F.collect_list(F.struct(*errors.columns))).alias("errors")))
    one.select(F.lit(json.dumps(settings)).alias("settings"), "items", "errors").coalesce(1).write.json(path)


def frames_of(spark: SparkSession, manifest: str, split: str) -> DataFrame:
    """(source_name, frame_index, path) of a split, from the manifest's counts and name patterns, without touching the frames."""
    if split not in ("train", "val", "test"):
        raise ValueError(f"no split {split!r}")
    items = spark.read.schema(MANIFEST).json(manifest, multiLine=True).select(F.explode("items").alias("i")).select("i.*").where(F.col("split") == split)
    rows = items.where("frame_count > 0").select("source_name", "frame_directory", F.regexp_extract("frame_filename_pattern", r"^(.*)_\{index", 1).alias("prefix"), F.explode(F.sequence(F.lit(1).cast("long"), "frame_count")).alias("frame_index"))
    return rows.select("source_name", "frame_index", F.format_string("%s/%s_%06d.png", "frame_directory", "prefix", "frame_index").alias("path"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """The calibration document as one row; a missing section raises."""
    row = spark.read.schema(CALIBRATION).json(path, multiLine=True)
    missing = [c for c in row.columns if row.where(F.col(c).isNull()).limit(1).count()]
    if missing or not row.limit(1).count():
        raise ValueError(f"{path} lacks {', '.join(missing) or 'everything'}")
    return row


def write_calibration(codec, path: str, **metadata) -> None:
    """The calibration document of a codec: metadata (with the mode it was fitted in), parameters, and tables. A file of the driver's."""
    import numpy as np

    from ..operators import entropy

    doc = {
        "calibration_metadata": {"method": f"percentile_{codec.mode}"} | {k: str(v) for k, v in metadata.items()},
        "quantization": {"bits": codec.bits, "mode": codec.mode, "scale": codec.scales.tolist(), "zero_point": codec.zero_points.tolist()},
        "entropy_model": {"name": entropy.MODEL_NAME, "version": entropy.MODEL_VERSION, "bits": codec.bits, "frequencies": np.diff(codec.cumulative, axis=1).tolist()},
    }
    with open(path, "w") as f:
        json.dump(doc, f, indent=2)


def load_codec(spark: SparkSession, path: str, *, shape: tuple[int, int, int], image: tuple[int, int, int]):
    """The codec of a calibration document. Other model versions, unequal lengths and scales that aren't positive raise ValueError."""
    from ..operators import container, entropy

    row = read_calibration(spark, path).first()
    q, e = row.quantization, row.entropy_model
    if e.version != entropy.MODEL_VERSION:
        raise ValueError(f"version {e.version} of the entropy model isn't known")
    if len(q.scale) != len(q.zero_point) or q.mode == "global" and len(q.scale) != 1 or not all(s > 0 for s in q.scale):
        raise ValueError(f"{path}: the parameters don't fit each other")
    freq = spark.createDataFrame([(t, s, n) for t, own in enumerate(e.frequencies) for s, n in enumerate(own)], "table int, symbol int, freq long")
    ids = entropy.model_id(freq, e.bits).first()["model_id"]
    return container.Codec(bits=q.bits, mode=q.mode, shape=shape, image=image, scales=q.scale, zero_points=q.zero_point, frequencies=e.frequencies, model_id=ids)
