"""What a codec costs and gives on a split's frames: sizes, quality, entropy, clipping, times, a row per calibration."""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import psnr
from ..operators import container, model
from ..sources import media
from ..sources.scratch import scratch_path

#: Frames that are coded side by side.
TOGETHER = 16
_FRAME = "payload_bytes long, total_bytes long, squared_error double, clipped long, expected_bits double, lossless boolean, encode_seconds double, decode_seconds double, symbols array<int>"


def coded_frames(frames: DataFrame, weights: dict[str, np.ndarray], codec: container.Codec) -> DataFrame:
    """A row per frame of (pixels) of the codec's image size: through the encoder, the container and back, and the decoder."""
    c, height, width = codec.image
    shared = frames.sparkSession.sparkContext.broadcast((weights, codec))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, own = shared.value
        top = 2**own.bits - 1
        cost = -np.log2(np.diff(own.cumulative, axis=1) / own.cumulative[0, -1])
        for part in parts:
            for at in range(0, len(part), TOGETHER):
                x = np.stack([np.frombuffer(p, np.uint8) for p in part["pixels"].iloc[at : at + TOGETHER]]).reshape(-1, height, width, c).transpose(0, 3, 1, 2) / 255.0
                z = model.encode(x, w).reshape(len(x), -1)
                place = np.rint(z / own.scales[own.parameter]) + own.zero_points[own.parameter]
                q = own.symbols(z)
                began = time.perf_counter()
                blobs = own.encode(list(z))
                middle = time.perf_counter()
                back = own.decode(blobs)
                ended = time.perf_counter()
                y = model.decode(np.stack([own.values(b) for b in back]).reshape(-1, *own.shape), w)
                sizes = [len(b) for b in blobs]
                yield pd.DataFrame({
                    "payload_bytes": [n - container.header_size(len(own.scales)) for n in sizes], "total_bytes": sizes, "squared_error": ((y - x) ** 2).sum((1, 2, 3)), "clipped": ((place < 0) | (place > top)).sum(1),
                    "expected_bits": cost[own.tables[None, :], q].sum(1), "lossless": [bool((a == b).all()) for a, b in zip(back, q, strict=True)], "encode_seconds": (middle - began) / len(x), "decode_seconds": (ended - middle) / len(x), "symbols": list(q.astype(np.int32)),
                })

    return frames.where("pixels is not null").select("pixels").mapInPandas(task, _FRAME)


def benchmark(spark: SparkSession, frames: DataFrame, weights: dict[str, np.ndarray], calibrations: list[str], *, image: tuple[int, int, int]) -> DataFrame:
    """A row per calibration document over decoded frames of one size. ValueError where decoding doesn't give the symbols back, or without frames."""
    shape = (weights["up0.weight"].shape[0], image[1] // model.DOWN, image[2] // model.DOWN)
    out, values, symbols = None, image[0] * image[1] * image[2], shape[0] * shape[1] * shape[2]
    raw, area = values * 8.0, image[1] * image[2]
    for path in calibrations:
        codec = media.load_codec(spark, path, shape=shape, image=image)
        place = scratch_path(spark, "coded")
        coded_frames(frames, weights, codec).write.parquet(place)
        rows = spark.read.schema(_FRAME).parquet(place)
        total, payload = F.col("total_bytes") * 8.0, F.col("payload_bytes") * 8.0
        one = rows.agg(
            F.count("*").alias("frames"), F.lit(symbols).alias("symbols_per_frame"), (F.sum("squared_error") / (F.count("*") * values)).alias("mse"), F.avg("payload_bytes").alias("mean_payload_bytes"),
            F.avg("total_bytes").alias("mean_total_bytes"), F.min("total_bytes").alias("min_total_bytes"), F.max("total_bytes").alias("max_total_bytes"), F.lit(container.header_size(len(codec.scales))).alias("header_bytes"),
            (F.avg(payload) / area).alias("mean_payload_bpp"), (F.avg(total) / area).alias("mean_total_bpp"), (F.min(total) / area).alias("min_total_bpp"), (F.max(total) / area).alias("max_total_bpp"),
            F.avg(raw / total).alias("mean_compression_ratio"), F.min(raw / total).alias("min_compression_ratio"), F.max(raw / total).alias("max_compression_ratio"),
            (F.avg(payload) / symbols).alias("mean_payload_bits_per_symbol"), (F.avg(total) / symbols).alias("mean_total_bits_per_symbol"), (F.avg("expected_bits") / symbols).alias("model_expected_bits_per_symbol"),
            ((F.avg(payload) - F.avg("expected_bits")) / symbols).alias("coder_overhead_vs_model_bits_per_symbol"), (100.0 * F.sum("clipped") / (F.count("*") * symbols)).alias("clipped_percent"),
            F.avg("encode_seconds").alias("encode_seconds_per_frame"), F.avg("decode_seconds").alias("decode_seconds_per_frame"), F.bool_and("lossless").alias("entropy_coding_lossless"),
        )
        counts = rows.select(F.explode("symbols").alias("q")).groupBy("q").agg(F.count("*").alias("n"))
        whole = counts.agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        entropy = whole.select((F.log2("total") - F.col("s") / F.col("total")).alias("test_empirical_entropy_bits_per_symbol"))  # one row
        found = one.crossJoin(F.broadcast(entropy)).first()
        if not found.frames:
            raise ValueError("a benchmark without frames")
        if not found.entropy_coding_lossless:
            raise ValueError(f"{path}: decoding doesn't give the symbols back")
        row = spark.createDataFrame([found], one.crossJoin(entropy).schema).select(F.lit(codec.bits).alias("bits"), F.lit(codec.mode).alias("mode"), psnr(F.col("mse")).alias("psnr_db"), "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("a benchmark without calibrations")
    return out.orderBy(F.desc("bits"))
