"""Training histories and the storage and rate arithmetic of reports."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import psnr, safe_ratio


def mean_of_batches(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """The mean of the batches' means: a short last batch weighs as much as others."""
    each = rows.groupBy(*by, "batch_id").agg(F.avg(value).alias("m"))
    return each.groupBy(*by).agg(F.count("*").alias("batches"), F.avg("m").alias("batch_mean_loss"))


def running_best(history: DataFrame, *, epoch: str, loss: str) -> DataFrame:
    """history with best_before and is_best, a strict improvement. One row per epoch, so one window holds them."""
    before = F.min(loss).over(Window.orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    out = history.withColumn("best_before", before)
    return out.withColumn("is_best", F.col("best_before").isNull() | (F.col(loss) < F.col("best_before")))


def resumed(history: DataFrame, later: DataFrame, *, epoch: str) -> DataFrame:
    """history with the rows of later after it, renumbered to follow its last epoch."""
    last = F.broadcast(history.agg(F.coalesce(F.max(epoch), F.lit(0)).alias("_last")))
    follow = later.withColumn("_r", F.row_number().over(Window.orderBy(epoch))).crossJoin(last).withColumn(epoch, (F.col("_last") + F.col("_r")).cast(dict(history.dtypes)[epoch])).drop("_r", "_last")
    return history.unionByName(follow)


def mse_psnr(pairs: DataFrame, a: str, b: str, peak: float = 1.0) -> DataFrame:
    """One row over array columns: squared errors are summed within arrays, so nothing is exploded."""
    each = pairs.select(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, d: s + d).alias("se"), F.size(a).alias("n"))
    return each.agg(safe_ratio(F.sum("se"), F.sum("n")).alias("mse")).withColumn("psnr_aggregate", psnr(F.col("mse"), peak))


def storage_table(latents: DataFrame, n_values: str, image: tuple[int, ...], widths: tuple[int, ...] = (32, 8, 6, 4)) -> DataFrame:
    """(n_values, frames, bits, total_bits, total_bytes, raw_size_ratio) by size of a latent, against 8 bits an image value. Raw sizes of a frame,
    not compression ratios; sizes that are null or 0 have none."""
    pixels = math.prod(image)
    sizes = latents.where(F.col(n_values) > 0).groupBy(F.col(n_values).cast("long").alias("n_values")).agg(F.count("*").alias("frames"))
    rows = sizes.select("*", F.explode(F.array(*map(F.lit, widths))).alias("bits")).withColumn("total_bits", F.col("n_values") * F.col("bits"))
    return rows.withColumn("total_bytes", F.col("total_bits") / 8.0).withColumn("raw_size_ratio", F.lit(pixels * 8.0) / F.col("total_bits"))


def rate_report(coded: DataFrame, *, pixels: int, channels: int, symbols: int, bits: int) -> DataFrame:
    """One row over (total_bytes, payload_bytes): sizes, bits per pixel and symbol, and the mean of the frames' ratios."""
    raw = float(pixels * channels * 8)
    t, p = F.col("total_bytes") * 8.0, F.col("payload_bytes") * 8.0
    return coded.agg(
        F.lit(bits).alias("bits"), F.count("*").alias("frames"), F.avg("payload_bytes").alias("mean_payload_bytes"), F.avg("total_bytes").alias("mean_total_bytes"),
        F.min("total_bytes").alias("min_total_bytes"), F.max("total_bytes").alias("max_total_bytes"), F.avg(t / pixels).alias("mean_total_bpp"),
        F.avg(p / pixels).alias("mean_payload_bpp"), F.avg(raw / t).alias("mean_compression_ratio"), F.min(raw / t).alias("min_compression_ratio"),
        F.max(raw / t).alias("max_compression_ratio"), F.avg(p / symbols).alias("payload_bits_per_symbol"),
    )
