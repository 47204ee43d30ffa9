"""Latents: one array per frame, or one row per value (frame_id, channel, pos, x)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lower_median, safe_ratio


def to_long(frames: DataFrame, *, id_col: str, array_col: str, plane: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Explode arrays in channel-major order; a channel is ``plane`` values long."""
    rows = frames.select(F.col(id_col).alias("frame_id"), *keep, F.posexplode(array_col).alias("pos", "x"))
    return rows.select("frame_id", *keep, F.floor(F.col("pos") / plane).cast("int").alias("channel"), "pos", F.col("x").cast("double").alias("x"))


def to_wide(rows: DataFrame, value: str = "x") -> DataFrame:
    """One array per frame, ordered by pos whatever order the rows arrive in."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", value)))
    return rows.groupBy("frame_id").agg(F.transform(ordered, lambda s: s[value]).alias(value))


def channel_of(frames: DataFrame, *, id_col: str, array_col: str, channel: int) -> DataFrame:
    """One channel of one-value channels, without exploding the others."""
    return frames.select(F.col(id_col).alias("frame_id"), F.element_at(array_col, channel + 1).cast("double").alias("x"))


def _statistics(near: float):
    return [
        F.count("*").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), lower_median("x").alias("median"),
        (100.0 * F.count_if(F.col("x") == 0) / F.count("*")).alias("zero_percent"), (100.0 * F.count_if(F.abs("x") < near) / F.count("*")).alias("near_zero_percent"),
    ]


def statistics(rows: DataFrame, by: str | None = None, near: float = 0.01) -> DataFrame:
    return (rows.groupBy(by) if by else rows.groupBy()).agg(*_statistics(near))


def statistics_rollup(rows: DataFrame, near: float = 0.01) -> DataFrame:
    """Every channel and, with a null channel, all of them, in one pass."""
    return rows.rollup("channel").agg(*_statistics(near))


def range_spread(rows: DataFrame) -> DataFrame:
    """How much wider the widest channel is than the narrowest."""
    widths = rows.groupBy("channel").agg((F.max("x") - F.min("x")).alias("w"))
    return widths.agg(F.min("w").alias("min_range"), F.max("w").alias("max_range"), (F.max("w") / F.greatest(F.min("w"), F.lit(1e-12))).alias("spread"))


def histogram(rows: DataFrame, bins: int = 200) -> DataFrame:
    """(bin, n) over the span of the values; the last bin is closed, empty bins are left out."""
    span = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
    at = F.floor(safe_ratio(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo"), 0.0) * bins)
    return rows.crossJoin(F.broadcast(span)).select(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def validation_errors(frames: DataFrame, *, id_col: str, array_col: str, length: int, low: float, high: float, tolerance: float = 1e-5) -> DataFrame:
    """(frame_id, error): the first rule that a frame breaks, null for sound ones."""
    x = F.col(array_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    error = (
        F.when(x.isNull(), "missing").when(F.size(x) != length, "length").when(bad, "not_finite")
        .when((F.array_min(x) < low - tolerance) | (F.array_max(x) > high + tolerance), "range")
    )
    return frames.select(F.col(id_col).alias("frame_id"), error.alias("error"))


def flip_crop(frames: DataFrame, *, id_col: str, array_col: str, height: int, width: int, crop: int, seed: int, train: bool = True) -> DataFrame:
    """(frame_id, flipped, top, left, x): a seeded random crop and mirror for training, the centre crop else; frames are row-major planes."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    draw = lambda k, n: F.pmod(F.conv(F.substring(h, k, 6), 16, 10).cast("long"), F.lit(n)).cast("int")
    top = draw(1, height - crop + 1) if train else F.lit((height - crop) // 2)
    left = draw(7, width - crop + 1) if train else F.lit((width - crop) // 2)
    placed = frames.select(F.col(id_col).alias("frame_id"), (draw(13, 2) == 1 if train else F.lit(False)).alias("flipped"), top.alias("top"), left.alias("left"), F.col(array_col).alias("a"))
    line = lambda y: F.slice(F.col("a"), (F.col("top") + y) * width + F.col("left") + 1, F.lit(crop))
    rows = F.transform(F.sequence(F.lit(0), F.lit(crop - 1)), lambda y: F.when(F.col("flipped"), F.reverse(line(y))).otherwise(line(y)))
    return placed.select("frame_id", "flipped", "top", "left", F.flatten(rows).alias("x"))
