"""Affine quantization with global or per-channel parameters.

A parameter table has one row (channel null) or a row per channel. The container's header counts channels in 16 bits, so it has at most 65,535
rows and is broadcast. float32=True computes as single-precision tensors do; the default is double precision, as the SQL beside the queries is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import float32_ratio, half_even, psnr, safe_ratio
from .percentiles import exact_percentiles

MODES = ("global", "per_channel")


def check(bits: int, mode: str) -> None:
    if isinstance(bits, bool) or not isinstance(bits, int) or not 1 <= bits <= 16:
        raise ValueError(f"bits must be an integer from 1 to 16, not {bits!r}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")


def _keys(mode: str) -> list:
    return ["channel"] if mode == "per_channel" else [F.lit(None).cast("int").alias("channel")]


def minmax_ranges(rows: DataFrame, mode: str, *by: str) -> DataFrame:
    return rows.groupBy(*by, *_keys(mode)).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def percentile_ranges(rows: DataFrame, mode: str, lower: float = 0.1, upper: float = 99.9) -> DataFrame:
    """Exact interpolated percentiles of each group, by refined histograms: counted at once, in memory that doesn't depend on the rows."""
    if not 0 <= lower < upper <= 100:
        raise ValueError(f"0 <= lower < upper <= 100 is asked for, not {lower}, {upper}")
    found, _ = exact_percentiles(rows, _keys(mode), "x", [lower / 100, upper / 100])
    return found.select("channel", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))


def params(ranges: DataFrame, bits: int, *, float32: bool = False) -> DataFrame:
    """(…, lo, hi, scale, zero_point); a range of no width is widened by a half on both sides. The zero point isn't clamped."""
    flat = F.col("lo") == F.col("hi")
    wide = ranges.withColumns({"lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")), "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi"))})
    ratio = float32_ratio if float32 else (lambda a, b: a / b)
    if float32:
        wide = wide.withColumns({"lo": F.col("lo").cast("float"), "hi": F.col("hi").cast("float")})
    return wide.withColumn("scale", ratio(F.col("hi") - F.col("lo"), F.lit(float(2**bits - 1)))).withColumn("zero_point", 0 - half_even(ratio(F.col("lo"), F.col("scale"))))


def with_params(rows: DataFrame, table: DataFrame, mode: str) -> DataFrame:
    table = table.select("scale", "zero_point", *(["channel"] if mode == "per_channel" else []))
    return rows.join(F.broadcast(table), "channel") if mode == "per_channel" else rows.crossJoin(F.broadcast(table))


def grid(x: Column, scale: Column, zero_point: Column, *, float32: bool = False) -> Column:
    """The place on the integer grid before clamping."""
    return half_even(float32_ratio(x, scale) if float32 else x / scale) + zero_point


def quantized(x: Column, scale: Column, zero_point: Column, bits: int, *, float32: bool = False) -> Column:
    return F.least(F.greatest(grid(x, scale, zero_point, float32=float32), F.lit(0.0)), F.lit(float(2**bits - 1))).cast("int")


def dequantized(q: Column, scale: Column, zero_point: Column) -> Column:
    return (q - zero_point) * scale


def quantize(rows: DataFrame, table: DataFrame, bits: int, mode: str = "per_channel", *, float32: bool = False) -> DataFrame:
    """rows with q and y, the value that q stands for."""
    check(bits, mode)
    out = with_params(rows, table, mode).withColumn("q", quantized(F.col("x"), F.col("scale"), F.col("zero_point"), bits, float32=float32))
    return out.withColumn("y", dequantized(F.col("q"), F.col("scale"), F.col("zero_point")))


def errors(rows: DataFrame, *by: str) -> DataFrame:
    """Mean squared, mean absolute and largest error of y against x, and PSNR of the mean over all."""
    d = F.col("x") - F.col("y")
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), safe_ratio(F.sum(d * d), F.count("*")).alias("mse"), safe_ratio(F.sum(F.abs(d)), F.count("*")).alias("mae"), F.max(F.abs(d)).alias("max_abs"))
    return out.withColumn("psnr_aggregate", psnr(F.col("mse")))


def clipping(rows: DataFrame, table: DataFrame, bits: int, mode: str = "per_channel") -> DataFrame:
    at = with_params(rows, table, mode).select(grid(F.col("x"), F.col("scale"), F.col("zero_point")).alias("u"))
    low, high = F.count_if(F.col("u") < 0), F.count_if(F.col("u") > 2**bits - 1)
    return at.agg(low.alias("clipped_low"), high.alias("clipped_high"), (low + high).alias("clipped_total"), F.count("*").alias("total"), safe_ratio(100.0 * (low + high), F.count("*")).alias("clipped_percent"))


def experiment(rows: DataFrame, bits: tuple[int, ...] = (8, 6, 4)) -> DataFrame:
    """Errors under every width and mode at once: the ranges are read once, and each value meets the few configurations."""
    both = minmax_ranges(rows, "global").withColumn("mode", F.lit("global")).union(minmax_ranges(rows, "per_channel").withColumn("mode", F.lit("per_channel")))
    tables = [params(both, b).withColumn("bits", F.lit(b)) for b in bits]
    table = tables[0]
    for t in tables[1:]:
        table = table.union(t)
    table = table.groupBy(F.col("channel").alias("c")).agg(F.collect_list(F.struct("mode", "bits", "scale", "zero_point")).alias("configs"))
    everywhere = F.broadcast(table.where("c is null").select(F.col("configs").alias("for_all")))
    met = rows.join(F.broadcast(table.where("c is not null")), rows["channel"] == F.col("c")).crossJoin(everywhere)
    met = met.select("x", F.explode(F.concat("configs", "for_all")).alias("k")).select("x", "k.*")
    q = F.least(F.greatest(grid(F.col("x"), F.col("scale"), F.col("zero_point")), F.lit(0.0)), F.pow(F.lit(2.0), F.col("bits")) - 1)
    return errors(met.withColumn("y", dequantized(q, F.col("scale"), F.col("zero_point"))), "mode", "bits")


def batch_dynamic(rows: DataFrame, bits: int) -> DataFrame:
    """Errors of each batch_id under parameters of its own."""
    table = params(minmax_ranges(rows, "per_channel", "batch_id"), bits).select("batch_id", "channel", "scale", "zero_point")
    met = rows.join(table, ["batch_id", "channel"])
    met = met.withColumn("y", dequantized(quantized(F.col("x"), F.col("scale"), F.col("zero_point"), bits), F.col("scale"), F.col("zero_point")))
    return errors(met, "batch_id")
