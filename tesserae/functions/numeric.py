"""Rounding, division, medians and PSNR as the codec defines them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column) -> Column:
    """Round to the nearest integer, ties to even, as a double."""
    return F.rint(x)


def float32_ratio(a: Column, b: Column) -> Column:
    """a / b in single precision: Spark divides floats as doubles, and rounding that once gives the same."""
    return (a.cast("float") / b.cast("float")).cast("float")


def safe_ratio(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(default))


def lower_median(x: str) -> Column:
    """The lower of the two middle values of an even count."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})")


def psnr(mse: Column, peak: float = 1.0) -> Column:
    """10 log10(peak^2 / mse), infinite for no error."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(peak * peak) / F.when(mse > 0, mse)))


def unit_hash(seed: int | str, key: Column) -> Column:
    """A sort key that shuffles: md5 of seed:key, the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
