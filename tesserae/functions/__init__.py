"""Column functions whose rounding and edge cases are part of the results."""

from .numeric import float32_ratio, half_even, lower_median, psnr, safe_ratio, unit_hash

__all__ = ["float32_ratio", "half_even", "lower_median", "psnr", "safe_ratio", "unit_hash"]
