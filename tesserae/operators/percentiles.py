"""Exact percentiles of groups of any size, by histograms that are refined digit by digit.

A value's bits, read so that they sort as the value does, are cut into digits of 16 bits. The first pass counts first digits; each later one
counts, among values that share the digits found so far, the next. So a task holds counts, never values, and doubles take four passes, floats
two, however many rows there are. For each group, fraction and pass, two numbers come to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT = 16


def _kinds(bits: int) -> tuple[np.dtype, np.dtype]:
    return (np.dtype(np.float32), np.dtype(np.int32)) if bits == 32 else (np.dtype(np.float64), np.dtype(np.int64))


def sortable(x: np.ndarray, bits: int = 64) -> np.ndarray:
    """Integers that sort as the floats do; both zeros are one, NaN is above all."""
    floats, ints = _kinds(bits)
    own = np.where(np.isnan(x), np.nan, x + 0.0).astype(floats)
    raw = own.view(ints)
    return np.where(raw < 0, raw ^ np.iinfo(ints).max, raw).astype(np.int64)


def unsorted_value(key: int, bits: int = 64) -> float:
    """The float of a sortable integer."""
    floats, ints = _kinds(bits)
    raw = np.array([key], ints)
    return float(np.where(raw < 0, raw ^ np.iinfo(ints).max, raw).astype(ints).view(floats)[0])


def exact_percentiles(rows: DataFrame, keys: list[str | Column], x: str, fractions: list[float]) -> tuple[DataFrame, list[str]]:
    """(a row per group with its keys and p, the array of its interpolated percentiles; names of the keys). Nulls in x don't count.

    As ``percentile``: between two values, the nearer weighs more. A group without values has no row. Groups are counted on the driver, so
    there should be as many as channels, not as rows.
    """
    spark = rows.sparkSession
    bits = 32 if isinstance(rows.select(x).schema[0].dataType, T.FloatType) else 64
    named = rows.select(*keys, F.col(x).alias("_x")).where("_x is not null")
    names = named.columns[:-1]

    @F.arrow_udf("long")
    def key(values: pa.Array) -> pa.Array:
        return pa.array(sortable(values.to_numpy(zero_copy_only=False), bits))

    keyed = named.select(*names, key("_x").alias("_k"))
    count = named.groupBy(*names).agg(F.count("*").alias("_n")).collect()
    # wanted: group, place in order -> (digits so far, place among values that share them)
    wanted: dict[tuple, list] = {}
    for r in count:
        for f in fractions:
            at = f * (r["_n"] - 1)
            for place in {int(np.floor(at)), int(np.ceil(at))}:
                wanted[tuple(r[n] for n in names), place] = [0, place]
    kind = T.StructType([named.schema[n] for n in names] + [T.StructField("_prefix", T.LongType())])
    for left in range(bits - DIGIT, -1, -DIGIT):
        first = left == bits - DIGIT
        digit = F.shiftright("_k", left) if first else F.shiftright("_k", left).bitwiseAND((1 << DIGIT) - 1)
        digits = keyed.withColumns({"_prefix": F.lit(0).cast("long") if first else F.shiftright("_k", left + DIGIT), "_digit": digit})
        if not first:
            asked = spark.createDataFrame(sorted({(*g, p) for (g, _), (p, _) in wanted.items()}, key=repr), kind)
            on = [digits["_prefix"] == asked["_prefix"], *(digits[n].eqNullSafe(asked[n]) for n in names)]
            digits = digits.join(F.broadcast(asked), on, "left_semi")  # groups x fractions x 2 rows at most
        counts = digits.groupBy(*names, "_prefix", "_digit").agg(F.count("*").alias("_c"))
        below = F.coalesce(F.sum("_c").over(Window.partitionBy(*names, "_prefix").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        places = spark.createDataFrame([(*g, p, place, rest) for (g, place), (p, rest) in wanted.items()], T.StructType([*kind.fields, T.StructField("_place", T.LongType()), T.StructField("_rest", T.LongType())]))
        summed = counts.withColumn("_below", below)
        on = [summed["_prefix"] == places["_prefix"], *(summed[n].eqNullSafe(places[n]) for n in names), F.col("_below") <= F.col("_rest"), F.col("_rest") < F.col("_below") + F.col("_c")]
        for r in summed.join(F.broadcast(places), on).select(*(places[n] for n in names), "_place", "_digit", (F.col("_rest") - F.col("_below")).alias("_left"), places["_prefix"]).collect():
            wanted[tuple(r[n] for n in names), r["_place"]] = [r["_digit"] if first else (r["_prefix"] << DIGIT) | r["_digit"], r["_left"]]
    out = []
    for r in count:
        group, own = tuple(r[n] for n in names), []
        for f in fractions:
            at = f * (r["_n"] - 1)
            low, high = int(np.floor(at)), int(np.ceil(at))
            a, b = (unsorted_value(wanted[group, p][0], bits) for p in (low, high))
            own.append(a if low == high or a == b else (high - at) * a + (at - low) * b)
        out.append((*group, own))
    return spark.createDataFrame(out, T.StructType([named.schema[n] for n in names] + [T.StructField("p", T.ArrayType(T.DoubleType()))])), names
