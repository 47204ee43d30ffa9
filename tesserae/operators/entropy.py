"""Integer frequency tables, and what they say about symbols: all group-bys and windows over (table, symbol).

Tables have at most 2^16 symbols each, so the windows of a table are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the format: what a table sums to, the count added to every symbol, and the name and version that ids are made from.
TOTAL = 1 << 16
SMOOTHING = 1.0
MODEL_NAME = "empirical_per_channel_static_v1"
MODEL_VERSION = 1


def counts(symbols: DataFrame, bits: int) -> DataFrame:
    """(table, symbol, n) of (table, q), zeroes included."""
    seen = symbols.groupBy("table", F.col("q").alias("symbol")).agg(F.count("*").alias("n"))
    every = seen.select("table").distinct().select("table", F.explode(F.sequence(F.lit(0), F.lit(2**bits - 1))).alias("symbol"))
    return every.join(seen, ["table", "symbol"], "left").select("table", "symbol", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def frequencies(counted: DataFrame) -> DataFrame:
    """(table, symbol, freq): at least 1 each, TOTAL a table.

    Smoothed shares are floored, at 1 at least. What is left over goes to the most frequent symbols, one each in turn; what is too much is taken from
    them, from each as much as it can spare. Ties go by symbol.
    """
    whole = Window.partitionBy("table")
    share = (F.col("n") + SMOOTHING) / F.sum(F.col("n") + SMOOTHING).over(whole)
    floored = counted.select("table", "symbol", F.greatest(F.floor(share * TOTAL), F.lit(1)).cast("long").alias("f"))
    ranked = Window.partitionBy("table").orderBy(F.desc("f"), "symbol")
    with_rest = floored.select(
        "*", (F.lit(TOTAL) - F.sum("f").over(whole)).alias("rest"), F.row_number().over(ranked).alias("r"), F.count("*").over(whole).alias("k"),
        F.coalesce(F.sum(F.col("f") - 1).over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("spared"),
    )
    added = F.expr("rest div k") + F.when(F.col("r") <= F.col("rest") % F.col("k"), 1).otherwise(0)
    taken = F.greatest(F.lit(0), F.least(F.col("f") - 1, -F.col("rest") - F.col("spared")))
    return with_rest.select("table", "symbol", F.when(F.col("rest") >= 0, F.col("f") + added).otherwise(F.col("f") - taken).cast("long").alias("freq"))


def cumulative(table: DataFrame) -> DataFrame:
    up_to = F.sum("freq").over(Window.partitionBy("table").orderBy("symbol").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return table.select("table", "symbol", "freq", (up_to - F.col("freq")).alias("cum_lo"), up_to.alias("cum_hi"))


def violations(table: DataFrame) -> DataFrame:
    """Tables that can't be used: a frequency below 1 or a wrong total."""
    return table.groupBy("table").agg(F.min("freq").alias("least"), F.sum("freq").alias("total")).where((F.col("least") < 1) | (F.col("total") != TOTAL))


def model_entropy(table: DataFrame) -> DataFrame:
    p = F.col("freq") / TOTAL
    return table.groupBy("table").agg((-F.sum(p * F.log2(p))).alias("bits_per_symbol"))


def expected_bits(symbols: DataFrame, table: DataFrame, *by: str) -> DataFrame:
    """Ideal code length of the symbols under the tables. Symbols are counted before they meet the tables."""
    seen = symbols.groupBy(*by, "table", F.col("q").alias("symbol")).agg(F.count("*").alias("n"))
    return seen.join(table, ["table", "symbol"]).groupBy(*by).agg(F.sum("n").alias("symbols"), (-F.sum(F.col("n") * F.log2(F.col("freq") / TOTAL))).alias("expected_bits"))


def empirical_entropy(symbols: DataFrame, *by: str) -> DataFrame:
    """Bits per symbol of the symbols themselves, without smoothing; no row for no symbols."""
    seen = symbols.groupBy(*by, "q").agg(F.count("*").alias("n"))
    return seen.groupBy(*by).agg(F.sum("n").alias("symbols"), F.count("*").alias("observed"), (F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def summary(symbols: DataFrame, bits: int) -> DataFrame:
    """One row: possible, observed and total symbols, counts in order, entropy, and its distance from the fixed width."""
    counted = counts(symbols.withColumn("table", F.lit(0)), bits)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("symbol", "n"))), lambda s: s["n"])
    row = counted.agg(F.count("*").alias("possible"), F.count_if(F.col("n") > 0).alias("observed"), F.sum("n").alias("total"), ordered.alias("counts"))
    return row.crossJoin(empirical_entropy(symbols).select("entropy")).withColumn("headroom", F.lit(float(bits)) - F.col("entropy"))


def model_id(table: DataFrame, bits: int) -> DataFrame:
    """(model_id): first 8 bytes, as hex, of the SHA-256 of the tables written as JSON with sorted keys."""
    rows = table.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("symbol", "freq"))), lambda s: s["freq"].cast("string")).alias("f"))
    rows = rows.select("table", F.concat(F.lit("["), F.array_join("f", ", "), F.lit("]")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table", "row"))), lambda s: s["row"]), ", ")
    text = F.concat(F.lit(f'{{"bits": {bits}, "frequencies": ['), body, F.lit(f'], "name": "{MODEL_NAME}", "version": {MODEL_VERSION}}}'))
    return rows.agg(F.substring(F.sha2(text, 256), 1, 16).alias("model_id"))
