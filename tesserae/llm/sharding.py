"""Sharding by extendible hashing.

A row's place is a 60-bit hash of its id. The directory is indexed by the leading bits; a bucket that is larger than its byte limit is told apart
by one more bit, others stay as they are, so a shard is the shortest prefix whose rows fit. Sums are taken eight bits at a time: one
group-by gives the sums of all prefixes of those lengths, and only rows of buckets that are still too large take part in the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .mixing import HASH_BITS, hash60

STEP = 8
LIMIT = 1 << 26
#: Directories of so many bits or fewer, 65,536 rows at most, are broadcast.
BROADCAST_BITS = 16


def _directory(live: DataFrame, done: int, step: int, limit: int) -> DataFrame:
    """(p, depth, prefix, shard_bytes, shard_docs, fits) of each prefix p of done + step bits; depth is null where it has to be split on."""
    fine = live.groupBy(F.shiftright("h", HASH_BITS - done - step).alias("p")).agg(F.sum("b").alias("b"), F.count("*").alias("n"), F.min("h").alias("h0"), F.max("h").alias("h1"))
    fine = stage(fine, "prefixes")
    spread = fine.withColumn("j", F.explode(F.sequence(F.lit(0 if done == 0 else 1), F.lit(step)))).withColumn("q", F.expr(f"shiftright(p, {step} - j)"))
    sums = spread.groupBy("j", "q").agg(F.sum("b").alias("bytes"), F.sum("n").alias("docs"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
    leaves = sums.where((F.col("bytes") <= limit) | (F.col("h0") == F.col("h1"))).select("j", "q", "bytes", "docs")
    first = spread.select("p", "j", "q").join(leaves, ["j", "q"]).groupBy("p").agg(F.min_by(F.struct("j", "q", "bytes", "docs"), "j").alias("leaf"))
    return stage(fine.select("p").join(first, "p", "left").select(
        "p", (F.col("leaf.j") + done).cast("int").alias("depth"), F.col("leaf.q").alias("prefix"), F.col("leaf.bytes").alias("shard_bytes"),
        F.col("leaf.docs").alias("shard_docs"), (F.col("leaf.bytes") <= limit).alias("fits"),
    ), "directory")


def assign_shards(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, seed: str = "shard") -> DataFrame:
    """df with shard (the prefix as text of 0 and 1), shard_depth, shard_bytes, shard_docs and shard_fits.

    A row's size is that of its text in UTF-8 (null: 0). Every shard is the shortest prefix whose rows have ``limit`` bytes at most. What no bit can
    split, one row or rows of one id, is a shard even where it is larger; shard_fits is false then. Reruns agree. An empty table
    gives an empty one. Columns of those names are replaced.
    """
    names = ["shard", "shard_depth", "shard_bytes", "shard_docs", "shard_fits"]
    rows = df.drop(*names).withColumns({"__shard_h": hash60(F.col(id_col), seed), "__shard_b": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")})
    live = stage(rows.select(F.col("__shard_h").alias("h"), F.col("__shard_b").alias("b")), "sizes")
    done, found = 0, []
    while True:
        step = min(STEP, HASH_BITS - done)
        directory = _directory(live, done, step, limit)
        done += step
        found.append((done, directory.where("depth IS NOT NULL")))
        open_ = directory.where("depth IS NULL").select("p")
        if done >= HASH_BITS or open_.isEmpty():
            break
        live = stage(live.withColumn("p", F.shiftright("h", HASH_BITS - done)).join(open_, "p", "left_semi").drop("p"), "sizes")
    # a row is in one directory only: one pass over the rows asks them all
    fields = ["depth", "prefix", "shard_bytes", "shard_docs", "fits"]
    for bits, directory in found:
        entry = directory.select(F.col("p").alias(f"__shard_p{bits}"), F.struct(*fields).alias(f"__shard_e{bits}"))
        # a directory of so many bits has 2^bits rows at most
        entry = F.broadcast(entry) if bits <= BROADCAST_BITS else entry
        rows = rows.withColumn(f"__shard_p{bits}", F.shiftright("__shard_h", HASH_BITS - bits)).join(entry, f"__shard_p{bits}", "left")
    met = rows.withColumn("__shard_e", F.coalesce(*(f"__shard_e{bits}" for bits, _ in found)))
    bits = F.when(F.col("__shard_e.depth") == 0, "").otherwise(F.expr("lpad(bin(__shard_e.prefix), __shard_e.depth, '0')"))
    return met.select(
        *df.drop(*names).columns, bits.alias("shard"), F.col("__shard_e.depth").alias("shard_depth"), F.col("__shard_e.shard_bytes").alias("shard_bytes"),
        F.col("__shard_e.shard_docs").alias("shard_docs"), F.col("__shard_e.fits").alias("shard_fits"),
    )


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write df as Parquet, one folder of one file for each shard; ``shard`` there is the prefix after a b, as a folder needs a name."""
    sharded = assign_shards(df, **options).withColumn("shard", F.concat(F.lit("b"), "shard"))
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)
