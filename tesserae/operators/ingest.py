"""Dataset ingestion on item and frame tables: discovery, collisions, splits, sampling, quarantine, roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import half_even, safe_ratio, unit_hash
from ..sources.scratch import scratch_path

SPLITS = ("train", "val", "test")


def detect_source_type(files: DataFrame, videos: list[str], images: list[str]) -> DataFrame:
    """(source_type) of (suffix, depth): a video at depth 0 makes it video, else an image at depth 1 a sequence; else the query fails."""
    seen = files.agg(F.bool_or((F.col("depth") == 0) & F.col("suffix").isin(videos)).alias("v"), F.bool_or((F.col("depth") == 1) & F.col("suffix").isin(images)).alias("i"))
    return seen.select(F.when(F.col("v"), "video").when(F.col("i"), "image_sequence").otherwise(F.raise_error(F.lit("neither videos nor image sequences"))).alias("source_type"))


def list_frames(files: DataFrame, *, item: str, order: str) -> DataFrame:
    """files with frame_index, from 0 in the order of names."""
    return files.withColumn("frame_index", F.row_number().over(Window.partitionBy(item).orderBy(order)) - 1)


def probe_items(frames: DataFrame, *, item: str, size: str) -> DataFrame:
    """(item, frame_count, total_bytes, unreadable, error_code) of frames whose size may be null: they can't be read."""
    out = frames.groupBy(item).agg(F.count("*").alias("frame_count"), F.sum(size).alias("total_bytes"), F.count_if(F.col(size).isNull()).alias("unreadable"))
    return out.withColumn("error_code", F.when(F.col("unreadable") > 0, "corrupt"))


def inconsistent(frames: DataFrame, *, item: str, order: str, width: str, height: str) -> DataFrame:
    """Items with a frame unlike their first: (item, width, height of the first, first odd frame, odd frames)."""
    w = Window.partitionBy(item).orderBy(order)
    first = frames.withColumns({"w0": F.first(width).over(w), "h0": F.first(height).over(w)})
    odd = first.where((F.col(width) != F.col("w0")) | (F.col(height) != F.col("h0")))
    return odd.groupBy(item).agg(F.min("w0").alias("width"), F.min("h0").alias("height"), F.min(order).alias("first_odd"), F.count("*").alias("odd_frames"))


def key_collisions(items: DataFrame, *, key: str, path: str) -> DataFrame:
    """Keys of more than one item, with the first two."""
    named = items.select(F.col(key).alias("item_key"), F.col(path).alias("path"))
    counted = named.groupBy("item_key").agg(F.count("*").alias("n"), F.min("path").alias("first")).where("n > 1")
    second = named.withColumn("r", F.row_number().over(Window.partitionBy("item_key").orderBy("path"))).where("r = 2")
    return counted.join(second.select("item_key", F.col("path").alias("second")), "item_key")


def check_ratios(train: float, val: float, test: float) -> None:
    if abs(train + val + test - 1) > 1e-6 or min(train, val, test) < 0:
        raise ValueError(f"ratios must be 0 or more and sum to 1, not {train}, {val}, {test}")


def assign_splits(items: DataFrame, *, key: str, train: float, val: float, test: float, seed: int) -> DataFrame:
    """(item_key, split): exact quotas over a seeded order of the items. One row per item, so the one window over all of them is of items, not frames."""
    check_ratios(train, val, test)
    ranked = items.select(F.col(key).alias("item_key")).withColumns({
        "r": F.row_number().over(Window.orderBy(unit_hash(seed, F.col("item_key")), "item_key")), "n": F.count("*").over(Window.partitionBy()),
    })
    n_train = F.least(half_even(F.col("n") * train), F.col("n"))
    n_val = F.least(half_even(F.col("n") * val), F.col("n") - n_train)
    return ranked.select("item_key", F.when(F.col("r") <= n_train, "train").when(F.col("r") <= n_train + n_val, "val").otherwise("test").alias("split"))


def sample_every(frames: DataFrame, n: int, *, item: str, order: str) -> DataFrame:
    """Each n-th frame of an item by its place, with frame_index from 1 among those that stay."""
    if n < 1:
        raise ValueError("every how many frames must be 1 or more")
    w = Window.partitionBy(item).orderBy(order)
    placed = frames.withColumn("source_index", F.row_number().over(w) - 1).where(F.col("source_index") % n == 0)
    return placed.withColumn("frame_index", F.expr(f"source_index div {n} + 1").cast("int"))


def frame_name(item: Column, index: Column) -> Column:
    return F.format_string("%s_%06d.png", item.cast("string"), index)


def resize_geometry(frames: DataFrame, *, width: str, height: str, target_width: int, target_height: int) -> DataFrame:
    """frames with new_width, new_height, left, top and interpolation of a cover-scale and centre crop."""
    w, h = F.col(width), F.col(height)
    scale = F.greatest(target_width / w, target_height / h)
    out = frames.withColumns({
        "new_width": F.greatest(F.lit(target_width), half_even(w * scale).cast("int")), "new_height": F.greatest(F.lit(target_height), half_even(h * scale).cast("int")),
    })
    shrinks = (F.col("new_width") <= w) & (F.col("new_height") <= h)
    return out.withColumns({
        "left": F.floor((F.col("new_width") - target_width) / 2).cast("int"), "top": F.floor((F.col("new_height") - target_height) / 2).cast("int"),
        "interpolation": F.when(shrinks, "area").otherwise("linear"),
    })


def quarantine(items: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(sound items, rows of those with an error code)."""
    marked = items.withColumn("error_code", error)
    return marked.where("error_code IS NULL").drop("error_code"), marked.where("error_code IS NOT NULL")


def manifest_summary(items: DataFrame) -> DataFrame:
    """(split, items, frames, bytes, average) of (split, frame_count, output_bytes), splits without items included."""
    splits = items.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    sums = items.groupBy("split").agg(F.count("*").alias("items"), F.sum("frame_count").alias("frames"), F.sum("output_bytes").alias("bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    filled = splits.join(sums, "split", "left").select("split", zero(F.col("items")).alias("items"), zero(F.col("frames")).alias("frames"), zero(F.col("bytes")).alias("bytes"))
    return filled.withColumn("average_frames", safe_ratio(F.col("frames").cast("double"), F.col("items").cast("double"), 0.0))


def batches(frames: DataFrame, size: int, *, order: list, item: str | None = None) -> DataFrame:
    """frames with batch_id by the given order, within an item or over all. Over all, ranks come from sorted ranges, not from one task.

    The ranges are written to the shared scratch folder, as they are read twice and their bounds come from samples.
    """
    if item:
        return frames.withColumn("batch_id", F.expr("0") + F.floor((F.row_number().over(Window.partitionBy(item).orderBy(*order)) - 1) / size))
    spark = frames.sparkSession
    path = scratch_path(spark, "ranges")
    ranges = frames.orderBy(*order).withColumn("_part", F.spark_partition_id())
    ranges.write.parquet(path)
    ranges = spark.read.schema(ranges.schema).parquet(path)
    ranges = ranges.withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranges.join(before, "_part").withColumn("batch_id", F.expr(f"(_before + _in - 1) div {size}")).drop("_part", "_in", "_before")
