"""Mixing sources to target weights with hash-threshold histograms.

A document's place is a 60-bit hash of its id. Words are summed by source and hash bucket; the running sum over a source's buckets finds
the bucket in which its budget ends, and only the documents of that bucket are summed again, ten bits finer, until it holds one hash.
Everything below the threshold is taken once more than everything above it. Budgets of several epochs are nested: whole epochs take
every document, and the rest of the budget sets the threshold. Nothing is sorted but the at most 1024 sums of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stage

HASH_BITS, STEP = 60, 10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(id_col: Column, seed: str) -> Column:
    """The first 60 bits of md5(seed:id); a null id hashes as the text null."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(named), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(key, source_size, target) of (key, source_size): ``share`` of all sizes by weight, capped at ``most`` times a source's size.

    Sources capped first are those of least cap over weight, so what capping frees goes to the others by weight in one pass. The window
    over all sources is as long as there are sources.
    """
    by_key = sizes.withColumn("rank", F.row_number().over(Window.orderBy("key")))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    caps = by_key.select("key", "source_size", w.alias("w"), (F.col("source_size") * most).alias("cap")).withColumn("per_w", F.col("cap") / F.col("w"))
    order = Window.orderBy("per_w", "key")
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    caps = caps.select(
        "*", (F.sum("source_size").over(total) * share).alias("budget"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    ).withColumn("capped", F.col("per_w") * F.col("w_left") <= F.col("budget") - F.col("before"))
    caps = caps.withColumn("free", F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(total), F.lit(0.0)))
    caps = caps.withColumn("w_free", F.sum(F.when(~F.col("capped"), F.col("w"))).over(total))
    return caps.select("key", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free") * F.col("w") / F.col("w_free")).alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, source_size, target, epochs, threshold): hashes below the threshold are taken epochs + 1 times, others epochs times."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("epochs", epochs).select(
        "*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("below"),
        F.lit(2).cast("long").alias("hashes"), F.lit(0).cast("long").alias("weighs"),
    )
    state, live = stage(state, "mix"), rows
    for done in range(0, HASH_BITS, STEP):
        up = HASH_BITS - done
        live = live.join(state.where("hashes > 1 and budget > 0").select("key", F.col("bucket").alias("in")), "key").where(F.shiftright("h", up) == F.col("in")).drop("in")
        sums = live.groupBy("key", F.shiftright("h", up - STEP).alias("b")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        running = F.sum("words").over(Window.partitionBy("key").orderBy("b"))
        cum = sums.join(state.select("key", "budget", "below"), "key").withColumn("cum", F.col("below") + running)
        # the first bucket that the budget doesn't cover; a key without one has a budget of all that is left
        edge = cum.where("cum > budget").groupBy("key").agg(F.min_by(F.struct("b", "words", "cum", F.when(F.col("h0") == F.col("h1"), 1).otherwise(2).alias("hashes")), "b").alias("e"))
        new = state.join(edge, "key", "left").select(
            "key", "source_size", "target", "epochs", "budget",
            F.coalesce("e.b", F.shiftleft("bucket", STEP)).alias("bucket"),
            F.coalesce(F.col("e.cum") - F.col("e.words"), "below").alias("below"),
            F.coalesce(F.col("e.hashes").cast("long"), F.when(F.col("hashes") > 1, 0).otherwise(F.col("hashes"))).alias("hashes"),
            F.coalesce("e.words", "weighs").alias("weighs"),
        )
        state = stage(new, "mix")
        if not state.where("hashes > 1 and budget > 0").limit(1).count():
            break
    shift = up - STEP
    # the last bucket is taken or left whole, whichever ends nearer the budget
    nearer = (2 * (F.col("budget") - F.col("below")) > F.col("weighs")).cast("long")
    at = F.shiftleft(F.col("bucket") + nearer, shift)
    return state.select("key", "source_size", "target", "epochs", F.when(F.col("budget") <= 0, F.lit(0)).when(F.col("hashes") == 0, F.lit(1 << HASH_BITS)).otherwise(at).alias("threshold"))


def mix_sources(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """df with the columns mix_size, mix_source_size, mix_target and mix_copies: how often the mix takes the row.

    A row's size is its number of words (null text: 0). Sources in code point order, a null one last, weigh ``weights``, repeating, and share
    ``share`` times all words; a source's target stops at ``most`` times its own words and what it leaves is shared by the others. Rows of
    the same id are taken alike; reruns agree. An empty table gives an empty one.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    sized = df.select("*", key.alias("__mix_key"), word_count(F.col(text_col)).alias("mix_size"), hash60(F.col(id_col), seed).alias("__mix_h"))
    rows = stage(sized.select(F.col("__mix_key").alias("key"), F.col("mix_size").alias("size"), F.col("__mix_h").alias("h")), "sizes")
    targets = source_targets(rows.groupBy("key").agg(F.sum("size").alias("source_size")), list(weights), share, most)
    cuts = stage(_thresholds(rows, targets), "thresholds").select(
        F.col("key").alias("__mix_key"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "epochs", "threshold"
    ).withColumnsRenamed({"epochs": "__mix_epochs", "threshold": "__mix_cut"})
    copies = F.col("__mix_epochs") + (F.col("__mix_h") < F.col("__mix_cut")).cast("long")
    return sized.join(cuts, "__mix_key").select(*df.columns, "mix_size", "mix_source_size", "mix_target", copies.alias("mix_copies"))


def take_mix(df: DataFrame, **options) -> DataFrame:
    """The rows of the mix, all columns of df, each as often as the mix takes it."""
    mixed = mix_sources(df, **options)
    return mixed.where("mix_copies > 0").withColumn("__mix_n", F.explode(F.sequence(F.lit(1).cast("long"), "mix_copies"))).select(*df.columns)
