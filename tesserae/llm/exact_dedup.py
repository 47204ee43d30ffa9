"""Exact dedup by a tree merge of sorted digest runs.

Rows are dealt into ``fan_in ** levels`` runs by a hash of their number in the staged table, so the copies of a hot text, and the rows of a
repeated or null id, lie in all runs; levels are as many as keep runs to RUN_ROWS rows. Each run is sorted by digest and reduced to one row
a digest. In every round, groups of ``fan_in`` partner runs exchange rows: one base-``fan_in`` digit of the run number
gives way to the matching digit of the digest, and the partners' rows are merged in the order of their digests, by a sort within the partition
and a sorted aggregate (Spark's shuffle doesn't keep the order of the runs, so they are sorted again rather than merged as they lie). Those of equal digest become one, with the extreme identifier, the sum of the counts, and the check that
their lengths and second digests agree. After the last round the run number is a prefix of the digest, so every digest lies in one run, no
run holds more than its share, and a hot text was never more than ``fan_in`` rows in one place. Decisions travel down the same tree: keys are
unique on one side of each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stage


#: Rows that a run has at most, on average: some hundred megabytes as they are sorted.
RUN_ROWS = 1 << 21


def levels_for(rows: int, fan_in: int) -> int:
    """Rounds of the tree, two at least: so many that ``fan_in ** levels`` runs of RUN_ROWS hold all rows."""
    levels = 2
    while rows > RUN_ROWS * fan_in**levels:
        levels += 1
    return levels


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(ascii_lower(F.col(text_col)), F.lit(""))
    return df.select(F.col(id_col).alias("doc_id"), text.alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.monotonically_increasing_id().alias("row"),  # holds once it is written
    )


def _merge(rows: DataFrame, keep: str) -> DataFrame:
    """One row a (run, digest), by merging sorted runs: the rows of a run, which come from several partners, are in one task in the order of their
    digests, and each digest's rows, side by side, become one."""
    best = F.max if keep == "max" else F.min
    runs = rows.repartition("run").sortWithinPartitions("run", "digest")
    # structs are compared while the order is walked; nothing is hashed
    out = runs.groupBy("run", "digest").agg(
        best(F.struct(F.col("keep_id").isNotNull().alias("some") if keep == "max" else F.col("keep_id").isNull().alias("none"), "keep_id")).alias("best"),
        F.sum("size").alias("size"), F.min(F.struct("check", "n_bytes")).alias("low"), F.max(F.struct("check", "n_bytes")).alias("high"),
    )
    verified = F.when(F.col("low") == F.col("high"), F.col("size")).otherwise(F.raise_error(F.lit("texts of equal SHA-256 differ")))
    return out.select("run", "digest", "best.keep_id", verified.cast("long").alias("size"), "low.check", "low.n_bytes")


def exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 16, levels: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the largest id
    (``keep='min'``: smallest) stays; a null id stays only if the group has no other. Repeated rows of
    the same id and text share the decision. Other columns are ignored, whatever their names. An empty table gives an empty table. ``levels`` is by
    default what the number of rows asks for.
    """
    rows = stage(_digests(df, id_col, text_col), "digests")
    if levels is None:
        levels = levels_for(rows.count(), fan_in)
    rows = rows.withColumn("run", F.pmod(F.xxhash64("row"), F.lit(fan_in**levels)).cast("int"))
    tree = [_merge(rows.select("run", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).alias("size"), "check", "n_bytes"), keep)]
    for level in range(levels):
        tree[-1] = stage(tree[-1], f"runs{level}")
        tree.append(_merge(tree[-1].withColumn("run", _exchanged(level, fan_in, levels)), keep))
    answer = tree[-1].select("run", "digest", "keep_id", "size")
    for level in reversed(range(levels)):
        asked = tree[level].select(F.col("run").alias("below"), "digest", _exchanged(level, fan_in, levels).alias("run"))
        answer = asked.join(answer, ["run", "digest"]).select(F.col("below").alias("run"), "digest", "keep_id", "size")
    return rows.join(answer, ["run", "digest"]).select(
        "doc_id", "keep_id", F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "n_bytes",
    )


def _exchanged(level: int, fan_in: int, levels: int):
    """The run number with its digit ``level`` replaced by that digit of the digest."""
    digest = F.pmod(F.conv(F.hex(F.substring(F.col("digest"), 1, 6)), 16, 10).cast("long"), F.lit(fan_in**levels))
    unit = fan_in**level
    digit = lambda c: F.pmod(F.floor(c / F.lit(unit)), F.lit(fan_in))
    return (F.col("run") + (digit(digest) - digit(F.col("run"))) * unit).cast("int")


def drop_exact_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of df that stay, all columns; of repeated rows of the same id and text, one."""
    marks = exact_duplicates(df, id_col=id_col, text_col=text_col, keep=keep).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("rows"))
    marks = marks.select(F.col("doc_id").alias("__dedup_id"), F.col("text_sha256").alias("__dedup_sha"), (F.col("rows") > 1).alias("__dedup_many"))
    sha = F.sha2(F.coalesce(ascii_lower(df[text_col]), F.lit("")), 256)
    joined = df.withColumn("__dedup_sha0", sha).join(marks, F.col(id_col).eqNullSafe(F.col("__dedup_id")) & (F.col("__dedup_sha0") == F.col("__dedup_sha")))
    once, many = joined.where("not __dedup_many"), joined.where("__dedup_many").dropDuplicates([id_col, "__dedup_sha0"])
    return once.select(*df.columns).unionByName(many.select(*df.columns))
