"""Quality rules with an isolation forest over their statistics.

Every text is reduced to a handful of counts in one pass over its bytes. Random trees, grown on small subsamples of labelled
rows, isolate unusual rows after few splits; the mean path length gives a score in (0, 1), higher for odder rows. All labelled
rows, good and bad, set the score from which a document is rejected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stage

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits", "n_types"]
BASE = STATS[:5]
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATS. n_upper: A-Z; n_marks: ! and ?; n_lines: lines with a word; n_types: distinct words."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        return (0, 0, int(byte[_SYMBOLS].sum()), *[0] * 7)
    byte = np.bincount(np.frombuffer(b"".join(words), np.uint8), minlength=256)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    return (
        len(words), int(byte.sum() - byte[0x80:0xC0].sum()), int(byte[_SYMBOLS].sum()), dup, _repeated(at, len(ids)), lines,
        int(byte[65:91].sum()), int(byte[33] + byte[63]), int(byte[48:58].sum()), len(ids),
    )


def _repeated(at: np.ndarray, types: int) -> int:
    """Positions that lie in a window of three words found twice or more."""
    if len(at) < 4:
        return 0
    pairs = at[:-1] * types + at[1:]
    if types > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * types + at[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(at), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def statistics(text):
    """Struct column of the STATS of a text column, all long."""

    @F.pandas_udf(T.StructType([T.StructField(s, T.LongType()) for s in STATS]))
    def udf(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_statistics(t) for t in texts], columns=STATS, dtype="int64")

    return udf(text)


def features(s: pd.DataFrame) -> np.ndarray:
    """Rates, so that a long document isn't odd for being long."""
    words, chars = np.maximum(s["n_words"].to_numpy(float), 1), np.maximum(s["word_chars"].to_numpy(float), 1)
    return np.column_stack((
        np.log(chars / words), s["n_symbols"] / words, s["n_dup_lines"] / np.maximum(s["n_lines"], 1), s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_marks"] / words, s["n_digits"] / chars, np.log1p(words) - np.log1p(s["n_types"].to_numpy(float)),
    ))


class IsolationForest:
    """Random cuts over the space of the statistics, grown on good rows.

    Junk is common enough to shield itself from plain isolation trees, so trees see subsamples of good rows only, and a node's cuts
    are drawn from its cell, not from the span of its rows: a cell without good rows is a leaf at its depth, and rows that fall there
    have short paths. Axes are first mapped to quantiles of a sample with both kinds in equal weight, so that cuts fall where rows lie.
    A tree is flat arrays: axis (-1 at leaves), cut, left child (the right one follows it), path length at leaves.
    """

    def __init__(self, rows: np.ndarray, good: np.ndarray, *, trees: int, subsample: int, seed: int):
        rng = np.random.default_rng(seed)
        bad = rows[~good] if (~good).any() else rows
        self.axes = np.sort(np.concatenate((rows[good], np.resize(bad, rows[good].shape))), axis=0)
        self.size = min(subsample, int(good.sum()))
        own = self._mapped(rows[good]) if self.size > 1 else rows
        self.trees = [self._grow(own[rng.choice(len(own), self.size, replace=False)], rng) for _ in range(trees)] if self.size > 1 else []

    def _mapped(self, rows: np.ndarray) -> np.ndarray:
        return np.column_stack([(np.searchsorted(axis, x, "left") + np.searchsorted(axis, x, "right")) / (2 * len(axis)) for axis, x in zip(self.axes.T, rows.T, strict=True)])

    @staticmethod
    def expected(n: int) -> float:
        """Mean path of an unsuccessful search in a binary tree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator):
        feature, cut, left, path = [-1], [0.0], [0], [0.0]
        width, most = rows.shape[1], 2 * int(np.ceil(np.log2(len(rows))))
        todo = [(0, rows, 0, np.zeros(width), np.ones(width))]
        while todo:
            node, part, depth, low, high = todo.pop()
            if depth >= most or len(part) < 2:
                path[node] = depth + self.expected(len(part))
                continue
            f = int(rng.integers(width))
            at = rng.uniform(low[f], high[f])
            feature[node], cut[node], left[node] = f, at, len(feature)
            for right in (False, True):
                lo, hi = low.copy(), high.copy()
                (lo if right else hi)[f] = at
                todo.append((len(feature), part[(part[:, f] > at) == right], depth + 1, lo, hi))
                feature.append(-1), cut.append(0.0), left.append(0), path.append(0.0)
        return tuple(map(np.array, (feature, cut, left, path)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few cuts isolate; 0 without trees."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, rows = np.zeros(len(rows)), self._mapped(rows)
        for feature, cut, left, path in self.trees:
            node = np.zeros(len(rows), np.int64)
            live = np.arange(len(rows)) if feature[0] >= 0 else np.empty(0, np.int64)
            while len(live):
                n = node[live]
                node[live] = left[n] + (rows[live, feature[n]] > cut[n])
                live = live[feature[node[live]] >= 0]
            total += path[node]
        return 2 ** (-total / len(self.trees) / self.expected(self.size))


def _smallest(rows: DataFrame, most: int) -> pd.DataFrame:
    """The ``most`` rows of smallest h (then doc_id). A bound on h comes first, under which about twice as many lie, so that the partitions send no more
    than that together, however many there are; where repeated ids leave too few below it, it is raised."""
    share = 2 * most / max(1, rows.count())
    while True:
        below = rows if share >= 1 else rows.where(F.col("h") < F.lit(int(share * 2**64) - 2**63))
        sample = below.orderBy("h", "doc_id").limit(most).toPandas()
        if share >= 1 or len(sample) == most:
            return sample
        share *= 4


def quality_rules(
    df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1",
    trees: int = 200, subsample: int = 256, fit_rows: int = 25_600, clean_loss: float = 0.005, bins: int = 4000, seed: int = 7,
) -> DataFrame:
    """One row per input row: doc_id, the STATS, base_failed, score, threshold, kept, text_key.

    base_failed: under 50 words, or over half of the words in repeated windows. labels has id_col and what ``good`` asks for; of those
    labelled rows that pass the base rules, the ``fit_rows`` of smallest hash grow the forest, and all of them set the threshold: the one
    that rejects most bad rows while at most ``clean_loss`` of the good ones go. Nothing is rejected by score without labelled rows of
    both kinds. Null and empty texts have no words and fail the base rules. Ids may be null or repeat: each row has its own result.
    Other columns are ignored.
    """
    small_batches(df.sparkSession)
    rows = stage(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), statistics(F.col(text_col)).alias("s")).select("doc_id", "text_key", "s.*"), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.expr(good).cast("int")).alias("is_good"))
    labelled = rows.where("not base_failed").join(marks.where("is_good is not null"), "doc_id")
    sample = _smallest(labelled.select(F.xxhash64("doc_id", F.lit(seed)).alias("h"), "doc_id", *STATS, "is_good"), fit_rows)
    forest = IsolationForest(features(sample), sample["is_good"].to_numpy() == 1, trees=trees, subsample=subsample, seed=seed)

    @F.pandas_udf(T.DoubleType())
    def score(s: pd.DataFrame) -> pd.Series:
        return pd.Series(forest.score(features(s)))

    scored = rows.withColumn("score", score(F.struct(*STATS)))
    counts = (
        labelled.withColumn("bin", F.floor(score(F.struct(*STATS)) * bins)).groupBy("bin")
        .agg(F.sum("is_good").alias("good"), F.sum(1 - F.col("is_good")).alias("bad")).toPandas()
    )
    threshold = _threshold(counts, clean_loss, bins)
    kept = (~F.col("base_failed") & (F.col("score") < F.lit(threshold))).alias("kept")
    return scored.select("doc_id", *STATS, "base_failed", "score", F.lit(threshold).alias("threshold"), kept, "text_key")


def drop_low_quality(df: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of df that the rules keep, all columns. Rows of one id and text share their fate, which their text decides."""
    kept = quality_rules(df, labels, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias("__kept_id"), F.col("text_key").alias("__kept_key"))
    return df.join(kept, df[id_col].eqNullSafe(F.col("__kept_id")) & (F.xxhash64(df[text_col]) == F.col("__kept_key")), "left_semi")


def _threshold(counts: pd.DataFrame, clean_loss: float, bins: int) -> float:
    """The lowest edge of a bin with at most ``clean_loss`` of the good rows at or above it; 1 or more rejects nothing."""
    counts = counts.sort_values("bin", ascending=False)
    if counts.empty or not counts["good"].sum() or not counts["bad"].sum():
        return 2.0
    lost = counts["good"].cumsum() / counts["good"].sum()
    allowed = counts[(lost <= clean_loss)]
    if allowed.empty or not allowed["bad"].sum():
        return 2.0
    # the lowest bin that still rejects a bad row: what lies below it would only cost good ones
    return float(allowed[allowed["bad"] > 0]["bin"].iloc[-1]) / bins
