"""Statistics and quantization. An embedding stands for a latent of one-value channels, also for an 8x8 plane; lineitem for a long latent table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import psnr
from ..operators import latents as lt
from ..operators import quantize as qz
from .ingestion import SEED, table

BITS, LOWER, UPPER = 8, 0.1, 99.9


def rows(spark, sf_dir):
    return lt.to_long(table(spark, sf_dir, "embeddings"), id_col="vec_id", array_col="embedding", keep=("label",))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("channel"), F.col("l_extendedprice").alias("x"))


def _rounded(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


_STATS = ("mean", "std", "zero_percent", "near_zero_percent")


def latent_long(spark, sf_dir):
    return rows(spark, sf_dir).select("frame_id", "channel", "x")


def latent_wide(spark, sf_dir):
    wide = lt.to_wide(rows(spark, sf_dir))
    return wide.select("frame_id", F.size("x").alias("n"), F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"))


def latent_stats_global(spark, sf_dir):
    return _rounded(lt.statistics(_lines(spark, sf_dir)), *_STATS)


def latent_stats_channel(spark, sf_dir):
    return _rounded(lt.statistics(_lines(spark, sf_dir), "channel"), *_STATS)


def latent_stats_rollup(spark, sf_dir):
    return _rounded(lt.statistics_rollup(rows(spark, sf_dir)), *_STATS)


def latent_channel(spark, sf_dir):
    return lt.channel_of(table(spark, sf_dir, "embeddings"), id_col="vec_id", array_col="embedding", channel=3)


def range_spread(spark, sf_dir):
    return _rounded(lt.range_spread(rows(spark, sf_dir)), "spread")


def latent_histogram(spark, sf_dir):
    return lt.histogram(rows(spark, sf_dir))


def validate_frames(spark, sf_dir):
    return lt.validation_errors(table(spark, sf_dir, "embeddings"), id_col="vec_id", array_col="embedding", length=64, low=-2.5, high=2.5)


def flip_crop(spark, sf_dir):
    out = lt.flip_crop(table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64), id_col="vec_id", array_col="embedding", height=8, width=8, crop=5, seed=SEED)
    return out.select("frame_id", "flipped", "top", "left", F.posexplode("x").alias("pos", "x")).select("frame_id", "flipped", "top", "left", "pos", F.col("x").cast("double").alias("x"))


def params_minmax_global(spark, sf_dir):
    return qz.params(qz.minmax_ranges(rows(spark, sf_dir), "global"), BITS)


def params_minmax_channel(spark, sf_dir):
    return qz.params(qz.minmax_ranges(_lines(spark, sf_dir), "per_channel"), BITS)


def _train(spark, sf_dir):
    return rows(spark, sf_dir).where("label < 8")


def params_pct_global(spark, sf_dir):
    return _rounded(qz.params(qz.percentile_ranges(_train(spark, sf_dir), "global", LOWER, UPPER), BITS), "lo", "hi", "scale")


def params_pct_channel(spark, sf_dir):
    return _rounded(qz.params(qz.percentile_ranges(_train(spark, sf_dir), "per_channel", LOWER, UPPER), BITS), "lo", "hi", "scale")


def _calibrated(spark, sf_dir):
    return qz.params(qz.percentile_ranges(_train(spark, sf_dir), "per_channel", LOWER, UPPER), BITS)


def quantize_channel(spark, sf_dir):
    out = qz.quantize(rows(spark, sf_dir), _calibrated(spark, sf_dir), BITS)
    return out.groupBy("channel").agg(F.count("*").alias("n"), F.sum("q").alias("sum_q"), F.min("q").alias("min_q"), F.max("q").alias("max_q"))


def dequantize_error(spark, sf_dir):
    return _rounded(qz.errors(qz.quantize(rows(spark, sf_dir), _calibrated(spark, sf_dir), BITS), "channel"), "mse", "mae", "max_abs", "psnr_aggregate")


def clip_rate(spark, sf_dir):
    return _rounded(qz.clipping(rows(spark, sf_dir), _calibrated(spark, sf_dir), BITS), "clipped_percent")


def quant_experiment(spark, sf_dir):
    return _rounded(qz.experiment(rows(spark, sf_dir)), "mse", "mae", "max_abs", "psnr_aggregate")


def batch_dynamic(spark, sf_dir):
    own = rows(spark, sf_dir).withColumn("batch_id", F.expr("frame_id div 16"))
    return _rounded(qz.batch_dynamic(own, 6), "mse", "mae", "max_abs", "psnr_aggregate")


def mse_psnr(spark, sf_dir):
    half = F.transform("embedding", lambda x: F.rint(x.cast("double") * 4) / 4)
    pairs = table(spark, sf_dir, "embeddings").select("embedding", half.alias("other"))
    from ..operators.metrics import mse_psnr as both

    out = both(pairs, "embedding", "other")
    return out.select(F.round("mse", 6).alias("mse"), F.round("psnr_aggregate", 6).alias("psnr_aggregate"), psnr(F.lit(0.0)).alias("psnr_of_equal"))


QUERIES = {
    f.__name__: f
    for f in (
        latent_long, latent_wide, latent_stats_global, latent_stats_channel, latent_stats_rollup, latent_channel, range_spread, latent_histogram, validate_frames, flip_crop,
        params_minmax_global, params_minmax_channel, params_pct_global, params_pct_channel, quantize_channel, dequantize_error, clip_rate, quant_experiment, batch_dynamic, mse_psnr,
    )
}

LATENTS = "l AS (SELECT vec_id AS frame_id, label, unnest(range(0, len(embedding)))::INT AS channel, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_LINES = "l AS (SELECT l_linenumber AS channel, l_extendedprice AS x FROM lineitem)"
_STAT_SQL = """count(*) AS n, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, quantile_disc(x, 0.5) AS median,
 round(100.0::DOUBLE * count(*) FILTER (x = 0) / count(*), 6) AS zero_percent, round(100.0::DOUBLE * count(*) FILTER (abs(x) < 0.01) / count(*), 6) AS near_zero_percent"""


def params_sql(source: str, by: str, where: str, bits: int, minmax: bool = False) -> str:
    """CTE p: channel, lo, hi, scale, zero_point."""
    lo, hi = ("min(x)", "max(x)") if minmax else (f"quantile_cont(x, {LOWER / 100})", f"quantile_cont(x, {UPPER / 100})")
    return f"""p0 AS (SELECT {by} AS channel, {lo} AS lo, {hi} AS hi FROM {source} {where} {"GROUP BY channel" if by == "channel" else ""}),
 p1 AS (SELECT channel, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM p0),
 p2 AS (SELECT *, (hi - lo) / {2**bits - 1}::DOUBLE AS scale FROM p1), p AS (SELECT *, 0 - round_even(lo / scale, 0) AS zero_point FROM p2)"""


_PCT = params_sql("l", "channel", "WHERE label < 8", BITS)
_Q = f"q AS (SELECT frame_id, l.channel, x, scale, zero_point, round_even(x / scale, 0) + zero_point AS u, least(greatest(round_even(x / scale, 0) + zero_point, 0), {2**BITS - 1})::INT AS q FROM l JOIN p ON l.channel = p.channel)"
_ERR = """count(*) AS n, round(avg(d * d), 6) AS mse, round(avg(abs(d)), 6) AS mae, round(max(abs(d)), 6) AS max_abs,
 round(CASE WHEN avg(d * d) = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(1.0::DOUBLE / avg(d * d)) END, 6) AS psnr_aggregate"""
_EXPERIMENT = " UNION ALL ".join(
    f"""SELECT * FROM (WITH {params_sql("l", by, "", bits, True)}
 SELECT '{mode}' AS mode, {bits} AS bits, {_ERR} FROM (SELECT x - (least(greatest(round_even(x / scale, 0) + zero_point, 0), {2**bits - 1}) - zero_point) * scale AS d FROM l JOIN p ON {"l.channel = p.channel" if mode == "per_channel" else "true"}))"""
    for bits in (8, 6, 4)
    for mode, by in (("global", "NULL::INT"), ("per_channel", "channel"))
)
_HEX = lambda k, n: f"(('0x' || substr(h, {k}, 6))::BIGINT % {n})"

ORACLES = {
    "latent_long": f"WITH {LATENTS} SELECT frame_id, channel, x FROM l",
    "latent_wide": "SELECT vec_id AS frame_id, len(embedding)::INT AS n, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings",
    "latent_stats_global": f"WITH {_LINES} SELECT {_STAT_SQL} FROM l",
    "latent_stats_channel": f"WITH {_LINES} SELECT channel, {_STAT_SQL} FROM l GROUP BY channel",
    "latent_stats_rollup": f"WITH {LATENTS} SELECT channel, {_STAT_SQL} FROM l GROUP BY ROLLUP (channel)",
    "latent_channel": "SELECT vec_id AS frame_id, embedding[4]::DOUBLE AS x FROM embeddings",
    "range_spread": f"WITH {LATENTS}, w AS (SELECT max(x) - min(x) AS w FROM l GROUP BY channel) SELECT min(w) AS min_range, max(w) AS max_range, round(max(w) / greatest(min(w), 1e-12), 6) AS spread FROM w",
    "latent_histogram": f"""WITH {LATENTS}, s AS (SELECT min(x) AS lo, max(x) AS hi FROM l) SELECT least(floor(coalesce((x - lo) / nullif(hi - lo, 0), 0) * 200), 199)::INT AS bin, count(*) AS n FROM l, s GROUP BY 1""",
    "validate_frames": """SELECT vec_id AS frame_id, CASE WHEN embedding IS NULL THEN 'missing' WHEN len(embedding) <> 64 THEN 'length'
 WHEN len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) > 0 THEN 'not_finite'
 WHEN list_min(embedding) < (-2.5 - 1e-5)::DOUBLE OR list_max(embedding) > (2.5 + 1e-5)::DOUBLE THEN 'range' END AS error FROM embeddings""",
    "flip_crop": f"""WITH e AS (SELECT vec_id AS frame_id, embedding, md5('{SEED}:' || vec_id) AS h FROM embeddings WHERE len(embedding) = 64),
 d AS (SELECT *, {_HEX(13, 2)} = 1 AS flipped, {_HEX(1, 4)}::INT AS top, {_HEX(7, 4)}::INT AS "left" FROM e), g AS (SELECT *, unnest(range(0, 25))::INT AS pos FROM d)
 SELECT frame_id, flipped, top, "left", pos, embedding[(top + pos // 5) * 8 + "left" + CASE WHEN flipped THEN 4 - pos % 5 ELSE pos % 5 END + 1]::DOUBLE AS x FROM g""",
    "params_minmax_global": f"WITH {LATENTS}, {params_sql('l', 'NULL::INT', '', BITS, True)} SELECT * FROM p",
    "params_minmax_channel": f"WITH {_LINES}, {params_sql('l', 'channel', '', BITS, True)} SELECT * FROM p",
    "params_pct_global": f"WITH {LATENTS}, {params_sql('l', 'NULL::INT', 'WHERE label < 8', BITS)} SELECT channel, round(lo, 6) AS lo, round(hi, 6) AS hi, round(scale, 6) AS scale, zero_point FROM p",
    "params_pct_channel": f"WITH {LATENTS}, {_PCT} SELECT channel, round(lo, 6) AS lo, round(hi, 6) AS hi, round(scale, 6) AS scale, zero_point FROM p",
    "quantize_channel": f"WITH {LATENTS}, {_PCT}, {_Q} SELECT channel, count(*) AS n, sum(q)::BIGINT AS sum_q, min(q) AS min_q, max(q) AS max_q FROM q GROUP BY channel",
    "dequantize_error": f"WITH {LATENTS}, {_PCT}, {_Q}, e AS (SELECT channel, x - (q - zero_point) * scale AS d FROM q) SELECT channel, {_ERR} FROM e GROUP BY channel",
    "clip_rate": f"""WITH {LATENTS}, {_PCT}, {_Q} SELECT count(*) FILTER (u < 0) AS clipped_low, count(*) FILTER (u > 255) AS clipped_high, count(*) FILTER (u < 0 OR u > 255) AS clipped_total, count(*) AS total,
 round(100.0::DOUBLE * count(*) FILTER (u < 0 OR u > 255) / count(*), 6) AS clipped_percent FROM q""",
    "quant_experiment": f"WITH {LATENTS} {_EXPERIMENT}",
    "batch_dynamic": f"""WITH {LATENTS}, b AS (SELECT *, frame_id // 16 AS batch_id FROM l), r AS (SELECT batch_id, channel, min(x) AS lo, max(x) AS hi FROM b GROUP BY ALL),
 w AS (SELECT batch_id, channel, CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS hi FROM r), s AS (SELECT *, (hi - lo) / 63::DOUBLE AS scale FROM w),
 p AS (SELECT *, 0 - round_even(lo / scale, 0) AS z FROM s), e AS (SELECT b.batch_id, x - (least(greatest(round_even(x / scale, 0) + z, 0), 63) - z) * scale AS d FROM b JOIN p USING (batch_id, channel))
 SELECT batch_id, {_ERR} FROM e GROUP BY batch_id""",
    "mse_psnr": f"""WITH {LATENTS}, e AS (SELECT x - round_even(x * 4, 0) / 4 AS d FROM l) SELECT round(avg(d * d), 6) AS mse, round(10 * log10(1.0::DOUBLE / avg(d * d)), 6) AS psnr_aggregate, 'inf'::DOUBLE AS psnr_of_equal FROM e""",
}
