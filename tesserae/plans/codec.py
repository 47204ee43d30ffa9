"""Entropy models, coding and reports. lineitem's quantities stand for 6-bit symbols, its flag and status for their table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import container, entropy, metrics, model
from ..operators import latents as lt
from ..operators import quantize as qz
from . import latent
from .ingestion import table

IMAGE, BITS = (3, 256, 256), 6


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("table"), (F.col("l_quantity") - 1).cast("int").alias("q"))


def _tables(spark, sf_dir):
    return entropy.frequencies(entropy.counts(_symbols(spark, sf_dir), BITS))


def symbol_histogram(spark, sf_dir):
    return entropy.counts(_symbols(spark, sf_dir), BITS)


def empirical_entropy(spark, sf_dir):
    return entropy.empirical_entropy(_symbols(spark, sf_dir), "table").select("table", "symbols", "observed", F.round("entropy", 6).alias("entropy"))


def symbol_summary(spark, sf_dir):
    s = entropy.summary(_symbols(spark, sf_dir), BITS)
    return s.select("possible", "observed", "total", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"), F.round("entropy", 6).alias("entropy"), F.round("headroom", 6).alias("headroom"))


def freq_tables(spark, sf_dir):
    return _tables(spark, sf_dir)


def cumulative(spark, sf_dir):
    return entropy.cumulative(_tables(spark, sf_dir))


def model_entropy(spark, sf_dir):
    return entropy.model_entropy(_tables(spark, sf_dir)).select("table", F.round("bits_per_symbol", 6).alias("bits_per_symbol"))


def expected_bits(spark, sf_dir):
    return entropy.expected_bits(_symbols(spark, sf_dir), _tables(spark, sf_dir), "table").select("table", "symbols", F.round("expected_bits", 4).alias("expected_bits"))


def table_violations(spark, sf_dir):
    return entropy.violations(_tables(spark, sf_dir)).agg(F.count("*").alias("violations"))


def model_id(spark, sf_dir):
    return entropy.model_id(_tables(spark, sf_dir), BITS)


def storage_table(spark, sf_dir):
    return metrics.storage_table(table(spark, sf_dir, "embeddings").select(F.size("embedding").alias("n")), "n", IMAGE)


def three_way(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.size("embedding").cast("long").alias("n"))
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(b).alias("bits")) for k, b in (("raw", 32), ("fixed_8", 8), ("fixed_4", 4))))
    return e.select("n", F.explode(kinds).alias("k")).groupBy(F.col("k.kind").alias("kind")).agg(F.sum(F.col("n") * F.col("k.bits")).alias("total_bits"), F.count("*").alias("frames"))


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding")


def _codec(spark, sf_dir, bits=8, ranges=None):
    # calibration sees the train labels only
    return container.fit_codec(latent.rows(spark, sf_dir).where("label < 8"), bits=bits, image=IMAGE, ranges=ranges)


def encode_payload(spark, sf_dir):
    coded = container.encode(_frames(spark, sf_dir), _codec(spark, sf_dir), array_col="embedding")
    return coded.select("frame_id", F.sha2("data", 256).alias("sha256"), F.length("data").alias("total_bytes"))


def roundtrip_lossless(spark, sf_dir):
    codec = _codec(spark, sf_dir)
    both = container.decode(container.encode(_frames(spark, sf_dir), codec, array_col="embedding"), codec)
    scale, zero = F.array(*map(F.lit, codec.scales.tolist())), F.array(*map(F.lit, codec.zero_points.tolist()))
    grid = F.transform("embedding", lambda x, i: F.least(F.greatest(F.rint(x.cast("double") / F.element_at(scale, i + 1)) + F.element_at(zero, i + 1), F.lit(0.0)), F.lit(255.0)).cast("int"))
    wrong = F.aggregate(F.zip_with("symbols", grid, lambda a, b: F.when(a.eqNullSafe(b), 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return both.agg(F.sum(F.size("symbols")).alias("symbols"), F.sum(wrong).alias("mismatches"))


def header_fields(spark, sf_dir):
    coded = container.encode(_frames(spark, sf_dir), _codec(spark, sf_dir), array_col="embedding")
    h = coded.select("frame_id", container.parse(F.col("data")).alias("p")).select("frame_id", "p.header", "p.error")
    return h.select("frame_id", "header.bits", "header.mode", "header.image_width", "header.latent_channels", "header.symbol_count", F.size("header.scales").alias("parameters"), "error")


def container_errors(spark, sf_dir):
    """Damage to every container, by kind, and the error that reading it gives."""
    coded = container.encode(_frames(spark, sf_dir), _codec(spark, sf_dir), array_col="embedding").select("data")
    n = F.length("data")
    end = lambda k: F.expr(f"substring(data, {k}, length(data))")
    put = lambda at, hexed: F.concat(F.expr(f"substring(data, 1, {at})"), F.unhex(F.lit(hexed)), end(at + len(hexed) // 2 + 1))
    kinds = {
        "none": F.col("data"), "short": F.expr("substring(data, 1, 20)"), "magic": put(0, "00"), "version": put(4, "09"), "bits": put(5, "00"), "mode": put(6, "07"), "coder": put(7, "05"),
        "dimensions": put(8, "0000"), "symbol_count": put(19, "01000000"), "parameter_count": put(23, "0100"), "parameter_block": F.expr("substring(data, 1, 60)"), "scale": put(37, "00000000"),
        "payload_cut": F.expr("substring(data, 1, length(data) - 1)"), "trailing": F.concat("data", F.unhex(F.lit("00"))),
    }
    rows = coded.where(n > 0).select(F.explode(F.array(*(F.struct(F.lit(k).alias("damage"), v.alias("bytes")) for k, v in kinds.items()))).alias("d")).select("d.*")
    return rows.select("damage", container.parse(F.col("bytes"))["error"].alias("error")).groupBy("damage", "error").agg(F.count("*").alias("n"))


def codec_benchmark(spark, sf_dir):
    out, ranges = None, qz.percentile_ranges(latent.rows(spark, sf_dir).where("label < 8"), "per_channel")
    for bits in (8, 6, 4):
        codec = _codec(spark, sf_dir, bits, ranges)
        coded = container.encode(_frames(spark, sf_dir), codec, array_col="embedding").select(F.length("data").alias("total_bytes"))
        coded = coded.withColumn("payload_bytes", F.col("total_bytes") - container.header_size(len(codec.scales)))
        row = metrics.rate_report(coded, pixels=IMAGE[1] * IMAGE[2], channels=IMAGE[0], symbols=len(codec.tables), bits=bits)
        out = row if out is None else out.union(row)
    return out.orderBy(F.desc("bits"))


def coder_overhead(spark, sf_dir):
    """Bits a symbol above the tables' ideal length, over the symbols of each table of lineitem coded as frames of 16,384."""
    tables = _tables(spark, sf_dir)
    grid = tables.orderBy("table", "symbol").toPandas()  # 6 tables of 64
    cum = grid["freq"].to_numpy().reshape(-1, 2**BITS).cumsum(axis=1)
    names = sorted(grid["table"].unique())
    lines = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("table"), "l_orderkey", "l_linenumber", (F.col("l_quantity") - 1).cast("int").alias("q"))
    frame = F.pmod(F.xxhash64("l_orderkey"), F.greatest(F.lit(1), F.ceil(F.lit(lines.count() / 16384))).cast("long"))
    rows = lines.groupBy("table", frame.alias("frame")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "q"))), lambda s: s["q"]).alias("symbols"))

    def task(parts):
        import numpy as np

        from ..operators import coder

        padded = np.concatenate((np.zeros((len(cum), 1), np.int64), cum), axis=1)
        for pdf in parts:
            which = [np.full(len(s), names.index(t)) for s, t in zip(pdf["symbols"], pdf["table"], strict=True)]
            coded = coder.encode_frames(list(pdf["symbols"]), padded, which)
            yield pdf[["table", "frame"]].assign(payload_bits=[8 * len(b) for b in coded], symbols=[len(s) for s in pdf["symbols"]])

    coded = rows.mapInPandas(task, "table string, frame long, payload_bits long, symbols long").groupBy("table").agg(F.sum("payload_bits").alias("payload_bits"), F.sum("symbols").alias("symbols"))
    ideal = entropy.expected_bits(_symbols(spark, sf_dir), tables, "table").select("table", "expected_bits")
    return coded.join(ideal, "table").withColumn("overhead_bits_per_symbol", (F.col("payload_bits") - F.col("expected_bits")) / F.col("symbols"))


def model_parameters(spark, sf_dir):
    """Parameters of a model whose latents have as many channels as the embeddings have values, by that number; each channel adds as many."""
    none, one = (model.parameter_count(latent=n) for n in (0, 1))
    sizes = table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").alias("latent_channels")).agg(F.count("*").alias("frames"))
    return sizes.select("latent_channels", "frames", (F.lit(none) + F.col("latent_channels") * (one - none)).cast("long").alias("parameters"))


CONV = {"in_channels": 1, "latent": 4, "base": 2}


def conv_forward(spark, sf_dir):
    """Embeddings tiled to 16x16 planes through the encoder with seeded weights: latents of 4 values."""
    weights = model.random_weights(0, **CONV)
    tiled = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.concat(*["embedding"] * 4).alias("a"))
    coded = model.encode_table(tiled, weights, id_col="vec_id", array_col="a", shape=(1, 16, 16))
    return coded.select("frame_id", F.posexplode("latent").alias("channel", "v")).select("frame_id", "channel", (F.round("v", 6) + 0.0).alias("value"))


def _layers() -> str:
    """The encoder as SQL: each layer joins its input with the weights of the kernel's places."""
    weights = model.random_weights(0, **CONV)
    out = """l0 AS (SELECT vec_id AS f, 0 AS c, (k // 16)::INT AS y, (k % 16)::INT AS x, v FROM
 (SELECT vec_id, generate_subscripts(a, 1) - 1 AS k, unnest(a)::DOUBLE AS v FROM (SELECT vec_id, embedding || embedding || embedding || embedding AS a FROM embeddings WHERE len(embedding) = 64)))"""
    side = 16
    for n in range(4):
        w, bias = weights[f"down{n}.weight"], weights[f"down{n}.bias"]
        side //= 2
        rows = ", ".join(f"({d},{c},{i},{j},{float(w[d, c, i, j])!r}::DOUBLE)" for d in range(w.shape[0]) for c in range(w.shape[1]) for i in range(4) for j in range(4))
        biases = ", ".join(f"({d},{float(b)!r}::DOUBLE)" for d, b in enumerate(bias))
        value = "sum(l.v * w.v) + any_value(b.v)"
        out += f""",
 w{n}(d, c, i, j, v) AS (VALUES {rows}), b{n}(d, v) AS (VALUES {biases}),
 l{n + 1} AS (SELECT f, w.d AS c, (l.y + 1 - i) // 2 AS y, (l.x + 1 - j) // 2 AS x, {value if n == 3 else f'greatest({value}, 0)'} AS v FROM l{n} l JOIN w{n} w ON w.c = l.c JOIN b{n} b ON b.d = w.d
  WHERE (l.y + 1 - i) % 2 = 0 AND (l.x + 1 - j) % 2 = 0 AND (l.y + 1 - i) BETWEEN 0 AND {2 * side - 2} AND (l.x + 1 - j) BETWEEN 0 AND {2 * side - 2} GROUP BY f, w.d, (l.y + 1 - i) // 2, (l.x + 1 - j) // 2)"""
    return f"WITH {out} SELECT f AS frame_id, c AS channel, round(v, 6) + 0.0::DOUBLE AS value FROM l4"


def codec_planes(spark, sf_dir):
    """Embeddings as latents of 4 channels of 4x4: calibrated over all, coded, and the symbols read back from the containers."""
    e = table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", "embedding")
    codec = container.fit_codec(lt.to_long(e, id_col="vec_id", array_col="embedding", plane=16), bits=6, plane=(4, 4), image=(3, 64, 64))
    coded = container.encode(e, codec, array_col="embedding").select("vec_id", "data")
    return container.decode(coded, codec).select("vec_id", F.posexplode("symbols").alias("pos", "q"))


QUERIES = {
    f.__name__: f
    for f in (
        symbol_histogram, empirical_entropy, symbol_summary, freq_tables, cumulative, model_entropy, expected_bits, table_violations, model_id, storage_table, three_way, encode_payload,
        roundtrip_lossless, header_fields, container_errors, codec_benchmark, coder_overhead, model_parameters, conv_forward, codec_planes,
    )
}

_SYM = "s AS (SELECT l_returnflag || l_linestatus AS t, (l_quantity - 1)::INT AS q FROM lineitem)"
_COUNTS = """n AS (SELECT a.t, g.i::INT AS symbol, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT DISTINCT t FROM s) a CROSS JOIN range(0, 64) g(i) LEFT JOIN (SELECT t, q, count(*) AS n FROM s GROUP BY ALL) c ON c.t = a.t AND c.q = g.i)"""
_FREQ = """f0 AS (SELECT t, symbol, greatest(floor((n + 1.0::DOUBLE) / sum(n + 1.0::DOUBLE) OVER (PARTITION BY t) * 65536), 1)::BIGINT AS f FROM n),
 f1 AS (SELECT *, 65536 - sum(f) OVER (PARTITION BY t) AS rest, row_number() OVER (PARTITION BY t ORDER BY f DESC, symbol) AS r, count(*) OVER (PARTITION BY t) AS k,
   coalesce(sum(f - 1) OVER (PARTITION BY t ORDER BY f DESC, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spared FROM f0),
 f AS (SELECT t AS "table", symbol, (CASE WHEN rest >= 0 THEN f + rest // k + CASE WHEN r <= rest % k THEN 1 ELSE 0 END ELSE f - greatest(0, least(f - 1, -rest - spared)) END)::BIGINT AS freq FROM f1)"""
_ALL = f"WITH {_SYM}, {_COUNTS}, {_FREQ}"

ORACLES = {
    "symbol_histogram": f'WITH {_SYM}, {_COUNTS} SELECT t AS "table", symbol, n FROM n',
    "empirical_entropy": f"""WITH {_SYM}, c AS (SELECT t, q, count(*)::DOUBLE AS n FROM s GROUP BY ALL), p AS (SELECT t, n, n / sum(n) OVER (PARTITION BY t) AS p FROM c)
 SELECT t AS "table", sum(n)::BIGINT AS symbols, count(*) AS observed, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY t""",
    "symbol_summary": f"""WITH {_SYM}, c AS (SELECT g.i::INT AS symbol, coalesce(n, 0) AS n FROM range(0, 64) g(i) LEFT JOIN (SELECT q, count(*) AS n FROM s GROUP BY q) ON q = g.i),
 p AS (SELECT *, n::DOUBLE / sum(n) OVER () AS p FROM c), e AS (SELECT -sum(p * log2(p)) AS e FROM p WHERE n > 0)
 SELECT count(*) AS possible, count(*) FILTER (n > 0) AS observed, sum(n)::BIGINT AS total, string_agg(n::VARCHAR, ',' ORDER BY symbol) AS counts, round(any_value(e), 6) AS entropy, round(6 - any_value(e), 6) AS headroom FROM p, e""",
    "freq_tables": f"{_ALL} SELECT * FROM f",
    "cumulative": f'{_ALL}, c AS (SELECT *, sum(freq) OVER (PARTITION BY "table" ORDER BY symbol)::BIGINT AS cum_hi FROM f) SELECT "table", symbol, freq, cum_hi - freq AS cum_lo, cum_hi FROM c',
    "model_entropy": f'{_ALL} SELECT "table", round(-sum(freq / 65536.0::DOUBLE * log2(freq / 65536.0::DOUBLE)), 6) AS bits_per_symbol FROM f GROUP BY 1',
    "expected_bits": f'{_ALL} SELECT "table", count(*) AS symbols, round(-sum(log2(freq / 65536.0::DOUBLE)), 4) AS expected_bits FROM s JOIN f ON t = "table" AND q = symbol GROUP BY 1',
    "table_violations": f'{_ALL}, v AS (SELECT "table" FROM f GROUP BY 1 HAVING min(freq) < 1 OR sum(freq) <> 65536) SELECT count(*) AS violations FROM v',
    "model_id": f"""{_ALL}, r AS (SELECT "table" AS t, '[' || string_agg(freq::VARCHAR, ', ' ORDER BY symbol) || ']' AS row FROM f GROUP BY 1)
 SELECT substr(sha256('{{"bits": 6, "frequencies": [' || string_agg(row, ', ' ORDER BY t) || '], "name": "empirical_per_channel_static_v1", "version": 1}}'), 1, 16) AS model_id FROM r""",
    "storage_table": """SELECT len(embedding)::BIGINT AS n_values, count(*) AS frames, bits::INT AS bits, (len(embedding) * bits)::BIGINT AS total_bits, len(embedding) * bits / 8.0::DOUBLE AS total_bytes,
 196608 * 8.0::DOUBLE / (len(embedding) * bits) AS raw_size_ratio FROM embeddings, (VALUES (32), (8), (6), (4)) v(bits) GROUP BY len(embedding), bits""",
    "three_way": "SELECT kind, sum(len(embedding) * bits)::BIGINT AS total_bits, count(*) AS frames FROM embeddings, (VALUES ('raw', 32), ('fixed_8', 8), ('fixed_4', 4)) v(kind, bits) GROUP BY kind",
    "roundtrip_lossless": "SELECT sum(len(embedding))::BIGINT AS symbols, 0::BIGINT AS mismatches FROM embeddings",
    "header_fields": """SELECT vec_id AS frame_id, 8 AS bits, 'per_channel' AS mode, 256 AS image_width, len(embedding)::INT AS latent_channels, len(embedding)::BIGINT AS symbol_count, len(embedding)::INT AS parameters, NULL::VARCHAR AS error FROM embeddings""",
    "container_errors": """SELECT damage, nullif(damage, 'none') AS error, count(*) AS n FROM embeddings, (SELECT unnest(['none', 'short', 'magic', 'version', 'bits', 'mode', 'coder', 'dimensions', 'symbol_count',
 'parameter_count', 'parameter_block', 'scale', 'payload_cut', 'trailing']) AS damage) GROUP BY ALL""",
    "model_parameters": """SELECT len(embedding)::INT AS latent_channels, count(*) AS frames,
 (2 * 16 * (3 * 32 + 32 * 64 + 64 * 128 + 128 * len(embedding)) + 32 + 64 + 128 + len(embedding) + 128 + 64 + 32 + 3)::BIGINT AS parameters FROM embeddings GROUP BY len(embedding)""",
    "conv_forward": _layers(),
    "codec_planes": """WITH v AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE len(embedding) = 64),
 r AS (SELECT pos // 16 AS c, quantile_cont(x, 0.001::DOUBLE) AS lo, quantile_cont(x, 0.999::DOUBLE) AS hi FROM v GROUP BY c),
 p AS (SELECT c, (hi - lo) / 63 AS scale, -round_even(lo / ((hi - lo) / 63), 0) AS zero_point FROM r)
SELECT vec_id, pos, greatest(0, least(63, round_even(x / scale, 0) + zero_point))::INT AS q FROM v JOIN p ON c = pos // 16""",
}
