"""Ingestion, splits, sampling, batches and histories. A conversation stands for a sequence, its turns for frames, a text's length for a file's size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import ingest, metrics
from ..sources import media

SEED, TRAIN, VAL, TEST = 42, 0.8, 0.1, 0.1
EVERY, BATCH = 3, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.length("text").cast("long").alias("n_bytes"), F.length("role").alias("width"))


def _splits(spark, sf_dir):
    return ingest.assign_splits(table(spark, sf_dir, "conversations").select("conv_id").distinct(), key="conv_id", train=TRAIN, val=VAL, test=TEST, seed=SEED)


def discover_items(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = media.named(table(spark, sf_dir, "documents").select("source", path.alias("path"), F.col("n_chars").alias("length")))
    return files.groupBy("source", F.col("directory").alias("lang")).agg(F.count("*").alias("files"), F.sum("length").alias("total_bytes"))


def detect_source_type(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("suffix"), F.lit(1).alias("depth"))
    return ingest.detect_source_type(files, ["mp4"], ["en", "de"])


def list_frames(spark, sf_dir):
    return ingest.list_frames(_turns(spark, sf_dir), item="conv_id", order="turn").select("conv_id", "turn", "frame_index")


def probe_items(spark, sf_dir):
    return ingest.probe_items(_turns(spark, sf_dir), item="conv_id", size="n_bytes")


def dims_consistency(spark, sf_dir):
    return ingest.inconsistent(_turns(spark, sf_dir), item="conv_id", order="turn", width="width", height="width")


def key_collisions(spark, sf_dir):
    return ingest.key_collisions(table(spark, sf_dir, "part"), key="p_name", path="p_partkey")


def split_leakage(spark, sf_dir):
    split = _splits(spark, sf_dir)
    return split.groupBy("item_key").agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") != 1).alias("leaks"), F.count("*").alias("items"))


def sample_every_n(spark, sf_dir):
    return ingest.sample_every(_turns(spark, sf_dir), EVERY, item="conv_id", order="turn").select("conv_id", "turn", "source_index", "frame_index")


def frame_names(spark, sf_dir):
    frames = ingest.sample_every(_turns(spark, sf_dir), EVERY, item="conv_id", order="turn").join(_splits(spark, sf_dir), F.col("conv_id") == F.col("item_key"))
    name = F.concat_ws("/", "split", F.col("conv_id").cast("string"), ingest.frame_name(F.col("conv_id"), F.col("frame_index")))
    return frames.select("conv_id", "frame_index", "split", name.alias("path"))


def manifest_summary(spark, sf_dir):
    frames = ingest.sample_every(_turns(spark, sf_dir), EVERY, item="conv_id", order="turn")
    items = frames.groupBy("conv_id").agg(F.count("*").alias("frame_count"), F.sum("n_bytes").alias("output_bytes"))
    return ingest.manifest_summary(items.join(_splits(spark, sf_dir), F.col("conv_id") == F.col("item_key")))


def quarantine(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    error = F.when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low_quality")
    sound, bad = ingest.quarantine(docs, error)
    return bad.groupBy("error_code").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).union(sound.agg(F.lit("sound"), F.count("*"), F.sum("n_chars")))


def unknown_keys(spark, sf_dir):
    """Keys of the events' documents that aren't settings, and in how many documents each is."""
    keys = table(spark, sf_dir, "events").select(F.explode(F.array_distinct(F.json_object_keys("props"))).alias("unknown_key"))
    return Config.unknown_rows(keys, "unknown_key").groupBy("unknown_key").agg(F.count("*").alias("n"))


def _batched_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return ingest.batches(e.withColumn("epoch", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))), BATCH, order=["event_id"], item="epoch")


def batch_ids(spark, sf_dir):
    return ingest.batches(table(spark, sf_dir, "events").select("event_id"), BATCH, order=["event_id"]).select("event_id", F.col("batch_id").cast("long").alias("batch_id"))


def shuffled_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.md5(F.concat(F.lit(f"{SEED}:"), F.col("event_id").cast("string"))).alias("h"))
    return ingest.batches(e, BATCH, order=["h", "event_id"]).select("event_id", F.col("batch_id").cast("long").alias("batch_id"))


def batch_mean_loss(spark, sf_dir):
    return metrics.mean_of_batches(_batched_events(spark, sf_dir), "value", "epoch").select("epoch", "batches", F.round("batch_mean_loss", 9).alias("batch_mean_loss"))


def _history(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("epoch"), "value")
    return e.groupBy("epoch").agg(F.round(F.avg("value"), 6).alias("val_loss"))


def running_best(spark, sf_dir):
    return metrics.running_best(_history(spark, sf_dir), epoch="epoch", loss="val_loss")


def resume_epochs(spark, sf_dir):
    h = _history(spark, sf_dir)
    return metrics.resumed(h, h.where("val_loss > 0"), epoch="epoch")


def resize_geometry(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 + 17).alias("w"), (F.col("p_partkey") % 400 + 20).cast("int").alias("h"))
    return ingest.resize_geometry(p, width="w", height="h", target_width=256, target_height=256)


QUERIES = {
    f.__name__: f
    for f in (
        discover_items, detect_source_type, list_frames, probe_items, dims_consistency, key_collisions, split_leakage, sample_every_n, frame_names, manifest_summary,
        quarantine, unknown_keys, batch_ids, shuffled_batches, batch_mean_loss, running_best, resume_epochs, resize_geometry,
    )
} | {"assign_splits": _splits}

_TURNS = "t AS (SELECT conv_id, turn, length(text)::BIGINT AS n_bytes, length(role)::INT AS width FROM conversations)"
_SPLIT = f"""r AS (SELECT conv_id AS item_key, row_number() OVER (ORDER BY md5('{SEED}:' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM conversations)),
 q AS (SELECT *, least(round_even(n * {TRAIN}::DOUBLE, 0), n) AS n_train FROM r),
 split AS (SELECT item_key, CASE WHEN r <= n_train THEN 'train' WHEN r <= n_train + least(round_even(n * {VAL}::DOUBLE, 0), n - n_train) THEN 'val' ELSE 'test' END AS split FROM q)"""
_SAMPLE = f"""p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS source_index FROM t),
 s AS (SELECT *, (source_index // {EVERY} + 1)::INT AS frame_index FROM p WHERE source_index % {EVERY} = 0)"""
_EPOCH = "(ts::DATE - DATE '1970-01-01')::INT"
_HIST = f"h AS (SELECT {_EPOCH} AS epoch, round(avg(value), 6) AS val_loss FROM events GROUP BY 1)"

ORACLES = {
    "discover_items": "SELECT source, lang, count(*) AS files, sum(n_chars)::BIGINT AS total_bytes FROM documents GROUP BY ALL",
    "detect_source_type": "SELECT CASE WHEN bool_or(lang IN ('en', 'de')) THEN 'image_sequence' END AS source_type FROM documents",
    "list_frames": "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS frame_index FROM conversations",
    "probe_items": f"WITH {_TURNS} SELECT conv_id, count(*) AS frame_count, sum(n_bytes)::BIGINT AS total_bytes, count(*) - count(n_bytes) AS unreadable, CASE WHEN count(*) > count(n_bytes) THEN 'corrupt' END AS error_code FROM t GROUP BY conv_id",
    "dims_consistency": f"WITH {_TURNS}, f AS (SELECT *, first_value(width) OVER (PARTITION BY conv_id ORDER BY turn) AS w0 FROM t) SELECT conv_id, min(w0) AS width, min(w0) AS height, min(turn) AS first_odd, count(*) AS odd_frames FROM f WHERE width <> w0 GROUP BY conv_id",
    "key_collisions": "SELECT p_name AS item_key, count(*) AS n, min(p_partkey) AS first, list_sort(list(p_partkey))[2] AS second FROM part GROUP BY p_name HAVING count(*) > 1",
    "assign_splits": f"WITH {_SPLIT} SELECT * FROM split",
    "split_leakage": f"WITH {_SPLIT}, k AS (SELECT item_key, count(DISTINCT split) AS k FROM split GROUP BY 1) SELECT count(*) FILTER (k <> 1) AS leaks, count(*) AS items FROM k",
    "sample_every_n": f"WITH {_TURNS}, {_SAMPLE} SELECT conv_id, turn, source_index::INT AS source_index, frame_index FROM s",
    "frame_names": f"WITH {_TURNS}, {_SAMPLE}, {_SPLIT} SELECT conv_id, frame_index, split, split || '/' || conv_id || '/' || conv_id || '_' || lpad(frame_index::VARCHAR, 6, '0') || '.png' AS path FROM s JOIN split ON conv_id = item_key",
    "manifest_summary": f"""WITH {_TURNS}, {_SAMPLE}, {_SPLIT}, i AS (SELECT conv_id, count(*) AS f, sum(n_bytes) AS b FROM s GROUP BY 1),
 a AS (SELECT split, count(*) AS items, sum(f) AS frames, sum(b) AS bytes FROM i JOIN split ON conv_id = item_key GROUP BY 1)
 SELECT v.split, coalesce(items, 0)::BIGINT AS items, coalesce(frames, 0)::BIGINT AS frames, coalesce(bytes, 0)::BIGINT AS bytes, coalesce(frames::DOUBLE / nullif(items, 0), 0) AS average_frames
 FROM (VALUES ('train'), ('val'), ('test')) v(split) LEFT JOIN a USING (split)""",
    "quarantine": """SELECT CASE WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low_quality' ELSE 'sound' END AS error_code, count(*) AS n, sum(n_chars)::BIGINT AS chars
 FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "unknown_keys": f"SELECT unknown_key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS unknown_key FROM events) WHERE unknown_key NOT IN ({', '.join(repr(f) for f in Config().to_dict())}) GROUP BY unknown_key",
    "batch_ids": f"SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // {BATCH})::BIGINT AS batch_id FROM events",
    "shuffled_batches": f"SELECT event_id, ((row_number() OVER (ORDER BY md5('{SEED}:' || event_id), event_id) - 1) // {BATCH})::BIGINT AS batch_id FROM events",
    "batch_mean_loss": f"""WITH b AS (SELECT {_EPOCH} AS epoch, value, (row_number() OVER (PARTITION BY {_EPOCH} ORDER BY event_id) - 1) // {BATCH} AS batch_id FROM events),
 m AS (SELECT epoch, batch_id, avg(value) AS m FROM b GROUP BY ALL) SELECT epoch, count(*) AS batches, round(avg(m), 9) AS batch_mean_loss FROM m GROUP BY epoch""",
    "running_best": f"WITH {_HIST}, b AS (SELECT *, min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM h) SELECT *, best_before IS NULL OR val_loss < best_before AS is_best FROM b",
    "resume_epochs": f"WITH {_HIST} SELECT * FROM h UNION ALL SELECT ((SELECT max(epoch) FROM h) + row_number() OVER (ORDER BY epoch))::INT, val_loss FROM h WHERE val_loss > 0",
    "resize_geometry": """WITH p AS (SELECT p_partkey, (p_size * 13 + 17)::INT AS w, (p_partkey % 400 + 20)::INT AS h FROM part), s AS (SELECT *, greatest(256::DOUBLE / w, 256::DOUBLE / h) AS scale FROM p),
 n AS (SELECT p_partkey, w, h, greatest(256, round_even(w * scale, 0)::INT) AS new_width, greatest(256, round_even(h * scale, 0)::INT) AS new_height FROM s)
 SELECT *, ((new_width - 256) // 2)::INT AS "left", ((new_height - 256) // 2)::INT AS top, CASE WHEN new_width <= w AND new_height <= h THEN 'area' ELSE 'linear' END AS interpolation FROM n""",
}
