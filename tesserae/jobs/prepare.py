"""From raw videos or folders of images to a dataset of PNG frames in three splits, with its manifest.

Frames are decoded and resized once, into a table under the output folder that is named by what it was made from; files are written from it, and
the manifest last. A run that died goes on from what is whole, and a run over the same input with the same settings has nothing to do.
"""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ingest, pixels, video
from ..sources import bitstream, media
from ..sources import video as video_source
from .files import exists, make_folder, read_json, write_json

KINDS = ("video", "image_sequence")


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, depth, directory, file, stem, suffix) of the files below a folder; depth 0 lies in the folder itself."""
    files = media.named(media.list_files(spark, root, recursive=True))
    below = F.substring_index("path", f"{root.rstrip('/')}/", -1)
    return files.withColumn("depth", F.size(F.split(below, "/")) - 1)


def _items(files: DataFrame, kind: str) -> DataFrame:
    """(item, path, ...): a row per video, or per image of a sequence, which is a direct subfolder."""
    if kind == "video":
        return files.where((F.col("depth") == 0) & F.col("suffix").isin(*media.VIDEO_SUFFIXES)).withColumn("item", F.col("stem"))
    return files.where((F.col("depth") == 1) & F.col("suffix").isin(*media.IMAGE_SUFFIXES)).withColumn("item", F.col("directory"))


def _decoded(spark: SparkSession, root: str, rows: DataFrame, kind: str, every: int) -> DataFrame:
    """(item, sample_index, height, width, pixels, error_code) of every n-th frame; of sequences, also the others, without number and pixels."""
    if kind == "video":
        video_source.register(spark)
        frames = spark.read.format("video").option("path", root).option("every", every).load()
        return video.decode_samples(frames.join(rows.select("item").distinct(), "item", "left_semi")).select("item", "sample_index", "height", "width", "pixels", "error_code")
    # every image is decoded, as one bad image spoils its sequence; those between samples go no further
    placed = ingest.list_frames(rows.select("item", "file", "path"), item="item", order="file")
    placed = placed.select("item", "path", F.when(F.col("frame_index") % every == 0, F.expr(f"frame_index div {every} + 1")).cast("long").alias("sample_index"))
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("content").alias("data"))
    frames = pixels.decode_frames(content.join(placed, "path")).withColumn("pixels", F.when(F.col("sample_index").isNotNull(), F.col("pixels")))
    return frames.select("item", "sample_index", "height", "width", "pixels", "error_code")


def prepare_dataset(
    spark: SparkSession, input_root: str, frames_root: str, manifest_path: str, *, source_type: str | None = None, target_width: int = 256, target_height: int = 256, every_n_frames: int = 1,
    preserve_aspect_ratio: bool = True, train_ratio: float = 0.8, val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42,
) -> dict:
    """The manifest, as written. ValueError for settings that make no sense, folders without items, and items of one key.

    An item with a frame that can't be decoded, or of another size than its first, is left out and listed among the errors.
    """
    if every_n_frames < 1 or target_width < 1 or target_height < 1:
        raise ValueError("every_n_frames and the target size must be positive")
    ingest.check_ratios(train_ratio, val_ratio, test_ratio)
    if source_type not in (None, *KINDS):
        raise ValueError(f"source_type is one of {KINDS}, not {source_type!r}")
    files = _listing(spark, input_root)
    detected = source_type is None
    kind = source_type
    if detected:
        try:
            kind = ingest.detect_source_type(files, list(media.VIDEO_SUFFIXES), list(media.IMAGE_SUFFIXES)).first().source_type
        except Exception as e:
            raise ValueError(f"{input_root}: neither videos nor image sequences") from e
    rows = _items(files, kind)
    settings = {
        "target_width": target_width, "target_height": target_height, "every_n_frames": every_n_frames, "preserve_aspect_ratio": preserve_aspect_ratio, "train_ratio": train_ratio,
        "val_ratio": val_ratio, "test_ratio": test_ratio, "random_seed": seed, "video_extensions": list(media.VIDEO_SUFFIXES), "image_extensions": list(media.IMAGE_SUFFIXES),
    }
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "length").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    if not seen.n:
        raise ValueError(f"no {kind} items in {input_root}")
    mark = hashlib.md5(json.dumps([kind, int(seen.n), str(seen.h), settings], sort_keys=True).encode()).hexdigest()
    before = read_json(manifest_path)
    if before and before.get("made_from") == mark:
        return before
    items = rows.groupBy("item").agg(F.min("path").alias("path"), F.count("*").alias("files"), F.sum("length").alias("bytes"))
    if kind == "video" and (clash := ingest.key_collisions(rows, key="item", path="path").orderBy("item_key").take(5)):
        raise ValueError("items of one name would overwrite each other's frames: " + "; ".join(f"{r.item_key} ({r.first}, {r.second})" for r in clash))
    work = f"{frames_root.rstrip('/')}/_work/{mark}"
    if not exists(f"{work}/_SUCCESS"):
        decoded = _decoded(spark, input_root, rows, kind, every_n_frames)
        sized = pixels.resize_frames(decoded.withColumns({"own_height": F.col("height"), "own_width": F.col("width")}), target_width, target_height, preserve_aspect_ratio=preserve_aspect_ratio)
        split = ingest.assign_splits(items, key="item", train=train_ratio, val=val_ratio, test=test_ratio, seed=seed).withColumnRenamed("item_key", "item")
        made = pixels.encode_frames(sized).join(split, "item").select("item", "split", "sample_index", "own_height", "own_width", "data", "error_code")
        made.write.mode("overwrite").parquet(work)
    made = spark.read.parquet(work)
    report = made.groupBy("item", "split").agg(
        F.count("data").alias("frame_count"), F.sum(F.octet_length("data")).alias("output_bytes"), F.min("error_code").alias("code"), F.min(F.when(F.col("sample_index").isNotNull(), F.struct("sample_index", "own_width", "own_height"))).alias("first"),
        F.count_distinct("own_height", "own_width").alias("sizes"),
    )
    report = report.withColumn("message", F.when(F.col("code").isNotNull(), F.col("code")).when(F.col("sizes") > 1, "INCONSISTENT_SIZE"))
    sound = report.where("message is null").select("item")
    for name in ingest.SPLITS:
        make_folder(f"{frames_root.rstrip('/')}/{name}")
    bitstream.register(spark)
    named = made.where("data is not null").join(sound, "item")
    named.select(F.concat_ws("/", "split", ingest.frame_name(F.col("item"), F.col("sample_index").cast("int"))).alias("name"), "data").write.format("bitstream").option("path", frames_root).option("suffix", "").mode("append").save()
    found = {r["item"]: r for r in report.collect()}  # a row per item
    probed = {r["item"]: r for r in video_source.probe_videos(items).collect()} if kind == "video" else {}
    folder = lambda split: os.path.relpath(f"{frames_root.rstrip('/')}/{split}", manifest_path.rpartition("/")[0]) if "://" not in frames_root else f"{frames_root.rstrip('/')}/{split}"
    records, errors = [], []
    for r in items.orderBy("item").collect():
        own, probe = found.get(r["item"]), probed.get(r["item"])
        if own is None or own.message:
            errors.append({"source_name": r["item"], "message": own.message if own else (probe.error_code if probe else None) or "NO_FRAMES"})
            continue
        records.append({
            "source_type": kind, "source_name": r["item"], "split": own.split, "frame_count": own.frame_count, "original_resolution": [own["first"].own_width, own["first"].own_height],
            "processed_resolution": [target_width, target_height], "frame_directory": folder(own.split), "frame_filename_pattern": r["item"] + "_{index:06d}.png", "every_n_frames": every_n_frames,
            "preserve_aspect_ratio": preserve_aspect_ratio, "original_fps": probe.fps if probe else None, "original_frame_count": probe.frame_count if probe else r.files, "output_bytes": own.output_bytes,
        })
    total = sum(r["frame_count"] for r in records)
    per = lambda value: {s: sum(value(r) for r in records if r["split"] == s) for s in ingest.SPLITS}
    manifest = {
        "generated_at": datetime.now(timezone.utc).isoformat(), "source_type": kind, "source_type_auto_detected": detected, "settings": settings, "items": records, "errors": errors,
        "summary": {
            "total_items_found": len(records) + len(errors), "total_items_processed": len(records), "total_items_skipped": len(errors), "items_per_split": per(lambda r: 1), "frames_per_split": per(lambda r: r["frame_count"]),
            "total_frames_extracted": total, "average_frames_per_item": total / len(records) if records else 0, "total_output_bytes": sum(r["output_bytes"] for r in records),
        },
        "made_from": mark,
    }
    write_json(manifest_path, manifest)
    return manifest


def report_lines(manifest: dict) -> list[str]:
    """The manifest's summary, to be read."""
    s = manifest["summary"]
    out = [f"{manifest['source_type']}: {s['total_items_found']} items found, {s['total_items_processed']} prepared, {s['total_items_skipped']} left out"]
    out += [f"  {k}: {s['items_per_split'][k]} items, {s['frames_per_split'][k]} frames" for k in ingest.SPLITS]
    out.append(f"{s['total_frames_extracted']} frames, {s['average_frames_per_item']:.1f} an item, {s['total_output_bytes'] / 2**20:.2f} MiB")
    return out + [f"  left out: {e['source_name']}: {e['message']}" for e in manifest["errors"]]
