"""Videos as tables: what files say about themselves, and format ``video`` with a row per frame.

Only headers are read to probe, and only the frames that are asked for to extract. A long file is read by many tasks: each reads the index
itself and takes its share of the frames, so the driver lists files and never opens one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..operators import ingest, pixels
from ..operators.video import Ranges, VideoError, decode_samples, open_video, places
from .media import VIDEO_SUFFIXES

SCHEMA = "path string, item string, frame_index long, sample_index long, codec string, width int, height int, top_down boolean, data binary, error_code string"
PROBE = "filename string, container string, codec string, width int, height int, fps double, frame_count long, duration_seconds double, file_size_bytes long, header_bytes long, error_code string"


def _opened(path: str) -> tuple[object, Ranges]:
    files, name = pafs.FileSystem.from_uri(path)
    info = files.get_file_info(name)
    if info.type != pafs.FileType.File:
        raise VideoError("NOT_FOUND")
    handle = files.open_input_file(name)

    def read_at(at: int, n: int) -> bytes:
        return handle.read_at(n, at)

    return handle, Ranges(read_at, info.size)


def probe_file(path: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES) -> dict:
    """The columns of PROBE; error_code is NOT_FOUND, UNSUPPORTED_FORMAT (by suffix), or what is wrong with the file."""
    name = path.rsplit("/", 1)[-1]
    out = dict.fromkeys(c.split()[0] for c in PROBE.split(", ")) | {"filename": name}
    try:
        handle, read = _opened(path)
    except (VideoError, OSError):
        return out | {"error_code": "NOT_FOUND"}
    with handle:
        out["file_size_bytes"] = read.size
        if not name.lower().endswith(suffixes):
            return out | {"error_code": "UNSUPPORTED_FORMAT"}
        try:
            video = open_video(read)
            if video.frame_count is None and video.container != "ebml":
                raise VideoError("CORRUPT")
        except VideoError as e:
            return out | {"error_code": e.code, "header_bytes": read.taken}
        seconds = video.frame_count / video.fps if video.frame_count and video.fps else None
        return out | {"container": video.container, "codec": video.codec, "width": video.width, "height": video.height, "fps": video.fps, "frame_count": video.frame_count, "duration_seconds": seconds, "header_bytes": read.taken}


def probe_videos(files: DataFrame, *, path_col: str = "path") -> DataFrame:
    """files with the columns of PROBE: a row per file, sound or not. Columns of those names are replaced; a null path isn't found."""
    names = [c.split()[0] for c in PROBE.split(", ")]

    def each(row):
        path = getattr(row, path_col)
        got = probe_file(path) if path else dict.fromkeys(names) | {"error_code": "NOT_FOUND"}
        return tuple(got[n] for n in names)

    return pixels._mapped(files, PROBE, each)


class _Share(InputPartition):
    def __init__(self, jobs: list[tuple[str, int, int]]):
        super().__init__(jobs)
        self.jobs = jobs


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.every = int(options.get("every", 1))
        self.task_bytes = int(options.get("taskBytes", 1 << 26))
        self.payload = options.get("payload", "true").lower() == "true"
        self.low, self.high = 0, 1 << 62
        if self.every < 1:
            raise ValueError("every how many frames must be 1 or more")

    def pushFilters(self, filters):
        """Bounds on frame_index decide what is read; Spark still applies them."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_index",) and isinstance(f.value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            yield f

    def partitions(self) -> list[_Share]:
        files, root = pafs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in files.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.path.lower().endswith(VIDEO_SUFFIXES)]
        out, size = [], self.task_bytes
        for x in sorted(found, key=lambda x: x.path):
            shares = max(1, -(-x.size // self.task_bytes))
            if shares > 1:
                out += [_Share([(x.path, k, shares)]) for k in range(shares)]
                continue
            if size + x.size > self.task_bytes or not out or out[-1].jobs[0][2] > 1:
                out.append(_Share([]))
                size = 0
            out[-1].jobs.append((x.path, 0, 1))
            size += x.size
        return out or [_Share([])]

    def read(self, partition: _Share) -> Iterator[tuple]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        for path, share, shares in partition.jobs:
            item = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            with files.open_input_file(path) as handle:
                read = Ranges(lambda at, n, handle=handle: handle.read_at(n, at), handle.size())
                try:
                    video = open_video(read)
                    offsets, sizes = places(read, video)
                except VideoError as e:
                    if share == 0:
                        yield path, item, None, None, None, None, None, None, None, e.code
                    continue
                samples = range(0, len(offsets), self.every)
                for k in samples[len(samples) * share // shares : len(samples) * (share + 1) // shares]:
                    if self.low <= k < self.high:
                        data = handle.read_at(int(sizes[k]), int(offsets[k])) if self.payload else None
                        yield path, item, k, k // self.every + 1, video.codec, video.width, video.height, video.top_down, data, None


class VideoSource(DataSource):
    """Options: path (a file or a folder), every (n-th frame), taskBytes (of video a task), payload (false: places only)."""

    @classmethod
    def name(cls) -> str:
        return "video"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make format ``video`` known to the session, and let filters reach sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoSource)


def extract_frames(spark: SparkSession, path: str, *, target_width: int, target_height: int, every: int = 1, preserve_aspect_ratio: bool = True) -> DataFrame:
    """(item, frame_index, name, height, width, pixels, data, error_code): every n-th frame of the videos under a path, resized, as a PNG file
    whose name counts from 1 among those of its video. A file or a frame that can't be decoded is a row with a code."""
    if target_width < 1 or target_height < 1:
        raise ValueError(f"the target size must be positive, not {target_width}x{target_height}")
    register(spark)
    decoded = decode_samples(spark.read.format("video").option("path", path).option("every", every).load())
    sized = pixels.resize_frames(decoded, target_width, target_height, preserve_aspect_ratio=preserve_aspect_ratio)
    name = F.when(F.col("error_code").isNull(), ingest.frame_name(F.col("item"), F.col("sample_index").cast("int")))
    return pixels.encode_frames(sized.withColumn("name", name).drop("data")).select("item", "frame_index", "name", "height", "width", "pixels", "data", "error_code")


def extraction_summary(frames: DataFrame) -> DataFrame:
    """(item, extracted_frames, output_bytes, failed_frames, error_code) of extracted frames."""
    return frames.groupBy("item").agg(
        F.count("name").alias("extracted_frames"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("output_bytes"), F.count("error_code").alias("failed_frames"), F.min("error_code").alias("error_code")
    )
