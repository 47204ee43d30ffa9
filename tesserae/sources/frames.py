"""Frames of a prepared dataset by ordinal: format ``frames``, and single frames.

A manifest has a row per item with its number of frames, so a frame's file follows from sums of counts; nothing is listed, and what a query
doesn't ask for isn't opened. Ordinals count the frames of a split from 0, in the order of the manifest's items.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.ingest import SPLITS
from ..operators.jpeg import PixelError
from ..operators.pixels import decode_image

SCHEMA = "ordinal long, split string, source_name string, frame_index int, path string, data binary, error_code string"


@dataclass
class FrameIndex:
    """The items of a split and where each begins: as large as the number of items, whatever the number of frames."""

    split: str
    items: list[tuple[str, str, str]]  # name, folder, pattern of file names
    ends: np.ndarray  # frames up to and with each item

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def locate(self, ordinal: int) -> tuple[str, int, str]:
        """(item, frame from 1, path) of an ordinal; IndexError beyond the last."""
        if not 0 <= ordinal < len(self):
            raise IndexError(f"{ordinal} isn't among {len(self)} frames")
        k = int(np.searchsorted(self.ends, ordinal, side="right"))
        name, folder, pattern = self.items[k]
        frame = ordinal - (int(self.ends[k - 1]) if k else 0) + 1
        return name, frame, f"{folder}/{pattern.format(index=frame)}"

    def span(self, name: str) -> list[tuple[int, int]]:
        """Ranges of ordinals of the items of a name."""
        return [(int(self.ends[k - 1]) if k else 0, int(self.ends[k])) for k, item in enumerate(self.items) if item[0] == name]

    def part(self, low: int, high: int) -> tuple[FrameIndex, int]:
        """(the items of ordinals low to high - 1, ordinal of their first frame)."""
        a, b = int(np.searchsorted(self.ends, low, side="right")), int(np.searchsorted(self.ends, high - 1, side="right")) + 1
        start = int(self.ends[a - 1]) if a else 0
        return FrameIndex(self.split, self.items[a:b], self.ends[a:b] - start), start


def _text(path: str) -> str:
    """A JSON document: a file, or the one part of a folder that Spark wrote."""
    files, root = pafs.FileSystem.from_uri(path)
    info = files.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if not info.is_file:
        parts = [x.path for x in files.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".json")]
        if len(parts) != 1:
            raise ValueError(f"{path} holds {len(parts)} documents")
        root = parts[0]
    with files.open_input_file(root) as f:
        return f.read().decode()


def load_index(manifest: str, split: str) -> FrameIndex:
    """The index of a split. Folders that aren't absolute lie beside the manifest. ValueError for other splits and for splits without frames."""
    if split not in SPLITS:
        raise ValueError(f"no split {split!r}")
    doc, home = json.loads(_text(manifest)), manifest.rstrip("/").rpartition("/")[0]
    rows = [i for i in doc["items"] if i["split"] == split and (i.get("frame_count") or 0) > 0]
    if not rows:
        raise ValueError(f"no frames of {split} in {manifest}")
    folder = lambda d: d if d.startswith("/") or "://" in d else f"{home}/{d}"
    return FrameIndex(split, [(i["source_name"], folder(i["frame_directory"]), i["frame_filename_pattern"]) for i in rows], np.cumsum([int(i["frame_count"]) for i in rows]))


def missing_folders(index: FrameIndex) -> list[str]:
    """Folders of the index that don't exist: to be asked before a long job, which would meet its files one by one."""
    out = []
    for folder in sorted({f for _, f, _ in index.items}):
        files, root = pafs.FileSystem.from_uri(folder)
        if files.get_file_info(root).type != pafs.FileType.Directory:
            out.append(folder)
    return out


def read_file(path: str) -> bytes:
    files, name = pafs.FileSystem.from_uri(path)
    with files.open_input_file(name) as f:
        return f.read()


def frame(index: FrameIndex, ordinal: int, *, height: int | None = None, width: int | None = None, read=read_file) -> np.ndarray:
    """One frame's pixels, from the one file that holds it. ValueError where it can't be decoded or has another size."""
    name, _, path = index.locate(ordinal)
    try:
        got = decode_image(read(path))
    except PixelError as e:
        raise ValueError(f"{path}: {e.code}") from None
    if (height or got.shape[0], width or got.shape[1]) != got.shape[:2]:
        raise ValueError(f"{path} of {name} is {got.shape[0]}x{got.shape[1]}, not {height}x{width}")
    return got


class _Range(InputPartition):
    def __init__(self, index: FrameIndex, start: int, low: int, high: int):
        super().__init__((low, high))
        self.index, self.start, self.low, self.high = index, start, low, high


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.index = load_index(options["manifest"], options["split"])
        self.per_task, self.payload = int(options.get("framesPerTask", 1000)), options.get("payload", "true").lower() == "true"
        self.spans = [(0, len(self.index))]

    def _keep(self, ranges: list[tuple[int, int]]) -> None:
        both = [(max(a, c), min(b, d)) for a, b in self.spans for c, d in ranges]
        self.spans = sorted({(a, b) for a, b in both if a < b})

    def pushFilters(self, filters):
        """Ordinals and items decide which ranges are planned; Spark still applies the filters."""
        far = len(self.index)
        for f in filters:
            name, value = getattr(f, "attribute", (None,)), getattr(f, "value", None)
            if name == ("ordinal",) and (isinstance(value, int) or isinstance(f, In)):
                if isinstance(f, EqualTo):
                    self._keep([(value, value + 1)])
                elif isinstance(f, In):
                    self._keep([(v, v + 1) for v in set(f.value) if v is not None])
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._keep([(value + isinstance(f, GreaterThan), far)])
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._keep([(0, value + isinstance(f, LessThanOrEqual))])
            elif name == ("source_name",) and isinstance(f, (EqualTo, In)):
                self._keep([s for v in (set(f.value) if isinstance(f, In) else [f.value]) if v is not None for s in self.index.span(v)])
            yield f

    def partitions(self) -> list[_Range]:
        out = []
        for low, high in self.spans:
            for a in range(low, high, self.per_task):
                b = min(a + self.per_task, high)
                out.append(_Range(*self.index.part(a, b), a, b))
        return out or [_Range(FrameIndex(self.index.split, [], np.zeros(0, np.int64)), 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        index, start = partition.index, partition.start
        for ordinal in range(partition.low, partition.high):
            name, number, path = index.locate(ordinal - start)
            data = code = None
            if self.payload:
                try:
                    data = read_file(path)
                except FileNotFoundError:
                    code = "NOT_FOUND"
            yield ordinal, index.split, name, number, path, data, code


class FrameSource(DataSource):
    """Options: manifest, split, framesPerTask, payload (false: names only)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make format ``frames`` known to the session, and let filters reach sources in Python."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def read_split(spark: SparkSession, manifest: str, split: str, *, payload: bool = True) -> DataFrame:
    """The frames of a split, a row each; a file that isn't there has a code."""
    register(spark)
    return spark.read.format("frames").option("manifest", manifest).option("split", split).option("payload", str(payload).lower()).load()
