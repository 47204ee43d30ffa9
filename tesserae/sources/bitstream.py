"""Containers as files: ``spark.read.format("bitstream")`` parses headers, ``df.write.format("bitstream")`` writes a file a row."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.container import SUFFIX, FormatError, split

SCHEMA = "path string, bits int, mode string, symbol_count long, payload_length long, model_id string, data binary, error string"


class BitstreamSource(DataSource):
    """Options: path, suffix. Rows to write need name (without suffix) and data."""

    @classmethod
    def name(cls) -> str:
        return "bitstream"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, [f.name for f in schema.fields])


class _Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class _Reader(DataSourceReader):
    #: Bytes of files for a task, none of which is large.
    TASK_BYTES = 1 << 26

    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", SUFFIX)

    def partitions(self) -> list[_Paths]:
        files, root = pafs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else [x for x in files.get_file_info(pafs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(self.suffix)]
        tasks, size = [], self.TASK_BYTES
        for x in sorted(found, key=lambda x: x.path):
            if size + x.size > self.TASK_BYTES:
                tasks.append(_Paths([]))
                size = 0
            tasks[-1].paths.append(x.path)
            size += x.size
        return tasks or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        files, _ = pafs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with files.open_input_file(path) as f:
                data = f.read()
            try:
                h, _ = split(data)
                yield path, h["bits"], h["mode"], h["symbol_count"], h["payload_length"], h["model_id"], data, None
            except FormatError as e:
                yield path, None, None, None, None, None, data, e.code


class _Writer(DataSourceWriter):
    def __init__(self, options, columns: list[str]):
        self.path, self.suffix = options["path"], options.get("suffix", SUFFIX)
        self.at = columns.index("name"), columns.index("data")

    def write(self, iterator) -> WriterCommitMessage:
        files, root = pafs.FileSystem.from_uri(self.path)
        files.create_dir(root, recursive=True)
        for row in iterator:
            # a repeated task writes the same bytes under the same name
            with files.open_output_stream(f"{root}/{row[self.at[0]]}{self.suffix}", compression=None) as f:
                f.write(bytes(row[self.at[1]]))
        return WriterCommitMessage()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BitstreamSource)
