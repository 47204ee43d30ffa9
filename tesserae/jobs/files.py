"""What jobs write: documents that appear whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs


def write_whole(path: str, data: bytes) -> None:
    """A file under its name once it is complete."""
    files, name = pafs.FileSystem.from_uri(path)
    files.create_dir(name.rpartition("/")[0], recursive=True)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with files.open_output_stream(part, compression=None) as f:
        f.write(data)
    files.move(part, name)


def write_json(path: str, doc) -> None:
    write_whole(path, json.dumps(doc, indent=2).encode())


def read_json(path: str):
    """The document, None where there is none."""
    files, name = pafs.FileSystem.from_uri(path)
    if files.get_file_info(name).type != pafs.FileType.File:
        return None
    with files.open_input_file(name) as f:
        return json.loads(f.read())


def exists(path: str) -> bool:
    files, name = pafs.FileSystem.from_uri(path)
    return files.get_file_info(name).type != pafs.FileType.NotFound


def is_folder(path: str) -> bool:
    files, name = pafs.FileSystem.from_uri(path)
    return files.get_file_info(name).type == pafs.FileType.Directory


def make_folder(path: str) -> None:
    files, name = pafs.FileSystem.from_uri(path)
    files.create_dir(name, recursive=True)
