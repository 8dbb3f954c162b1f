"""Files of a store that pyarrow reaches (local, HDFS, S3, GCS), for tasks and driver."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(file system, path)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def read_bytes(uri: str, start: int = 0, length: int | None = None) -> bytes:
    f, p = filesystem(uri)
    with f.open_input_file(p) as s:
        s.seek(start)
        return s.read() if length is None else s.read(length)


def size(uri: str) -> int:
    f, p = filesystem(uri)
    return f.get_file_info(p).size or 0


def exists(uri: str) -> bool:
    from pyarrow import fs

    f, p = filesystem(uri)
    return f.get_file_info(p).type != fs.FileType.NotFound


def write_bytes(uri: str, data: bytes) -> None:
    """Whole or not at all: written under another name, then renamed, so a repeated task leaves the same file."""
    f, p = filesystem(uri)
    folder = p.rsplit("/", 1)[0]
    f.create_dir(folder, recursive=True)
    tmp = f"{folder}/.{uuid.uuid4().hex}"
    with f.open_output_stream(tmp) as s:
        s.write(data)
    f.move(tmp, p)


def listing(uri: str) -> list[str]:
    """The file itself, or the files of a folder by name."""
    from pyarrow import fs

    f, p = filesystem(uri)
    info = f.get_file_info(p)
    if info.type == fs.FileType.File:
        return [uri]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    return [f"{uri.rstrip('/')}/{x.base_name}" for x in sorted(f.get_file_info(fs.FileSelector(p)), key=lambda x: x.path) if x.type == fs.FileType.File]
