"""Binary files in the shared folder, by any path that Arrow's file systems know (local, file:, hdfs:, s3:, gs:)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of ``path`` and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


class AtomicFile:
    """A file that appears under its name only when it is whole, so that a retried task just writes it again."""

    def __init__(self, path: str):
        self.fs, self.path = file_system(path)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.stream = self.fs.open_output_stream(self.temporary, compression=None)
        self.offset = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.offset += len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.temporary, self.path)

    def discard(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.temporary)


def open_file(path: str):
    found, inner = file_system(path)
    return found.open_input_file(inner)
