"""Byte ranges of files for Python data sources: listing, splitting, bounded reads, and writing with a two-phase commit.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), from the driver's planner and from tasks alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition

#: Bytes of a range, and of one read inside it.
RANGE_BYTES, READ_BYTES = 32 << 20, 1 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute local path, and the path in it."""
    return fs.FileSystem.from_uri(path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of all files below the folder in the order of their names; names that begin with _ or . are skipped as Spark does."""
    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    below = lambda p: p[len(at) :].lstrip("/").split("/")
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in below(f.path)))


@dataclass
class ByteRange(InputPartition):
    """Bytes [start, stop) of a file of `size` bytes; what begins there belongs to it, wherever it ends."""

    root: str
    path: str
    start: int
    stop: int
    size: int


def ranges_of(path: str, size: int = RANGE_BYTES) -> list[ByteRange]:
    return [ByteRange(path, name, start, min(start + size, total), total) for name, total in files_of(path) for start in range(0, total, size)]


def blocks(part: ByteRange, start: int, stop: int | None = None, size: int = READ_BYTES) -> Iterator[bytes]:
    """The file's bytes from start to stop, or to its end, in blocks of bounded size."""
    system, _ = file_system(part.root)
    stop = part.size if stop is None else min(stop, part.size)
    with system.open_input_file(part.path) as f:
        f.seek(start)
        while start < stop:
            data = f.read(min(size, stop - start))
            if not data:
                return
            start += len(data)
            yield data


class Staged:
    """Files that tasks write to a job's hidden folder; the driver's commit moves those of the attempts that counted to their names."""

    def __init__(self, path: str):
        self.path, self.job = path, f"_staged-{uuid.uuid4().hex}"

    def open(self, suffix: str) -> tuple[str, object]:
        """A new file of this attempt: its name, and the stream to write to."""
        system, at = file_system(self.path)
        system.create_dir(f"{at}/{self.job}", recursive=True)
        name = f"{uuid.uuid4().hex}{suffix}"
        return name, system.open_output_stream(f"{at}/{self.job}/{name}", compression=None)

    def clear(self) -> None:
        """Drop what earlier jobs left, for an overwriting commit."""
        system, at = file_system(self.path)
        for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            if f.base_name != self.job:
                system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)

    def move(self, name: str, to: str) -> None:
        system, at = file_system(self.path)
        system.create_dir(f"{at}/{to}".rpartition("/")[0], recursive=True)
        system.move(f"{at}/{self.job}/{name}", f"{at}/{to}")

    def end(self) -> None:
        """Drop the job's folder with whatever lost attempts left there."""
        system, at = file_system(self.path)
        system.create_dir(f"{at}/{self.job}", recursive=True)
        system.delete_dir(f"{at}/{self.job}")
