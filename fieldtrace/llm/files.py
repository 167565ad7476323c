"""Files that tasks write and read by ranges, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from fieldtrace.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder of its own below the session's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def place(uri: str):
    """(file system, path) of a path or URI; object stores and HDFS go through their own file systems."""
    if "://" not in uri:
        uri = uri.removeprefix("file:")
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def publish(uri: str, write) -> None:
    """Write a file under a name of this attempt and move it to ``uri`` when it is whole, so that a lost or repeated
    task never leaves half a file there."""
    fs, path = place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


class Ranges:
    """Reads by offset and length from one file."""

    def __init__(self, uri: str):
        fs, path = place(uri)
        self._file = fs.open_input_file(path)
        self.size = self._file.size()

    def read(self, offset: int, length: int) -> bytes:
        if offset < 0 or length < 0 or offset + length > self.size:
            raise ValueError(f"range {offset}+{length} is outside the file's {self.size} bytes")
        self._file.seek(offset)
        return self._file.read(length)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()
