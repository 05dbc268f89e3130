"""Results that are written once to the shared folder and read again.

All paths lie in the folder that ``spark.checkpoint.dir`` names. Executors open raw files there
through Arrow's filesystems, so the folder may be on a disk all machines mount or in a store.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from tablerisk.functions.durable import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder path for one run of an operator."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Write a frame as Parquet and continue from the files; this cuts its lineage."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def growing(df: DataFrame) -> DataFrame:
    """A join side that grows with the corpus: never broadcast, so small and large inputs share one plan."""
    return df.hint("merge")


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's filesystem and path for a folder given as path or URI."""
    if "://" in folder or folder.startswith("file:"):
        if folder.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), os.path.abspath(folder)


class Folder:
    """Raw files in the shared folder; a file appears under its name only when it is complete."""

    def __init__(self, folder: str):
        self.fs, self.path = filesystem(folder)

    def open_new(self, name: str):
        """A stream to a private name; pass it to ``publish`` when all is written."""
        self.fs.create_dir(self.path, recursive=True)
        private = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        stream = self.fs.open_output_stream(private, compression=None)
        return stream, private

    def publish(self, private: str, name: str) -> None:
        """Give a finished file its name; a repeated task replaces the same content."""
        self.fs.move(private, f"{self.path}/{name}")

    def write(self, name: str, data: bytes | np.ndarray) -> None:
        stream, private = self.open_new(name)
        with stream:
            stream.write(memoryview(np.ascontiguousarray(data)).cast("B") if isinstance(data, np.ndarray) else data)
        self.publish(private, name)

    def open_input(self, name: str):
        return self.fs.open_input_stream(f"{self.path}/{name}", compression=None)

    def open_file(self, name: str):
        return self.fs.open_input_file(f"{self.path}/{name}")

    def holds(self, name: str) -> bool:
        return self.fs.get_file_info(f"{self.path}/{name}").type == pafs.FileType.File

    def array(self, name: str, dtype) -> np.ndarray:
        """A stored array, mapped into memory where the folder is mounted, else read."""
        if isinstance(self.fs, pafs.LocalFileSystem):
            path = f"{self.path}/{name}"
            return np.memmap(path, dtype, "r").view(np.ndarray) if os.path.getsize(path) else np.zeros(0, dtype)
        with self.open_input(name) as stream:
            return np.frombuffer(stream.read(), dtype)

    def write_arrays(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        """Arrays in one file, which a task opens and maps once; a directory of their places stands in front."""
        ends = np.cumsum([(a.nbytes + 7) // 8 * 8 for a in arrays.values()], dtype=np.int64).tolist()
        places = {key: (end - (a.nbytes + 7) // 8 * 8, a.nbytes) for (key, a), end in zip(arrays.items(), ends)}
        head = json.dumps(places).encode()
        head += b" " * (-len(head) % 8)
        stream, private = self.open_new(name)
        with stream:
            stream.write(np.array([len(head)], np.int64).tobytes() + head)
            for a in arrays.values():
                stream.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
        self.publish(private, name)

    def arrays(self, name: str) -> Callable[[str, object], np.ndarray]:
        """Opens a file of arrays; the result gives each by its key and type."""
        data = self.array(name, np.uint8)
        start = 8 + int(data[:8].view(np.int64)[0])
        places = json.loads(data[8:start].tobytes())

        def load(key: str, dtype) -> np.ndarray:
            place, size = places[key]
            return data[start + place : start + place + size].view(dtype)

        return load
