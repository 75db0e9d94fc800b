"""Helpers that several operators share: shared folders, written tables, files on any store."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The C library's call that returns free memory, where it has one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder name that the driver and all executors reach.

    It lies in ``spark.checkpoint.dir``; only a local session may lack that setting, and gets
    a temporary folder.  A path without a scheme lies in Hadoop's default file system, as everywhere in Spark.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read again: lineage ends there."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no later step reads, through Hadoop, whatever its store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


class Files:
    """Whole-file access to a folder URI from driver or executors.

    ``file:`` URIs use the operating system, all others ``pyarrow.fs``.
    """

    def __init__(self, folder: str):
        self.folder = folder
        if folder.startswith("file:"):
            self.fs, self.root = None, folder.removeprefix("file://").removeprefix("file:")
        else:
            from pyarrow import fs

            scheme, _, rest = folder.partition("://")
            self.fs, self.root = fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else folder)  # pyarrow knows one name

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def writer(self, name: str):
        if self.fs is None:
            os.makedirs(self.root, exist_ok=True)
            return open(self._path(name), "wb")  # noqa: SIM115
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(self._path(name))

    def reader(self, name: str):
        """A seekable binary file."""
        return open(self._path(name), "rb") if self.fs is None else self.fs.open_input_file(self._path(name))  # noqa: SIM115

    def remove(self, name: str) -> None:
        try:
            os.remove(self._path(name)) if self.fs is None else self.fs.delete_file(self._path(name))
        except FileNotFoundError:
            pass


def text_groups(texts, most: int = 2 << 20, rows: int = 64):
    """Runs of an Arrow array of texts as bytes, of about ``most`` bytes each: (first index, list).

    Only one run at a time is held as Python objects; null is empty.
    """
    start, size, group = 0, 0, []
    for at in range(0, len(texts), rows):
        for text in texts.slice(at, rows).to_pylist():
            group.append(text or b"")
            size += len(group[-1])
            if size >= most:
                yield start, group
                start, size, group = start + len(group), 0, []
    if group:
        yield start, group
    del group
    released()


def released() -> None:
    """Give what a run of texts held back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)
