"""Small files through Hadoop's file system, which reaches every store that Spark reads."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Protocol

from pyspark.sql import SparkSession

from ..errors import CommitConflict

#: Schemes of stores whose rename fails, as one step, if the target is there.
RENAMES = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: Fixed value: Hadoop's option for a create that the store itself refuses if the object is there.
CONDITIONAL = "fs.option.create.conditional.overwrite"
#: Classes of file systems of the scheme ``file`` where a file is what lies at its path (Spark brings Hive's).
LOCAL = ("org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.fs.RawLocalFileSystem", "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem")

_local_dir: str | None = None


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, removed at exit: under ``spark.checkpoint.dir``, or, in local mode and
    where that is unset, a temporary one."""
    global _local_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _local_dir = _local_dir or f"file://{tempfile.mkdtemp(prefix='sluice-')}"
        base = _local_dir
    path = f"{base.rstrip('/')}/sluice/{label}-{uuid.uuid4().hex}"
    store = Store(spark)
    store.make_folder(path)  # only a folder that is there can be marked
    store.remove_at_exit(path)
    return path


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it is one of Hadoop's own local file system, which takes files from any process."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    own = fs.getUri().getScheme() == "file" and fs.getClass().getName() in LOCAL
    return fs.makeQualified(jpath).toUri().getPath() if own else None


class Storage(Protocol):
    """What a warehouse needs of a store beside Spark's own readers and writers. Paths are URIs that Spark reads."""

    def exists(self, path: str) -> bool: ...

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""

    def read_text(self, path: str) -> str: ...

    def write_text(self, path: str, text: str) -> None: ...

    def publish(self, path: str, content: dict) -> None:
        """Make a JSON file appear whole and only if it isn't there; else CommitConflict."""

    def remove(self, path: str) -> bool: ...


class Store:
    """Reads, writes, lists and removes small files in any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._hadoop = spark._jvm.org.apache.hadoop

    def _at(self, path: str):
        jpath = self._hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        jpath, fs = self._at(path)
        return fs.exists(jpath)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        jpath, fs = self._at(folder)
        if not fs.exists(jpath):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(jpath))

    def read_text(self, path: str) -> str:
        jpath, fs = self._at(path)
        stream = fs.open(jpath)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write a file, in place of one that is there."""
        jpath, fs = self._at(path)
        self._fill(fs.create(jpath, True), text)

    @staticmethod
    def _fill(stream, text: str) -> None:
        try:
            stream.write(text.encode("utf-8"))
        finally:
            stream.close()

    def fetch(self, path: str, local: str) -> None:
        """Copy a file to the driver's own disk."""
        jpath, fs = self._at(path)
        fs.copyToLocalFile(False, jpath, self._hadoop.fs.Path(f"file://{local}"), True)

    def put(self, local: str, path: str) -> None:
        """Copy a file from the driver's own disk, in place of one that is there."""
        jpath, fs = self._at(path)
        fs.copyFromLocalFile(False, True, self._hadoop.fs.Path(f"file://{local}"), jpath)

    def publish(self, path: str, content: dict) -> None:
        """Make a JSON file appear whole and only if it isn't there; else CommitConflict.

        Where a rename is one step, a draft is renamed. Other stores (s3a, where a rename is a copy) must refuse the
        creation themselves, and one that can't raises an error rather than let two writers win.
        """
        text = json.dumps(content, sort_keys=True)
        jpath, fs = self._at(path)
        try:
            if fs.getUri().getScheme() in RENAMES:
                self._rename_new(path, text)
            else:
                self._fill(fs.createFile(jpath).overwrite(False).must(CONDITIONAL, True).recursive().build(), text)
        except Exception as error:
            if self.exists(path):
                raise CommitConflict(path) from error
            raise

    def _rename_new(self, path: str, text: str) -> None:
        self.make_folder(path.rpartition("/")[0])
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        self.write_text(draft, text)
        files = self._hadoop.fs.FileContext.getFileContext(self._at(path)[0].toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(self._hadoop.fs.Options.Rename, 0)
        try:
            files.rename(self._hadoop.fs.Path(draft), self._hadoop.fs.Path(path), options)
        except Exception:
            self.remove(draft)
            raise

    def make_folder(self, path: str) -> None:
        jpath, fs = self._at(path)
        fs.mkdirs(jpath)

    def remove(self, path: str) -> bool:
        jpath, fs = self._at(path)
        return fs.delete(jpath, True)

    def remove_at_exit(self, path: str) -> bool:
        """Remove a path when the application ends; False if it isn't there yet."""
        jpath, fs = self._at(path)
        return fs.deleteOnExit(jpath)
