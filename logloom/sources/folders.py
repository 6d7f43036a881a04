"""Folders on whatever file system a path names, through Spark's own access to it."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


class Folders:
    """Names, creation and removal of folders: metadata only, no data passes through."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        target = self._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        files, target = self._open(path)
        return files.exists(target)

    def create(self, path: str) -> None:
        files, target = self._open(path)
        if not files.mkdirs(target):
            raise OSError(f"cannot create {path}")

    def remove(self, path: str) -> None:
        files, target = self._open(path)
        if files.exists(target) and not files.delete(target, True):
            raise OSError(f"cannot remove {path}")

    def children(self, path: str) -> list[str]:
        """Names directly under a folder; none if it does not exist."""
        files, target = self._open(path)
        if not files.exists(target):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(target))

    def size(self, path: str) -> int:
        """Bytes of all files under a folder; none if it does not exist."""
        files, target = self._open(path)
        return files.getContentSummary(target).getLength() if files.exists(target) else 0

    def age_seconds(self, path: str) -> float:
        """Time since a folder was made or had an entry added or removed."""
        files, target = self._open(path)
        return time.time() - files.getFileStatus(target).getModificationTime() / 1000

    def read_text(self, path: str) -> str:
        """A small file, without a job."""
        files, target = self._open(path)
        stream = files.open(target)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
