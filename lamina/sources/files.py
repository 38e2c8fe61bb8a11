"""The few file operations that tables need, through Hadoop's FileSystem, so that any store that Spark reads will do."""

from __future__ import annotations

import os
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.where(name))

    def where(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        """Bytes under name."""
        return self._fs.getContentSummary(self._path(name)).getLength()

    def age(self, name: str) -> float:
        """Seconds since name was changed."""
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def claim(self, name: str) -> bool:
        """Creates an empty file; False if it exists. Of writers at the same time, one is told True.

        A local file is opened exclusively, other stores are asked for a file that overwrites none, which HDFS does in
        one step, as do object stores with conditional writes.
        """
        if self._fs.getUri().getScheme() == "file":
            path = self._fs.makeQualified(self._path(name)).toUri().getPath()
            try:
                os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(self._path(name), False).close()
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True

    def rename(self, old: str, new: str) -> None:
        """To a name that is the caller's alone."""
        if not self._fs.rename(self._path(old), self._path(new)):
            raise OSError(f"{self.where(old)} couldn't be renamed to {new}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self._path(name), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
