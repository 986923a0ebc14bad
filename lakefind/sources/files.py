"""Files on any Hadoop file system: listing, and the atomic creation that commits rest on."""

from __future__ import annotations

from pyspark.errors.exceptions.base import PySparkException
from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.path(name)))

    def sizes(self, name: str = "") -> dict[str, int]:
        """The bytes of each file in a folder."""
        return {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(self.path(name))}

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file at once; False if it is there already.

        The text goes to a file of its own first, which is then renamed; a
        rename onto an existing file fails, so of two writers one wins.
        """
        import uuid

        if self.exists(name):
            return False
        temp = f".tmp-{uuid.uuid4().hex}"
        self.write(temp, text)
        self._fs.mkdirs(self.path(name).getParent())
        try:
            done = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.spark._jsc.hadoopConfiguration())
            done.rename(self.path(temp), self.path(name), self._no_options())
            return True
        except (Py4JJavaError, PySparkException):
            self.delete(temp)
            if self.exists(name):
                return False
            raise

    def _no_options(self):
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        return self.spark.sparkContext._gateway.new_array(rename, 0)

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self.path(name), True)
