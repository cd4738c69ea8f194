"""Published versions of a table: new files beside the old ones, then one pointer file replaced in one step.

A job that fails before the switch leaves the old version in place, one that fails after it the new one; readers and
other handles follow the pointer, so they see one whole version. There is one writer at a time: a publication that builds on a version which isn't
the current one any more is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


class Pointer:
    """The name of the current folder below a path, in a file that is replaced by one rename."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop

    def _file(self, name: str):
        return self._hadoop.fs.Path(f"{self.path}/{name}")

    def _system(self):
        return self._file(POINTER).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def get(self) -> str | None:
        """The current name, None before the first one."""
        if not self._system().exists(self._file(POINTER)):
            return None
        stream = self._system().open(self._file(POINTER))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def set(self, name: str) -> None:
        own = self._file(f"{POINTER}-{uuid.uuid4().hex}")
        stream = self._system().create(own)
        stream.write(bytearray(name.encode()))
        stream.close()
        jvm = self.spark._jvm
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = jvm.java.lang.reflect.Array.newInstance(kind, 1)
        options[0] = jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
        self._hadoop.fs.FileContext.getFileContext(self._system().getUri(), self.spark._jsc.hadoopConfiguration()).rename(own, self._file(POINTER), options)


class Versions:
    """A table kept as versions below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.pointer = spark, path.rstrip("/"), Pointer(spark, path)

    def read(self, version: str | None = None) -> DataFrame:
        """The current version, or one of those that are still kept."""
        name = version or self.pointer.get()
        if name is None:
            raise ValueError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, rows: DataFrame) -> str:
        """Writes a version that nobody reads yet."""
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def publish(self, rows: DataFrame, based_on: str | None = None) -> str:
        """Writes a version and makes it the current one; with `based_on`, only if that is still the current one."""
        name = self.write(rows)
        if based_on is not None and self.pointer.get() != based_on:
            raise ValueError(f"{based_on} isn't the current version any more")
        self.pointer.set(name)
        return name

    def update(self, change: Callable[[DataFrame], DataFrame]) -> str:
        """Publishes what `change` makes of the current version."""
        current = self.pointer.get()
        return self.publish(change(self.read(current)), current)

    def drop_others(self) -> int:
        """Deletes all versions but the current one, those of failed jobs too, and says how many. No job may be reading them."""
        system, current, n = self.pointer._system(), self.pointer.get(), 0
        for found in system.listStatus(self.pointer._file("")):
            name = found.getPath().getName()
            if name != current and (name.startswith("version-") or name.startswith(f"{POINTER}-")):
                system.delete(found.getPath(), True)
                n += name.startswith("version-")
        return n
