"""Small files of commits in the shared store, by Spark's own file systems: written once, never replaced."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Folder:
    """A folder of any store that Spark reaches, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def names(self) -> list[str]:
        """In order."""
        if not self._fs.exists(self._root):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._root))

    def put_new(self, name: str, content: object) -> bool:
        """Write JSON under a name that isn't taken; False if it is. What was cut off while it was written reads as None."""
        self._fs.mkdirs(self._root)
        try:
            out = self._fs.create(self._at(name), False)
        except Exception as e:  # noqa: BLE001  the store's own exception, by the JVM
            if "exists" in str(e).lower():
                return False
            raise
        try:
            out.write(bytearray((json.dumps(content, sort_keys=True) + "\n").encode()))
        finally:
            out.close()
        return True

    def get(self, name: str) -> Any:
        """The JSON of a file; None if it isn't there or isn't whole."""
        try:
            rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect()
            return json.loads(rows[0].value) if rows and rows[0].value.endswith("\n") else None
        except (PySparkException, ValueError):
            return None

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
