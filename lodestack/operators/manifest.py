"""What a stored table consists of: a list of segments that changes by compare-and-rename, so that of two writers one wins.

Each version is one small file, `manifest/<number>.json`, written aside and renamed to its number; a rename never replaces a file, so a
writer that started from an older version fails and nothing of it is seen. A segment is a folder that only a version names: readers
take one version and its segments, whatever is written meanwhile. Needs a file system whose rename is atomic (HDFS, a local one).
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

START: dict[str, Any] = {"segments": [], "batches": {}}


class Conflict(RuntimeError):
    """Another writer was first; the change has to be made again from the newest version."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.base = spark.sparkContext._jvm, f"{path}/manifest"
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.base).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path(self.base)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.base))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, version: int | None = None) -> tuple[int, dict[str, Any]]:
        """A version's number and content, the newest by default; 0 and an empty list before the first."""
        number = version if version is not None else max(self.versions(), default=0)
        if not number:
            return 0, json.loads(json.dumps(START))
        stream = self.fs.open(self._path(f"{self.base}/{number:012d}.json"))
        try:
            return number, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, content: dict[str, Any]) -> int:
        """The version after `base`, unless there is one already."""
        aside, target = self._path(f"{self.base}/.{uuid.uuid4().hex}"), self._path(f"{self.base}/{base + 1:012d}.json")
        self.fs.mkdirs(self._path(self.base))
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.NONE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            files.rename(self.fs.makeQualified(aside), self.fs.makeQualified(target), options)
        except Exception as error:
            self.fs.delete(aside, False)
            if self.fs.exists(target):
                raise Conflict(f"version {base + 1} exists") from error
            raise
        return base + 1
