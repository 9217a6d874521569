"""A folder of Markdown notes as a data source: `spark.read.format("markdown_notes")` and `readStream`, for all files, empty ones too.

Folders down to `depth` are partitions of their own and are listed and read in the tasks; filters on the path (equal, prefix) leave out
folders before they are listed, filters on the time and the option `since` leave out files before they are opened. Files are reached
through Arrow's file systems (local and shared folders, HDFS, object stores).

As a stream, its offset is the newest time of change that lies at least `settle_ms` back, so that files of one moment aren't torn apart; a
batch holds the notes changed after the last offset, up to the new one, and a restarted stream goes on from its checkpoint. A note
that changes again before it is read comes with the next batch. Deletions leave no file to see; they come out of comparing listings.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

NAME = "markdown_notes"
#: path (below the root), mtime, bytes, text with LF ends
SCHEMA = "path string, mtime timestamp, bytes long, text string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Folder(InputPartition):
    """A folder below the root: `deep` with all below it, else its own files only; times of change (microseconds) over `after`, up to `until`."""

    name: str
    deep: bool
    after: int = -(1 << 62)
    until: int = 1 << 62


class Tree:
    """Listing and reading below a root."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.exclude = [g for g in options.get("exclude", ".obsidian/**;.trash/**;node_modules/**").split(";") if g]
        self.depth = int(options.get("depth", "1"))
        since = options.get("since")
        self.since = -(1 << 62) if since is None else micros(datetime.fromisoformat(since.replace("Z", "+00:00")))
        self.prefix, self.exact = "", None

    def place(self) -> tuple[Any, str]:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.root) if "://" in self.root or self.root.startswith("file:") else (fs.LocalFileSystem(), self.root)
        return system, path.rstrip("/")

    def wanted(self, path: str) -> bool:
        return path.endswith(".md") and path.startswith(self.prefix) and (self.exact is None or path == self.exact) and not any(under(path, g) for g in self.exclude)

    def folders(self) -> list[Folder]:
        """The partitions; folders that no wanted path can lie in are left out without being listed."""
        from pyarrow import fs

        system, base = self.place()
        out, todo = [Folder("", False)], [("", 0)]
        while todo:
            name, depth = todo.pop()
            for info in system.get_file_info(fs.FileSelector(f"{base}/{name}".rstrip("/"), allow_not_found=False)):
                if info.type != fs.FileType.Directory:
                    continue
                below = f"{name}{info.base_name}/"
                target = self.exact or self.prefix
                if not (target.startswith(below) or below.startswith(target)) or any(under(below + "x.md", g) for g in self.exclude if g.endswith("/**")):
                    continue
                out.append(Folder(below, depth + 1 >= self.depth))
                if depth + 1 < self.depth:
                    todo.append((below, depth + 1))
        return sorted(out, key=lambda f: f.name)

    def files(self, folder: Folder) -> Iterator[tuple[str, int, int]]:
        """path, time of change and bytes of a partition's notes."""
        from pyarrow import fs

        system, base = self.place()
        for info in system.get_file_info(fs.FileSelector(f"{base}/{folder.name}".rstrip("/"), recursive=folder.deep)):
            path = info.path[len(base) :].lstrip("/")
            if info.type == fs.FileType.File and self.wanted(path):
                at = info.mtime_ns // 1000
                if max(folder.after, self.since) < at <= folder.until:
                    yield path, at, info.size

    def read(self, folder: Folder) -> Iterator[tuple]:
        system, base = self.place()
        for path, at, size in self.files(folder):
            with system.open_input_stream(f"{base}/{path}") as stream:
                text = stream.read().decode("utf-8", "replace").replace("\r\n", "\n")
            yield path, datetime.fromtimestamp(at / 1e6, timezone.utc), size, text


def micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return round(at.timestamp() * 1_000_000)


def under(path: str, glob: str) -> bool:
    """Whether a path fits a glob: `**` stands for any path, `*` and `?` stay within one folder."""
    import re

    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    signs = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return re.fullmatch("".join(signs.get(p, re.escape(p)) for p in parts), path) is not None


class NoteReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.tree = Tree(options)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.tree.exact = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.tree.prefix = max(self.tree.prefix, f.value, key=len)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("mtime",) and getattr(f.value, "tzinfo", None):
                self.tree.since = max(self.tree.since, micros(f.value) - 1)
            yield f  # Spark looks at the rows again

    def partitions(self) -> Sequence[InputPartition]:
        return self.tree.folders()

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.tree.read(partition)


class NoteStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.tree, self.settle = Tree(options), int(options.get("settle_ms", "1000"))

    def initialOffset(self) -> dict:
        return {"at": self.tree.since}

    def latestOffset(self) -> dict:
        newest = max((at for folder in self.tree.folders() for _, at, _ in self.tree.files(folder)), default=self.tree.since)
        return {"at": max(self.tree.since, min(newest, time.time_ns() // 1000 - self.settle * 1000))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [Folder(f.name, f.deep, start["at"], end["at"]) for f in self.tree.folders()] if end["at"] > start["at"] else []

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.tree.read(partition)

    def commit(self, end: dict) -> None:
        pass


class MarkdownNotes(DataSource):
    """Options: path, exclude (globs parted by ;), depth, since (ISO time), settle_ms (of a stream)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return NoteReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return NoteStream(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session, which needs filter pushdown for Python sources. The classes travel by value."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(MarkdownNotes)


def notes(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    """path, mtime, bytes, text of the notes below the root."""
    register(spark)
    return spark.read.format(NAME).options(**options).load(root)


def changed_notes(spark: SparkSession, root: str, **options: Any) -> DataFrame:
    """The same as a stream of what changes."""
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(root)
