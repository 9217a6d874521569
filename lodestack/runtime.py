"""Session helpers: shipping the package to executors, a small-table reader, and the shared folder for tables between jobs."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_SCRATCH: list[str] = []


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        root = Path(__file__).resolve().parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        target = Path(tempfile.mkdtemp(prefix="lodestack-")) / "lodestack_pkg.zip"
        atexit.register(shutil.rmtree, target.parent, True)
        target.write_bytes(buffer.getvalue())
        context.addPyFile(str(target))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state_of(spark: SparkSession, path: str) -> str:
    """Bytes, files and last change of a table's folder or file, which tell whether it was rewritten."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = fs.getContentSummary(place)
    newest = max([fs.getFileStatus(place).getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(place))])
    return f"{whole.getLength()}-{whole.getFileCount()}-{newest}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder, which goes with the process; on a cluster that would be a folder
    that no executor sees, so it is an error there.
    """
    context = spark.sparkContext
    base = context.getCheckpointDir()
    if base is None:
        base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
        if not base:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="lodestack-shared-")
            atexit.register(shutil.rmtree, base, True)
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return base


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder for a written table; `drop_scratch` removes it."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows, written once in the shared folder and read from there: lineage ends, and their size is known to the planner."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove one written table."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _SCRATCH:
        _SCRATCH.remove(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the tables written by this process, when no result that reads them is needed any more."""
    while _SCRATCH:
        drop(spark, _SCRATCH[-1])
