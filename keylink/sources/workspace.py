"""Shared scratch tables.

Intermediate results that several jobs read are written as parquet into the
shared folder named by ``spark.checkpoint.dir``.  They outlive executors, cut
the lineage, and give later jobs pruned columns and known sizes.
"""

from __future__ import annotations

import functools
import itertools
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Has Spark delete the shuffle files of an execution as it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Workspace:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = f"{root or shared_folder(spark)}/keylink-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)
        self._saved: list[tuple[DataFrame, str]] = []

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes ``frame`` once and returns it as read back."""
        path = f"{self.root}/{next(self._numbers):04d}-{name}"
        with _shuffles_removed(self.spark):
            frame.write.parquet(path)
        saved = self.spark.read.schema(frame.schema).parquet(path)
        self._saved.append((saved, path))
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Removes tables that ``save`` returned and that no later job reads."""
        for path in [p for saved, p in self._saved if any(saved is f for f in frames)]:
            self.remove(path)
        self._saved = [x for x in self._saved if not any(x[0] is f for f in frames)]

    def clear(self) -> None:
        """Removes all tables."""
        self._saved = []
        self.remove(self.root)

    def remove(self, path: str) -> None:
        """Deletes a file or folder of this scratch space."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


_LOCK = threading.Lock()
_WRITING: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Sets ``CLEANUP`` while some thread writes, and then puts back what the session had.

    What is written is read back from its files, so nothing asks for these shuffles again."""
    with _LOCK:
        writing, before = _WRITING.get(id(spark), (0, None))
        if not writing:
            before = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _WRITING[id(spark)] = (writing + 1, before)
    try:
        yield
    finally:
        with _LOCK:
            writing, before = _WRITING.pop(id(spark))
            if writing > 1:
                _WRITING[id(spark)] = (writing - 1, before)
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.conf.get("spark.master", "").startswith("local"):
        return _local_folder()
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="keylink-")
