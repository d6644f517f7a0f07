"""Tables and checkpoints in the folder that driver and executors share, gone when they have served."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, a local session gets one in the machine's temporary
    folder; on a cluster that would lose rows, so it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), f"bindery-{os.getuid()}")
    return found.rstrip("/")


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the time of a block; a double underscore stands for a dot. The session's own are put back."""
    own = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """A folder of one job's tables. A table is written once, so a lost executor costs a reread and not a recomputation.

    A result is a plan that may still read some of them, so they can't go when the job's function returns: the file system
    deletes the folder when the session's process ends, and close() does so earlier.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/bindery-{uuid.uuid4().hex}", 0
        where, fs = self._at(self.root)
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def _at(self, path: str):
        sc = self.spark.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(sc._jsc.hadoopConfiguration())

    def folder(self, name: str) -> str:
        """A path for a table or a stream's checkpoint."""
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        """`df`, written and read again. Shuffle files go when it has been written, as nothing else reads them."""
        path = self.folder(name)
        with settings(self.spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        for df in tables:
            where, fs = self._at(df._stored_at)
            fs.delete(where, True)

    def close(self) -> None:
        where, fs = self._at(self.root)
        fs.delete(where, True)
