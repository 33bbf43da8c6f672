"""Tables written in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only where that setting is absent and the session is local, as in tests, is a
    temporary folder made and remembered in the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local") or "cluster" in spark.conf.get("spark.master", "local"):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="goldpan-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_gatherers: list[list[Scratch]] = []


@contextlib.contextmanager
def gathered():
    """A list of the folders that are opened inside, for whoever knows when their results are written."""
    found: list[Scratch] = []
    _gatherers.append(found)
    try:
        yield found
    finally:
        _gatherers.remove(found)


class Scratch:
    """One operator run's own folder below the shared one.

    A result reads its tables whenever it is evaluated, so they stay until whoever owns the shared
    folder clears it; what no later plan reads is dropped at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/goldpan/{name}-{uuid.uuid4().hex}"
        self.n = 0
        for found in _gatherers:
            found.append(self)

    def table(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df as Parquet and read it back; the plan above it is cut."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._goldpan_path = path
        return out

    def sweep(self) -> None:
        """Have the shuffle files of finished queries deleted now.

        Spark deletes them once the driver's garbage is collected, by default every half hour.
        """
        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for t in tables:
            self._delete(t._goldpan_path)

    def clear(self) -> None:
        """Delete all tables, once what was made of them is written."""
        self._delete(self.root)
