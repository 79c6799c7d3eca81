"""Lineage cuts that survive the loss of executors.

Iterative plans are cut by writing the intermediate table into the shared folder that the
cluster names in ``spark.checkpoint.dir``.  A written table is columnar and compressed, so it
costs less disk than a serialised RDD checkpoint, and later readers prune columns from it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.ship import ship


def shared_root(spark: SparkSession) -> str:
    """Folder shared by all executors; a temporary one is set only where none is configured."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
        root = sc.getCheckpointDir()
    return root.rstrip("/")


_OPEN: list[Scratch] = []
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@atexit.register
def sweep() -> None:
    """Delete the tables of all queries so far: at exit, or in a long session once their results are written."""
    while _OPEN:
        _OPEN.pop().close()


class Scratch:
    """Written tables of one query, under one folder of the shared root."""

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/tessella/{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append(self)

    def cut(self, df: DataFrame, file_rows: int = 0, batch_bytes: str | None = None) -> DataFrame:
        """Write ``df`` and return a scan of what was written.

        ``file_rows`` is the most rows of a file, 0 for any number; ``batch_bytes`` about the most that goes to
        Python at once, None for what the session has.
        """
        self._n += 1
        path = f"{self.root}/t{self._n}"
        conf, before = self.spark.conf, self.spark.conf.get(_BATCH)
        try:
            conf.set(_BATCH, batch_bytes or before)
            df.write.option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(path)
        finally:
            conf.set(_BATCH, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, n: int) -> None:
        """Delete table ``n`` of this scratch; only for tables that no later plan reads."""
        self._delete(f"{self.root}/t{n}")

    @property
    def last(self) -> int:
        return self._n

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the JVM may already be gone at interpreter exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
