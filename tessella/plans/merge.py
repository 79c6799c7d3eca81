"""Tables that change: upserts, deletes and versions that appear whole or not at all."""

from __future__ import annotations

import json
import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from tessella.plans.ship import ship


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; of several new ones the last by ``order``.

    Null keys equal null keys.  Without ``order`` whole rows decide, the greatest wins.
    """
    columns = old.columns
    rank = [F.col(order).desc_nulls_last()] if order else []
    last = W.partitionBy(*keys).orderBy(*rank, *(F.col(c).desc_nulls_last() for c in columns if c not in keys))
    fresh = new.select(*columns).withColumn("__row_no", F.row_number().over(last)).filter("__row_no = 1").drop("__row_no")
    return deleted(old, fresh, keys).unionByName(fresh)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``old`` with those rows of ``new`` whose keys it lacks."""
    return upsert(old, deleted(new.select(*old.columns), old, keys), keys, order)


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the rows whose keys are in ``gone``; null keys equal null keys."""
    g = gone.select(*(F.col(k).alias(f"__gone_{k}") for k in keys)).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"__gone_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return old.join(g, on, "left_anti")


class VersionedFolder:
    """A folder of tables in versions, of which one is current.

    A version is written beside the others and becomes current by one rename of a small pointer file, so
    readers see the old one or the new one.  Who opened a version keeps reading it until it is dropped.
    """

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The name of the current version."""
        p, fs = self._fs(f"{self.folder}/CURRENT")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def path(self, version: str) -> str:
        return f"{self.folder}/{version}"

    def new(self) -> str:
        return f"v-{uuid.uuid4().hex}"

    def publish(self, version: str) -> None:
        """Make a version current."""
        target, fs = self._fs(f"{self.folder}/CURRENT")
        draft, _ = self._fs(f"{self.folder}/CURRENT.{version}")
        out = fs.create(draft, True)
        out.write(bytearray(version.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs(f"{self.folder}")[1].getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, target, options)

    def drop(self, version: str) -> None:
        p, fs = self._fs(self.path(version))
        fs.delete(p, True)


def write_json_atomically(path: str, value) -> None:
    """A local JSON file that is there whole or not at all."""
    p = Path(path)
    draft = p.with_name(f".{p.name}.{uuid.uuid4().hex}")
    draft.write_text(json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    os.replace(draft, p)
