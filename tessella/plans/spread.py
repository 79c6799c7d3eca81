"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: A table of more bytes than this is left as its files are split.
SMALL = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it is small and lies in fewer files than there are cores.

    A small file is one split and would be read, parsed and tokenised by one task; moving it costs next
    to nothing.  Large tables have splits enough and are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL and len(df.inputFiles()) < cores else df
