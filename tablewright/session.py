"""Session settings the operators need: where reliable checkpoints and scratch tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import col


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` decides.  Only a local session without it gets a
    temporary folder; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of that machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        configured = tempfile.mkdtemp(prefix="tablewright-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for a scratch table in the session's shared folder.

    The whole folder is removed when the driver's JVM ends in an orderly way.
    """
    root = checkpoint_dir(spark)
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files outlive a lost executor; later reads prune columns.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Successive states of one table, of which only the newest stays on disk."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._path: str | None = None

    def write(self, df: DataFrame) -> DataFrame:
        """``df`` written and read back; what was written before is deleted."""
        path = scratch_path(self._spark, "round")
        df.write.parquet(path)
        self.close()
        self._path = path
        return self._spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        if self._path is not None:
            place = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
            place.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            self._path = None


BROADCAST_BYTES = 64 * 1024 * 1024
_ROW_OVERHEAD = 64


def row_bytes(df: DataFrame) -> Column:
    """Estimated size of a row: text at its length, nested values at that of their JSON
    text, everything else at eight bytes."""
    size = F.lit(_ROW_OVERHEAD + 8 * len(df.columns)).cast("bigint")
    for name, dtype in df.dtypes:
        if dtype in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(col(name)), F.lit(0))
        elif dtype.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(col(name)))), F.lit(0))
    return size


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast when its measured size allows, else as it is.

    Left unmarked, a join shuffles and adaptive execution splits hot keys.
    """
    measured = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return F.broadcast(df) if measured <= max_bytes else df
