"""The folder that driver and executors share, tables written there to cut lineage, and small tables that the driver holds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that the driver holds itself.
SMALL = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without that setting a temporary one, which only a local master can use."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="lattisca-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def spool(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that later steps don't recompute it and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


class Held:
    """Rows computed once. table: the rows themselves, if there are at most SMALL; otherwise df reads them from the shared folder."""

    def __init__(self, df: DataFrame | None, table: pa.Table | None, make: Callable[[], DataFrame] | None = None):
        self.table = table
        if make is None:
            self.df = df
        else:
            self._make = make

    @cached_property
    def df(self) -> DataFrame:
        return self._make()

    @property
    def empty(self) -> bool:
        return self.table is not None and self.table.num_rows == 0


def local(spark: SparkSession, table: pa.Table, like: DataFrame) -> Held:
    """Rows on the driver with the schema of like; plans over them fold at planning, without a job. The DataFrame is made when it is asked for."""
    table = table.combine_chunks()  # an empty first chunk would hide the others
    return Held(None, table, lambda: spark.createDataFrame(table, schema=like.schema))


def hold(df: DataFrame, tag: str) -> Held:
    """df computed once: kept on the driver where it has at most SMALL rows, written to the shared folder where it has more."""
    few = df.limit(SMALL + 1).toArrow()
    if few.num_rows <= SMALL:
        return local(df.sparkSession, few, df)
    return Held(spool(df, tag), None)
