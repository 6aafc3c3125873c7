"""Shared pieces of the training-data operators: table access, row keys and bounded slices of batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattisca.sources.shared import shared_dir, spool

__all__ = ["each_returns_memory", "fresh", "hash128", "let", "returns_memory", "shared_dir", "slices", "spool", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that df doesn't have, in any case of letters."""
    there, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in there:
            n += "_"
        there.add(n.lower())
        out.append(n)
    return out


def hash128(*cols):
    """Two 64-bit hashes of the same columns, as a struct: a 128-bit key."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit("lattisca"), *reversed(cols)).alias("b"))


def let(value, body):
    """body(value) with value computed once a row: inside a lambda the optimizer would put the whole expression in place of a name."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """Memory that is free goes back to the system; malloc would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def returns_memory(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives memory back to the system when it ends: Python workers outlive tasks, and several idle ones share an executor with the next stage's."""

    @wraps(task)
    def run(batches):
        yield from task(batches)
        gc.collect()
        give_back()

    return run


def each_returns_memory(group: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """A function of one group of rows, or of two that meet, that gives memory back to the system after each."""

    def run(*parts: pa.Table) -> pa.Table:
        out = group(*parts)
        give_back()
        return out

    if group.__code__.co_argcount == 1:  # Spark counts the arguments
        return lambda part: run(part)
    return lambda own, got: run(own, got)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``size`` bytes together, so that a task's memory doesn't depend on how long texts are; a longer text is a run of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.cast(pc.binary_length(batch.column(column)), pa.int64()), 0)) + 64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
