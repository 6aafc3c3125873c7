"""Observed queries: subscribers hear of result changes, from batches of changes or from a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lattisca.sources.relations import RelationInput
from lattisca.streaming.maintenance import Change, Session, StaleBasis

#: Columns of a log of changes: the batch, which is a folder's name, and whether a row left.
BATCH, GONE = "lattisca_batch", "lattisca_gone"


class Observer:
    """Tells subscribers ('diff', removed, added) after an update, ('invalidation',) when one was refused, ('reset', rows) when they join."""

    def __init__(self, session: Session):
        self.session, self.subscribers = session, []

    def subscribe(self, hear: Callable) -> Callable[[], None]:
        self.subscribers.append(hear)
        hear(("reset", self.session.rows))
        return lambda: self.subscribers.remove(hear)

    def snapshot(self) -> DataFrame:
        return self.session.rows

    def update(self, changes: dict[str, Change], expected: int, basis: int) -> None:
        try:
            removed, added = self.session.update(changes, expected, basis)
        except StaleBasis:
            for hear in list(self.subscribers):
                hear(("invalidation",))
            raise
        for hear in list(self.subscribers):
            hear(("diff", removed, added))

    def follow(self, stream: DataFrame, relation: str, checkpoint: str, deleted: str | None = None, log: str | None = None):
        """A streaming query that feeds each micro-batch to the session as a change of ``relation``; rows whose ``deleted`` column is true leave it.

        Batches carry their number as basis. A batch that Spark replays after a failure has been applied already and is skipped;
        one that comes before those between it and the session's basis raises StaleBasis, as the session lacks their rows. A session is
        held by the driver; log, a folder that outlives it, keeps the changes of each batch, and restored() gives its relation back.
        """

        def batch(df: DataFrame, number: int) -> None:
            if number < self.session.basis:
                return
            if number > self.session.basis:
                raise StaleBasis(f"the stream is at batch {number}, the session at {self.session.basis}: open it over what restored() reads")
            if log:
                side = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
                df.select(*[c for c in df.columns if c != deleted], side.alias(GONE)).write.mode("overwrite").parquet(f"{log}/{BATCH}={number}")
                df = df.sparkSession.read.parquet(f"{log}/{BATCH}={number}")  # the rows applied are those that were kept
                self._apply(relation, df, GONE, number)
                return
            self._apply(relation, df, deleted, number)

        return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _apply(self, relation: str, df: DataFrame, deleted: str | None, number: int) -> None:
        columns = [c for c in df.columns if c != deleted]
        gone = df.filter(F.col(deleted)) if deleted else df.limit(0)
        there = df.filter(~F.coalesce(F.col(deleted), F.lit(False))) if deleted else df
        self.update({relation: Change(gone.select(*columns), there.select(*columns))}, self.session.basis, number + 1)


def restored(spark: SparkSession, log: str, own: RelationInput) -> tuple[RelationInput, int]:
    """A followed relation as the log of its changes leaves it, and the basis to open a session with: own's rows, if there is no whole batch, and 0.

    own: the relation as it was before the first batch. With occurrence columns the last change of a key tells whether its row is there;
    without them changes add and take rows of a bag. A batch whose writing broke off isn't read; the stream sends it again.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{log}/{BATCH}=*/_SUCCESS")
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    numbers = sorted(int(str(s.getPath().getParent().getName()).split("=")[1]) for s in whole or [])
    if not numbers:
        return own, 0
    schema = StructType([*own.df.schema.fields, StructField(GONE, BooleanType())])
    changes = spark.read.schema(schema).option("basePath", log).parquet(*[f"{log}/{BATCH}={k}" for k in numbers])
    columns = [F.col(f"`{c}`") for c in own.df.columns]
    if own.occurrence:
        first = own.df.select(*columns, F.lit(False).alias(GONE), F.lit(-1).alias(BATCH))
        keys = [F.col(f"`{c}`") for c in own.occurrence]
        row = F.struct(F.col(BATCH), (~F.col(GONE)).alias("there"), F.struct(*columns).alias("row"))
        last = first.unionByName(changes).groupBy(*[k.alias(f"#{i}") for i, k in enumerate(keys)]).agg(F.max_by(row, F.struct(F.col(BATCH), ~F.col(GONE))).alias("last"))
        df = last.filter("last.there").select("last.row.*")
    else:
        there = own.df.unionByName(changes.filter(~F.col(GONE)).select(*columns))
        df = there.exceptAll(changes.filter(F.col(GONE)).select(*columns))
    return replace(own, df=df), numbers[-1] + 1
