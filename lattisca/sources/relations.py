"""Inputs of relations: a DataFrame with what is known of its rows' identity, origin and completeness."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RelationInput:
    """One attachment's rows of a relation.

    occurrence: columns whose values identify a row for good; without them a row is known by the hash of its content, so
    equal rows share an identity. basis: the version that cursors and updates must name.
    """

    df: DataFrame
    occurrence: tuple[str, ...] = ()
    completeness: str = "exact"
    source: str | None = None
    attachment: str | None = None
    basis: object = None
    optional: frozenset[str] = field(default_factory=frozenset)

    def occurrence_id(self, relation: str) -> Column:
        """Length-prefixed by the source, or else the attachment, so ids of different inputs never meet."""
        own = F.concat_ws(":", F.lit(relation), *[F.col(f"`{c}`").cast("string") for c in self.occurrence]) if self.occurrence else F.concat(F.lit(relation + ":"), F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.df.columns])), 256))
        name = self.source or self.attachment or ""
        return F.concat(F.lit(f"{len(name)}:{name}"), F.char_length(own).cast("string"), F.lit(":"), own)


def parquet(spark: SparkSession, path: str, **known) -> RelationInput:
    return RelationInput(spark.read.parquet(path), **known)


def catalog(spark: SparkSession, sf_dir: str, names: list[str], keys: dict[str, tuple[str, ...]] | None = None) -> dict[str, list[RelationInput]]:
    """The named Parquet tables of a folder, each as the one input of a relation."""
    return {n: [parquet(spark, f"{sf_dir}/{n}.parquet", occurrence=(keys or {}).get(n, ()))] for n in names}
