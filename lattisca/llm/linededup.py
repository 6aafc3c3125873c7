"""Line dedup over overlapping windows of three lines.

Consecutive lines hash to windows; windows that occur more than once anywhere are found with one aggregation,
and every line that a later occurrence covers is removed. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattisca.llm.common import fresh, hash128, let

LINES = 3


def line_dedup(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """docs with ``text`` cut, and n_lines and n_removed (bigint) added.

    Lines end at newlines. A window is ``lines`` consecutive lines of one text; its first occurrence has the smallest
    (doc_id, hash of the text, place); lines that any other occurrence covers go, windows being judged on the input.
    Texts of fewer lines have no window and stay. A null text stays null, with 0 lines; an empty text has one line.
    A null doc_id sorts first. Rows with the same doc_id and text count as one document and are all treated alike.
    An empty table gives an empty result. Other columns stay; an input's own n_lines or n_removed is replaced.
    """
    null = F.lit(-(2**63))
    own = [F.coalesce(F.col("doc_id").cast("bigint"), null).alias("d"), F.xxhash64("text").alias("h")]

    def hashes(parts):
        one = F.transform(parts, lambda x: hash128(x))
        starts = F.when(F.size(parts) >= lines, F.sequence(F.lit(1), F.size(parts) - (lines - 1)))
        return let(one, lambda x: F.transform(starts, lambda i: hash128(*[F.element_at(x, i + j)[f] for j in range(lines) for f in ("a", "b")])))

    windows = docs.select(*own, F.posexplode(let(F.split("text", "\n", -1), hashes)).alias("p", "w"))
    windows = windows.select("d", "h", "p", F.col("w.a").alias("wa"), F.col("w.b").alias("wb"))
    place = F.struct("d", "h", "p")
    repeated = windows.groupBy("wa", "wb").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").select("wa", "wb", "first")
    later = windows.join(repeated, ["wa", "wb"]).filter(place != F.col("first"))
    covered = later.groupBy("d", "h").agg(F.collect_set("p").alias("at"))
    d, h, g = fresh(docs, "d", "h", "gone")
    gone = covered.select(F.col("d").alias(d), F.col("h").alias(h), F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + (lines - 1))))).alias(g))
    joined = docs.withColumns({d: own[0], h: own[1]}).join(gone, [d, h], "left")
    kept = let(F.split("text", "\n", -1), lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(g)), lambda i: F.element_at(x, i + 1)))
    return joined.select(
        *[F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(F.split("text", "\n", -1))).cast("bigint").alias("n_lines"),
        F.when(F.col(g).isNull(), F.lit(0)).otherwise(F.size(g)).cast("bigint").alias("n_removed"),
    )
