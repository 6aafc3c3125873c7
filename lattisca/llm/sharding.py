"""Sharding by fixed virtual slots.

Records hash by key into a fixed number of virtual slots. Bytes are summed per slot, and a versioned
map sends each slot to a shard. Rebalancing edits the map and never the hash, so only the rows of the
slots that it moves change their shard. Everything is a DataFrame expression; the slot table has
``slots`` rows at any input size, so the map is built in one small task and is safe to broadcast.

Every version of a map holds all slots, those without rows too, so a stored map serves rows that came later.

Law ``bytes``: slots are dealt in falling order of bytes, each to the shard with the least bytes so far,
so shard sizes differ by less than the last slots dealt. A slot without rows is dealt as one byte, which spreads these slots.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattisca.llm.common import shared_dir, spool

SLOTS = 8192
SHARDS = 16
#: A stored map is edited where its largest shard is beyond an equal share by more than this part of it.
SLACK = 0.05
MAP_SCHEMA = "version int, slot int, shard int, slot_bytes bigint, slot_rows bigint"


def slot_of(key: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: the first 32 bits of its MD5, modulo the number of slots. A null key takes the slot of ''."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row. A null text has 0 bytes (and so CRC 0); size adds 1."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), slot_of("doc_id", slots).alias("virtual_slot"))


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, slot_bytes and slot_rows of every slot, zeros where it has no rows."""
    counted = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(counted, "slot", "left").select("slot", F.coalesce("b", F.lit(0)).alias("slot_bytes"), F.coalesce("n", F.lit(0)).alias("slot_rows"))


def _deal(table: DataFrame, loads: Column) -> DataFrame:
    """Deals the slots of table (slot, slot_bytes, slot_rows) in falling order of bytes to the least loaded shard; loads: bytes that the shards have already. One row per slot comes back."""
    packed = table.agg(F.array_sort(F.collect_list(F.struct((-F.greatest("slot_bytes", F.lit(1))).alias("neg"), "slot", "slot_bytes", "slot_rows"))).alias("s"), loads.alias("loads"))
    step = "named_struct('loads', transform(acc.loads, (x, i) -> x + IF(i + 1 = array_position(acc.loads, array_min(acc.loads)), -e.neg, 0L)), 'out', concat(acc.out, array(CAST(array_position(acc.loads, array_min(acc.loads)) - 1 AS INT))))"
    dealt = packed.select("s", F.expr(f"aggregate(s, named_struct('loads', loads, 'out', CAST(array() AS ARRAY<INT>)), (acc, e) -> {step}, acc -> acc.out)").alias("to"))
    pairs = dealt.select(F.explode(F.arrays_zip("s", "to")).alias("p"))
    return pairs.select(F.col("p.s.slot").alias("slot"), F.col("p.to").alias("shard"), F.col("p.s.slot_bytes").alias("slot_bytes"), F.col("p.s.slot_rows").alias("slot_rows"))


def first_map(table: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: slots of slot_bytes() dealt to empty shards."""
    return _deal(table, F.array_repeat(F.lit(0).cast("bigint"), shards)).select(F.lit(1).alias("version"), "slot", "shard", "slot_bytes", "slot_rows")


def rebalance(old: DataFrame, table: DataFrame, shards: int) -> DataFrame:
    """The next version of a map, for new slot bytes or a new number of shards.

    Each shard keeps its largest slots up to an equal share of all bytes; only slots beyond the share, slots of
    shards that are gone, and slots that the old map lacks are dealt anew, to the least loaded shards. A slot of the old map
    that table lacks stays, without rows.
    """
    # Both sides have as many rows as there are slots.
    both = table.join(F.broadcast(old.select("slot", "shard", "version")), "slot", "full_outer")
    now = both.select("slot", "shard", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("slot_bytes", "slot_rows")])
    weight = F.greatest("slot_bytes", F.lit(1))
    share = F.sum(weight).over(Window.partitionBy()) / shards
    so_far = F.sum(weight).over(Window.partitionBy("shard").orderBy(weight.desc(), "slot").rowsBetween(Window.unboundedPreceding, 0))
    marked = now.withColumn("share", share).withColumn("so_far", so_far).withColumn("stays", F.coalesce((F.col("shard") < shards) & (F.col("so_far") <= F.col("share")), F.lit(False)))
    stay = marked.filter("stays")
    held = stay.groupBy("shard").agg(F.sum(weight).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "b"))).alias("held"))
    loads = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.element_at(F.first("held"), i), F.lit(0).cast("bigint")))
    moved = _deal(marked.filter("NOT stays").select("slot", "slot_bytes", "slot_rows").crossJoin(F.broadcast(held)), loads)
    version = old.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("version"))
    return stay.select("slot", "shard", "slot_bytes", "slot_rows").unionByName(moved).crossJoin(F.broadcast(version)).select("version", "slot", "shard", "slot_bytes", "slot_rows")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the stored versions; none where no map is stored."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    return sorted(r[0] for r in spark.read.schema(MAP_SCHEMA).parquet(path).select("version").distinct().collect())


def save_map(shard_map: DataFrame, path: str) -> int:
    """Stores one version and returns its number; earlier versions stay readable. A version that is stored already, and a map that lacks a slot or has one twice, are refused."""
    ready = spool(shard_map, "map")
    low, high, n, slots, last = ready.agg(F.min("version"), F.max("version"), F.count(F.lit(1)), F.count_distinct("slot"), F.max("slot")).first()
    if not n or low != high or n != slots or n != last + 1:
        raise ValueError("a map has one version and each slot once")
    if low in versions(shard_map.sparkSession, path):
        raise ValueError(f"version {low} is stored already")
    ready.drop("version").coalesce(1).write.mode("error").parquet(f"{path.rstrip('/')}/version={low}")
    return low


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the latest by default; one that isn't stored raises ValueError."""
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise ValueError(f"no version {'' if version is None else version} at {path}")
    return spark.read.schema(MAP_SCHEMA).parquet(path).filter(F.col("version") == (there[-1] if version is None else version))


def crooked(shard_map: DataFrame, table: DataFrame, shards: int, slack: float = SLACK) -> bool:
    """Whether a map should be edited for slot bytes: it has other shards, or one holds more than its share, the slack and its largest slot."""
    loads = shard_map.select("slot", "shard").join(table, "slot").groupBy("shard").agg(F.sum("slot_bytes").alias("b"), F.max("slot_bytes").alias("most")).collect()  # a row a shard
    share = sum(r.b for r in loads) / shards
    return {r.shard for r in loads} != set(range(shards)) or any(r.b > share * (1 + slack) + r.most for r in loads)


def assign(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Shard and slot of each row of sized(). slot: the row's place in its shard, gapless from 0: rows of one virtual slot lie together, in order of doc_id.

    The map may have been made for other rows: places start where the rows assigned here end in the slots before. No row is
    lost: with a map that lacks its slot, which save_map() refuses, a row would have a null shard and slot. No task orders a
    whole shard: places are counted inside virtual slots.
    """
    counted = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n"))
    known = shard_map.select(F.col("slot").alias("virtual_slot"), "shard", "version").join(counted, "virtual_slot", "left")
    starts = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    placed = known.select("virtual_slot", "shard", F.coalesce(starts, F.lit(0)).alias("start"), "version")  # a row a slot
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("within", within).join(F.broadcast(placed), "virtual_slot", "left").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All rows of docs in shards 0 to shards - 1, by law ``bytes``, with the map stored at path.

    Without a stored map version 1 is made and stored; a stored one is used as it is, or, where it is crooked() for these
    rows, edited and stored as its next version. Without a path the map is stored in the shared folder, for this call.

    Nulls: a null doc_id takes the slot of the empty key, a null text counts as empty. Repeated rows go to one shard and
    get places of their own; ties keep any order among equal rows. An empty table gives no rows. Columns other than
    doc_id and text are not read, so clashing names do no harm.
    """
    spark, rows = docs.sparkSession, sized(docs, slots)
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    table = slot_bytes(rows, slots)
    if not versions(spark, path):
        save_map(first_map(table, shards), path)
    elif crooked(load_map(spark, path), table := spool(table, "slots"), shards):
        save_map(rebalance(load_map(spark, path), table, shards), path)
    return assign(rows, load_map(spark, path))
