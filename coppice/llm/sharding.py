"""Sharding through fixed virtual slots and a versioned slot-to-shard map.

A record's slot comes from a hash of its id and text and never changes. Bytes and
rows are summed per slot, so everything decided outside the cluster's tasks is a
table of ``SLOTS`` numbers. Version 1 of the map gives each shard an equal run of
slots; a rebalancing reads the newest version and writes a further one in which slots
have moved, one at a time, from the fullest shards to the emptiest; records keep their
slots. Records are placed by the newest stored version.

Law: `bytes`. Slots of one hash hold about equal bytes, and whole slots move until
the shards' sizes differ by less than the smallest useful move.

Defined results: a null text has no bytes and counts as size 1 with the CRC of
nothing; rows that are equal in id and text share a slot and get places next to
each other; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.plans.storage import materialize, new_path, table

SLOTS = 4096


def measured(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of every record."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def equal_map(shards: int, slots: int = SLOTS) -> list[int]:
    return [slot * shards // slots for slot in range(slots)]


def rebalanced(shard_of: list[int], weight: list[int], shards: int) -> list[int]:
    """An edited map: slots moved from the fullest to the emptiest shard while that lowers the larger of the two.

    Works on a number per slot, whatever the number of records.
    """
    shard_of = list(shard_of)
    load, held = [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        load[shard] += weight[slot]
        held[shard].append(slot)
    for _ in range(len(shard_of) * shards):
        full, low = max(range(shards), key=lambda s: (load[s], -s)), min(range(shards), key=lambda s: (load[s], s))
        gap = load[full] - load[low]
        best = min((s for s in held[full] if 0 < weight[s] < gap), key=lambda s: (abs(2 * weight[s] - gap), s), default=None)
        if best is None:
            break
        held[full].remove(best)
        held[low].append(best)
        load[full] -= weight[best]
        load[low] += weight[best]
        shard_of[best] = low
    return shard_of


def lookup(values: list[int], kind: str = "int") -> Column:
    """A constant array of a number per slot, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def map_frame(spark: SparkSession, version: int, shard_of: list[int]) -> DataFrame:
    return spark.range(1).select(F.lit(version).alias("version"), F.posexplode(lookup(shard_of)).alias("slot", "shard"))


def newest_map(spark: SparkSession, map_path: str, shards: int, slots: int) -> tuple[int, list[int]]:
    """The newest stored version and its map; where none is stored, version 1 is written."""
    try:
        stored = spark.read.schema("slot int, shard int, version int").parquet(map_path)
        version = stored.agg(F.max("version")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        version = None
    if version is None:
        store_map(spark, map_path, 1, equal_map(shards, slots))
        return newest_map(spark, map_path, shards, slots)
    rows = stored.where(F.col("version") == version).orderBy("slot").collect()
    if [r["slot"] for r in rows] != list(range(slots)) or any(r["shard"] >= shards for r in rows):
        raise ValueError(f"version {version} of {map_path} is no map of {slots} slots to {shards} shards")
    return version, [r["shard"] for r in rows]


def store_map(spark: SparkSession, map_path: str, version: int, shard_of: list[int]) -> None:
    map_frame(spark, version, shard_of).drop("version").coalesce(1).write.parquet(f"{map_path}/version={version}")


def slot_totals(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; at most `slots` rows come to the driver."""
    size, count = [0] * slots, [0] * slots
    for slot, b, n in rows.groupBy("virtual_slot").agg(F.sum("size"), F.count("*")).collect():
        size[slot], count[slot] = b, n
    return size, count


def place(rows: DataFrame, shard_of: list[int], count: list[int]) -> DataFrame:
    """Shard and gapless place in it: rows before the slot, from the slot totals, plus the rank within the slot."""
    before, seen = [0] * len(shard_of), {}
    for slot, shard in enumerate(shard_of):
        before[slot] = seen.get(shard, 0)
        seen[shard] = before[slot] + count[slot]
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.select(
        "*",
        F.get(lookup(shard_of), F.col("virtual_slot")).alias("shard"),
        (F.get(lookup(before, "bigint"), F.col("virtual_slot")) + rank - 1).alias("slot"),
    )


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every record with its shard under the newest map under map_path, which is rebalanced first, as a further version, if it can be."""
    spark = docs.sparkSession
    rows = materialize(measured(docs, slots), "measured")
    size, count = slot_totals(rows, slots)
    path = map_path or new_path(spark, "slot-map")
    version, stored = newest_map(spark, path, shards, slots)
    if (edited := rebalanced(stored, size, shards)) != stored:
        store_map(spark, path, version + 1, edited)
        version, stored = newest_map(spark, path, shards, slots)
    return place(rows, stored, count).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
