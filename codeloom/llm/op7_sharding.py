"""Sharding by a permutation-filled lookup table. DataFrame functions only.

The shards take turns: each claims the first free slot of its own permutation of a prime-sized table, given by an offset
and a step that come from the shard's name. The filled table is even to within one slot a turn, and when a shard goes or
comes, few slots of the other shards change hands. A document's key hashes to a slot; the table, whose size is the
parameter `slots` whatever the documents are, is broadcast, so placement is one look-up a row without a shuffle.

The key is the SHA-256 of the text without regard to its id, so equal texts share a shard; null counts as empty.
Repeated rows are placed each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: A prime of at least a hundred slots a shard keeps loads within about a per cent.
SLOTS = 16_381
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Slots are broadcast as one row each; a table beyond this is refused.
MOST_SLOTS = 1_000_003


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The number of the shard that owns each slot. slots must be prime and not fewer than the shards."""
    if not 1 <= len(shards) <= slots <= MOST_SLOTS or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and no more than slots; slots no more than MOST_SLOTS")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be prime")
    half = lambda s, salt: int(hashlib.sha256(f"{salt}:{s}".encode()).hexdigest()[:15], 16)
    place = [half(s, "offset") % slots for s in shards]
    step = [half(s, "step") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while owner[place[i]] >= 0:
                place[i] = (place[i] + step[i]) % slots
            owner[place[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a string key: the first 60 bits of its SHA-256 modulo slots."""
    return (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, key: Column, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """rows with slot and shard."""
    table = _table(rows.sparkSession, fill(shards, slots), shards)
    return rows.withColumn("slot", slot(key, slots)).join(F.broadcast(table), "slot").select(*rows.columns, "slot", "shard")


def _table(spark: SparkSession, owner: list[int], shards: list[str]) -> DataFrame:
    """(slot, shard) of every slot, from two literals: the owners in order and the names."""
    owners = F.split(F.lit(",".join(map(str, owner))), ",")
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select("slot", F.get(names, F.col("owner").cast("int")).alias("shard"))


def shard_documents(docs: DataFrame, shards: list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """One row a document: doc_id, slot, shard."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("key"))
    return place(rows, F.col("key"), shards, slots).select("doc_id", "slot", "shard")


def op7_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def sql() -> str:
    """DuckDB SQL for the query. The table of owners is data here; tests hold `fill` against a plain simulation."""
    owners = ",".join(map(str, fill(SHARDS, SLOTS)))
    return f"""
WITH t AS (SELECT string_split('{owners}', ',') AS owners),
d AS (SELECT doc_id, CAST(('0x' || substr(sha256(coalesce(text, '')), 1, 15)) AS BIGINT) % {SLOTS} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, printf('shard-%03d', CAST(owners[slot + 1] AS INTEGER)) AS shard FROM d, t
"""
