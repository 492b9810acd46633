"""Snapshots, patches and sessions: what changed since the last build, merge on read, delta reads, logs.

Batch forms are joins and windows; `reconcile_stream` runs the same patch for each micro-batch of a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries that a session keeps of content, and of operations.
MOST_ENTRIES, MOST_OPS = 200, 100


def snapshot_diff(indexed: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): added, modified or deleted, by path, mtime_ns and size: one full outer join."""
    a, b = indexed.select("path", F.col("mtime_ns").alias("m0"), F.col("size").alias("s0")), now.select("path", F.col("mtime_ns").alias("m1"), F.col("size").alias("s1"))
    change = F.when(F.col("s0").isNull(), "added").when(F.col("s1").isNull(), "deleted").when((F.col("m0") != F.col("m1")) | (F.col("s0") != F.col("s1")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")


def fresh(entries: DataFrame, now: DataFrame) -> DataFrame:
    return entries.join(now.select("path", "mtime_ns", "size"), ["path", "mtime_ns", "size"], "left_semi")


def dirty(log: DataFrame) -> DataFrame:
    return log.select("path").distinct()


def patched(table: DataFrame, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """A table keyed by path after changes: rows of deleted and modified files go, those of modified and added come."""
    kept = table.join(changes.where("change <> 'added'").select("path"), "path", "left_anti")
    new = rows.join(changes.where("change <> 'deleted'").select("path"), "path", "left_semi")
    return kept.unionByName(new)


def reconcile_stream(stream: DataFrame, extract, read_table, write_table):
    """A streaming query that patches a table with what `extract` makes of each batch of files, all taken as modified."""

    def step(batch: DataFrame, _: int) -> None:
        changes = batch.select("path").distinct().withColumn("change", F.lit("modified"))
        write_table(patched(read_table(), changes, extract(batch)))

    return stream.writeStream.foreachBatch(step).trigger(availableNow=True)


def delta_reads(log: DataFrame) -> DataFrame:
    """log(session, ord, key, hash) with status: new, or unchanged if the last read of the key had the same content."""
    w = Window.partitionBy("session", "key").orderBy("ord")
    return log.withColumn("status", F.when(F.lag("hash").over(w) == F.col("hash"), "unchanged").otherwise("new"))


def kept_entries(log: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(session, key): the entries used last."""
    last = log.groupBy("session", "key").agg(F.max("ord").alias("last"))
    w = Window.partitionBy("session").orderBy(F.desc("last"), "key")
    return last.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("session", "key", "last")


def recent_ops(log: DataFrame, most: int = MOST_OPS) -> DataFrame:
    w = Window.partitionBy("session").orderBy(F.desc("ord"))
    return log.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def edits_since_read(log: DataFrame) -> DataFrame:
    """(session, n): edits after the last read of a session; all of them if it never read."""
    reads = log.where("op = 'read'").groupBy("session").agg(F.max("ord").alias("last_read"))
    edits = log.where("op = 'edit'").join(reads, "session", "left").where("last_read IS NULL OR ord > last_read")
    return edits.groupBy("session").agg(F.count("*").alias("n"))


def stale_assumptions(assumed: DataFrame, current: DataFrame) -> DataFrame:
    return assumed.join(current.withColumnRenamed("hash", "now"), "key").where("hash <> now").select("key")


def external_changes(seen: DataFrame, now: DataFrame) -> DataFrame:
    """Files whose time moved and whose content differs."""
    return seen.join(now.select("path", F.col("mtime_ns").alias("m1"), F.col("hash").alias("h1")), "path").where("mtime_ns <> m1 AND hash <> h1").select("path")


def build_state(log: DataFrame) -> DataFrame:
    """(session, status, edited): the last verify's result, and whether edits came after it."""
    last = log.where("op = 'verify'").groupBy("session").agg(F.max_by("hash", "ord").alias("status"), F.max("ord").alias("at"))
    edits = log.where("op = 'edit'").groupBy("session").agg(F.max("ord").alias("edit"))
    return last.join(edits, "session", "left").select("session", "status", F.coalesce(F.col("edit") > F.col("at"), F.lit(False)).alias("edited"))


def checkpoint_diff(saved: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) between a saved and a present (path, hash)."""
    rows = saved.select("path", F.col("hash").alias("h0")).join(now.select("path", F.col("hash").alias("h1")), "path", "full_outer")
    return rows.select("path", F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified").alias("change")).where("change IS NOT NULL")
