"""What the operators of this subpackage share: written tables, batches of bounded size, the rows that stay of groups of copies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import let
from codeloom import scratch as _tables
from codeloom.scratch import delete, scratch, shared_folder

__all__ = ["WHITE", "batches_of", "delete", "exists", "let", "map_batches", "read", "scratch", "shared_folder", "small_batches", "survivors", "written"]

#: The white space of the contracts, `[\x20\x09-\x0D]`, one character each.
WHITE = " \t\n\x0b\x0c\r"
#: Rows and bytes that an operator works on at once; one row is never split. Shingling takes some thirty bytes for each byte of text.
BATCH_ROWS, BATCH_BYTES = 512, 2 << 20


#: Bytes that the JVM puts into one Arrow batch while operators run: such batches lie beside the heap.
JVM_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small Arrow batches for what runs inside; the session's own setting is back at the end."""
    (key, most), before = JVM_BATCH, spark.conf.get(JVM_BATCH[0])
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`scratch.written` with small Arrow batches."""
    with small_batches(df.sparkSession):
        return _tables.written(df, name, keep)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spark's batches (bounded by its own settings) in slices of BATCH_ROWS rows and about BATCH_BYTES at most."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, int(batch.num_rows * BATCH_BYTES / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with one state a task: make() gives the function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches_of(batches):
            yield f(batch)

    return df.mapInArrow(run, schema)


def survivors(docs: DataFrame, key: Column, me: Column, groups: DataFrame) -> DataFrame:
    """docs, all columns as they were, without the copies that groups (key, best, ties) name. A row whose key is in no group stays;
    others stay if `me` equals the group's best, and where `ties` rows do, one of them. Only groups of two rows or more need be
    given. Groups grow with the table, so the join is by sorting at any size: rows are shuffled once, Spark splits a hot key, and no text
    is written."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), key.alias("key"), me.alias("me"))
    one = groups.where("ties < 2 OR ties IS NULL").select("key", "best", F.lit(True).alias("met")).union(groups.where("ties > 1").select("key", F.lit(None).cast(groups.schema["best"].dataType), F.lit(True)))
    same = F.coalesce(F.col("best").isNotNull() & F.col("me").eqNullSafe(F.col("best")), F.lit(False))
    out = rows.join(one.hint("merge"), "key", "left").where(F.col("met").isNull() | same).select("row.*")
    tied = groups.where("ties > 1").select("key", "best")
    if tied.isEmpty():
        return out
    return out.union(rows.join(tied, "key").where(F.col("me").eqNullSafe(F.col("best"))).groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
