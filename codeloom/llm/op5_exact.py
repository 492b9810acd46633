"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

Texts are equal when identical after deleting the white space `[\\x20\\x09-\\x0D]`; null counts as empty, so null, empty
and blank texts are equal. Of equal texts the row with the most code points in the original text, then the smallest
doc_id (null last), stays; of rows that repeat both, `keep_first` leaves one. Texts are hashed whole, however long. `exact_dedup`
shuffles digests, lengths and ids only; `keep_first` returns whole rows and joins them once with the groups of two rows
or more, which Spark broadcasts where they are few. An empty table gives an empty index and no rows; other columns are not read.

Every append carries the name of its batch. A batch that runs again after a failure finds its own digests in the index and treats
them as new, so nothing is lost or entered twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, read, scratch, survivors, written


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    text = F.coalesce(text, F.lit(""))
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.sha2(text.cast("binary"), 256)


class DigestIndex:
    """A table of (digest, keep_id, n_points, group_size, batch), bucketed and sorted by digest.

    Each batch is appended after a sort-merge anti-join: both sides are laid out by digest, the index without a shuffle."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, path: str | None = None, id_type: str = "bigint"):
        """name: a table of the catalog; path: where its files lie, so that a later session finds them again; id_type: that of doc_id."""
        self.spark, self.name, self.buckets = spark, name, buckets
        at = f" LOCATION '{path}'" if path else ""
        columns = f"digest string, keep_id {id_type}, n_points bigint, group_size bigint, batch string"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS{at}")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    @staticmethod
    def groups(rows: DataFrame) -> DataFrame:
        """One row a digest: the row of the batch that stays, how many rows it stands for, and how many of them are equal to it in
        length and id. Counted before each shuffle, so a hot digest is a few rows."""
        counted = rows.groupBy("digest", "n_points", "doc_id").agg(F.count("*").alias("n"))
        best = F.min(F.struct((-F.col("n_points")).alias("longest"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("n").alias("ties"))).alias("best")
        g = counted.groupBy("digest").agg(best, F.sum("n").alias("group_size"))
        return g.select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.longest")).alias("n_points"), "group_size", F.col("best.ties").alias("ties"))

    def new(self, groups: DataFrame, batch: str) -> DataFrame:
        """Groups whose digest no other batch has entered: a sort-merge anti-join in which the index is neither shuffled nor sorted."""
        return groups.join(self.table().where(F.col("batch") != batch).select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """Add the groups of a batch that the index lacks: none, where an earlier run of the batch has added them."""
        rows = fresh.join(self.table().where(F.col("batch") == batch).select("digest").hint("merge"), "digest", "left_anti")
        rows = rows.select("digest", "keep_id", "n_points", "group_size", F.lit(batch).alias("batch")).repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def keepers(self, groups: DataFrame) -> DataFrame:
        """(digest, keep_id) of the index for each of the groups; one row a digest on both sides."""
        return groups.select("digest", "group_size").join(self.table().select("digest", "keep_id").hint("merge"), "digest")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


@contextmanager
def _index(docs: DataFrame, index: DigestIndex | None) -> Iterator[DigestIndex]:
    """The index given, or one that lasts as long as the work."""
    if index is not None:
        yield index
        return
    index = DigestIndex(docs.sparkSession, f"digests_{uuid.uuid4().hex}", id_type=dict(docs.dtypes)["doc_id"])
    try:
        yield index
    finally:
        index.drop()


def points() -> Column:
    return F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_points")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size (rows of docs), kept, text_sha256. Without an index, a new one is made.

    With an index that already has a text, the row kept then stays and all copies in docs go. Rows that repeat both
    doc_id and text are marked alike; `keep_first` leaves one of them. Each text is hashed once; the join of rows and
    keepers shuffles both sides, so that Spark can split a hot digest."""
    batch = batch or uuid.uuid4().hex
    with scratch(docs.sparkSession), _index(docs, index) as index:
        rows = written(docs.select("doc_id", points(), digest(F.col("text")).alias("digest")), "digests", keep=True)
        groups = written(index.groups(rows), "groups")
        index.append(written(index.new(groups, batch), "new"), batch)
        keepers = written(index.keepers(groups), "keepers", keep=True)
    joined = rows.join(keepers, "digest")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """docs without copies and without texts that the index has, all columns as they were.

    batch: a name that a rerun of the same docs gives again. Ids and digests decide which rows stay; rows are read again for the result."""
    batch = batch or uuid.uuid4().hex
    with scratch(docs.sparkSession), _index(docs, index) as index:
        groups = written(index.groups(docs.select("doc_id", points(), digest(F.col("text")).alias("digest"))), "groups")
        fresh = written(index.new(groups, batch), "new")
        best = F.struct(F.col("n_points"), F.col("keep_id").alias("doc_id")).alias("best")
        copies = fresh.where("group_size > 1").select(F.col("digest").alias("key"), best, "ties")
        known = groups.join(fresh.select("digest"), "digest", "left_anti").select(F.col("digest").alias("key"), F.lit(None).cast(copies.schema["best"].dataType).alias("best"), F.lit(1).cast("long").alias("ties"))
        decided = written(copies.union(known), "decided", keep=True)
        index.append(fresh, batch)
    return survivors(docs, digest(F.col("text")), F.struct(points(), F.col("doc_id")), decided)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r
"""
