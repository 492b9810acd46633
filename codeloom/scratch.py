"""Tables that a query writes for itself: in the folder that driver and executors share, and gone when no longer read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the folder set for checkpoints. Only a local master may do without: a cluster's machines share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="codeloom-"))
        folder = context.getCheckpointDir().get()
    return folder.rstrip("/")


def delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with keep, which belong to the scope around this one.

    Without a scope around it, what is kept stays until the caller is done with the result: such tables hold ids and counts, no texts."""
    mine: list[str] = []
    outer = _scopes.get()
    token = _scopes.set((*outer, mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        delete(spark, mine)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files are deleted once the driver has collected the plans that made them: asked for where much was shuffled for a table now written."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if scopes and not keep:
        scopes[-1].append(path)
    elif len(scopes) > 1:
        scopes[-2].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
