"""The index as Parquet tables under one folder: files, postings, symbols, edges, refs.

Each build writes a new version and then appends its manifest, in one commit of Spark's writer; readers take the newest
manifest, so they see one whole version or another. Postings are laid out by trigram, so that a look-up reads few row
groups; other tables are separate, so that a reader of symbols never touches postings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import text
from codeloom.streaming.incremental import patched, snapshot_diff

MANIFEST = "version bigint, folder string, n_files bigint, n_postings bigint, n_symbols bigint"
#: The column by which rows of each table belong to a file, and that by which the table is laid out.
TABLES = {"files": ("path", "path"), "postings": ("path", "tri"), "symbols": ("path", "name"), "edges": ("importer", "imported"), "refs": ("path", "name_lc"), "popularity": ("sym_id", "sym_id"), "decls": ("path", "name"), "bound": ("path", "path")}


class IndexStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def manifest(self) -> DataFrame:
        """One row: the newest manifest; none before the first build."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifests")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.folder}/manifests").orderBy(F.desc("version")).limit(1)

    def table(self, name: str) -> DataFrame:
        row = self.manifest().first()
        if row is None:
            raise ValueError(f"no index in {self.folder}")
        return self.spark.read.parquet(f"{row.folder}/{name}")

    def write(self, tables: dict[str, DataFrame]) -> None:
        """A new version from whole tables."""
        folder = f"{self.folder}/version-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.repartitionByRange(TABLES[name][1]).sortWithinPartitions(TABLES[name][1]).write.parquet(f"{folder}/{name}")
        count = lambda n: self.spark.read.parquet(f"{folder}/{n}").count() if n in tables else 0
        last = self.manifest().first()
        row = ((last.version if last else 0) + 1, folder, count("files"), count("postings"), count("symbols"))
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{self.folder}/manifests")

    def build(self, files: DataFrame, symbols: DataFrame | None = None, edges: DataFrame | None = None, refs: DataFrame | None = None, **more: DataFrame) -> None:
        """files: path, content, and what else describes them (size, mtime_ns). more: popularity, decls, bound."""
        given = {"symbols": symbols, "edges": edges, "refs": refs, **more}
        self.write({"files": files.drop("content"), "postings": text.postings(files)} | {k: v for k, v in given.items() if v is not None})

    def patch(self, changes: DataFrame, files: DataFrame, symbols: DataFrame | None = None) -> None:
        """A new version after changes(path, change): postings, file rows and (where the index has them) symbols of changed files anew, all
        others as they are. Tables that depend on more than a file (edges, refs, popularity) are left to the next build."""
        new_rows = {"files": files.drop("content"), "postings": text.postings(files)} | ({"symbols": symbols} if symbols is not None else {})
        self.write({k: patched(self.table(k), changes, v) for k, v in new_rows.items()})

    def tick(self, now: DataFrame, symbols: DataFrame | None = None) -> bool:
        """Bring the index up to files now (path, content, mtime_ns, size): nothing if none differs, else a patch. Tells whether it wrote."""
        changes = snapshot_diff(self.table("files"), now)
        if changes.isEmpty():
            return False
        self.patch(changes, now, symbols)
        return True

    def complete(self, now: DataFrame) -> bool:
        """Whether the index is that of files now."""
        return snapshot_diff(self.table("files"), now).isEmpty()

    def status(self, now: DataFrame | None = None) -> DataFrame:
        """One row: files, trigrams, and whether the files given now differ."""
        sums = self.table("postings").agg(F.count_distinct("tri").alias("n_trigrams"))
        out = self.manifest().select("version", "n_files").join(sums, F.lit(True))
        if now is None:
            return out
        stale = now.join(self.table("files"), ["path", "size"], "left_anti").isEmpty() and self.table("files").join(now, ["path", "size"], "left_anti").isEmpty()
        return out.withColumn("stale", F.lit(not stale))
