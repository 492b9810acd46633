"""The engine's tables over the test tables, in Spark and in DuckDB SQL.

files: documents as source/lang/doc_id.txt. lines: their lines. symbols: each line with an identifier stands for a symbol,
named by its first identifier; kind by the name's shape; it spans a line more for each 40 characters. refs: a symbol's other
identifiers. edges: document d imports documents (7d+1) mod n and (13d+5) mod n, a device of this harness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators import text


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("text").alias("content"), "doc_id")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = text.lines(files(spark, d)).withColumn("start_byte", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).cast("long"))
    rows = rows.withColumn("name", F.regexp_extract("text", "[A-Za-z0-9_]{2,}", 0)).where("name <> ''")
    kind = F.when(F.col("name").rlike("^[A-Z0-9_]+$"), "constant").when(F.col("name").rlike("^[A-Z]"), "class").otherwise("function")
    return rows.select(
        F.concat_ws("#", "path", F.col("line").cast("string")).alias("sym_id"), "path", "name", kind.alias("kind"), F.col("line").cast("long").alias("start_line"),
        (F.col("line") + F.floor(F.length("text") / 40)).cast("long").alias("end_line"), "start_byte", (F.col("start_byte") + F.octet_length("text")).cast("long").alias("end_byte"), F.col("text").alias("body"),
    )


def refs(spark: SparkSession, d: str) -> DataFrame:
    rows = symbols(spark, d).select("sym_id", "path", F.lower("name").alias("own"), F.explode(text.identifiers(F.col("body"))).alias("token"))
    return rows.select("sym_id", "path", F.lower("token").alias("name_lc"), "own").where("name_lc <> own").drop("own").distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    docs = files(spark, d).select("doc_id", "path")
    n = docs.count()
    out = docs.select(F.col("path").alias("importer"), F.explode(F.array((F.col("doc_id") * 7 + 1) % n, (F.col("doc_id") * 13 + 5) % n)).alias("doc_id"))
    return out.join(docs.withColumnRenamed("path", "imported"), "doc_id").where("importer <> imported").select("importer", "imported").distinct()


FILES = "files AS (SELECT source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, text AS content, doc_id FROM documents)"
LINES = FILES + ", parts AS (SELECT path, string_split(content, chr(10)) AS l FROM files), lines AS (SELECT path, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM parts)"
SYMBOLS = (
    LINES
    + r""", named AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte, regexp_extract(text, '[A-Za-z0-9_]{2,}') AS name FROM lines),
symbols AS (SELECT path || '#' || CAST(line AS VARCHAR) AS sym_id, path, name, CASE WHEN regexp_matches(name, '^[A-Z0-9_]+$') THEN 'constant' WHEN regexp_matches(name, '^[A-Z]') THEN 'class' ELSE 'function' END AS kind,
line::BIGINT AS start_line, (line + length(text) // 40)::BIGINT AS end_line, start_byte, start_byte + strlen(text) AS end_byte, text AS body FROM named WHERE name <> '')"""
)
REFS = SYMBOLS + ", refs AS (SELECT DISTINCT sym_id, path, name_lc FROM (SELECT sym_id, path, lower(name) AS own, lower(unnest(regexp_extract_all(body, '[A-Za-z0-9_]{2,}'))) AS name_lc FROM symbols) WHERE name_lc <> own)"
EDGES = """n AS (SELECT count(*) AS n FROM files), hops AS (SELECT path AS importer, unnest([(doc_id * 7 + 1) % n, (doc_id * 13 + 5) % n]) AS doc_id FROM files, n),
edges AS (SELECT DISTINCT importer, f.path AS imported FROM hops JOIN files f USING (doc_id) WHERE importer <> f.path)"""
