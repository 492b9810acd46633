"""Source files made from the test table documents, alike in Spark and in DuckDB SQL.

A template of code is one file a document: names that the template marks get a tag of the document (its number and first word), and as
many empty lines as its number modulo five stand before it. What an operator must find is told by the template's own rows, which SQL
tags and moves in the same way; the operator sees nothing but the files."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.adapters import table

#: doc_id, its tag, its folder, how far lines move: one row a document.
DOCS = "docs AS (SELECT doc_id, '_' || CAST(doc_id AS VARCHAR) || '_' || regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS tag, source || '/' || lang || '/' AS dir, doc_id % 5 AS shift FROM documents)"


def docs(s: SparkSession, d: str) -> DataFrame:
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)
    tag = F.concat(F.lit("_"), F.col("doc_id").cast("string"), F.lit("_"), word)
    return table(s, d, "documents").select("doc_id", tag.alias("tag"), F.concat("source", F.lit("/"), "lang", F.lit("/")).alias("dir"), (F.col("doc_id") % 5).alias("shift"))


def _parts(text: str, names: list[str]) -> list[str]:
    """text cut behind each marked name, where the tag goes."""
    return re.sub(rf"(?<![A-Za-z0-9_])({'|'.join(map(re.escape, names))})(?![A-Za-z0-9_])", "\\1\0", text).split("\0") if names else [text]


def tagged(text: str, names: list[str]) -> Column:
    """text with the document's tag behind each of the names."""
    parts = _parts(text, names)
    return F.concat(*(x for p in parts[:-1] for x in (F.lit(p), F.col("tag"))), F.lit(parts[-1]))


def tagged_sql(text: str | None, names: list[str]) -> str:
    if text is None:
        return "NULL"
    quoted = [f"'{p}'" for p in (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in _parts(text, names))]
    return " || tag || ".join(quoted)


def sources(s: SparkSession, d: str, files: list[tuple[str, str]], names: list[str], moved: bool = True) -> DataFrame:
    """(path, content binary): for each document the given (file name, code); file names get the tag too, before their extension."""
    made = [F.struct(F.concat("dir", tagged(p, names)).alias("path"), tagged(c, names).alias("code")) for p, c in files]
    rows = docs(s, d).select("dir", "tag", "shift", F.explode(F.array(*made)).alias("f"))
    lead = F.repeat(F.lit("\n"), F.col("shift").cast("int")) if moved else F.lit("")
    return rows.select(F.col("f.path").alias("path"), F.encode(F.concat(lead, F.col("f.code")), "UTF-8").alias("content"))


def rows(s: SparkSession, d: str, values: list[tuple], schema: str, names: list[str]) -> DataFrame:
    """The rows, once a document, with their texts tagged."""
    kinds = [x.rsplit(" ", 1) for x in re.split(r", *", schema)]
    cell = lambda v, kind: F.lit(None).cast(kind) if v is None else tagged(v, names) if kind == "string" else F.lit(v).cast(kind)
    made = [F.struct(*(cell(v, kind).alias(n) for v, (n, kind) in zip(r, kinds, strict=True))) for r in values]
    return docs(s, d).select("doc_id", "dir", "tag", "shift", F.inline(F.array(*made)))


def answer(columns: str, values: list[tuple], names: list[str], moved: tuple[str, ...] = ("start_line", "end_line"), prefix: tuple[str, ...] = ("path",)) -> str:
    """SQL of the rows, once a document: texts tagged, columns of `moved` moved, columns of `prefix` put into the document's folder."""
    heads = [c.strip() for c in columns.split(",")]

    def cell(v, c: str) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return ("dir || " if c in prefix else "") + tagged_sql(v, names)
        return f"CAST({v} + {'shift' if c in moved else 0} AS INTEGER)"

    return f"WITH {DOCS} " + " UNION ALL ".join("SELECT " + ", ".join(f'{cell(v, c)} AS "{c}"' for v, c in zip(r, heads, strict=True)) + " FROM docs" for r in values)


Query = Callable[[SparkSession, str], DataFrame]
