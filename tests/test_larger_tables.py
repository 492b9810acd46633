"""What larger tables have and the small ones do not: first words that look like a rule's own, repeated pages, names that very many call."""

import os

import duckdb
import pytest

from codeloom.operators import symbols as Y
from codeloom.plans import catalog
from codeloom.scratch import shared_folder
from tests.oracle import differences


@pytest.mark.parametrize("name", ["sy38", "ov10"])
def test_a_document_that_begins_with_test(spark, tmp_path, name):
    duckdb.sql("SELECT * FROM (VALUES (1, 'Test of all', 'en', 'web', 11), (2, 'test', 'en', 'web', 4), (3, 'mock', 'en', 'web', 4), (4, 'One', 'en', 'web', 3)) t(doc_id, text, lang, source, n_chars)").write_parquet(str(tmp_path / "documents.parquet"))
    assert differences(spark, str(tmp_path), catalog.QUERIES[name], catalog.SQL[name]) == ""


def test_links_of_a_page_that_stands_twice(spark, tmp_path):
    duckdb.sql("""SELECT k AS page_id, 'u' AS url, '<a href="x">' AS html FROM range(2) t(k)""").write_parquet(str(tmp_path / "pages.parquet"))
    assert differences(spark, str(tmp_path), catalog.QUERIES["gr8"], catalog.SQL["gr8"]) == ""


def test_popularity_of_a_name_with_very_many_callers(spark):
    """b and c call x and import a, c imports b: 1 + log2(2) and 1, however many symbols call."""
    symbols = spark.createDataFrame([("a#1", "x", "a")], "sym_id string, name string, path string")
    refs = spark.range(60_000).selectExpr("concat('s', id) AS sym_id", "if(id % 2 = 0, 'b', 'c') AS path", "'x' AS name_lc")
    edges = spark.createDataFrame([("b", "a"), ("c", "a"), ("c", "b")], "importer string, imported string")
    assert [tuple(r) for r in Y.popularity(symbols, refs, edges).collect()] == [("a#1", 3)]


@pytest.mark.parametrize("name", ["bd39", "bd53", "rn12"])
def test_linking_leaves_nothing_but_its_result(spark, name):
    """Sources, what parsers say of them and links are as large as the table: they go when the query returns."""
    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    rows = catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    left = set(os.listdir(folder)) - before
    assert rows >= 200 and len(left) == 1 and next(iter(left)).startswith("result-")
