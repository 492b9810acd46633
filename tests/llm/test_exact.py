import hashlib
import random
import uuid

import duckdb

from codeloom.llm import op5_exact as op


def _rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["a b", "ab", " a\tb\n", "", None, "  ", "x" * 20_000, f"u{i % 9}", "é b", "éb"])) for i in range(200)]
    return [*rows, (3, "twice"), (3, "twice"), (None, "nobody"), (None, "ab")]


def test_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'q' AS digest", "1 AS n_points", "2 AS tag", "3 AS `row`")
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), i is None, i))
    want = []
    for i, t in rows:
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        keep = min(groups[norm])[2]
        want.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    assert sorted(map(tuple, op.exact_dedup(df).collect()), key=str) == sorted(want, key=str)
    kept = op.keep_first(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == len(groups)
    for r in got:
        norm = "".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")
        assert (-len(r.text or ""), r.doc_id is None, r.doc_id) == min(groups[norm])
    assert op.exact_dedup(df.where("false")).count() == 0
    assert op.keep_first(df.where("false")).count() == 0


def test_index_grows_by_batches(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    index = op.DigestIndex(spark, name, buckets=4, path=str(tmp_path / "index"))
    a = spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a   b"), (2, "d"), (3, "d ")], "doc_id bigint, text string")
    assert {r.doc_id for r in op.keep_first(a, index).collect()} == {5, 6}
    again = op.DigestIndex(spark, name, buckets=4)
    assert [(r.doc_id, r.keep_id, r.kept) for r in op.exact_dedup(b, again).orderBy("doc_id").collect()] == [(1, 5, False), (2, 3, False), (3, 3, True)]
    assert {r.keep_id for r in again.table().collect()} == {3, 5, 6}
    plan = again.new(again.groups(b.select("doc_id", op.points(), op.digest(b.text).alias("digest"))), "batch")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_a_batch_that_runs_again_loses_nothing(spark, tmp_path):
    index = op.DigestIndex(spark, f"t_{uuid.uuid4().hex}", buckets=4, path=str(tmp_path / "index"), id_type="string")
    a = spark.createDataFrame([("x", "a b"), ("y", "c"), ("z", "ab"), ("z", "ab")], "doc_id string, text string")
    b = spark.createDataFrame([("u", "c"), ("v", "d")], "doc_id string, text string")
    first = sorted(map(tuple, op.keep_first(a, index, "one").collect()))
    assert first == [("x", "a b"), ("y", "c")]
    assert sorted(map(tuple, op.keep_first(a, index, "one").collect())) == first and index.table().count() == 2
    assert [r.doc_id for r in op.keep_first(b, index, "two").collect()] == ["v"]
    assert op.keep_first(a, index, "three").count() == 0


def test_only_ids_stay_behind(spark, tmp_path, monkeypatch):
    rows = [(i, "some words that are here " + str(i % 7)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = {t.name for t in spark.catalog.listTables()}
    monkeypatch.setattr("codeloom.scratch.shared_folder", lambda s: str(tmp_path))
    assert op.keep_first(docs).count() == 7
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["decided"]
    assert {t.name for t in spark.catalog.listTables()} == before


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = sorted(con.sql(op.SQL).select("doc_id, keep_id, group_size, kept, text_sha256").fetchall())
    assert sorted(map(tuple, op.op5_exact_dedup(spark, d).collect())) == want
