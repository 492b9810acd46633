import hashlib
from collections import Counter

import duckdb
import pytest

from codeloom.llm import op7_sharding as op


def brute(shards, slots):
    """Turns by explicit permutations."""
    half = lambda s, salt: int(hashlib.sha256(f"{salt}:{s}".encode()).hexdigest()[:15], 16)
    order = {s: [(half(s, "offset") % slots + j * (half(s, "step") % (slots - 1) + 1)) % slots for j in range(slots)] for s in shards}
    table, at = {}, dict.fromkeys(shards, 0)
    while len(table) < slots:
        for i, s in enumerate(shards):
            while at[s] < slots and order[s][at[s]] in table:
                at[s] += 1
            if at[s] < slots:
                table[order[s][at[s]]] = i
    return [table[k] for k in range(slots)]


def test_fill_equals_brute_force_and_is_even():
    for n, slots in ((1, 2), (3, 7), (5, 5), (7, 251), (64, 1009)):
        shards = [f"s{i}" for i in range(n)]
        got = op.fill(shards, slots)
        assert got == brute(shards, slots)
        assert max(Counter(got).values()) - min(Counter(got).values()) <= 1
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            op.fill(*bad)


def test_few_slots_move_when_a_shard_goes():
    a = op.fill(op.SHARDS, op.SLOTS)
    b = op.fill(op.SHARDS[:-1], op.SLOTS)
    stay = [(x, y) for x, y in zip(a, b, strict=True) if x != len(op.SHARDS) - 1]
    assert sum(x != y for x, y in stay) / len(stay) < 0.1


def test_documents(spark):
    rows = [(1, "a"), (2, None), (3, ""), (None, "a"), (4, "x" * 50_000), (1, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS slot", "2 AS shard", "3 AS key")
    owner = brute(op.SHARDS[:5], 251)
    got = sorted(map(tuple, op.shard_documents(df, op.SHARDS[:5], 251).collect()), key=str)
    at = lambda t: int(hashlib.sha256((t or "").encode()).hexdigest()[:15], 16) % 251
    assert got == sorted([(i, at(t), op.SHARDS[owner[at(t)]]) for i, t in rows], key=str)
    assert op.shard_documents(df.where("false")).count() == 0
    plan = op.shard_documents(df)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan.split("Physical Plan")[1].split("Scan")[0]


def test_sql_gives_the_same(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(map(tuple, op.op7_lookup_sharding(spark, d).collect())) == sorted(con.sql(op.sql()).select("doc_id, slot, shard").fetchall())
