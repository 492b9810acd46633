import random

from codeloom.operators import text as T
from codeloom.scratch import scratch, written


def test_scan_and_index_agree_on_any_text(spark):
    rng = random.Random(5)
    parts = ["kelvin", "Kelvin", "KELVIN", "Straße", "STRASSE", "İstanbul", "ıs", "é", "É", " ", "\n", "abc", "ABC", "ﬁ", "fi", "\u0000", "x|y", "(", "ſecret", "secret"]
    rows = [(f"f{i}", "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(300)] + [("f900", "2 Kelvin"), ("f901", "")]
    df = spark.createDataFrame(rows, "path string, content string").cache()
    postings = T.postings(df).cache()
    for pattern in ("kelvin", "Kelvin", "KELVIN", "straße", "strasse", "istanbul", "é", "secret", "abcabc", "ﬁ", "fi", "Kelvin"):
        scan = [r.path for r in T.find_files(df, pattern).collect()]
        assert scan == [r.path for r in T.find_files(df, pattern, postings_=postings).collect()], pattern
        low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
        exact = any("A" <= c <= "Z" for c in pattern)
        assert scan == sorted(p for p, t in rows if (pattern in t if exact else pattern in low(t))), pattern


def test_written_tables_go_with_their_scope(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("codeloom.scratch.shared_folder", lambda s: str(tmp_path))
    with scratch(spark):
        a = written(spark.range(5), "a")
        with scratch(spark):
            b, c = written(a, "b"), written(a, "c", keep=True)
            assert b.count() == 5
        assert sorted(p.name[0] for p in tmp_path.iterdir()) == ["a", "c"] and c.count() == 5
    assert list(tmp_path.iterdir()) == []
    try:
        with scratch(spark):
            written(spark.range(1), "d")
            raise ValueError
    except ValueError:
        assert list(tmp_path.iterdir()) == []
