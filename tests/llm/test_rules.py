import math
import random
import re

from codeloom.llm import op10_rules as op

WS = " \t\n\x0b\x0c\r"


def brute_counts(text):
    t = text or ""
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
    lines = [x for x in t.split("\n") if any(c not in WS for c in x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def brute_kept(rows):
    """Verdicts of all texts by the definition: histograms, mean references, Jensen-Shannon distances."""
    hist = []
    for t in rows:
        t = t or ""
        words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", t) if w]
        c = [0] * 7
        for ch in t:
            k = 0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch in WS else 4 if ch in ".,;:!?'\"()-" else 5 if ch in "#*$%&|<>" else 6
            c[k] += 1
        w = [sum(x == y for x in words) for y in op.COMMON]
        w.append(max(0, len(words) - sum(w)))
        score = {g: sum(w[op.COMMON.index(x)] for x in ws) for g, ws in op.FUNCTION_WORDS.items()}
        best = max(score.values())
        hist.append((len(words), c, w, next(g for g, s in score.items() if s == best) if best else "none"))
    share = lambda x: [v / max(1, sum(x)) for v in x]
    smooth = lambda x: [(v / sum(x) + op.SMOOTH) / sum(u / sum(x) + op.SMOOTH for u in x) for v in x]
    refs = {}
    for g, ws in op.FUNCTION_WORDS.items():
        total = sum(1 / k for k in range(1, len(ws) + 1))
        common = [0.3 / (ws.index(w) + 1) / total if w in ws else 0.0 for w in op.COMMON] + [0.7]
        refs[g] = smooth(op.PROSE[g]), smooth(common)
    refs["all"] = tuple(smooth([sum(r[k][i] for r in refs.values()) for i in range(len(refs["en"][k]))]) for k in (0, 1))

    def distance(x, q):
        p, js = share(x), 0.0
        for a, b in zip(p, q, strict=True):
            m = (a + b) / 2
            js += (a * math.log2(a / m) if a else 0) + b * math.log2(b / m)
        return math.sqrt(max(0.0, js / 2))

    out = []
    for t, (n, c, w, g) in zip(rows, hist, strict=True):
        group = g if g in op.FUNCTION_WORDS else "all"
        failed = n < 50 or 100 * brute_counts(t)[4] > 50 * n
        a, b = distance(c, refs[group][0]), distance(w, refs[group][1])
        out.append((failed, a, b, not failed and (n < op.MIN_WORDS_CLASSES or a <= op.MAX_CLASSES) and (n < op.MIN_WORDS_COMMON or b <= op.MAX_COMMON)))
    return out


def _texts():
    rng = random.Random(6)
    en, fr = op.FUNCTION_WORDS["en"], op.FUNCTION_WORDS["fr"]
    made = lambda pool, n, sep=" ": sep.join(rng.choice(pool) if rng.random() < 0.5 else "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(n))
    out = [made(rng.choice([en, fr]), rng.randint(1, 250)) for _ in range(70)]
    out += [made(en, 120, " | "), made(en, 90).upper(), made(fr, 80, "*** "), "same words here " * 60, "line one\nline two\nline one\n \n\n line one", "  lead\ttabs\x0b\x0cand\r\nends  ", "a b a b a b a", "x y", "", None, "é " * 30_000, "abc \x85", "abc \u2028", "abc \u2029", "\u2028 abc", "a " * 60 + "\u2028", "a b c d " * 12 + "x \x85", "12 34 56, 78! " * 9]
    return [*out, out[0], out[0]]


def test_equals_brute_force(spark):
    texts = _texts()
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS words", "2 AS kept", "'s' AS spoken")
    got = {r.doc_id: r for r in op.quality_rules(df).collect()}
    verdict = brute_kept(texts)
    for (i, t), (failed, a, b, kept) in zip(rows, verdict, strict=True):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t), repr((t or "")[:60])
        assert r.base_failed == failed and abs(r.js_classes - a) < 1e-9 and abs(r.js_common - b) < 1e-9 and r.kept == kept
    good = op.keep_good(df)
    assert good.columns == df.columns and good.count() == sum(v[3] for v in verdict)
    assert op.quality_rules(df.where("false")).count() == 0 and op.keep_good(df.where("false")).count() == 0


def test_wide_form_equals_packed_form(spark):
    from pyspark.sql import functions as F

    saved, op.POSITION_BITS = op.POSITION_BITS, 3  # texts of seven words or more take the wider form
    try:
        df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts()[:70])] + [(99, "a b a b a b a b a")], "doc_id bigint, text string")
        for r in df.select("text", op._repeated(op._words(F.col("text"))).alias("n")).collect():
            assert r.n == brute_counts(r.text)[4]
    finally:
        op.POSITION_BITS = saved


def test_colliding_windows_take_the_wider_form(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op.F, "xxhash64", lambda *c: F.length(c[0].cast("string")).cast("long") * 0)  # one hash for all windows
    texts = ["a b c x a b d y a b c", "p q r s t u v", "a b c a b c a b c", "m n o k m n o l m n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", op._repeated(op._words(F.col("text"))).alias("n")).collect():
        assert r.n == brute_counts(r.text)[4]


def test_learned_references_move_little_and_do_not_depend_on_junk(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = op.references(df)
    b = op.references(df.union(df.limit(1).selectExpr("doc_id", "repeat('JUNK ', 9999) AS text", "lang", "source", "n_chars")))
    assert a == b and set(a) == {*op.FUNCTION_WORDS, "all"}
    assert op.references(df.where("false")).keys() == a.keys()


def test_verdict_does_not_depend_on_other_rows(spark):
    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(d + "/documents.parquet")
    whole = {tuple(r) for r in op.quality_rules(df).collect()}
    assert {tuple(r) for r in op.quality_rules(df.where("doc_id < 20")).collect()} <= whole


def test_sql_gives_the_same(spark):
    from tests.oracle import differences

    assert differences(spark, "/root/testdata/sf0.001", op.op10_quality_rules, op.sql()) == ""


def test_real_table_keeps_good_and_drops_bad(spark):
    d = "/root/testdata/sf0.01"
    got = op.op10_quality_rules(spark, d).join(spark.read.parquet(d + "/labels.parquet"), "doc_id").toPandas()
    fair = got[~got.base_failed]
    assert fair[fair.quality == 1].kept.mean() >= 0.98
    assert got[got.quality == 0].kept.mean() <= 0.05
