import random
from collections import Counter
from itertools import combinations

import numpy as np

from codeloom.llm import op8_near as op


def brute(rows):
    """Classes by all pairs, shingles as word tuples."""
    docs = []
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ")
        w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        docs.append(Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []))
    df = Counter(s for d in docs for s in d)
    n = len(rows)
    idf = {s: 1 + np.log(min(max(n / k, 1), op.RARE)) / np.log(op.RARE) for s, k in df.items()}
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sims = {}
    for a, b in combinations(range(n), 2):
        same = (rows[a][1] or "") == (rows[b][1] or "")
        lo = sum(min(docs[a][s], docs[b][s]) * idf[s] for s in docs[a].keys() & docs[b].keys())
        hi = sum(max(docs[a][s], docs[b][s]) * idf[s] for s in docs[a].keys() | docs[b].keys())
        sims[a, b] = lo / hi if hi else 0.0
        if same or (hi and lo / hi >= op.SIMILAR):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)], sims


def _rows():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120, 200]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3, rng.choice([" ", "\n", "  "]).join(w)))
    core = [rng.choice(vocabulary) for _ in range(150)]  # copies that are like the core but not like each other
    for _ in range(40):
        w = list(core)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((len(rows) * 3, " ".join(w)))
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [(1000 + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(20)]
    return [*rows, (1, None), (2, ""), (4, "A b"), (5, "a B"), (7, "twice told tale of old times"), (7, "twice told tale of old times"), (None, "z " * 3000)]


def test_equals_brute_force(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS tag", "2 AS label", "'x' AS `row`")
    want, _ = brute(rows)
    got = op.tagged_classes(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.label, []).append(r.doc_id)
    names = {}
    for (i, _), w in zip(rows, want, strict=True):
        names.setdefault(w, []).append(i)
    assert sorted(map(lambda x: sorted(x, key=str), by.values()), key=str) == sorted(map(lambda x: sorted(x, key=str), names.values()), key=str)
    kept = op.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(names)
    out = op.classes(df).collect()
    assert len(out) == len(rows) and sum(r.class_size for r in out if r.kept) >= len(rows) - 1
    assert op.classes(df.where("false")).count() == 0


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.choice(1 << 31, 900, replace=False).astype(np.uint32)
    wa, wb = rng.uniform(1, 4, 900), rng.uniform(1, 4, 900)
    wb = np.where(rng.random(900) < 0.8, wa, wb)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    order = np.argsort(a)
    hits = []
    saved = op.BANDS, op.ROWS
    op.BANDS, op.ROWS = 2000, 1
    try:
        x = op.bands(np.zeros(900, np.int64), a[order], wa[order], 1)
        y = op.bands(np.zeros(900, np.int64), a[order], wb[order], 1)
        hits = (x == y).mean()
    finally:
        op.BANDS, op.ROWS = saved
    assert abs(hits - want) < 0.04


def test_frequent_shingles_are_counted_exactly(spark):
    rng = random.Random(3)
    line = "this line is in very many texts"
    rows = [(i, (line + " " if i % 3 else "") + " ".join(rng.choice("abcdefgh") * 3 for _ in range(20))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    frequent, n = op.frequencies(df)
    assert n == 600
    _, h, _ = op.counted(*op.shingles([line]))
    for x in h:
        assert abs(frequent.weights(np.array([x]), np.array([1]))[0] - (1 + np.log(600 / 400) / np.log(op.RARE))) < 1e-9
