import random

import corpus_pipeline
from codeloom.llm import op6_packing, op9_secrets
from tests.llm.test_near import brute as near_classes
from tests.llm.test_rules import brute_kept


def _rows():
    rng = random.Random(21)
    common = "the of and to in a is that for it was on".split()
    text = lambda n: [rng.choice(common) if rng.random() < 0.45 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(n)]
    rows = []
    for k in range(40):
        w = text(rng.randint(60, 200))
        rows.append(" ".join(w))
        if k % 4 == 0:
            rows.append("\n".join(w) + " ")  # equal but for white space
        if k % 5 == 0:
            w[len(w) // 2] = "changed"
            rows.append(" ".join(w))
        if k % 6 == 0:
            rows.append(" ".join(text(90)) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + " ".join(text(20)))
    rows += ["short text", "", None, " | ".join(text(80)), " ".join(text(80)).upper() + "!!"]
    return [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(rows)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now, docs = {r[0]: r[1] for r in rows}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == df.columns, name
            out.write.parquet(str(tmp_path / f"s{k}"))
            docs = spark.read.parquet(str(tmp_path / f"s{k}"))
            got = {r.doc_id: r.text for r in docs.collect()}
        if k == 0:
            ids = list(now)
            now = {i: now[i] for i, v in zip(ids, brute_kept([now[i] for i in ids]), strict=True) if v[3]}
        elif k == 1:
            best = {}
            for i, t in now.items():
                best.setdefault("".join(t.split()), []).append((-len(t), i))
            now = {min(v)[1]: now[min(v)[1]] for v in best.values()}
        elif k == 2:
            ids = sorted(now)
            roots, _ = near_classes([(i, now[i]) for i in ids])
            now = {ids[r]: now[ids[r]] for r in set(roots)}
        elif k == 3:
            net = op9_secrets.trained()
            now = {i: op9_secrets.masked(t, op9_secrets.find([t], net)[0]) for i, t in now.items()}
            assert any(op9_secrets.MASK in t for t in now.values())
        if k < 4:
            assert got == now, name
    ids = {i: len(op6_packing.words(op6_packing.VOCABULARY).encode(t)) // 4 + 1 for i, t in now.items()}
    packed = out.collect()
    size = {}
    for r in packed:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == ids
    whole = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert whole == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)
