import zlib

import numpy as np

from codeloom.llm import op1_quality as op


def test_scores_equal_brute_force_and_hold_out(spark):
    d = "/root/testdata/sf0.01"
    got = op.op1_quality_classifier(spark, d).toPandas().set_index("doc_id")
    docs = spark.read.parquet(d + "/documents.parquet").toPandas().set_index("doc_id")
    labels = spark.read.parquet(d + "/labels.parquet").toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    x = np.array([op.statistics(t) for t in docs.text])
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in docs.index])
    assert (got.held_out.loc[docs.index].to_numpy() == out).all()
    learn = [i for i in labels.index if zlib.crc32(str(i).encode()) % 5 and i in docs.index]
    at = {i: k for k, i in enumerate(docs.index)}
    xs, ys = x[[at[i] for i in learn]], labels.quality.loc[learn].to_numpy()
    m, s = xs.mean(0), np.maximum(xs.std(0), 1e-3)
    z = np.clip((xs - m) / s, -op.LIMIT, op.LIMIT)
    cov = [np.cov(z[ys == c].T, bias=True) for c in (0, 1)]
    shared = sum((ys == c).sum() * cov[c] for c in (0, 1)) / len(ys)
    zs, dens = np.clip((x - m) / s, -op.LIMIT, op.LIMIT), []
    for c in (0, 1):
        k = (1 - op.POOLED) * cov[c] + op.POOLED * shared
        k = (1 - op.UNIT) * k + op.UNIT * np.trace(k) / len(k) * np.eye(len(k)) + 1e-9 * np.eye(len(k))
        e = zs - z[ys == c].mean(0)
        dens.append(-0.5 * np.einsum("ij,jk,ik->i", e, np.linalg.inv(k), e) - 0.5 * np.linalg.slogdet(k)[1])
    odds = dens[1] - dens[0] + np.log(((ys == 1).sum() + 0.5) / ((ys == 0).sum() + 0.5))
    want = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
    assert np.allclose(got.score.loc[docs.index], want, atol=1e-6)
    test = [i for i in labels.index if i in docs.index and zlib.crc32(str(i).encode()) % 5 == 0]
    right = got.predicted.loc[test].to_numpy() == labels.quality.loc[test].to_numpy()
    assert right.mean() >= 0.95, right.mean()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "a " * 30_000), (3, "a " * 30_000)], "doc_id bigint, text string").selectExpr("*", "1 AS x", "2 AS quality", "3 AS score")
    labels = spark.createDataFrame([(1, 0), (2, 1), (9, 1), (3, None)], "doc_id bigint, quality int")
    got = op.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert op.classify(docs.where("false"), labels).count() == 0
    assert op.classify(docs, labels.where("false")).count() == 5
