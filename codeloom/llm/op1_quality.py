"""Quality classifier: regularised quadratic discriminant over transformed statistics of a document.

Each class has a Gaussian whose covariance is shrunk towards the pooled one and then towards a multiple of the unit
matrix; the score is the logistic of the difference of Mahalanobis log-densities, computed with Cholesky factors kept
in the model. Class moments are sums over all labelled rows that learning may see, aggregated where the rows are.

Statistics come from the whole text only. A null text counts as empty and gets a score like any other; repeated rows
get equal rows; labels without a document are unused; with fewer than two labelled rows of either class every score is
the prior's. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, written

#: Function words of the four languages.
FUNCTION_WORDS = frozenset("the of and to in a is that for it was on with are be this der die und das den von zu mit sich auf ist im dem nicht ein eine de la le les et des du que qui dans un une est pour par sur el en y los se del las por con no para".split())
NAMES = ["words", "word_length", "longest", "symbols", "upper", "digits", "marks", "white", "foreign", "distinct", "pairs", "lines", "function", "line_length", "entropy", "alone"]
#: Weights of the pooled covariance and of the unit matrix; folds of five that learning never sees; the score from which a row is predicted 1.
POOLED, UNIT, HELD_OUT, PREDICTED = 0.15, 0.05, 0, 0.3
LIMIT = 6.0


def _bytes(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


KINDS = np.stack([_bytes(b"#*$%&|<>!@^~=+\\_{}[]"), _bytes(bytes(range(65, 91))), _bytes(b"0123456789"), _bytes(b".,;:?'\"()-"), _bytes(b" \t\n\x0b\x0c\r"), _bytes(bytes(range(128, 256))), _bytes(b"|#*$%&<>")], 1)


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logarithms of sizes, logits of shares."""
    data = text.encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    total = max(1, len(data))
    symbols, upper, digits, marks, white, foreign, _ = counts @ KINDS
    p = counts[counts > 0] / total
    words = text.split()
    n = max(1, len(words))
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    alone = sum(1 for w in set(words) if not w[:1].isalnum())
    letters = max(1.0, total - white - symbols - digits - marks)
    share = lambda k, of: float(np.log((k + 0.5) / (max(of, k) - k + 0.5)))
    long = max(map(len, words), default=0)
    known = sum(map(FUNCTION_WORDS.__contains__, words))
    return [
        float(np.log1p(len(words))), float(np.log1p(len(text) / n)), float(np.log1p(long)), share(symbols, total), share(upper, letters), share(digits, total),
        share(marks, total), share(white, total), share(foreign, total), share(distinct, n), share(pairs, max(1, n - 1)),
        share(len(lines) - len(set(lines)), max(1, len(lines))), share(known, n), float(np.log1p(len(text) / max(1, len(lines)))), float(-(p * np.log(p)).sum()), share(alone, max(1, distinct)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text, written once."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t or "") for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

        return f

    return written(map_batches(docs.select("doc_id", "text"), make, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>"), "features")


@dataclass
class Model:
    """Standardisation, class means, inverse Cholesky factors of the class covariances, their log-determinants, the prior's log-odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray] | None
    factors: tuple[np.ndarray, np.ndarray] | None
    logdets: tuple[float, float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        if self.factors is not None:
            z = np.clip((x - self.centre) / self.scale, -LIMIT, LIMIT)
            density = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
            odds = odds + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _moments(rows: DataFrame, centre: list[float], scale: list[float]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, mean and covariance of the standardised statistics by class; a row a class comes to the driver."""
    n = len(NAMES)
    z = [F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), (F.get("x", F.lit(i)) - centre[i]) / scale[i])).alias(f"z{i}") for i in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = rows.select("quality", *z).groupBy("quality").agg(F.count("*").alias("n"), *(F.sum(f"z{i}").alias(f"s{i}") for i in range(n)), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"p{i}_{j}") for i, j in pairs)).collect()
    out = {}
    for r in sums:
        mean, second = np.array([r[f"s{i}"] for i in range(n)]) / r["n"], np.zeros((n, n))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        out[int(r["quality"])] = (r["n"], mean, second - np.outer(mean, mean))
    return out


def fit(rows: DataFrame, pooled: float = POOLED, unit: float = UNIT) -> Model:
    """rows: x and quality (0 or 1) of every labelled row that learning may see."""
    n = len(NAMES)
    first = rows.agg(*(f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(n) for k, f in (("m", F.avg), ("d", F.stddev_pop)))).first()
    centre = [first[f"m{i}"] or 0.0 for i in range(n)]
    scale = [max(first[f"d{i}"] or 0.0, 1e-3) for i in range(n)]
    by = _moments(rows, centre, scale)
    counts = [by[c][0] if c in by else 0 for c in (0, 1)]
    prior = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
    if min(counts) < 2:
        return Model(np.array(centre), np.array(scale), None, None, (0.0, 0.0), prior)
    total = sum(counts)
    shared = sum(by[c][0] * by[c][2] for c in (0, 1)) / total
    factors, logdets = [], []
    for c in (0, 1):
        s = (1 - pooled) * by[c][2] + pooled * shared
        s = (1 - unit) * s + unit * np.trace(s) / n * np.eye(n) + 1e-9 * np.eye(n)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        logdets.append(float(2 * np.log(np.diag(low)).sum()))
    return Model(np.array(centre), np.array(scale), (by[0][1], by[1][1]), tuple(factors), tuple(logdets), prior)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == HELD_OUT


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows of doc_id, x with score and predicted."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = model.score(np.array(batch.column(1).to_pylist()))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= PREDICTED).astype(np.int32))], ["doc_id", "score", "predicted"])

        return f

    return map_batches(rows.select("doc_id", "x"), make, f"doc_id {dict(rows.dtypes)['doc_id']}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labelled rows outside the held-out fold."""
    rows = features(docs)
    known = labels.select("doc_id", "quality").where("quality IN (0, 1)").where(~held_out())
    model = fit(rows.join(known, "doc_id").select("x", "quality"))
    out = scored(rows, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
