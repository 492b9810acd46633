"""Near-dedup by improved consistent weighted sampling over TF-IDF shingles, banded and verified by weighted Jaccard.

Shingles are five words (all words of shorter texts), words are parted by white space and compared without ASCII case.
A shingle weighs its count in the text times 1 + ln(min(N / df, RARE)) / ln(RARE), so 1 to 2 times its count: shingles in more
than a RAREth of the N documents lose weight, all others weigh alike. Hence only document frequencies above N / RARE
matter; no more than RARE times the mean length of a text can have them, which bounds the table that each task gets.

A text is a node; equal texts are one. Nodes that share a band meet in a bucket and are compared to its hub, the member
whose buckets are fullest, so a bucket gives one candidate a member. Buckets whose members then still lie in different
classes go to an exact join by prefix filter: two texts of similarity t share one of the rarest shingles that carry the
share 1 - t of either's weight, so pairs meet at those shingles only, and only while enough weight lies ahead. Classes are the components of the verified links.

Results: one row a document. Null and empty texts have no shingles and are a class of their own; repeated rows fall into
the class of their text; an empty table gives no rows; ties go to the smaller id; other columns are not read by `classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, map_batches, read, scratch, small_batches, survivors, written

WORDS, SIMILAR, BANDS, ROWS, RARE = 5, 0.8, 12, 3, 100
#: Documents of a chunk whose frequent shingles become candidates, and the share of a chunk that makes a shingle one.
CHUNK_DOCS, CHUNK_SHINGLES, CANDIDATE = 4096, 3_000_000, 1 / (2 * RARE)
#: Shingles that are sampled at once: bounds memory for the longest texts.
BLOCK = 200_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_values() -> np.ndarray:
    v = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    v[65:91] = v[97:123]
    return v


_VALUES, _WHITE = _byte_values(), np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers["up"]) < n:
        base, m = 0x5851F42D4C957F2D, 1 << max(16, n.bit_length())
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def shingles(texts: list[str], in_order: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 32-bit shingle) of every shingle of every text, in order of text and shingle; in_order: of place, without texts of fewer words."""
    data = "\n".join(texts).encode() + b"\n"
    buf = np.frombuffer(data, np.uint8)
    ends = np.cumsum([len(t.encode()) + 1 for t in texts])
    white = _WHITE[buf]
    edge = np.diff(np.concatenate([[True], white]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    up, down = _power(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[buf] * up[: len(buf)])])
    word = _mix((sums[stops] - sums[starts]) * down[starts])
    doc = np.searchsorted(ends, starts, "right")
    n = len(word)
    out_doc, out = [], []
    if n >= WORDS:
        h = word[: n - WORDS + 1].copy()
        for k in range(1, WORDS):
            h = _mix(h * _ODD + word[k : n - WORDS + 1 + k])
        whole = doc[: n - WORDS + 1] == doc[WORDS - 1 :]
        out_doc.append(doc[: n - WORDS + 1][whole])
        out.append(h[whole])
    count = np.bincount(doc, minlength=len(texts))
    for d in np.flatnonzero((count > 0) & (count < WORDS)) if not in_order else ():
        a = np.searchsorted(doc, d)
        h = word[a : a + 1] + _U(count[d])
        for k in range(1, count[d]):
            h = _mix(h * _ODD + word[a + k : a + k + 1])
        out_doc.append(np.array([d]))
        out.append(h)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    docs, hashes = np.concatenate(out_doc), (np.concatenate(out) >> _U(32)).astype(np.uint32)
    if in_order:
        return docs, hashes
    order = np.lexsort((hashes, docs))
    return docs[order], hashes[order]


def counted(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs of sorted ones, and their counts."""
    if not len(docs):
        return docs, hashes, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])]))
    return docs[first], hashes[first], np.diff(np.append(first, len(docs)))


class Frequent:
    """Inverse document frequencies: a factor for each frequent shingle, 2 for all others."""

    def __init__(self, frequent: dict[int, int], n: int):
        keys = np.array(sorted(frequent), np.uint32)
        self.keys = keys
        df = np.array([frequent[int(k)] for k in keys], float)
        self.factor = 1 + np.log(np.clip(n / np.maximum(df, 1), 1, RARE)) / np.log(RARE)

    def weights(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = np.full(len(hashes), 2.0)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            w = np.where(self.keys[at] == hashes, self.factor[at], w)
        return w * counts


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) quantiles and their logarithms at the middle of 2^16 equal shares."""
    x = np.linspace(0, 24, 400_001)
    cdf = 1 - np.exp(-x) * (1 + x)
    q = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return q.astype(np.float32), np.log(q).astype(np.float32)


_GAMMA, _LOG_GAMMA = _tables()


def bands(docs: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """n rows of BANDS keys. Each sample is the shingle with the least ln a = ln c - ln y - r, and its level t
    (y = exp(r (t - beta)), t = floor(ln w / r + beta)); r, c and beta come from the shingle's hash and the sample's number."""
    out = np.zeros((n, BANDS), np.uint64)
    if not len(docs):
        return out
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    sizes = np.diff(np.append(starts, len(docs)))
    rows = docs[starts]
    log_w = np.log(weights).astype(np.float32)
    wide = hashes.astype(np.uint64)
    for band in range(BANDS):
        key = np.full(len(rows), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            x = _mix(wide * _ODD + _U((k + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
            r = _GAMMA[(x & _U(0xFFFF)).astype(np.int64)]
            beta = ((x >> _U(32)) & _U(0xFFFF)).astype(np.float32) / 65536
            t = np.floor(log_w / r + beta)
            a = _LOG_GAMMA[((x >> _U(16)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta) - r
            least = np.minimum.reduceat(a, starts)
            # ties, frequent only in very long texts, go to the smallest mixed hash
            hit = np.flatnonzero(a == np.repeat(least, sizes))
            sample = _mix(wide[hit] * _ODD + t[hit].astype(np.int64).astype(np.uint64))
            row = np.searchsorted(starts, hit, "right") - 1
            best = np.full(len(rows), ~_U(0))
            np.minimum.at(best, row, sample)
            key = _mix(key * _ODD + best)
        out[rows, band] = key
    return out


def _blocks(docs: np.ndarray) -> Iterator[slice]:
    """Slices of about BLOCK pairs that hold whole texts."""
    a = 0
    while a < len(docs):
        b = min(len(docs), a + BLOCK)
        if b < len(docs):
            b = max(int(np.searchsorted(docs, docs[b], "left")), a)
            b = int(np.searchsorted(docs, docs[a], "right")) if b == a else b
        yield slice(a, b)
        a = b


def _candidates(docs: DataFrame) -> DataFrame:
    """(shingle, n): shingles in more than CANDIDATE of the documents of some chunk. One in more than that share of all
    documents is so in at least one chunk, however the rows are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, size = [], 0, 0

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(parts), return_counts=True)
            keys = keys[counts > CANDIDATE * n]
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts[counts > CANDIDATE * n])], ["shingle", "n"])

        for batch in batches_of(batches):
            d, h, _ = counted(*shingles([t or "" for t in batch.column(0).to_pylist()]))
            parts.append(h)
            n, size = n + batch.num_rows, size + len(h)
            if n >= CHUNK_DOCS or size >= CHUNK_SHINGLES:
                yield flush()
                parts, n, size = [], 0, 0
        if parts:
            yield flush()

    return docs.select("text").mapInArrow(run, "shingle bigint, n bigint")


def frequencies(docs: DataFrame) -> tuple[Frequent, int]:
    """Exact document frequencies of all shingles in more than a RAREth of the documents.

    Candidates come from chunks; a second pass counts them exactly. A shingle that is kept has, by its candidate counts
    and what chunks may have left out, at least CANDIDATE times all documents, so no more than mean length / CANDIDATE are collected."""
    n = docs.count()
    found = _candidates(docs).groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= (1 / RARE - CANDIDATE) * n)
    with small_batches(docs.sparkSession):
        keys = np.array(sorted(r[0] for r in found.select("shingle").toLocalIterator()), np.uint32)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            _, h, _ = counted(*shingles([t or "" for t in batch.column(0).to_pylist()]))
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = at[keys[at] == h]
            c = np.bincount(at, minlength=len(keys))
            hit = np.flatnonzero(c)
            return pa.RecordBatch.from_arrays([pa.array(keys[hit].astype(np.int64)), pa.array(c[hit])], ["shingle", "n"])

        return f

    if not len(keys):
        return Frequent({}, n), n
    exact = map_batches(docs.select("text"), make, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > n / RARE)
    with small_batches(docs.sparkSession):
        return Frequent({r[0]: r[1] for r in exact.collect()}, n), n


def digest(text: Column) -> Column:
    """128 bits of the text's SHA-256, in hexadecimal digits; null counts as empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32)


def sketches(docs: DataFrame, frequent: Frequent) -> DataFrame:
    """tag (a number of the row, made here), doc_id, digest of the text, total weight, band keys, shingles (packed, counts as repeats), written once."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            d, h = shingles(texts)
            ud, uh, c = counted(d, h)
            w = frequent.weights(uh, c)
            keys = np.zeros((len(texts), BANDS), np.uint64)
            for s in _blocks(ud):
                rows = ud[s]
                keys[rows[0] : rows[-1] + 1] = bands(rows - rows[0], uh[s], w[s], rows[-1] - rows[0] + 1)
            total = np.bincount(ud, w, len(texts))
            cuts = np.searchsorted(d, np.arange(len(texts) + 1))
            packed = [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            key_lists = [k if b > a else [] for k, a, b in zip(keys.view(np.int64).tolist(), cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(total), pa.array(key_lists, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["tag", "doc_id", "digest", "total", "bands", "shingles"])

        return f

    rows = docs.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text", digest(F.col("text")).alias("digest"))
    return written(map_batches(rows, make, f"tag bigint, doc_id {dict(docs.dtypes)['doc_id']}, digest string, total double, bands array<bigint>, shingles binary"), "sketches")


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.frombuffer(x, np.uint32), return_counts=True)


def weighted_jaccard(a: bytes, b: bytes, frequent: Frequent) -> float:
    (ka, ca), (kb, cb) = _unpacked(a), _unpacked(b)
    both, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    common = frequent.weights(both, np.minimum(ca[ia], cb[ib])).sum()
    union = frequent.weights(ka, ca).sum() + frequent.weights(kb, cb).sum() - common
    return float(common / union) if union > 0 else 1.0


def verified(pairs: DataFrame, texts: DataFrame, frequent: Frequent) -> DataFrame:
    """pairs (a, b) with their weighted Jaccard similarity. texts: tag, shingles of all that pairs name."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            s = [weighted_jaccard(x, y, frequent) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64())], ["a", "b", "similarity"])

        return f

    left, right = texts.select(F.col("tag").alias("a"), F.col("shingles").alias("x")), texts.select(F.col("tag").alias("b"), F.col("shingles").alias("y"))
    return map_batches(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), make, "a bigint, b bigint, similarity double")


def components(links: DataFrame) -> DataFrame:
    """(tag, label) of every node that has a link: label is the least tag of its component.

    Each round takes the least label among neighbours and then the label of the label; rounds end when nothing changes."""
    with scratch(links.sparkSession):
        both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
        labels = written(both.groupBy(F.col("a").alias("tag")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
        while True:
            near = both.join(labels.withColumnRenamed("tag", "b"), "b").groupBy(F.col("a").alias("tag")).agg(F.min("label").alias("near"))
            step = written(labels.join(near, "tag").select("tag", F.col("label").alias("old"), F.least("label", "near").alias("label")), "labels")
            jump = step.select(F.col("tag").alias("label"), F.col("label").alias("top"))
            now = written(step.join(jump, "label", "left").select("tag", "old", F.least("label", F.coalesce("top", "label")).alias("label")), "labels", keep=True)
            if now.where("old <> label").isEmpty():
                return now.select("tag", "label")
            labels = now.select("tag", "label")


def _prefixes(members: DataFrame, labels: DataFrame, texts: DataFrame, frequent: Frequent) -> DataFrame:
    """(tag, label, total, shingle, rest) of the prefixes of texts in doubt, members of buckets that hold more than one class: rest is the weight
    from the shingle on, in order of rarity."""
    named = members.join(labels.withColumnRenamed("label", "known"), "tag", "left").select("key", "tag", F.coalesce("known", "tag").alias("label"))
    named = written(named, "named")
    mixed = written(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    doubt = written(named.join(mixed, "key", "left_semi").select("tag", "label").distinct(), "doubt")
    rows = written(texts.select("tag", "shingles").join(doubt, "tag"), "doubted")

    def spread():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [np.unique(np.frombuffer(x, np.uint32)) for x in batch.column(0).to_pylist()]
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["shingle", "n"])

        return f

    df = map_batches(rows.select("shingles"), spread, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("df"))

    def explode():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            tag, label, total, key, weight = [], [], [], [], []
            for t, g, x in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                k, c = _unpacked(x)
                w = frequent.weights(k, c)
                tag.append(np.full(len(k), t))
                label.append(np.full(len(k), g))
                total.append(np.full(len(k), w.sum()))
                key.append(k.astype(np.int64))
                weight.append(w)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tag, label, total, key, weight)], ["tag", "label", "total", "shingle", "w"])

        return f

    spread_rows = map_batches(rows.select("tag", "label", "shingles"), explode, "tag bigint, label bigint, total double, shingle bigint, w double").join(df, "shingle")
    gathered = spread_rows.groupBy("tag", "label", "total").agg(F.sort_array(F.collect_list(F.struct("df", "shingle", "w"))).alias("all"))

    def prefix():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            tag, label, total, key, rest = [], [], [], [], []
            for t, g, whole, items in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                left = whole
                for it in items:
                    if left < SIMILAR * whole - 1e-9:
                        break
                    if it["df"] > 1:
                        tag.append(t)
                        label.append(g)
                        total.append(whole)
                        key.append(it["shingle"])
                        rest.append(left)
                    left -= it["w"]
            return pa.RecordBatch.from_arrays([pa.array(tag, pa.int64()), pa.array(label, pa.int64()), pa.array(total, pa.float64()), pa.array(key, pa.int64()), pa.array(rest, pa.float64())], ["tag", "label", "total", "shingle", "rest"])

        return f

    short = written(map_batches(gathered, prefix, "tag bigint, label bigint, total double, shingle bigint, rest double"), "prefixes")
    return short


def _contested(rows: DataFrame) -> DataFrame:
    """rows whose shingle more than one class has."""
    shared = written(rows.groupBy("shingle").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("shingle"), "shared")
    return rows.join(shared, "shingle", "left_semi")


def _possible(x: str, y: str) -> Column:
    """Whether two texts that meet at a shingle can be similar: sizes are near, and at the first shingle that they share, all they share is still
    ahead in both and must be t / (1 + t) of their sum."""
    totals = F.col(f"total_{x}"), F.col(f"total_{y}")
    enough = F.least(f"rest_{x}", f"rest_{y}") >= SIMILAR / (1 + SIMILAR) * (totals[0] + totals[1]) - 1e-6
    return (totals[0] >= SIMILAR * totals[1]) & (totals[1] >= SIMILAR * totals[0]) & enough


def _speakers(rows: DataFrame, order: Column) -> DataFrame:
    """(a, b): at each contested shingle one text of each class, first by order, with that of the class that has most texts there: as many pairs as
    classes."""
    best = F.min_by(F.struct("tag", "total", "rest"), order).alias("s")
    speak = written(_contested(rows).groupBy("shingle", "label").agg(best, F.count("*").alias("n")).select("shingle", "label", "n", "s.*"), "speakers")
    largest = F.max_by(F.struct("label", "tag", "total", "rest"), F.struct("n", (-F.col("label")).alias("l"))).alias("s")
    hubs = written(speak.groupBy("shingle").agg(largest).select("shingle", *(F.col(f"s.{c}").alias(f"{c}_b") for c in ("label", "tag", "total", "rest"))), "speaking_hubs")
    rows = speak.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("label", "tag", "total", "rest"))).join(hubs, "shingle").where("label_a <> label_b")
    return rows.where(_possible("a", "b")).select(F.least("tag_a", "tag_b").alias("a"), F.greatest("tag_a", "tag_b").alias("b")).distinct()


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): texts of different classes that share a shingle of both prefixes and can be similar: those of similarity SIMILAR are among them."""
    met = written(_contested(rows), "met")
    x, y = (met.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("tag", "label", "total", "rest"))) for s in "ab")
    pairs = x.join(y, (x.shingle == y.shingle) & (F.col("label_a") < F.col("label_b")) & _possible("a", "b"))
    return pairs.select(F.col("tag_a").alias("a"), F.col("tag_b").alias("b")).distinct()


def links(sketch: DataFrame, frequent: Frequent) -> DataFrame:
    """(a, b, similarity): verified links between distinct texts, named by the least tag of each text, enough to join every class."""
    nodes = written(sketch.groupBy("digest").agg(F.min("tag").alias("tag")).select("tag"), "nodes")
    exploded = sketch.select("tag", "bands").join(nodes, "tag", "left_semi").select("tag", F.explode("bands").alias("key"))
    keys = written(exploded, "keys")
    counts = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    members = written(keys.join(counts, "key"), "members")
    score = written(members.groupBy("tag").agg(F.sum("n").alias("score")), "scores")
    best = F.max(F.struct("score", F.bitwise_not("tag").alias("inverse"))).alias("best")
    hubs = written(members.join(score, "tag").groupBy("key").agg(best).select("key", F.bitwise_not("best.inverse").alias("hub")), "hubs")
    stars = members.join(hubs, "key").where("tag <> hub").select(F.least("tag", "hub").alias("a"), F.greatest("tag", "hub").alias("b")).distinct()
    stars = written(stars, "stars")
    named = written(members.select("tag").distinct(), "involved")
    texts = written(sketch.select("tag", "shingles").join(named, "tag", "left_semi"), "involved")
    found = written(verified(stars, texts, frequent).where(F.col("similarity") >= SIMILAR), "first")
    rows = _prefixes(members.select("key", "tag"), components(found), texts, frequent)
    # the text with the least weight before the shingle differs least from what its class has in common; then any
    for order in (F.struct((-F.col("rest") / F.col("total")).alias("r"), "tag"), F.struct(F.xxhash64("tag").alias("r"), "tag")):
        new = written(verified(written(_speakers(rows, order), "spoken"), texts, frequent).where(F.col("similarity") >= SIMILAR), "heard")
        if new.isEmpty():
            continue
        found = found.union(new)
        classes_of = rows.select("tag", "label").distinct()
        joined = new.join(classes_of.toDF("a", "x"), "a").join(classes_of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        merged = components(joined.where("a <> b")).toDF("label", "merged")
        rows = written(rows.join(merged, "label", "left").withColumn("label", F.coalesce("merged", "label")).drop("merged"), "prefixes")
    rest = written(_all_pairs(rows), "rest")
    return found.union(verified(rest, texts, frequent).where(F.col("similarity") >= SIMILAR))


def tagged_classes(docs: DataFrame) -> DataFrame:
    """tag (a number of the row), doc_id, digest, label of every row: rows of one class have one label."""
    with scratch(docs.sparkSession):
        frequent, _ = frequencies(docs)
        sketch = sketches(docs, frequent)
        labels = components(links(sketch, frequent))
        nodes = written(sketch.groupBy("digest").agg(F.min("tag").alias("node")), "nodes")
        named = written(nodes.join(labels.withColumnRenamed("tag", "node"), "node", "left").select("digest", F.coalesce("label", "node").alias("label")), "named")
        return written(sketch.select("tag", "doc_id", "digest").join(named, "digest").select("tag", "doc_id", "digest", "label"), "classes", keep=True)


def classes(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, class_id (the least doc_id of its class), class_size, kept (the row that stays)."""
    rows = tagged_classes(docs)
    heads = written(rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "heads")
    return rows.join(heads, "label").select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class, that of the least doc_id (null last), all columns as they were. Sketches are gone
    when it returns; rows are read again for the result and joined with the texts of classes of two rows or more."""
    with scratch(docs.sparkSession):
        rows = tagged_classes(docs)
        counted = written(rows.groupBy("label", "digest", "doc_id").agg(F.count("*").alias("n")), "counted")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", F.col("n").alias("ties"))).alias("best")
        heads = written(counted.groupBy("label").agg(best, F.sum("n").alias("size")).where("size > 1"), "heads")
        met = counted.select("label", F.col("digest").alias("key")).distinct().join(heads, "label")
        mine = F.col("key") == F.col("best.digest")
        decided = met.select("key", F.when(mine, F.struct(F.col("best.doc_id").alias("doc_id"))).alias("best"), F.when(mine, F.col("best.ties")).otherwise(F.lit(1)).alias("ties"))
        decided = written(decided, "decided", keep=True)
    return survivors(docs, digest(F.col("text")), F.struct("doc_id"), decided)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
