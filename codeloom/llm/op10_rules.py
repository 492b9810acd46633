"""Quality rules by distribution divergence: Jensen-Shannon distance of a document's character-class and
common-word histograms to language references. DataFrame functions only.

References are parameters: shares of character classes and of function words in ordinary prose of four languages. They do
not come from the table, so a document's verdict depends on its own text only, whatever its neighbours and the table's size,
and the rules are one pass without a shuffle; `references` learns other ones from documents that pass the base rules.

Texts are taken whole, however long: words, windows and histograms of a text are arrays of one row, and a text too long for
packed windows takes a wider form with equal results. A null or empty text has no words. Distances equal to a limit pass.
Repeated rows give one result each; an empty table gives no rows; other columns of the input, whatever their names, are neither
read nor returned by `quality_rules` and pass unchanged through `keep_good`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read

#: Function words that tell the languages, most frequent first.
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "are", "be", "this"],
    "de": ["der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "ist", "im", "dem", "nicht", "ein", "eine"],
    "fr": ["de", "la", "le", "les", "et", "des", "du", "que", "qui", "dans", "un", "une", "est", "pour", "par", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por", "con", "no", "una", "para"],
}
COMMON = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})
CLASSES = ["lower", "upper", "digit", "white", "mark", "symbol", "other"]
#: Words that a document needs for a verdict of each histogram; below, the histogram says nothing and the document passes it.
MIN_WORDS_CLASSES, MIN_WORDS_COMMON = 50, 80
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of kept documents.
MAX_CLASSES, MAX_COMMON = 0.19, 0.42
#: Added to each reference share, so that a reference never has a zero.
SMOOTH = 1e-4
#: Shares of CLASSES in ordinary prose.
PROSE = {
    "en": [0.780, 0.025, 0.005, 0.165, 0.024, 0.0005, 0.0005],
    "de": [0.765, 0.045, 0.005, 0.148, 0.025, 0.0005, 0.0115],
    "fr": [0.745, 0.025, 0.005, 0.163, 0.030, 0.0005, 0.0315],
    "es": [0.755, 0.025, 0.005, 0.165, 0.025, 0.0005, 0.0245],
}
#: Share of a text's words that its language's FUNCTION_WORDS are; among themselves they follow Zipf's law.
COMMON_SHARE = 0.3
WORD = r"[^\x20\x09-\x0D]+"


#: Low bits of a packed window that hold its position; texts of more words take the wider form.
POSITION_BITS = 21


def _words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that the text has twice or more.

    Each window becomes one long, hash above and position below; sorted, equal windows are neighbours; flagged positions
    cover three words each. 43 bits of hash only propose: flagged neighbours are compared word by word, and a text in which two
    different windows have one hash takes the wider form, which sorts the words themselves."""
    n = F.size(words)
    mask = (1 << POSITION_BITS) - 1

    def packed(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.shiftleft(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)), POSITION_BITS).bitwiseOR(i.cast("long"))), 1, F.greatest(n - 2, F.lit(0)))

    at = lambda e: e.bitwiseAND(mask).cast("int")
    key = lambda e: F.shiftright(e, POSITION_BITS)
    next_to = lambda s, e, k: F.coalesce(key(e) == key(F.get(s, k + 1)), F.lit(False)) | F.coalesce(key(e) == key(F.get(s, k - 1)), F.lit(False))
    proposed = lambda s: F.filter(s, lambda e, k: next_to(s, e, k))
    word = lambda e, j: F.get(words, at(e) + j)
    differ = lambda e, o: (key(e) == key(o)) & ((word(e, 0) != word(o, 0)) | (word(e, 1) != word(o, 1)) | (word(e, 2) != word(o, 2)))
    collide = lambda p: F.exists(F.zip_with(p, F.slice(p, 2, 1 << 30), lambda e, o: F.coalesce(differ(e, o), F.lit(False))), lambda x: x)
    gaps = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, 1 << 30), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda a, x: a + x)

    def wide(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i")))
        alike = lambda e, o: F.coalesce((e["a"] == o["a"]) & (e["b"] == o["b"]) & (e["c"] == o["c"]), F.lit(False))
        flagged = lambda s: F.transform(F.filter(s, lambda e, k: alike(e, F.get(s, k + 1)) | alike(e, F.get(s, k - 1))), lambda e: e["i"])
        return let(F.sort_array(pairs), lambda s: let(F.sort_array(flagged(s)), gaps))

    settled = lambda p: F.when(F.size(p) == 0, F.lit(0)).when(collide(p), wide(words)).otherwise(let(F.sort_array(F.transform(p, at)), gaps))
    short = let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(F.sort_array(packed(h)), lambda s: let(proposed(s), settled)))
    return F.when(n < 4, F.lit(0)).when(n < mask, short).otherwise(wide(words)).cast("long")


def _histograms(df: DataFrame) -> DataFrame:
    """Adds words and the counts of the rules: n_words, word_chars, n_symbols, classes (of characters), commons (of common words), spoken."""
    df = df.withColumn("body", F.coalesce(F.col("text"), F.lit("")))
    df = df.withColumn("words", _words(F.regexp_replace("body", r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")))
    df = df.withColumns({"rest": F.regexp_replace("body", r"[a-z\x20\x09-\x0D]+", ""), "word_chars": F.length(F.array_join("words", "")).cast("long"), "n_points": F.length("body").cast("long")})
    inside = lambda cls: (F.length("rest") - F.length(F.regexp_replace("rest", cls, ""))).cast("long")
    df = df.withColumns({"n_words": F.when(F.col("word_chars") == 0, 0).otherwise(F.size("words")).cast("long"), "c_upper": inside("[A-Z]+"), "c_digit": inside("[0-9]+"), "c_mark": inside(r"[.,;:!?'\"()\-]+"), "n_symbols": inside(r"[#*$%&|<>]+"), "c_rest": F.length("rest").cast("long")})
    white, lower = F.col("n_points") - F.col("word_chars"), F.col("word_chars") - F.col("c_rest")
    other = F.col("c_rest") - F.col("c_upper") - F.col("c_digit") - F.col("c_mark") - F.col("n_symbols")
    counted = let(F.filter("words", lambda w: w.isin(COMMON)), lambda k: F.transform(F.array(*map(F.lit, COMMON)), lambda c: F.size(F.filter(k, lambda w: w == c))))
    df = df.withColumns({"classes": F.array(*(x.cast("int") for x in (lower, F.col("c_upper"), F.col("c_digit"), white, F.col("c_mark"), F.col("n_symbols"), other))), "counts": counted})
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD))
    return df.withColumns({"n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"), "n_repeat_words": _repeated(F.col("words"))})


def _spoken() -> Column:
    """The language whose function words the text has most of, or 'none'."""
    score = {g: sum((F.get("counts", F.lit(COMMON.index(w))) for w in ws), F.lit(0)) for g, ws in FUNCTION_WORDS.items()}
    best = F.greatest(*score.values())
    spoken = F.when(best <= 0, "none")
    for g, s in score.items():
        spoken = spoken.when(s == best, g)
    return spoken


def measured(docs: DataFrame) -> DataFrame:
    """docs, without text, with the counts and histograms of each text. They pass through a generator of one row, below which
    Spark moves no filter: a filter would else measure the text again."""
    df = _histograms(docs)
    rest = F.greatest(F.col("n_words") - F.aggregate("counts", F.lit(0), lambda a, x: a + x), F.lit(0)).cast("int")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes"]
    counts = F.struct(*names, F.concat("counts", F.array(rest)).alias("commons"), _spoken().alias("spoken"))
    return df.select(*(c for c in docs.columns if c != "text"), F.inline(F.array(counts)))


References = dict[str, tuple[list[float], list[float]]]


def _mean(refs: References) -> tuple[list[float], list[float]]:
    return tuple(_smooth([sum(column) for column in zip(*(r[k] for r in refs.values()), strict=True)]) for k in (0, 1))


def prose() -> References:
    """The references of PROSE and FUNCTION_WORDS; 'all', for texts with none of the words, is their mean."""
    out = {}
    for g, words in FUNCTION_WORDS.items():
        zipf = [1 / (k + 1) for k in range(len(words))]
        share = {w: COMMON_SHARE * z / sum(zipf) for w, z in zip(words, zipf, strict=True)}
        out[g] = (_smooth(PROSE[g]), _smooth([share.get(w, 0.0) for w in COMMON] + [1 - COMMON_SHARE]))
    return out | {"all": _mean(out)}


def references(docs: DataFrame) -> References:
    """References learned from documents that pass the base rules: summed counts by language, added to those that PROSE expects of
    100 documents of 1,000 characters and 200 words, so that a language with few documents has no other rule than one with many.

    Sums are of whole numbers; one row a language comes to the driver, at most len(FUNCTION_WORDS) + 1 however large the table is."""
    rows = measured(docs.select("text")).where(~base_failed())
    sizes = {"classes": len(CLASSES), "commons": len(COMMON) + 1}
    sums = {r["spoken"]: r for r in rows.groupBy("spoken").agg(*(F.sum(F.get(k, F.lit(i)).cast("long")).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n))).collect()}
    prior, out = prose(), {}
    for g in FUNCTION_WORDS:
        out[g] = tuple(_smooth([w * p + (sums[g][f"{k}{i}"] if g in sums else 0) for i, p in enumerate(prior[g][j])]) for j, (k, w) in enumerate((("classes", 100_000), ("commons", 20_000))))
    return out | {"all": _mean(out)}


def _smooth(sums: list[float]) -> list[float]:
    total = sum(sums) or 1.0
    p = [s / total + SMOOTH for s in sums]
    return [x / sum(p) for x in p]


def _distance(counts: Column, ref: Column) -> Column:
    """Jensen-Shannon distance, base 2, of counts to the reference distribution."""

    def js(total: Column) -> Column:
        def term(c: Column, q: Column) -> Column:
            p = c / total
            m = (p + q) / 2
            return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0)) + q * F.log2(q / m)

        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(counts, ref, term), F.lit(0.0), lambda a, x: a + x) / 2))

    return let(F.greatest(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x), F.lit(1.0)), js)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(rows: DataFrame, refs: References) -> DataFrame:
    """Measured rows with base_failed, the distances js_classes and js_common, kept."""
    df = rows.withColumn("base_failed", base_failed())

    def nearest(k: int) -> Column:
        array = lambda g: F.array(*map(F.lit, refs.get(g, refs["all"])[k]))
        ref = F.when(F.lit(False), array("all"))
        for g in FUNCTION_WORDS:
            ref = ref.when(F.col("spoken") == g, array(g))
        return ref.otherwise(array("all"))

    df = df.withColumns({"js_classes": _distance(F.col("classes"), nearest(0)), "js_common": _distance(F.col("commons"), nearest(1))})
    passes = ((F.col("n_words") < MIN_WORDS_CLASSES) | (F.col("js_classes") <= MAX_CLASSES)) & ((F.col("n_words") < MIN_WORDS_COMMON) | (F.col("js_common") <= MAX_COMMON))
    return df.withColumn("kept", ~F.col("base_failed") & passes)


def quality_rules(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """One row a document: doc_id, counts of the rules, base_failed, the distances, kept. refs: those of `references`, else `prose`."""
    rows = measured(docs.select("doc_id", "text"))
    return judged(rows, refs or prose()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_classes", "js_common", "kept")


def keep_good(docs: DataFrame, refs: References | None = None) -> DataFrame:
    """docs without those that the rules reject, all columns as they were, also where doc_id is null or repeated."""
    rows = measured(docs.select(F.struct(*docs.columns).alias("row"), "text"))
    return judged(rows, refs or prose()).where("kept").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules(read(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 6) for c in ("js_classes", "js_common")})


def sql() -> str:
    """DuckDB SQL for the query, from the same references."""
    refs = prose()
    array = lambda x: f"[{', '.join(map(repr, x))}]"
    ref = lambda k: f"CASE spoken {' '.join(f'WHEN {g!r} THEN {array(refs[g][k])}' for g in FUNCTION_WORDS)} ELSE {array(refs['all'][k])} END"
    score = {g: " + ".join(f"counts[{COMMON.index(w) + 1}]" for w in ws) for g, ws in FUNCTION_WORDS.items()}
    best = f"greatest({', '.join(score.values())})"
    spoken = f"CASE WHEN {best} <= 0 THEN 'none' {' '.join(f'WHEN {s} = {best} THEN {g!r}' for g, s in score.items())} END"
    inside = lambda cls: f"length(body) - length(regexp_replace(body, '{cls}', '', 'g'))"
    js = lambda h, r: f"round(sqrt(greatest(0.0, list_sum(list_transform(list_zip({h}, {r}), lambda x: CASE WHEN x[1] > 0 THEN x[1]::DOUBLE / greatest(list_sum({h}), 1) * log2((x[1]::DOUBLE / greatest(list_sum({h}), 1)) / ((x[1]::DOUBLE / greatest(list_sum({h}), 1) + x[2]) / 2)) ELSE 0.0 END + x[2] * log2(x[2] / ((x[1]::DOUBLE / greatest(list_sum({h}), 1) + x[2]) / 2)))) / 2)), 6)"
    return f"""
WITH t AS (SELECT row_number() OVER () AS tag, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words FROM t),
c AS (SELECT tag, doc_id, words, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, length(body) AS points,
  {inside('[a-z]')} AS lower, {inside('[A-Z]')} AS upper, {inside('[0-9]')} AS digit, {inside("[.,;:!?''\\x22()\\-]")} AS mark, ({inside('[#*$%&|<>]')})::BIGINT AS n_symbols,
  list_transform({COMMON}, lambda k: len(list_filter(words, lambda x: x = k))) AS counts,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM w),
g AS (SELECT tag, i, words[i] || chr(32) || words[i + 1] || chr(32) || words[i + 2] AS x FROM (SELECT tag, words, unnest(range(1, n_words - 1)) AS i FROM c)),
r AS (SELECT tag, count(DISTINCT j)::BIGINT AS n FROM (SELECT tag, unnest([i, i + 1, i + 2]) AS j FROM (SELECT tag, i, count(*) OVER (PARTITION BY tag, x) AS k FROM g) WHERE k > 1) GROUP BY tag),
h AS (SELECT c.*, coalesce(r.n, 0) AS n_repeat_words, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, {spoken} AS spoken,
  [lower, upper, digit, points - word_chars, mark, n_symbols, word_chars - lower - upper - digit - mark - n_symbols]::BIGINT[] AS classes,
  list_append(counts, greatest(n_words - list_sum(counts), 0))::BIGINT[] AS commons FROM c LEFT JOIN r USING (tag)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {js('classes', ref(0))} AS js_classes, {js('commons', ref(1))} AS js_common FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_classes, js_common,
  NOT base_failed AND (n_words < {MIN_WORDS_CLASSES} OR js_classes <= {MAX_CLASSES}) AND (n_words < {MIN_WORDS_COMMON} OR js_common <= {MAX_COMMON}) AS kept FROM j
"""
