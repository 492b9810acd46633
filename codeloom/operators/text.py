"""Text index and text predicates: trigram postings, candidates, literal, regular-expression and line search.

Everything is DataFrame to DataFrame and lazy. Tables: files(path, content string, ...), postings(tri, path), lines(path, line, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.plans import patterns
from codeloom.schema import LANGUAGES


def postings(files: DataFrame) -> DataFrame:
    """(tri, path), once each: distinct within a file before rows are made, so nothing has to be shuffled."""
    return files.select(F.explode(C.trigrams("content")).alias("tri"), "path")


def posting_sizes(postings_: DataFrame) -> DataFrame:
    """Document frequency of each trigram with the ends of its list; lists themselves stay as rows, however long."""
    return postings_.groupBy("tri").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))


def candidates(postings_: DataFrame, literal: str) -> DataFrame:
    """Paths of files that hold all trigrams of a literal of three bytes or more: a division, one aggregate a path."""
    wanted = patterns.folded_trigrams(literal)
    return postings_.where(F.col("tri").isin(wanted)).groupBy("path").agg(F.count_distinct("tri").alias("k")).where(F.col("k") == len(wanted)).select("path")


def rare_candidates(postings_: DataFrame, sizes: DataFrame, literal: str, rarest: int = 3) -> DataFrame:
    """The same by the rarest trigrams only: fewer rows meet, and verification does the rest. Few rows come to the driver."""
    wanted = patterns.folded_trigrams(literal)
    found = [r.tri for r in sizes.where(F.col("tri").isin(wanted)).orderBy("n_files", "tri").limit(rarest).select("tri").collect()]
    if len(found) < min(rarest, len(wanted)):
        return postings_.where("false").select("path")
    return postings_.where(F.col("tri").isin(found)).groupBy("path").agg(F.count_distinct("tri").alias("k")).where(F.col("k") == len(found)).select("path")


def any_candidates(postings_: DataFrame, literals: list[str]) -> DataFrame:
    out = candidates(postings_, literals[0])
    for x in literals[1:]:
        out = out.union(candidates(postings_, x))
    return out.distinct()


def matches(content: Column, pattern: str, regex: bool) -> Column:
    """Whether content matches: smart case for literals, and for regular expressions too."""
    if not regex:
        return C.smart_contains(content, pattern)
    smart = "" if any(c in C.UPPER for c in pattern) else "(?i)"
    return F.regexp_like(content, F.lit(smart + pattern))


def find_files(files: DataFrame, pattern: str, regex: bool = False, glob: str | None = None, postings_: DataFrame | None = None) -> DataFrame:
    """Paths of files whose content matches, in order. With postings, regular expressions and literals first meet the index
    where they can; without, and for patterns too short for it, all files are read."""
    if r"\|" in pattern and not regex:
        pattern, regex = patterns.from_basic(pattern), True
    literals = patterns.required_literals(pattern) if regex else [pattern]
    if postings_ is not None and literals and all(len(x.encode()) >= patterns.LEAST for x in literals) and all(x.isascii() for x in literals):
        files = files.join(any_candidates(postings_, literals), "path", "left_semi")
    out = files.where(matches(F.col("content"), pattern, regex))
    if glob:
        out = out.where(F.col("path").rlike(patterns.glob_regex(glob)))
    return out.select("path").distinct().orderBy("path")


def budgeted(paths: DataFrame, budget: int) -> DataFrame:
    """Paths in order while their costs fit the budget; the first always stays.

    A prefix sum over all rows would pass through one task; since each path costs at least two tokens, only the first
    budget / 2 + 1 paths can count, and only they are summed."""
    first = paths.orderBy("path").limit(budget // 2 + 1)
    w = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    return first.withColumn("spent", F.sum(C.path_cost("path")).over(w)).withColumn("n", F.row_number().over(Window.orderBy("path"))).where((F.col("n") == 1) | (F.col("spent") <= budget)).select("path", "spent")


def lines(files: DataFrame) -> DataFrame:
    """(path, line from 1, text): a trailing newline gives a last empty line."""
    return files.select("path", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).select("path", (F.col("at") + 1).alias("line"), "text")


def line_starts(files: DataFrame) -> DataFrame:
    """(path, line, start): byte offset of each line, summed over the lines of its file."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines(files).withColumn("start", F.coalesce(F.sum(F.octet_length("text") + 1).over(w), F.lit(0)).cast("long")).select("path", "line", "start")


def search_lines(files: DataFrame, pattern: str, context: int = 2, limit: int = 100, include: list[str] | None = None, exclude: list[str] | None = None, regex: bool = False) -> DataFrame:
    """Matching lines with the lines around them, in order of path and line, at most `limit`.

    Snippets come from the file's own array of lines, so no window is needed and only matching files are split."""
    if include:
        files = files.where(F.col("path").rlike("|".join(patterns.glob_regex(g) for g in include)))
    if exclude:
        files = files.where(~F.col("path").rlike("|".join(patterns.glob_regex(g) for g in exclude)))
    hit = (lambda x: F.regexp_like(x, F.lit(pattern))) if regex else (lambda x: F.contains(x, F.lit(pattern)))
    rows = files.where(hit(F.col("content"))) if not regex else files
    rows = rows.select("path", F.split("content", "\n", -1).alias("all"))
    rows = rows.select("path", "all", F.posexplode("all").alias("at", "text")).where(hit(F.col("text")))
    first = F.greatest(F.col("at") - context, F.lit(0))
    snippet = F.transform(F.slice("all", first + 1, F.col("at") + context + 1 - first), lambda x, i: F.concat((first + i + 1).cast("string"), F.lit(": "), x))
    out = rows.select("path", (F.col("at") + 1).alias("line"), F.trim("text").alias("text"), F.array_join(snippet, "\n").alias("snippet"))
    return out.orderBy("path", "line").limit(limit)


def search_between(lines_: DataFrame, ranges: DataFrame, pattern: str) -> DataFrame:
    """Lines that hold a literal and lie in a range of `ranges` (path, start_line, end_line)."""
    return lines_.where(F.contains("text", F.lit(pattern))).join(ranges, "path").where("line BETWEEN start_line AND end_line").select("path", "line", "text").distinct()


def match_glob(files: DataFrame, glob: str) -> DataFrame:
    return files.where(F.col("path").rlike(patterns.glob_regex(glob)))


def in_language(path: Column, language: str) -> Column:
    """By the language's extensions; an unknown language is taken for an extension."""
    return C.extension(path).isin(LANGUAGES.get(language, ["." + language.lower()]))


def name_matches(name: Column, pattern: str) -> Column:
    return name.rlike(f"(?i)(?:{pattern})")


def word_spans(files: DataFrame, name: str) -> DataFrame:
    r"""(path, start, end, line): byte spans of the name as a whole word, from the lengths of what lies between them."""
    n = len(name.encode())
    parts = F.split("content", C.whole_word(name), -1)
    rows = files.where(F.contains("content", F.lit(name))).select("path", parts.alias("parts"))
    rows = rows.where(F.size("parts") > 1).select("path", "parts", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("k"))
    before = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "")
    start = F.octet_length(before) + (F.col("k") - 1) * n
    return rows.select("path", start.cast("long").alias("start"), (start + n).cast("long").alias("end"), (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("line"))


def identifiers(content: Column) -> Column:
    """Distinct ASCII identifiers of two or more characters."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit("[A-Za-z0-9_]{2,}"), F.lit(0)))


def unicode_identifiers(content: Column) -> Column:
    """Distinct identifiers that start with a letter or underscore; a single letter of more than one byte counts."""
    found = F.regexp_extract_all(content, F.lit(r"[\p{L}_][\p{L}\p{Nd}_]*"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.octet_length(x) > 1))


#: Marks of comments by language: of a line, of a block.
COMMENTS = {"go": ("//", "/*", "*/"), "c": ("//", "/*", "*/"), "python": ("#", None, None), "ruby": ("#", None, None), "lua": ("--", None, None)}


def spans_in_comments(files: DataFrame, name: str, language: str) -> DataFrame:
    """word_spans with in_comment: a line mark before it on its line, or a block opened and not closed before it."""
    line_mark, opens, closes = COMMENTS[language]
    spans = word_spans(files, name).join(files.select("path", F.encode("content", "UTF-8").alias("data")), "path")
    before = F.decode(F.substring(F.col("data"), F.lit(1), F.col("start").cast("int")), "UTF-8")
    in_line = F.contains(F.substring_index(before, "\n", -1), F.lit(line_mark))
    blocked = F.lit(False)
    if opens:
        last = lambda mark: F.when(F.contains(before, F.lit(mark)), F.length(before) - F.length(F.substring_index(before, mark, -1))).otherwise(0)
        blocked = last(opens) > last(closes)
    return spans.select("path", "start", "end", "line", (in_line | blocked).alias("in_comment"))


def companion_mentions(files: DataFrame, name: str, extensions: list[str], edited: DataFrame) -> DataFrame:
    """Mentions in files of other kinds (templates, documents) that no edit touches: path, n."""
    rows = files.where(C.extension("path").isin(extensions)).join(edited.select("path"), "path", "left_anti")
    return word_spans(rows, name).groupBy("path").agg(F.count("*").alias("n"))
