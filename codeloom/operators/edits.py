"""Edit sets: spans and replacements as rows, spliced file by file. Nothing is written unless a sink is asked to."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A rename that touches more than this needs force.
MOST_FILES, MOST_OCCURRENCES = 50, 200


def rename_edits(spans: DataFrame, new_name: str) -> DataFrame:
    """(path, start_byte, end_byte, replacement) once for each span."""
    return spans.select("path", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.lit(new_name).alias("replacement")).distinct()


def rename_gate(edits: DataFrame, force: bool = False) -> DataFrame:
    """One row: files, occurrences, and whether the rename may go on."""
    sums = edits.agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("n_edits"))
    return sums.withColumn("allowed", F.lit(force) | ((F.col("n_files") <= MOST_FILES) & (F.col("n_edits") <= MOST_OCCURRENCES)))


def sound(edits: DataFrame) -> DataFrame:
    """Edits in order of start without malformed ones and those that overlap the one before."""
    w = Window.partitionBy("path").orderBy("start_byte", "end_byte").rowsBetween(Window.unboundedPreceding, -1)
    rows = edits.where("end_byte >= start_byte")
    return rows.withColumn("reach", F.max("end_byte").over(w)).where("reach IS NULL OR start_byte >= reach").drop("reach")


def spliced(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, content) of edited files: kept stretches and replacements joined in order, on bytes.

    The edits of a file are an array in its row, so a file is spliced where it lies."""
    lists = sound(edits).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte", "replacement"))).alias("edits"))
    rows = files.select("path", F.encode("content", "UTF-8").alias("data")).join(lists, "path")

    def kept(e: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get("edits", i - 1)["end_byte"])
        return F.concat(F.decode(F.substring(F.col("data"), (start + 1).cast("int"), (e["start_byte"] - start).cast("int")), "UTF-8"), e["replacement"])

    tail = F.decode(F.substring(F.col("data"), (F.element_at("edits", -1)["end_byte"] + 1).cast("int"), F.octet_length("data")), "UTF-8")
    return rows.select("path", F.concat(F.array_join(F.transform("edits", kept), ""), tail).alias("content"))


def guarded(edits: DataFrame, files: DataFrame) -> DataFrame:
    """Edits whose file still has the content that they were made for (expect_hash, if given)."""
    now = files.select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
    return edits.join(now, "path").where("expect_hash IS NULL OR expect_hash = hash").drop("hash")


def replace_once(files: DataFrame, old: str, new: str) -> DataFrame:
    """(path, n, content): content with the text replaced where it is there exactly once, else as it was."""
    n = (F.octet_length("content") - F.octet_length(F.replace("content", F.lit(old), F.lit("")))) / len(old.encode())
    rows = files.select("path", "content", F.floor(n).cast("long").alias("n"))
    return rows.select("path", "n", F.when(F.col("n") == 1, F.replace("content", F.lit(old), F.lit(new))).otherwise(F.col("content")).alias("content"))


def squeezed(text: Column) -> Column:
    """Text with every run of white space as one space: what a fuzzy match compares."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def fuzzy_matches(files: DataFrame, wanted: str) -> DataFrame:
    """(path, n): how often files have a text, white space aside."""
    w = " ".join(wanted.split())
    s = squeezed(F.col("content"))
    n = (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(w), F.lit("")))) / len(w.encode())
    return files.select("path", F.floor(n).cast("long").alias("n")).where("n > 0")


def overlay_binary(content: Column, start: int, end: int, replacement: str) -> Column:
    """The bytes of content with [start, end) replaced, wherever characters begin."""
    data = F.encode(content, "UTF-8")
    return F.concat(F.substring(data, 1, start), F.encode(F.lit(replacement), "UTF-8"), F.substring(data, F.lit(end + 1), F.octet_length(data)))


def overlay_bytes(content: Column, start: int, end: int, replacement: str) -> Column:
    return F.decode(overlay_binary(content, start, end, replacement), "UTF-8")


def byte_slice(content: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(content, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def _count(text: Column, part: str) -> Column:
    return F.floor((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("long")


def replace_in_symbol(files: DataFrame, symbols: DataFrame, old: str, new: str) -> DataFrame:
    """(path, n, content) of files of symbols(path, start_byte, end_byte), one a file: the text replaced where the symbol holds it exactly once."""
    rows = files.select("path", "content").join(symbols.select("path", "start_byte", "end_byte"), "path")
    size = F.octet_length("content")
    rows = rows.withColumn("body", byte_slice(F.col("content"), F.col("start_byte"), F.col("end_byte"))).withColumn("n", _count(F.col("body"), old))
    whole = F.concat(byte_slice(F.col("content"), F.lit(0), F.col("start_byte")), F.replace("body", F.lit(old), F.lit(new)), byte_slice(F.col("content"), F.col("end_byte"), size))
    return rows.select("path", "n", F.when(F.col("n") == 1, whole).otherwise(F.col("content")).alias("content"))


def removals(spans: DataFrame) -> DataFrame:
    """Edits that take spans(path, start_byte, end_byte) out."""
    return spans.select("path", "start_byte", "end_byte", F.lit("").alias("replacement"))


def insertions(places: DataFrame) -> DataFrame:
    """Edits that put text at places(path, at, text)."""
    return places.select("path", F.col("at").alias("start_byte"), F.col("at").alias("end_byte"), F.col("text").alias("replacement"))


def moved_after(symbols: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits of moves(path, name, to_path, after): the first symbol of a name goes behind another, in its file or in a second one. The two edits
    of a move are rows of one set, so `spliced` and `guarded` see both or none."""
    first = symbols.groupBy("path", "name").agg(F.min_by(F.struct("start_byte", "end_byte", "body"), "start_byte").alias("s")).select("path", "name", "s.*")
    source = moves.join(first, ["path", "name"])
    target = first.select(F.col("path").alias("to_path"), F.col("name").alias("after"), F.col("end_byte").alias("at"))
    met = source.join(target, ["to_path", "after"])
    taken = removals(met)
    put = insertions(met.select(F.col("to_path").alias("path"), "at", F.concat(F.lit("\n"), "body").alias("text")))
    return taken.union(put)


def insert_after_symbol(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edits that put text behind the first symbol of wanted(path, name, text)."""
    last = symbols.groupBy("path", "name").agg(F.min_by("end_byte", "start_byte").alias("at"))
    return insertions(wanted.join(last, ["path", "name"]).select("path", "at", F.concat(F.lit("\n"), "text").alias("text")))


def insert_inside(lines: DataFrame, symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, before_line, text) for wanted(path, name, text): the text before the last line of a container, each of its lines indented as the
    container's first inner line, or one step more than its head where it has none."""
    first = symbols.groupBy("path", "name").agg(F.min_by(F.struct("start_line", "end_line"), "start_line").alias("s")).select("path", "name", "s.*")
    rows = wanted.join(first, ["path", "name"])
    indent = F.regexp_extract("line_text", r"^([ \t]*)", 1)
    near = rows.join(lines.select("path", F.col("line").alias("at"), F.col("text").alias("line_text")), "path").where("at BETWEEN start_line AND end_line")
    seen = near.groupBy("path", "name", "text", "end_line").agg(F.min_by(F.when((F.col("at") > F.col("start_line")) & (F.col("at") < F.col("end_line")) & (F.trim("line_text") != ""), indent), F.when((F.col("at") > F.col("start_line")) & (F.col("at") < F.col("end_line")) & (F.trim("line_text") != ""), F.col("at"))).alias("inner"), F.min_by(indent, "at").alias("head"))
    lead = F.coalesce("inner", F.concat("head", F.lit("    ")))
    return seen.select("path", F.col("end_line").alias("before_line"), F.array_join(F.transform(F.split("text", "\n"), lambda x: F.concat(lead, x)), "\n").alias("text"))


def near_matches(files: DataFrame, wanted: str, like: float = 0.6) -> DataFrame:
    """(path, why) for files that lack a text: what in them comes near it, the first that holds of: white space differs, indentation
    differs, its first line is there, some line is alike by bigrams."""
    first = wanted.split("\n")[0].strip()
    squeeze = lambda x: " ".join(x.split())
    bare = lambda c: F.array_join(F.transform(F.split(c, "\n"), lambda x: F.ltrim(x)), "\n")
    rows = files.where(~F.contains("content", F.lit(wanted))).select("path", "content")
    low = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(first) - 1))), lambda i: F.substring(F.lit(first), i, F.lit(2)))
    # bigrams with their numbers, so that repeated ones count as often as both have them
    numbered = lambda g: F.transform(g, lambda x, i: F.concat(x, F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).cast("string")))
    dice = lambda x: 2 * F.size(F.array_intersect(numbered(bigrams(x)), numbered(low))) / F.greatest(F.length(x) + len(first) - 2, F.lit(1))
    alike = F.exists(F.split("content", "\n"), lambda x: dice(F.trim(x)) >= like) if len(first) > 1 else F.lit(False)
    why = F.when(F.contains(squeezed(F.col("content")), F.lit(squeeze(wanted))), "white space").when(F.contains(bare(F.col("content")), F.lit("\n".join(x.lstrip() for x in wanted.split("\n")))), "indentation")
    return rows.select("path", why.when(F.contains("content", F.lit(first)), "first line").when(alike, "alike").otherwise("nothing").alias("why"))


def ambiguous_matches(lines: DataFrame, symbols: DataFrame, wanted: str) -> DataFrame:
    """(path, line, name): lines that hold a text found more than once in their file, with the smallest symbol around each."""
    hits = lines.where(F.contains("text", F.lit(wanted))).select("path", "line")
    many = hits.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    rows = hits.join(many, "path", "left_semi")
    around = rows.join(symbols.select("path", "name", "start_line", "end_line"), "path").where("line BETWEEN start_line AND end_line")
    best = around.groupBy("path", "line").agg(F.min_by("name", F.struct((F.col("end_line") - F.col("start_line")).alias("n"), F.col("start_line"))).alias("name"))
    return rows.join(best, ["path", "line"], "left")


def lcs_lines(pairs: DataFrame) -> DataFrame:
    """(path, old_line, new_line) of a longest common subsequence of lines of pairs(path, old, new). Alignment has no relational form, so Arrow
    batches go through dynamic programming over the lines that remain when equal ends are taken off."""

    def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
        lo = 0
        while lo < min(len(a), len(b)) and a[lo] == b[lo]:
            lo += 1
        hi = 0
        while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
            hi += 1
        x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        out, i, j = [(k, k) for k in range(lo)], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((lo + i, lo + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
        return out + [(len(a) - hi + k, len(b) - hi + k) for k in range(hi)]

    def run(batches):
        for batch in batches:
            rows = [(p, i + 1, j + 1) for p, o, n in zip(batch.path, batch.old, batch.new, strict=True) for i, j in align(o.split("\n"), n.split("\n"))]
            yield pd.DataFrame(rows, columns=["path", "old_line", "new_line"])

    return pairs.select("path", "old", "new").mapInPandas(run, "path string, old_line int, new_line int")


def insert_at_line(content: Column, line: int, text: str) -> Column:
    """text as lines before line `line` (1 is the first)."""
    parts = F.split(content, "\n", -1)
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(line - 1)), F.split(F.lit(text), "\n", -1), F.slice(parts, F.lit(line), F.greatest(F.size(parts), F.lit(1)))), "\n")


def replace_lines(content: Column, first: int, last: int, text: str) -> Column:
    parts = F.split(content, "\n", -1)
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.lit(first - 1)), F.split(F.lit(text), "\n", -1), F.slice(parts, F.lit(last + 1), F.greatest(F.size(parts), F.lit(1)))), "\n")


def bigrams(text: Column) -> Column:
    return F.when(F.length(text) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(2))))


def bigram_similarity(pairs: DataFrame) -> DataFrame:
    """(id, similarity) of pairs(id, a, b): Dice coefficient of bigrams with their counts."""
    count = lambda c: pairs.select("id", F.explode(bigrams(F.col(c))).alias("g")).groupBy("id", "g").agg(F.count("*").alias(f"n_{c}"))
    common = count("a").join(count("b"), ["id", "g"]).groupBy("id").agg(F.sum(F.least("n_a", "n_b")).alias("common"))
    sizes = pairs.select("id", (F.length("a") + F.length("b") - 2).alias("total"))
    return sizes.join(common, "id", "left").select("id", F.when(F.col("total") > 0, 2 * F.coalesce("common", F.lit(0)) / F.col("total")).otherwise(0.0).alias("similarity"))


def unified_diff(pairs: DataFrame) -> DataFrame:
    """(path, diff) of pairs(path, old, new); sequence alignment has no relational form, so Arrow batches go to difflib."""

    def run(batches):
        for b in batches:
            diffs = ["".join(difflib.unified_diff(o.splitlines(True), n.splitlines(True), f"a/{p}", f"b/{p}")) for p, o, n in zip(b.path, b.old, b.new, strict=True)]
            yield pd.DataFrame({"path": b.path, "diff": diffs})

    return pairs.select("path", "old", "new").mapInPandas(run, "path string, diff string")


def doc_comment_starts(lines: DataFrame, heads: DataFrame, mark: str) -> DataFrame:
    """(path, line, first): for each head line the first of the comment lines right above it: gaps and islands."""
    rows = lines.withColumn("comment", F.ltrim("text").startswith(mark))
    island = rows.withColumn("group", F.col("line") - F.row_number().over(Window.partitionBy("path", "comment").orderBy("line"))).where("comment")
    blocks = island.groupBy("path", "group").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return heads.join(blocks, (heads.path == blocks.path) & (heads.line == blocks["last"] + 1), "left").select(heads.path, heads.line, F.coalesce("first", heads.line).alias("first"))


def error_places(output: DataFrame) -> DataFrame:
    """(path, line) of `file:line` marks in the lines of a build's output (text)."""
    found = output.select(F.regexp_extract("text", r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+):(\d+)", 1).alias("path"), F.regexp_extract("text", r"([A-Za-z0-9_./-]+\.[A-Za-z0-9]+):(\d+)", 2).alias("line"))
    return found.where("path <> ''").select("path", F.col("line").cast("long").alias("line"))
