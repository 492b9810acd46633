"""Overview, budgets and the ledger of classified occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators.symbols import importance, numbered
from codeloom.plans.patterns import glob_regex

#: Characters a symbol line is taken to cost when caps are set.
LINE_COST = 45


def visible(symbols: DataFrame) -> DataFrame:
    """symbols without locals: those that start and end within some function, method or variable of their file.

    An interval test without a self-join: over the symbols by start, the furthest end among functions that started before."""
    holder = F.col("kind").isin("function", "method", "variable") & (F.col("start_line") < F.col("end_line"))
    w = Window.partitionBy("path").orderBy("start_line").rangeBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(holder, F.col("end_line"))).over(w)
    return symbols.withColumn("reach", reach).where("reach IS NULL OR end_line > reach").drop("reach")


def overview(symbols: DataFrame, inbound: DataFrame, budget: int, by: str = "inbound") -> DataFrame:
    """(path, name, kind, start_line, place, spent): lines of the overview that a token budget shows.

    Files in order, the most important symbols of each up to a cap; a line shows while what came before is under the
    budget. Only as many files as the budget can name are numbered and summed."""
    rows = visible(symbols)
    est = budget * 4 // LINE_COST
    order = rows.groupBy("path").agg(F.count("*").alias("n_symbols")).join(inbound, "path", "left").withColumns({"inbound": F.coalesce("inbound", F.lit(0)), "depth": F.size(F.split("path", "/"))})
    keys = [F.desc("inbound"), F.desc("n_symbols"), "depth", "path"] if by == "inbound" else ["depth", F.desc("inbound"), "path"]
    n_files = order.count()
    if by == "inbound":
        cap = max(2, est // max(2, min(n_files, est // 2)))
    else:
        cap = 1 << 30 if n_files == 1 else 1 if est < n_files else max(2, est // n_files)
    first = order.orderBy(*keys).limit(budget * 4).withColumn("place", F.row_number().over(Window.orderBy(*keys)))
    span = F.col("end_line") - F.col("start_line") + 1
    w = Window.partitionBy("path").orderBy(F.desc("importance"), "start_line")
    top = rows.join(first.select("path", "place"), "path").withColumn("importance", importance(F.col("kind"), span)).withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap)
    line = F.length(F.concat(F.lit("  "), "kind", F.lit(" "), "name", F.lit(" ["), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("]\n")))
    cost = line + F.when(F.col("k") == 1, F.length("path") + 2).otherwise(0)
    top = top.withColumn("cost", cost).where(F.col("place") <= budget * 4)
    before = F.coalesce(F.sum("cost").over(Window.orderBy("place", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return top.withColumn("spent", before).where(F.col("spent") < budget * 4).select("path", "name", "kind", "start_line", F.col("place").cast("long").alias("place"), F.col("spent").cast("long").alias("spent"))


def directory_summary(symbols: DataFrame) -> DataFrame:
    """(dir, n_files, n_symbols) by first path component, '.' for files at the root."""
    top = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise(".")
    return symbols.groupBy(top.alias("dir")).agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("n_symbols"))


def cut_at_line(text: Column, most: int) -> Column:
    """text up to its last newline within `most` characters; all of a shorter one; without a newline, `most` characters."""
    head = F.substring(text, 1, most)
    last = F.instr(F.reverse(head), "\n")
    return F.when(F.length(text) <= most, text).when(last > 0, F.substring(head, F.lit(1), most - last)).otherwise(head)


def read_range(lines: DataFrame, path: str, start: int, end: int) -> DataFrame:
    return lines.where((F.col("path") == path) & F.col("line").between(start, end))


def is_code(path: Column) -> Column:
    from codeloom.schema import LANGUAGE_OF

    return C.extension(path).isin(list(LANGUAGE_OF))


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests?|testdata|bench|spec)(/|$)|_test\.|\.test\.|\.spec\.|(^|/)test_")


def shared_budgets(n: int, budget: int) -> int:
    """What each of n reads gets of a common budget."""
    return max(50, min(budget, 2 * budget // (n + 1)))


def site_key(file: Column, start: Column, end: Column, tier: Column, old: Column) -> Column:
    return F.sha2(F.concat_ws("\0", F.lit("v1"), file, start.cast("string"), end.cast("string"), tier, old).cast("binary"), 256)


def ledger_filter(sites: DataFrame, tier: list[str] | None = None, path_glob: str | None = None, role: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Sites that pass all given predicates, and how many of each tier do not."""
    ok = F.lit(True)
    if tier:
        ok = ok & F.col("tier").isin(tier)
    if role:
        ok = ok & F.col("role").isin(role)
    if path_glob:
        ok = ok & F.col("path").rlike(glob_regex(path_glob))
    return sites.where(ok), sites.where(~ok).groupBy("tier").agg(F.count("*").alias("n"))


def short_ids(sites: DataFrame) -> DataFrame:
    """sites with short_id: the tier's first letter and the number within it in order of path and start. All sites are numbered by a sort over
    all partitions; each tier counts from its own first number."""
    rows = numbered(sites, "tier", "path", "start")
    starts = rows.groupBy("tier").agg(F.min("rank").alias("first"))
    return rows.join(starts, "tier").withColumn("short_id", F.concat(F.substring("tier", 1, 1), (F.col("rank") - F.col("first") + 1).cast("string"))).drop("rank", "first")


def invalid_sites(sites: DataFrame) -> DataFrame:
    """Sites that break the ledger's rules: malformed spans, or a place that two of them claim."""
    bad = sites.where("start >= end_byte").select("path", "start", F.lit("malformed span").alias("fault"))
    twice = sites.groupBy("path", "start").agg(F.count("*").alias("n")).where("n > 1").select("path", "start", F.lit("claimed twice").alias("fault"))
    return bad.union(twice)


def common_directories(paths: DataFrame, *groups: str) -> DataFrame:
    """(groups, directory): the longest directory that all paths of a group share, from the least and the greatest path."""
    ends = paths.groupBy(*groups).agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    a, b = F.split(F.regexp_replace("lo", "/?[^/]*$", ""), "/"), F.split(F.regexp_replace("hi", "/?[^/]*$", ""), "/")
    return ends.select(*groups, F.array_join(F.slice(a, F.lit(1), C.common_parts(a, b).cast("int")), "/").alias("directory"))


def next_actions(sites: DataFrame, command: str) -> DataFrame:
    """(place, action) that the counts of a ledger's tiers leave open: apply what is definite, review what is probable, look at mentions."""
    n = {t: F.sum((F.col("tier") == t).cast("long")) for t in ("definite", "probable", "mention")}
    sums = sites.agg(*(F.coalesce(v, F.lit(0)).alias(k) for k, v in n.items()))
    text = lambda t, verb, flag: F.when(F.col(t) > 0, F.concat(F.lit(f"{verb} "), F.col(t).cast("string"), F.lit(f": {command} {flag}")))
    rows = F.array(text("definite", "apply", "--apply"), text("probable", "review", "--tier probable"), text("mention", "read", "--tier mention"))
    return sums.select(F.posexplode(rows).alias("place", "action")).where("action IS NOT NULL")


def envelope_summary(results: DataFrame) -> DataFrame:
    """(op, n, n_failed) of results(op, ok)."""
    return results.groupBy("op").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("long")).alias("n_failed"))


def aggregated_status(reports: DataFrame) -> DataFrame:
    """One row a component: its worst level and how many reports said so. reports(component, level), 0 is well."""
    worst = reports.groupBy("component").agg(F.max("level").alias("level"))
    return worst.join(reports, ["component", "level"]).groupBy("component", "level").agg(F.count("*").alias("n"))
