"""Import and reference graphs: edges(importer, imported), refs(sym_id, path, name_lc)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.scratch import scratch, written

#: Names with more definitions than this are skipped when callees and dependencies are looked up.
MOST_DEFINITIONS = 5


def import_graph(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Distinct edges between known files, no loops."""
    known = files.select("path")
    return raw.join(known.withColumnRenamed("path", "importer"), "importer").join(known.withColumnRenamed("path", "imported"), "imported").where("importer <> imported").select("importer", "imported").distinct()


def in_degree(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, inbound) of every file, 0 if none imports it."""
    counts = edges.groupBy(F.col("imported").alias("path")).agg(F.count("*").alias("inbound"))
    return files.select("path").join(counts, "path", "left").select("path", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def importers(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("imported") == path).select(F.col("importer").alias("path"))


def imports(edges: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("importer") == path).select(F.col("imported").alias("path"))


def suffixes(files: DataFrame) -> DataFrame:
    """(suffix, path) of every file: the path without its first 0, 1, ... segments."""
    parts = F.split("path", "/")
    rows = files.select("path", parts.alias("parts"))
    return rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "/"))).alias("suffix"), "path")


def candidate_suffixes(raw: DataFrame, rules: DataFrame) -> DataFrame:
    """(importer, raw, priority, suffix): rules(lang, priority, head, tail) put head and tail around the raw import."""
    return raw.join(F.broadcast(rules), "lang").select("importer", "raw", "priority", F.concat("head", "raw", "tail").alias("suffix"))


def resolved_imports(candidates: DataFrame, suffix_rows: DataFrame) -> DataFrame:
    """All targets of the first candidate suffix that some file has."""
    hits = candidates.join(suffix_rows, "suffix")
    first = hits.groupBy("importer", "raw").agg(F.min("priority").alias("priority"))
    return hits.join(first, ["importer", "raw", "priority"]).select("importer", "raw", F.col("path").alias("imported")).distinct()


def reference_graph(tokens: DataFrame) -> DataFrame:
    """(sym_id, path, name_lc) once each from tokens(sym_id, path, own, token); a symbol does not refer to its own name."""
    return tokens.select("sym_id", "path", F.lower("token").alias("name_lc"), "own").where("name_lc <> own").drop("own").distinct()


def callers_by_name(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(F.col("name_lc") == name.lower()).select("sym_id", "path")


def callee_names(refs: DataFrame, sym_id: str) -> DataFrame:
    return refs.where(F.col("sym_id") == sym_id).select("name_lc")


def callees(refs: DataFrame, symbols: DataFrame, sym_ids: DataFrame) -> DataFrame:
    """(caller, path, name) that symbols refer to; names with more than MOST_DEFINITIONS definitions say nothing."""
    names = symbols.groupBy(F.lower("name").alias("name_lc")).agg(F.count("*").alias("n")).where(F.col("n") <= MOST_DEFINITIONS).select("name_lc")
    mine = refs.join(sym_ids, "sym_id").select(F.col("sym_id").alias("caller"), "name_lc").join(names, "name_lc")
    return mine.join(symbols.select(F.lower("name").alias("name_lc"), "path", "name"), "name_lc").select("caller", "path", "name").distinct()


def text_callers(symbols: DataFrame, name: str, defined_in: str, edges: DataFrame) -> DataFrame:
    """Symbols whose body holds a name and whose file is the definition's, or imports it."""
    reach = importers(edges, defined_in).union(edges.sparkSession.range(1).select(F.lit(defined_in).alias("path"))).distinct()
    return symbols.where(F.contains("body", F.lit(name)) & (F.col("name") != name)).join(reach, "path", "left_semi").select("sym_id", "path")


def same_file_callers(symbols: DataFrame, name: str, path: str) -> DataFrame:
    return symbols.where((F.col("path") == path) & F.contains("body", F.lit(name)) & (F.col("name") != name)).select("sym_id")


def dependencies(symbols: DataFrame, refs: DataFrame, sym_ids: DataFrame, k: int = 10) -> DataFrame:
    """(caller, path, name, distance, place): what symbols depend on, symbols of their own file first, then by path distance; k a caller."""
    own = symbols.select(F.col("sym_id").alias("caller"), F.col("path").alias("from_path"))
    rows = callees(refs, symbols, sym_ids).join(own, "caller").withColumn("distance", C.path_distance("from_path", "path"))
    w = Window.partitionBy("caller").orderBy((F.col("path") == F.col("from_path")).desc(), "distance", "path", "name")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("caller", "path", "name", "distance", "place")


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node): everything that an undirected chain of edges(a, b) reaches from seeds(seed). Rounds of joins, each
    written to the session's checkpoint folder, until a round finds nothing new."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    found = []  # each node once, in the round that meets it
    with scratch(edges.sparkSession):
        links = written(both, "links")
        found.append(written(seeds.select("seed", F.col("seed").alias("node")).distinct(), "found", keep=True))
        while not found[-1].isEmpty():
            step = found[-1].join(links, F.col("node") == links.a).select("seed", F.col("b").alias("node")).distinct()
            for old in found[-2:]:  # a neighbour of the last round's nodes was met then, just before, or never
                step = step.join(old, ["seed", "node"], "left_anti")
            found.append(written(step, "found", keep=True))
    out = found[0]
    for more in found[1:-1]:
        out = out.union(more)
    return out


def export_chain(edges: DataFrame, depth: int = 8) -> DataFrame:
    """(start, target, hops): follow re-exports(a, b) up to a depth to names that re-export nothing. A visited list stops circles."""
    rows = edges.select(F.col("a").alias("start"), F.col("b").alias("target"), F.lit(1).alias("hops"), F.array("a", "b").alias("seen"))
    out = rows
    for _ in range(depth - 1):
        rows = rows.join(edges, rows.target == edges.a).where(~F.array_contains("seen", F.col("b"))).select("start", F.col("b").alias("target"), (F.col("hops") + 1).alias("hops"), F.concat("seen", F.array("b")).alias("seen"))
        out = out.union(rows)
    return out.join(edges.select(F.col("a").alias("target")).distinct(), "target", "left_anti").select("start", "target", "hops")


def satisfied(needs: DataFrame, methods: DataFrame) -> DataFrame:
    """(interface, receiver): receivers that have every method of an interface: division by counting matches.
    needs(interface, method), methods(receiver, method)."""
    sizes = needs.distinct().groupBy("interface").agg(F.count("*").alias("n"))
    have = needs.distinct().join(methods.distinct(), "method").groupBy("interface", "receiver").agg(F.count("*").alias("m"))
    return have.join(sizes, "interface").where("m = n").select("interface", "receiver")


def sibling_implementers(needs: DataFrame, methods: DataFrame, receiver: str) -> DataFrame:
    """Other receivers that satisfy an interface which `receiver` satisfies."""
    sat = satisfied(needs, methods)
    mine = sat.where(F.col("receiver") == receiver).select("interface")
    return sat.join(mine, "interface").where(F.col("receiver") != receiver).select("interface", "receiver")


def callers_with_fallback(symbols: DataFrame, refs: DataFrame, edges: DataFrame, files: DataFrame, names: DataFrame) -> DataFrame:
    """(name_lc, n): for each of names(name_lc) how many symbols refer to it; where none does, how many files have the word at all."""
    known = refs.groupBy("name_lc").agg(F.count("*").alias("by_refs"))
    words = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("content"), F.lit("[a-z0-9_]{2,}"), F.lit(0)))).alias("name_lc"))
    open_names = names.join(known.select("name_lc"), "name_lc", "left_anti")
    text = words.join(open_names, "name_lc", "left_semi").groupBy("name_lc").agg(F.count("*").alias("by_text"))
    return names.join(known, "name_lc", "left").join(text, "name_lc", "left").select("name_lc", F.coalesce("by_refs", "by_text", F.lit(0)).cast("long").alias("n"))


def narrowed(imports_: DataFrame, defines: DataFrame, used: DataFrame) -> DataFrame:
    """imports(importer, raw, imported) that mean several files: those that define a name the importer uses, or else the first."""
    hits = imports_.join(defines.select(F.col("path").alias("imported"), "name"), "imported").join(used.select(F.col("path").alias("importer"), "name"), ["importer", "name"]).select("importer", "raw", "imported").distinct()
    none = imports_.join(hits.select("importer", "raw").distinct(), ["importer", "raw"], "left_anti").groupBy("importer", "raw").agg(F.min("imported").alias("imported"))
    return hits.union(none)
