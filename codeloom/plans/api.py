"""The engine's face: one object over a tree or a table of files, whose methods give DataFrames.

    repo = Repo.of_tree(spark, "/shared/tree")
    repo.files("literal or regex"); repo.search("text"); repo.focus("Name"); repo.callers("Name"); repo.rename("old", "new")

Everything is lazy but for routing: `focus` falls back to text where no symbol has the name."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import bindings, parsers, scopes
from codeloom.operators import edits, graph, linking, overview, symbols, text
from codeloom.plans import patterns
from codeloom.sources.repo import read_repo


class Repo:
    def __init__(self, files: DataFrame, postings: DataFrame | None = None):
        """files: path and content (text or bytes). postings: those of a stored index of the same files; searches that can meet it first do, with
        equal results."""
        self.spark, self.postings = files.sparkSession, postings
        kind = dict(files.dtypes)["content"]
        self.bytes = files.select("path", F.col("content").cast("binary").alias("content")) if kind == "string" else files.select("path", "content")
        self.table = files.select("path", F.decode("content", "UTF-8").alias("content") if kind == "binary" else F.col("content"))

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str, directory: str = "") -> Repo:
        return cls(read_repo(spark, root, directory).cache())

    @cached_property
    def symbols(self) -> DataFrame:
        return parsers.parse_symbols(self.bytes).cache()

    @cached_property
    def refs(self) -> DataFrame:
        rows = self.symbols.select("sym_id", "path", F.lower("name").alias("own"), F.explode(text.identifiers(F.col("body"))).alias("token"))
        return graph.reference_graph(rows)

    @cached_property
    def edges(self) -> DataFrame:
        """Imports whose last parts, as a path with or without the importer's extension, some file ends in."""
        raw = parsers.parse_imports(self.bytes).withColumn("ext", F.regexp_extract("path", r"(\.[^./]+)$", 1))
        plain = F.regexp_replace(F.regexp_replace("raw", r"^(?:\./|\.\./)+", ""), r"::|\\", "/")
        dotted = F.when(F.col("ext").isin(".py", ".java", ".kt", ".scala"), F.regexp_replace(plain, r"\.", "/")).otherwise(plain)
        wanted = raw.select(F.col("path").alias("importer"), "raw", F.posexplode(F.array(dotted, F.concat(dotted, "ext"), F.concat(dotted, F.lit("/__init__.py")), F.concat(dotted, F.lit("/index"), "ext"))).alias("priority", "suffix"))
        found = graph.resolved_imports(wanted, graph.suffixes(self.table))
        return found.where("importer <> imported").select("importer", "imported").distinct()

    def files(self, pattern: str, regex: bool = False, glob: str | None = None, budget: int | None = None) -> DataFrame:
        out = text.find_files(self.table, pattern, regex, glob, self.postings)
        if not regex and patterns.has_alternation(pattern) and out.isEmpty():
            again = text.find_files(self.table, pattern, True, glob, self.postings)
            out = out if again.isEmpty() else again
        return text.budgeted(out, budget) if budget else out

    def search(self, pattern: str, **options) -> DataFrame:
        return text.search_lines(self.table, pattern, **options)

    def orient(self, budget: int = 2000, directory: str | None = None, kind: str | None = None, grep: str | None = None) -> DataFrame:
        inbound = self.edges.groupBy(F.col("imported").alias("path")).agg(F.count("*").alias("inbound"))
        return overview.overview(symbols.filtered(self.symbols, directory, kind, grep), inbound, budget)

    def focus(self, name: str, k: int = 10) -> DataFrame:
        """Ranked definitions of a name; snake case is tried too, and then text."""
        inbound = graph.in_degree(self.table, self.edges)
        found = symbols.shortlist(symbols.ranked(self.symbols, name, inbound, k), k)
        if found.isEmpty():
            snake = patterns.re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
            found = symbols.shortlist(symbols.ranked(self.symbols, snake, inbound, k), k)
        return self.search(name) if found.isEmpty() else found.select("path", "name", "kind", "start_line", "end_line", "score", "rank", "body")

    def callers(self, name: str) -> DataFrame:
        return graph.callers_by_name(self.refs, name)

    def callees(self, name: str) -> DataFrame:
        return graph.callees(self.refs, self.symbols, symbols.by_name(self.symbols, name).select("sym_id"))

    def usages(self, name: str) -> DataFrame:
        return text.word_spans(self.table, name)

    def similar(self, name: str) -> DataFrame:
        return symbols.similar_names(self.symbols, name)

    @cached_property
    def scoped(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Scopes, declarations and references of all files."""
        return tuple(x.cache() for x in scopes.parse_scopes(self.bytes))

    @cached_property
    def modules(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What files bring in, what package they are part of, what they export by default."""
        return tuple(f(self.bytes).cache() for f in (bindings.parse_bindings, bindings.parse_packages, bindings.parse_default_exports))

    @cached_property
    def links(self) -> DataFrame:
        return linking.links(*self.scoped, *self.modules).cache()

    def declarations(self, name: str, path: str | None = None) -> DataFrame:
        """Declarations of a name but imports and locals: those of a file's own scope, or of a class in it."""
        rows = self.scoped[1].where((F.col("name") == name) & ~F.col("kind").isin("import", "variable", "parameter"))
        return rows if path is None else rows.where(F.col("path") == path)

    def references(self, name: str, path: str | None = None) -> DataFrame:
        """References to the declarations of a name, in their files and across files, with how sure they are."""
        return linking.references_to(self.declarations(name, path), *self.scoped, self.links)

    def insert_after(self, path: str, name: str, new: str) -> DataFrame:
        """The file as it would be with text behind a symbol."""
        wanted = self.spark.createDataFrame([(path, name, new)], "path string, name string, text string")
        return edits.spliced(self.table, edits.insert_after_symbol(self.symbols, wanted))

    def replace(self, path: str, old: str, new: str, symbol: str | None = None) -> DataFrame:
        """The file as it would be with a text replaced, which it (or its symbol) must hold exactly once; else why not."""
        here = self.table.where(F.col("path") == path)
        if symbol is None:
            out = edits.replace_once(here, old, new)
        else:
            out = edits.replace_in_symbol(here, symbols.by_name(self.symbols, symbol).where(F.col("path") == path).orderBy("start_line").limit(1), old, new)
        return out if out.where("n = 1").count() else edits.near_matches(here, old)

    def rename(self, old: str, new: str, path: str | None = None, force: bool = False, text_only: bool = False) -> DataFrame:
        """Files as they would be; nothing is written. The declaration of the name (in the file, where several have one), what is bound to it and
        the import clauses that name it change, and neither comments nor other declarations of the name; with text_only every whole word does.
        Too large a rename is refused unless forced."""
        if text_only:
            rows = edits.rename_edits(self.usages(old), new)
        else:
            found = self.declarations(old, path)
            if found.select("path").distinct().count() != 1:
                raise ValueError(f"{old} is declared in no file or in several; give the path of one, or text_only=True")
            spans = linking.rename_spans(found, *self.scoped, *self.modules)
            rows = edits.rename_edits(spans.select("path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end")), new)
        if not edits.rename_gate(rows, force).first().allowed:
            raise ValueError(f"{old} occurs in more than {edits.MOST_FILES} files or {edits.MOST_OCCURRENCES} times; pass force=True")
        return edits.spliced(self.table, rows)
