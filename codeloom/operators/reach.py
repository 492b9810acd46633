"""Whether an import can mean a file, by language: expressions over (raw, importer, target).

A file reaches itself and its directory's files of the same language family; else some import must reach the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import columns as C

#: Languages that can import each other.
FAMILIES = {"js": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx"], "jvm": [".java", ".kt", ".kts", ".scala"], "c": [".c", ".h", ".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"], "go": [".go"], "python": [".py", ".pyi"], "rust": [".rs"], "ruby": [".rb"], "csharp": [".cs"], "php": [".php"], "swift": [".swift"]}
_bare = lambda path: F.regexp_replace(path, r"\.[^./]+$", "")  # noqa: E731  without extension


def ends_with_path(whole: Column, tail: Column) -> Column:
    """Whether tail is the last segments of whole."""
    return (tail != "") & F.concat(F.lit("/"), whole).endswith(F.concat(F.lit("/"), tail))


def family(path: Column) -> Column:
    out, ext = F.lit(None).cast("string"), C.extension(path)
    for name, exts in FAMILIES.items():
        out = F.coalesce(out, F.when(ext.isin(exts), name))
    return out


def go(raw: Column, target: Column) -> Column:
    """As many last segments as the shorter of import path and target directory has; plain names are of the standard library."""
    a, b = F.reverse(F.split(raw, "/")), F.reverse(F.split(C.dirname(target), "/"))
    n = F.least(F.size(a), F.size(b))
    return raw.rlike("[./]") & (C.dirname(target) != "") & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))


def joined_path(directory: Column, relative: Column) -> Column:
    """directory/relative with `.` and `..` resolved."""
    parts = F.filter(F.split(F.concat_ws("/", F.when(directory != "", directory), relative), "/"), lambda x: (x != ".") & (x != ""))
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def js(raw: Column, importer: Column, target: Column) -> Column:
    """Relative: the resolved path, with an extension or as a folder's index; bare: a segment of the target is the package."""
    full = joined_path(C.dirname(importer), raw)
    relative = (target == full) | (_bare(target) == full) | (_bare(target) == F.concat(full, F.lit("/index"))) | (_bare(target) == _bare(full))
    package = F.regexp_extract(raw, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(raw.startswith("."), relative).otherwise(F.array_contains(F.split(target, "/"), package))


def dotted(raw: Column, target: Column) -> Column:
    """JVM, C#, PHP, Swift: the import as a path, or without its last part, ends the target's path or directory, without case."""
    path = F.lower(F.regexp_replace(F.regexp_replace(raw, r"\.\*$", ""), r"[.\\]", "/"))
    low, parent = F.lower(_bare(target)), F.regexp_replace(path, "/[^/]*$", "")
    return ends_with_path(low, path) | ends_with_path(C.dirname(F.lower(target)), path) | (F.contains(path, F.lit("/")) & ends_with_path(C.dirname(F.lower(target)), parent))


def python(raw: Column, importer: Column, target: Column) -> Column:
    """Absolute modules end the target's path; leading dots start from the importer's directory, one up for each dot after the first."""
    module = F.regexp_replace(F.regexp_replace(raw, r"^\.+", ""), r"\.", "/")
    bare = F.regexp_replace(_bare(target), "/__init__$", "")
    dots = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    base = joined_path(C.dirname(importer), F.concat(F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), module))
    return F.when(dots > 0, bare == base).otherwise(ends_with_path(bare, module))


def c_include(raw: Column, target: Column) -> Column:
    return ends_with_path(target, F.regexp_replace(raw, r"^(?:\./|\.\./)+", ""))


def ruby(raw: Column, target: Column) -> Column:
    return ends_with_path(_bare(target), F.regexp_replace(_bare(raw), r"^(?:\./|\.\./)+", ""))


def rust(raw: Column, target: Column) -> Column:
    """Modules of the path after crate, self or super, with or without the last part."""
    path = F.regexp_replace(F.regexp_replace(raw, r"^(?:crate|self|super)::", ""), "::", "/")
    bare = F.regexp_replace(_bare(target), "/(?:mod|lib)$", "")
    return ends_with_path(bare, path) | (F.contains(path, F.lit("/")) & ends_with_path(bare, F.regexp_replace(path, "/[^/]*$", "")))


def import_reaches(raw: Column, importer: Column, target: Column) -> Column:
    f = family(importer)
    return F.when(f == "go", go(raw, target)).when(f == "js", js(raw, importer, target)).when(f.isin("jvm", "csharp", "php", "swift"), dotted(raw, target)).when(f == "python", python(raw, importer, target)).when(f == "c", c_include(raw, target)).when(f == "ruby", ruby(raw, target)).when(f == "rust", rust(raw, target)).otherwise(False)


def reaching(imports: DataFrame, target: str) -> DataFrame:
    """Files of imports(importer, raw) that reach a target file."""
    t, who = F.lit(target), F.col("importer")
    near = (who == t) | ((family(who) == family(t)) & ((C.dirname(who) == C.dirname(t)) | import_reaches(F.col("raw"), who, t)))
    return imports.where(F.coalesce(near, F.lit(False))).select(F.col("importer").alias("path")).distinct()
