"""Binding across files: import targets, links of references to declarations elsewhere, what files see, references to a declaration, rename spans.

Tables, from `functions.scopes` and `functions.bindings`: decls, refs, bindings(path, lang, raw, name, local, kind), packages(path, lang,
package). A module is met by keys: each import asks for a few, in order, each file answers to its own; so links are equi-joins in which no
key stands for more rows than the files of a folder, a package or a path ending have. Declarations that others see are those of file scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators.binding import bind
from codeloom.scratch import free_shuffles, scratch, written

#: Languages whose files see what others of their folder or package declare; those that must also share the package clause.
BY_PACKAGE, BY_FOLDER = ["java", "kotlin", "scala", "csharp", "php"], ["go", "csharp", "swift", "php", "ruby"]
#: Languages in which a rename takes every reference of the name.
BY_NAME = ["lua", "zig"]
#: Re-exports are followed so far.
MOST_HOPS = 8
_SCRIPT = [".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", ""]


def normalised(folder: Column, relative: Column) -> Column:
    """folder/relative without `.` and `..`."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(F.split(F.concat_ws("/", folder, relative), "/"), F.array().cast("array<string>"), step), "/")


def _asked(lang: Column, path: Column, raw: Column, kind: Column) -> Column:
    """The keys that an import asks for, best first."""
    folder = C.dirname(path)
    here = normalised(folder, raw)
    slashed = F.regexp_replace(raw, r"\.", "/")
    keys = lambda prefix, base, ends: [F.concat(F.lit(prefix), base, F.lit(e)) for e in ends]
    up = F.length(F.regexp_extract(raw, r"^(\.*)", 1))
    relative = normalised(folder, F.concat(F.repeat(F.lit("../"), F.greatest(up - 1, F.lit(0))), F.regexp_replace(F.regexp_replace(raw, r"^\.+", ""), r"\.", "/")))
    python = F.when(up > 0, F.array(*keys("path:", relative, [".py", "/__init__.py"]))).otherwise(F.array(*keys("end:", slashed, [".py", "/__init__.py"])))
    head = F.when(kind == "star", raw).otherwise(F.regexp_replace(raw, r"[.\\][^.\\]*$", ""))
    package = F.array(F.concat(F.lit("package:"), lang, F.lit(":"), head))
    parts = F.split(raw, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("folder:"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "^crate", "src"), "^self", ""), "::", "/")
    inside = F.when(raw.startswith("super"), normalised(folder, F.regexp_replace(F.regexp_replace(raw, "^super(::)?", ""), "::", "/"))).otherwise(normalised(F.regexp_replace(path, r"\.rs$", ""), module))
    rust = F.when(raw.startswith("crate"), F.array(*keys("end:", module, [".rs", "/mod.rs"]))).otherwise(F.array(*keys("path:", inside, [".rs", "/mod.rs"])))
    out = F.when(lang.isin("typescript", "javascript"), F.when(raw.startswith("."), F.array(*keys("path:", here, _SCRIPT))).otherwise(F.array(*keys("end:", raw, _SCRIPT[:-1]))))
    out = out.when(lang == "python", python).when(lang == "go", folders).when(lang == "rust", rust).when(lang.isin(BY_PACKAGE), package)
    out = out.when(lang.isin("c", "cpp"), F.array(F.concat(F.lit("path:"), here), F.concat(F.lit("end:"), raw)))
    out = out.when(lang == "ruby", F.array(F.concat(F.lit("path:"), here, F.lit(".rb")), F.concat(F.lit("end:"), raw, F.lit(".rb"))))
    return out.when(lang == "lua", F.array(*keys("end:", slashed, [".lua", "/init.lua"]))).when(lang == "zig", F.array(F.concat(F.lit("path:"), here))).otherwise(F.array().cast("array<string>"))


def module_keys(packages: DataFrame) -> DataFrame:
    """(target, key): what each file answers to: its path, all endings of it, all endings of its folder, its package."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("end:"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    last = F.size(parts) - 1
    folders = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit("folder:"), F.array_join(F.slice(parts, i, F.greatest(last - i + 1, F.lit(0))), "/")))
    folders = F.when((F.col("lang") == "go") & ~F.col("path").endswith("_test.go") & (last > 0), folders).otherwise(F.array().cast("array<string>"))
    package = F.when(F.col("package").isNotNull(), F.concat(F.lit("package:"), "lang", F.lit(":"), "package"))
    keys = F.concat(ends, folders, F.array(F.concat(F.lit("path:"), "path")), F.array_compact(F.array(package)))
    return packages.select(F.col("path").alias("target"), F.explode(keys).alias("key"))


def _folders(path: Column) -> Column:
    """The folders round a file, each with how many parts it has, from the root on."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("folder"), i.alias("m")))


def import_targets(bindings: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, raw, target): the files that an import means: those of the first key that any file answers to; of files or folders that only
    end alike the nearest to the importer, then that with the shortest path, then the first.

    A key that many files answer to never meets all who ask for it: that it is answered, and by whom if by one, is known by its first and last
    file; the nearest unit (a file or folder) is the best of any folder round the importer, which keeps its two best: one may be the importer's own."""
    with scratch(bindings.sparkSession):
        packages = written(packages.select("path", "lang", "package"), "packages")
        asked = bindings.select("path", "raw", F.posexplode(_asked(F.col("lang"), F.col("path"), F.col("raw"), F.col("kind"))).alias("place", "key")).distinct()
        asked = written(asked, "asked")
        forms = asked.select(_form(F.col("key")).alias("form")).distinct()  # a few kinds of keys, and as many lengths as paths have
        keys = module_keys(packages).where(_form(F.col("key")).isin([r.form for r in forms.collect()]))
        met = asked.join(keys.groupBy("key").agg(F.min("target").alias("lo"), F.max("target").alias("hi")), "key").where("lo <> path OR hi <> path")
        met = written(met.withColumn("first", F.min("place").over(Window.partitionBy("path", "raw"))).where("place = first").drop("place", "first"), "met")
        out = met.where("lo = hi").select("path", "raw", F.col("lo").alias("target"))
        several = met.where("lo <> hi").select("path", "raw", "key")
        if not several.isEmpty():
            alike = F.col("key").startswith("end:") | F.col("key").startswith("folder:")
            whole = several.where(~alike).join(keys.where(~alike), "key").where("target <> path").select("path", "raw", "target")
            near = several.where(alike)
            unit = F.when(F.col("key").startswith("folder:"), C.dirname("target")).otherwise(F.col("target"))
            held = written(keys.where(alike).join(near.select("key").distinct(), "key", "left_semi").withColumn("unit", unit), "held")
            units = held.groupBy("key", "unit").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
            units = units.select("*", F.length("unit").alias("n"), F.size(F.split("lo", "/")).alias("deep"), F.inline(_folders(F.col("lo"))))
            place = F.row_number().over(Window.partitionBy("key", "folder").orderBy("deep", "n", "unit"))
            best = units.withColumn("place", place).where("place <= 2").select("key", "folder", "unit", "n", "deep", "lo", "hi")
            around = near.select("*", F.size(F.split("path", "/")).alias("size"), F.inline(_folders(F.col("path"))))
            far = F.col("size") + F.col("deep") - 2 * F.col("m")
            found = around.join(best, ["key", "folder"]).where("lo <> path OR hi <> path").groupBy("path", "raw", "key").agg(F.min(F.struct(far.alias("far"), "n", "unit"))["unit"].alias("unit"))
            out = out.union(whole).union(found.join(held, ["key", "unit"]).where("target <> path").select("path", "raw", "target"))
        return written(out.distinct(), "targets", keep=True)


def _form(key: Column) -> Column:
    """The kind of a key and, of endings, how many parts it has."""
    kind = F.substring_index(key, ":", 1)
    return F.when(kind.isin("end", "folder"), F.concat(kind, F.length(F.regexp_replace(key, "[^/]", "")).cast("string"))).otherwise(kind)


def exports(scopes: DataFrame, decls: DataFrame, bindings: DataFrame, targets: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(target, name, decl_id): what files show: their declarations in the scope of the file or of a name space, default exports as 'default', and re-exports, followed MOST_HOPS
    times at most. Of declarations of one name the first."""
    outer = scopes.where("kind IN ('file', 'namespace')").select("path", "scope_id")
    own = decls.where("kind <> 'import' AND NOT (kind = 'module' AND path LIKE '%.cs')").join(outer, ["path", "scope_id"], "left_semi").groupBy(F.col("path").alias("target"), "name").agg(F.min_by("decl_id", "ord").alias("decl_id"))
    if defaults is not None:
        chosen = defaults.where("form IN ('default', 'module')").select(F.col("path").alias("target"), "name").join(own, ["target", "name"])
        own = own.union(chosen.select("target", F.lit("default").alias("name"), "decl_id"))
    passed = bindings.where("kind = 'export'").join(targets.withColumnRenamed("target", "source"), ["path", "raw"])
    with scratch(decls.sparkSession):
        passed = written(passed, "passed", keep=True)
        if passed.isEmpty():
            return own
        levels = [written(own, "shown", keep=True)]
        for _ in range(MOST_HOPS):
            found = passed.join(levels[-1].withColumnRenamed("target", "source").withColumnRenamed("name", "shown"), "source").where("name = '*' AND shown <> 'default' OR name = shown")
            level = found.select(F.col("path").alias("target"), F.when(F.col("name") == "*", F.col("shown")).otherwise(F.col("local")).alias("name"), "decl_id").distinct()
            for old in levels:
                level = level.join(old, ["target", "name", "decl_id"], "left_anti")
            levels.append(written(level, "shown", keep=True))
            if levels[-1].isEmpty():
                break
    return reduce(DataFrame.union, levels).groupBy("target", "name").agg(F.min("decl_id").alias("decl_id"))


def visible(bindings: DataFrame, packages: DataFrame, targets: DataFrame, shown: DataFrame) -> DataFrame:
    """(path, name, decl_id, source): what a file sees of others by a plain name: imported symbols, all of starred modules, and what its
    language shows within a package or a folder."""
    symbols = bindings.where("kind = 'symbol'").join(targets, ["path", "raw"]).join(shown, ["target", "name"]).select("path", F.col("local").alias("name"), "decl_id", F.lit("import").alias("source"))
    stars = bindings.where("kind = 'star'").drop("name").join(targets, ["path", "raw"]).join(shown.where("name <> 'default'"), "target").select("path", "name", "decl_id", F.lit("star").alias("source"))
    here = packages.withColumn("folder", C.dirname("path"))
    files = here.select(F.col("path").alias("target"), "lang", F.coalesce("package", F.lit("")).alias("package"), "folder")
    mine = here.select("path", "lang", F.coalesce("package", F.lit("")).alias("package"), "folder")
    package = mine.where((F.col("package") != "") & F.col("lang").isin(BY_PACKAGE)).join(files.drop("folder"), ["lang", "package"])
    folder = mine.where(F.col("lang").isin(BY_FOLDER)).join(files, ["lang", "package", "folder"]).drop("folder")
    near = package.select("path", "target", F.lit("package").alias("source")).union(folder.select("path", "target", F.lit("folder").alias("source")))
    near = near.where("path <> target").groupBy("path", "target").agg(F.max("source").alias("source"))
    siblings = near.join(shown.where("name <> 'default'"), "target").select("path", "name", "decl_id", "source")
    return symbols.union(stars).union(siblings)


def links(scopes: DataFrame, decls: DataFrame, refs: DataFrame, bindings: DataFrame, packages: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(path, ord, name, line, start_byte, end_byte, decl_id, reason) of references that mean a declaration of another file.

    A plain name that its own file does not resolve, or resolves to its import, means what the file sees: an imported symbol before a starred
    one before one of its package or folder. A name behind the handle of a module means what that module shows. In Swift a name
    with one declaration in the tree means that one. Ruby is not linked: there, declarations of one name are merged across files."""
    with scratch(decls.sparkSession):
        return written(_links(decls, refs, bindings, packages, *_prepared(scopes, decls, refs, bindings, packages, defaults)), "links", keep=True)


def _prepared(scopes: DataFrame, decls: DataFrame, refs: DataFrame, bindings: DataFrame, packages: DataFrame, defaults: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Import targets, what files show and what references are bound to, each written once: links and renames read them many times."""
    targets = import_targets(bindings, packages)
    free_shuffles(decls.sparkSession)
    shown = written(exports(scopes, decls, bindings, targets, defaults), "exports")
    free_shuffles(decls.sparkSession)
    bound = written(bind(scopes, decls, refs), "bound")
    free_shuffles(decls.sparkSession)
    return targets, shown, bound


def _links(decls: DataFrame, refs: DataFrame, bindings: DataFrame, packages: DataFrame, targets: DataFrame, shown: DataFrame, bound: DataFrame) -> DataFrame:
    """To be called in a scope: references that are left open, and what files see, are each read twice and written once."""
    keep = ["path", "ord", "name", "line", "start_byte", "end_byte"]
    bindings, packages = bindings.where("lang <> 'ruby'"), packages.where("lang <> 'ruby'")
    imported = decls.where("kind = 'import'").select("decl_id")
    ends = bound.where("bind_kind = 'unresolved'").select("path", "ord").union(bound.where("bind_kind <> 'unresolved'").join(imported, "decl_id", "left_semi").select("path", "ord"))
    plain = written(refs.where("reason IS NULL").select(*keep).join(ends, ["path", "ord"], "left_semi"), "plain")
    seen = visible(bindings, packages, targets, shown)
    order = F.when(F.col("source") == "import", 0).when(F.col("source") == "star", 1).otherwise(2)
    best = seen.groupBy("path", "name").agg(F.min(F.struct(order.alias("o"), "decl_id", "source")).alias("s")).select("path", "name", "s.decl_id", F.col("s.source").alias("reason"))
    best = written(best, "best")
    free_shuffles(decls.sparkSession)
    out = plain.join(best, ["path", "name"]).select(*keep, "decl_id", "reason")
    handles = bindings.where("kind = 'module'").select("path", "raw", F.element_at(F.split("local", r"\."), -1).alias("qualifier"))
    held = handles.join(targets, ["path", "raw"]).select("path", "qualifier", "target").distinct()
    through = refs.where("qualifier IS NOT NULL").join(held, ["path", "qualifier"]).join(shown, ["target", "name"]).select(*keep, "decl_id", F.lit("handle").alias("reason"))
    swift = packages.where("lang = 'swift'").select("path")
    alone = shown.join(swift.withColumnRenamed("path", "target"), "target").groupBy("name").agg(F.count("*").alias("n"), F.min("decl_id").alias("decl_id"), F.min("target").alias("target")).where("n = 1")
    tree = plain.join(alone, "name").where("path <> target").join(swift, "path", "left_semi").join(best.select("path", "name"), ["path", "name"], "left_anti").select(*keep, "decl_id", F.lit("tree").alias("reason"))
    return out.union(through).union(tree).distinct()


def import_names(decls: DataFrame, refs: DataFrame, bindings: DataFrame, targets: DataFrame, shown: DataFrame, bound: DataFrame) -> DataFrame:
    """(path, name, line, start_byte, end_byte, decl_id): the names in import clauses that mean a declaration of another file: a declared
    import, the part of a qualified name, or the name before an alias, which its file does not declare."""
    keep = ["path", "name", "line", "start_byte", "end_byte", F.col("means").alias("decl_id")]
    symbols = bindings.where("kind IN ('symbol', 'export') AND name <> '*'").join(targets, ["path", "raw"]).join(shown, ["target", "name"]).select("path", "lang", "raw", "name", "local", F.col("decl_id").alias("means"))
    symbols = symbols.join(decls.select(F.col("decl_id").alias("means"), "name"), ["means", "name"])  # not where a module passes it on by another name
    named = decls.where("kind = 'import'").drop("decl_id").join(symbols.where("name = local").select("path", "name", "means"), ["path", "name"]).select(*keep)
    whole = F.regexp_replace("raw", r"[.\\:]+", ".")
    before = F.when(F.substring_index(whole, ".", -1) == F.col("name"), F.substring_index(F.substring_index(whole, ".", -2), ".", 1)).otherwise(F.substring_index(whole, ".", -1))
    clauses = symbols.where(F.col("lang").isin(*BY_PACKAGE, "rust")).select("path", "name", "means", before.alias("qualifier"))
    dotted = refs.where("qualifier IS NOT NULL").join(clauses, ["path", "name", "qualifier"]).select(*keep)
    open_refs = bound.where("bind_kind = 'unresolved'").select("path", "ord").join(refs, ["path", "ord"])
    aliased = open_refs.join(symbols.where("name <> local").select("path", "name", "means"), ["path", "name"]).select(*keep)
    return named.union(dotted).union(aliased).distinct()


def references_to(decl_ids: DataFrame, scopes: DataFrame, decls: DataFrame, refs: DataFrame, linked: DataFrame) -> DataFrame:
    """(decl_id, path, line, start_byte, end_byte, binding, reason): references to each of the declarations: bound in its file, linked from
    other files, and ('probable') property accesses of its name in files that link to its file or are its own."""
    with scratch(decls.sparkSession):
        wanted = written(_wanted(decl_ids, decls), "wanted")
        resolved = _resolved(wanted, refs, linked, bind(scopes, decls, refs))
        return written(resolved.union(_loose(wanted, decls, refs, linked)).distinct(), "references", keep=True)


def _loose(wanted: DataFrame, decls: DataFrame, refs: DataFrame, linked: DataFrame) -> DataFrame:
    known = linked.select("path", "start_byte").distinct()
    near = linked.join(decls.select("decl_id", F.col("path").alias("home")), "decl_id").select("path", "home").union(wanted.select(F.col("home").alias("path"), "home")).distinct()
    # the files come before the name: a name that many files have would else pair all its accesses with all its declarations
    loose = refs.where("reason = 'property_access'").join(near.join(wanted, "home"), ["path", "name"]).join(known, ["path", "start_byte"], "left_anti")
    return loose.select("decl_id", *_SPAN, F.lit("probable").alias("binding"), F.lit("property_access").alias("reason"))


_SPAN = ["path", "line", "start_byte", "end_byte"]


def _wanted(decl_ids: DataFrame, decls: DataFrame) -> DataFrame:
    return decl_ids.select("decl_id").distinct().join(decls.select("decl_id", F.col("path").alias("home"), "name"), "decl_id")


def _resolved(wanted: DataFrame, refs: DataFrame, linked: DataFrame, bound: DataFrame) -> DataFrame:
    own = bound.where("bind_kind = 'resolved'").select("path", "ord", "decl_id").join(wanted, "decl_id").join(refs.select("ord", *_SPAN), ["path", "ord"])
    own = own.select("decl_id", *_SPAN, F.lit("resolved").alias("binding"), F.lit("direct_scope").alias("reason"))
    return own.union(linked.join(wanted, "decl_id").select("decl_id", *_SPAN, F.lit("resolved").alias("binding"), "reason"))


def _part(df: DataFrame, name: str) -> DataFrame:
    """A part of a result, written: the driver plans a query anew after each of its stages, so one plan of all parts takes it hundreds of MB."""
    out = written(df, name)
    free_shuffles(df.sparkSession)
    return out


def rename_spans(decl_ids: DataFrame, scopes: DataFrame, decls: DataFrame, refs: DataFrame, bindings: DataFrame, packages: DataFrame, defaults: DataFrame | None = None) -> DataFrame:
    """(decl_id, path, line, start_byte, end_byte, role) of what a rename of each declaration rewrites: itself, its resolved references that
    call it by its own name, and that name where it is imported. In languages of BY_NAME every reference of the name in files of the language:
    declarations of one name share these, so they are one row each, under the first of them."""
    keep = ["decl_id", *_SPAN]
    with scratch(decls.sparkSession):
        targets, shown, bound = _prepared(scopes, decls, refs, bindings, packages, defaults)
        wanted = written(_wanted(decl_ids, decls), "wanted")
        linked = _links(decls, refs, bindings, packages, targets, shown, bound)
        named_so = linked.join(wanted.select("decl_id", "name"), ["decl_id", "name"], "left_semi").select(linked.columns)
        named_so = _part(named_so, "named_so")
        itself = decls.join(wanted.select("decl_id"), "decl_id").select(*keep, F.lit("definition").alias("role"))
        uses = _part(_resolved(wanted, refs, named_so, bound).select(*keep, F.lit("reference").alias("role")), "uses")
        clauses = import_names(decls, refs, bindings, targets, shown, bound).join(wanted.select("decl_id"), "decl_id").select(*keep, F.lit("import").alias("role"))
        clauses = _part(clauses, "clauses")
        langs = packages.where(F.col("lang").isin(BY_NAME)).select("path", "lang")
        named = wanted.join(langs.withColumnRenamed("path", "home"), "home").groupBy("name", "lang").agg(F.min("decl_id").alias("decl_id"))
        loose = _part(refs.join(langs, "path").join(named, ["name", "lang"]).select(*keep, F.lit("reference").alias("role")), "loose")
        aliased = clauses.select("decl_id", "path", "start_byte")
        uses = uses.union(loose).distinct().join(aliased, ["decl_id", "path", "start_byte"], "left_anti").select(*keep, "role")
        return written(itself.union(clauses).union(uses), "spans", keep=True)


def hierarchy_closure(supers: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path, type, related): types of a file that an undirected chain of supers(path, type, super) joins to seeds(path, type)."""
    from codeloom.operators.graph import closure

    key = lambda c: F.concat_ws("\t", "path", c)
    found = closure(supers.select(key("type").alias("a"), key("super").alias("b")), seeds.select(key("type").alias("seed")))
    cut = lambda c, i: F.get(F.split(c, "\t"), F.lit(i))
    return found.where("seed <> node").select(cut("seed", 0).alias("path"), cut("seed", 1).alias("type"), cut("node", 1).alias("related"))


def hierarchy_neighbours(supers: DataFrame, seeds: DataFrame) -> DataFrame:
    """(path, type, related, side): direct supers and subs of seeds(path, type)."""
    up = supers.join(seeds, ["path", "type"]).select("path", "type", F.col("super").alias("related"), F.lit("super").alias("side"))
    down = supers.join(seeds.select("path", F.col("type").alias("super")), ["path", "super"]).select("path", F.col("super").alias("type"), F.col("type").alias("related"), F.lit("sub").alias("side"))
    return up.union(down).distinct()


def path_patterns(specs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(path, spec, place, target): import specs rewritten by patterns(pattern, place, target) with one `*` each at most; the pattern with the longest
    text before its star wins. Patterns are those of one configuration file; their heads are joined by length of the spec's own heads."""
    star = F.instr("pattern", "*")
    rules = patterns.withColumns({"head": F.when(star > 0, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")), "tail": F.when(star > 0, F.substring_index("pattern", "*", -1)).otherwise(""), "open": star > 0})
    heads = specs.withColumn("head", F.explode(F.transform(F.sequence(F.lit(0), F.length("spec")), lambda n: F.substring(F.col("spec"), F.lit(1), n))))
    fits = (F.col("open") & F.col("spec").endswith(F.col("tail")) & (F.length("spec") >= F.length("head") + F.length("tail"))) | (~F.col("open") & (F.col("head") == F.col("spec")))
    met = heads.join(rules, "head").where(fits)
    met = met.withColumn("longest", F.max(F.struct(~F.col("open"), F.length("head"))).over(Window.partitionBy("path", "spec"))).where(F.struct(~F.col("open"), F.length("head")) == F.col("longest"))
    middle = F.substring(F.col("spec"), F.length("head") + 1, F.length("spec") - F.length("head") - F.length("tail"))
    return met.select("path", "spec", "place", F.when(F.col("open"), F.replace("target", F.lit("*"), middle)).otherwise(F.col("target")).alias("target"))
