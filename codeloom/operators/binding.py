"""Scopes, declarations and references: binding as joins.

scopes(path, scope_id, parent_id, kind, start_byte, end_byte), decls(path, ord, decl_id, name, ns, kind, scope_id, start_byte, end_byte, ...),
refs(path, ord, name, ns, scope_id, start_byte, end_byte, bind_kind, decl_id, candidates, reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.scratch import written

#: Nesting deeper than this is an error of the extractor; ancestors are found by so many joins at most.
MOST_DEPTH = 64


def ancestors(scopes: DataFrame) -> DataFrame:
    """(path, scope_id, ancestor, depth): a scope is its own ancestor at depth 0. One join a level, until none has a parent;
    each level is written, else it is found again for every level above it."""
    up = scopes.select("path", F.col("scope_id").alias("ancestor"), F.col("parent_id").alias("next"))
    level = scopes.select("path", "scope_id", F.col("scope_id").alias("ancestor"), F.lit(0).alias("depth"), F.col("parent_id").alias("next"))
    out = level
    for _ in range(MOST_DEPTH):
        level = level.where("next IS NOT NULL").drop("ancestor").withColumnRenamed("next", "ancestor").join(up, ["path", "ancestor"]).select("path", "scope_id", "ancestor", (F.col("depth") + 1).alias("depth"), "next")
        level = written(level, "level")
        if level.isEmpty():
            return out.drop("next")
        out = out.union(level)
    raise ValueError(f"scopes nest deeper than {MOST_DEPTH}")


def bind(scopes: DataFrame, decls: DataFrame, refs: DataFrame, builtins: list[str] = (), class_scopes_hide: bool = False) -> DataFrame:
    """(path, ord, decl_id, bind_kind, reason) of every reference that is no property access.

    The innermost scope that declares the name in the reference's name space wins, its first declaration at that; then a
    type declared before the reference in a scope that ends no earlier than it; then builtins; else it is unresolved.
    class_scopes_hide: names of class scopes are seen from that scope itself only."""
    open_refs = refs.where("coalesce(reason, '') <> 'property_access'").select("path", "ord", "name", "ns", "scope_id", "start_byte", "end_byte")
    around = ancestors(scopes)
    if class_scopes_hide:
        kinds = scopes.select("path", F.col("scope_id").alias("ancestor"), F.col("kind").alias("scope_kind"))
        around = around.join(kinds, ["path", "ancestor"]).where("depth = 0 OR scope_kind <> 'class'").drop("scope_kind")
    seen = open_refs.join(around, ["path", "scope_id"]).join(decls.select("path", F.col("scope_id").alias("ancestor"), "name", "ns", F.col("ord").alias("decl_ord"), "decl_id"), ["path", "ancestor", "name", "ns"])
    direct = seen.groupBy("path", "ord").agg(F.min_by("decl_id", F.struct("depth", "decl_ord")).alias("direct_id"))
    types = decls.where("ns = 'type'").join(scopes.select("path", "scope_id", F.col("end_byte").alias("scope_end")), ["path", "scope_id"])
    before = open_refs.join(types.select("path", "name", F.col("start_byte").alias("decl_start"), "scope_end", F.col("ord").alias("decl_ord"), "decl_id"), ["path", "name"]).where("decl_start < start_byte AND scope_end >= end_byte")
    signature = before.groupBy("path", "ord").agg(F.min_by("decl_id", "decl_ord").alias("signature_id"))
    rows = open_refs.join(direct, ["path", "ord"], "left").join(signature, ["path", "ord"], "left")
    builtin = F.col("name").isin(list(builtins)) if builtins else F.lit(False)
    reason = F.when(F.col("direct_id").isNotNull(), "direct_scope").when(F.col("signature_id").isNotNull(), "signature_scope").when(builtin, "builtin").otherwise("missing_import")
    found = F.coalesce("direct_id", "signature_id", F.when(builtin, F.concat(F.lit("builtin:"), "name")))
    return rows.select("path", "ord", found.alias("decl_id"), F.when(found.isNotNull(), "resolved").otherwise("unresolved").alias("bind_kind"), reason.alias("reason"))


def refs_to(refs: DataFrame, decl_id: str) -> DataFrame:
    """References bound to a declaration or having it among their candidates."""
    return refs.where((F.col("decl_id") == decl_id) | F.array_contains("candidates", decl_id))


def file_scope_decl(decls: DataFrame, root_scope: int = 1) -> DataFrame:
    """(path, name, decl_id): the first declaration of each name at file scope."""
    return decls.where(F.col("scope_id") == root_scope).groupBy("path", "name").agg(F.min_by("decl_id", "ord").alias("decl_id"))


def merged_ids(decls: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """decls with canonical_id: the id of the first in `order` of those equal in `keys`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return decls.withColumn("canonical_id", F.first("decl_id").over(w))


def merge_in_file(decls: DataFrame) -> DataFrame:
    return merged_ids(decls, ["path", "scope_id", "name", "kind"], ["ord"])


def merge_across_files(decls: DataFrame) -> DataFrame:
    """The same across files for declarations of one language, qualifier, name and kind, first in order of path."""
    return merged_ids(decls, ["lang", "qualifier", "name", "kind"], ["path", "ord"])


def rebound(refs: DataFrame, merged: DataFrame) -> DataFrame:
    """refs with their declaration's canonical id."""
    ids = merged.select("decl_id", "canonical_id").distinct()
    return refs.join(ids, "decl_id", "left").withColumn("decl_id", F.coalesce("canonical_id", "decl_id")).drop("canonical_id")


def owners(scopes: DataFrame, decls: DataFrame) -> DataFrame:
    """(path, scope_id, owner): the nearest declaration before a scope in its parent."""
    rows = scopes.where("parent_id IS NOT NULL").select("path", "scope_id", "parent_id", F.col("start_byte").alias("at"))
    near = rows.join(decls.select("path", F.col("scope_id").alias("parent_id"), "name", "end_byte"), ["path", "parent_id"]).where("end_byte <= at")
    return near.groupBy("path", "scope_id").agg(F.max_by("name", "end_byte").alias("owner"))


def qualifiers(scopes: DataFrame, decls: DataFrame) -> DataFrame:
    """(path, scope_id, qualifier): owners' names from the outermost scope inwards, joined by dots."""
    named = ancestors(scopes).join(owners(scopes, decls).select("path", F.col("scope_id").alias("ancestor"), "owner"), ["path", "ancestor"])
    parts = named.groupBy("path", "scope_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("d"), "owner"))), lambda x: x["owner"]), ".").alias("qualifier"))
    return scopes.select("path", "scope_id").join(parts, ["path", "scope_id"], "left").select("path", "scope_id", F.coalesce("qualifier", F.lit("")).alias("qualifier"))


def link_imports(refs: DataFrame, decls: DataFrame, targets: DataFrame) -> DataFrame:
    """Rebind references to import declarations to what the imported file exports under that name.

    targets(path, import_path, target): the file that each import path of a file means. Exports prefer values to types."""
    exports = decls.where("exported AND import_path IS NULL").groupBy(F.col("path").alias("target"), F.col("name").alias("import_name")).agg(F.min_by("decl_id", F.struct(F.when(F.col("ns") == "value", 0).otherwise(1), "ord")).alias("export_id"))
    imports = decls.where("import_path IS NOT NULL AND import_name <> '*'").select("path", "import_path", "import_name", "decl_id").join(targets, ["path", "import_path"]).join(exports, ["target", "import_name"])
    ids = imports.select("decl_id", "export_id").distinct()
    rows = refs.join(ids, "decl_id", "left")
    hit = F.col("export_id").isNotNull()
    return rows.withColumns({"reason": F.when(hit, "import_export").otherwise(F.col("reason")), "decl_id": F.coalesce("export_id", "decl_id")}).drop("export_id")


def namespace(decls: DataFrame, brought: DataFrame) -> DataFrame:
    """(path, name, decl_id, source): a file's own file-scope declarations and what its language brings in from other files."""
    own = decls.where("scope_id = 1").select("path", "name", "decl_id", F.lit("local").alias("source"))
    return own.unionByName(brought.select("path", "name", "decl_id", "source"))


def siblings(decls: DataFrame) -> DataFrame:
    """What files of one directory see of each other."""
    top = decls.where("scope_id = 1 AND exported").withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    here = decls.select("path").distinct().withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    return here.join(top.select("dir", F.col("path").alias("other"), "name", "decl_id"), "dir").where("other <> path").select("path", "name", "decl_id", F.lit("same_directory").alias("source"))


def names_match(space: DataFrame, name: str, decl_id: str) -> DataFrame:
    """Files in which a name can mean a declaration."""
    return space.where((F.col("name") == name) & (F.col("decl_id") == decl_id)).select("path").distinct()


def cross_file_refs(refs: DataFrame, origin: str, name: str) -> DataFrame:
    """Name-equal references in other files with the reason they may be meant; builtins and ambiguous ones are left out."""
    reason = F.when(F.col("reason") == "property_access", "property_access").when(F.col("reason") == "builtin", None).when(F.col("bind_kind") == "resolved", "cross_file_import").when(F.col("bind_kind") == "unresolved", "cross_file_unresolved")
    return refs.where((F.col("path") != origin) & (F.col("name") == name)).withColumn("why", reason).where("why IS NOT NULL").select("path", "ord", "start_byte", F.col("why").alias("reason"))


def name_match_only(matches: DataFrame, covered: DataFrame) -> DataFrame:
    """(path, n): word matches that no bound reference covers."""
    return matches.join(covered.select("path", "start"), ["path", "start"], "left_anti").groupBy("path").agg(F.count("*").alias("n"))


def line_of(points: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, pos, line, col): the last line that starts at or before a byte; starts(path, line, start)."""
    rows = points.join(starts, "path").where("start <= pos")
    best = rows.groupBy("path", "pos").agg(F.max_by("line", "start").alias("line"), F.max("start").alias("start"))
    return best.select("path", "pos", "line", (F.col("pos") - F.col("start") + 1).alias("col"))


def tiers(refs: DataFrame) -> DataFrame:
    """How many references of each kind of binding: what a strict rename asks before it goes on."""
    return refs.groupBy("bind_kind").agg(F.count("*").alias("n"))


def collisions(scopes: DataFrame, decls: DataFrame, scope_id: int, path: str, new_name: str) -> DataFrame:
    """Declarations of a new name that are visible from a scope or lie in scopes below it."""
    around = ancestors(scopes).where(F.col("path") == path)
    up = around.where(F.col("scope_id") == scope_id).select(F.col("ancestor").alias("scope_id"))
    down = around.where(F.col("ancestor") == scope_id).select("scope_id")
    return decls.where((F.col("path") == path) & (F.col("name") == new_name)).join(up.union(down).distinct(), "scope_id", "left_semi").select("decl_id")


def builtin_refs(refs: DataFrame, builtins: list[str]) -> DataFrame:
    """refs(.., name) with builtin: whether the name is one that the language brings along."""
    return refs.withColumn("builtin", F.col("name").isin(builtins))
