"""Import targets against a brute-force version, and work that grows with the files and not with their square."""

import itertools

from codeloom.functions import columns as C
from codeloom.operators import linking as L
from pyspark.sql import Window
from pyspark.sql import functions as F

PACKAGES = "path string, lang string, package string"
BINDINGS = "path string, lang string, raw string, name string, local string, kind string"


def brute(bindings, packages):
    """All who ask a key against all who answer to it."""
    asked = bindings.select("path", "raw", F.posexplode(L._asked(F.col("lang"), F.col("path"), F.col("raw"), F.col("kind"))).alias("place", "key")).distinct()
    met = asked.join(L.module_keys(packages), "key").where("target <> path")
    met = met.withColumn("first", F.min("place").over(Window.partitionBy("path", "raw"))).where("place = first")
    unit = F.when(F.col("key").startswith("folder:"), C.dirname("target")).otherwise(F.col("target"))
    met = met.withColumn("unit", F.struct(C.path_distance("path", "target").alias("far"), F.length(unit).alias("n"), unit.alias("unit")))
    alike = F.col("key").startswith("end:") | F.col("key").startswith("folder:")
    met = met.withColumn("best", F.min("unit").over(Window.partitionBy("path", "raw", "key")))
    return met.where(~alike | (F.col("unit") == F.col("best"))).select("path", "raw", "target").distinct()


def test_targets_equal_brute_force(spark):
    folders = ["", "a/", "a/q/", "a/b/", "a/b/q/", "c/", "c/b/q/", "d/e/f/", "d/e/q/"]
    files = [(f"{d}{n}", lang, None) for d in folders for n, lang in (("u.h", "c"), ("u.c", "c"), ("u.go", "go"), ("v.go", "go"), ("u.py", "python"))]
    files += [(f"{d}S{k}.java", "java", f"p.{k}") for d, k in itertools.product(folders, (1, 2))]
    files = [x for k, x in enumerate(files) if k % 7]  # not the same everywhere
    raws = {"c": [("u.h", "star"), ("b/u.h", "star"), ("../u.h", "star")], "go": [("m/q", "module"), ("x/b/q", "module")], "python": [("u", "module"), (".u", "symbol"), ("q.u", "symbol")], "java": [("p.1.S1", "symbol"), ("p.2", "star")]}
    asks = [(p, lang, raw, "x", "x", kind) for p, lang, _ in files for raw, kind in raws[lang]]
    packages, bindings = spark.createDataFrame(files, PACKAGES), spark.createDataFrame(asks, BINDINGS)
    got = sorted(map(tuple, L.import_targets(bindings, packages).collect()))
    assert got == sorted(map(tuple, brute(bindings, packages).collect())) and len(got) > 100


def test_a_key_of_many_files_is_no_product(spark):
    """20,000 includes of a name that 20,000 files end in: as a product 400 million rows."""
    n = 20_000
    at = F.concat(F.lit("d"), F.col("id").cast("string"))
    packages = spark.range(n).select(F.inline(F.array(*(F.struct(F.concat(at, F.lit(e)).alias("path"), F.lit("c").alias("lang"), F.lit(None).cast("string").alias("package")) for e in ("/inc/u.h", "/m.c")))))
    bindings = packages.where("path LIKE '%.c'").select("path", "lang", F.lit("u.h").alias("raw"), F.lit("*").alias("name"), F.lit("*").alias("local"), F.lit("star").alias("kind"))
    got = L.import_targets(bindings, packages)
    assert got.count() == n and got.where("substring_index(path, '/', 1) <> substring_index(target, '/', 1)").isEmpty()


def _parsed(spark, files):
    from codeloom.functions import bindings as I
    from codeloom.functions import scopes as X

    rows = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in files], "path string, content binary")
    return X.parse_scopes(rows), I.parse_bindings(rows), I.parse_packages(rows)


def test_references_by_name_are_one_row_each(spark):
    """Thirty Lua files that declare and call one name: a rename of all of them has each call once, not once a declaration."""
    tables, found, packages = _parsed(spark, [(f"d{k}/lib.lua", "local function go(a)\n  return a\nend\nx.go(1)\n") for k in range(30)])
    rows = L.rename_spans(tables[1].where("name = 'go'").select("decl_id"), *tables, found, packages).select("path", "line", "role").collect()
    assert sorted(map(tuple, rows)) == sorted((f"d{k}/lib.lua", n, role) for k in range(30) for n, role in ((1, "definition"), (4, "reference")))


def test_probable_references_keep_to_files_that_link(spark):
    """Property accesses of a name that many files declare: each is probable for its own file's declaration only."""
    tables, found, packages = _parsed(spark, [(f"d{k}/a.py", "def go(x):\n    return x\n\ny.go(1)\n") for k in range(30)])
    links = L.links(*tables, found, packages)
    rows = L.references_to(tables[1].where("name = 'go'").select("decl_id"), *tables, links).select("path", "line", "binding", F.substring_index("decl_id", ":", 1).alias("home")).collect()
    assert sorted(map(tuple, rows)) == sorted((f"d{k}/a.py", 4, "probable", f"d{k}/a.py") for k in range(30))


def test_a_rename_writes_no_plan_of_all_its_parts(spark, monkeypatch):
    """the driver holds a plan anew after each of its stages, so the last one has few joins."""
    tables, found, packages = _parsed(spark, [("p/one.lua", "local function go(a)\n  return a\nend\ngo(1)\n")])
    joins, written = {}, L.written

    def watch(df, name, keep=False):
        joins[name] = df._jdf.queryExecution().analyzed().toString().count("Join ")
        return written(df, name, keep)

    monkeypatch.setattr(L, "written", watch)
    L.rename_spans(tables[1].where("name = 'go'").select("decl_id"), *tables, found, packages)
    assert joins["spans"] <= 4, joins
