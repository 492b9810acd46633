"""Queries of binding across files, over source files made from the documents: a small project in each language for each of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import bindings as I
from codeloom.functions import scopes as X
from codeloom.operators import linking as L
from codeloom.plans import generated as G
from codeloom.scratch import scratch, written

Q: dict = {}
S: dict[str, str] = {}

#: Files of a project by language. `p` (and what else is named) gets the document's tag.
PROJECTS = {
    "typescript": ([("p/lib.ts", "export function go(x: number) {\n  return x;\n}\nexport default class Box {\n}\n"), ("p/barrel.ts", "export { go as start } from './lib';\nexport * from './lib';\n"), ("p/app.ts", "import Thing, { go } from './lib';\nimport { start } from './barrel';\nimport * as all from './lib';\nfunction main() {\n  go(1);\n  start(2);\n  all.go(3);\n  const one = new Thing();\n}\n")], ["p"]),
    "python": ([("p/lib.py", "def go(x):\n    return x\n"), ("p/app.py", "from p.lib import go as run, other\nimport p.lib as lib\n\ndef main():\n    run(1)\n    lib.go(2)\n    go = 5\n    return go\n"), ("p/near.py", "from .lib import go\n\ndef use():\n    return go(1)\n")], ["p"]),
    "go": ([("p/queue/q.go", "package queue\nfunc Push(x int) {\n}\n"), ("p/queue/more.go", "package queue\nfunc Also() {\n  Push(1)\n}\n"), ("p/app/main.go", 'package main\nimport "ex.org/m/p/queue"\nfunc main() {\n  queue.Push(2)\n}\n')], ["p"]),
    "java": ([("p/a/Svc.java", "package p.a;\npublic class Svc {\n  int run(int x) {\n    return x;\n  }\n}\n"), ("p/b/Main.java", "package p.b;\nimport p.a.Svc;\nclass Main {\n  void go(int n) {\n    Svc s = new Svc();\n  }\n}\n"), ("p/a/Near.java", "package p.a;\nclass Near {\n  Svc field;\n}\n")], ["p"]),
    "kotlin": ([("p/A.kt", "package p.a\nfun go(x: Int) {\n}\n"), ("p/B.kt", "package p.b\nimport p.a.go\nfun main() {\n  go(1)\n}\n"), ("p/C.kt", "package p.a\nfun also() {\n  go(2)\n}\n")], ["p"]),
    "rust": ([("p/src/net.rs", "pub fn go(x: u8) {\n}\n"), ("p/src/main.rs", "use crate::net::go;\nfn main() {\n  go(1);\n}\n")], ["p", "net"]),
    "ruby": ([("p/lib.rb", "def go\n  1\nend\n"), ("p/app.rb", "require_relative 'lib'\ndef main\n  go\nend\n")], ["p"]),
    "swift": ([("p/A.swift", "func go(a: Int) {\n}\n"), ("p/C.swift", "func other() {\n}\n"), ("p/x/B.swift", "func main() {\n  go(1)\n}\n")], ["p", "go"]),
    "php": ([("p/A.php", "<?php\nnamespace P\\A;\nclass Svc {\n}\n"), ("p/B.php", "<?php\nnamespace P\\B;\nuse P\\A\\Svc;\nfunction main() {\n  $s = new Svc();\n}\n"), ("p/C.php", "<?php\nnamespace P\\A;\nclass Near {\n}\n")], ["p", "P"]),
    "csharp": ([("p/A.cs", "namespace Acme.Core;\nclass Svc {\n}\n"), ("p/B.cs", "using Acme.Core;\nnamespace Acme.App;\nclass Main {\n  void Go(int n) {\n    Svc s = new Svc();\n  }\n}\n")], ["p", "Acme"]),
    "c": ([("p/inc.h", "static int go(int a) {\n  return a;\n}\n"), ("p/main.c", '#include "inc.h"\nint main(int n) {\n  return go(n);\n}\n')], ["p"]),
    "cpp": ([("p/inc.hpp", "int go(int a) {\n  return a;\n}\n"), ("p/main.cpp", '#include "inc.hpp"\nint run(int n) {\n  return go(n);\n}\n')], ["p"]),
    "lua": ([("p/lib.lua", "local function go(a)\n  return a\nend\n"), ("p/app.lua", "local lib = require('p.lib')\nlocal function main()\n  lib.go(1)\nend\n")], ["p"]),
    "zig": ([("p/lib.zig", "pub fn go(a: u8) void {\n}\n"), ("p/app.zig", 'const lib = @import("lib.zig");\nfn main() void {\n  lib.go(1);\n}\n')], ["p"]),
}
#: Links of each project: path, line, name, file and name of the declaration, reason.
LINKS = {
    "typescript": [("p/app.ts", 1, "Thing", "p/lib.ts", "Box", "import"), ("p/app.ts", 5, "go", "p/lib.ts", "go", "import"), ("p/app.ts", 6, "start", "p/lib.ts", "go", "import"), ("p/app.ts", 7, "go", "p/lib.ts", "go", "handle"), ("p/app.ts", 8, "Thing", "p/lib.ts", "Box", "import")],
    "python": [("p/app.py", 5, "run", "p/lib.py", "go", "import"), ("p/app.py", 6, "go", "p/lib.py", "go", "handle"), ("p/near.py", 4, "go", "p/lib.py", "go", "import")],
    "go": [("p/queue/more.go", 3, "Push", "p/queue/q.go", "Push", "folder"), ("p/app/main.go", 4, "Push", "p/queue/q.go", "Push", "handle")],
    "java": [("p/b/Main.java", 5, "Svc", "p/a/Svc.java", "Svc", "import"), ("p/a/Near.java", 3, "Svc", "p/a/Svc.java", "Svc", "package")],
    "kotlin": [("p/B.kt", 4, "go", "p/A.kt", "go", "import"), ("p/C.kt", 3, "go", "p/A.kt", "go", "package")],
    "rust": [("p/src/main.rs", 3, "go", "p/src/net.rs", "go", "import")], "ruby": [], "swift": [("p/x/B.swift", 2, "go", "p/A.swift", "go", "tree")], "php": [("p/B.php", 3, "Svc", "p/A.php", "Svc", "import"), ("p/B.php", 5, "Svc", "p/A.php", "Svc", "import")],
    "csharp": [("p/B.cs", 5, "Svc", "p/A.cs", "Svc", "star")], "c": [("p/main.c", 3, "go", "p/inc.h", "go", "star")], "cpp": [("p/main.cpp", 3, "go", "p/inc.hpp", "go", "star")],
    "lua": [("p/app.lua", 3, "go", "p/lib.lua", "go", "handle")], "zig": [("p/app.zig", 3, "go", "p/lib.zig", "go", "handle")],
}
#: What files see of others by a plain name.
SEEN = {
    "typescript": [("p/app.ts", "Thing", "import"), ("p/app.ts", "go", "import"), ("p/app.ts", "start", "import")], "python": [("p/app.py", "run", "import"), ("p/near.py", "go", "import")],
    "go": [("p/queue/more.go", "Push", "folder"), ("p/queue/q.go", "Also", "folder")], "java": [("p/b/Main.java", "Svc", "import"), ("p/a/Near.java", "Svc", "package"), ("p/a/Svc.java", "Near", "package")],
    "kotlin": [("p/B.kt", "go", "import"), ("p/C.kt", "go", "package"), ("p/A.kt", "also", "package")], "rust": [("p/src/main.rs", "go", "import")], "ruby": [("p/app.rb", "go", "star"), ("p/app.rb", "go", "folder"), ("p/lib.rb", "main", "folder")],
    "swift": [("p/A.swift", "other", "folder"), ("p/C.swift", "go", "folder")], "php": [("p/B.php", "Svc", "import"), ("p/A.php", "Near", "package"), ("p/C.php", "Svc", "package")], "csharp": [("p/B.cs", "Svc", "star")],
    "c": [("p/main.c", "go", "star")], "cpp": [("p/main.cpp", "go", "star")],
}
#: What a rename of the project's first declaration rewrites beside the links that mean it: path, line, role.
CLAUSES = {"typescript": [("p/app.ts", 1), ("p/barrel.ts", 1)], "python": [("p/app.py", 1), ("p/near.py", 1)], "java": [("p/b/Main.java", 2)], "kotlin": [("p/B.kt", 2)], "rust": [("p/src/main.rs", 1)]}
FIRST = {"typescript": "go", "python": "go", "go": "Push", "java": "Svc", "kotlin": "go", "rust": "go", "ruby": "go", "swift": "go", "php": "Svc", "csharp": "Svc", "c": "go", "cpp": "go", "lua": "go", "zig": "go"}


def _parsed(s, d, lang):
    return _tables(G.sources(s, d, *PROJECTS[lang]))


def _tables(files):
    """What the parsers say of files, parsed and written once: binding reads it many times."""
    files = written(files, "sources")
    held = X.scope_parts(written(X.scope_rows(files), "scoped"))
    return held, written(I.parse_bindings(files), "bindings"), written(I.parse_packages(files), "packages"), written(I.parse_default_exports(files), "defaults")


def _links(s, d, lang):
    tables, found, packages, defaults = _parsed(s, d, lang)
    return L.links(*tables, found, packages, defaults), tables


def _linked(s, d, lang):
    linked, (_, decls, _) = _links(s, d, lang)
    means = decls.select("decl_id", F.col("path").alias("target"), F.col("name").alias("target_name"))
    return linked.join(means, "decl_id").select("path", "line", "name", "target", "target_name", "reason").distinct()


def _seen(s, d, lang):
    (scopes, decls, _), found, packages, defaults = _parsed(s, d, lang)
    targets = L.import_targets(found, packages)
    return L.visible(found, packages, targets, L.exports(scopes, decls, found, targets, defaults)).select("path", "name", "source")


def _target(s, d, lang):
    tables, found, packages, defaults = _parsed(s, d, lang)
    path, names = PROJECTS[lang][0][0][0], PROJECTS[lang][1]
    home = G.docs(s, d).select(F.concat("dir", G.tagged(path, names)).alias("path"))
    wanted = G.tagged(FIRST[lang], names)
    named = home.join(G.docs(s, d).select(F.concat("dir", G.tagged(path, names)).alias("path"), wanted.alias("name")), "path")
    return tables[1].join(named, ["path", "name"]).select("decl_id"), tables, found, packages, defaults


def _references(s, d, lang):
    ids, tables, found, packages, defaults = _target(s, d, lang)
    rows = L.references_to(ids, *tables, L.links(*tables, found, packages, defaults))
    return rows.select("path", "line", "binding", "reason").distinct()


def _renamed(s, d, lang):
    ids, *rest = _target(s, d, lang)
    tables, found, packages, defaults = rest
    return L.rename_spans(ids, *tables, found, packages, defaults).select("path", "line", "role").distinct()


_LINK_IDS = dict(zip(["typescript", "go", "python", "java", "kotlin", "rust", "ruby", "swift", "php", "csharp", "c", "cpp", "lua", "zig"], range(26, 40), strict=True))
for _lang, _n in _LINK_IDS.items():
    Q[f"bd{_n}"] = lambda s, d, g=_lang: _linked(s, d, g)
    S[f"bd{_n}"] = G.answer("path, line, name, target, target_name, reason", LINKS[_lang], PROJECTS[_lang][1], ("line",), ("path", "target")) if LINKS[_lang] else "SELECT '' AS path, 0 AS line, '' AS name, '' AS target, '' AS target_name, '' AS reason WHERE false"


def _all_links(s, d):
    """The projects of all languages as one tree, linked at once."""
    files = reduce(DataFrame.union, (G.sources(s, d, *PROJECTS[lang]) for lang in _LINK_IDS))
    tables, found, packages, defaults = _tables(files)
    linked = L.links(*tables, found, packages, defaults).select("path", "line", "name", "decl_id", "reason").distinct()
    return linked.join(packages.select("path", "lang"), "path").groupBy("lang", "reason").agg(F.count("*").alias("n"))


Q["bd25"] = _all_links
_counts = [(g, r, sum(x[5] == r for x in rows)) for g, rows in LINKS.items() for r in sorted({x[5] for x in rows})]
S["bd25"] = f"SELECT lang, reason, n * (SELECT count(*) FROM documents) AS n FROM (VALUES {', '.join(map(str, _counts))}) t(lang, reason, n)"
_SEEN_IDS = dict(zip(["go", "java", "kotlin", "python", "typescript", "rust", "c", "cpp", "csharp", "swift", "php", "ruby"], range(42, 54), strict=True))
for _lang, _n in _SEEN_IDS.items():
    Q[f"bd{_n}"] = lambda s, d, g=_lang: _seen(s, d, g)
    S[f"bd{_n}"] = G.answer("path, name, source", SEEN[_lang], PROJECTS[_lang][1])


def _resolved(lang):
    return sorted({(p, n, "resolved", why) for p, n, _, t, name, why in LINKS[lang] if (t, name) == (PROJECTS[lang][0][0][0], FIRST[lang])})


for _name, _lang in (("bd63", "java"), ("bd66", "go"), ("bd68", "python"), ("bd69", "typescript")):
    Q[_name] = lambda s, d, g=_lang: _references(s, d, g)
    _loose = [("p/b/Main.java", 2, "probable", "property_access")] if _lang == "java" else []  # the name in the import clause
    S[_name] = G.answer("path, line, binding, reason", _resolved(_lang) + _loose, PROJECTS[_lang][1], ("line",))
_PROPERTY = [("p/queue/q.go", "package queue\ntype T struct {\n}\nfunc Push(x int) {\n}\nfunc use(t T) {\n  t.Push(1)\n}\n"), ("p/app/main.go", 'package main\nimport "ex.org/m/p/queue"\nfunc main() {\n  queue.Push(2)\n  other.Push(3)\n}\n')]


def _property(s, d):
    tables, found, packages, _ = _tables(G.sources(s, d, _PROPERTY, ["p"]))
    ids = tables[1].where("name = 'Push'").select("decl_id")
    return L.references_to(ids, *tables, L.links(*tables, found, packages)).select("path", "line", "binding", "reason").distinct()


Q["bd67"] = _property
S["bd67"] = G.answer("path, line, binding, reason", [("p/queue/q.go", 7, "probable", "property_access"), ("p/app/main.go", 4, "resolved", "handle"), ("p/app/main.go", 5, "probable", "property_access")], ["p"], ("line",))
_RENAME_IDS = {"rn4": "go", "rn5": "java", "rn6": "typescript", "rn7": "python", "rn8": "ruby", "rn9": "rust", "rn11": "c", "rn12": "cpp", "rn13": "csharp", "rn14": "swift", "rn15": "php", "rn16": "lua", "rn17": "zig", "rn3": "kotlin"}
for _name, _lang in _RENAME_IDS.items():
    _at = {"go": 2, "java": 2, "php": 3, "csharp": 2, "kotlin": 2}.get(_lang, 1)
    _path = PROJECTS[_lang][0][0][0]
    _rows = [(_path, _at, "definition"), *((p, n, "import") for p, n in CLAUSES.get(_lang, [])), *sorted({(p, n, "reference") for p, n, own, t, x, _ in LINKS[_lang] if (own, t, x) == (FIRST[_lang], _path, FIRST[_lang])})]
    Q[_name] = lambda s, d, g=_lang: _renamed(s, d, g)
    S[_name] = G.answer("path, line, role", _rows, PROJECTS[_lang][1], ("line",))
#: One file: definition, references in it, a name that an inner scope takes for itself.
_SAME = [("p/one.py", "def go(x):\n    return x\n\ndef main():\n    go(1)\n    return go(2)\n\ndef other(go):\n    return go\n")]


def _same_file(s, d):
    tables, found, packages, _ = _tables(G.sources(s, d, _SAME, ["p"]))
    ids = tables[1].where("name = 'go' AND kind = 'function'").select("decl_id")
    return L.rename_spans(ids, *tables, found, packages).select("path", "line", "role").distinct()


Q["rn2"] = _same_file
S["rn2"] = G.answer("path, line, role", [("p/one.py", 1, "definition"), ("p/one.py", 5, "reference"), ("p/one.py", 6, "reference")], ["p"], ("line",))

#: Class heads by language: code, names that are tagged, (type, super, line), what the first type is related to.
FAMILIES = {
    "bd57": ("p/a.ts", "interface Shape { a: number }\nclass Base implements Shape {\n}\nclass Deep<T> extends Base {\n}\nclass Alone {\n}\n", ["p", "Shape", "Base", "Deep", "Alone"], [("Base", "Shape", 2), ("Deep", "Base", 4)]),
    "bd58": ("p/a.cpp", "class Shape {\n};\nstruct Base : public Shape, virtual ns::Other {\n};\nclass Deep : Base {\n};\n", ["p", "Shape", "Base", "Deep", "Other"], [("Base", "Shape", 3), ("Base", "Other", 3), ("Deep", "Base", 5)]),
    "bd59": ("p/a.cs", "interface IShape {\n}\nclass Base : IShape, IList<int> {\n}\nclass Deep : Base {\n}\n", ["p", "IShape", "Base", "Deep"], [("Base", "IShape", 3), ("Base", "IList", 3), ("Deep", "Base", 5)]),
    "bd60": ("p/a.php", "<?php\ninterface Shape {\n}\nclass Base implements Shape {\n}\nclass Deep extends Base {\n}\n", ["p", "Shape", "Base", "Deep"], [("Base", "Shape", 4), ("Deep", "Base", 6)]),
    "bd61": ("p/a.py", "class Shape:\n    pass\n\nclass Base(Shape, metaclass=Meta):\n    pass\n\nclass Deep(mod.Base):\n    pass\n", ["p", "Shape", "Base", "Deep"], [("Base", "Shape", 4), ("Deep", "Base", 7)]),
    "bd62": ("p/a.rb", "module Mix\nend\nclass Base\n  include Mix\nend\nclass Deep < Base\nend\n", ["p", "Mix", "Base", "Deep"], [("Base", "Mix", 4), ("Deep", "Base", 6)]),
}
for _name, (_path, _code, _names, _want) in FAMILIES.items():
    Q[_name] = lambda s, d, p=_path, c=_code, n=_names: I.parse_hierarchy(G.sources(s, d, [(p, c)], n))
    S[_name] = G.answer("path, type, super, line", [(_path, *w) for w in _want], _names, ("line",))


def _seeds(s, d, name, kind):
    path, _, names, _ = FAMILIES[name]
    return G.docs(s, d).select(F.concat("dir", G.tagged(path, names)).alias("path"), F.concat(F.lit(kind), "tag").alias("type"))


def _related(s, d, name):
    path, code, names, _ = FAMILIES[name]
    return L.hierarchy_closure(I.parse_hierarchy(G.sources(s, d, [(path, code)], names)), _seeds(s, d, name, "Deep"))


for _name, _family in (("gr36", "bd58"), ("gr37", "bd59"), ("gr38", "bd60"), ("gr39", "bd61"), ("gr40", "bd62"), ("gr41", "bd57")):
    _path, _, _names, _want = FAMILIES[_family]
    Q[_name] = lambda s, d, f=_family: _related(s, d, f)
    S[_name] = G.answer("path, type, related", [(_path, "Deep", x) for x in sorted({x for a, b, _ in _want for x in (a, b)} - {"Deep"})], _names)


def _neighbours(s, d):
    path, code, names, _ = FAMILIES["bd57"]
    return L.hierarchy_neighbours(I.parse_hierarchy(G.sources(s, d, [(path, code)], names)), _seeds(s, d, "bd57", "Base"))


Q["gr35"] = _neighbours
S["gr35"] = G.answer("path, type, related, side", [("p/a.ts", "Base", "Shape", "super"), ("p/a.ts", "Base", "Deep", "sub")], ["p", "Shape", "Base", "Deep"])
_EXPORTING = [("p/a.ts", "export { one as two, three } from './b';\nexport * from './c';\nexport * as all from './d';\n// export * from './no';\n")]
Q["bd55"] = lambda s, d: I.parse_bindings(G.sources(s, d, _EXPORTING, ["p", "one", "b"])).where("kind = 'export'").select("path", "raw", "name", "local")
S["bd55"] = G.answer("path, raw, name, local", [("p/a.ts", "./b", "one", "two"), ("p/a.ts", "./b", "three", "three"), ("p/a.ts", "./c", "*", "*"), ("p/a.ts", "./d", "*", "all")], ["p", "one", "b"])
_DEFAULTS = [("p/a.js", "export default function go() {\n}\n"), ("p/b.js", "class Box {\n}\nmodule.exports = Box;\nexports.more = 1;\n"), ("p/c.js", "const { go, x: y } = require('./a');\nconst whole = require('./b');\n")]
Q["bd56"] = lambda s, d: I.parse_default_exports(G.sources(s, d, _DEFAULTS, ["p", "go", "Box"])).select("path", "form", "name").union(I.parse_bindings(G.sources(s, d, _DEFAULTS, ["p", "go", "Box"])).select("path", "kind", "local"))
S["bd56"] = G.answer("path, form, name", [("p/a.js", "default", "go"), ("p/b.js", "module", "Box"), ("p/b.js", "member", "more"), ("p/c.js", "symbol", "go"), ("p/c.js", "symbol", "y"), ("p/c.js", "module", "whole")], ["p", "go", "Box"])
_PATTERNS = [("@app/*", 0, "src/app/*"), ("@app/*", 1, "lib/app/*"), ("@app/deep/*", 0, "src/deep/*"), ("exact", 0, "src/exact.ts"), ("*/end", 0, "ends/*")]
_SPECS = [("a.ts", "@app/x"), ("a.ts", "@app/deep/x"), ("a.ts", "exact"), ("a.ts", "exact/x"), ("a.ts", "x/end")]


def _mapped(s, d):
    specs = G.rows(s, d, _SPECS, "path string, spec string", ["x"]).select(F.concat("dir", "path").alias("path"), "spec")
    return L.path_patterns(specs.distinct(), s.createDataFrame(_PATTERNS, "pattern string, place int, target string"))


Q["bd54"] = _mapped
S["bd54"] = "SELECT DISTINCT * FROM (" + G.answer("path, spec, place, target", [("a.ts", "@app/x", 0, "src/app/x"), ("a.ts", "@app/x", 1, "lib/app/x"), ("a.ts", "@app/deep/x", 0, "src/deep/x"), ("a.ts", "exact", 0, "src/exact.ts"), ("a.ts", "x/end", 0, "ends/x")], ["x"]) + ")"
Q["gr7"] = lambda s, d: L.import_targets(*(f(G.sources(s, d, *PROJECTS["go"])) for f in (I.parse_bindings, I.parse_packages))).select("path", "raw", F.regexp_replace("target", "/[^/]*$", "").alias("folder")).distinct()
S["gr7"] = G.answer("path, raw, folder", [("p/app/main.go", "ex.org/m/p/queue", "p/queue")], ["p"], (), ("path", "folder"))
Q["gr45"] = lambda s, d: L.import_targets(*(f(G.sources(s, d, *PROJECTS["go"])) for f in (I.parse_bindings, I.parse_packages))).where("target LIKE '%/queue/q.go'").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
S["gr45"] = G.answer("folder", [("p/app",)], ["p"], (), ("folder",))


def _once(query):
    """query with its result written, so that the tables that it makes for itself are gone when it returns."""

    def run(s, d):
        with scratch(s):
            return written(query(s, d), "result", keep=True)

    return run


for _name in [x for x in Q if x in _RENAME_IDS or x in ("bd25", "bd63", "bd66", "bd67", "bd68", "bd69", "rn2", "gr7", "gr45") or x in {f"bd{n}" for n in (*_LINK_IDS.values(), *_SEEN_IDS.values())}]:
    Q[_name] = _once(Q[_name])
