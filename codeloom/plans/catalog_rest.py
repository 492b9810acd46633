"""Queries of the stored index and its upkeep, the tree source and sink, edit verbs, callers, and the smaller rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.functions import parsers, scopes
from codeloom.operators import binding as B
from codeloom.operators import edits as E
from codeloom.operators import graph as R
from codeloom.operators import overview as O
from codeloom.operators import symbols as Y
from codeloom.operators import text as T
from codeloom.plans import generated as G
from codeloom.plans.adapters import EDGES, FILES, LINES, REFS, SYMBOLS, edges, files, refs, symbols, table
from codeloom.plans.catalog_state import CHANGES, _log, _snapshots
from codeloom.plans.catalog_text import TRI, index
from codeloom.scratch import shared_folder
from codeloom.sources import repo
from codeloom.sources.store import IndexStore
from codeloom.streaming import incremental as I

Q: dict = {}
S: dict[str, str] = {}

# The stored index: written once, read table by table.
Q["sc12"] = lambda s, d: index(s, d).manifest().select("version", "n_files", "n_postings", "n_symbols")
S["sc12"] = f"WITH {TRI}, {SYMBOLS.removeprefix(FILES + ', ')} SELECT 1::BIGINT AS version, (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM grams) AS n_postings, (SELECT count(*) FROM symbols) AS n_symbols"
Q["sc13"] = lambda s, d: index(s, d).table("files").select("path", "size")
S["sc13"] = f"WITH {FILES} SELECT path, strlen(content)::BIGINT AS size FROM files"
Q["sc15"] = lambda s, d: index(s, d).table("symbols").select("sym_id", "name", "kind", "start_line")
S["sc15"] = f"WITH {SYMBOLS} SELECT sym_id, name, kind, start_line FROM symbols"
Q["sc18"] = lambda s, d: index(s, d).table("edges")
S["sc18"] = f"WITH {FILES}, {EDGES} SELECT importer, imported FROM edges"
Q["sc19"] = lambda s, d: index(s, d).table("edges").groupBy("imported").agg(F.count("*").alias("n"))
S["sc19"] = f"WITH {FILES}, {EDGES} SELECT imported, count(*) AS n FROM edges GROUP BY 1"
Q["sc20"] = lambda s, d: index(s, d).table("refs")
S["sc20"] = f"WITH {REFS} SELECT sym_id, path, name_lc FROM refs"
Q["sc21"] = lambda s, d: index(s, d).table("refs").where("name_lc = 'the'").select("sym_id", "path")
S["sc21"] = f"WITH {REFS} SELECT sym_id, path FROM refs WHERE name_lc = 'the'"


def _popular(s, d):
    """Popularity written with the index and read back."""
    at = index(s, d)
    store = IndexStore(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
    store.write({"popularity": Y.popularity(at.table("symbols"), at.table("refs"), at.table("edges"))})
    return store.table("popularity")


_POP = """inbound AS (SELECT imported AS path, count(*) AS inbound FROM edges GROUP BY 1), calling AS (SELECT DISTINCT name_lc, path AS importer FROM refs),
reached AS (SELECT n.name_lc, n.path, sum(1 + log2(1 + coalesce(i.inbound, 0))) AS score FROM (SELECT DISTINCT lower(name) AS name_lc, path FROM symbols) n JOIN edges e ON e.imported = n.path JOIN calling c ON c.name_lc = n.name_lc AND c.importer = e.importer LEFT JOIN inbound i ON i.path = e.importer GROUP BY 1, 2),
popular AS (SELECT sym_id, trunc(least(coalesce(score, 0), 65535))::BIGINT AS popularity FROM symbols s LEFT JOIN reached r ON r.name_lc = lower(s.name) AND r.path = s.path)"""
Q["sc22"] = _popular
S["sc22"] = f"WITH {REFS}, {EDGES}, {_POP} SELECT sym_id, popularity FROM popular"
Q["sc23"] = lambda s, d: _popular(s, d).groupBy("popularity").agg(F.count("*").alias("n"))
S["sc23"] = f"WITH {REFS}, {EDGES}, {_POP} SELECT popularity, count(*) AS n FROM popular GROUP BY 1"
#: A file whose scopes are stored: declarations and what its references are bound to.
_SCOPED = [("p/a.py", "def go(x):\n    y = x\n    return y\n\ndef main():\n    return go(1)\n")]
_DECLS = [("p/a.py", "go", "function", 1), ("p/a.py", "x", "parameter", 1), ("p/a.py", "y", "variable", 2), ("p/a.py", "main", "function", 5)]
_BOUND = [("p/a.py", "x", 2, "parameter"), ("p/a.py", "y", 3, "variable"), ("p/a.py", "go", 6, "function")]


def _scope_store(s, d):
    made = G.sources(s, d, _SCOPED, ["p", "go", "main"])
    tree, decls, found = scopes.parse_scopes(made)
    bound = B.bind(tree, decls, found).where("bind_kind = 'resolved'").select("path", "ord", "decl_id").join(found.select("path", "ord", "name", "line"), ["path", "ord"])
    store = IndexStore(s, f"{shared_folder(s)}/scopes-{uuid.uuid4().hex}")
    store.write({"decls": decls, "bound": bound})
    return store


def _bound(store):
    return store.table("bound").join(store.table("decls").select("decl_id", F.col("kind")), "decl_id").select("path", "name", "line", "kind")


Q["sc24"] = lambda s, d: _scope_store(s, d).table("decls").select("path", "name", "kind", "line")
S["sc24"] = G.answer("path, name, kind, line", _DECLS, ["p", "go", "main"], ("line",))
Q["sc25"] = lambda s, d: _scope_store(s, d).manifest().select("version", "n_files", "n_symbols")
S["sc25"] = "SELECT 1::BIGINT AS version, 0::BIGINT AS n_files, 0::BIGINT AS n_symbols"
Q["sc26"] = lambda s, d: _bound(_scope_store(s, d)).where("name LIKE 'go%'")
S["sc26"] = G.answer("path, name, line, kind", _BOUND[2:], ["p", "go", "main"], ("line",))
Q["sc27"] = lambda s, d: _bound(_scope_store(s, d))
S["sc27"] = G.answer("path, name, line, kind", _BOUND, ["p", "go", "main"], ("line",))
Q["tx4"] = lambda s, d: index(s, d).table("postings").where(F.col("tri").isin("746865", "696E67", "C3A920")).groupBy("tri").agg(F.sort_array(F.collect_list("path")).alias("paths")).select("tri", F.posexplode("paths").alias("place", "path"))
S["tx4"] = f"WITH {TRI} SELECT tri, (row_number() OVER (PARTITION BY tri ORDER BY path) - 1)::INTEGER AS place, path FROM grams WHERE tri IN ('746865', '696E67', 'C3A920')"

# Upkeep: a tree that changed, an index that follows.


def _ticked(s, d, symbols_too=False):
    rows = files(s, d).select("path", "doc_id", "content", F.octet_length("content").cast("long").alias("size"))
    old, now = _snapshots(s, d)
    store = IndexStore(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
    mine = lambda at: rows.join(at.select("path", "mtime_ns"), "path")
    store.build(mine(old).drop("doc_id"), symbols(s, d).join(old.select("path"), "path", "left_semi").withColumn("gen", F.lit(0)) if symbols_too else None)
    wrote = store.tick(mine(now).drop("doc_id"), symbols(s, d).join(now.select("path"), "path", "left_semi").withColumn("gen", F.lit(1)) if symbols_too else None)
    again = store.tick(mine(now).drop("doc_id"))
    return store, wrote, again, mine(now).drop("doc_id"), mine(old).drop("doc_id")


def _tick(s, d):
    store, wrote, again, now, old = _ticked(s, d)
    return store.manifest().select("version", "n_files", F.lit(wrote).alias("wrote"), F.lit(again).alias("again"))


Q["st8"] = _tick
S["st8"] = f"WITH {FILES} SELECT 2::BIGINT AS version, count(*) AS n_files, true AS wrote, false AS again FROM files WHERE doc_id % 10 <> 0"
Q["st10"] = lambda s, d: I.snapshot_diff(*_snapshots(s, d)).where("change <> 'deleted'").join(files(s, d), "path").select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
S["st10"] = f"WITH {FILES}, {CHANGES} SELECT path, sha256(content) AS hash FROM changes JOIN files USING (path) WHERE change <> 'deleted'"
Q["st11"] = lambda s, d: _ticked(s, d)[0].table("files").select("path", "mtime_ns", "size")
S["st11"] = f"WITH {FILES} SELECT path, 5::BIGINT AS mtime_ns, strlen(content)::BIGINT AS size FROM files WHERE doc_id % 10 <> 0"
Q["st13"] = lambda s, d: _ticked(s, d, True)[0].table("symbols").groupBy("path", "gen").agg(F.count("*").alias("n"))
S["st13"] = f"WITH {SYMBOLS} SELECT path, CASE WHEN doc_id % 10 <= 2 THEN 1 ELSE 0 END AS gen, count(*) AS n FROM symbols JOIN files USING (path) WHERE doc_id % 10 <> 0 GROUP BY 1, 2"


def _complete(s, d):
    store, _, _, now, old = _ticked(s, d)
    return table(s, d, "documents").agg(F.count("*").alias("n_files")).select("n_files", F.lit(store.complete(now)).alias("now"), F.lit(store.complete(old)).alias("before"))


Q["st14"] = _complete
S["st14"] = "SELECT count(*) AS n_files, true AS now, false AS before FROM documents"
Q["st3"] = lambda s, d: _snapshots(s, d)[1].select("path", "mtime_ns", "size")
S["st3"] = f"WITH {FILES} SELECT path, 5::BIGINT AS mtime_ns, strlen(content)::BIGINT AS size FROM files WHERE doc_id % 10 <> 0"


def _marked(s, d):
    """Marks appended twice to a list that is only ever added to, read back once each."""
    at = f"{shared_folder(s)}/dirty-{uuid.uuid4().hex}"
    for _ in range(2):
        I.snapshot_diff(*_snapshots(s, d)).select("path").write.mode("append").parquet(at)
    return I.dirty(s.read.parquet(at))


Q["st6"] = _marked
S["st6"] = f"WITH {FILES} SELECT path FROM files WHERE doc_id % 10 <= 2"
Q["st18"] = lambda s, d: I.delta_reads(_log(s, d)).select("session", "ord", F.when(F.col("status") == "unchanged", F.lit("[seen]")).otherwise(F.col("hash")).alias("body"))
S["st18"] = "WITH log AS (SELECT conv_id AS session, turn AS ord, role AS key, substr(sha256(substr(text, 1, 1)), 1, 8) AS hash FROM conversations) SELECT session, ord, CASE WHEN lag(hash) OVER (PARTITION BY session, key ORDER BY ord) = hash THEN '[seen]' ELSE hash END AS body FROM log"


def _checkpoint(s, d):
    """The content of dirty files, put by."""
    dirty = I.snapshot_diff(*_snapshots(s, d)).where("change <> 'added'").select("path")
    at = f"{shared_folder(s)}/checkpoint-{uuid.uuid4().hex}"
    files(s, d).join(dirty, "path", "left_semi").select("path", "content").write.parquet(at)
    return s.read.parquet(at)


Q["st24"] = lambda s, d: _checkpoint(s, d).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
S["st24"] = f"WITH {FILES} SELECT path, sha256(content) AS hash FROM files WHERE doc_id % 10 <= 1"


def _restored(s, d):
    """Files as they are after an edit of all of them, with those of the checkpoint as they were."""
    saved = _checkpoint(s, d)
    now = files(s, d).select("path", F.concat("content", F.lit("!")).alias("content"))
    return I.patched(now, saved.select("path", F.lit("modified").alias("change")), saved).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))


Q["st25"] = _restored
S["st25"] = f"WITH {FILES} SELECT path, sha256(CASE WHEN doc_id % 10 <= 1 THEN content ELSE content || '!' END) AS hash FROM files"

# The tree source and sink: files of the documents, written to a folder and walked.


def _tree(s, d, extra=()):
    root = f"{shared_folder(s)}/tree-{uuid.uuid4().hex}"
    scheme, _, rest = root.rpartition("://")
    root = rest if scheme in ("", "file") else root
    root = root.removeprefix("file:")
    rows = files(s, d).select("path", "content")
    for name, text in extra:
        rows = rows.union(G.docs(s, d).select(F.concat("dir", F.lit(name)).alias("path"), F.lit(text).alias("content")).distinct() if not name.startswith("/") else s.createDataFrame([(name[1:], text)], "path string, content string"))
    repo.write_repo(rows, root)
    return root


_hash = lambda: F.sha2(F.col("content"), 256).alias("hash")
Q["ed18"] = lambda s, d: repo.read_repo(s, _tree(s, d)).select("path", _hash())
S["ed18"] = f"WITH {FILES} SELECT path, sha256(content) AS hash FROM files"
Q["sc1"] = lambda s, d: repo.read_repo(s, _tree(s, d)).select("path", F.col("size").cast("long").alias("size"), _hash())
S["sc1"] = f"WITH {FILES} SELECT path, strlen(content)::BIGINT AS size, sha256(content) AS hash FROM files"
Q["sc2"] = lambda s, d: repo.read_repo(s, _tree(s, d), "src1").select("path")
S["sc2"] = f"WITH {FILES} SELECT path FROM files WHERE path LIKE 'src1/%'"
Q["sc4"] = lambda s, d: repo.read_repo(s, _tree(s, d, [("node_modules/x.js", "x"), (".next/y.js", "y"), (".hidden/z.txt", "z"), ("out/w.txt", "w")])).select("path").where("path NOT LIKE '%/%/%0%.txt'")
S["sc4"] = f"WITH {FILES}, dirs AS (SELECT DISTINCT source || '/' || lang || '/' AS dir FROM documents), a AS (SELECT path FROM files UNION ALL SELECT dir || '.hidden/z.txt' FROM dirs UNION ALL SELECT dir || 'out/w.txt' FROM dirs) SELECT path FROM a WHERE path NOT LIKE '%/%/%0%.txt'"
_RULES = "# comment\n\n1*.txt\n!12*.txt\n/src3/\n**/fr/5?.txt\n"
Q["sc5"] = lambda s, d: repo.read_repo(s, _tree(s, d, [("/.gitignore", _RULES)])).select("path").where("path <> '.gitignore'")
S["sc5"] = f"WITH {FILES} SELECT path FROM files WHERE NOT (regexp_matches(path, '/1[^/]*[.]txt$') AND NOT regexp_matches(path, '/12[^/]*[.]txt$')) AND path NOT LIKE 'src3/%' AND NOT regexp_matches(path, '/fr/5[^/][.]txt$')"
Q["sc7"] = lambda s, d: repo.ignored_paths(files(s, d).select("path"), ["1*.txt", "!12*.txt", "/src3/", "**/fr/5?.txt"]).select("path", "ignored")
S["sc7"] = f"WITH {FILES} SELECT path, (regexp_matches(path, '/1[^/]*[.]txt$') AND NOT regexp_matches(path, '/12[^/]*[.]txt$')) OR path LIKE 'src3/%' OR regexp_matches(path, '/fr/5[^/][.]txt$') AS ignored FROM files"

# Symbols of code made from the documents.
_CODE = [("p/a.py", "class Box:\n    \"\"\"Holds.\"\"\"\n    size = 1\n\n    def open(self, x):\n        for i in x:\n            print(i)\n        return x\n\n    def shut(self):\n        pass\n\ndef start():\n    return Box()\n"), ("p/b.go", "package b\nimport (\n  \"fmt\"\n  \"os\"\n)\ntype T struct {\n  a int\n}\nfunc (t *T) Run(x int) error {\n  fmt.Println(x)\n  return nil\n}\nfunc helper() {\n}\n")]
_NAMES = ["p", "Box", "start", "T", "Run", "helper"]
_code = lambda s, d: G.sources(s, d, _CODE, _NAMES)
_parsed = lambda s, d: parsers.parse_symbols(_code(s, d))
_WANT = [("p/a.py", "Box", "class", 1, 11), ("p/a.py", "open", "method", 5, 8), ("p/a.py", "shut", "method", 10, 11), ("p/a.py", "start", "function", 13, 14), ("p/b.go", "T", "struct", 6, 8), ("p/b.go", "Run", "method", 9, 12), ("p/b.go", "helper", "function", 13, 14)]
Q["sy18"] = lambda s, d: _parsed(s, d).select("path", "name", "kind", "start_line", "end_line")
S["sy18"] = G.answer("path, name, kind, start_line, end_line", _WANT, _NAMES)
Q["sy17"] = lambda s, d: parsers.parse_symbols(_code(s, d).where("path LIKE '%.go'")).select("path", "name", "start_line")
S["sy17"] = G.answer("path, name, start_line", [(p, n, a) for p, n, _, a, _ in _WANT if p.endswith("go")], _NAMES)


def _candidates(s, d):
    """Only files that the trigrams of a text let through are parsed."""
    made = _code(s, d).withColumn("text", F.decode("content", "UTF-8"))
    found = T.candidates(T.postings(made.select("path", F.col("text").alias("content"))), "Println")
    return parsers.parse_symbols(made.join(found, "path", "left_semi").select("path", "content")).select("path", "name", "start_line")


Q["sy19"], S["sy19"] = _candidates, S["sy17"]
Q["sy23"] = lambda s, d: Y.by_name(_parsed(s, d), "OPEN").select("path", "name", F.col("sym_id").isNotNull().alias("has_id"))
S["sy23"] = G.answer("path, name, has_id", [("p/a.py", "open", True)], _NAMES)
Q["sy21"] = lambda s, d: symbols(s, d).select("sym_id", C.name_hash("name").alias("hash"))
S["sy21"] = f"WITH {SYMBOLS} SELECT sym_id, substr(sha256(lower(name)), 1, 16) AS hash FROM symbols"
Q["sy40"] = lambda s, d: Y.header_degree(files(s, d).select("path"), edges(s, d))
S["sy40"] = f"WITH {FILES}, {EDGES}, i AS (SELECT imported AS path, count(*) AS n FROM edges GROUP BY 1) SELECT f.path, coalesce(i.n, 0)::BIGINT AS degree FROM files f LEFT JOIN i USING (path)"
_COMMANDS = ["files", "search", "orient", "focus", "edit", "rename", "verify", "status"]
_typed = lambda s, d: table(s, d, "documents").select("doc_id", F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z]+", 0)).alias("typed")).where("typed <> ''")
Q["sy42"] = lambda s, d: Y.command_suggestions(_typed(s, d), _COMMANDS, 8).select("doc_id", "command", F.col("distance").cast("long").alias("distance"))
S["sy42"] = f"WITH t AS (SELECT doc_id, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS typed FROM documents), c AS (SELECT unnest({_COMMANDS}) AS command), x AS (SELECT doc_id, command, levenshtein(typed, command)::BIGINT AS distance FROM t, c WHERE typed <> '') SELECT doc_id, command, distance FROM x WHERE distance <= 8 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, command) = 1"
Q["sy45"] = lambda s, d: Y.not_found(_typed(s, d).select("doc_id", F.col("typed").alias("name")), symbols(s, d), T.lines(files(s, d)).where("line = 1").select("path", "text"))
S["sy45"] = f"WITH {SYMBOLS}, t AS (SELECT doc_id, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS name FROM documents), n AS (SELECT DISTINCT lower(name) AS name FROM symbols), w AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_]{{2,}}'))) AS name FROM lines WHERE line = 1) SELECT doc_id, name, CASE WHEN n.name IS NOT NULL THEN 'symbol' WHEN w.name IS NOT NULL THEN 'text' ELSE 'nothing' END AS found FROM t LEFT JOIN n USING (name) LEFT JOIN w USING (name) WHERE name <> ''"
Q["sy48"] = lambda s, d: Y.container_stubs(_parsed(s, d)).select("path", "name", "members")
S["sy48"] = G.answer("path, name, members", [("p/a.py", "Box", "open, shut"), ("p/b.go", "T", "")], _NAMES)
Q["sy49"] = lambda s, d: Y.signatures(_parsed(s, d).where("path LIKE '%.go'")).join(_parsed(s, d).select("sym_id", "path", "name"), "sym_id").select("path", "name", "signature")
S["sy49"] = G.answer("path, name, signature", [("p/b.go", "T", "type T struct"), ("p/b.go", "Run", "func (t *T) Run(x int) error"), ("p/b.go", "helper", "func helper()")], _NAMES)
Q["sy50"] = lambda s, d: Y.outline(_parsed(s, d)).select("path", "name", "depth", "start_line")
S["sy50"] = G.answer("path, name, depth, start_line", [("p/a.py", "Box", 0, 1), ("p/a.py", "open", 1, 5), ("p/a.py", "shut", 1, 10), ("p/a.py", "start", 0, 13), ("p/b.go", "T", 0, 6), ("p/b.go", "Run", 0, 9), ("p/b.go", "helper", 0, 13)], _NAMES)
_lines = lambda s, d: T.lines(_code(s, d).select("path", F.decode("content", "UTF-8").alias("content")))
Q["sy53"] = lambda s, d: Y.collapsed_blocks(_lines(s, d), 2).where("path LIKE '%.py'").select("path", "line", "hidden")
S["sy53"] = G.answer("path, line, hidden", [("p/a.py", 5, 3), ("p/a.py", 6, 1), ("p/a.py", 10, 1)], _NAMES, ("line",))
Q["sy54"] = lambda s, d: Y.collapsed_imports(_lines(s, d)).select("path", "first", "last")
S["sy54"] = G.answer("path, first, last", [("p/b.go", 2, 5)], _NAMES, ("first", "last"))

# Callers and expansion.
Q["gr15"] = lambda s, d: R.callers_with_fallback(symbols(s, d), refs(s, d), edges(s, d), files(s, d), table(s, d, "documents").select(F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z0-9_]{2,}", 0)).alias("name_lc")).where("name_lc <> ''").distinct()).select("name_lc", "n")
S["gr15"] = f"WITH {REFS}, w AS (SELECT DISTINCT lower(regexp_extract(coalesce(text, ''), '[A-Za-z0-9_]{{2,}}')) AS name_lc FROM documents), g AS (SELECT name_lc, count(*) AS n FROM refs GROUP BY 1), l AS (SELECT DISTINCT path, lower(unnest(regexp_extract_all(content, '[A-Za-z0-9_]{{2,}}'))) AS name_lc FROM files), t AS (SELECT name_lc, count(*) AS n FROM l GROUP BY 1) SELECT name_lc, coalesce(g.n, t.n, 0)::BIGINT AS n FROM w LEFT JOIN g USING (name_lc) LEFT JOIN t USING (name_lc) WHERE name_lc <> ''"
Q["gr18"] = lambda s, d: T.word_spans(files(s, d), "of").select("path", "start")
S["gr18"] = f"WITH {FILES}, p AS (SELECT path, string_split_regex(content, '\\bof\\b') AS parts FROM files), k AS (SELECT path, parts, unnest(range(1, len(parts))) AS k FROM p) SELECT path, (strlen(array_to_string(parts[1:k], '')) + (k - 1) * 2)::BIGINT AS start FROM k"
Q["gr10"] = lambda s, d: R.narrowed(*_multi(s, d))
_MULTI = [("a.py", "m", "m1.py", "go"), ("a.py", "m", "m2.py", "run"), ("b.py", "m", "m1.py", "go"), ("b.py", "m", "m2.py", "run")]


def _multi(s, d):
    """Imports of a name that two files answer to; a.py uses what the second one defines, b.py nothing of either."""
    rows = G.rows(s, d, _MULTI, "importer string, raw string, imported string, defines string", ["a", "b", "m", "m1", "m2"])
    used = G.rows(s, d, [("a.py", "run"), ("b.py", "none")], "path string, name string", ["a", "b"]).select("path", "name")
    return rows.select("importer", "raw", "imported"), rows.select(F.col("imported").alias("path"), F.col("defines").alias("name")).distinct(), used


S["gr10"] = G.answer("importer, raw, imported", [("a.py", "m", "m2.py"), ("b.py", "m", "m1.py")], ["a", "b", "m", "m1", "m2"])
Q["bd18"] = lambda s, d: B.builtin_refs(_typed(s, d).select("doc_id", F.col("typed").alias("name")), ["the", "of", "and", "der", "le"])
S["bd18"] = "SELECT doc_id, name, name IN ('the', 'of', 'and', 'der', 'le') AS builtin FROM (SELECT doc_id, lower(regexp_extract(coalesce(text, ''), '[A-Za-z]+')) AS name FROM documents) WHERE name <> ''"

# Edit verbs over code made from the documents.


def _made(s, d):
    return _code(s, d).select("path", F.decode("content", "UTF-8").alias("content"))


def _after(s, d, edits_):
    return E.spliced(_made(s, d), edits_).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))


def _expect(path, code, names=None):
    """SQL of a file's hash after an edit, given as its template."""
    names = _NAMES if names is None else names
    return f"WITH {G.DOCS} SELECT dir || {G.tagged_sql(path, names)} AS path, sha256(repeat(chr(10), shift) || {G.tagged_sql(code, names)}) AS hash FROM docs"


_A, _B = _CODE[0][1], _CODE[1][1]
_spans = lambda s, d, where: _parsed(s, d).where(where).select("path", "name", "start_byte", "end_byte", "body", "start_line", "end_line")
Q["ed3"] = lambda s, d: E.replace_in_symbol(_made(s, d), _spans(s, d, "name = 'open'"), "return x", "return None").select("path", "n", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
S["ed3"] = f"SELECT path, 1::BIGINT AS n, hash FROM ({_expect('p/a.py', _A.replace('return x', 'return None'))})"
Q["ed11"] = lambda s, d: _after(s, d, E.guarded(_spans(s, d, "name = 'shut'").join(_made(s, d), "path").select("path", "start_byte", "end_byte", F.lit("pass").alias("replacement"), F.sha2(F.encode("content", "UTF-8"), 256).alias("expect_hash")), _made(s, d)))
S["ed11"] = _expect("p/a.py", _A.replace("def shut(self):\n        pass", "pass"))
_move = lambda s, d, path, name, to, after: G.docs(s, d).select(*(F.concat(*( ["dir"] if i in (0, 2) else []), G.tagged(v, _NAMES)).alias(c) for i, (v, c) in enumerate(((path, "path"), (name, "name"), (to, "to_path"), (after, "after")))))  # noqa: E731, E201
Q["ed8"] = lambda s, d: _after(s, d, E.moved_after(_parsed(s, d), _move(s, d, "p/b.go", "T", "p/b.go", "helper")))
S["ed8"] = _expect("p/b.go", _B.replace("type T struct {\n  a int\n}", "").replace("func helper() {\n}", "func helper() {\n}\ntype T struct {\n  a int\n}"))
Q["ed9"] = lambda s, d: _after(s, d, E.moved_after(_parsed(s, d), _move(s, d, "p/b.go", "helper", "p/a.py", "start")))
S["ed9"] = _expect("p/b.go", _B.replace("func helper() {\n}", "")) + " UNION ALL " + _expect("p/a.py", _A.replace("    return Box()", "    return Box()\nfunc helper() {\n}")).split("FROM documents) ", 1)[1]
Q["ed20"] = lambda s, d: _after(s, d, E.insert_after_symbol(_parsed(s, d), G.docs(s, d).select(F.concat("dir", G.tagged("p/a.py", _NAMES)).alias("path"), G.tagged("start", _NAMES).alias("name"), F.lit("x = 1").alias("text"))))
S["ed20"] = _expect("p/a.py", _A.replace("    return Box()", "    return Box()\nx = 1"))
Q["ed21"] = lambda s, d: E.insert_inside(_lines(s, d), _parsed(s, d), G.docs(s, d).select(F.concat("dir", G.tagged("p/a.py", _NAMES)).alias("path"), G.tagged("Box", _NAMES).alias("name"), F.lit("one = 1\ntwo = 2").alias("text"))).select("path", "before_line", "text")
S["ed21"] = G.answer("path, before_line, text", [("p/a.py", 11, "    one = 1\n    two = 2")], _NAMES, ("before_line",))
Q["ed19"] = lambda s, d: files(s, d).select("path", F.sha2(F.encode(F.concat("content", F.lit("\nend\n")), "UTF-8"), 256).alias("hash"))
S["ed19"] = f"WITH {FILES} SELECT path, sha256(content || chr(10) || 'end' || chr(10)) AS hash FROM files"
Q["ed13"] = lambda s, d: E.lcs_lines(G.rows(s, d, [("f", "a\nb\nc\nd", "a\nc\nx\nd"), ("g", "x\nd", "x\nd")], "path string, old string, new string", ["f", "g", "a", "b", "c", "d", "x"]).select("path", "old", "new"))
S["ed13"] = G.answer("path, old_line, new_line", [("f", 1, 1), ("f", 3, 2), ("f", 4, 4), ("g", 1, 1), ("g", 2, 2)], ["f", "g"], (), ())
_NEAR = [("a", "go(x,  y)\n", "white space"), ("b", "    go(x, y)\n    run(z)\n", "indentation"), ("c", "go(x, y)\nother\n", "first line"), ("d", "go(x, yy)\n", "alike"), ("e", "nothing of it\n", "nothing")]
_near_row = {"a": "go(x,  y)\nrun(z)\n", "b": "go(x, y)\n    run(z)\n", "c": "go(x, y)\nother\n", "d": "go(x, yy)\nother\n", "e": "nothing of it\n", "f": "go(x, y)\nrun(z)\n"}
Q["ed15"] = lambda s, d: E.near_matches(G.rows(s, d, list(_near_row.items()), "path string, content string", list("abcdef")).select("path", "content"), "go(x, y)\nrun(z)")
S["ed15"] = G.answer("path, why", [("a", "white space"), ("b", "white space"), ("c", "first line"), ("d", "alike"), ("e", "nothing")], list("abcdef"), (), ())
Q["ed17"] = lambda s, d: E.ambiguous_matches(_lines(s, d), _parsed(s, d), "return").select("path", "line", "name")
S["ed17"] = G.answer("path, line, name", [("p/a.py", 8, "open"), ("p/a.py", 14, "start")], _NAMES, ("line",))

# Smaller rules.
Q["ov22"] = lambda s, d: O.next_actions(_sites(s, d), "rename old new")
_sites = lambda s, d: table(s, d, "events").select(F.when(F.col("event_id") % 3 == 0, "definite").otherwise("probable").alias("tier"))
S["ov22"] = "WITH n AS (SELECT count(*) FILTER (event_id % 3 = 0) AS a, count(*) FILTER (event_id % 3 <> 0) AS b FROM events) SELECT 0 AS place, 'apply ' || a || ': rename old new --apply' AS action FROM n UNION ALL SELECT 1, 'review ' || b || ': rename old new --tier probable' FROM n"
Q["ov24"] = lambda s, d: O.envelope_summary(table(s, d, "events").select(F.col("event_type").alias("op"), (F.col("user_id") % 5 > 0).alias("ok")))
S["ov24"] = "SELECT event_type AS op, count(*) AS n, count(*) FILTER (user_id % 5 = 0) AS n_failed FROM events GROUP BY 1"
Q["ov25"] = lambda s, d: O.aggregated_status(table(s, d, "events").select(F.col("event_type").alias("component"), (F.col("user_id") % 7 % 4).cast("int").alias("level")))
S["ov25"] = "WITH r AS (SELECT event_type AS component, (user_id % 7 % 4)::INTEGER AS level FROM events) SELECT component, level, count(*) AS n FROM r GROUP BY 1, 2 QUALIFY level = max(level) OVER (PARTITION BY component)"
