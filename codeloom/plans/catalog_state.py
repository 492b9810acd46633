"""Queries of binding, overview, ledger, edits, snapshots and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import binding as B
from codeloom.operators import edits as E
from codeloom.operators import overview as O
from codeloom.operators import text as T
from codeloom.plans.adapters import EDGES, FILES, LINES, SYMBOLS, edges, files, symbols, table
from codeloom.streaming import incremental as I

Q: dict = {}
S: dict[str, str] = {}

#: A small tree of scopes for each document, in forty folders: file, class, method, block; names repeat at different depths.
_SCOPES = [(1, None, "file", 0, 1000), (2, 1, "class", 100, 900), (3, 2, "function", 200, 500), (4, 3, "block", 300, 400), (5, 1, "function", 910, 990)]
_DECLS = [(1, "top", "value", "function", 1, 10, 20), (2, "Box", "type", "class", 1, 90, 95), (3, "item", "value", "field", 2, 110, 120), (4, "item", "value", "variable", 3, 210, 220), (5, "inner", "value", "variable", 4, 310, 320), (6, "inner", "value", "variable", 4, 330, 340), (7, "Arg", "type", "type", 5, 912, 915), (8, "top", "value", "variable", 5, 920, 930)]
_REFS = [(1, "item", "value", 4, 350, 354, None), (2, "top", "value", 3, 230, 233, None), (3, "inner", "value", 4, 360, 365, None), (4, "inner", "value", 3, 450, 455, None), (5, "print", "value", 5, 940, 945, None), (6, "field", "value", 3, 460, 465, "property_access"), (7, "top", "value", 5, 950, 953, None), (8, "Arg", "type", 1, 960, 963, None), (9, "item", "value", 2, 600, 604, None)]


def _sql(rows, columns):
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns}))"


def _tables(s, d):
    paths = table(s, d, "documents").select(F.concat(F.lit("d"), (F.col("doc_id") % 40).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".x")).alias("path"), F.col("doc_id").alias("k"))
    sc = paths.join(F.broadcast(s.createDataFrame(_SCOPES, "scope_id int, parent_id int, kind string, start_byte int, end_byte int")), F.lit(True))
    de = paths.join(F.broadcast(s.createDataFrame(_DECLS, "ord int, name string, ns string, kind string, scope_id int, start_byte int, end_byte int")), F.lit(True)).withColumn("decl_id", F.concat("path", F.lit(":"), F.col("ord").cast("string")))
    re = paths.join(F.broadcast(s.createDataFrame(_REFS, "ord int, name string, ns string, scope_id int, start_byte int, end_byte int, reason string")), F.lit(True))
    return sc.drop("k"), de.where("k % 3 <> 1 OR ord <> 4").drop("k"), re.drop("k")


TREE = f"""p AS (SELECT 'd' || CAST(doc_id % 40 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.x' AS path, doc_id AS k FROM documents), scopes AS (SELECT path, s.* FROM p, {_sql(_SCOPES, 'scope_id, parent_id, kind, start_byte, end_byte')} s),
decls AS (SELECT path, path || ':' || CAST(ord AS VARCHAR) AS decl_id, s.* FROM p, {_sql(_DECLS, 'ord, name, ns, kind, scope_id, start_byte, end_byte')} s WHERE k % 3 <> 1 OR ord <> 4),
refs AS (SELECT path, s.* FROM p, {_sql(_REFS, 'ord, name, ns, scope_id, start_byte, end_byte, reason')} s),
up(path, scope_id, ancestor, depth) AS (SELECT path, scope_id, scope_id, 0 FROM scopes UNION ALL SELECT u.path, u.scope_id, s.parent_id, u.depth + 1 FROM up u JOIN scopes s ON s.path = u.path AND s.scope_id = u.ancestor WHERE s.parent_id IS NOT NULL)"""
BIND = TREE + """, open AS (SELECT * FROM refs WHERE coalesce(reason, '') <> 'property_access'),
direct AS (SELECT r.path, r.ord, arg_min(d.decl_id, u.depth * 1000 + d.ord) AS direct_id FROM open r JOIN up u ON u.path = r.path AND u.scope_id = r.scope_id JOIN decls d ON d.path = r.path AND d.scope_id = u.ancestor AND d.name = r.name AND d.ns = r.ns {where} GROUP BY 1, 2),
sig AS (SELECT r.path, r.ord, arg_min(d.decl_id, d.ord) AS sig_id FROM open r JOIN decls d ON d.path = r.path AND d.name = r.name AND d.ns = 'type' AND d.start_byte < r.start_byte JOIN scopes s ON s.path = d.path AND s.scope_id = d.scope_id AND s.end_byte >= r.end_byte GROUP BY 1, 2)
SELECT r.path, r.ord, coalesce(direct_id, sig_id, CASE WHEN r.name = 'print' THEN 'builtin:print' END) AS decl_id, CASE WHEN direct_id IS NULL AND sig_id IS NULL AND r.name <> 'print' THEN 'unresolved' ELSE 'resolved' END AS bind_kind,
CASE WHEN direct_id IS NOT NULL THEN 'direct_scope' WHEN sig_id IS NOT NULL THEN 'signature_scope' WHEN r.name = 'print' THEN 'builtin' ELSE 'missing_import' END AS reason FROM open r LEFT JOIN direct USING (path, ord) LEFT JOIN sig USING (path, ord)"""
Q["bd16"] = lambda s, d: B.bind(*_tables(s, d), ["print"])
S["bd16"] = "WITH RECURSIVE " + BIND.replace("{where}", "")
Q["bd17"] = lambda s, d: B.bind(*_tables(s, d), ["print"], class_scopes_hide=True)
S["bd17"] = "WITH RECURSIVE " + BIND.replace("{where}", "JOIN scopes z ON z.path = u.path AND z.scope_id = u.ancestor AND (u.depth = 0 OR z.kind <> 'class')")
Q["bd19"] = lambda s, d: B.refs_to(B.bind(*_tables(s, d)).withColumn("candidates", F.array(F.concat("path", F.lit(":8")))), "d7/7.x:8").select("path", "ord")
S["bd19"] = "WITH RECURSIVE " + BIND.replace("{where}", "").replace("'print'", "'-'") + " WHERE r.path = 'd7/7.x'"
S["bd19"] = f"SELECT path, ord FROM ({S['bd19']})"
Q["bd20"] = lambda s, d: B.file_scope_decl(_tables(s, d)[1])
S["bd20"] = f"WITH RECURSIVE {TREE} SELECT path, name, arg_min(decl_id, ord) AS decl_id FROM decls WHERE scope_id = 1 GROUP BY 1, 2"
Q["bd21"] = lambda s, d: B.merge_in_file(_tables(s, d)[1]).select("decl_id", "canonical_id")
S["bd21"] = f"WITH RECURSIVE {TREE} SELECT decl_id, first_value(decl_id) OVER (PARTITION BY path, scope_id, name, kind ORDER BY ord) AS canonical_id FROM decls"
Q["bd22"] = lambda s, d: B.merge_across_files(_tables(s, d)[1].withColumns({"lang": F.lit("x"), "qualifier": F.substring_index("path", "/", 1)})).select("decl_id", "canonical_id")
S["bd22"] = f"WITH RECURSIVE {TREE} SELECT decl_id, first_value(decl_id) OVER (PARTITION BY split_part(path, '/', 1), name, kind ORDER BY path, ord) AS canonical_id FROM decls"
Q["bd23"] = lambda s, d: B.owners(*_tables(s, d)[:2])
OWN = "owners AS (SELECT s.path, s.scope_id, arg_max(d.name, d.end_byte) AS owner FROM scopes s JOIN decls d ON d.path = s.path AND d.scope_id = s.parent_id AND d.end_byte <= s.start_byte GROUP BY 1, 2)"
S["bd23"] = f"WITH RECURSIVE {TREE}, {OWN} SELECT path, scope_id, owner FROM owners"
Q["bd24"] = lambda s, d: B.qualifiers(*_tables(s, d)[:2])
S["bd24"] = f"WITH RECURSIVE {TREE}, {OWN}, q AS (SELECT u.path, u.scope_id, string_agg(owner, '.' ORDER BY depth DESC) AS qualifier FROM up u JOIN owners o ON o.path = u.path AND o.scope_id = u.ancestor GROUP BY 1, 2) SELECT s.path, s.scope_id, coalesce(qualifier, '') AS qualifier FROM scopes s LEFT JOIN q USING (path, scope_id)"
Q["bd64"] = lambda s, d: B.name_match_only(_ascii_spans(s, d), _ascii_spans(s, d).where("start % 2 = 0"))
_ascii_spans = lambda s, d: T.word_spans(files(s, d), "thing")
SPANS = FILES + """, p AS (SELECT path, string_split_regex(content, '\\bthing\\b') AS parts FROM files), k AS (SELECT path, parts, unnest(range(1, len(parts))) AS k FROM p),
spans AS (SELECT path, strlen(array_to_string(parts[1:k], '')) + (k - 1) * 5 AS start FROM k)"""
S["bd64"] = f"WITH {SPANS} SELECT path, count(*) AS n FROM spans WHERE start % 2 <> 0 GROUP BY 1"
Q["bd70"] = lambda s, d: T.line_starts(files(s, d))
S["bd70"] = f"WITH {LINES} SELECT path, line::INTEGER AS line, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines"
Q["bd71"] = lambda s, d: B.line_of(files(s, d).select("path", F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 50, 500, 5000)])).alias("pos")), T.line_starts(files(s, d)))
S["bd71"] = f"WITH {LINES}, st AS (SELECT path, line, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lines), q AS (SELECT path, unnest([0, 50, 500, 5000])::BIGINT AS pos FROM files) SELECT path, pos, max(line)::INTEGER AS line, pos - max(start) + 1 AS col FROM q JOIN st USING (path) WHERE start <= pos GROUP BY 1, 2"

VISIBLE = "reach AS (SELECT *, max(CASE WHEN kind IN ('function', 'method', 'variable') AND start_line < end_line THEN end_line END) OVER (PARTITION BY path ORDER BY start_line RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM symbols), seen AS (SELECT * FROM reach WHERE r IS NULL OR end_line > r)"
_inbound = lambda s, d: edges(s, d).groupBy(F.col("imported").alias("path")).agg(F.count("*").alias("inbound"))


def _overview_sql(budget: int, by: str) -> str:
    order = "inbound DESC, n_symbols DESC, depth, path" if by == "inbound" else "depth, inbound DESC, path"
    est = budget * 4 // O.LINE_COST
    cap = f"greatest(2, {est} // greatest(2, least(n, {est} // 2)))" if by == "inbound" else f"CASE WHEN n = 1 THEN 1000000000 WHEN {est} < n THEN 1 ELSE greatest(2, {est} // n) END"
    return f"""WITH {SYMBOLS}, {EDGES.replace('n AS (SELECT count(*) AS n FROM files)', 'nn AS (SELECT count(*) AS n FROM files)').replace('FROM files, n)', 'FROM files, nn)')}, {VISIBLE},
inb AS (SELECT imported AS path, count(*) AS inbound FROM edges GROUP BY 1), f AS (SELECT path, count(*) AS n_symbols, coalesce(max(inbound), 0) AS inbound, len(string_split(path, '/')) AS depth FROM seen LEFT JOIN inb USING (path) GROUP BY path),
o AS (SELECT path, row_number() OVER (ORDER BY {order}) AS place, count(*) OVER () AS n FROM f),
t AS (SELECT s.*, place, n, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN kind = 'class' THEN 100 WHEN kind = 'function' THEN 60 ELSE 30 END + least((end_line - start_line + 1) // 10, 20) DESC, start_line) AS k FROM seen s JOIN o USING (path)),
c AS (SELECT *, length('  ' || kind || ' ' || name || ' [' || CAST(start_line AS VARCHAR) || '-' || CAST(end_line AS VARCHAR) || ']' || chr(10)) + CASE WHEN k = 1 THEN length(path) + 2 ELSE 0 END AS cost FROM t WHERE k <= {cap}),
b AS (SELECT *, coalesce(sum(cost) OVER (ORDER BY place, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent FROM c)
SELECT path, name, kind, start_line, place, spent FROM b WHERE spent < {budget * 4}"""


Q["ov1"] = lambda s, d: O.overview(symbols(s, d), _inbound(s, d), 500, by="depth")
S["ov1"] = _overview_sql(500, "depth")
Q["ov2"] = lambda s, d: O.overview(symbols(s, d), _inbound(s, d), 500)
S["ov2"] = _overview_sql(500, "inbound")
Q["ov5"] = lambda s, d: O.visible(symbols(s, d)).select("sym_id")
S["ov5"] = f"WITH {SYMBOLS}, {VISIBLE} SELECT sym_id FROM seen"
Q["ov6"] = lambda s, d: T.budgeted(files(s, d).select("path"), 100)
S["ov6"] = f"WITH {FILES}, c AS (SELECT path, (sum(greatest(1, (length(path) + 3) // 4) + 1) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING))::BIGINT AS spent, row_number() OVER (ORDER BY path) AS n FROM files) SELECT path, spent FROM c WHERE n = 1 OR spent <= 100"
Q["ov7"] = lambda s, d: files(s, d).select("path", F.floor((F.length("content") + 3) / 4).cast("long").alias("tokens"))
S["ov7"] = f"WITH {FILES} SELECT path, (length(content) + 3) // 4 AS tokens FROM files"
Q["ov8"] = lambda s, d: files(s, d).select("path", O.cut_at_line(F.col("content"), 300).alias("head"))
S["ov8"] = f"WITH {FILES}, h AS (SELECT path, content, substr(content, 1, 300) AS h FROM files) SELECT path, CASE WHEN length(content) <= 300 THEN content WHEN contains(h, chr(10)) THEN substr(h, 1, 300 - instr(reverse(h), chr(10))) ELSE h END AS head FROM h"
Q["ov9"] = lambda s, d: files(s, d).select("path", O.is_code(F.col("path")).alias("code"), O.is_test(F.col("path")).alias("test"))
S["ov9"] = f"WITH {FILES} SELECT path, false AS code, false AS test FROM files"
Q["ov11"] = lambda s, d: T.lines(files(s, d)).where("line BETWEEN 2 AND 3")
S["ov11"] = f"WITH {LINES} SELECT path, line::INTEGER AS line, text FROM lines WHERE line BETWEEN 2 AND 3"
Q["ov16"] = lambda s, d: files(s, d).select(F.substring_index("path", "/", 2).alias("dir")).distinct()
S["ov16"] = "SELECT DISTINCT source || '/' || lang AS dir FROM documents"
Q["ov4"] = lambda s, d: O.directory_summary(symbols(s, d))
S["ov4"] = f"WITH {SYMBOLS} SELECT string_split(path, '/')[1] AS dir, count(DISTINCT path) AS n_files, count(*) AS n_symbols FROM symbols GROUP BY 1"


def _sites(s, d):
    return table(s, d, "events").select(F.concat(F.lit("u/"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("path"), F.col("event_id").alias("start"), (F.col("event_id") + F.col("user_id") % 5).alias("end_byte"), "event_type", F.when(F.col("event_id") % 3 == 0, "definite").when(F.col("event_id") % 3 == 1, "probable").otherwise("mention").alias("tier"), F.lit("code").alias("role"))


SITES = "sites AS (SELECT 'u/' || CAST(user_id AS VARCHAR) || '/' || event_type AS path, event_id AS start, event_id + user_id % 5 AS end_byte, event_type, CASE event_id % 3 WHEN 0 THEN 'definite' WHEN 1 THEN 'probable' ELSE 'mention' END AS tier FROM events)"
Q["ov17"] = lambda s, d: O.ledger_filter(_sites(s, d), ["definite", "probable"], "u/1*/*")[0].select("path", "start", "tier")
S["ov17"] = f"WITH {SITES} SELECT path, start, tier FROM sites WHERE tier IN ('definite', 'probable') AND regexp_matches(path, '^u/1[^/]*/[^/]*$')"
Q["ov18"] = lambda s, d: O.ledger_filter(_sites(s, d), ["definite", "probable"], "u/1*/*")[1]
S["ov18"] = f"WITH {SITES} SELECT tier, count(*) AS n FROM sites WHERE NOT (tier IN ('definite', 'probable') AND regexp_matches(path, '^u/1[^/]*/[^/]*$')) GROUP BY 1"
Q["ov19"] = lambda s, d: O.invalid_sites(_sites(s, d))
S["ov19"] = f"WITH {SITES} SELECT path, start, 'malformed span' AS fault FROM sites WHERE start >= end_byte UNION ALL SELECT path, start, 'claimed twice' FROM sites GROUP BY 1, 2 HAVING count(*) > 1"
Q["ov20"] = lambda s, d: _sites(s, d).select("start", O.site_key(F.col("path"), F.col("start"), F.col("end_byte"), F.col("tier"), F.col("event_type")).alias("key"))
S["ov20"] = f"WITH {SITES} SELECT start, sha256('v1' || chr(0) || path || chr(0) || CAST(start AS VARCHAR) || chr(0) || CAST(end_byte AS VARCHAR) || chr(0) || tier || chr(0) || event_type) AS key FROM sites"
Q["ov21"] = lambda s, d: O.short_ids(_sites(s, d)).select("start", "short_id")
S["ov21"] = f"WITH {SITES} SELECT start, tier[1] || CAST(row_number() OVER (PARTITION BY tier ORDER BY path, start) AS VARCHAR) AS short_id FROM sites"
_per_source = lambda s, d: files(s, d).withColumn("group", F.substring_index("path", "/", 2))
Q["ov23"] = lambda s, d: O.common_directories(_per_source(s, d), "group")
S["ov23"] = "SELECT DISTINCT source || '/' || lang AS \"group\", source || '/' || lang AS directory FROM documents"


def _renames(s, d):
    return E.rename_edits(_ascii_spans(s, d), "entity")


Q["rn1"] = lambda s, d: E.spliced(files(s, d), _renames(s, d))
S["rn1"] = f"WITH {FILES} SELECT path, regexp_replace(content, '\\bthing\\b', 'entity', 'g') AS content FROM files WHERE regexp_matches(content, '\\bthing\\b')"
Q["rn1_gate"] = lambda s, d: E.rename_gate(_renames(s, d))
S["rn1_gate"] = f"WITH {SPANS} SELECT count(DISTINCT path) AS n_files, count(*) AS n_edits, count(DISTINCT path) <= 50 AND count(*) <= 200 AS allowed FROM spans"
Q["rn19"] = lambda s, d: B.tiers(B.bind(*_tables(s, d), ["print"]))
S["rn19"] = "WITH RECURSIVE " + BIND.replace("{where}", "")
S["rn19"] = f"SELECT bind_kind, count(*) AS n FROM ({S['rn19']}) GROUP BY 1"
Q["rn21"] = lambda s, d: B.collisions(*_tables(s, d)[:2], 3, "d7/7.x", "item")
S["rn21"] = f"WITH RECURSIVE {TREE} SELECT decl_id FROM decls WHERE path = 'd7/7.x' AND name = 'item' AND scope_id IN (SELECT ancestor FROM up WHERE path = 'd7/7.x' AND scope_id = 3 UNION SELECT scope_id FROM up WHERE path = 'd7/7.x' AND ancestor = 3)"
Q["rn22"] = lambda s, d: _renames(s, d).union(_renames(s, d)).distinct().select("path", "start_byte")
S["rn22"] = f"WITH {SPANS} SELECT path, start::BIGINT AS start_byte FROM spans"
Q["ed2"] = lambda s, d: E.replace_once(files(s, d), "thing in", "X").select("path", "n", F.length("content").cast("long").alias("size"))
S["ed2"] = f"WITH {FILES}, c AS (SELECT path, content, (strlen(content) - strlen(replace(content, 'thing in', ''))) // 8 AS n FROM files) SELECT path, n::BIGINT AS n, length(CASE WHEN n = 1 THEN replace(content, 'thing in', 'X') ELSE content END) AS size FROM c"
Q["ed4"] = lambda s, d: E.fuzzy_matches(files(s, d), "in \n the")
S["ed4"] = f"WITH {FILES}, z AS (SELECT path, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM files), c AS (SELECT path, ((strlen(t) - strlen(replace(t, 'in the', ''))) // 6)::BIGINT AS n FROM z) SELECT path, n FROM c WHERE n > 0"
Q["ed5"] = lambda s, d: files(s, d).select("path", F.hex(E.overlay_binary(F.col("content"), 3, 7, "[new]")).alias("data"))
S["ed5"] = f"WITH {FILES} SELECT path, substr(hex(encode(content)), 1, 6) || hex(encode('[new]')) || substr(hex(encode(content)), 15) AS data FROM files"
Q["ed6"] = lambda s, d: files(s, d).select("path", E.replace_lines(F.col("content"), 2, 3, "one\ntwo").alias("content"))
S["ed6"] = f"WITH {FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files) SELECT path, array_to_string(list_concat(list_concat(l[1:1], ['one', 'two']), l[4:]), chr(10)) AS content FROM l"
Q["ed7"] = lambda s, d: files(s, d).select("path", E.insert_at_line(F.col("content"), 2, "new line").alias("content"))
S["ed7"] = f"WITH {FILES}, l AS (SELECT path, string_split(content, chr(10)) AS l FROM files) SELECT path, array_to_string(list_concat(list_concat(l[1:1], ['new line']), l[2:]), chr(10)) AS content FROM l"
Q["ed12"] = lambda s, d: files(s, d).select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"))
S["ed12"] = f"WITH {FILES} SELECT path, sha256(content) AS hash FROM files"
Q["ed16"] = lambda s, d: E.bigram_similarity(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("a"), F.col("p_type").alias("b"))).select("id", F.round("similarity", 5).alias("similarity"))
S["ed16"] = """WITH x AS (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part), ga AS (SELECT id, substr(a, unnest(range(1, length(a))), 2) AS g FROM x), gb AS (SELECT id, substr(b, unnest(range(1, length(b))), 2) AS g FROM x),
na AS (SELECT id, g, count(*) AS n FROM ga GROUP BY 1, 2), nb AS (SELECT id, g, count(*) AS n FROM gb GROUP BY 1, 2), c AS (SELECT id, sum(least(na.n, nb.n)) AS common FROM na JOIN nb USING (id, g) GROUP BY 1)
SELECT id, round(CASE WHEN length(a) + length(b) > 2 THEN 2 * coalesce(common, 0) / (length(a) + length(b) - 2) ELSE 0 END, 5)::DOUBLE AS similarity FROM x LEFT JOIN c USING (id)"""
Q["ed23"] = lambda s, d: E.error_places(table(s, d, "nation").select(F.concat(F.lit("err at src/"), F.lower("n_name"), F.lit(".go:"), F.col("n_nationkey").cast("string"), F.lit(": bad")).alias("text")))
S["ed23"] = "SELECT regexp_extract('err at src/' || lower(n_name) || '.go:' || n_nationkey || ': bad', '([A-Za-z0-9_./-]+\\.[A-Za-z0-9]+):', 1) AS path, n_nationkey::BIGINT AS line FROM nation"


def _snapshots(s, d):
    now = files(s, d).select("path", "doc_id", F.lit(5).cast("long").alias("mtime_ns"), F.octet_length("content").cast("long").alias("size"))
    old = now.where("doc_id % 10 <> 2").withColumn("mtime_ns", F.when(F.col("doc_id") % 10 == 1, 4).otherwise(5).cast("long"))
    return old, now.where("doc_id % 10 <> 0")


CHANGES = "changes AS (SELECT path, CASE doc_id % 10 WHEN 0 THEN 'deleted' WHEN 1 THEN 'modified' WHEN 2 THEN 'added' END AS change FROM files WHERE doc_id % 10 <= 2)"
Q["st1"] = lambda s, d: I.snapshot_diff(*_snapshots(s, d))
S["st1"] = f"WITH {FILES}, {CHANGES} SELECT path, change FROM changes"
Q["st4"] = lambda s, d: I.fresh(*_snapshots(s, d)).select("path")
S["st4"] = f"WITH {FILES} SELECT path FROM files WHERE doc_id % 10 > 2"
Q["st7"] = lambda s, d: I.dirty(I.snapshot_diff(*_snapshots(s, d)).union(I.snapshot_diff(*_snapshots(s, d))))
S["st7"] = f"WITH {FILES} SELECT path FROM files WHERE doc_id % 10 <= 2"


def _patched(s, d):
    old, now = _snapshots(s, d)
    before = T.postings(files(s, d).join(old.select("path"), "path", "left_semi")).withColumn("gen", F.lit(0))
    after = T.postings(files(s, d).join(now.select("path"), "path", "left_semi")).withColumn("gen", F.lit(1))
    return I.patched(before, I.snapshot_diff(old, now), after).groupBy("path", "gen").agg(F.count("*").alias("n"))


Q["st9"] = _patched
S["st9"] = f"""WITH {FILES}, {CHANGES}, h AS (SELECT path, doc_id, hex(encode(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h FROM files WHERE doc_id % 10 <> 0),
g AS (SELECT DISTINCT path, doc_id, substr(h, 2 * i + 1, 6) AS tri FROM (SELECT path, doc_id, h, unnest(range(0, length(h) // 2 - 2)) AS i FROM h)) SELECT path, CASE WHEN doc_id % 10 <= 2 THEN 1 ELSE 0 END AS gen, count(*) AS n FROM g GROUP BY 1, 2"""


def _log(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("ord"), F.when(F.col("turn") % 3 == 1, "edit").when(F.col("turn") % 5 == 4, "verify").otherwise("read").alias("op"), F.col("role").alias("key"), F.substring(F.sha2(F.substring("text", 1, 1).cast("binary"), 256), 1, 8).alias("hash"))


LOG = "log AS (SELECT conv_id AS session, turn AS ord, CASE WHEN turn % 3 = 1 THEN 'edit' WHEN turn % 5 = 4 THEN 'verify' ELSE 'read' END AS op, role AS key, substr(sha256(substr(text, 1, 1)), 1, 8) AS hash FROM conversations)"
Q["st15"] = lambda s, d: I.delta_reads(_log(s, d)).select("session", "ord", "key", "status")
S["st15"] = f"WITH {LOG} SELECT session, ord, key, CASE WHEN lag(hash) OVER (PARTITION BY session, key ORDER BY ord) = hash THEN 'unchanged' ELSE 'new' END AS status FROM log"
Q["st16"] = lambda s, d: I.delta_reads(_log(s, d)).groupBy("status").agg(F.count("*").alias("n"))
S["st16"] = f"SELECT status, count(*) AS n FROM ({S['st15']}) GROUP BY 1"
Q["st17"] = lambda s, d: I.kept_entries(_log(s, d).withColumn("session", F.col("session") % 7).withColumn("key", F.concat("key", F.col("ord").cast("string"))), 5)
S["st17"] = f"WITH {LOG}, l AS (SELECT session % 7 AS session, key || ord AS key, max(ord) AS last FROM log GROUP BY 1, 2) SELECT session, key, last FROM l QUALIFY row_number() OVER (PARTITION BY session ORDER BY last DESC, key) <= 5"
Q["st19"] = lambda s, d: I.recent_ops(_log(s, d), 2).select("session", "ord")
S["st19"] = f"WITH {LOG} SELECT session, ord FROM log QUALIFY row_number() OVER (PARTITION BY session ORDER BY ord DESC) <= 2"
Q["st20"] = lambda s, d: I.edits_since_read(_log(s, d))
S["st20"] = f"WITH {LOG}, r AS (SELECT session, max(ord) AS last_read FROM log WHERE op = 'read' GROUP BY 1) SELECT session, count(*) AS n FROM log LEFT JOIN r USING (session) WHERE op = 'edit' AND (last_read IS NULL OR ord > last_read) GROUP BY 1"
_hashes = lambda s, d: files(s, d).select("path", F.lit(1).alias("mtime_ns"), F.sha2(F.encode("content", "UTF-8"), 256).alias("hash"), "doc_id")
Q["st21"] = lambda s, d: I.stale_assumptions(_hashes(s, d).select(F.col("path").alias("key"), "hash"), _hashes(s, d).select(F.col("path").alias("key"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("hash")).alias("hash")))
S["st21"] = f"WITH {FILES} SELECT path AS key FROM files WHERE doc_id % 4 = 0"
Q["st22"] = lambda s, d: I.external_changes(_hashes(s, d), _hashes(s, d).select("path", (F.col("doc_id") % 2).alias("mtime_ns"), F.when(F.col("doc_id") % 4 == 0, "other").otherwise(F.col("hash")).alias("hash")))
S["st22"] = f"WITH {FILES} SELECT path FROM files WHERE doc_id % 4 = 0"
Q["st23"] = lambda s, d: I.build_state(_log(s, d))
S["st23"] = f"WITH {LOG}, v AS (SELECT session, arg_max(hash, ord) AS status, max(ord) AS verified FROM log WHERE op = 'verify' GROUP BY 1), e AS (SELECT session, max(ord) AS edit FROM log WHERE op = 'edit' GROUP BY 1) SELECT session, status, coalesce(edit > verified, false) AS edited FROM v LEFT JOIN e USING (session)"
Q["st26"] = lambda s, d: I.checkpoint_diff(_hashes(s, d).where("doc_id % 5 <> 0"), _hashes(s, d).where("doc_id % 5 <> 1").withColumn("hash", F.when(F.col("doc_id") % 5 == 2, "x").otherwise(F.col("hash"))))
S["st26"] = f"WITH {FILES} SELECT path, CASE doc_id % 5 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' ELSE 'modified' END AS change FROM files WHERE doc_id % 5 <= 2"
