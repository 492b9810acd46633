"""Queries of the text index and text predicates."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from codeloom.functions import columns as C
from codeloom.operators import text as T
from codeloom.plans import generated as G
from codeloom.plans import patterns
from codeloom.plans.adapters import FILES, LINES, edges, files, refs, symbols, table
from codeloom.scratch import shared_folder
from codeloom.sources.store import IndexStore

Q: dict = {}
S: dict[str, str] = {}
#: Trigrams in DuckDB: two-digit steps over the hexadecimal text, folded like the index.
TRI = FILES + """, folded AS (SELECT path, hex(encode(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h FROM files),
grams AS (SELECT DISTINCT path, substr(h, 2 * i + 1, 6) AS tri FROM (SELECT path, h, unnest(range(0, length(h) // 2 - 2)) AS i FROM folded))"""


_built: dict[tuple[str, str, bool], IndexStore] = {}


def index(s, d, whole: bool = True) -> IndexStore:
    """The stored index of the files of d, built once a Spark application: of text alone, or with symbols, edges and refs."""
    key = s.sparkContext.applicationId, d, whole
    if key not in _built:
        store = IndexStore(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}")
        more = (symbols(s, d), edges(s, d), refs(s, d)) if whole else ()
        store.build(files(s, d).select("path", "content", F.octet_length("content").cast("long").alias("size")), *more)
        _built[key] = store
    return _built[key]


def stored(s, d):
    return index(s, d, False).table("postings")


def _list(xs: list[str]) -> str:
    return ", ".join(f"'{x}'" for x in xs)


Q["tx1"] = lambda s, d: T.postings(files(s, d))
S["tx1"] = f"WITH {TRI} SELECT path, tri FROM grams"
_WORD = "regexp_extract(coalesce(text, ''), '[A-Za-z0-9_]{2,}')"
Q["tx2"] = lambda s, d: table(s, d, "documents").select("doc_id", F.explode(C.trigrams(F.concat(F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z0-9_]{2,}", 0), F.lit(" Ét")))).alias("tri"))
S["tx2"] = f"SELECT DISTINCT doc_id, substr(h, 2 * i + 1, 6) AS tri FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 2)) AS i FROM (SELECT doc_id, hex(encode(translate({_WORD}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || ' Ét')) AS h FROM documents))"
Q["tx3"] = lambda s, d: T.posting_sizes(T.postings(files(s, d)))
S["tx3"] = f"WITH {TRI} SELECT tri, count(*) AS n_files, min(path) AS first_path, max(path) AS last_path FROM grams GROUP BY tri"
_WANT = patterns.folded_trigrams("tionhein")
Q["tx5"] = lambda s, d: T.candidates(stored(s, d), "tionhein")
S["tx5"] = f"WITH {TRI} SELECT path FROM grams WHERE tri IN ({_list(_WANT)}) GROUP BY path HAVING count(*) = {len(_WANT)}"


def _rare(s, d):
    p = stored(s, d)
    return files(s, d).join(T.rare_candidates(p, T.posting_sizes(p), "tionhein"), "path", "left_semi").where(C.smart_contains("content", "tionhein")).select("path")


Q["tx6"] = _rare
S["tx6"] = f"WITH {FILES} SELECT path FROM files WHERE contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'tionhein')"


def _both(s, d):
    p = stored(s, d)
    return T.candidates(p, "tion").intersect(T.candidates(p, "eux"))


Q["tx7"] = _both
_of = lambda x: f"SELECT path FROM grams WHERE tri IN ({_list(patterns.folded_trigrams(x))}) GROUP BY path HAVING count(*) = {len(patterns.folded_trigrams(x))}"
S["tx7"] = f"WITH {TRI} ({_of('tion')}) INTERSECT ({_of('eux')})"
Q["tx8"] = lambda s, d: stored(s, d).where(F.col("tri") == "746865")
S["tx8"] = f"WITH {TRI} SELECT path, tri FROM grams WHERE tri = '746865'"
Q["tx9"] = lambda s, d: T.candidates(stored(s, d), "tionhein").join(files(s, d), "path").select("path", F.octet_length("content").cast("long").alias("size"))
S["tx9"] = f"WITH {TRI}, c AS ({_of('tionhein')}) SELECT path, strlen(content)::BIGINT AS size FROM c JOIN files USING (path)"
Q["tx10"] = lambda s, d: T.find_files(files(s, d), "tionhein", postings_=stored(s, d))
S["tx10"] = S["tx6"]
Q["tx10_regex"] = lambda s, d: T.find_files(files(s, d), "thnt(on|ing)|schtz[a-z]+", regex=True, glob="src1*/**", postings_=stored(s, d))
S["tx10_regex"] = f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(content, '(?i)thnt(on|ing)|schtz[a-z]+') AND regexp_matches(path, '^src1[^/]*/')"
Q["tx10_alternation"] = lambda s, d: T.find_files(files(s, d), r"tionhein\|Zz9q")
S["tx10_alternation"] = f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(content, 'tionhein|Zz9q')"
Q["tx11"] = lambda s, d: files(s, d).select("path", C.smart_contains("content", "the").alias("folded"), C.smart_contains("content", "The").alias("exact"), C.smart_contains("content", "ñ").alias("short"))
S["tx11"] = f"WITH {FILES} SELECT path, contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') AS folded, contains(content, 'The') AS exact, contains(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'ñ') AS short FROM files"


#: Patterns with what is known of them: required literals, alternation, meta characters, basic syntax. WORD stands for a word of a document.
_PATTERNS = [
    ("WORD", "WORD", False, False, False), ("WORD|de", "-", True, True, False), ("ab(cdef)+x", "cdef", False, True, False), ("ab.*WORDbarbaz", "WORDbarbaz", False, True, False), ("a\\|WORDx", "a|WORDx", False, True, True), ("(?i)WORD", "-", False, True, False),
    ("x?yzzy{2}", "yzz", False, True, False), ("[ab]cdef|WORDghi", "cdef|WORDghi", True, True, False), ("(ab", "-", False, True, False),
]


def _planned(s, d):
    """Each pattern with a word of each document in it, analysed by the library's own functions in batches."""
    words = table(s, d, "documents").select("doc_id", F.concat(F.lit("zzq"), F.regexp_extract(F.coalesce("text", F.lit("")), "[a-z]+", 0)).alias("word"))

    def run(batches):
        for b in batches:
            rows = []
            for i, w in zip(b.doc_id, b.word, strict=True):
                for k, (p, *_) in enumerate(_PATTERNS):
                    p = p.replace("WORD", w)
                    rows.append((i, k, "|".join(patterns.required_literals(p) or ["-"]), patterns.has_alternation(p), patterns.has_meta(p), patterns.basic_syntax_hint(p) != ""))
            yield pd.DataFrame(rows, columns=["doc_id", "k", "literals", "alternation", "meta", "basic"])

    return words.mapInPandas(run, "doc_id long, k int, literals string, alternation boolean, meta boolean, basic boolean")


Q["tx12"] = _planned
S["tx12"] = "WITH w AS (SELECT doc_id, 'zzq' || regexp_extract(coalesce(text, ''), '[a-z]+') AS word FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, replace('{literals}', 'WORD', word) AS literals, {str(alt).lower()} AS alternation, {str(meta).lower()} AS meta, {str(basic).lower()} AS basic FROM w" for k, (_, literals, alt, meta, basic) in enumerate(_PATTERNS))
for _name, _column in (("tx14", "alternation"), ("tx22", "basic"), ("tx24", "meta")):
    Q[_name] = lambda s, d, c=_column: _planned(s, d).select("doc_id", "k", c)
    S[_name] = f"SELECT doc_id, k, {_column} FROM ({S['tx12']})"
Q["tx13"] = lambda s, d: _planned(s, d).select("doc_id", "k", F.reduce(F.split("literals", r"\|"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)).alias("longest"))
S["tx13"] = f"SELECT doc_id, k, list_reduce(list_prepend('', string_split(literals, '|')), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) AS longest FROM ({S['tx12']})"
Q["tx16"] = lambda s, d: T.search_lines(files(s, d), "tionhein", context=1, limit=50)
S["tx16"] = f"""WITH {LINES}, hit AS (SELECT path, line, trim(text) AS text FROM lines WHERE contains(text, 'tionhein'))
SELECT h.path, h.line::INTEGER AS line, h.text, string_agg(CAST(l.line AS VARCHAR) || ': ' || l.text, chr(10) ORDER BY l.line) AS snippet FROM hit h JOIN lines l ON l.path = h.path AND l.line BETWEEN h.line - 1 AND h.line + 1
GROUP BY h.path, h.line, h.text ORDER BY h.path, h.line LIMIT 50"""
Q["tx17"] = lambda s, d: T.search_between(T.lines(files(s, d)), files(s, d).select("path", F.lit(2).alias("start_line"), F.lit(4).alias("end_line")), "the")
S["tx17"] = f"WITH {LINES} SELECT DISTINCT path, line::INTEGER AS line, text FROM lines WHERE contains(text, 'the') AND line BETWEEN 2 AND 4"
Q["tx19"] = lambda s, d: T.match_glob(files(s, d), "src1?/*/[1-5]*.txt").select("path")
S["tx19"] = f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1[^/]/[^/]*/[1-5][^/]*[.]txt$')"
Q["tx20"] = lambda s, d: T.match_glob(files(s, d), "src1/**/*3.txt").select("path")
S["tx20"] = f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(path, '^src1/(.*/)?[^/]*3[.]txt$')"
Q["tx21"] = lambda s, d: T.lines(files(s, d)).where(T.name_matches(F.regexp_extract("text", "[A-Za-z0-9_]{2,}", 0), "^th|on$")).select("path", "line")
S["tx21"] = f"WITH {LINES} SELECT path, line::INTEGER AS line FROM lines WHERE regexp_matches(regexp_extract(text, '[A-Za-z0-9_]{{2,}}'), '(?i)(?:^th|on$)')"
Q["tx23"] = lambda s, d: table(s, d, "pages").select("url", T.in_language(F.col("url"), "python").alias("python"), T.in_language(F.col("url"), "html").alias("html"))
S["tx23"] = r"SELECT url, coalesce(regexp_extract(lower(regexp_extract(url, '[^/]*$')), '(\.[^.]+)$', 1) IN ('.py', '.pyi'), false) AS python, coalesce(regexp_extract(lower(regexp_extract(url, '[^/]*$')), '(\.[^.]+)$', 1) = '.html', false) AS html FROM pages"
Q["tx25"] = lambda s, d: T.word_spans(files(s, d), "thing")
S["tx25"] = f"""WITH {FILES}, p AS (SELECT path, string_split_regex(content, '\\bthing\\b') AS parts FROM files), k AS (SELECT path, parts, unnest(range(1, len(parts))) AS k FROM p),
b AS (SELECT path, k, array_to_string(parts[1:k], '') AS b FROM k)
SELECT path, strlen(b)::BIGINT + (k - 1) * 5 AS start, strlen(b)::BIGINT + (k - 1) * 5 + 5 AS "end", (length(b) - length(replace(b, chr(10), '')) + 1)::BIGINT AS line FROM b"""
Q["tx26"] = lambda s, d: T.word_spans(files(s, d).join(T.candidates(stored(s, d), "thing"), "path", "left_semi"), "thing").groupBy("path").agg(F.count("*").alias("n"))
S["tx26"] = f"WITH {FILES} SELECT path, (len(string_split_regex(content, '\\bthing\\b')) - 1)::BIGINT AS n FROM files WHERE regexp_matches(content, '\\bthing\\b')"
Q["tx27"] = lambda s, d: files(s, d).select("path", F.explode(T.identifiers(F.col("content"))).alias("token"))
S["tx27"] = f"WITH {FILES} SELECT DISTINCT path, unnest(regexp_extract_all(content, '[A-Za-z0-9_]{{2,}}')) AS token FROM files"
Q["tx28"] = lambda s, d: files(s, d).select("path", F.explode(T.unicode_identifiers(F.col("content"))).alias("token"))
S["tx28"] = f"WITH {FILES}, t AS (SELECT DISTINCT path, unnest(regexp_extract_all(content, '[\\p{{L}}_][\\p{{L}}\\p{{Nd}}_]*')) AS token FROM files) SELECT * FROM t WHERE strlen(token) > 1"
_CODE = "a = 1 // thing here\nthing(b) /* see\n thing */ thing\n// a thing, another thing\n"
_one = lambda s, d: G.sources(s, d, [("p/f.c", _CODE)], ["p", "a", "b"], moved=False).select("path", F.decode("content", "UTF-8").alias("content"))
#: Where the word stands: byte offset without tags, tags before it, whether in a comment.
_MENTIONS = [(9, 1, True), (20, 1, False), (37, 2, True), (46, 2, False), (57, 3, True), (72, 3, True)]
_MENTION_SQL = f"SELECT dir || 'p' || tag || '/f.c' AS path, (p0 + n * strlen(tag))::BIGINT AS start FROM docs, (SELECT * FROM (VALUES {', '.join(f'({a}, {n}, {str(c).lower()})' for a, n, c in _MENTIONS)}) t(p0, n, c))"
Q["tx29"] = lambda s, d: T.word_spans(_one(s, d), "thing").select("path", "start")
S["tx29"] = f"WITH {G.DOCS} {_MENTION_SQL}"
Q["tx30"] = lambda s, d: T.spans_in_comments(_one(s, d), "thing", "c").where("in_comment").select("path", "start")
S["tx30"] = f"WITH {G.DOCS} {_MENTION_SQL} WHERE c"
Q["tx31"] = lambda s, d: T.spans_in_comments(_one(s, d), "thing", "c").where("NOT in_comment").select("path", "start")
S["tx31"] = f"WITH {G.DOCS} {_MENTION_SQL} WHERE NOT c"
Q["tx32"] = lambda s, d: T.spans_in_comments(_one(s, d), "thing", "c").select("path", "start", "in_comment")
S["tx32"] = f"WITH {G.DOCS} {_MENTION_SQL.replace(' AS start', ' AS start, c AS in_comment')}"
Q["tx33"] = lambda s, d: T.companion_mentions(files(s, d), "thing", [".txt"], files(s, d).where("doc_id % 3 = 0"))
S["tx33"] = S["tx26"] + " AND doc_id % 3 <> 0"
