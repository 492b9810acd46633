"""Scopes, declarations and references of source files, as rows for `operators.binding`.

One extractor for all languages on top of the symbol rules: brackets (or symbol spans, where blocks have none) are scopes,
symbols, parameters, imports and local variables are declarations, all other identifiers are references. Names share one name
space, 'value'. References after a dot or its like are property accesses, which binding leaves open."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codeloom.functions.parsers import BY_END, blanked, symbols
from codeloom.schema import LANGUAGE_OF

_ID = re.compile(r"[A-Za-z_$][\w$]*")
#: Words that are never references.
KEYWORDS = frozenset("if else for while do switch case default break continue return func function def class struct enum interface trait impl fn let const var val local end then elif in is not and or new delete try catch finally throw raise import from export package use using namespace module public private protected static final abstract async await yield match with as pass lambda type typedef void true false null nil None True False self this super int float double char bool string elseif repeat until unless begin rescue ensure extends implements pub mut ref loop where extern unsafe defer chan fallthrough override fun sealed echo".split())
#: Local variables by language: group 1 is a name or several parted by commas.
LOCALS = {
    "go": [r"\b([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s*:=", r"^[ \t]+var\s+([A-Za-z_]\w*)"], "python": [r"^[ \t]*([A-Za-z_]\w*)\s*=(?!=)", r"\bfor\s+([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+in\b"],
    "javascript": [r"\b(?:let|const|var)\s+([A-Za-z_$][\w$]*)"], "typescript": [r"\b(?:let|const|var)\s+([A-Za-z_$][\w$]*)"], "rust": [r"\blet\s+(?:mut\s+)?([A-Za-z_]\w*)"], "kotlin": [r"\b(?:val|var)\s+([A-Za-z_]\w*)"],
    "scala": [r"\b(?:val|var)\s+([A-Za-z_]\w*)"], "swift": [r"\b(?:let|var)\s+([A-Za-z_]\w*)"], "lua": [r"\blocal\s+([A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)(?!\w)(?=\s*(?:=|\n|$))"], "ruby": [r"^[ \t]*([a-z_]\w*)\s*=(?!=)"],
    "php": [r"(\$[A-Za-z_]\w*)\s*=(?!=)"], "zig": [r"\b(?:const|var)\s+([A-Za-z_]\w*)"],
}
_TYPED = [r"(?<![\w.])(?!(?:return|else|new|throw|goto|case|using|import|package|delete)\b)(?:(?:const|final|static|unsigned|struct|auto|var)\s+)*[A-Za-z_][\w:<>,\[\]]*[ \t*&]+([A-Za-z_]\w*)\s*(?==[^=]|;|\[)"]
#: Names that imports bring in: group 1 lists them, the last identifier of each item counts.
IMPORTED = {"javascript": r"^\s*import\s*(?:\w+\s*,\s*)?\{([^}]*)\}", "python": r"^[ \t]*from[ \t]+[\w.]+[ \t]+import[ \t]+([^\n(#]+)"}
IMPORTED["typescript"] = IMPORTED["javascript"]
#: Languages whose parameters are written type first.
TYPE_FIRST = {"c", "cpp", "java", "csharp"}
FUNCTIONS = {"function", "method"}


def _inner(clean: str, start: int, stop: int) -> tuple[int, int] | None:
    """The span inside the first pair of parentheses from start."""
    a = clean.find("(", start, stop)
    if a < 0:
        return None
    depth = 0
    for k in range(a, stop):
        depth += (clean[k] == "(") - (clean[k] == ")")
        if depth == 0:
            return a + 1, k
    return None


def _parameters(clean: str, a: int, b: int, lang: str) -> Iterator[tuple[str, int]]:
    depth, start, parts = 0, a, []
    for k in range(a, b):
        depth += (clean[k] in "([{<") - (clean[k] in ")]}>")
        if clean[k] == "," and depth == 0:
            parts.append((start, k))
            start = k + 1
    for s, e in [*parts, (start, b)]:
        text = re.split(r"=(?!>)|:(?!:)", clean[s:e])[0] if lang not in TYPE_FIRST else clean[s:e].split("=")[0]
        names = [m for m in _ID.finditer(text) if m.group() not in KEYWORDS or m.group() == "self"]
        if names:
            m = names[-1] if lang in TYPE_FIRST | {"php", "swift"} else names[0]
            if not (lang in TYPE_FIRST and len(names) < 2 and not re.search(r"\b(?:int|char|float|double|bool|void|string)\b", text)):
                yield m.group(), s + m.start()


def parse(code: str, lang: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """(scopes, decls, refs) in characters of code: scopes (id, parent, kind, a, b), decls (name, kind, scope, a, b),
    refs (name, scope, a, b, reason, qualifier: the name before the dot of a property access)."""
    clean, syms = blanked(code, lang), symbols(code, lang)
    names = {}
    for s in syms:
        bare = re.split(r"[.:]+", s["name"])[-1]
        at = clean.find(bare, clean.find(s["name"], s["a"]) + len(s["name"]) - len(bare) if s["name"] in clean[s["a"] : s["b"]] else s["a"])
        names[at] = (bare, s)
    spans = []
    if lang == "python" or lang in BY_END:
        spans = [("function" if s["kind"] in FUNCTIONS else "class", at + len(bare), s["b"]) for at, (bare, s) in names.items() if s["kind"] in FUNCTIONS | {"class", "module"}]
    else:
        heads = {clean.find("{", at, s["b"]): ("function" if s["kind"] in FUNCTIONS else "namespace" if s["kind"] == "module" else "class", at + len(bare)) for at, (bare, s) in names.items()}
        stack = []
        for m in re.finditer(r"[{}]", clean):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                a = stack.pop()
                kind, start = heads.get(a, ("block", a))
                spans.append((kind, start, m.end()))
    scopes = [(1, None, "file", 0, len(code))]
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        parent = max((s for s in scopes if s[3] <= a and b <= s[4]), key=lambda s: s[3])[0]
        scopes.append((len(scopes) + 1, parent, kind, a, b))
    inside = lambda pos: max((s for s in scopes if s[3] <= pos < s[4] or s[0] == 1), key=lambda s: (s[3], s[0]))[0]
    decls = {at: (bare, s["kind"], inside(at), at, at + len(bare)) for at, (bare, s) in names.items()}
    for at, (bare, s) in names.items():
        if s["kind"] in FUNCTIONS and (span := _inner(clean, at + len(bare), s["b"])):
            for name, p in _parameters(clean, *span, lang):
                decls.setdefault(p, (name, "parameter", inside(p), p, p + len(name)))
    for pattern in LOCALS.get(lang, _TYPED):
        for m in re.finditer(pattern, clean, re.M):
            for x in _ID.finditer(m.group(1)):
                p = m.start(1) + x.start()
                scope = inside(p)
                same = lang in ("python", "ruby", "php") and any(d[0] == x.group() and d[2] == scope for d in decls.values())
                if x.group() not in KEYWORDS and not same:
                    decls.setdefault(p, (x.group(), "variable", scope, p, p + len(x.group())))
    for m in re.finditer(IMPORTED[lang], clean, re.M) if lang in IMPORTED else ():
        for item in re.finditer(r"[^,]+", m.group(1)):
            if found := list(_ID.finditer(item.group())):
                p = m.start(1) + item.start() + found[-1].start()
                decls.setdefault(p, (found[-1].group(), "import", inside(p), p, p + len(found[-1].group())))
    refs = []
    for m in _ID.finditer(clean):
        if m.start() not in decls and m.group() not in KEYWORDS and not (m.start() and clean[m.start() - 1].isdigit()):
            before = clean[: m.start()].rstrip(" \t")[-2:]
            prop = before.endswith(".") and not before.endswith("..") or before in ("->", "::") or lang == "lua" and before.endswith(":")
            owner = re.search(r"([A-Za-z_$][\w$]*)\s*(?:\.|->|::|:)\s*$", clean[max(0, m.start() - 200) : m.start()]) if prop else None
            refs.append((m.group(), inside(m.start()), m.start(), m.end(), "property_access" if prop else None, owner[1] if owner else None))
    return scopes, [decls[k] for k in sorted(decls)], refs


def scope_rows(files: DataFrame) -> DataFrame:
    """Scopes, decls and refs of files(path, content binary) as rows of one table, for `scope_parts`."""
    return files.select("path", "content").mapInPandas(_rows, "what string, path string, ord int, scope_id int, parent_id int, kind string, name string, start_byte int, end_byte int, reason string, qualifier string, line int")


def parse_scopes(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """scopes, decls and refs of files(path, content binary), in bytes, in the shape that binding takes. Each parses the files when it is read."""
    return scope_parts(scope_rows(files))


def scope_parts(one: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    part = lambda what, *cols: one.where(f"what = '{what}'").select("path", *cols)
    scopes = part("scope", "scope_id", "parent_id", "kind", "start_byte", "end_byte")
    decls = part("decl", "ord", "name", "kind", "scope_id", "start_byte", "end_byte", "line").selectExpr("*", "'value' AS ns", "concat(path, ':', ord) AS decl_id")
    return scopes, decls, part("ref", "ord", "name", "scope_id", "start_byte", "end_byte", "reason", "qualifier", "line").selectExpr("*", "'value' AS ns")


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["what", "path", "ord", "scope_id", "parent_id", "kind", "name", "start_byte", "end_byte", "reason", "qualifier", "line"]
    for b in batches:
        out = []
        for path, data in zip(b.path, b.content, strict=True):
            lang = LANGUAGE_OF.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")
            if not lang:
                continue
            code = bytes(data).decode("utf-8", "replace")
            at = (lambda p: p) if code.isascii() else lambda p, c=code: len(c[:p].encode())
            scopes, decls, refs = parse(code, lang)
            ends = [m.start() for m in re.finditer("\n", code)]
            line = lambda p, ends=ends: bisect_left(ends, p) + 1
            out += [("scope", path, 0, i, p, k, None, at(s), at(e), None, None, line(s)) for i, p, k, s, e in scopes]
            out += [("decl", path, n, sc, None, k, name, at(s), at(e), None, None, line(s)) for n, (name, k, sc, s, e) in enumerate(decls, 1)]
            out += [("ref", path, n, sc, None, None, name, at(s), at(e), why, owner, line(s)) for n, (name, sc, s, e, why, owner) in enumerate(refs, 1)]
        frame = pd.DataFrame(out, columns=columns)
        frame["parent_id"] = frame["parent_id"].astype("Int32")
        yield frame
