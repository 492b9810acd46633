"""What files bring in from others, as rows: one rule table of import forms for each language, and of class heads.

A binding (raw, name, local, kind) says: the file's name `local` means `name` of the module `raw`. Kind 'symbol' names one declaration, 'module'
a handle before a dot, 'star' all that the module shows, 'export' a name that the file passes on without using it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codeloom.functions.parsers import LEXICAL, blanked, symbols
from codeloom.schema import LANGUAGE_OF

_NAME = r"[A-Za-z_$][\w$]*"
_LIST = re.compile(rf"(?:type\s+)?({_NAME})(?:\s+as\s+({_NAME}))?")


def _listed(items: str) -> Iterator[tuple[str, str]]:
    """(name, local) of `a, b as c`."""
    for part in items.split(","):
        if m := _LIST.match(part.strip()):
            yield m[1], m[2] or m[1]


def _typescript(code: str) -> Iterator[tuple]:
    quoted = r"['\"]([^'\"\n]+)['\"]"
    for m in re.finditer(rf"^[ \t]*import\s+(?:type\s+)?(?:({_NAME})\s*,?\s*)?(?:\{{([^}}]*)\}}|\*\s+as\s+({_NAME}))?\s*from\s*{quoted}", code, re.M):
        if m[1]:
            yield m[4], "default", m[1], "symbol"
        for name, local in _listed(m[2] or ""):
            yield m[4], name, local, "symbol"
        if m[3]:
            yield m[4], "*", m[3], "module"
    for m in re.finditer(rf"^[ \t]*(?:const|let|var)\s+(?:\{{([^}}]*)\}}|({_NAME}))\s*=\s*require\(\s*{quoted}\s*\)", code, re.M):
        for name, local in _listed((m[1] or "").replace(":", " as ")):
            yield m[3], name, local, "symbol"
        if m[2]:
            yield m[3], "*", m[2], "module"
    for m in re.finditer(rf"^[ \t]*export\s*(?:\{{([^}}]*)\}}|\*(?:\s+as\s+({_NAME}))?)\s*from\s*{quoted}", code, re.M):
        for name, local in _listed(m[1] or ""):
            yield m[3], name, local, "export"
        if m[1] is None:
            yield m[3], "*", m[2] or "*", "export"


def _python(code: str) -> Iterator[tuple]:
    for m in re.finditer(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(?:\(([^)]*)\)|([^\n#]+))", code, re.M):
        items = m[2] or m[3]
        if items.strip() == "*":
            yield m[1], "*", "*", "star"
        for name, local in _listed(items):
            yield m[1], name, local, "symbol"
    for m in re.finditer(r"^[ \t]*import[ \t]+([^\n#]+)", code, re.M):
        for part in m[1].split(","):
            if x := re.match(rf"\s*([\w.]+)(?:\s+as\s+({_NAME}))?", part):
                yield x[1], "*", x[2] or x[1], "module"


def _go(code: str) -> Iterator[tuple]:
    for block in re.finditer(r'^import\s+(?:\(([^)]*)\)|((?:[\w.]+\s+)?"[^"\n]+"))', code, re.M):
        for m in re.finditer(r'(?:([\w.]+)[ \t]+)?"([^"\n]+)"', block[1] or block[2]):
            if m[1] == ".":
                yield m[2], "*", "*", "star"
            elif m[1] != "_":
                yield m[2], "*", m[1] or m[2].rsplit("/", 1)[-1], "module"


def _dotted(pattern: str, part: str = ".") -> object:
    """Imports of a qualified name: its last part is the symbol, or a star."""

    def f(code: str) -> Iterator[tuple]:
        for m in re.finditer(pattern, code, re.M):
            head, _, last = m["q"].rpartition(part)
            if last in ("*", "_"):
                yield head, "*", "*", "star"
            else:
                yield m["q"], last, (m.groupdict().get("as") or last), "symbol"

    return f


def _rust(code: str) -> Iterator[tuple]:
    for m in re.finditer(r"^[ \t]*(?:pub\s+)?use\s+((?:crate|self|super)[\w:]*)::(?:\{([^}]*)\}|(\w+|\*)(?:\s+as\s+(\w+))?)\s*;", code, re.M):
        if m[3] == "*":
            yield m[1], "*", "*", "star"
        for name, local in [(m[3], m[4] or m[3])] if m[3] and m[3] != "*" else _listed(m[2] or ""):
            yield m[1], name, local, "symbol"


def _whole(pattern: str, kind: str) -> object:
    """Imports of a whole file or name space; a group `local` is the handle."""

    def f(code: str) -> Iterator[tuple]:
        for m in re.finditer(pattern, code, re.M):
            yield m["q"], "*", m.groupdict().get("local") or "*", kind

    return f


def _csharp(code: str) -> Iterator[tuple]:
    for m in re.finditer(r"^[ \t]*(?:global\s+)?using\s+(?:(\w+)\s*=\s*)?([\w.]+)\s*;", code, re.M):
        if m[1]:
            yield m[2], m[2].rsplit(".", 1)[-1], m[1], "symbol"
        else:
            yield m[2], "*", "*", "star"


#: Import forms by language.
BINDINGS = {
    "typescript": _typescript, "javascript": _typescript, "python": _python, "go": _go, "rust": _rust, "csharp": _csharp,
    "java": _dotted(r"^[ \t]*import\s+(?:static\s+)?(?P<q>[\w.]+(?:\.\*)?)\s*;"), "kotlin": _dotted(rf"^[ \t]*import\s+(?P<q>[\w.]+(?:\.\*)?)(?:\s+as\s+(?P<as>{_NAME}))?"),
    "scala": _dotted(r"^[ \t]*import\s+(?P<q>[\w.]+(?:\._)?)"), "php": _dotted(rf"^[ \t]*use\s+(?P<q>[\w\\]+)(?:\s+as\s+(?P<as>{_NAME}))?\s*;", "\\"),
    "c": _whole(r'^[ \t]*#[ \t]*include[ \t]+"(?P<q>[^"\n]+)"', "star"), "cpp": _whole(r'^[ \t]*#[ \t]*include[ \t]+"(?P<q>[^"\n]+)"', "star"),
    "ruby": _whole(r"""^[ \t]*require(?:_relative)?\s*\(?['"](?P<q>[^'"\n]+)['"]""", "star"), "lua": _whole(rf"""^[ \t]*local\s+(?P<local>{_NAME})\s*=\s*require\s*\(?\s*['"](?P<q>[^'"\n]+)['"]""", "module"),
    "zig": _whole(rf'^[ \t]*(?:pub\s+)?const\s+(?P<local>{_NAME})\s*=\s*@import\(\s*"(?P<q>[^"\n]+)"\s*\)', "module"), "swift": _whole(r"^[ \t]*import[ \t]+(?P<q>[\w.]+)", "star"),
}
#: How a file says what module it is part of.
PACKAGES = {"go": r"^package\s+(\w+)", "java": r"^[ \t]*package\s+([\w.]+)\s*;", "kotlin": r"^[ \t]*package\s+([\w.]+)", "scala": r"^[ \t]*package\s+([\w.]+)", "php": r"^[ \t]*namespace\s+([\w\\]+)\s*;", "csharp": r"^[ \t]*namespace\s+([\w.]+)"}
#: Class heads: name, and supers as one text.
_HEADS = {
    "typescript": rf"\b(?:class|interface)\s+(?P<n>{_NAME})(?:<[^>{{]*>)?(?P<s>[^{{;]*)\{{", "cpp": rf"\b(?:class|struct)\s+(?P<n>{_NAME})(?:\s+final)?\s*(?::(?P<s>[^{{;]*))?\{{",
    "csharp": rf"\b(?:class|interface|struct|record)\s+(?P<n>{_NAME})(?:<[^>{{]*>)?\s*(?::(?P<s>[^{{;]*))?\{{", "php": rf"\b(?:class|interface|trait)\s+(?P<n>{_NAME})(?P<s>[^{{;]*)\{{",
    "python": rf"^[ \t]*class\s+(?P<n>{_NAME})\s*(?:\((?P<s>[^)]*)\))?\s*:", "ruby": r"^[ \t]*(?:class|module)\s+(?P<n>[\w:]+)[ \t]*(?:<[ \t]*(?P<s>[\w:]+))?", "java": rf"\b(?:class|interface|enum|record)\s+(?P<n>{_NAME})(?:<[^>{{]*>)?(?P<s>[^{{;]*)\{{",
    "kotlin": rf"\b(?:class|interface|object)\s+(?P<n>{_NAME})(?:\([^)]*\))?\s*(?::(?P<s>[^{{\n]*))?", "swift": rf"\b(?:class|struct|protocol|extension|enum)\s+(?P<n>{_NAME})\s*(?::(?P<s>[^{{]*))?\{{",
}
_HEADS["javascript"] = _HEADS["typescript"]
_HEADS["scala"] = _HEADS["java"]
_NOISE = frozenset("extends implements public private protected virtual with where class new permits".split())


def bindings(code: str, lang: str) -> list[tuple]:
    """(raw, name, local, kind) in order of the rules; comments are blanked, strings are seen."""
    line, block, _ = LEXICAL.get(lang, ("//", ("/*", "*/"), ""))
    clean = re.sub(rf"^[ \t]*{re.escape(line)}[^\n]*", "", code, flags=re.M) if lang not in ("c", "cpp") or line != "#" else code
    if block and lang != "python":
        clean = re.sub(re.escape(block[0]) + r".*?" + re.escape(block[1]), lambda m: "\n" * m[0].count("\n"), clean, flags=re.S)
    return list(dict.fromkeys(BINDINGS[lang](clean))) if lang in BINDINGS else []


def package(code: str, lang: str) -> str | None:
    m = re.search(PACKAGES[lang], blanked(code, lang), re.M) if lang in PACKAGES else None
    return m[1] if m else None


def hierarchy(code: str, lang: str) -> list[tuple[str, str, int]]:
    """(type, super, line) of class heads, with Ruby's mixins; names without type arguments and qualifiers."""
    if lang not in _HEADS:
        return []
    clean, out = blanked(code, lang), []
    for m in re.finditer(_HEADS[lang], clean, re.M):
        supers = re.sub(r"<[^<>]*>|\([^()]*\)|\[[^\[\]]*\]", "", m["s"] or "")
        line = clean.count("\n", 0, m.start("n")) + 1
        for item in re.split(r"[,\s]+", supers) if lang != "python" else supers.split(","):
            name = re.split(r"[.:\\]+", item.strip())[-1]
            if re.fullmatch(_NAME, name) and name not in _NOISE and "=" not in item:
                out.append((m["n"], name, line))
    if lang == "ruby":
        spans = [(s["name"], s["a"], s["b"]) for s in symbols(code, lang) if s["kind"] in ("class", "module")]
        for m in re.finditer(r"^[ \t]*(?:include|extend|prepend)\s+([\w:]+)", clean, re.M):
            around = [n for n, a, b in spans if a <= m.start() < b]
            if around:
                out.append((around[-1], m[1].split("::")[-1], clean.count("\n", 0, m.start(1)) + 1))
    return out


def _each(files: DataFrame, f, schema: str) -> DataFrame:
    """Rows of f(code, language) for files(path, content binary) of known languages, with the path."""
    names = ["path", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b.path, b.content, strict=True):
                lang = LANGUAGE_OF.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")
                rows += [(path, *r) for r in f(bytes(data).decode("utf-8", "replace"), lang)] if lang else []
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def parse_bindings(files: DataFrame) -> DataFrame:
    """(path, lang, raw, name, local, kind)."""
    return _each(files, lambda code, lang: [(lang, *b) for b in bindings(code, lang)], "lang string, raw string, name string, local string, kind string")


def parse_packages(files: DataFrame) -> DataFrame:
    """(path, lang, package) of all files of known languages; package is null where none is declared."""
    return _each(files, lambda code, lang: [(lang, package(code, lang))], "lang string, package string")


def parse_hierarchy(files: DataFrame) -> DataFrame:
    """(path, type, super, line)."""
    return _each(files, hierarchy, "type string, super string, line int")


def default_exports(code: str, lang: str) -> list[tuple[str, str]]:
    """(form, name): what a module exports by default, in both module systems."""
    clean, out = blanked(code, lang), []
    for m in re.finditer(rf"^[ \t]*export\s+default\s+(?:(?:async\s+)?function\s*\*?\s*|(?:abstract\s+)?class\s+)?({_NAME})", clean, re.M):
        out.append(("default", m[1]))
    for m in re.finditer(rf"^[ \t]*module\.exports\s*=\s*({_NAME})", clean, re.M):
        out.append(("module", m[1]))
    for m in re.finditer(rf"^[ \t]*(?:module\.)?exports\.({_NAME})\s*=", clean, re.M):
        out.append(("member", m[1]))
    return out


def parse_default_exports(files: DataFrame) -> DataFrame:
    """(path, form, name)."""
    return _each(files, lambda code, lang: default_exports(code, lang) if lang in ("typescript", "javascript") else [], "form string, name string")
