"""Symbols and imports of source files, by a table of rules for each language.

Comments and strings are blanked first, keeping every offset, so that rules and bracket counts see code only. A rule gives
a kind and a pattern with the name; a symbol ends with its bracket, its indentation or its `end`. Broken code gives what
rules still see. Functions that stand in a type become its methods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from codeloom.schema import LANGUAGE_OF

_ID = r"[A-Za-z_$][\w$]*"
_C_LIKE = ("//", ("/*", "*/"), "\"'")
#: Line comment, block comment and quotes of each language.
LEXICAL = {
    "go": ("//", ("/*", "*/"), "\"'`"), "python": ("#", ('"""', '"""'), "\"'"), "javascript": ("//", ("/*", "*/"), "\"'`"), "typescript": ("//", ("/*", "*/"), "\"'`"), "ruby": ("#", None, "\"'"),
    "lua": ("--", ("--[[", "]]"), "\"'"), "php": ("//", ("/*", "*/"), "\"'"), "zig": ("//", None, '"'), "rust": ("//", ("/*", "*/"), '"'),
}
_MOD = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|open|async|virtual|data|inline|export|default|pub(?:\([a-z]+\))?|unsafe|const|extern|partial|readonly|suspend|lazy|implicit|case|fileprivate|mutating|inout|declare|synchronized|native)\s+)*"
#: (kind, pattern): the name is group 1; a second group is a receiver.
RULES = {
    "go": [("function", rf"^func\s+({_ID})"), ("method", rf"^func\s+\(\s*(?:\w+\s+)?\*?(?P<recv>\w+)[^)]*\)\s*({_ID})"), ("struct", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+struct\b"), ("interface", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+interface\b"), ("type", rf"^type\s+({_ID})(?:\[[^\]]*\])?\s+(?!struct\b|interface\b)\S"), ("constant", rf"^const\s+({_ID})"), ("variable", rf"^var\s+({_ID})")],
    "python": [("class", rf"^[ \t]*class\s+({_ID})"), ("function", rf"^[ \t]*(?:async\s+)?def\s+({_ID})")],
    "javascript": [("function", rf"^[ \t]*{_MOD}function\s*\*?\s*({_ID})"), ("class", rf"^[ \t]*{_MOD}class\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}interface\s+({_ID})"), ("enum", rf"^[ \t]*{_MOD}enum\s+({_ID})"), ("type", rf"^[ \t]*{_MOD}type\s+({_ID})[^=\n]*="), ("variable", rf"^(?:export\s+)?(?:const|let|var)\s+({_ID})"), ("method", rf"^[ \t]+{_MOD}(?!(?:if|for|while|switch|catch|return|function)\b)({_ID})\s*\([^()\n]*\)\s*(?::[^{{\n]+)?\{{")],
    "java": [("class", rf"^[ \t]*{_MOD}(?:class|record)\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}@?interface\s+({_ID})"), ("enum", rf"^[ \t]*{_MOD}enum\s+({_ID})"), ("method", rf"^[ \t]+{_MOD}(?!(?:return|new|throw|else)\b)(?:<[^>\n]+>\s*)?[\w.<>\[\], ?]+\s+({_ID})\s*\([^;{{}}()]*\)[^;{{}}]*\{{")],
    "kotlin": [("class", rf"^[ \t]*{_MOD}(?:class|object)\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}interface\s+({_ID})"), ("function", rf"^[ \t]*{_MOD}fun\s+(?:<[^>]+>\s*)?(?:\w+\.)?({_ID})"), ("type", rf"^[ \t]*{_MOD}typealias\s+({_ID})")],
    "scala": [("class", rf"^[ \t]*{_MOD}(?:class|object)\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}trait\s+({_ID})"), ("function", rf"^[ \t]*{_MOD}def\s+({_ID})"), ("type", rf"^[ \t]*{_MOD}type\s+({_ID})")],
    "rust": [("function", rf"^[ \t]*{_MOD}fn\s+({_ID})"), ("struct", rf"^[ \t]*{_MOD}struct\s+({_ID})"), ("enum", rf"^[ \t]*{_MOD}enum\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}trait\s+({_ID})"), ("impl", rf"^[ \t]*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_ID})"), ("module", rf"^[ \t]*{_MOD}mod\s+({_ID})"), ("type", rf"^[ \t]*{_MOD}type\s+({_ID})"), ("constant", rf"^[ \t]*(?:pub\s+)?(?:const|static)\s+(?:mut\s+)?({_ID})\s*:"), ("macro", rf"^[ \t]*macro_rules!\s*({_ID})")],
    "c": [("struct", rf"^[ \t]*(?:typedef\s+)?struct\s+({_ID})\s*\{{"), ("enum", rf"^[ \t]*(?:typedef\s+)?enum\s+({_ID})\s*\{{"), ("function", rf"^(?!(?:return|else|if|for|while|switch|typedef)\b)[A-Za-z_][\w \t*]*?[ \t*]({_ID})\s*\([^;{{}}]*\)\s*\{{"), ("macro", rf"^[ \t]*#\s*define\s+({_ID})")],
    "cpp": [("module", rf"^[ \t]*namespace\s+({_ID})"), ("class", rf"^[ \t]*(?:template\s*<[^>]*>\s*)?class\s+({_ID})[^;]*\{{"), ("struct", rf"^[ \t]*struct\s+({_ID})[^;]*\{{"), ("enum", rf"^[ \t]*enum\s+(?:class\s+)?({_ID})"), ("method", rf"^(?!return\b)[\w:<>*& \t]*?(?P<recv>{_ID})::(~?{_ID})\s*\([^;{{}}]*\)[^;{{}}]*\{{"), ("function", rf"^[ \t]*(?!(?:return|else|if|for|while|switch|namespace|class)\b)[\w:<>*& \t]+?[ \t*&]({_ID})\s*\([^;{{}}]*\)[^;{{}}]*\{{")],
    "csharp": [("class", rf"^[ \t]*{_MOD}(?:class|record)\s+({_ID})"), ("struct", rf"^[ \t]*{_MOD}struct\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}interface\s+({_ID})"), ("enum", rf"^[ \t]*{_MOD}enum\s+({_ID})"), ("module", r"^[ \t]*namespace\s+([\w.]+)"), ("method", rf"^[ \t]+{_MOD}(?!(?:return|new|throw|else|namespace|class)\b)[\w.<>\[\], ?]+\s+({_ID})\s*(?:<[^>]*>)?\s*\([^;{{}}()]*\)\s*(?:\{{|=>)"), ("property", rf"^[ \t]+{_MOD}[\w.<>\[\]?]+\s+({_ID})\s*\{{\s*(?:get|set)")],
    "swift": [("class", rf"^[ \t]*{_MOD}(?:class|actor)\s+({_ID})"), ("struct", rf"^[ \t]*{_MOD}struct\s+({_ID})"), ("enum", rf"^[ \t]*{_MOD}enum\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}protocol\s+({_ID})"), ("impl", rf"^[ \t]*{_MOD}extension\s+({_ID})"), ("function", rf"^[ \t]*{_MOD}func\s+({_ID})"), ("function", rf"^[ \t]*{_MOD}(init)\s*[(<?]")],
    "ruby": [("module", r"^[ \t]*module\s+([\w:]+)"), ("class", r"^[ \t]*class\s+([\w:]+)"), ("function", r"^[ \t]*def\s+(?:self\.)?([\w]+[?!=]?)")],
    "php": [("class", rf"^[ \t]*{_MOD}class\s+({_ID})"), ("interface", rf"^[ \t]*{_MOD}(?:interface|trait)\s+({_ID})"), ("enum", rf"^[ \t]*{_MOD}enum\s+({_ID})"), ("function", rf"^[ \t]*{_MOD}function\s+&?({_ID})")],
    "lua": [("function", r"^[ \t]*(?:local\s+)?function\s+([\w.:]+)"), ("function", r"^[ \t]*(?:local\s+)?([\w.]+)\s*=\s*function\b")],
    "zig": [("function", rf"^[ \t]*{_MOD}fn\s+({_ID})"), ("struct", rf"^[ \t]*(?:pub\s+)?const\s+({_ID})\s*=\s*(?:packed\s+|extern\s+)?(?:struct|union|enum)\b"), ("constant", rf"^(?:pub\s+)?const\s+({_ID})\s*(?::[^=]+)?=\s*(?!struct|union|enum|packed|extern)")],
}
RULES["typescript"] = RULES["javascript"]
#: Patterns whose group 1 is what a file imports; they see the text with its strings.
IMPORTS = {
    "go": [r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$'], "python": [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"], "javascript": [r"""^\s*(?:import|export)\b[^'"\n]*['"]([^'"\n]+)['"]""", r"""require\(\s*['"]([^'"\n]+)['"]\s*\)"""],
    "java": [r"^\s*import\s+(?:static\s+)?([\w.]+)"], "kotlin": [r"^\s*import\s+([\w.]+)"], "scala": [r"^\s*import\s+([\w.]+)"], "rust": [r"^\s*(?:pub\s+)?use\s+([\w:]+)"], "c": [r'^\s*#\s*include\s+["<]([^">\n]+)[">]'],
    "csharp": [r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"], "swift": [r"^[ \t]*import[ \t]+(?:(?:class|struct|enum|protocol|func|var|let|typealias)[ \t]+)?([\w.]+)"], "ruby": [r"""^\s*require(?:_relative)?\s*\(?['"]([^'"\n]+)['"]"""], "php": [r"^\s*use\s+([\w\\]+)", r"""(?:require|include)(?:_once)?\s*\(?['"]([^'"\n]+)['"]"""],
    "lua": [r"""require\s*\(?\s*['"]([^'"\n]+)['"]"""], "zig": [r'@import\(\s*"([^"\n]+)"\s*\)'],
}
IMPORTS["typescript"], IMPORTS["cpp"] = IMPORTS["javascript"], IMPORTS["c"]
BY_END, TYPES = {"ruby", "lua"}, {"class", "struct", "interface", "enum", "impl", "type", "module"}
_COMPILED = {lang: [(k, re.compile(p, re.M)) for k, p in rules] for lang, rules in RULES.items()}
_IMPORTS = {lang: [re.compile(p, re.M) for p in ps] for lang, ps in IMPORTS.items()}
_OPENS = re.compile(r"\b(?:def|class|module|do|function|then|case|begin|repeat)\b|^[ \t]*(?:if|unless|while|until|for)\b", re.M)
_CLOSES = re.compile(r"\b(?:end|until)\b")


def blanked(code: str, lang: str) -> str:
    """code with comments and the inside of strings as spaces; newlines stay."""
    line, block, quotes = LEXICAL.get(lang, _C_LIKE)
    out, i, n = list(code), 0, len(code)

    def wipe(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        if block and code.startswith(block[0], i):
            j = code.find(block[1], i + len(block[0]))
            j = n if j < 0 else j + len(block[1])
            wipe(i, j)
        elif code.startswith(line, i) or lang == "php" and code[i] == "#":
            j = code.find("\n", i)
            j = n if j < 0 else j
            wipe(i, j)
        elif code[i] in quotes and not (lang == "rust" and code[i] == "'"):
            q, j = code[i], i + 1
            while j < n and code[j] != q and (q == "`" or code[j] != "\n"):
                j += 1 + (code[j] == "\\" and q != "`")
            wipe(i + 1, j)
            j += 1
        else:
            j = i + 1
        i = j
    return "".join(out)


def _end(clean: str, start: int, head_end: int, lang: str) -> int:
    """Where a symbol that starts at `start` ends."""
    if lang == "python":
        indent = len(re.match(r"[ \t]*", clean[start:]).group())
        m = re.compile(rf"^(?![ \t]*(?:\n|$))[ \t]{{0,{indent}}}(?=[^\s])", re.M).search(clean, clean.find("\n", head_end) + 1 or len(clean))
        stop = m.start() if m else len(clean)
        return len(clean[:stop].rstrip())
    if lang in BY_END:
        depth, at = 0, start
        for line in clean[start:].split("\n"):
            depth += len([m for m in _OPENS.finditer(line) if not (lang == "lua" and m.group().strip() in ("do", "then", "if", "while", "for") and m.group().strip() in ("while", "for", "if"))]) if lang == "lua" else len(re.findall(r"^[ \t]*(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo\b", line))
            depth -= len(_CLOSES.findall(line)) if lang == "lua" else len(re.findall(r"^[ \t]*end\b", line))
            at += len(line) + 1
            if depth <= 0:
                break
        return min(at - 1, len(clean))
    stop = clean.find("\n", head_end)
    stop = len(clean) if stop < 0 else stop
    brace = clean.find("{", max(start, head_end - 1))
    semi = clean.find(";", head_end)
    if brace < 0 or 0 <= semi < brace or (brace > stop and clean[head_end:brace].count("\n") > 3):
        return stop
    depth = 0
    for m in re.compile(r"[{}]").finditer(clean, brace):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(clean)


def symbols(code: str, lang: str) -> list[dict]:
    """Symbols in order of place: name, kind, lines (from 1), byte span, number of the enclosing symbol, receiver."""
    clean = blanked(code, lang)
    found: dict[int, dict] = {}
    for kind, pattern in _COMPILED.get(lang, ()):
        for m in pattern.finditer(clean):
            group = m.lastindex
            at = m.start(group)
            if at not in found:
                recv = m.groupdict().get("recv") if "recv" in pattern.groupindex else None
                start = m.start() + len(m.group()) - len(m.group().lstrip())
                line_start = code.rfind("\n", 0, start) + 1
                found[at] = {"name": m.group(group), "kind": kind, "a": start, "b": _end(clean, line_start if lang == "python" or lang in BY_END else start, m.end(), lang), "receiver": recv}
    rows, stack = [], []
    for s in sorted(found.values(), key=lambda s: (s["a"], -s["b"])):
        while stack and rows[stack[-1]]["b"] <= s["a"]:
            stack.pop()
        parent = stack[-1] if stack else None
        if parent is not None and rows[parent]["kind"] in TYPES:
            s["receiver"] = s["receiver"] or rows[parent]["name"]
            s["kind"] = "method" if s["kind"] == "function" else s["kind"]
        s["parent"] = parent
        stack.append(len(rows))
        rows.append(s)
    ascii_only = code.isascii()
    for s in rows:
        s["start_line"], s["end_line"] = code.count("\n", 0, s["a"]) + 1, code.count("\n", 0, max(s["a"], s["b"] - 1)) + 1
        s["start_byte"], s["end_byte"] = (s["a"], s["b"]) if ascii_only else (len(code[: s["a"]].encode()), len(code[: s["b"]].encode()))
    return rows


def imports(code: str, lang: str, first_lines: int = 200) -> list[str]:
    """What the first lines of a file import, once each."""
    head = "\n".join(code.split("\n", first_lines)[:first_lines])
    return list(dict.fromkeys(m.group(1) for p in _IMPORTS.get(lang, ()) for m in p.finditer(head)))


def parse_symbols(files: DataFrame) -> DataFrame:
    """symbols of files(path, content binary): Arrow batches through one table of rules."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b.path, b.content, strict=True):
                lang = LANGUAGE_OF.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")
                if lang:
                    code = bytes(data).decode("utf-8", "replace")
                    for k, s in enumerate(symbols(code, lang)):
                        parent = None if s["parent"] is None else f"{path}#{s['parent']}"
                        rows.append((f"{path}#{k}", path, k, s["name"], s["kind"], s["start_line"], s["end_line"], s["start_byte"], s["end_byte"], parent, s["receiver"], code[s["a"] : s["b"]]))
            yield pd.DataFrame(rows, columns=["sym_id", "path", "ord", "name", "kind", "start_line", "end_line", "start_byte", "end_byte", "parent_id", "receiver", "body"])

    return files.select("path", "content").mapInPandas(run, "sym_id string, path string, ord int, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, parent_id string, receiver string, body string")


def parse_imports(files: DataFrame) -> DataFrame:
    """(path, raw) of files(path, content binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b.path, b.content, strict=True):
                lang = LANGUAGE_OF.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")
                rows += [(path, x) for x in imports(bytes(data).decode("utf-8", "replace"), lang)] if lang else []
            yield pd.DataFrame(rows, columns=["path", "raw"])

    return files.select("path", "content").mapInPandas(run, "path string, raw string")
