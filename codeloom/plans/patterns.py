"""What is decided about a pattern before a plan is made: literals that its matches must hold, globs as regular expressions."""

from __future__ import annotations

import re
from re import _parser as parser

#: Literals shorter than a trigram cannot be looked up.
LEAST = 3


def has_meta(pattern: str) -> bool:
    """Whether a pattern is more than a literal."""
    return any(c in r".*+?()[]{}|^$\\" for c in pattern)


def has_alternation(pattern: str) -> bool:
    """Whether a bar stands in the pattern without a backslash before it."""
    escaped = False
    for c in pattern:
        if c == "|" and not escaped:
            return True
        escaped = c == "\\" and not escaped
    return False


def basic_syntax_hint(pattern: str) -> str:
    """What to write instead of escapes of the older regular expression syntax; empty if there are none."""
    found = [e for e in (r"\|", r"\(", r"\)", r"\+", r"\?", r"\{", r"\}") if e in pattern]
    return f"pattern has {', '.join(found)}; write {', '.join(e[1] for e in found)}" if found else ""


def from_basic(pattern: str) -> str:
    r"""`\|` as the bar of alternation."""
    return pattern.replace(r"\|", "|")


def longest_literal(tree) -> str:
    """The longest stretch of characters that every match of a parsed pattern holds."""
    best = run = ""
    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        best, run = max(best, run, key=len), ""
        if name == "SUBPATTERN" and not value[1] & re.IGNORECASE:
            best = max(best, longest_literal(value[3]), key=len)
        elif name == "MAX_REPEAT" and value[0] >= 1:
            best = max(best, longest_literal(value[2]), key=len)
    return max(best, run, key=len)


def required_literals(pattern: str) -> list[str] | None:
    """One literal for each alternative, so that each match holds one of them; None if some alternative has none of LEAST
    characters or the pattern can't be parsed."""
    try:
        tree = parser.parse(pattern)
    except re.error:
        return None
    if tree.state.flags & re.IGNORECASE:
        return None
    parts = list(tree)
    ways = [list(x) for x in parts[0][1][1]] if len(parts) == 1 and str(parts[0][0]) == "BRANCH" else [parts]
    found = [longest_literal(w) for w in ways]
    return found if all(len(x.encode()) >= LEAST for x in found) else None


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression for a whole path: `**` crosses directories, `*` and `?` do not; a glob without a
    slash is for the last segment."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            out, i = out + "[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", c), i + 1
    return f"^{out}$" if "/" in pattern or "**" in pattern else f"^(?:.*/)?{out}$"


def folded_trigrams(literal: str) -> list[str]:
    """Distinct trigrams of a literal as the index has them."""
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in literal).encode()
    return list(dict.fromkeys(data[i : i + 3].hex().upper() for i in range(len(data) - 2)))
