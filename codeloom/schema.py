"""Tables of the engine: names and types of columns, languages by extension, kinds of symbols."""

from __future__ import annotations

FILES = "path string, mtime_ns bigint, size bigint, content binary, lang string"
POSTINGS = "tri string, path string"
SYMBOLS = "sym_id string, path string, ord int, name string, kind string, start_line int, end_line int, start_byte int, end_byte int, parent_id string, receiver string, popularity int"
SYM_REFS = "sym_id string, path string, name_lc string"
RAW_IMPORTS = "path string, raw string, alias string"
IMPORT_EDGES = "importer string, imported string"
SCOPES = "path string, scope_id int, parent_id int, kind string, start_byte int, end_byte int"
DECLS = "path string, ord int, decl_id string, name string, ns string, kind string, scope_id int, start_byte int, end_byte int, exported boolean, import_path string, import_name string, supertypes array<string>"
REFS = "path string, ord int, name string, ns string, scope_id int, start_byte int, end_byte int, bind_kind string, decl_id string, candidates array<string>, reason string"
EDITS = "path string, start_byte int, end_byte int, replacement string, expect_hash string"
SESSION_LOG = "session string, ord bigint, op string, key string, hash string"

#: Languages and the extensions of their files.
LANGUAGES = {
    "go": [".go"], "python": [".py", ".pyi"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".tsx"], "java": [".java"], "kotlin": [".kt", ".kts"],
    "scala": [".scala", ".sc"], "rust": [".rs"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"], "csharp": [".cs"], "swift": [".swift"],
    "ruby": [".rb"], "php": [".php"], "lua": [".lua"], "zig": [".zig"],
}
LANGUAGE_OF = {ext: lang for lang, exts in LANGUAGES.items() for ext in exts}
#: Kinds that define a type.
DEFINITIONS = ["struct", "class", "interface", "type", "enum", "impl"]
#: Short names of kinds.
KIND_ALIASES = {"func": "function", "fn": "function", "iface": "interface", "intf": "interface", "var": "variable", "const": "constant"}
