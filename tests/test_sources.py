import subprocess

import pytest

from codeloom.functions import parsers
from codeloom.sources import repo

SOURCES = {
    "go": ('package main\nimport (\n  "fmt"\n)\n// func no() {}\ntype Box struct { n int }\nfunc (b *Box) Get() int {\n  s := "func x() {"\n  return len(s)\n}\nfunc main() { fmt.Println() }\n', [("struct", "Box", 6, 6), ("method", "Get", 7, 10), ("function", "main", 11, 11)], ["fmt"]),
    "python": ('import os\nfrom a.b import c\nclass A:\n    def f(self):\n        return "def x():"\n\n    def g(self): pass\n\ndef top():\n    def inner(): pass\n    return 1\n', [("class", "A", 3, 7), ("method", "f", 4, 5), ("method", "g", 7, 7), ("function", "top", 9, 11), ("function", "inner", 10, 10)], ["os", "a.b"]),
    "typescript": ("import { x } from './lib';\nexport interface P { a: number }\nexport class C {\n  run(a: number): void {\n    return;\n  }\n}\nexport function go() {}\nconst v = 1;\n", [("interface", "P", 2, 2), ("class", "C", 3, 7), ("method", "run", 4, 6), ("function", "go", 8, 8), ("variable", "v", 9, 9)], ["./lib"]),
    "java": ("import a.b.C;\npublic class Main {\n  private int f(int x) {\n    return x;\n  }\n}\ninterface I { }\n", [("class", "Main", 2, 6), ("method", "f", 3, 5), ("interface", "I", 7, 7)], ["a.b.C"]),
    "kotlin": ("import a.b\nclass K {\n  fun f(): Int { return 1 }\n}\nobject O\n", [("class", "K", 2, 4), ("method", "f", 3, 3), ("class", "O", 5, 5)], ["a.b"]),
    "scala": ("import x.y\ntrait T {\n  def f = 1\n}\n", [("interface", "T", 2, 4), ("method", "f", 3, 3)], ["x.y"]),
    "rust": ("use std::io;\npub struct S { a: u8 }\nimpl S {\n    pub fn get(&self) -> u8 { self.a }\n}\nfn main() {}\n", [("struct", "S", 2, 2), ("impl", "S", 3, 5), ("method", "get", 4, 4), ("function", "main", 6, 6)], ["std::io"]),
    "c": ('#include "x.h"\nstruct P { int a; };\nstatic int add(int a, int b) {\n  return a + b; /* int no() { */\n}\n', [("struct", "P", 2, 2), ("function", "add", 3, 5)], ["x.h"]),
    "cpp": ("namespace n {\nclass G {\n};\n}\nint G::size() const {\n  return 1;\n}\n", [("module", "n", 1, 4), ("class", "G", 2, 3), ("method", "size", 5, 7)], []),
    "csharp": ("using A.B;\nnamespace N {\n  public class C {\n    public int F(int x) {\n      return x;\n    }\n  }\n}\n", [("module", "N", 2, 8), ("class", "C", 3, 7), ("method", "F", 4, 6)], ["A.B"]),
    "swift": ("import Foundation\nstruct S {\n  func f() -> Int { 1 }\n}\nextension S { }\n", [("struct", "S", 2, 4), ("method", "f", 3, 3), ("impl", "S", 5, 5)], ["Foundation"]),
    "ruby": ("require 'json'\nmodule M\n  class A\n    def f\n      if x\n        1\n      end\n    end\n  end\nend\n", [("module", "M", 2, 10), ("class", "A", 3, 9), ("method", "f", 4, 8)], ["json"]),
    "php": ("<?php\nuse A\\B;\nclass C {\n  public function f() { return 1; }\n}\n", [("class", "C", 3, 5), ("method", "f", 4, 4)], ["A\\B"]),
    "lua": ('local m = require("mod")\nlocal function f(a)\n  return a\nend\n', [("function", "f", 2, 4)], ["mod"]),
    "zig": ('const std = @import("std");\npub const P = struct {\n    pub fn get() u8 {\n        return 1;\n    }\n};\n', [("constant", "std", 1, 1), ("struct", "P", 2, 6), ("method", "get", 3, 5)], ["std"]),
}


@pytest.mark.parametrize("lang", sorted(SOURCES))
def test_symbols_and_imports(lang):
    code, want, imported = SOURCES[lang]
    got = [(s["kind"], s["name"], s["start_line"], s["end_line"]) for s in parsers.symbols(code, lang)]
    assert got == want
    assert parsers.imports(code, lang) == imported
    for cut in range(0, len(code), 7):  # broken code does not raise
        parsers.symbols(code[:cut], lang)


def test_repo_source(spark, tmp_path):
    files = {"a.py": "x = 1\n", "pkg/__init__.py": "", "pkg/_priv.py": "def f(): pass\n", ".github/x.py": "y = 2\n", "out/skip.py": "1", "logs/a.log": "1", "logs/keep.log": "2", "deep/er/b.go": "package b\nfunc B() {}\n", "bin.dat": "a\0b", ".git/config": "z"}
    for p, t in files.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(t.encode())
    (tmp_path / "big.txt").write_bytes(b"x" * ((1 << 20) + 1))
    (tmp_path / ".gitignore").write_text("# rules\nout/\n*.log\n!keep.log\n/nothing\n")
    rows = {r.path: r for r in repo.read_repo(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "pkg/__init__.py", "pkg/_priv.py", ".github/x.py", "logs/keep.log", "deep/er/b.go", ".gitignore"}
    assert rows["a.py"].lang == "python" and rows["a.py"].size == 6 and bytes(rows["a.py"].content) == b"x = 1\n"
    below = repo.read_repo(spark, str(tmp_path), "deep")
    assert [r.path for r in below.collect()] == ["deep/er/b.go"]
    got = parsers.parse_symbols(repo.read_repo(spark, str(tmp_path))).select("path", "name", "kind").collect()
    assert {tuple(r) for r in got} == {("pkg/_priv.py", "f", "function"), ("deep/er/b.go", "B", "function")}
    assert parsers.parse_imports(repo.read_repo(spark, str(tmp_path))).count() == 0


def test_rules_match_git(tmp_path):
    lines = ["*.o", "/build", "docs/*.txt", "!docs/keep.txt", "tmp/", "a/**/z", "**/node", "x?y"]
    paths = ["a.o", "d/b.o", "build", "d/build", "docs/a.txt", "docs/keep.txt", "docs/s/a.txt", "a/z", "a/b/c/z", "q/node", "node", "xzy", "d/xzy", "xzzy"]
    rules = [repo.Rule(x) for x in lines]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("\n".join(lines) + "\n")
    said = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", *paths], capture_output=True, text=True).stdout.split()
    assert [p for p in paths if repo.ignored(rules, p, False)] == said
