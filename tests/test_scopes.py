import pytest

from codeloom.functions import scopes as X
from codeloom.operators import binding as B

#: Traps: (file, code, [(reference, occurrence, line of its declaration or None)]).
CASES = [
    ("a.ts", "import { go } from './x';\nfunction run(go: number) {\n  return go;\n}\nfunction other() {\n  const v = 1;\n  return v;\n}\n", [("go", 0, 2), ("v", 0, 6)]),
    ("a.c", "int size(int a) {\n  return a;\n}\nint use(int n) {\n  int r = size(n);\n  int size = 3;\n  return size + r;\n}\n", [("a", 0, 1), ("n", 0, 4), ("r", 0, 5)]),
    ("a.py", "def outer(x):\n    y = x\n    def inner(y):\n        return y\n    return inner(y)\n\nclass A:\n    z = 1\n    def f(self):\n        return z\n", [("x", 0, 1), ("y", 0, 3), ("y", 1, 2), ("inner", 0, 3), ("z", 0, None)]),
    ("a.go", "package a\nfunc Top() int {\n  v := 1\n  if v > 0 {\n    v := 2\n    return v\n  }\n  return v + Top()\n}\n", [("v", 0, 3), ("v", 1, 5), ("v", 2, 3), ("Top", 0, 2)]),
    ("a.lua", "local function f(a)\n  local function g(a)\n    return a\n  end\n  return g(a)\nend\nreturn f(1)\n", [("a", 0, 2), ("g", 0, 2), ("a", 1, 1), ("f", 0, 1)]),
    ("A.java", "class A {\n  int item;\n  int f(int item) {\n    return item;\n  }\n  int g() {\n    return item;\n  }\n}\n", [("item", 0, 3), ("item", 1, 2)]),
    ("a.rs", "fn f(a: u8) -> u8 {\n    let b = a;\n    {\n        let a = b;\n        a\n    }\n}\n", [("a", 0, 1), ("b", 0, 2), ("a", 1, 4)]),
]


@pytest.fixture(scope="module")
def bound(spark):
    files = spark.createDataFrame([(p, bytearray(c.encode())) for p, c, _ in CASES], "path string, content binary")
    scopes, decls, refs = X.parse_scopes(files)
    rows = B.bind(scopes, decls, refs, class_scopes_hide=False).collect()
    python = B.bind(scopes, decls, refs, class_scopes_hide=True).where("path = 'a.py'").collect()
    return {(r.path, r.ord): r.decl_id for r in rows if r.path != "a.py"} | {(r.path, r.ord): r.decl_id for r in python}, {(r.path, r.ord): r for r in refs.collect()}, {r.decl_id: r for r in decls.collect()}


@pytest.mark.parametrize("case", CASES, ids=[c[0] for c in CASES])
def test_traps(bound, case):
    binding, refs, decls = bound
    path, code, want = case
    mine = sorted((r for (p, _), r in refs.items() if p == path and r.reason is None), key=lambda r: r.start_byte)
    for name, k, line in want:
        r = [x for x in mine if x.name == name][k]
        d = decls.get(binding[path, r.ord])
        assert (code.encode().count(b"\n", 0, d.start_byte) + 1 if d else None) == line, (name, k)


def test_broken_code_does_not_raise():
    for path, code, _ in CASES:
        lang = X.LANGUAGE_OF["." + path.split(".")[-1]]
        for cut in range(0, len(code), 5):
            X.parse(code[:cut], lang)
