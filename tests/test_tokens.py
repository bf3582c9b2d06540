"""Tokens, definitions over broken lines and categories by syntax, in all languages."""

import pytest

from quillspark.functions import code as K
from quillspark.operators import skeletons as L
from quillspark.operators import symbols as S
from quillspark.operators import tokens as T

FILES = {
    "a.rs": 'pub fn long<\'a>(\n    x: &\'a str, // fn no() {\n    y: i32,\n) -> i32\nwhere\n    i32: Copy,\n{\n    let s = r#"fn no() { " {"#;\n    /* { /* { */ fn no() {} */\n    x.len()\n}\n\nstruct Unit;\npub struct Pair {\n    a: i32,\n}\ntrait Shape {\n    fn area(&self) -> i32;\n}\nconst SIZE: usize = 3;\n',
    "b.py": 'class Tree(\n    Base,\n):\n    """def no(): pass"""\n\n    async def grow(\n        self,\n        n=")",\n    ):\n        if n:\n            return rb"def no"\n\n        # def no():\n    # end\n\n    def one(self): return 1\n\ndef top(a,\n  b):\n    return f"{a}"\n',
    "c.ts": "export const add = (\n  a: number,\n  b: number,\n): number => {\n  return a + b;\n};\nexport const half = (n) => n / 2;\nconst plain = 3;\nexport class Shop\n  extends Base\n{\n  total(\n    a: number,\n  ): number {\n    if (a) { return `${a}}`; }\n    return a;\n  }\n}\nexport async function load(\n  x,\n) {\n  return x;\n}\ninterface Kind {\n  a: number;\n}\n",
    "d.go": "package p\n\nfunc (s *Server) Run(\n\tn int,\n) error {\n\tx := `func no() {`\n\treturn nil\n}\n\ntype Server struct {\n\tn int\n}\n\nfunc Plain() {}\n",
    "e.java": 'public class Box\n    extends Base {\n  private int n;\n  public int get(\n      int a)\n      throws Error {\n    if (a > 0) {\n      return "}".length();\n    }\n    return n;\n  }\n  Box() { }\n}\n',
    "f.cs": 'class Cell {\n  public string Name(\n    int a) {\n    return $"{a}";\n  }\n}\n',
    "g.c": 'struct point {\n  int x;\n};\nstatic int\nadd(int a,\n    int b)\n{\n  return a + b; /* } */\n}\nint declared(int a);\n',
    "h.cpp": "class Thing {\n public:\n  int size(\n      int a) const {\n    return 1;\n  }\n};\n",
    "i.php": "<?php\nclass Page {\n  public function show(\n    $a,\n    $b\n  ) {\n    return '}'; # }\n  }\n}\n",
    "j.rb": "class Cat\n  def name?(a,\n            b)\n    return 1 if a\n    [1].each do |x|\n      x\n    end\n  end\nend\n",
    "k.proto": "message Ask {\n  string q = 1;\n}\nservice Find {\n  rpc Get (Ask) returns (Ask);\n}\n",
    "l.dart": "class Dog {\n  int bark(\n    int n,\n  ) {\n    return n;\n  }\n}\n",
    "m.ts": "function $http(u) { return u; }\nconst r = $http(1);\nconst o = { $http: 1 };\nx.$http;\n",
    "n.txt": "fn no() {}\n",
}
WANT = {
    ("a.rs", "long", "function", 1, 11), ("a.rs", "Unit", "struct", 13, 13), ("a.rs", "Pair", "struct", 14, 16), ("a.rs", "Shape", "trait", 17, 19), ("a.rs", "area", "function", 18, 18), ("a.rs", "SIZE", "const", 20, 20),
    ("b.py", "Tree", "class", 1, 16), ("b.py", "grow", "function", 6, 11), ("b.py", "one", "function", 16, 16), ("b.py", "top", "function", 18, 20),
    ("c.ts", "add", "arrow", 1, 6), ("c.ts", "half", "arrow", 7, 7), ("c.ts", "plain", "const", 8, 8), ("c.ts", "Shop", "class", 9, 18), ("c.ts", "total", "method", 12, 17), ("c.ts", "load", "function", 19, 23), ("c.ts", "Kind", "interface", 24, 26),
    ("d.go", "Run", "function", 3, 8), ("d.go", "Server", "type", 10, 12), ("d.go", "Plain", "function", 14, 14),
    ("e.java", "Box", "class", 1, 13), ("e.java", "get", "method", 4, 11), ("e.java", "Box", "method", 12, 12),
    ("f.cs", "Cell", "class", 1, 6), ("f.cs", "Name", "method", 2, 5),
    ("g.c", "point", "struct", 1, 3), ("g.c", "add", "function", 5, 9),
    ("h.cpp", "Thing", "struct", 1, 7), ("h.cpp", "size", "function", 3, 6),
    ("i.php", "Page", "class", 2, 9), ("i.php", "show", "function", 3, 8),
    ("j.rb", "Cat", "class", 1, 9), ("j.rb", "name?", "function", 2, 8),
    ("k.proto", "Ask", "message", 1, 3), ("k.proto", "Find", "message", 4, 6), ("k.proto", "Get", "rpc", 5, 5),
    ("l.dart", "Dog", "class", 1, 7), ("l.dart", "bark", "function", 2, 6),
    ("m.ts", "$http", "function", 1, 1), ("m.ts", "r", "const", 2, 2), ("m.ts", "o", "const", 3, 3),
}
USES = """struct Point { x: i32 }
fn make(
    p: &Point,
) -> Vec<
    Point,
> {
    let q = Point {
        x: 1,
    };
    show(
        q,
        |v| q.x,
    );
    q
        .x;
    let s = "q"; // q
    q
}
"""


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, k.rpartition(".")[2], v) for k, v in FILES.items()] + [("null.py", "py", None), ("empty.py", "py", "")]
    return spark.createDataFrame(rows, "rel_path string, ext string, text string").repartition(3)


def test_definitions_over_broken_lines(texts):
    got = {(r.rel_path, r.name, r.kind, r.line_no, r.line_end) for r in T.definitions(texts).collect()}
    assert got == WANT


def test_scanner_covers_odd_texts():
    for lang in T.PATTERNS:
        for text in ("", ")", "}}(", '"', "'", "/*", "/* /* */", "\\", "a\x00b\u2028c", "`${`", "\ufffd", "#", "def f(\n", "    x\n  y\n z", "([{" * 50, "r#" * 20 + '"'):
            rows = list(T.scan(text, lang))
            assert all(r[3] >= 0 and r[0] >= 1 for r in rows) and sum(r[2].count("\n") for r in rows if r[1] != "end") <= text.count("\n")
    deep = list(T.scan("f(" * 3000 + ")" * 3000, "go"))
    assert max(r[3] for r in deep) == 2999 and deep[-1][5] == 1


def test_categories_by_syntax(spark, texts):
    one = spark.createDataFrame([("u.rs", "rs", USES)], "rel_path string, ext string, text string")
    kinds = lambda name: sorted((r.line_no, r.category) for r in T.uses(T.tokens(one), name).collect())
    types, calls, keys, chains, other = K.CATEGORIES
    assert kinds("Point") == [(1, types), (3, types), (5, types), (7, types)]
    assert kinds("q") == [(7, other), (11, calls), (12, calls), (14, chains), (17, other)]
    assert kinds("x") == [(1, keys), (8, keys), (12, calls), (15, chains)] and kinds("show") == [(10, calls)] and kinds("make") == [(2, other)]
    got = {(r.line_no, r.category) for r in S.usages(texts, "$http").collect()}
    assert got == {(1, other), (2, calls), (3, keys), (4, chains)}
    assert [(r.line_no, r.caller) for r in S.incoming(texts, "$http").collect()] == [(2, None)]


def test_skeletons_keep_broken_heads(texts):
    got = {r.rel_path: r.skeleton for r in L.skeletons(texts.filter("rel_path IN ('a.rs', 'b.py', 'c.ts')")).collect()}
    assert "y: i32," in got["a.rs"] and "x.len()" not in got["a.rs"] and ") -> i32" in got["a.rs"]
    assert "        n=\")\"," in got["b.py"] and "return rb" not in got["b.py"] and "a + b" not in got["c.ts"] and "a: number," in got["c.ts"]
