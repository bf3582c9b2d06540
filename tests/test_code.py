"""Symbols, uses, calls and skeletons on a small corpus of source files."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import code as K
from quillspark.functions import text as X
from quillspark.operators import skeletons as L
from quillspark.operators import symbols as S
from quillspark.operators import tokens as T

FILES = {
    "src/a.rs": """use std::fmt;
// area is only named here
pub struct Point { x: i32 }

impl Point {
    /* nested /* comment */ area */
    pub fn area(&self) -> i32 {
        let s = "area()";
        helper(self.x).clone()
    }
}

fn helper(x: i32) -> i32 {
    x * 2
}

fn outer() -> Point {
    let p = Point { x: 1 };
    p.area();
    // TODO later
    p
}
""",
    "b.py": '''"""doc of area"""
import os
from sys import path

class Tree:
    size = 1

    def grow(self, n):
        # area
        return area(n)

    def _hide(self):
        pass

def area(n):
    return n
''',
    "c.ts": """import { x } from './x';
export class Shop extends Base {
  total(a: number) {
    return invoke('compute_area', a);
  }
}
export const price = (n) => n + 1;
""",
    "d.txt": "plain area text\n",
    "cmd.rs": "#[tauri::command]\nfn compute_area() -> i32 {\n  1\n}\n",
    "min.js": "var a=" + "1+" * 1500 + "1;\n",
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(k, k.rpartition(".")[2], v) for k, v in FILES.items()], "rel_path string, ext string, text string")


def test_comments_and_strings_are_blanked(spark):
    rows = [("rs", 'let a = r#"x "y" z"#; // c\nlet b = \'q\'; let l: &\'a str = "s\\"t"; /* m\nn */ f()'), ("py", 'x = """a\n#b""" # c\ny = \'d\' + e'), ("ts", "a(`t\n${u}`); // v\nb('w')"), ("txt", "# stays")]
    df = spark.createDataFrame(rows, "ext string, text string")
    got = [r[0] for r in df.select(K.code_only(F.col("text"), F.col("ext"))).collect()]
    assert all(len(g) == len(t) and [len(x) for x in g.split("\n")] == [len(x) for x in t.split("\n")] for g, (_, t) in zip(got, rows))
    assert got[0].split() == ["let", "a", "=", ";", "let", "b", "=", ";", "let", "l:", "&'a", "str", "=", ";", "f()"]
    assert got[1].split() == ["x", "=", "y", "=", "+", "e"] and got[2].split() == ["a(", ");", "b(", ")"] and got[3] == "# stays"
    long = "x" * 200_000
    assert df.limit(1).select(F.length(K.code_only(F.lit(f'"{long}" /* {long} */ y'), F.lit("rs")))).first()[0] == 400_011


def test_extents(texts):
    got = {(r.rel_path, r.name): (r.kind, r.line_no, r.line_end) for r in T.definitions(texts).collect()}
    assert got[("src/a.rs", "area")] == ("function", 7, 10) and got[("src/a.rs", "Point")] == ("struct", 3, 3)
    assert got[("b.py", "Tree")] == ("class", 5, 13) and got[("b.py", "grow")] == ("function", 8, 10)
    assert got[("c.ts", "total")] == ("method", 3, 5) and got[("c.ts", "Shop")] == ("class", 2, 6)


def test_usages(texts):
    got = [(r.rel_path, r.line_no, r.category) for r in S.usages(texts, "area").collect()]
    assert ("src/a.rs", 19, "Calls") in got and ("b.py", 10, "Calls") in got
    assert {(p, n) for p, n, _ in got} == {("src/a.rs", 7), ("src/a.rs", 19), ("b.py", 10), ("b.py", 15), ("d.txt", 1)}
    kinds = {r.line_no: r.category for r in S.usages(texts, "Point").collect()}
    assert kinds[17] == "Type Refs" and kinds[18] == "Type Refs"
    assert {r.line_no: r.category for r in S.usages(texts, "x").filter("rel_path = 'src/a.rs'").collect()}[18] == "Field Inits"
    assert sum(r.n for r in S.usage_counts(texts, "area").collect()) == 5


def test_calls(texts):
    out = {(r.rel_path, r.callee, r.line_no) for r in S.outgoing(texts, "area").collect()}
    assert out == {("src/a.rs", "helper", 9)}
    got = {(r.rel_path, r.line_no, r.caller) for r in S.incoming(texts, "area").collect()}
    assert got == {("src/a.rs", 19, "outer"), ("b.py", 10, "grow")}
    sections = [r.section for r in S.blast_radius(texts, "area").collect()]
    assert sorted(sections) == ["definition", "definition", "incoming", "incoming", "outgoing"]


def test_read_symbols(texts):
    got = S.read_symbols(texts, "area").orderBy("instance").collect()
    assert [(r.rel_path, r.line_no) for r in got] == [("b.py", 15), ("src/a.rs", 7)] and got[0].source == "def area(n):\n    return n"
    assert [r.kind for r in S.read_symbols(texts, "TREE").collect()] == ["class"]
    assert "lines more" in S.read_symbols(texts, "area", 1).collect()[0].source
    assert S.first_definition(T.definitions(texts), "function:grow").count() == 1


def test_analysis_and_overview(texts):
    got = {r.rel_path: r for r in S.analysis(texts).collect()}
    assert got["src/a.rs"].imports == ["std::fmt"] and got["src/a.rs"].exports == ["Point", "area"]
    assert got["c.ts"].exports == ["Shop", "price"] and got["min.js"].symbols == [] and len(got) == len(FILES)
    deep = {r.rel_path: r.symbols for r in S.overview(texts).collect()}
    assert deep["b.py"] == "class Tree, function area, function grow"
    assert {r.level for r in S.overview(texts, deep=2).collect()} == {"files"}
    assert {(r.folder, r.symbols) for r in S.overview(texts, shallow=2).collect()} == {("", "5"), ("src", "1")}
    assert [r.rel_path for r in S.overview(texts, ".PY|nothing").collect()] == ["b.py"]


def test_propagation_and_bridges(texts):
    got = {r.rel_path: (r.domain, r.uses, r.first_lines) for r in S.propagation(texts, "computeArea", ["area"]).collect()}
    assert got["cmd.rs"] == ("rust", 1, "2") and got["b.py"] == ("python", 2, "10, 15")
    lines = S.code_lines(texts).withColumn("line", F.col("raw"))
    assert {(r.side, r.rel_path) for r in S.bridges(lines, "compute_area").collect()} == {("command", "cmd.rs"), ("invoke", "c.ts")}


def test_skeletons(texts):
    got = {r.rel_path: r.skeleton for r in L.skeletons(texts).collect()}
    assert got["b.py"].split("\n")[0] == "// ... (2 imports)" and "    def grow(self, n):" in got["b.py"] and "return" not in got["b.py"]
    assert "pub fn area(&self) -> i32 {" in got["src/a.rs"] and "helper(" in got["src/a.rs"] and "clone" not in got["src/a.rs"] and "// ... (1 uses)" in got["src/a.rs"]
    assert got["d.txt"] is None and got["min.js"] is None


def test_universal_skeleton(spark):
    one = lambda t: spark.range(1).select(L.universal(F.lit(t)).alias("x")).first().x
    assert one("mod x;\nfunction a()\n  body\n  class B  \n# todo\n") == "function a()\n...\nclass B\n# todo\n"
    assert one("\n".join("abcdefgh")) == "/* TRUNCATED */\n" + "\n".join("abcdefgh") + "\n" and one(" x\n" * 80) == "/* TRUNCATED */\n" + "x\n" * 50
    assert one("function f\n" * 700) == "function f\n" * 600 + "...\n" and one("function f\n" * 600) == "function f\n" * 600 and one("y" * 2001).startswith("/* MINIFIED")
    assert one("private static val x\nimpl Y\nreturn val x\n") == "private static val x\n" and one(None) is None


def test_text_cuts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.cut_bytes(F.lit("aé€😀"), 9, "…")) == "aé€…" and one(X.cut_bytes(F.lit("abc"), 3)) == "abc" and one(X.cut_bytes(F.lit("😀"), 3)) == ""
    assert one(X.cut_unknown(F.lit("a.sql"), F.lit("x\n" * 60))).endswith("x\n\n/* ... */\n") and one(X.cut_unknown(F.lit("a.z"), F.lit("y"))) == "/* TRUNCATED */\ny\n"
    assert one(X.cut_unknown(F.lit("A.YML"), F.lit("k\n" * 50))) == "# TRUNCATED\n" + "k\n" * 50 and one(X.cut_unknown(F.lit("a.md"), F.lit("é" * 2000))) == "# TRUNCATED\n" + "é" * 1024 + "\n\n/* ... */\n"
    assert X.journal_words("Fix A the  ÄX fix") == ["fix", "the", "äx", "fix"] and X.path_terms("Ab É c") == ["ab", "É"]
    assert one(X.bare_name(F.lit("impl Convert"))) == "convert" and one(X.utc_time(F.lit(1709251199))) == "2024-02-29 23:59:59 UTC"
    kinds = {'{"a":1}': "{object}", "[1]": "[array]", '"x"': "string", "1.5": "number", "true": "bool", "null": "null", "{x": "value"}
    assert all(one(X.value_kind(F.lit(k))) == v for k, v in kinds.items())
    assert X.query_limit(32_000) == 21 and X.query_limit(1000, 5) == 5 and X.candidate_limit(30) == 360
    tests = {"src/main.rs": 120, "a/src/main.rs": 150, "a/tests/x.py": -1000, "app/test_x.py": -1000, "Cargo.toml": 65, "x/readme.md": 10, "a/core/server.ts": 115, "a/b/c/d/e/f/g/h.c": -5, "a/dist/i.json": -25}
    got = {r.p: r.s for r in spark.createDataFrame([(k,) for k in tests], "p string").select("p", X.importance(F.col("p")).alias("s")).collect()}
    assert got == tests
