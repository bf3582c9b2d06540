import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark import queries as core
from quillspark.functions import edits, names
from quillspark.functions import paths as P
from quillspark.functions import text as X
from quillspark.operators import packing
from quillspark.operators import relational as R
from quillspark.operators import runs as U
from quillspark.operators import sections as C
from quillspark.operators import symbols
from quillspark.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    rows = [tuple(None if v is pd.NA or v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert plain(core.queries()[name](spark, SF).toPandas()) == plain(con.sql(core.oracle_sql()[name]).df())


def test_greedy_packing_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 40), ("g", 4, 500)], "g string, id long, size long")
    got = packing.pack_greedy(rows, "g", ["id"], "size", "id", 100).collect()
    assert sorted(r.id for r in got) == [1, 3]


def test_greedy_packing_equals_a_fold(spark):
    """Many groups, one of which holds most rows; budgets by group; ties; nothing that fits."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(9)}", i, rng.randrange(40), rng.choice([1, 5, 30, 80, 300, 2000])) for i in range(1500)] + [(None, 9999, 1, 1), ("none", 8888, 1, 10**9)]
    budget = {g: 50 * (i + 2) for i, g in enumerate(sorted({r[0] for r in rows if r[0]}))}
    df = spark.createDataFrame([(*r, budget.get(r[0])) for r in rows], "g string, id long, o int, size long, room long").repartition(7)
    want, used = set(), {}
    for g, i, o, s in sorted((r for r in rows if r[0]), key=lambda r: (-r[2], r[1])):
        if used.get(g, 20) + s <= budget[g]:
            used[g] = used.get(g, 20) + s
            want.add((g, i))
    got = packing.pack_greedy(df, "g", [F.negative("o")], "size", "id", "room", fixed=20).collect()
    assert {(r.g, r.id) for r in got} == want and all(r.used == used[r.g] for r in got)
    assert packing.pack_greedy(df.limit(0), "g", ["o"], "size", "id", 10).collect() == []


def test_cosine_of_odd_inputs(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([], []), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(X.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_scan_and_lines(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("def f():\n    pass\n")
    (tmp_path / "src/empty.py").write_text("")
    (tmp_path / "src/b.bin").write_bytes(b"x")
    (tmp_path / "src/c.txt").write_bytes(b"a\0b")
    (tmp_path / "node_modules/x.js").write_text("x")
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.rel_path for r in found.collect()) == ["src/a.py", "src/c.txt"]
    assert [(r.line_no, r.line) for r in files.lines(files.texts(found)).orderBy("line_no").collect()] == [(1, "def f():"), (2, "    pass"), (3, "")]


def test_journal_leaves_bad_lines_out(spark, tmp_path):
    good = '{"schema_version":"1","id":"a","session_id":"s","timestamp":"t","source_ide":"x","project_path":"/p","intent":"fix","decision":"done"}'
    (tmp_path / "j.jsonl").write_text(good + '\n{bad json}\n{"id":"b"}\n\n')
    assert [(r.id, r.tags) for r in files.journal(spark, str(tmp_path / "j.jsonl")).collect()] == [("a", [])]


def test_merge_rules():
    low = {"a": 1, "tools": ["x", "y"], "deep": {"p": 1}}
    assert files.merge_rules(low, {"a": 2, "tools": ["y", "z"], "deep": {"q": 2}}) == {"a": 2, "tools": ["x", "y", "z"], "deep": {"p": 1, "q": 2}}


def test_casing_variants():
    assert names.casing_variants("parse_HTTPHeader") == ["parse_HTTPHeader", "ParseHTTPHeader", "parseHttpHeader", "parse_http_header"]


def test_changes(spark):
    a = spark.createDataFrame([("p", 1, "x"), ("q", 2, "x"), ("r", 3, "x"), ("s", 4, "x")], "k string, n long, h string")
    b = spark.createDataFrame([("p", 1, "x"), ("q", 5, "x"), ("r", 3, "y"), ("t", 4, "x")], "k string, n long, h string")
    assert {r.k: r.status for r in R.changes(a, b, "k").collect()} == {"p": "same", "q": "resized", "r": "changed", "s": "deleted", "t": "new"}


def source_lines(spark):
    texts = {
        "a.rs": "use std::fmt::Display;\npub struct Point;\nimpl fmt::Display for Point {\n}\npub fn area(p: Point) -> i32 {\n    scale(1)\n}\nconst fn scale(x: i32) -> i32 { x }\n",
        "b.py": "class Tree:\n    async def grow(self):\n        scale (2)\n\nscaled(3)\n",
        "c.ts": "import { x } from './x';\nexport class Shop extends Base implements Store, Other.Thing {\n}\nexport const price = 1;\n",
        "d.txt": "def nothing\n",
    }
    rows = spark.createDataFrame([(k, k[2:], v) for k, v in texts.items()], "rel_path string, ext string, text string")
    return files.lines(rows).join(rows.select("rel_path", "ext"), "rel_path")


def test_symbols_imports_and_implementations(spark):
    got = {(r.rel_path, r.name, r.kind, r.line_no) for r in symbols.symbols(source_lines(spark)).collect()}
    assert got == {("a.rs", "Point", "struct", 2), ("a.rs", "area", "function", 5), ("a.rs", "scale", "function", 8), ("b.py", "Tree", "class", 1), ("b.py", "grow", "function", 2), ("c.ts", "Shop", "class", 2), ("c.ts", "price", "const", 4)}
    assert {(r.rel_path, r.imports) for r in symbols.imports(source_lines(spark)).collect()} == {("a.rs", "std::fmt::Display"), ("c.ts", "./x")}
    assert [r.type for r in symbols.implementations(source_lines(spark), "Display").collect()] == ["Point"]
    assert [r.type for r in symbols.implementations(source_lines(spark), "Thing").collect()] == ["Shop"]


def test_callers_and_skeleton(spark):
    got = {(r.rel_path, r.line_no, r.caller) for r in symbols.callers(source_lines(spark), "scale").select("rel_path", "line_no", "caller").collect()}
    assert got == {("a.rs", 6, "area"), ("b.py", 3, "grow")}
    gaps = {(r.line_no, r.gap) for r in symbols.skeleton(source_lines(spark)).filter("rel_path = 'a.rs'").collect()}
    assert gaps == {(1, 0), (2, 0), (5, 2), (8, 2)}


def test_edits(spark):
    rows = spark.createDataFrame([("FOO=bar\n  BAZ=123  \n# comment\n",), (None,)], "t string")
    t = F.col("t")
    got = rows.select(edits.set_env(t, "BAZ", "9").alias("a"), edits.set_env(t, "NEW", "1").alias("b"), edits.delete_env(t, "FOO").alias("c")).collect()
    assert tuple(got[0]) == ("FOO=bar\nBAZ=9\n# comment\n", "FOO=bar\n  BAZ=123  \n# comment\nNEW=1\n", "  BAZ=123  \n# comment\n")
    assert tuple(got[1]) == ("BAZ=9\n", "NEW=1\n", "\n")
    one = spark.range(1).select(edits.file_element(F.lit('a&"b'), F.lit("x]]>y  \n\n")).alias("e")).first().e
    assert one == '<file path="a&amp;&quot;b"><![CDATA[x]]]]><![CDATA[>y]]></file>'


def test_headings_and_sections(spark):
    text = "# One\ntext\n## Two\n```\n# not this\n```\n### Three ##\n## Four\n# Five\n"
    lines = files.lines(spark.createDataFrame([("a.md", text), ("b.md", None)], "rel_path string, text string"))
    got = C.section_ends(C.headings(lines), "rel_path", "line_no", "level", F.lit(10)).orderBy("line_no").collect()
    assert [(r.title, r.level, r.line_no, r.end) for r in got] == [("One", 1, 1, 8), ("Two", 2, 3, 7), ("Three", 3, 7, 7), ("Four", 2, 8, 8), ("Five", 1, 9, 10)]


def folded_runs(spans, most):
    out = []
    for key in sorted({k for k, low, _ in spans if low is not None}):
        open_ = []
        for low, high in sorted((a, b) for k, a, b in spans if k == key):
            if open_ and max(open_[-1][1], high) - open_[-1][0] < most:
                open_[-1] = [open_[-1][0], max(open_[-1][1], high), open_[-1][2] + 1]
            else:
                open_.append([low, high, 1])
        out += [(key, *x) for x in open_]
    return sorted(out)


@pytest.mark.parametrize("fold", [512, 20, 0])
def test_line_groups_equal_brute_force(spark, fold):
    """Overlapping, repeated and too long spans, a hot key; all keys as arrays, some, none."""
    r = random.Random(2)
    spans = [(f"f{k}", low, low + r.randint(0, 40)) for k in range(5) for low in r.sample(range(400), 30)] + [("g", 1, 500), ("g", 2, 3), ("h", None, 3)]
    spans += [("hot", low, low + r.choice([0, 1, 10, 79, 80, 200])) for low in (r.randint(0, 6000) for _ in range(600))] + [("same", 5, 300)] * 30
    df = spark.createDataFrame(spans, "k string, low long, high long").repartition(6)
    got = U.line_groups(df, "k", "low", "high", 80, fold)
    assert got.columns == ["k", "first", "last", "n"] and sorted(tuple(x) for x in got.collect()) == folded_runs(spans, 80)
    assert U.line_groups(df.limit(0), "k", "low", "high", 80, fold).collect() == []


def test_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [bool(re.match(P.glob_regex(g), p)) for g, p in [("packages/*", "packages/a"), ("packages/*", "packages/a/b"), ("**/*.py", "a.py"), ("**/*.py", "x/y/a.py"), ("a?.c", "ab.c")]] == [True, False, True, True, True]
    assert one(P.matches_globs(F.lit("x/y.py"), ["**/*.py"], ["x/*"])) is False and one(P.matches_globs(F.lit(None).cast("string"))) is False
    assert one(P.normal_path(F.lit(".\\a\\b\\"))) == "a/b" and one(P.normal_path(F.lit("/"))) == "/"
    assert one(P.uri_path(F.lit("file:///C:/a/b.txt?q#f"))) == "C:/a/b.txt"
    assert one(P.safe_name(F.lit("a b/c:*d"))) == "a_b_c_d"
    assert one(P.import_candidates(F.lit("src/a"), F.lit("../b/./c")))[:2] == ["src/b/c", "src/b/c.ts"] and one(P.import_candidates(F.lit("src"), F.lit("react"))) == []


def test_short_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(X.short_cell(F.lit("x" * 40))) == "x" * 40 and one(X.short_cell(F.lit("x" * 41))) == "x" * 39 + "…"
    assert one(X.signature(F.lit("fn  f(a: i32)\t-> u8 {\n  1 }"))) == "fn f(a: i32) -> u8"
    assert one(X.without_fences(F.lit("```rust\nfn f() {}\n```"))) == "fn f() {}"
    assert one(X.minified(F.lit("\n" + "é" * 1001))) is True and one(X.minified(F.lit(None).cast("string"))) is False
    assert one(X.unquoted(F.lit("'a'"))) == "a" and one(X.unquoted(F.lit("'a"))) == "'a"
