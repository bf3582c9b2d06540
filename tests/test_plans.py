"""Slices, checkpoints, data files, graphs, the chunk index and edits."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.functions import patches, paths, trees
from quillspark.plans import explore, graphs, history, index, postings, search, slices
from quillspark.sources import files
from quillspark.streaming import refresh


def frame(spark, texts):
    rows = [(k, k.rpartition(".")[2], len(v.encode()), v) for k, v in texts.items()]
    return spark.createDataFrame(rows, "rel_path string, ext string, bytes long, text string")


def test_plain_slice(spark):
    df = frame(spark, {"a/src/main.rs": "fn main() {}\n", "a/src/big.rs": "x" * 2000, "a/x/util.py": "y = 1\n", "a/package.json": '{"name": "p", "junk": 1}'})
    n_map = len("# REPOSITORY_MAP\n") + sum(len(r.rel_path) + 1 for r in df.collect())
    got = slices.plain_slice(df, 140).orderBy("position").collect()
    assert [r.rel_path for r in got] == ["a/src/main.rs", "a/package.json", "a/x/util.py"] and json.loads(got[1].text) == {"name": "p"}
    assert got[-1].tokens == -(-(64 + 40 + sum(33 + len(r.rel_path) + len(r.text) for r in got) + n_map) // 4) <= 140
    edges = spark.createDataFrame([("q", "a/x/util.py")] * 16, "source string, target string")
    assert slices.plain_slice(df, 140, edges).orderBy("position").first().rel_path == "a/x/util.py"
    xml = slices.document(slices.plain_slice(df, 140), slices.repository_map(df)).first().xml
    assert xml.index("a/src/big.rs") < xml.index('<file path="a/src/main.rs">') < xml.index('<file path="a/x/util.py">')
    assert slices.totals(slices.plain_slice(df, 140), 140).first().files == 3
    short = {r.rel_path: r.text for r in slices.plain_slice(df, 1000, skeleton=True, focus="a/x/util.py").collect()}
    assert short["a/x/util.py"] == "y = 1\n" and short["a/src/main.rs"] == "fn main() {}"


def test_query_slice_and_members(spark):
    df = frame(spark, {"app/auth.py": "a = 1\n", "app/auth/other.py": "b = 22\n", "lib/auth.py": "c\n", "lib/z.py": "d\n", "application/auth.py": "e\n"})
    assert [r.rel_path for r in slices.query_slice(df, None, "Auth x", 500, "app").orderBy("position").collect()] == ["app/auth.py", "app/auth/other.py"]
    ranked = spark.createDataFrame([("lib/z.py", 1), ("app/auth.py", 2)], "rel_path string, rank int")
    assert [r.rel_path for r in slices.query_slice(df, ranked, "q", 500).orderBy("position").collect()] == ["lib/z.py", "app/auth.py"]
    assert slices.query_slice(df, None, "nothing", 500).count() == 5
    members = spark.createDataFrame([("app",), ("lib",)], "root string")
    got = {(r.member, r.rel_path) for r in slices.member_slices(df, members, 500).collect()}
    assert got == {("app", "app/auth.py"), ("app", "app/auth/other.py"), ("lib", "lib/auth.py"), ("lib", "lib/z.py")}


def test_repository_map_is_cut_at_whole_lines(spark, monkeypatch):
    df = frame(spark, {f"d/{i:03}.py": "x" for i in range(30)})
    assert slices.repository_map(df).first().repo_map == "# REPOSITORY_MAP\n" + "".join(f"d/{i:03}.py\n" for i in range(30))
    monkeypatch.setattr(slices, "MAP_BYTES", 17 + 9 * 4 + 5)
    assert slices.repository_map(df).first().repo_map == "# REPOSITORY_MAP\n" + "".join(f"d/{i:03}.py\n" for i in range(4)) + "# ... (truncated)\n"
    monkeypatch.setattr(slices, "MAP_LINES", 2)
    assert slices.repository_map(df).first().repo_map.count("\n") == 4 and slices.repository_map(df.limit(0)).first().repo_map == "# REPOSITORY_MAP\n"


def test_compact_manifests_keep_order_and_tables(spark):
    cargo = '[workspace]\nmembers = [\n  "a",\n  "[b]",\n]\n\n[profile.dev]\nx = 1\n\n[package]\nname = "q"\n[dependencies]\nserde = { version = "1", features = ["a"] }\n[[bin]]\nname = "m"\n'
    got = slices.compact("cargo.toml", cargo)
    import tomllib

    want = tomllib.loads(cargo)
    del want["profile"]
    assert tomllib.loads(got) == want and "[profile" not in got and slices.compact("cargo.toml", "= broken") == "= broken"
    assert slices.compact("package.json", '{"optionalDependencies": {"x": "1"}, "junk": 2, "name": "n"}') == '{\n  "name": "n",\n  "optionalDependencies": {\n    "x": "1"\n  }\n}'


def test_checkpoints(spark, tmp_path):
    folder = str(tmp_path / "marks")
    assert history.checkpoints(spark, folder).count() == 0
    rows = spark.createDataFrame([("./a.rs", "f", "fn f() {}", 1, 1), ("b.rs", "f", "fn f() { 1 }", 3, 3)], "path string, symbol string, code string, line_no int, line_end int")
    history.save(rows, folder, "n", "v1")
    history.save(rows.filter("path = './a.rs'").withColumn("code", F.lit(" fn f() {} \n")), folder, "n", "v2")
    (tmp_path / "marks/namespace=n/bad.json").write_text("{bad\n")
    all_ = history.checkpoints(spark, folder)
    assert all_.count() == 3 and history.compared(all_, "v1", "v2", "f", "a.rs").first().same is True
    for args in (("v1", "v2", "f"), ("v1", "v3", "f")):
        with pytest.raises(LookupError):
            history.compared(all_, *args)
    live = spark.createDataFrame([("f", "a.rs", "fn f() { 2 }")], "symbol string, path string, code string")
    assert history.compared(all_, "v2", history.LIVE, "f", live=live).first().same is False
    assert history.deleted(all_, tag="v1").count() == 1 and history.deleted(all_, namespace="n").count() == 0
    with pytest.raises(ValueError):
        history.deleted(all_)
    assert [(r.tag, r.more) for r in history.listing(all_, most=1).orderBy("tag").collect()] == [("v1", 1), ("v2", 0)]


def entry(i, **more):
    return {"schema_version": "1", "id": i, "session_id": "s", "timestamp": "t", "source_ide": "x", "project_path": "/p/one", "intent": "fix the login", "decision": "done"} | more


def test_recall(spark, tmp_path):
    rows = [entry("a", tags=["Auth"], vector=[1.0, 0.0]), entry("b", intent="other", vector=[0.0, 1.0]), entry("c", project_path="/q", vector=[1.0])]
    (tmp_path / "j.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n{bad json}\n")
    j = files.journal(spark, str(tmp_path / "j.jsonl"))
    got = search.recall(j, "login fix", [0.0, 1.0]).collect()
    assert {r.id: round(r.score, 4) for r in got} == {"a": 0.3, "b": 0.7, "c": 1.0} and [r.id for r in sorted(got, key=lambda r: r.rank)] == ["c", "b", "a"]
    assert [r.id for r in search.recall(j, "login", tags=["AUTH"]).collect()] == ["a"] and search.recall(j, "login", project="/q").count() == 1
    assert files.journal(spark, str(tmp_path / "none.jsonl")).count() == 0
    with pytest.raises(ValueError):
        search.recall(j, "  ")


def test_data_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx y\n2\n3\tLong " + "z" * 60 + "\n")
    rows = files.delimited(spark, str(tmp_path / "t.tsv"))
    assert [tuple(r) for r in rows.collect()][1] == ("2", None)
    assert explore.table_overview(rows).collect()[2].b.endswith("…") and explore.found_rows(rows, "X Y", ["a"]).count() == 1
    texts = frame(spark, {"a.log": "\n".join(f"line {i}" for i in range(1, 101)), "b.log": "x\ny", "c.yaml": "p:\n  q: [1, two]\n", "d.toml": "[p]\nq = 1\n", "e.json": "{bad", "f.md": "# A\nx\n## B\ny\n# C\n"})
    seen = explore.text_overview(texts).groupBy("rel_path").count().collect()
    assert {r.rel_path: r["count"] for r in seen}["a.log"] == 40 and {r.rel_path: r["count"] for r in seen}["b.log"] == 2
    trees = explore.as_json(texts.filter("ext IN ('yaml', 'toml', 'json')"))
    got = {r.rel_path: r for r in trees.collect()}
    assert json.loads(got["c.yaml"].json) == {"p": {"q": [1, "two"]}} and got["e.json"].error and got["e.json"].json is None
    assert [r.x for r in trees.filter("rel_path = 'c.yaml'").select(explore.dot_path("json", "p.q.1").alias("x")).collect()] == ["two"]
    assert {(r.rel_path, r.name, r.kind) for r in explore.keys_of(trees).collect()} == {("c.yaml", "p", "{object}"), ("d.toml", "p", "{object}")}
    assert explore.found_lines(texts, "LINE", 20).filter("rel_path = 'a.log'").count() == 3
    heads = explore.outline(texts.filter("ext = 'md'"))
    assert [(r.title, r.line_no, r.end) for r in heads.orderBy("line_no").collect()] == [("A", 1, 4), ("B", 3, 4), ("C", 5, 6)]
    one = explore.byte_range(texts.filter("ext = 'md'").join(heads.filter("title = 'B'").select("rel_path", F.col("line_no").alias("start"), "end"), "rel_path")).first()
    assert one.text[one.first_byte : one.last_byte] == "## B\ny\n"
    assert explore.reader_of("x/Y.TOML") == "structured" and explore.reader_of("a.csv") == "table" and explore.reader_of("a.png") is None


def test_graphs(spark):
    df = frame(spark, {"src/a.ts": "aa", "src/b.ts": "b", "src/sub/c.ts": "c", "Cargo.toml": "t", "pkg/x/Cargo.toml": "t", "pkg/x/src/l.rs": "l", "pkg/xy/m.rs": "m"})
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "./sub/c"), ("src/a.ts", "react"), ("pkg/xy/m.rs", "my_x::f")], "rel_path string, imports string")
    edges = graphs.import_edges(df, imports)
    assert {(r.source, r.target) for r in edges.collect()} == {("src/a.ts", "src/b.ts"), ("src/a.ts", "src/sub/c.ts")}
    nodes, links = graphs.repo_map(df, imports, "src")
    assert {(r.id, r.kind, r.bytes) for r in nodes.collect()} == {("src", "folder", 4), ("src/a.ts", "file", 2), ("src/b.ts", "file", 1), ("src/sub", "folder", 1)}
    assert sorted((r.source, r.target) for r in links.filter("kind = 'imports'").collect()) == [("src/a.ts", "src/b.ts")] and links.count() == 4
    of = graphs.owners(df, graphs.module_roots(df))
    assert {r.rel_path: r.module for r in of.collect()}["pkg/x/src/l.rs"] == "pkg/x" and {r.rel_path: r.module for r in of.collect()}["pkg/xy/m.rs"] == "."
    packages, declared = spark.createDataFrame([("my-x", "pkg/x")], "name string, module string"), spark.createDataFrame([(".", "pkg/x")], "module string, path string")
    assert [tuple(r) for r in graphs.module_edges(edges, of, packages, imports, declared).collect()] == [(".", "pkg/x", 6)]
    assert {(r.id, r.file_count) for r in graphs.module_nodes(df, of).collect()} == {(".", 5), ("pkg/x", 2)}
    assert {(r.target, r.in_degree) for r in graphs.in_degree(edges).collect()} == {("src/b.ts", 1), ("src/sub/c.ts", 1)}


def test_chunk_index(spark, tmp_path):
    body = "".join(f"def f{i}():\n" + "    x = 1  # a long line that fills the file up\n" * 30 for i in range(8))
    df = frame(spark, {"s.py": "a = 1\n", "b.py": "import os\n" + body, "t.txt": "line of text to fill\n" * 600})
    cut = index.chunks(df, 60).collect()
    of = lambda p: [(r.chunk, r.first, r.last, r.symbols) for r in sorted(cut, key=lambda r: r.first) if r.rel_path == p]
    assert of("s.py") == [(0, 1, 2, [])] and [x[1:3] for x in of("t.txt")][:2] == [(1, 60), (61, 120)] and of("t.txt")[-1][2] == 601
    assert of("b.py")[0] == (0, 1, 1, ["<preamble>"]) and of("b.py")[1] == (1, 2, 32, ["function f0"]) and of("b.py")[-1][2] == 250
    empty = index.load(spark, str(tmp_path / "none"))
    made = index.refreshed(empty, df, index.hashed_vectors, "m", 60)
    index.save(made, str(tmp_path / "one"))
    stored = index.load(spark, str(tmp_path / "one"))
    assert stored.count() == len(cut) and stored.filter("size(vector) <> 256").count() == 0
    later = df.filter("rel_path <> 't.txt'").withColumn("text", F.when(F.col("rel_path") == "s.py", "b = 2\n").otherwise(F.col("text")))
    again = index.refreshed(stored, later, index.hashed_vectors, "m", 60)
    assert {r.path for r in again.collect()} == {"s.py", "b.py"} and index.usable(stored, "m", 40).count() == index.usable(stored, "n", 60).count() == 0
    assert {r.path for r in index.without_endings(stored, ["py"]).select("path").distinct().collect()} == {"t.txt"}
    status = spark.createDataFrame([("new",), ("changed",), ("resized",), ("deleted",), ("same",)], "status string")
    assert tuple(index.counters(status).first()) == (1, 2, 1, 1)


def test_edits_of_code_and_config(spark):
    df = frame(spark, {"a.py": "def f():\n    return 1\n\ndef g():\n    return 2\n"})
    assert patches.replaced_symbols(df, "function:f", "def f():\n    return 3").first().text == "def f():\n    return 3\n\ndef g():\n    return 2\n"
    assert patches.replaced_symbols(df, "g", None).first().text == "def f():\n    return 1\n\n"
    edits = spark.createDataFrame([("a.py", 1, 1, "x"), ("a.py", 4, 5, None), ("a.py", 1, 2, "lost")], "rel_path string, first int, last int, new string")
    assert patches.replaced_lines(df, edits.filter("new IS NULL OR new = 'x'")).first().text == "x\n    return 1\n\n"
    md = frame(spark, {"a.md": "# A\nold\n## Sub\nold\n# B\nstays"})
    assert patches.replaced_section(md, "a", "new").first().text == "# A\n\nnew\n\n# B\nstays"
    conf = frame(spark, {"c.json": '{"db":{"host":"localhost","port":5432}}', "c.yaml": "db:\n  port: 1\n", "c.toml": "a = 1\n[db]\nport = 1\n\n[z]\n", "bad.json": "{"})
    got = {r.rel_path: r for r in patches.patched_config(conf, "db.port", 9).collect()}
    assert json.loads(got["c.json"].text)["db"]["port"] == 9 and "port: 9" in got["c.yaml"].text and got["c.toml"].text == "a = 1\n[db]\nport = 9\n\n[z]\n" and got["bad.json"].error
    gone = {r.rel_path: r.text for r in patches.patched_config(conf, "db.host", delete=True).collect()}
    assert json.loads(gone["c.json"]) == {"db": {"port": 5432}} and gone["c.yaml"] == "db:\n  port: 1\n"
    added = {r.rel_path: r.text for r in patches.patched_config(conf, "new.x", ["a", True]).collect()}
    assert added["c.toml"].endswith('[new]\nx = ["a", true]\n')


def test_scan_rules_and_workspaces(spark, tmp_path):
    for name, text in {"a/.hidden/x.py": "x", "a/keep.log": "k", "a/b.log": "l", "gen/y.py": "y", ".env": "e", "Cargo.toml": "[package]\nname = 'top'\n", "svc/Cargo.toml": '[package]\nname = "svc"\n[dependencies]\nx = { path = "../x" }\n', "w/d/e/f/package.json": '{"name": "deep"}'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = files.scan(spark, str(tmp_path), ignore="# c\n*.log\n!keep.log\n/gen/\n")
    assert sorted(r.rel_path for r in got.collect()) == ["Cargo.toml", "a/keep.log", "svc/Cargo.toml", "w/d/e/f/package.json"]
    assert [r.rel_path for r in files.scan(spark, str(tmp_path / "a/b.log")).collect()] == ["b.log"]
    counts, dropped = files.funnel(files.found(spark, str(tmp_path)), got)
    assert counts.first().scanned == 6 and counts.first().kept == 4 and [r.rel_path for r in dropped.collect()] == ["a/b.log", "gen/y.py"]
    texts = files.texts(got)
    assert [(r.root, r.name) for r in files.members(texts).collect()] == [(".", "top"), ("svc", "svc")]
    assert [r.root for r in files.members(texts, include=["w/**"], exclude=["svc"]).collect()] == [".", "w/d/e/f"]
    assert [r.path for r in files.path_dependencies(texts).collect()] == ["../x"]
    (tmp_path / "net.json").write_text('{"codebases": [{"id": "one", "path": "/x"}, {"id": "two"}]}')
    known = files.network(spark, str(tmp_path / "net.json"))
    asked = spark.createDataFrame([("one",), ("/x",), ("three",)], "target string")
    assert sorted(r.target for r in files.allowed(asked, known).collect()) == ["/x", "one"]
    bad = spark.createDataFrame([("a", bytearray(b"\xff")), ("b", bytearray(b"ok"))], "rel_path string, content binary")
    assert [r.rel_path for r in files.texts(bad, strict=True).collect()] == ["b"] and files.texts(bad).count() == 2


def test_rules():
    tiers = [{"persona": "a", "tools": ["x"]}, {"persona": "team"}, {"tools": ["y"]}]
    assert files.merged_rules(tiers, team="t") == {"persona": "team", "tools": ["x", "y"]} and files.merged_rules(tiers, sync=False, team="t")["persona"] == "a"
    assert files.merged_rules([]) == {"status": "no_rules_found"}
    rules = {"sql_style": 1, "vision_model": 2, "persona": 3}
    assert files.rules_for(rules, "db/x.sql", {".sql": ["sql"], "images": ["vision"]}) == {"sql_style": 1, "persona": 3}


def test_stream_hands_on_new_files_once(spark, tmp_path):
    seen = []
    each = lambda df, n: seen.append(df.count())
    for i in range(2):
        spark.range(3 + i).write.mode("append").parquet(str(tmp_path / "in"))
        refresh.follow(spark, str(tmp_path / "in"), "id long", str(tmp_path / "marks"), each).awaitTermination()
    assert seen == [3, 4]


def test_ignore_files_of_folders(spark):
    """Rules of deeper folders and later lines decide; a folder's rules reach below it only."""
    paths = ["a.log", "x/a.log", "x/keep.log", "x/y/a.log", "x/y/b.txt", "z/b.txt", "x/gen/c.txt", "src/bin/main.rs", "build/o.txt", "z/top.txt", "top.txt"]
    rows = spark.createDataFrame([(p, 1) for p in paths], "rel_path string, bytes long")
    ignores = spark.createDataFrame([("", "*.log\n/top.txt\n"), ("x", "!keep.log\ngen/\n"), ("x/y", "!*.log\nb.txt\n"), ("none", "*\n"), ("z", None)], "folder string, text string")
    kept = {r.rel_path for r in files.kept_by_ignores(rows, ignores).collect()}
    assert kept == {"x/keep.log", "x/y/a.log", "z/b.txt", "src/bin/main.rs", "build/o.txt", "z/top.txt"}
    assert {r.rel_path for r in files.wanted(rows).collect()} == set(paths) - {"build/o.txt"}
    assert files.kept_by_ignores(rows, ignores.limit(0)).count() == len(paths)


def test_places_in_json(spark):
    text = '{"a": {"b": [1, {"c": "x\\"}"}, []], "é": null}, "d" : -1.5e3, "": true}'
    got = {p: text.encode()[a:b].decode() for p, a, b, _ in trees.places(text.encode())}
    assert got == {"a.b.0": "1", "a.b.1.c": '"x\\"}"', "a.b.1": '{"c": "x\\"}"}', "a.b.2": "[]", "a.b": '[1, {"c": "x\\"}"}, []]', "a.é": "null", "a": got["a"], "d": "-1.5e3", "": text} | {"": got[""]}
    assert json.loads(got["a"]) == json.loads(text)["a"] and list(trees.places(b"{bad")) == [] and [p[3] for p in trees.places(b"[]")] == ["list"]
    rows = spark.createDataFrame([(1, text, "p"), (1, text, "q"), (2, None, "r"), (3, "no json", "s"), (4, '{"d":0}', "t")], "id int, j string, path string")
    new = {r.path: r.j for r in trees.spliced(rows, "j", "d", '{"z": 1}').collect()}
    assert new == {"p": text.replace("-1.5e3", '{"z": 1}'), "q": text.replace("-1.5e3", '{"z": 1}'), "r": None, "s": "no json", "t": '{"d":{"z": 1}}'}
    assert trees.byte_ranges(rows.limit(0), "j").collect() == []


def test_paths_of_any_depth(spark):
    one = lambda f, t: spark.range(1).select(paths.joined(F.lit(f), F.lit(t)).alias("x")).first().x
    assert one("a/b", "../../x") == "x" and one("a/b", "../../../x") is None and one("a", "./b//c/./d") == "a/b/c/d" and one("a/b", "../..") == "." and one("a", "/z") == "z"
    deep = "/".join("abcdefghijklmnopqrstuvwxyz")
    assert one(deep, "../" * 25 + "q") == "a/q" and one(deep, "..\\..\\q") == deep[:-4] + "/q"
    rel = lambda p, r: spark.range(1).select(paths.relative_to(F.lit(p), F.lit(r)).alias("x")).first().x
    assert rel("C:\\repo\\src\\a.rs", "C:/repo/") == "src/a.rs" and rel("./repo", "repo") == "." and rel("repository/a", "repo") == "repository/a"
    declared = spark.createDataFrame([("apps/web", "../../x"), ("apps/web", "../../../x"), (".", "./x"), ("apps/web", "../none")], "module string, path string")
    roots = spark.createDataFrame([("x",), ("apps/web",), (".",)], "root string")
    assert {tuple(r) for r in graphs.declared_modules(declared, roots).collect()} == {("apps/web", "x"), (".", "x")}


def test_postings_answer_many_names(spark):
    texts = spark.createDataFrame([("a.py", "py", "def getUser(x):\n    return x  # get_user\n"), ("b.rs", "rs", "fn get_user(x: i32) {\n let s = \"getUser\";\n get_user(1); }"), ("c.ts", "ts", "GetUser();")], "rel_path string, ext string, text string")
    index_ = postings.of_code(texts)
    names = spark.createDataFrame([("get_user",), ("x",), ("none",)] + [(f"n{i}",) for i in range(1000)], "name string")
    got = {(r.asked, r.rel_path): (r.uses, r.lines) for r in postings.found(index_, names).collect()}
    assert got == {("get_user", "b.rs"): (2, [1, 3]), ("x", "a.py"): (2, [1, 2]), ("x", "b.rs"): (1, [1])}
    cased = {(r.asked, r.name, r.rel_path) for r in postings.found(index_, names.limit(1), any_casing=True).collect()}
    assert cased == {("get_user", "getUser", "a.py"), ("get_user", "get_user", "b.rs"), ("get_user", "GetUser", "c.ts")}
    newer = postings.of_code(spark.createDataFrame([("a.py", "py", "y = 1")], "rel_path string, ext string, text string"))
    after = postings.refreshed(index_, newer, spark.createDataFrame([("c.ts",)], "rel_path string"))
    assert {(r.name, r.rel_path) for r in after.filter("rel_path <> 'b.rs'").collect()} == {("y", "a.py")} and after.filter("rel_path = 'b.rs'").count() == index_.filter("rel_path = 'b.rs'").count()
