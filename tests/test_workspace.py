"""One budget over a workspace, against a plain walk; the call that chooses what to slice."""

import random

import pytest

from quillspark.plans import workspace as W

from tests.test_plans import frame


def walk(files, members, budget, least):
    """What workspace_slice should keep: (member, path) in order."""
    own = {p: max((m for m in members if p.startswith(m + "/")), key=len, default="*" if "/" in p else ".") for p in files}
    place = {p: {".": 0, "*": 2}.get(own[p], 1) for p in files}
    names = sorted({(place[p], own[p]) for p in files if own[p] != "."})
    lines = ["# ROOT (workspace root)", ""]
    for _, m in names:
        lines += ["# OTHER (outside of members)" if m == "*" else f"# {m.rpartition('/')[2]} ({m})", *sorted(p for p in files if own[p] == m)]
    repo_map = "# REPOSITORY_MAP\n" + "\n".join(lines)
    size = {p: len(t) + 33 + len(p) for p, t in files.items()}
    rest, used, got = budget * 4 - 104 - len(repo_map), 0, []
    at_root = min(max(budget // 10, 500), 2000) * 4
    for p in sorted(p for p in files if own[p] == "."):
        if used + size[p] > at_root:
            break
        used += size[p]
        got.append((".", p))
    rest -= used
    need = {m: sum(size[p] for p in files if own[p] == m[1] and size[p] <= rest) for m in names}
    need = {m: n for m, n in need.items() if n}
    share, open_, left = 0, sorted(need.values()), rest
    while open_ and open_[0] * len(open_) < left:
        left -= open_.pop(0)
    share = max(left // len(open_) if open_ else max(need.values(), default=0), least * 4)
    given, kept = rest, []
    for m in sorted(need):
        room, given = max(0, min(need[m], share, given)), given - min(need[m], share)
        for p in sorted(p for p in files if own[p] == m[1]):
            if size[p] <= room:
                room -= size[p]
                kept.append(p)
    left = rest - sum(size[p] for p in kept)
    for p in sorted((p for p in files if place[p] and p not in kept), key=lambda p: (place[p], own[p], p)):
        if size[p] <= left:
            left -= size[p]
            kept.append(p)
    return got + [(own[p], p) for p in sorted(kept, key=lambda p: (place[p], own[p], p))], repo_map


@pytest.mark.parametrize("budget, least", [(3000, 10), (2500, 600), (50_000, 4000)])
def test_workspace_equals_a_walk(spark, budget, least):
    r = random.Random(budget)
    files = {f"{d}/f{i:02}.txt": "x" * r.choice([5, 80, 400, 1500]) for d in ("a", "b", "b/in", "c", "out/of") for i in range(r.randint(2, 14))}
    files |= {f"r{i}.toml": f"k = {i}" for i in range(3)}
    df = frame(spark, files)
    members = spark.createDataFrame([(m,) for m in ("a", "b", "b/in", "c", ".")], "root string")
    files = {p: f"# TRUNCATED\n{t}\n" if "/" not in p else t for p, t in files.items()}
    got, repo_map = W.workspace_slice(df, members, budget, least)
    want, want_map = walk(files, ["a", "b", "b/in", "c"], budget, least)
    rows = sorted(got.collect(), key=lambda x: x.position)
    assert repo_map.first().repo_map == want_map
    assert [(x.member, x.rel_path) for x in rows] == want and rows[-1].tokens <= budget
    assert {x.rel_path: x.text for x in rows if "/" in x.rel_path}.items() <= files.items()


def test_workspace_map_is_cut_at_whole_lines(spark, monkeypatch):
    monkeypatch.setattr(W, "MAP_BYTES", 24 + 1 + 8 + 2 * 8 + 3)
    df = frame(spark, {f"a/{i:03}.p": "x" for i in range(9)})
    scored = W.L.by_importance(W.owned(df, spark.createDataFrame([("a",)], "root string")))
    got = W.workspace_map(scored, spark.createDataFrame([("a",)], "root string")).first().repo_map
    assert got == "# REPOSITORY_MAP\n# ROOT (workspace root)\n\n# a (a)\na/000.p\na/001.p\n# ... (truncated)\n"


def test_deep_slice_chooses(spark):
    df = frame(spark, {"package.json": '{"workspaces": ["p/*"]}', "p/one/a.py": "a", "p/two/b.py": "b", "p/two/skip/c.py": "c", "q.py": "d"})
    members = spark.createDataFrame([("p/one",), ("p/two",)], "root string")
    assert W.is_large(df) and not W.is_large(df.filter("rel_path <> 'package.json'"))
    cargo = frame(spark, {"Cargo.toml": "m = [" + '"x", ' * 5 + "]"})
    assert W.is_large(cargo) and not W.is_large(frame(spark, {"Cargo.toml": '["x"]', "a/package.json": '{"workspaces": []}'}))
    paths = lambda **k: [r.rel_path for r in W.deep_slice(df, **k).orderBy("position").collect()]
    assert paths(members=members, exclude=["skip"]) == ["package.json", "q.py", "p/one/a.py", "p/two/b.py"]
    assert paths(target="p/two") == ["p/two/b.py", "p/two/skip/c.py"]
    assert paths(target="p", query="skip", only_dir="p/two", budget=500) == ["p/two/skip/c.py"]
    assert paths(target="p/one", query="b", single_file=True) == ["p/one/a.py"]
    with pytest.raises(ValueError, match="'p/two'"):
        W.deep_slice(df, "p/tw")
    with pytest.raises(ValueError, match="does not exist$"):
        W.deep_slice(df, "zzz")
    assert W.workspace_slice(df.limit(0), members, 500)[0].collect() == []
