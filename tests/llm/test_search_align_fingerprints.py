"""Ranked search, tokenizer alignment and fingerprints against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import alignment, fingerprints, ranking

TERM = re.compile(ranking.TERM)
ODD = [(0, None), (1, ""), (2, "Apple pie apple"), (3, "Apple pie apple"), (4, "pie"), (5, "  \n"), (6, "ÉÉ éé ẞ 1a_b"), (None, "apple pie"), (8, "plum " * 4000 + "pie"), (9, "pie"), (9, "pie apple")]


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_ranks(docs, items, k=10):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for i, wanted in asked.items():
        scores = []
        for d, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // length
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 8 * m)) for t, c in wanted.items() if t in b)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if gone else d, -s) for r, (s, gone, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("blocks", [{}, {"block_items": 1}, {"block_pairs": 2}])
def test_ranks_equal_brute_force(spark, blocks):
    items = [(1, "APPLE pie"), (2, "pie pie unknown"), (2, "plum"), (3, ""), (4, None), (None, "éé"), (5, "nothing here")]
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in ODD], "doc_id long, text string, rank string, score int").repartition(3)
    got = ranking.ranked(docs, spark.createDataFrame(items, "item_id int, text string"), **blocks)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(ODD, items)


def test_ranks_with_ties_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(ranking, "TILE_DOCS", 7)
    monkeypatch.setattr(ranking, "TILE_TERMS", 3)
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randint(0, 4)))) for i in rng.sample(range(1000), 150)]
    items = [(i, " ".join(rng.choice("abcdefghijk") for _ in range(6))) for i in range(5)]
    got = ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranks(docs, items)


def test_ranks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.ranked(docs.limit(0), items).collect() == []
    assert ranking.ranked(docs, items.limit(0)).collect() == []


def test_weight_tiles_stay_exact(monkeypatch):
    monkeypatch.setattr(ranking, "EXACT", 1000 * ranking.IMPACT)
    rng = np.random.default_rng(3)
    items, columns = np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)
    weights = rng.integers(1, 3500, 24)
    tiles = ranking.vocabulary_tiles(items, columns, weights, 4)
    total = np.zeros((4, 6), np.int64)
    for at, i, c, w in tiles:
        assert (np.bincount(i, w, 4) < 1000).all()
        np.add.at(total, (i, at[c]), w.astype(np.int64))
    assert total.ravel().tolist() == weights.tolist() and len(tiles) > 3


def brute_alignment(docs):
    tok = alignment.Tokenizers(alignment.tokenizer_paths())
    letters = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
    aligned = []
    for text in docs:
        data, a, b = f" {text or ''}".encode(), tok.whole.encode(f" {text or ''}", add_special_tokens=False).ids, tok.pieces.encode(text or "")
        a_bytes = [bytes(letters[c] for c in tok.whole.id_to_token(i)) for i in a]
        b_bytes = [tok.b_bytes[i] for i in b]
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            aligned.append(None)
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        cuts = sorted({*a_end.tolist()} & {*b_end.tolist()})
        parts = [[[x for x, e in zip(ids, ends, strict=True) if low < e <= high] for ids, ends in ((a, a_end), (b, b_end))] for low, high in zip([0, *cuts], cuts, strict=False)]
        aligned.append((len(a), len(b), parts))
    count, best = Counter(), defaultdict(int)
    for x in filter(None, aligned):
        count.update({(i, j) for a, b in x[2] for i in a for j in b})
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    out = []
    for x in aligned:
        links = [(i, j) for a, b in x[2] for i in a for j in b] if x else []
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x[2]) if x else ""
        sizes = (x[0], x[1], len(x[2])) if x else (0, 0, 0)
        out.append((*sizes, len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out


ODD_TEXTS = [None, "", " ", "a", "two  blanks\tand\n\n\nlines", "<|endoftext|> <s> <0x41> ▁ x", "日本語のテキスト、漢字。", "naïve ﬁ ½     é", "👩‍👩‍👧 🎉", "\x00\x01", "x" * 3000, " " * 2500 + "end", "word " * 9000, "two  blanks\tand\n\n\nlines", "Eauouon enpaè. The tion of"]


def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string").withColumns({"row": F.lit(1), "keys": F.lit("x"), "part": F.lit(None)})
    want = brute_alignment(ODD_TEXTS)
    for sizes in ({}, {"block_pairs": 40, "task_links": 50}):
        got = {r[0]: tuple(r)[1:] for r in alignment.scored(docs, **sizes).collect()}
        assert [got[i] for i in range(len(ODD_TEXTS))] == want
    assert want[5][0] == 0 and want[6][0] > 0  # a mark that the second tokenizer reads as a blank


def test_alignment_of_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored(empty).collect() == [] and alignment.groups(empty).collect() == []
    twice = alignment.scored(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert len(twice) == 3 and {r.count_sum for r in twice} == {3 * twice[0].n_links}


def test_groups_cover_every_byte(spark):
    rows = alignment.groups(spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")).orderBy("doc_id", "position").collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, got in by.items():
        assert [r.position for r in got] == list(range(len(got)))
        assert [r.first_byte for r in got] == [0, *[r.end_byte for r in got[:-1]]] and got[-1].end_byte == len(f" {ODD_TEXTS[i]}".encode())


def test_cuts_equal_intersection():
    rng = np.random.default_rng(11)
    for dense in (0.02, 0.3, 0.9):
        for _ in range(20):
            n = int(rng.integers(1, 400))
            a, b = (np.unique(np.append(rng.integers(1, n + 1, int(n * dense) + 1), n)) for _ in range(2))
            got = alignment.shared_cuts(a, b, np.array([[0, len(a), 0, len(b)]]))
            assert a[got[:, 1] - 1].tolist() == b[got[:, 3] - 1].tolist() == np.intersect1d(a, b).tolist()


def test_wide_groups_count_all_links():
    class Fixed:
        a_size, b_size = np.ones(5, int), np.ones(5, int)

        def encode(self, texts):
            return [([1, 2, 1] * 5, [3, 4] * 9) for _ in texts]

    batch = alignment.Batch.__new__(alignment.Batch)
    batch.a, batch.b = np.array([1, 2, 1] * 5), np.array([3, 4] * 9)
    batch.groups, batch.doc, batch.sizes = np.array([[0, 15, 0, 18]]), np.array([0]), np.array([15 * 18])
    texts, keys, times = batch.links()
    want = Counter((a << alignment.B_BITS) + b for a in [1, 2, 1] * 5 for b in [3, 4] * 9)
    assert dict(zip(keys.tolist(), times.tolist(), strict=True)) == dict(want) and texts.tolist() == [0] * 4


def bag(text):
    return Counter(w for w in re.split("[ \t\n\x0b\x0c\r]", text or "") if w)


def jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def sorted_docs(docs):
    return sorted(docs, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_edited_texts_and_next(spark, parts):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ODD], "doc_id long, text string, part int, row string").repartition(4)
    got = fingerprints.with_edits(docs, parts=parts).collect()
    order, want, by_id = sorted_docs(ODD), [], defaultdict(set)
    for i, (d, t) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        by_id[d].add(t == after)
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert next(r.near_next for r in got if r.doc_id == 2) == 1.0  # its copy follows
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1 and {r.fingerprint for r in got if r.doc_id in (0, 1)} == {""}


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string")
    row = fingerprints.with_edits(one).first()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest()
    assert fingerprints.with_edits(one.limit(0)).collect() == []
    assert len(fingerprints.with_edits(spark.createDataFrame([(None, "a"), (None, None)], "doc_id long, text string")).collect()) == 2


def test_collisions_equal_generalised_jaccard(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words[: rng.randint(3, 40)], k=rng.randint(5, 120))) for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    terms_ = fingerprints.weighted_terms(rows.select(F.lit(0).alias("part"), F.col("id").alias("row"), "text"), {"text": [0]}, 1)
    got = {r.row: r.s0 for r in fingerprints.sampled(terms_, 1, samples=2048).collect()}
    errors = []
    for i in range(30):
        for j in range(i):
            true, seen = jaccard(bag(texts[i]), bag(texts[j])), np.mean(np.array(got[i]) == np.array(got[j]))
            errors.append((seen - true) / math.sqrt(max(true * (1 - true), 1e-3) / 2048))
    assert abs(np.mean(errors)) < 0.5 and np.max(np.abs(errors)) < 5 and np.std(errors) < 1.5


def test_fingerprints_of_rows(spark):
    rows = spark.createDataFrame([(d, t, "old") for d, t in ODD], "doc_id long, text string, fingerprint string").withColumn("_key", F.lit(1))
    got = fingerprints.fingerprints(rows)
    assert sorted(got.columns) == ["_key", "doc_id", "fingerprint", "text"] and got.count() == len(ODD)
    by = defaultdict(set)
    for r in got.collect():
        by[r.text or ""].add(r.fingerprint)
    assert all(len(x) == 1 for x in by.values()) and by[""] == {""} and len(next(iter(by["pie"]))) == 4 * fingerprints.SAMPLES
    same = fingerprints.with_edits(rows).select("doc_id", "fingerprint").collect()
    assert {r.fingerprint for r in same if r.doc_id == 4} == by["pie"]


def test_native_plan_shuffles_texts_once(spark, tmp_path):
    plan = fingerprints.with_edits(spark.range(50).selectExpr("id AS doc_id", "repeat('a b ', 5) AS text"), parts=3)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
