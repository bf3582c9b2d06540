"""The training-data operators against brute force and on odd inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import exact_dedup, licenses, line_dedup, mixing, near_dedup, ogg, packing, pii, quality, sharding
from quillspark.llm import queries as registered
from quillspark.llm.common import Scratch
from quillspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string"
LONG = " ".join(f"w{i}" for i in range(40_000))
BASE = [f"tok{i}" for i in range(120)]
ROWS = [
    (1, "Hello  world\tagain", "en", "a", 1, 0, "x"),
    (2, "Hello world again", "en", "b", 1, 0, "x"),
    (2, "Hello world again", "en", "b", 1, 0, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", 0, 0, "x"),
    (5, LONG, "en", "c", 1, 0, "x"),
    (6, " ".join(BASE), "en", "c", 1, 0, "x"),
    (7, " ".join(BASE[:118] + ["other", "end"]), "en", "c", 1, 0, "x"),
    (8, "mail me at joe.b@mail.example.com or +1 (434) 555-2368 from 10.0.0.1", "en", "a", 1, 0, "x"),
    (None, "no id", "en", "a", 1, 0, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert [(r.doc_id, r.keep_id, r.group_size) for r in got if r.kept and r.keep_id == 1] == [(1, 1, 3)]
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (3, 4)} == {(3, 2)}
    assert sum(r.kept for r in got) == len({re.sub(r"[ \t-\r]+", " ", r[1] or "") for r in ROWS})
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_index_reruns_and_names(spark, docs):
    """A batch that is ingested again, as after a lost job, decides alike; indexes whose folders share a last name are two."""
    root = Scratch(spark, "test-index").path
    one, two = exact_dedup.DigestIndex(spark, f"{root}/a/index", 4), exact_dedup.DigestIndex(spark, f"{root}/b/index", 4)
    plain = lambda df: sorted((r.doc_id, r.keep_id, r.kept, r.text_sha256) for r in df.filter("doc_id IS NOT NULL").collect())
    first = plain(one.ingest(docs, batch="x"))
    assert plain(one.ingest(docs, batch="x")) == first and any(r[2] for r in first)
    assert one.table().count() == len({r[3] for r in first} | {"no id"})
    assert plain(two.ingest(docs, batch="x")) == first
    later = plain(one.ingest(docs, batch="y"))
    assert not any(r[2] for r in later)
    assert plain(one.ingest(docs, batch="x")) == first and plain(one.ingest(docs, batch="y")) == later
    assert one.compacted(f"{root}/c").table().count() == one.table().count()


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_dedup_in_batches(spark, docs, none, batches):
    got = sorted(map(str, exact_dedup.exact_duplicates(docs, batches=batches).drop("row").collect()))
    assert got == sorted(map(str, exact_dedup.exact_duplicates(docs).drop("row").collect()))
    assert exact_dedup.exact_duplicates(none, batches=batches).count() == 0


def test_index_persists(spark, docs):
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "test-index").path, 4)
    first = index.ingest(docs.filter("doc_id <= 4"))
    assert first.filter("kept").count() == 2
    again = index.ingest(docs.filter("doc_id = 2 OR doc_id = 6")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in again} == {(2, 1, False), (6, 6, True)}


def test_mixing(docs, none):
    got = {(r.doc_id, r.size): r for r in mixing.plan_mix(docs).collect()}
    assert got[(3, 0)].copies == 0 and got[(1, 3)].size == 3
    assert all(r.target <= 3 * r.source_size and r.copies <= 3 for r in got.values())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan_mix(none).count() == 0


def test_sharding(spark, docs, none):
    got = sharding.shuffle_into_shards(docs, shards=4, rows_per_bin=2).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert sorted(len(s) for s in slots.values()) == [2, 2, 3, 3]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shuffle_into_shards(none).count() == 0
    counts, sizes = np.array([5, 0, 9, 4]), np.array([7, 7, 4])
    rows = sharding.Rows(counts, sizes, 3)
    m = np.array([rows.row(i) for i in range(4)])
    assert m.sum(1).tolist() == counts.tolist() and m.sum(0).tolist() == sizes.tolist()
    assert all((sharding.Rows(counts, sizes, 3).row(i) == m[i]).all() for i in (2, 0, 3, 1))


def test_sharding_draws_are_hypergeometric():
    """The share of a unit's rows in a bin, over many seeds, against the exact probabilities by chi-square."""
    from math import comb

    seen = np.zeros(6)
    for seed in range(4000):
        seen[min(5, sharding.Rows(np.array([5, 7, 8]), np.array([8, 12]), seed).row(1)[0])] += 1
    want = np.array([comb(7, k) * comb(13, 8 - k) for k in range(8)]) / comb(20, 8)
    want = np.concatenate([want[:5], [want[5:].sum()]])
    assert (np.square(seen - 4000 * want) / (4000 * want)).sum() < 20.5


def test_sharding_does_not_depend_on_splits(spark, docs):
    """Other splits of the files deal every row alike; small units, and columns with internal-looking names."""
    staged = Scratch(spark, "split").table(docs.withColumn("_bin", F.lit(1)).withColumn("__at", F.lit("x")).repartition(3), "rows")
    key = lambda df: sorted(str(r) for r in df.collect())
    first = key(sharding.shuffle_into_shards(staged, shards=3, rows_per_bin=2, staged=True, per_unit=2))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert key(sharding.shuffle_into_shards(staged, shards=3, rows_per_bin=2, staged=True, per_unit=2)) == first and len(first) == len(ROWS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_sharding_is_uniform(spark):
    rows = spark.range(4000, numPartitions=4)
    got = sharding.shuffle_into_shards(rows, shards=8).groupBy("shard").agg(F.avg("id").alias("m"), F.count("*").alias("n")).collect()
    assert all(r.n == 500 and abs(r.m - 2000) < 250 for r in got)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    got = packing.pack(docs, with_ids=True).collect()
    rows = defaultdict(list)
    for r in got:
        rows[(r.doc_id, r.row)].append(r)
    t = Tokenizer.from_file(packing.tokenizer_path())
    texts = {(d[0], d[1] or "") for d in ROWS}
    for (doc, _), pieces in rows.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist()
        assert any(d == doc and t.encode(x, add_special_tokens=False).ids + [1] == ids for d, x in texts)
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(ids) for r in pieces)
    assert len(rows) == len(ROWS)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert sorted(ends.values())[1:] == [2048] * (len(ends) - 1)
    whole = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert all(len(r.ids) == 4 * ends[r.sequence_id] for r in whole)
    assert packing.pack(none).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[a, b, c] for a in range(4) for b in range(4) for c in range(4)])
    line = cells[np.argsort(packing.hilbert(cells, 2))]
    assert (np.abs(np.diff(line, axis=0)).sum(1) == 1).all()


def test_words_match_tokenizer():
    from tokenizers import Tokenizer

    t, memo = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path(), limit=5)
    odd = ["", " a\x1cb ", "Ünï ΣΑΣ İx H̱e <|endoftext|> <|ENDOFTEXT|>", "don't I'LL 'sa", "日本 123 a1 ¿qué? µ½…", "A" * 3000, "ß÷× don't. x,y;"]
    for x, got in zip(odd, packing.ids_of(odd, memo), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(docs, none):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    assert got[7].class_id == 6 and got[6].n_links == 1 and got[4].class_id == 3 and got[3].n_links == 0
    assert got[5].class_id == 5 and None not in got
    assert near_dedup.near_duplicates(none).count() == 0


def test_jaccard_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = []
    for _ in range(12):
        base = [f"v{x}" for x in rng.integers(0, 500, 90)]
        for _ in range(9):
            copy = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 7)):
                copy[at] = f"n{rng.integers(0, 9999)}"
            texts.append(" ".join(copy))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, links = near_dedup.jaccard_join(rows)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    sets = {i: shingle_set(t) for t, i in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in links.collect()} == want and want


def test_texts_of_one_id_keep_their_links(spark):
    a, b = " ".join(BASE), " ".join(reversed(BASE))
    rows = [(1, a), (1, b), (1, b), (2, a + " end"), (3, b + " end")]
    _, links = near_dedup.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.a, r.b) for r in links.collect()) == [(1, 2), (1, 3)]


def test_pruning_table():
    fewest = near_dedup.fewest_matches()
    assert all(0.5 * n < m < 0.8 * n for n, m in fewest.items())


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (100, 102), (7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_line_dedup(spark, none):
    line = "a long line about many things that repeats in several documents of this corpus"
    rows = spark.createDataFrame([(1, line + "\n\nalone"), (2, line + "!\nalone"), (3, None), (2, line + "!\nalone")], "doc_id long, text string")
    got = line_dedup.line_classes(rows).collect()
    kept = sorted((r.doc_id, r.line_no) for r in got if r.kept)
    assert kept == [(1, 0), (1, 1), (1, 2), (3, 0)] and len(got) == 8
    assert [r.text for r in line_dedup.dedup_lines(rows).orderBy("doc_id").collect()][0] == line + "\n\nalone"
    assert line_dedup.line_classes(none).count() == 0


def line_shingles(line):
    return {line[i : i + 5] for i in range(max(len(line) - 4, 1))}


def plain_classes(lines):
    """The first line of each line's class, by comparing all with all."""
    sets, up = [line_shingles(x) for x in lines], list(range(len(lines)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in range(len(lines))}


@pytest.mark.parametrize("block", [2048, 16])
def test_line_classes_equal_brute_force(spark, monkeypatch, block):
    """Random lines with edits, and a template whose fillings fall into large buckets; also with buckets cut into small blocks."""
    if block < 100:
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        monkeypatch.setattr(line_dedup, "COUNTED", 1)
    r = random.Random(3)
    words = ["".join(r.choices("abcdefghij\u00e9\u4e2d\U0001f600", k=r.randint(2, 8))) for _ in range(60)]
    lines = [" ".join(r.choices(words, k=r.randint(1, 30))) for _ in range(120)] + ["x", "xy", "abcd", "abcde", "\u4e2d" * 3000]
    for x in lines[:80]:
        at = r.randrange(len(x))
        lines.append(x[:at] + r.choice("qz") * r.randint(1, 3) + x[at + r.randint(0, 2) :])
    template = " ".join(r.choices(words, k=12))
    lines += [template + " " + " ".join(r.choices(words, k=r.randint(1, 8))) for _ in range(120)]
    unique = list(dict.fromkeys(lines))
    want = plain_classes(unique)
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(unique)], "doc_id long, text string")
    got = {x.doc_id: x.class_doc_id for x in line_dedup.line_classes(rows).collect()}
    wrong = [i for i in want if want[i] != got[i]]
    assert len(set(want.values())) < len(want) - 40 and len(wrong) <= 0.01 * len(want)


def test_line_classes_at_the_threshold(spark):
    """Short lines, lines that repeat themselves or a few signs or words, and lines with an edit in 46 to 50 characters."""
    r = random.Random(11)
    lines = ["=" * k for k in (5, 9, 40, 300, 301)] + ["ab" * k for k in (4, 20, 200)] + ["".join(r.choices("01", k=k)) for k in (60, 200, 200, 600)]
    for n in range(4, 40):
        short = "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n))
        lines += [short, short + "~", short + "~~"]
    few = ["".join(r.choices("abcdefghijkl", k=5)) for _ in range(10)]
    lines += [" ".join(r.choices(few, k=k)) for k in (400, 600, 900)]
    for _ in range(200):
        line = "".join(r.choices("abcdefghijklmnop ", k=r.randint(48, 700))).strip()
        edits, other = len(line) // 48, list(line)
        for k in range(edits):
            other[int((k + 0.5) * len(line) / edits)] = r.choice("QZXY")
        lines += [line, "".join(other)]
    unique = list(dict.fromkeys(lines))
    want = plain_classes(unique)
    rows = spark.createDataFrame(list(enumerate(unique)), "doc_id long, text string")
    assert {x.doc_id: x.class_doc_id for x in line_dedup.line_classes(rows).collect()} == want


def test_line_classes_recall_on_tables(spark):
    """Against brute force over all pairs of lines that share a rare shingle, on the whole smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lines = sorted({x.strip(" \t\r\x0b\x0c") for r in docs.select("text").collect() for x in (r.text or "").split("\n")} - {""})
    want = plain_classes(lines)
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x.doc_id: x.class_doc_id for x in line_dedup.line_classes(rows).collect()}
    linked = [i for i in want if list(want.values()).count(want[i]) > 1] if len(want) < 5000 else []
    assert sum(want[i] == got[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] >= want[i] for i in want)


def test_line_pairs_by_fine_sketches(spark):
    """Long lines of one vocabulary, which 512 parity bits cannot tell apart, are no candidates; linked ones are, also when one is below LONG."""
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(900)]
    lines = [" ".join(r.choices(words, k=600)) for _ in range(6)]
    lines += [x[:1500] + "Q" + x[1501:] for x in lines] + [lines[0][:990], lines[0][:1010]]
    table = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "id long, line string, n_chars int")
    marks = Scratch(spark, "t").table(line_dedup.sketches(table, table.select("id")), "marks")
    pairs = spark.createDataFrame([(i, j) for j in range(14) for i in range(j)], "a long, b long")
    pairs = pairs.join(marks.toDF("a", "u"), "a").join(marks.toDF("b", "v"), "b")
    got = {(x.a, x.b) for x in line_dedup.finely_close(pairs.filter(line_dedup.may_be_close("u", "v"))).collect()}
    assert got == {(i, i + 6) for i in range(6)} | {(12, 13)}


def test_line_keys_of_one_vocabulary(spark):
    """Long lines of one small vocabulary, of which no two are linked, seldom share a key; an edited copy shares several."""
    r = random.Random(5)
    parts = ["the", "er", "ing", "an", "tion", "re", "on", "th", "ed", "ent", "or", "at", "is", "es", "en", "ou"]
    lines = [" ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(200)) for _ in range(1000)]
    lines += ["Z".join(x[i : i + 60] for i in range(0, len(x), 60)) for x in lines[:50]]
    table = line_dedup.probed(spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(lines)], "id long, line string, n_chars int"))
    keys = line_dedup.candidates(table.filter("NOT again AND n_chars < 2000").withColumn("n_chars", F.least("n_chars", F.lit(999)))).distinct()
    met = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("a", "b").distinct().collect()
    other = [x for x in met if x.b != x.a + 1000]
    assert len(met) - len(other) >= 40 and len(other) <= 20


def test_line_dedup_odd_inputs(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = spark.createDataFrame([(None, "a\n\nlonger line here"), (5, "a"), (5, "a"), (6, long), (7, long + "!")], "doc_id long, text string")
    got = line_dedup.line_classes(rows).collect()
    assert sorted((r.doc_id or 0, r.line_no) for r in got if r.kept) == [(0, 1), (0, 2), (5, 0), (6, 0)] and len(got) == 7
    wide = rows.withColumn("line_no", F.lit(1)).withColumn("best", F.lit("x"))
    assert line_dedup.dedup_lines(wide).columns == wide.columns and line_dedup.dedup_lines(wide).count() == 5
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(rows.withColumn("__row", F.lit(1)))


def test_base_spans_equal_patterns():
    import random

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def plain(text):
        out = []
        for kind, p in patterns.items():
            digits = lambda m: re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m: True,
                "ip": lambda m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda m: 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m)),
                "phone": lambda m: 8 <= len(digits(m)) <= 15,
            }[kind]
            out.append([m.span() for m in re.finditer(p, text) if good(m)])
        return out

    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice("12345. @a+-()") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == plain(text)
    assert pii.base_spans("4111 1111-1111 1111")[2] == [(0, 19)]


def enumerated(nodes, model):
    """Label marginals by summing over all labellings."""
    import itertools

    chain, skip = pii.edges_of([nodes])
    own = model.unary[np.array([t.features for t in nodes])].sum(1)
    total = np.zeros((len(nodes), pii.LABELS))
    for y in itertools.product(range(pii.LABELS), repeat=len(nodes)):
        if any(t.label > 0 and t.label != k for t, k in zip(nodes, y)):
            continue
        score = sum(own[i, k] for i, k in enumerate(y) if nodes[i].label <= 0)
        score += sum(model.chain[y[a], y[b]] for a, b in chain) + sum(model.skip[y[a], y[b]] for a, b in skip)
        for i, k in enumerate(y):
            total[i, k] += np.exp(score)
    return total / total.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(8)
    model = pii.Field(0.3 * rng.standard_normal((pii.HASHED, pii.LABELS)), 0.3 * rng.standard_normal((pii.LABELS, pii.LABELS)), 0.5 * np.eye(pii.LABELS))
    trees = ["a1 22333 b4", "55566677 x 55566677 y 99", "mail a@b.cd then 77777 1 and 77777 2"]
    for text in trees:
        nodes = pii.tokens(text, pii.base_spans(text))
        assert 2 <= len(nodes) <= 6
        assert np.abs(pii.marginals([nodes], model) - enumerated(nodes, model)).max() < 2e-3
    loop = "11111 22222 x 11111 22222"
    nodes = pii.tokens(loop, pii.base_spans(loop))
    assert np.abs(pii.marginals([nodes], model) - enumerated(nodes, model)).max() < 0.05


def test_field_adds_what_patterns_lose(spark):
    """Phone numbers that run into another number are lost to the pattern; the field, fitted on the tables, finds them and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii.train(docs)
    rng, texts, want = random.Random(9), [], []
    for i in range(200):
        phone = f"+1 ({rng.randrange(100, 1000)}) 555-{rng.randrange(1000, 10000)}"
        texts.append(f"on the {phone} {rng.randrange(10, 99)}.{rng.randrange(99)}.17.4 and")
        want.append(f"phone:7:{7 + len(phone)}")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pii.find(rows, model).orderBy("doc_id").collect()
    hits = sum(w in r.spans.split(",") for w, r in zip(want, got, strict=True))
    assert all(r.n_phone == 0 for r in got) and hits >= 190 and sum(r.n_added for r in got) <= hits + 10
    found = pii.find(docs, model).agg(F.sum("n_added").alias("n"), F.count_if(F.col("n_added") > 0).alias("docs")).first()
    assert 0 < found.n and found.docs < 0.02 * docs.count()
    one = pii.op2_pii(spark, "/root/testdata/sf0.001").first()
    assert len(one.base_sha256) == 64


def test_skip_edges_carry_labels(spark, docs, none):
    text = "call +14345552368 now. later the number 1-434-555-2368 came up again"
    model = pii.Field(np.zeros((pii.HASHED, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), 8 * np.eye(pii.LABELS))
    base = pii.base_spans(text)
    got = pii.added([pii.tokens(text, base)], model)[0]
    assert [text[s:e] for s, e in got[3]] == ["1-434-555-2368"]
    fitted = pii.train(docs)
    rows = {r.doc_id: r for r in pii.find(docs, fitted).collect()}
    assert (rows[8].n_email, rows[8].n_ip, rows[8].n_phone) == (1, 1, 1) and rows[3].spans == ""
    long = "a@x.com;" * 40 + "key=" + "0c497b5014f705c0be648d68b816f88c209136eb"
    assert len(pii.tokens(long, pii.base_spans(long))) == 41
    assert pii.find(spark.createDataFrame([(1, long)], "doc_id long, text string"), fitted).first().n_secret == 1
    assert "[email]" in pii.redact(docs.filter("doc_id = 8"), fitted).first().text
    assert pii.find(none, pii.train(none)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 254, 255, 256, 4000, 65_024, 65_025, 70_000, 300_000])
def test_ogg_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    payload = ogg.padded(data)
    media = ogg.store(payload)
    back, times, streams = ogg.timed(media)
    assert back == payload and len(streams) == 2 and sum(t[3] - t[2] for t in times) == pytest.approx(len(payload) / ogg.RATE)
    for serial in (1, 2):
        own = [t[2:] for t in times if t[0] == serial]
        assert all(a[1] == b[0] for a, b in zip(own, own[1:])) and (not own or own[0][0] == 0)


def test_page_checksum_is_the_formats():
    """Bit by bit: polynomial 0x04C11DB7, most significant bit first, from 0."""
    data, crc = bytes(range(256)) * 3, 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    assert ogg.page_checksum(data) == crc


def test_any_ogg_column(spark):
    """A stream of another codec, a stream that begins later, spoilt bytes and null: times from granules, errors by row."""
    w, parts = ogg.Writer(77), []
    parts += w.packet(b"\x01vorbis" + bytes(5) + (44_100).to_bytes(4, "little") + bytes(14), 0)
    parts.append(w.flush(ogg.FIRST))
    parts += [*w.packet(b"a" * 300, 44_100), *w.packet(b"b" * 20, 88_200)]
    parts.append(w.flush(ogg.LAST))
    vorbis = b"".join(parts)
    w, parts = ogg.Writer(5), []
    parts += w.packet(ogg.OPENING.pack(ogg.MARK, 1, 1, 0, 100), 0)
    parts.append(w.flush(ogg.FIRST))
    parts += [*w.packet(b"x" * 50, 0), *w.packet(b"y" * 100, 1150)]
    parts.append(w.flush(ogg.LAST))
    late = b"".join(parts)
    rows = spark.createDataFrame([(1, vorbis), (2, late), (3, vorbis[:-1]), (4, None), (5, b"")], "id long, media binary")
    got = {r.id: r for r in ogg.read_media(rows).collect()}
    assert [(p.codec, p.bytes, p.start, p.end) for p in got[1].packets] == [("vorbis", 30, None, None), ("vorbis", 300, None, None), ("vorbis", 20, None, 2.0)]
    assert [(p.start, p.end) for p in got[2].packets] == [(None, None), (10.0, 10.5), (10.5, 11.5)]
    assert got[3].error and got[3].packets is None and got[4].error is None and got[4].packets is None and got[5].packets == []


def test_ogg_spoilt_bytes_are_found():
    media = bytearray(ogg.store(bytes(range(256)) * 40))
    for at in (0, 5, 30, 5000, len(media) - 1):
        bad = bytearray(media)
        bad[at] ^= 1
        with pytest.raises(ogg.OggError):
            ogg.timed(bytes(bad))
    with pytest.raises(ogg.OggError):
        ogg.timed(bytes(media[:-1]))


def test_ogg_column(docs, none):
    rows = {r.doc_id: r for r in ogg.media_column(docs).collect()}
    assert rows[3].n_bytes == 0 and rows[3].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() == rows[4].payload_sha256
    assert rows[2].media_sha256 == hashlib.sha256(rows[2].media).hexdigest()
    assert ogg.media_column(none).count() == 0


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = quality.train(docs, labels.filter(fold))
    assert (np.diff(model.thresholds) > 0).all()
    held = quality.grade(docs, model).join(quality.graded(labels.filter(~fold)), "doc_id")
    r = held.agg(F.avg(F.when(F.col("grade") == 2, F.col("selected").cast("int"))).alias("good"), F.avg(F.when(F.col("grade") < 2, F.col("selected").cast("int"))).alias("bad")).first()
    assert r.good > 0.95 and r.bad < 0.5


def test_quality_odd_inputs(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.grade(docs, model, keep_columns=True).count() == len(ROWS)
    assert quality.grade(none, quality.train(none, labels)).count() == 0


def test_licences(spark, docs, none):
    text = "x y z Licensed under the Apache Licence, Version 2.0. and more\n" + licenses.TEMPLATES["MIT"].replace("free of charge, ", "") + " the end"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "of the license in the work")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(rows).collect()}
    found = {m.template: text[m.start : m.end] for m in got[1].matches}
    assert found["MIT"].startswith("Permission is") and found["MIT"].endswith("of the Software") and "Apache-2.0-line" in found
    assert got[2].n_matches == got[3].n_matches == 0
    assert licenses.scan(none).count() == 0


def plain_matches(template, text, coverage=licenses.COVERAGE):
    """Matches (matched words, first, last + 1) by alignment of all words with all, cell by cell."""
    need, low, out = coverage * len(template), 0, []
    while True:
        cells, best = {}, None
        for j in range(low, len(text)):
            now = {}
            for i, w in enumerate(template):
                s, m, a = cells.get(i - 1, (0, 0, j))
                ways = [(s + 2, m + 1, a) if w == text[j] else (s - 2, m, a)]
                ways += [(c[0] - 2, *c[1:]) for c in (cells.get(i), now.get(i - 1)) if c]
                if max(ways)[0] > 0:
                    now[i] = max(ways)
            cells = now
            good = max((c for c in cells.values() if c[1] >= need), default=None)
            if good and (best is None or good[0] > best[0]):
                best = (*good, j + 1)
            if best and not any(a < best[3] and s + 2 * (len(template) - 1 - i) > best[0] for i, (s, _, a) in cells.items()):
                break
        if best is None:
            return out
        out.append(best[1:])
        low = best[3]


def found_matches(templates, text, **named):
    words, posts = licenses.index(templates)
    got = licenses.matches(text, licenses.prepared(words, **named), posts, np.array(sorted(posts), np.uint64), licenses.Hashes())
    return [(m[0], round(m[1] * len(words[m[0]])), m[2], m[3]) for m in got]


def spelled_matches(templates, text):
    at = [m.span() for m in licenses.WORD.finditer(text)]
    low = [w.lower() for w in licenses.WORD.findall(text)]
    want = [(k, m, at[a][0], at[b - 1][1]) for k, t in templates.items() for m, a, b in plain_matches([w.lower() for w in licenses.WORD.findall(t)], low)]
    return sorted(want, key=lambda x: (x[2], x[3], x[0]))


def test_licences_with_phrases_left_out_or_put_in():
    gpl, mit, bsd = (licenses.TEMPLATES[k] for k in ("GPL-notice", "MIT", "BSD"))
    short = gpl.replace("either version 3 of the License, or (at your option) any later version.", "version 3 of the License.")
    (got,) = [m for m in found_matches(licenses.TEMPLATES, "x y " + short + " z") if m[0] == "GPL-notice"]
    assert got[1] == 72
    long = mit.replace("without restriction,", "without restriction of any kind that the holder of rights could name here,")
    assert [m[1] for m in found_matches({"MIT": mit}, "a b " + long)] == [len(licenses.WORD.findall(mit))]
    rng = random.Random(5)
    for _ in range(30):
        words = ["this", "text", "the", "of"] * rng.randrange(3)
        for t in rng.choices([gpl, mit, bsd], k=2):
            own = licenses.WORD.findall(t)
            for _ in range(rng.randrange(4)):
                at, n = rng.randrange(len(own)), rng.randrange(12)
                own[at : at + n * rng.randrange(2)] = [rng.choice(["the", "of", "new", "and"]) for _ in range(n * rng.randrange(2))]
            words += own
        text, some = " ".join(words), {"GPL": gpl, "MIT": mit, "BSD": bsd}
        assert found_matches(some, text) == spelled_matches(some, text)


def test_licence_lines_are_counted_each(spark):
    names = ("Rights", "SPDX-MIT", "MIT-line", "SPDX-Apache-2.0")
    for name in names:
        for between in ("\n", " x ", " Copyright 2021 B. "):
            for n in (1, 2, 5, 40):
                text = between.join([licenses.TEMPLATES[name]] * n)
                own = {name: licenses.TEMPLATES[name]}
                got = found_matches(own, text, named=licenses.NAMED)
                assert len(got) == n and [text[m[2] : m[3]] for m in got] == [licenses.TEMPLATES[name].rstrip(".")] * n
    text = "Copyright 2020 A. All rights reserved. Copyright 2021 B. All rights reserved."
    others = ["SPDX-License-Identifier: X", "SPDX-License-Identifier: GPL-2.0", "Released under the BSD License.", "Licensed under CC BY 4.0."]
    rows = spark.createDataFrame(list(enumerate([text, *others])), "doc_id long, text string")
    assert [r.n_matches for r in licenses.scan(rows).orderBy("doc_id").collect()] == [2, 0, 0, 0, 0]
    short = {k: licenses.TEMPLATES[k] for k in names}
    rng = random.Random(6)
    for _ in range(60):
        pool = [w for t in short.values() for w in [t] * 3 + licenses.WORD.findall(t)] + ["x"]
        text = " ".join(rng.choices(pool, k=12))
        want = [m for m in spelled_matches(short, text)]
        seen = found_matches(short, text)
        assert all(m in want for m in seen) and [m for m in want if m not in seen and m[1] > 3] == []


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "test-pipeline")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = scratch.table(stage(spark, docs, sf), name)
        if name == "exact_dedup":
            texts = [re.sub(r"[ \t-\r]+", " ", r.text or "") for r in before.collect()]
            assert docs.count() == len(set(texts))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.count() > 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_dedup_stages_decide_by_row(spark):
    near, far = " ".join(BASE), " ".join(reversed(BASE))
    rows = [
        (None, "only text without id"),
        (1, "same"), (1, "same"), (None, "same"), (2, " same "), (2, "stays"),
        (3, near), (3, near), (4, near + " end"), (4, far), (None, near + " last"), (None, far + " last"), (None, far + " last"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    exact = corpus_pipeline.drop_exact(spark, docs, "")
    plain = lambda t: re.sub(r"[ \t-\r]+", " ", t)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = {plain(t): (i, t) for i, t in reversed(order)}
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, exact.collect()), key=key) == sorted(want.values(), key=key)
    left = corpus_pipeline.drop_near(spark, docs, "").collect()
    want = [(1, "same"), (2, " same "), (2, "stays"), (3, near), (4, far), (None, "only text without id")]
    # white space is no part of a shingle: the two spellings of one word are near copies
    want.remove((2, " same "))
    assert sorted(map(tuple, left), key=key) == sorted(want, key=key)
    assert near_dedup.near_rows(docs).count() == len(rows)


def test_registry():
    names = registered.queries()
    assert {re.match(r"op(\d+)_", n)[1] for n in names} == {str(i) for i in range(1, 11)}
    assert set(registered.oracle_sql()) <= set(names)
