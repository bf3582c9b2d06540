"""Every registered opN query over the smallest tables: its columns and what its contract lets be worked out plainly."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import licenses, mixing, packing
from quillspark.llm import queries as registered

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id", 2: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 3: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature", 4: "doc_id",
    5: "doc_id size source_size target taken", 6: "doc_id size text_crc32 law shard slot grown_shard", 7: "doc_id", 8: "doc_id keep_id group_size kept text_sha256", 9: "doc_id n_matches spans",
    10: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 11: "item_id rank doc_id score", 12: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    13: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
}


@pytest.fixture(scope="module")
def texts():
    return {d: t or "" for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


def rows(spark, n):
    name = next(x for x in registered.queries() if x.startswith(f"op{n}_"))
    df = registered.queries()[name](spark, SF)
    assert set(COLUMNS[n].split()) <= set(df.columns)
    return df.collect()


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 8, 9, 12, 13])
def test_one_row_a_document(spark, texts, n):
    got = rows(spark, n)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    if n == 3:
        for r in got:
            raw = texts[r.doc_id].encode()
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    if n == 6:
        slots = defaultdict(list)
        for r in got:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
            slots[r.shard].append(r.slot)
        sizes = [len(slots[s]) for s in range(8)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    if n == 12:
        assert all((r.n_a > 0) == bool(r.groups_sha256) and r.n_best <= r.n_links <= r.count_sum for r in got)
    if n == 13:
        order, near = sorted(texts), []
        for r in got:
            t, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
            half = len(t) // 2
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())
            near.append((r.near_edited, r.near_next, t == after))
        assert np.mean([a > b for a, b, same in near if not same]) > 0.9 and all(b == 1 for _, b, same in near if same)


@pytest.mark.parametrize("n", [5, 8, 11])
def test_equals_sql(spark, n):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    name = next(x for x in registered.queries() if x.startswith(f"op{n}_"))
    df, want = registered.queries()[name](spark, SF), con.sql(registered.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.project(", ".join(f'"{c}"' for c in names)).fetchall(), key=repr)


def test_packing_contract(spark, texts):
    from tokenizers import Tokenizer

    got, by, room = rows(spark, 10), defaultdict(list), defaultdict(list)
    tok = Tokenizer.from_file(packing.tokenizer_path())
    for r in got:
        by[r.doc_id].append(r)
        room[r.sequence_id].append(r)
    for d, pieces in by.items():
        ids = np.array([*tok.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert set(by) == set(texts)
    for pieces in room.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


@pytest.mark.parametrize("n", [1, 7])
def test_other_operators_run(spark, n):
    assert rows(spark, n)


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b", f"s{i % 2}", i, i, i) for i in range(40)], "doc_id long, text string, source string, __copy int, __size int, c0 int")
    got = mixing.mix(docs)
    assert got.columns == docs.columns and all(r.doc_id == r["__copy"] == r["__size"] == r.c0 for r in got.collect())
    copies = Counter(r.doc_id for r in got.collect())
    assert copies == Counter({r.doc_id: r.copies for r in mixing.plan_mix(docs).collect() if r.copies})
    assert corpus_pipeline.mix(spark, docs.limit(0), "").collect() == []


def test_no_templates_no_matches(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    docs = spark.createDataFrame([(1, "MIT License text"), (2, None)], "doc_id long, text string").withColumn("n_matches", F.lit(9))
    assert [(r.doc_id, r.n_matches) for r in licenses.scan(docs, {}).orderBy("doc_id").collect()] == [(1, 0), (2, 0)]
