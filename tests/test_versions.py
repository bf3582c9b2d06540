"""Tables replaced in place, and state between batches of a stream."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.plans import history, index
from quillspark.sources.versions import Versions
from quillspark.streaming import state
from tests.test_plans import frame


def test_versions_are_swapped_at_once(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "k string, n long")
    assert table.read().collect() == [] and table.newest() == (0, None)
    assert table.replace(spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long")) == 1
    open_ = table.read()
    assert table.replace(open_.filter("k = 'a'").withColumn("n", F.col("n") + 10)) == 2  # read from the table it replaces
    assert [tuple(r) for r in table.read().collect()] == [("a", 11)]
    assert sorted(tuple(r) for r in open_.collect()) == [("a", 1), ("b", 2)]  # a reader opened before
    with pytest.raises(Exception, match="spoilt"):
        table.replace(table.read().withColumn("n", F.raise_error(F.lit("spoilt")).cast("long")))
    assert [tuple(r) for r in table.read().collect()] == [("a", 11)] and table.newest()[0] == 2
    assert sorted(tuple(r) for r in table.read(1).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(LookupError):
        table.read(7)
    assert len(table.forget(1)) == 2  # the first version and what the failed write left
    assert [tuple(r) for r in table.read().collect()] == [("a", 11)]
    assert Versions(spark, str(tmp_path / "t"), "k string, other long").read().collect() == []
    with pytest.raises(ValueError):
        table.forget(0)


def test_index_is_kept_up_in_place(spark, tmp_path):
    path, made = str(tmp_path / "index"), []

    def embed(rows):
        made.append(rows.count())
        return index.hashed_vectors(rows)

    df = frame(spark, {"a.txt": "one", "b.txt": "two", "c.txt": "three"})
    assert tuple(index.kept_up(spark, path, df, embed, "m").first()) == (3, 0, 0, 0)
    before = index.load(spark, path)
    later = frame(spark, {"a.txt": "one", "b.txt": "2", "d.txt": "four"})
    assert tuple(index.kept_up(spark, path, later, embed, "m").first()) == (1, 1, 1, 1) and made == [3, 2]
    assert {r.path for r in index.load(spark, path).collect()} == {"a.txt", "b.txt", "d.txt"} and {r.path for r in before.collect()} == {"a.txt", "b.txt", "c.txt"}
    assert tuple(index.kept_up(spark, path, later, embed, "m").first()) == (0, 0, 0, 3) and made == [3, 2]
    assert tuple(index.kept_up(spark, path, later, embed, "other").first()) == (3, 0, 0, 0) and made == [3, 2, 3]
    assert {r.model for r in index.load(spark, path).collect()} == {"other"}


def test_checkpoints_are_deleted_in_place(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "marks"), history.SCHEMA)
    rows = [(t, "a.rs", "f", "x", 1, 1, i, "n") for i, t in enumerate(("v1", "v2", "v2"))]
    table.replace(spark.createDataFrame(rows, history.SCHEMA))
    assert history.delete(table, tag="v1") == 1 and history.delete(table, tag="v1") == 0 and table.newest()[0] == 2
    assert history.delete(table, namespace="n") == 2 and table.read().collect() == []


def test_state_between_batches(spark, tmp_path):
    """Changed, deleted, late and expired entries; each file is a batch, and every run goes on from the state of the one before."""
    state.use_state(spark)
    schema, got, n = "path string, version string, seen timestamp, gone boolean", [], iter(range(99))

    def run(*rows):
        text = "".join(json.dumps({"path": p, "version": v, "seen": f"2024-01-0{d} {h:02}:00:00", "gone": g}) + "\n" for p, v, d, h, g in rows)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{next(n)}.json").write_text(text)
        got.clear()
        stream = state.newest_versions(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        each = lambda batch, _: got.extend((r.path, r.version, r.before, r.status) for r in batch.collect())
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(got)

    assert run(("a", "1", 1, 1, False), ("b", "1", 1, 1, False), ("c", "1", 1, 1, False), ("c", "2", 1, 2, False), (None, "1", 1, 1, False)) == [("a", "1", None, "new"), ("b", "1", None, "new"), ("c", "2", None, "new")]
    assert run(("a", "2", 1, 5, False), ("b", None, 1, 5, True), ("c", "2", 1, 9, False), ("x", None, 1, 6, True)) == [("a", "2", "1", "changed"), ("b", "1", "1", "deleted")]
    assert run(("a", "0", 1, 3, False), ("c", "3", 2, 8, False)) == [("a", "2", "2", "expired"), ("c", "3", "2", "changed")]
    assert run(("a", "2", 2, 9, False), ("b", "1", 2, 9, False)) == [("a", "2", None, "new"), ("b", "1", None, "new")]
