"""N-gram Jaccard join of whole texts with Bayesian candidate pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, text_of
from .components import components

#: Words of a shingle and the least similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Bands of ROWS MinHash values; at the threshold a pair meets in no band with probability (1 - 0.8 ** 4) ** 32, about 5e-8.
BANDS, ROWS = 32, 4
#: A pair is dropped after so many values if the probability that it reaches the threshold falls below the tolerance.
LOOKS, TOLERANCE = (32, 64, 96, 128), 1e-4
#: Rows of a cell; a task compares two cells at a time.
BLOCK = 512
HASHES = BANDS * ROWS

ODD = np.random.default_rng(11).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = np.random.default_rng(12).integers(0, 2**63, HASHES, dtype=np.uint64)


class WordNumbers(dict):
    """64-bit number of a word; emptied at a size, which bounds memory only."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


def shingles(text: str, memo: WordNumbers, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of every k words in a row; of all words where there are fewer; none without words."""
    words = np.array(list(map(memo.__getitem__, text.split())), np.uint64)
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i : len(words) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    """HASHES MinHash values of 16 bits: the low bits of the smallest of odd * x + add, by its high bits."""
    least = np.empty(HASHES, np.uint64)
    step = max(1, 200_000 // max(len(found), 1))
    for i in range(0, HASHES, step):
        least[i : i + step] = (found[None, :] * ODD[i : i + step, None] + ADD[i : i + step, None]).min(1)
    mixed = (least ^ (least >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(48)).astype(np.uint16)


def fewest_matches(looks: tuple[int, ...] = LOOKS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each count of values compared, the fewest matches that keep a pair.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1);
    it reaches the threshold with the probability that n + 1 draws at the
    threshold succeed m times at most.
    """

    def reaches(m: int, n: int) -> float:
        return sum(math.comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))

    return {n: next(m for m in range(n + 1) if reaches(m, n) >= tolerance) for n in looks}


def sign(docs: DataFrame) -> DataFrame:
    """row, doc_id, text, digest (16 bytes) of the text and sig (MinHash values as bytes; null where the text has no words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo = WordNumbers()
        for b in batches:
            digests, sigs = [], []
            for t in b.column("text").to_pylist():
                digests.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                found = shingles(t, memo)
                sigs.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=[*b.schema.names, "digest", "sig"])

    return docs.select("row", "doc_id", text_of().alias("text")).mapInArrow(run, "row long, doc_id long, text string, digest binary, sig binary")


def survivors(cross: np.ndarray, side: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the pairs of one tile that share a band and survive the looks; where cross, of different sides only."""
    fewest, keys = fewest_matches(), sig.view(np.uint64)
    left, right = [np.array([], np.int64)], [np.array([], np.int64)]
    for i in range(len(sig) - 1):
        j = np.arange(i + 1, len(sig))
        if cross[i]:
            j = j[side[j] != side[i]]
        j = j[(keys[j] == keys[i]).any(1)]
        done, matched = 0, np.zeros(len(j), np.int64)
        for n in LOOKS:
            if len(j):
                matched += (sig[j, done:n] == sig[i, done:n]).sum(1)
                kept = matched >= fewest[n]
                j, matched, done = j[kept], matched[kept], n
        if len(j):
            left.append(np.full(len(j), i))
            right.append(j)
    return np.concatenate(left), np.concatenate(right)


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tile together; rows come sorted by tile."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        t = b.column("tile").to_numpy()
        starts = np.flatnonzero(np.diff(t, prepend=t[0] - 1 if len(t) else 0))
        for at, to in zip(starts, [*starts[1:], len(t)], strict=True):
            if held and held[-1].column("tile")[0].as_py() != t[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def columns_of(tile: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sig = np.frombuffer(b"".join(tile.column("sig").to_pylist()), np.uint16).reshape(tile.num_rows, HASHES)
    return tile.column("id").to_numpy(), tile.column("cross").to_numpy().astype(bool), tile.column("side").to_numpy(), sig


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (tile, id) that have a surviving pair in their tile: at most one for each row read."""
    out: list[tuple[int, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        ids = np.concatenate([np.array([], np.int64), *(x for _, x in out)])
        where = np.repeat(np.array([t for t, _ in out], np.int64), [len(x) for _, x in out])
        return pa.RecordBatch.from_arrays([pa.array(where), pa.array(ids)], names=["tile", "id"])

    for tile in tiles(batches):
        ids, cross, side, sig = columns_of(tile)
        i, j = survivors(cross, side, sig)
        if len(i):
            out.append((tile.column("tile")[0].as_py(), ids[np.union1d(i, j)]))
        if len(out) >= 1000:
            yield made()
            out = []
    yield made()


def linked(tile: pa.Table, memo: WordNumbers) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """A tile's ids and its links (i, j, jaccard): the surviving pairs whose exact similarity reaches the threshold."""
    ids, cross, side, sig = columns_of(tile)
    left, right = survivors(cross, side, sig)
    sets, out = [shingles(t, memo) for t in tile.column("text").to_pylist()], []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
            continue
        both = np.concatenate([x, y])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        if shared >= THRESHOLD * (len(both) - shared):
            out.append((i, j, shared / (len(both) - shared)))
    return ids, out


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, jaccard), a < b, of every tile."""
    memo = WordNumbers()
    for tile in tiles(batches):
        ids, links = linked(tile, memo)
        a, b = (np.array([ids[x[k]] for x in links], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array([x[2] for x in links], pa.float64())], names=["a", "b", "jaccard"])


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each linked row of every tile once: a, b (the smallest row that the tile's links join it to) and n, its links in the tile."""
    memo = WordNumbers()
    for tile in tiles(batches):
        ids, links = linked(tile, memo)
        up, n = list(range(len(ids))), np.zeros(len(ids), np.int64)

        def root(i: int, up: list[int] = up) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        for i, j, _ in links:  # rows are in order of their ids
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
            n[i] += 1
            n[j] += 1
        own = np.flatnonzero(n)
        to = ids[[root(i) for i in own.tolist()]] if len(own) else own
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(to.astype(np.int64)), pa.array(n[own])], names=["a", "b", "n"])


def jaccard_join(docs: DataFrame, scratch: Scratch | None = None, whole: bool = True, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, links) of docs(doc_id, text); unless ``whole``, ``forest`` of the links instead, as many rows as linked texts and tiles.

    Classes are equal texts (null: empty). Their node is the smallest place of
    their rows, or ``row_col`` (a unique long) where docs has one, so that ids
    need not be unique or known; their representative is the row with the
    smallest id (null ids come last), of repeated rows the first. membership:
    row, doc_id, node, rep, rep_row for each row. links: a, b, jaccard for each
    pair of classes whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more; a <= b are the ids of their representatives (equal where
    texts share an id, null where they have none), while the forest names
    nodes. A text of fewer than five words is one shingle; a text without
    words links to none. Empty tables give no rows; other columns are not read.

    Representatives with a common band of MinHash values meet in a bucket. The
    smallest node that a representative meets is its hub; the rows of a hub are
    cut by hash into cells of about BLOCK rows. Two cells with a bucket in
    common are a tile, in which one task compares the pairs that share a band:
    first by signatures, which tells the rows that survive with another, then
    those by their texts. A pair has one tile only, no task gathers a bucket or
    a component, and nothing but links is written by pairs.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near-dedup")
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    signed = scratch.table(sign(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    reps = signed.groupBy("digest").agg(F.min("row").alias("node"), first.alias("first"))
    reps = scratch.table(reps.select("digest", "node", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("rep_row")), "reps")
    members = scratch.table(signed.select("row", "doc_id", "digest").join(reps, "digest").drop("digest"), "members")
    nodes = reps.select(F.col("node").alias("id"))
    unique = signed.select(F.col("row").alias("id"), "sig").filter("sig IS NOT NULL").join(nodes, "id", "left_semi")
    unique = scratch.table(unique, "unique")
    width = 2 * ROWS
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(BANDS)])
    banded = unique.select("id", F.explode(keys).alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")).filter("n > 1").select("key", "low")
    rows = scratch.table(banded.join(buckets, "key").select("key", "id", "low"), "rows")
    hubs = scratch.table(rows.groupBy("id").agg(F.min("low").alias("hub")), "hubs")
    parts = hubs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    cells = hubs.join(parts, "hub").select("id", F.xxhash64("hub", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("cell"))
    rows = scratch.table(rows.select("key", "id").join(cells, "id").select("key", "id", "cell"), "placed")
    others = rows.select("key", F.col("cell").alias("other")).distinct()
    tile = F.xxhash64(F.least("cell", "other"), F.greatest("cell", "other")).alias("tile")
    dealt = rows.join(others, "key").select(tile, "id", F.col("cell").alias("side"), (F.col("cell") != F.col("other")).alias("cross")).distinct()
    dealt = scratch.table(dealt.withColumn("cross", F.col("cross").cast("int")), "dealt")
    scratch.drop("rows", "placed")
    together = lambda df: df.repartition(F.col("tile")).sortWithinPartitions("tile", "id")
    alive = scratch.table(together(dealt.join(unique, "id")).mapInArrow(compare, "tile long, id long"), "alive")
    texts = signed.select(F.col("row").alias("id"), "text")
    signs = dealt.join(alive, ["tile", "id"]).join(unique, "id")
    rows = together(texts.hint("merge").join(signs, "id"))
    links = rows.mapInArrow(verify, "a long, b long, jaccard double") if whole else rows.mapInArrow(forest, "a long, b long, n long")
    links = scratch.table(links, "links")
    scratch.drop("signed", "unique", "hubs", "dealt", "alive")
    if not whole:
        return members, links
    x, y = (reps.select(F.col("node").alias(k), F.col("rep").alias(f"rep_{k}")) for k in "ab")
    x, y = links.join(x, "a").join(y, "b"), (F.col("rep_a"), F.col("rep_b"))
    ordered = (F.when(y[0].isNull() | y[1].isNull(), y[i]).otherwise(f(*y)).alias(k) for i, (f, k) in enumerate(((F.least, "a"), (F.greatest, "b"))))
    return members, x.select(*ordered, "jaccard")


def near_rows(docs: DataFrame, row_col: str | None = None) -> DataFrame:
    """doc_id, class_id, rep_id, n_links, kept and row for every row.

    rep_id is the smallest id with the same text (null where none has an id);
    class_id the smallest id of all texts that links join to it, directly or by
    way of others; n_links the number of different texts that its text links
    to. Of each class one row is kept: the one with class_id, of several such
    the first. row is ``row_col`` or the input row's place.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    members, trees = jaccard_join(docs, scratch, whole=False, row_col=row_col)
    counts = trees.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = components(trees, scratch).join(counts, "node", "left")
    reps = members.filter("row = rep_row").select("node", "rep", "rep_row")
    linked_rows = scratch.table(roots.join(reps, "node"), "linked")
    first = F.min(F.struct(F.col("rep").isNull(), "rep", "rep_row"))
    firsts = linked_rows.groupBy("root").agg(first.alias("first"))
    firsts = firsts.select("root", F.col("first.rep").alias("class_id"), F.col("first.rep_row").alias("class_row"))
    known = scratch.table(linked_rows.select("node", "root", "n_links").join(firsts, "root").drop("root"), "known")
    out = members.join(known, "node", "left")
    alone = F.col("class_row").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("rep").alias("rep_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("row") == F.coalesce("class_row", "rep_row")).alias("kept"),
        "row",
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, rep_id, n_links of ``near_rows`` for every row with an id; rows without one take part in the classes."""
    return near_rows(docs).filter("doc_id IS NOT NULL").drop("kept", "row")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
