"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts."""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents

BYTE_BPE, BYTE_RANKS, PIECE_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Bits of a pair's key that the second tokenizer's id takes.
B_BITS = 15
#: UTF-8 bytes that are aligned at a time, tries near the middle before all ends of an interval are compared, links of a group beyond which its ids are counted before they are paired.
AT_ONCE, TRIES, WIDE = 1 << 18, 24, 64
#: Id pairs of a block of the corpus-wide table, of one of its rows, and links looked up by one task.
BLOCK_PAIRS, ROW_PAIRS, TASK_LINKS = 1 << 20, 1 << 16, 1 << 22
#: Runs that the faster library is not given: its pattern may look back over all of a run.
LONG_RUN = re.compile(r"\s{1000}|\S{1000}")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return tuple(public_tokenizers.path(x) for x in (BYTE_BPE, BYTE_RANKS, PIECE_BPE))


class Tokenizers:
    """Both tokenizers and the bytes of each of their tokens.

    The first is byte-level BPE; tiktoken encodes by its ranks, which gives the
    ids of the vocabulary file (tests compare them), and the file's own library,
    read when first needed, what has runs too long for tiktoken's pattern. The
    second is a sentencepiece model.
    """

    def __init__(self, paths: tuple[str, str, str]):
        import sentencepiece
        import tiktoken

        self.path = paths[0]
        with open(paths[1], "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=paths[2])
        names = {rank: token for token, rank in ranks.items()}
        self.a_bytes = [names.get(i, b"") for i in range(max(names) + 2)]
        b = self.pieces
        self.b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in y]) for y in (self.a_bytes, self.b_bytes))

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of blank + text by both; none where a text is empty or a tokenizer does not keep its bytes."""
        second = self.pieces.encode(texts, num_threads=1)
        out = []
        for text, b in zip(texts, second, strict=True):
            marked = f" {text}"
            a = self.whole.encode(marked, add_special_tokens=False).ids if LONG_RUN.search(marked) else self.plain.encode_ordinary(marked)
            data = marked.encode()
            kept = text and b"".join(map(self.a_bytes.__getitem__, a)) == data == b"".join(map(self.b_bytes.__getitem__, b))
            out.append((a, b) if kept else ([], []))
        return out


def shared_cuts(a_end: np.ndarray, b_end: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The finest groups of roots: rows a0, a1, b0, b1 of token ranges (ends exclusive) that cover the same bytes and have no end in common within.

    a_end and b_end are the tokens' byte ends, ascending over all roots. An
    interval is cut where, nearest to its middle, an end of the first side is
    found among the second's by bisect; both halves are treated alike, and an
    interval without a cut is a group. All intervals of one depth are bisected
    together. An interval whose first TRIES ends about the middle are no cuts
    has all of its ends looked up at once.
    """
    groups, open_ = [], roots
    while len(open_):
        single = (open_[:, 1] - open_[:, 0] == 1) | (open_[:, 3] - open_[:, 2] == 1)
        groups.append(open_[single])
        waiting, halves = open_[~single], []
        for step in range(TRIES):
            if not len(waiting):
                break
            a0, a1 = waiting[:, 0], waiting[:, 1]
            middle, far = (a0 + a1) // 2 - 1, (step + 1) // 2
            at = middle + (far if step % 2 else -far)
            inside = (at >= a0) & (at <= a1 - 2)
            end = a_end[np.where(inside, at, a0)]
            place = np.searchsorted(b_end, end)
            hit = inside & (b_end[place] == end)
            if hit.any():
                halves += cut(waiting[hit], at[hit], place[hit])
            done = ~hit & (np.maximum(middle - a0, a1 - 2 - middle) <= far) & (step % 2 == 0)
            groups.append(waiting[done])
            waiting = waiting[~hit & ~done]
        for row in waiting:  # few, and long
            a0, a1, b0, b1 = row
            ends = a_end[a0 : a1 - 1]
            place = b0 + np.searchsorted(b_end[b0:b1], ends)
            cuts = np.flatnonzero(b_end[place] == ends)
            if len(cuts):
                near = cuts[np.argmin(np.abs(cuts - (a1 - a0) // 2 + 1))]
                halves += cut(row[None], np.array([a0 + near]), place[[near]])
            else:
                groups.append(row[None])
        open_ = np.concatenate(halves) if halves else open_[:0]
    found = np.concatenate(groups)
    return found[np.argsort(found[:, 0])]


def cut(rows: np.ndarray, at: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    left, right = rows.copy(), rows.copy()
    left[:, 1] = right[:, 0] = at + 1
    left[:, 3] = right[:, 2] = place + 1
    return [left, right]


class Batch:
    """Some texts' tokens, laid one after another, and their groups."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str]):
        ids = tokenizers.encode(texts)
        self.n_a, self.n_b = (np.array([len(x[side]) for x in ids], np.int64) for side in (0, 1))
        self.a, self.b = (np.array([i for x in ids for i in x[side]], np.int64) for side in (0, 1))
        self.a_end, self.b_end = np.cumsum(tokenizers.a_size[self.a]), np.cumsum(tokenizers.b_size[self.b])
        a1, b1 = np.cumsum(self.n_a), np.cumsum(self.n_b)
        roots = np.stack([a1 - self.n_a, a1, b1 - self.n_b, b1], 1)
        self.groups = shared_cuts(self.a_end, self.b_end, roots[self.n_a > 0])
        self.doc = np.searchsorted(a1, self.groups[:, 0], "right")
        self.n_groups = np.bincount(self.doc, minlength=len(texts))
        self.sizes = (self.groups[:, 1] - self.groups[:, 0]) * (self.groups[:, 3] - self.groups[:, 2])
        self.n_links = np.bincount(self.doc, self.sizes, len(texts)).astype(np.int64)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, key of the id pair and number of links, ascending by text and key."""
        few = self.sizes <= WIDE
        groups, sizes, doc = self.groups[few], self.sizes[few], self.doc[few]
        of = np.repeat(np.arange(len(groups)), sizes)
        k = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = groups[:, 3] - groups[:, 2]
        keys = self.a[groups[of, 0] + k // wide[of]] << B_BITS | self.b[groups[of, 2] + k % wide[of]]
        texts, times = doc[of], np.ones(len(of), np.int64)
        for (a0, a1, b0, b1), d in zip(self.groups[~few], self.doc[~few], strict=True):
            (a, n), (b, m) = (np.unique(x, return_counts=True) for x in (self.a[a0:a1], self.b[b0:b1]))
            keys = np.concatenate([keys, (a[:, None] << B_BITS | b).ravel()])
            texts, times = np.concatenate([texts, np.full(len(a) * len(b), d)]), np.concatenate([times, np.outer(n, m).ravel()])
        order = np.lexsort((keys, texts))
        keys, texts, times = keys[order], texts[order], times[order]
        first = np.flatnonzero((np.diff(keys, prepend=-1) != 0) | (np.diff(texts, prepend=-1) != 0))
        return texts[first], keys[first], np.add.reduceat(times, first) if len(first) else times

    def digests(self, written: list[bytes]) -> list[str]:
        """Hash of each text's groups as decimal ids, ``a1,a2|b1;a3|b2,b3``; '' without tokens. written: see ``written_ids``."""
        g = self.groups
        of_a, of_b = (np.repeat(np.arange(len(g)), g[:, i + 1] - g[:, i]) for i in (0, 2))
        i, j = np.arange(len(self.a)), np.arange(len(self.b))
        ends = np.concatenate([np.diff(self.doc) != 0, [True]]) if len(g) else np.array([], bool)
        codes = np.empty(len(i) + len(j), np.int64)
        codes[i + g[of_a, 2]] = self.a + (np.where(i + 1 < g[of_a, 1], 0, 1) << 16)
        codes[j + g[of_b, 1]] = self.b + (np.where(j + 1 < g[of_b, 3], 0, np.where(ends[of_b], 3, 2)) << 16)
        codes, at, out = codes.tolist(), 0, []
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256(b"".join([written[c] for c in codes[at : at + n]])).hexdigest() if n else "")
            at += n
        return out


def written_ids() -> list[bytes]:
    """Decimal ids with what follows them: at 65536 times 0 to 3 plus the id, a comma, a bar, a semicolon, nothing."""
    return [b"%d%s" % (i, mark) for mark in (b",", b"|", b";", b"") for i in range(1 << 16)]


def spans(texts: pa.StringArray) -> Iterator[tuple[int, list[str]]]:
    """The column's texts, null as empty, in lists of about AT_ONCE bytes, of one text at least, each with the place of its first."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    piece = (np.cumsum(sizes, dtype=np.int64) - sizes) // AT_ONCE
    starts = np.flatnonzero(np.diff(piece, prepend=-1)) if len(piece) else piece
    for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)], strict=True):
        yield low, [x or "" for x in texts.slice(low, high - low).to_pylist()]


ALIGNED = ["doc_id long", "n_a long", "n_b long", "n_groups long", "n_links long", "groups_sha256 string", "keys array<long>", "times array<long>"]
GROUPS = "doc_id long, position int, first_byte long, end_byte long, a_ids array<int>, b_ids array<int>"


def lists(texts: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    """A list of values for each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(texts, minlength=n))]), pa.int32()), pa.array(values, kind))


def groups(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row a group of docs(doc_id, text): position from 0, bytes of blank + text that it covers, ids of both sides in order."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = Tokenizers(paths)
        for b in batches:
            ids = b.column("doc_id")
            for low, texts in spans(b.column("text")):
                x = Batch(tokenizers, texts)
                g, before = x.groups, np.concatenate([[0], np.cumsum(x.n_groups)])
                base = np.concatenate([[0], x.a_end])[(np.cumsum(x.n_a) - x.n_a)[x.doc]]
                a, c = (pa.ListArray.from_arrays(pa.array(np.append(g[:, k], side.size), pa.int32()), pa.array(side, pa.int32())) for k, side in ((0, x.a), (2, x.b)))
                start = np.concatenate([[0], x.a_end])[g[:, 0]]
                cells = [ids.take(pa.array(low + x.doc)), pa.array(np.arange(len(g)) - before[x.doc], pa.int32()), pa.array(start - base), pa.array(x.a_end[g[:, 1] - 1] - base), a, c]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "position", "first_byte", "end_byte", "a_ids", "b_ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, GROUPS)


def aligned(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row for each of docs: numbers of tokens, groups and links, the hash of the groups, and the id pairs that are linked with how often."""
    paths = paths or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, written = Tokenizers(paths), written_ids()
        for b in batches:
            for low, texts in spans(b.column("text")):
                x, n = Batch(tokenizers, texts), len(texts)
                of, keys, times = x.links()
                own = [pa.array(v, pa.int64()) for v in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                cells = [b.column("doc_id").slice(low, n), *own, pa.array(x.digests(written), pa.string()), lists(of, keys, n), lists(of, times, n)]
                yield pa.RecordBatch.from_arrays(cells, names=[c.split()[0] for c in ALIGNED])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(ALIGNED))


def pair_counts(rows: DataFrame) -> DataFrame:
    """key, n and best of every id pair of ``aligned`` rows: in how many rows it is linked, and whether no pair of its first id is in more."""
    pairs = rows.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    first = F.shiftright("key", B_BITS).alias("a")
    most = pairs.select(first, "n").groupBy("a").agg(F.max("n").alias("most"))
    return pairs.select("key", "n", first).join(most, "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, paths: tuple[str, str, str] | None = None, block_pairs: int = BLOCK_PAIRS, task_links: int = TASK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs(doc_id, text).

    Tokens are aligned row by row (``aligned``, written once); the rows' id
    pairs are counted over the corpus. Then pairs are cut into blocks of about
    block_pairs, and a row's pairs are looked up block by block: rows are dealt
    by block and by a share of the rows, task_links links a task on average, and
    each task reads its block's counts first, then streams its rows. A pair that
    all documents hold is thus spread over all shares. Repeated rows count each;
    null and empty texts, and such as a tokenizer does not keep, give zeros.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "alignment")
    rows = scratch.table(aligned(docs, paths).withColumn("row", F.monotonically_increasing_id()), "aligned")
    pairs = scratch.table(pair_counts(rows), "pairs")
    n_pairs, n_keys = pairs.count(), rows.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_pairs // block_pairs)) | 1  # odd, so that ids of either side decide
    shares = max(1, -(-n_keys // (blocks * task_links)))
    base = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    fields = [*ALIGNED[:6], "row long", "part int", "known boolean", "keys array<long>", "times array<long>"]
    names = [c.split()[0] for c in fields]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = np.repeat(np.arange(b.num_rows), b.column("keys").value_lengths().to_numpy()), b.num_rows
            keys, times = (b.column(c).flatten().to_numpy() for c in ("keys", "times"))
            block = keys % blocks
            share = b.column("row").to_numpy() % 1_000_003 % shares
            for k in range(blocks):
                on = block == k
                held = np.bincount(at[on], minlength=n) > 0
                held |= k == 0  # every row once at least
                cells = [b.column(c) for c in [*base, "row"]]
                cells += [pa.array(k * shares + share, pa.int32()), pa.array(np.zeros(n, bool)), lists(at[on], keys[on], n), lists(at[on], times[on], n)]
                yield pa.RecordBatch.from_arrays(cells, names=names).filter(pa.array(held))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, table = [[np.array([], np.int64)] * 2], None
        for b in batches:
            known = b.column("known").to_numpy(zero_copy_only=False)
            if known.any():
                counts = b.filter(pa.array(known))
                gathered.append([counts.column(c).flatten().to_numpy() for c in ("keys", "times")])
            b = b.filter(pa.array(~known))
            if not b.num_rows:
                continue
            if table is None:
                key, count = (np.concatenate(x) for x in zip(*gathered, strict=True))
                table, gathered = (key[order := np.argsort(key)], count[order]), []
            size = b.column("keys").value_lengths().to_numpy()
            keys, times = (b.column(c).flatten().to_numpy() for c in ("keys", "times"))
            got = table[1][np.searchsorted(table[0], keys)] if len(keys) else keys
            total = np.concatenate([[0], np.cumsum(times * (got >> 1))])
            best = np.concatenate([[0], np.cumsum(times * (got & 1))])
            end = np.cumsum(size)
            cells = [b.column(c) for c in [*base, "row"]] + [pa.array(x[end] - x[end - size]) for x in (best, total)]
            yield pa.RecordBatch.from_arrays(cells, names=[*base, "row", "n_best", "count_sum"])

    empty = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in fields[:7]]
    block, piece = (F.col("key") % blocks).cast("int").alias("block"), F.pmod(F.xxhash64("key"), F.lit(max(1, -(-n_pairs // (blocks * ROW_PAIRS))))).alias("piece")
    table = pairs.select(block, piece, F.struct("key", (F.col("n") * 2 + F.col("best").cast("long")).alias("n")).alias("p")).groupBy("block", "piece").agg(F.collect_list("p").alias("p"))
    table = table.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    table = table.select(*empty, (F.col("block") * shares + F.col("share")).cast("int").alias("part"), F.lit(True).alias("known"), F.col("p.key").alias("keys"), F.col("p.n").alias("times"))
    dealt = table.unionByName(rows.mapInArrow(deal, ", ".join(fields))).repartitionById(blocks * shares, F.col("part")).sortWithinPartitions(F.desc("known"))
    found = dealt.mapInArrow(look_up, ", ".join([*fields[:7], "n_best long", "count_sum long"]))
    sums = [F.sum(c).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return found.groupBy("row", *base).agg(*sums).select(*base[:5], "n_best", "count_sum", "groups_sha256")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
