"""Packing documents into token sequences along a Hilbert curve."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, shuffle_partitions, text_of

TOKENIZER = "word_bpe_49k.json"
#: Buckets of the hashed document vector, dimensions and bits per dimension of the curve.
BUCKETS, DIMS, BITS = 1024, 4, 6
#: Tokens of a range, one task's work, and finer ranges counted for each.
RANGE_TOKENS, FINE = 16_000_000, 4
#: Bits of the row number's hash that split ties on the curve; with the curve's bits a double holds the key exactly.
TIE_BITS = 28


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


#: Words of these characters alone are merged by the faster library: their letters, digits and marks are beyond doubt.
PLAIN = re.compile("[!-;=-~ß-öø-ÿ]+")
#: The tokenizer's pieces, for such words.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[str, int]:
    """The byte for each letter by which byte-level vocabularies write it."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in seen)}


class PlainMerger:
    """The same vocabulary and merges in tiktoken, for single pieces in small letters.

    The word end is the byte 255, which UTF-8 never has: it merges with the last
    byte before all else. As every token has one merge that makes it, merging
    by the token's place gives the ids that the tokenizer gives.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        byte = {b: c for c, b in letters.items()}
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(256)}
        ids = [vocab[byte[b]] for b in range(256)] + [vocab[byte[b] + "</w>"] for b in range(256)]
        for pair in model["merges"]:
            token = "".join(pair if isinstance(pair, list) else pair.split(" "))
            end = token.endswith("</w>")
            ranks[bytes(letters[c] for c in token.removesuffix("</w>")) + b"\xff" * end] = len(ids)
            ids.append(vocab[token])
        if len(ranks) != len(ids):
            raise ValueError("two merges make the same token")
        self.ids = [np.uint32(i).astype("<u4").tobytes() for i in ids]
        self.merge = tiktoken.Encoding("plain", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __call__(self, word: str) -> bytes:
        ids = self.ids
        return b"".join([ids[i] for piece in PIECES.findall(word) for i in self.merge(piece.encode() + b"\xff")])


class WordIds(dict):
    """Token ids (little-endian, 4 bytes each) of words without blanks, encoded when first asked for.

    The tokenizer never joins across white space, so that a text's ids are its
    words' ids one after another. The memo is emptied at ``limit`` words, which
    bounds a worker's memory and changes no result.
    """

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encode, self.plain, self.limit = Tokenizer.from_file(path).encode, PlainMerger(path), limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if PLAIN.fullmatch(word) and word == word.lower():
            got = self.plain(word)
        else:
            got = np.array(self.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = got
        return got


#: Beyond these letters, small letters first could change the ids.
UNSAFE = re.compile("[^\x00-\u012f\u0131-\u017f]")


def words_of(text: str) -> list[str]:
    """Words between ASCII blanks, which the tokenizer drops; in small letters where that keeps the ids, so that fewer distinct words are encoded."""
    for blank in "\n\t\r":
        if blank in text:
            text = text.replace(blank, " ")
    safe = (text.isascii() or not UNSAFE.search(text)) and "<|" not in text  # a special token's mark
    return (text.lower() if safe else text).split(" ")


def ids_of(texts: list[str], memo: WordIds) -> list[bytes]:
    """Ids of each text without the end mark."""
    return [b"".join(map(memo.__getitem__, words_of(x))) for x in texts]


def projection(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def hashed_vector(ids: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """The document's token counts, hashed into buckets, dampened, scaled to length 1 and projected."""
    counts = np.sqrt(np.bincount((ids * np.uint32(2654435761)) >> np.uint32(22), minlength=BUCKETS))
    return counts @ onto / (np.sqrt(np.square(counts).sum()) or 1.0)


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, row (unique), ids (binary: 4 bytes per token, with end_id) and the projected vector p0, p1, ..."""
    names = [f"p{i}" for i in range(DIMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, onto, end = WordIds(path), projection(), np.array([end_id], "<u4").tobytes()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = ids_of(part.column("text").to_pylist(), memo)
                vectors = np.array([hashed_vector(np.frombuffer(x, "<u4"), onto) for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("row"), pa.array([x + end for x in ids], pa.binary()), *(pa.array(vectors[:, i]) for i in range(DIMS))],
                    names=["doc_id", "row", "ids", *names],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, ids binary, " + ", ".join(f"{n} double" for n in names))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell coordinates (n x dims, below 2 ** bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the coarsest level
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def pack(docs: DataFrame, length: int = 2048, end_id: int = 1, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences: doc_id, row, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Each row of docs (null text: empty) is its token ids and end_id. Rows are
    ordered by the Hilbert key of their projected hashed vectors, ties by a
    hash of the row number, and laid end to end; the line is cut every
    ``length`` tokens, so that only the last sequence is short. Repeated rows
    are packed each on its own, an empty text as its end mark alone; an empty
    table gives no rows. Other columns are not read. ``row`` tells repeated ids
    apart.

    Ranges of keys of about equal numbers of tokens are dealt to tasks, so many
    that each holds about RANGE_TOKENS, and as many as there are shuffle
    partitions at least. The token counts of finer ranges (one number each) say
    where ranges end and give each its first offset.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokens = scratch.table(tokenize(docs, path or tokenizer_path(), end_id), "tokens")
    names = [f"p{i}" for i in range(DIMS)]
    spread = tokens.agg(*[F.avg(n).alias(f"m{n}") for n in names], *[F.stddev_pop(n).alias(f"s{n}") for n in names]).first()
    center = np.array([spread[f"m{n}"] or 0.0 for n in names])
    scale = np.array([spread[f"s{n}"] or 1.0 for n in names])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.column_stack([b.column(n).to_numpy() for n in names])
            cells = np.floor(1 / (1 + np.exp(-1.6 * (z - center) / scale)) * (1 << BITS)).clip(0, (1 << BITS) - 1)
            key = hilbert(cells, BITS) << TIE_BITS | b.column("tie").to_numpy()
            kept = [n for n in b.schema.names if n not in ("tie", *names)]
            own = [pa.array(key), pa.array(np.searchsorted(cuts, key, "right").astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *own], names=[*kept, "key", "part"])

    tie = F.shiftrightunsigned(F.xxhash64("row"), 64 - TIE_BITS).alias("tie")
    small = tokens.select((F.octet_length("ids") / 4).cast("long").alias("n"), tie, *names)
    cuts = np.array([], np.int64)
    keys = scratch.table(small.mapInArrow(keyed, "n long, key long, part long").drop("part"), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-total // RANGE_TOKENS))
    fine = [i / (FINE * parts) for i in range(1, FINE * parts)]
    cuts = np.unique(np.array(keys.approxQuantile("key", fine, 0.2 / (FINE * parts)), np.int64))
    at = spark.sparkContext.broadcast(cuts)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(np.searchsorted(at.value, b.column("key").to_numpy(), "right"))], names=["n", "part"])

    sums = {r[0]: r[1] for r in keys.select("n", "key").mapInArrow(placed, "n long, part long").groupBy("part").agg(F.sum("n")).collect()}
    # neighbouring fine ranges join until they hold a part's share of the tokens
    first, upto, low, joined = {}, 0, 0, []
    for p in range(len(cuts) + 1):
        if p and upto - low >= total / parts:
            joined.append(cuts[p - 1])
            low = upto
        first.setdefault(len(joined), upto)
        upto += sums.get(p, 0)
    cuts = np.array(joined, np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = -1, 0
        for b in batches:
            out: list[tuple] = []
            for doc, row, ids, p in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "ids", "part")), strict=True):
                if p != last:
                    last, at = p, first[p]
                n, start = len(ids) // 4, 0
                while start < n:
                    take = min(length - at % length, n - start)
                    piece = ids[4 * start : 4 * (start + take)]
                    out.append((doc, row, start, take, zlib.crc32(piece), n, at // length, at % length, piece if with_ids else None))
                    start, at = start + take, at + take
            columns = zip(*out, strict=True) if out else [()] * len(out_names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(out_names, columns, strict=True)], names=out_names)

    out_names = ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = tokens.select("doc_id", "row", "ids", tie, *names).mapInArrow(keyed, "doc_id long, row long, ids binary, key long, part long")
    rows = rows.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "key", "row")
    pieces = rows.select("doc_id", "row", "ids", "part").mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in out_names))
    return pieces if with_ids else pieces.drop("ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary) and doc_ids of pieces made ``with_ids``; a sequence gathers ``length`` tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("row")
