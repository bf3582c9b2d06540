"""Document fingerprints by improved consistent weighted sampling (DataFrame operations only)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, shuffle_partitions, text_of

#: White space other than the blank, which it counts as.
WHITE = "\t\n\x0b\x0c\r"
#: Samples of a fingerprint, and how many of them one row of the sampling step draws: as many as compiled code has room for.
SAMPLES, AT_ONCE = 32, 2
#: Sampled values are compared in steps of 2^-41, up to 2^6; marks have 16 bits.
STEP, MOST, MARK = float(1 << 41), (1 << 47) - 1, 0xFFFF
LN2, BITS24, BITS16 = math.log(2.0), (1 << 24) - 1, (1 << 16) - 1


def fraction(bits: Column, at: int) -> Column:
    """A number in (0, 1) of 24 bits of a hash."""
    return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(BITS24)) + F.lit(0.5)) / F.lit(float(1 << 24))


def zeros(bits: Column) -> Column:
    """How many of the 16 uppermost bits are 0, from the lowest on: a geometric number."""
    x = F.shiftrightunsigned(bits, 48).bitwiseOR(F.lit(1 << 16))
    return F.bit_count(x.bitwiseAND(F.negative(x)) - 1)


def with_draws(terms: DataFrame, seed: int) -> DataFrame:
    """terms(term, __run, ...) with __u{j}, __v{j} and __m{j} for each sample j of the run, which depend on the term, the sample and the seed alone.

    Consistent weighted sampling wants r and c from Gamma(2, 1) and beta uniform
    in [0, 1). Of two uniform numbers u and v, r = -ln u - ln v is such a
    number and beta = -ln v / r is uniform and independent of it. c is the sum of
    two exponential numbers, each ln 2 times a geometric number plus minus the
    logarithm of a number in [1/2, 1); the two logarithms are one of a product p
    in [1, 4), by its series about 2. m = c u is the sampled value where the
    weight is 1, so that there no logarithm is called. Each step is a
    projection of its own, so that nothing is worked out twice.
    """
    each = range(AT_ONCE)
    steps = [
        lambda j: {f"__h{j}": F.xxhash64("term", F.col("__run") * AT_ONCE + j, F.lit(seed))},
        lambda j: {f"__i{j}": F.xxhash64(f"__h{j}")},
        lambda j: {f"__u{j}": fraction(F.col(f"__h{j}"), 0), f"__v{j}": fraction(F.col(f"__h{j}"), 24), f"__g{j}": zeros(F.col(f"__h{j}")) + zeros(F.col(f"__i{j}")) + 1, f"__p{j}": (fraction(F.col(f"__i{j}"), 0) + F.lit(1.0)) * (fraction(F.col(f"__i{j}"), 24) + F.lit(1.0))},
        lambda j: {f"__s{j}": (F.col(f"__p{j}") - F.lit(2.0)) / (F.col(f"__p{j}") + F.lit(2.0))},
        lambda j: {f"__q{j}": F.col(f"__s{j}") * F.col(f"__s{j}")},
        lambda j: {f"__m{j}": F.col(f"__u{j}") * (F.lit(LN2) * F.col(f"__g{j}") - F.lit(2.0) * F.col(f"__s{j}") * series(F.col(f"__q{j}")))},
    ]
    for step in steps:
        terms = terms.withColumns({k: v for j in each for k, v in step(j).items()})
    return terms.drop(*[f"__{x}{j}" for x in "higpsq" for j in each])


def series(q: Column) -> Column:
    """1 + q / 3 + q^2 / 5 + ... + q^5 / 11: with q = s^2 and 2 s before it the logarithm of (1 + s) / (1 - s)."""
    out = F.lit(1 / 11)
    for n in (9, 7, 5, 3, 1):
        out = F.lit(1 / n) + q * out
    return out


def sample_step(j: int, weight: Column, ln_weight: Column) -> Column:
    """t = floor(ln weight / r + beta) of sample j; 0 where the weight is 1, without a logarithm."""
    u, v = F.col(f"__u{j}"), F.col(f"__v{j}")
    return F.when(weight > 1, F.floor((ln_weight - F.ln(v)) / F.negative(F.ln(u * v)))).otherwise(F.lit(0).cast("long"))


def sample_key(j: int, weight: Column, t: Column) -> Column:
    """A number whose smallest over a document's terms is its sample j: in the upper bits the sampled value c u e^(-r t), in
    the lowest 16 what term and t it came from; null without weight."""
    u, v, m = (F.col(f"__{x}{j}") for x in "uvm")
    value = F.when(t == 0, m).otherwise(m * F.exp(F.ln(u * v) * t))
    mark = F.shiftrightunsigned("term", 32).bitwiseXOR(t).bitwiseAND(F.lit(MARK))
    return F.when(weight > 0, F.shiftleft(F.least(F.floor(value * F.lit(STEP)), F.lit(MOST)), 16).bitwiseOR(mark))


def plain(text: Column) -> Column:
    """The text with blanks for all white space."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def weighted_terms(rows: DataFrame, pieces: dict[str, Sequence[int]], texts: int) -> DataFrame:
    """part, row, term (a hash of the word) and w0, w1, ... (how often each of so many texts has the word) of rows(part, row, pieces).

    ``pieces`` names columns of ``plain`` text and which of the row's texts each
    is a part of; words do not reach over pieces, and blanks alone part them (a
    single character, which needs no pattern). A row without words has one term
    without weight. Rows are dealt by part already, so that nothing is shuffled.
    """
    each = F.explode(F.array(*[F.struct(F.lit(sum(1 << i for i in of)).alias("of"), F.col(c).alias("text")) for c, of in pieces.items()])).alias("each")
    words = rows.select("part", "row", each).select("part", "row", F.col("each.of").alias("of"), F.explode(F.split("each.text", " ")).alias("word"))
    counts = [F.count_if((F.col("of").bitwiseAND(F.lit(1 << i)) > 0) & (F.col("word") != "")).alias(f"w{i}") for i in range(texts)]
    return words.withColumn("term", F.xxhash64("word")).groupBy("part", "row", "term").agg(*counts)


def sampled(terms: DataFrame, texts: int, samples: int = SAMPLES, seed: int = 13) -> DataFrame:
    """part, row and s0, s1, ... for each text an array of ``samples`` numbers of 16 bits; null where all its weights are 0.

    ``weighted_terms`` are dealt by part. Two texts have the same number at a
    place with a probability that equals the generalised Jaccard similarity of
    their weighted terms, the sum of the smaller weights over the sum of the
    larger ones (and 2^-16 by chance). What is drawn for a term serves all texts
    of a row.
    """
    logs = {f"__l{i}": F.when(F.col(f"w{i}") > 1, F.ln(F.col(f"w{i}").cast("double"))).otherwise(0.0) for i in range(texts)}
    runs = terms.withColumns(logs).select("*", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // AT_ONCE) - 1))).alias("__run"))
    drawn = with_draws(runs, seed)
    each = [(i, j) for i in range(texts) for j in range(AT_ONCE)]
    drawn = drawn.withColumns({f"__t{i}_{j}": sample_step(j, F.col(f"w{i}"), F.col(f"__l{i}")) for i, j in each})
    drawn = drawn.withColumns({f"__k{i}_{j}": sample_key(j, F.col(f"w{i}"), F.col(f"__t{i}_{j}")) for i, j in each})
    least = [F.min(f"__k{i}_{j}").alias(f"__k{i}_{j}") for i in range(texts) for j in range(AT_ONCE)]
    found = drawn.groupBy("part", "row", "__run").agg(*least)
    draws = [F.array(*[F.col(f"__k{i}_{j}").bitwiseAND(F.lit(MARK)) for j in range(AT_ONCE)]).alias(f"s{i}") for i in range(texts)]
    whole = found.select("part", "row", F.struct("__run", *draws).alias("run")).groupBy("part", "row").agg(F.sort_array(F.collect_list("run")).alias("runs"))
    signatures = [F.slice(F.flatten(F.col(f"runs.s{i}")), 1, samples) for i in range(texts)]
    return whole.select("part", "row", *[F.when(x[0].isNotNull(), x).alias(f"s{i}") for i, x in enumerate(signatures)])


def written(signature: Column) -> Column:
    """The signature as text, four hexadecimal digits a sample; '' for that of an empty text."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two signatures; 1 for two empty texts, 0 for an empty one and another."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same)


def fingerprints(rows: DataFrame, samples: int = SAMPLES, seed: int = 13) -> DataFrame:
    """rows with fingerprint, of their column text (see ``written``); an input column of that name is replaced.

    Equal texts have equal fingerprints, repeated rows stay repeated, null and
    empty texts have the empty fingerprint, texts of any length are read whole.
    Each distinct text is sampled once.
    """
    rows = rows.drop("fingerprint")
    key = "_key"
    while key in rows.columns:
        key = f"_{key}"
    n, digest = shuffle_partitions(rows.sparkSession), F.sha2(text_of(), 256)
    texts = rows.select(digest.alias("digest"), text_of().alias("text")).dropDuplicates(["digest"]).withColumn("part", F.pmod(F.hash("digest"), F.lit(n)))
    numbered = texts.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy("digest")))
    signed = sampled(weighted_terms(numbered.withColumn("text", plain(F.col("text"))), {"text": [0]}, 1), 1, samples, seed)
    known = numbered.select("part", "row", "digest").join(signed, ["part", "row"]).select(F.col("digest").alias(key), written(F.col("s0")).alias("fingerprint"))
    return rows.withColumn(key, digest).join(known, key).drop(key)


def first_ids(ids: DataFrame, parts: int) -> list[int]:
    """The smallest ids of about ``parts`` spans of equally many rows; the first is the smallest of all."""
    spans = [i / parts for i in range(parts)]
    rough = ids.agg(F.percentile_approx("doc_id", spans, max(10_000, 20 * parts)).alias("at")).first()["at"] or []
    rough = sorted(set(rough))
    # the percentiles went through doubles: take the ids that begin the spans
    return sorted(x.least for x in ids.groupBy(span_of(F.col("doc_id"), rough).alias("span")).agg(F.min("doc_id").alias("least")).collect())


def span_of(id_: Column, firsts: Sequence[int]) -> Column:
    """The last place of firsts (ascending, from 0) that is not above the id; 0 if all are, the last place for null."""
    if len(firsts) < 2:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << i) for i in range((len(firsts) - 1).bit_length() - 1, -1, -1)])
    known = F.lit([int(x) for x in firsts]).cast("array<bigint>")

    def step(at: Column, by: Column) -> Column:
        return F.when((at + by < len(firsts)) & (F.get(known, at + by) <= id_), at + by).otherwise(at)

    return F.when(id_.isNull(), len(firsts) - 1).otherwise(F.aggregate(steps, F.lit(0), step))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, next_text, part, row and guest: every row of docs with the text of the next by ascending id, after the last the first.

    Rows are dealt by spans of ids, cut at quantiles; the first row of a span
    also stands, as a guest, at the end of the span before, so that no row looks
    into another task. Rows without an id come last; rows that share an id, or
    have none, follow in the order of their texts, all in one span.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    firsts = first_ids(rows.select("doc_id").filter("doc_id IS NOT NULL"), parts)
    n = max(1, len(firsts))
    own = span_of(F.col("doc_id"), firsts).cast("int")
    first = F.get(F.lit(firsts).cast("array<bigint>"), own) == F.col("doc_id") if firsts else F.lit(True)
    places = F.when(first, F.array(F.struct(own.alias("part"), F.lit(False).alias("guest")), F.struct(((own + n - 1) % n).alias("part"), F.lit(True).alias("guest"))))
    places = places.otherwise(F.array(F.struct(own.alias("part"), F.lit(False).alias("guest"))))
    dealt = rows.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.guest").repartitionById(n, F.col("part"))
    order = Window.partitionBy("part").orderBy("guest", F.asc_nulls_last("doc_id"), "text")
    return dealt.withColumns({"next_text": F.coalesce(F.lead("text").over(order), F.col("text")), "row": F.row_number().over(order)})


def with_edits(docs: DataFrame, samples: int = SAMPLES, seed: int = 13, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row of docs(doc_id, text).

    The edited text keeps the first half (the longer, of an odd number of code
    points) and goes on with as many code points of the next text as it lost, or
    all that there are. near_edited and near_next are the ``likeness`` of the
    row's fingerprint to that of its edited text and of the next row. A single
    row is its own next; an empty table gives no rows; null texts are empty;
    repeated rows are rows like others; further columns are not read.

    Texts are shuffled once, by spans of ids (``with_next``); terms, weights
    and samples of a row are made where it is.
    """
    spark = docs.sparkSession
    laid = with_next(docs, parts or 4 * shuffle_partitions(spark))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    base = laid.filter("NOT guest").select("part", "row", "doc_id", n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"))
    # both texts begin alike: up to the last blank before the cut they are counted as one piece
    halves = laid.select("part", "row", F.substring(plain(F.col("text")), F.lit(1), n - half).alias("kept"), F.substring(plain(F.col("text")), n - half + 1, half).alias("lost"), F.substring(plain(F.col("next_text")), F.lit(1), half).alias("new"))
    halves = halves.withColumn("word", F.substring_index("kept", " ", -1))
    pieces = halves.select("part", "row", F.substring("kept", F.lit(1), F.char_length("kept") - F.char_length("word")).alias("head"), F.concat("word", "lost").alias("own"), F.concat("word", "new").alias("other"))
    signed = sampled(weighted_terms(pieces, {"head": [0, 1], "own": [0], "other": [1]}, 2), 2, samples, seed)
    after = F.lead(F.struct("s0")).over(Window.partitionBy("part").orderBy("row"))
    signed = signed.withColumn("after", F.coalesce(after, F.struct("s0"))).select(
        "part", "row", written(F.col("s0")).alias("fingerprint"), written(F.col("s1")).alias("edited_fingerprint"),
        likeness(F.col("s0"), F.col("s1"), samples).alias("near_edited"), likeness(F.col("s0"), F.col("after.s0"), samples).alias("near_next"),
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return base.join(signed, ["part", "row"]).select(*names)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(documents(spark, sf_dir))
