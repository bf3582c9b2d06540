"""Personal data: fixed patterns, and a skip-chain conditional random field that adds consistent further spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

KINDS = ("email", "ip", "card", "phone")
#: Labels of a token: 0 is none, k + 1 is KINDS[k], the last is a secret; UNKNOWN where a pattern's match failed a check.
SECRET, UNKNOWN = 1 + len(KINDS), -1
LABELS = SECRET + 1
#: Documents that the field is fitted on at most (those with the smallest hash of their id among documents with a digit or @).
MOST_FITTED = 1500
#: A token outside the base spans becomes a span where its marginal reaches this.
SURE = 0.9
#: Rounds of message passing, and how much of the old message stays in each.
ROUNDS, DAMPING = 12, 0.3
HASHED = 1 << 14

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
#: Words end at white space and at marks that no kind contains.
WORD = re.compile(r"[^\s()\[\]{}<>\"'`,;|=!?*#$%&]+")
EVIDENCE = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")
#: Forms of keys in wide use, from which the field learns what stands around secrets.
KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{40}|[0-9a-f]{64})(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    """Doubles every second digit from the right; the digit sum must end in 0."""
    back = [int(d) for d in reversed(digits)]
    return sum(back[::2] + [2 * d - 9 * (d > 4) for d in back[1::2]]) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans from each @: the run of local characters before it (after the last match) and the domain after it."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and not NOT_LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans (code points, end exclusive) of each kind, leftmost and not overlapping; failing matches are dropped without another try."""
    found: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if not re.search("[0-9]", text):
        return found
    found[1] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found[2].append(m.span())
    if "+" in text:
        found[3] = [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return found


@dataclass
class Token:
    start: int
    end: int
    label: int  # of the base span or key that it lies in, else 0 or UNKNOWN
    features: list[int]
    key: str


def hashed(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % HASHED


def failed_spans(text: str) -> list[tuple[int, int]]:
    """Matches of the ip and phone patterns that fail their checks: numbers that run into others, which may hold one of the kind."""
    if not EVIDENCE.search(text):
        return []
    ips = [m.span() for m in IP.finditer(text) if any(len(p.lstrip("0")) > 3 or int(p) > 255 for p in m[0].split("."))]
    phones = [m.span() for m in PHONE.finditer(text) if not 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15] if "+" in text else []
    return ips + phones


def tokens(text: str, base: list[list[tuple[int, int]]]) -> list[Token]:
    """The nodes of a text: words with a digit or @, of any length.

    Words in between carry no evidence for any kind and are fixed to none, which
    cuts the chain there. A node's label is that of the base span or key that it
    lies in; UNKNOWN within a failed match, so that the field is not taught that
    numbers which run together are none of the kind.
    """
    if not EVIDENCE.search(text):
        return []
    spans = sorted([(s, e, k + 1) for k, kind in enumerate(base) for s, e in kind] + [(*m.span(), SECRET) for m in KEYS.finditer(text)])
    failed, out, i, j, before = sorted(failed_spans(text)), [], 0, 0, ""
    for m in WORD.finditer(text):
        word = m[0].rstrip(".:")
        last, before = before, word
        if not EVIDENCE.search(word):
            continue
        start = m.start()
        while i < len(spans) and spans[i][1] <= start:
            i += 1
        while j < len(failed) and failed[j][1] <= start:
            j += 1
        label = UNKNOWN if j < len(failed) and failed[j][0] < start + len(word) else 0
        if i < len(spans) and spans[i][0] < start + len(word):
            label = spans[i][2]
        digits = NOT_DIGIT.sub("", word)
        letters = sum(map(str.isalpha, word))
        names = [
            "bias",
            "form=" + re.sub("[^\\W\\d_]+", "a", re.sub("[0-9]+", "9", word)) if letters < 12 else "form=long",
            f"digits={min(len(digits), 20)}",
            f"letters={min(letters, 20)}",
            f"dots={min(word.count('.'), 5)}",
            f"at={'@' in word}",
            f"plus={word.startswith('+')}",
            f"bracket={text[max(0, start - 1) : start] == '('}",
            f"luhn={11 < len(digits) < 20 and luhn(digits)}",
            f"before={last.lower()}",
        ]
        # similar words: the same letters and digits whatever the marks between
        key = re.sub(r"[\W_]+", "", word).lower()
        out.append(Token(start, start + len(word), label, [hashed(n) for n in names], key))
    return out


@dataclass
class Field:
    """Log potentials: of a label by feature, of neighbours' labels in the chain, and of labels at the ends of a skip edge."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def edges_of(docs: list[list[Token]], gap: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Chain edges between nodes at most gap characters apart, and skip edges between successive nodes of a text with one key."""
    chain, skip, n = [], [], 0
    for nodes in docs:
        seen: dict[str, int] = {}
        for i, t in enumerate(nodes):
            if i and t.start - nodes[i - 1].end <= gap:
                chain.append((n + i - 1, n + i))
            if len(t.key) > 4:
                if t.key in seen and (n + i - 1 != seen[t.key] or not (chain and chain[-1] == (n + i - 1, n + i))):
                    skip.append((seen[t.key], n + i))
                seen[t.key] = n + i
        n += len(nodes)
    return np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)


def fit(docs: list[list[Token]], steps: int = 150, l2: float = 0.5) -> Field:
    """Piecewise training on the base spans' labels: a softmax over each node's features, and edge potentials from label pairs.

    The label pairs are the pointwise mutual information of smoothed counts.
    Pairs on skip edges start with a count of agreement, as repeats of one word
    nearly always mean one thing. Nodes of unknown label teach nothing, neither
    by themselves nor in pairs. Without nodes all potentials are 0.
    """
    every = [t for d in docs for t in d]
    label = np.array([t.label for t in every], np.int64)
    nodes = [t for t in every if t.label != UNKNOWN]
    y = label[label != UNKNOWN]
    unary = np.zeros((HASHED, LABELS))
    if nodes:
        x = np.array([t.features for t in nodes])
        onto, goal = np.zeros_like(unary), np.eye(LABELS)[y]
        weight = (1 / np.maximum(np.bincount(y, minlength=LABELS), 1))[y][:, None] ** 0.3
        for _ in range(steps):
            p = softmax(unary[x].sum(1))
            grad = np.zeros_like(unary)
            np.add.at(grad, x, np.repeat(((goal - p) * weight)[:, None], x.shape[1], 1))
            grad -= l2 * 0.01 * unary
            onto += grad**2
            unary += 0.5 * grad / (np.sqrt(onto) + 1e-8)

    def pairs(edges: np.ndarray, start: np.ndarray) -> np.ndarray:
        counts = start.copy()
        known = edges[(label[edges] != UNKNOWN).all(1)] if len(edges) else edges
        if len(known):
            np.add.at(counts, (label[known[:, 0]], label[known[:, 1]]), 1)
        joint = counts / counts.sum()
        return np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))

    chain, skip = edges_of(docs)
    return Field(unary, pairs(chain, np.full((LABELS, LABELS), 0.5)), pairs(skip, np.full((LABELS, LABELS), 0.1) + 5 * np.eye(LABELS)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def marginals(docs: list[list[Token]], model: Field) -> np.ndarray:
    """Loopy belief propagation over the graphs of all docs at once: the label marginals of every node.

    Nodes in base spans are held at their label, so that their repeats hear of it.
    """
    nodes = [t for d in docs for t in d]
    if not nodes:
        return np.zeros((0, LABELS))
    own = model.unary[np.array([t.features for t in nodes])].sum(1)
    y = np.array([t.label for t in nodes])
    held = y > 0
    own[held] = np.where(np.arange(LABELS) == y[held][:, None], 0.0, -30.0)
    chain, skip = edges_of(docs)
    source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
    target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
    n = len(chain) + len(skip)
    back = np.concatenate([np.arange(len(chain)) + len(chain), np.arange(len(chain)), 2 * len(chain) + len(skip) + np.arange(len(skip)), 2 * len(chain) + np.arange(len(skip))])
    potential = np.concatenate([np.repeat(p[None], k, 0) for p, k in ((model.chain, len(chain)), (model.chain.T, len(chain)), (model.skip, len(skip)), (model.skip.T, len(skip)))])
    told = np.zeros((2 * n, LABELS))
    belief = own.copy()
    for _ in range(ROUNDS if n else 0):
        out = belief[source] - told[back]
        most = (out[:, :, None] + potential).max(1)
        new = most + np.log(np.exp(out[:, :, None] + potential - most[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        told = DAMPING * told + (1 - DAMPING) * new
        belief = own.copy()
        np.add.at(belief, target, told)
    return softmax(belief)


def added(docs: list[list[Token]], model: Field) -> list[list[list[tuple[int, int]]]]:
    """For each text and kind (secrets last) the further spans: free nodes whose marginal for the kind is SURE; neighbours in the chain join to one span."""
    p = marginals(docs, model)
    best, sure, n, out = p.argmax(1) if len(p) else [], p.max(1) if len(p) else [], 0, []
    for nodes in docs:
        found: list[list[tuple[int, int]]] = [[] for _ in range(SECRET)]
        last = None
        for i, t in enumerate(nodes):
            label = int(best[n + i]) if t.label <= 0 and sure[n + i] >= SURE else 0
            if label:
                if last and last[0] == label and last[1] == i - 1 and t.start - nodes[i - 1].end <= 2:
                    found[label - 1][-1] = (found[label - 1][-1][0], t.end)
                else:
                    found[label - 1].append((t.start, t.end))
                last = (label, i)
        n += len(nodes)
        out.append(found)
    return out


def train(docs: DataFrame, most: int = MOST_FITTED) -> Field:
    """Fits on the texts of at most ``most`` documents with a digit or @, chosen by hash of the id.

    Ids are chosen first, so that only those meet in one task. Of rows that
    share an id the smallest text counts; rows without an id are not fitted on.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter("doc_id IS NOT NULL").filter(F.col("text").rlike("[0-9@]"))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # chosen has ``most`` numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[(t.start, t.end, t.label, t.features, t.key) for t in tokens(x, base_spans(x))] for x in b.column("text").to_pylist()]
            cols = [pa.array([[t[i] for t in r] for r in rows], pa.list_(k)) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "s", "e", "y", "x", "k"])

    got = texts.mapInArrow(run, "doc_id long, s array<long>, e array<long>, y array<long>, x array<array<long>>, k array<string>").collect()
    return fit([[Token(*t) for t in zip(r.s, r.e, r.y, r.x, r.k, strict=True)] for r in sorted(got, key=lambda r: r.doc_id)])


def disjoint(base: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Base spans and those further ones that touch none of them."""
    return base + [x for x in more if not any(x[0] < e and s < x[1] for s, e in base)]


def all_spans(texts: list[str], model: Field) -> tuple[list[list[list[tuple[int, int]]]], list[list[list[tuple[int, int]]]]]:
    """Of each text the base spans by kind, and all spans by kind with the secrets (keys and what the field adds) last."""
    base = [base_spans(t) for t in texts]
    more = added([tokens(t, s) for t, s in zip(texts, base, strict=True)], model)
    keys = [[m.span() for m in KEYS.finditer(t)] for t in texts]
    return base, [[disjoint(x, y) for x, y in zip([*s, k], m, strict=True)] for s, k, m in zip(base, keys, more, strict=True)]


def joined(spans: list[list[tuple[int, int]]]) -> str:
    """kind:start:end by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{s}:{e}" for k, found in zip(KINDS, spans, strict=True) for s, e in sorted(found))


def find(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, n_email, ..., base (spans of the patterns), spans (base and added), n_added, n_secret and n_found of every whole text.

    base and spans have kind:start:end joined. n_found counts spans and secrets.
    Null counts as the empty text, which has no spans. Repeated rows get the
    same spans; other columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = all_spans(b.column("text").to_pylist(), shared.value)
            counts = [pa.array([len(s[k]) for s in base], pa.int64()) for k in range(len(KINDS))]
            n = [(sum(map(len, x)), len(x[-1]), sum(map(len, s))) for s, x in zip(base, every, strict=True)]
            more = [pa.array([f(*x) for x in n], pa.int64()) for f in (lambda a, k, s: a - k - s, lambda a, k, s: k, lambda a, k, s: a)]
            spelled = [pa.array([joined(s) for s in base], pa.string()), pa.array([joined(s[:-1]) for s in every], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *spelled, *more], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added", "n_secret", "n_found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long, n_secret long, n_found long")


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """docs with each span and secret of ``text`` replaced by its kind in brackets; of overlapping spans the first stays."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for t, found in zip(texts, all_spans([t or "" for t in texts], shared.value)[1], strict=True):
                parts, at = [], 0
                for s, e, k in sorted((s, e, k) for k, kind in zip([*KINDS, "secret"], found, strict=True) for s, e in kind):
                    if s >= at:
                        parts += [t[at:s], f"[{k}]"]
                        at = e
                out.append(None if t is None else "".join([*parts, t[at:]]))
            i = b.schema.names.index("text")
            yield pa.RecordBatch.from_arrays([*b.columns[:i], pa.array(out, pa.string()), *b.columns[i + 1 :]], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find(docs, train(docs))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", "n_secret", "n_found")
