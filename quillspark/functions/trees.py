"""Places of values in JSON texts, and edits that leave all other bytes as they are."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A string, a mark, or a number or word; whatever else is no JSON.
PART = re.compile(rb'"(?:[^"\\]|\\.)*"|[\[\]{},:]|[^\s\[\]{},:"]+', re.S)
PLACES = "path string, first_byte long, last_byte long, kind string"


def places(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Dotted path, first byte, last byte (exclusive) and kind of every value in a JSON text, a container behind what it holds; the whole has the empty path.

    Members go by name, elements by number from 0. A text that is no JSON has
    none; of repeated names each is told.
    """
    try:
        json.loads(raw)
    except ValueError:
        return
    stack: list[list] = []  # opening byte, kind, path, name or number of the next value

    def path() -> str:
        return "" if not stack else str(stack[-1][3]) if not stack[-1][2] else f"{stack[-1][2]}.{stack[-1][3]}"

    for m in PART.finditer(raw):
        token = m[0]
        if token in b"[{":
            stack.append([m.start(), "list" if token == b"[" else "object", path(), 0 if token == b"[" else None])
        elif token in b"]}":
            start, kind, own, _ = stack.pop()
            yield own, start, m.end(), kind
        elif token == b",":
            stack[-1][3] = stack[-1][3] + 1 if stack[-1][1] == "list" else None
        elif token == b":":
            continue
        elif stack and stack[-1][1] == "object" and stack[-1][3] is None:
            stack[-1][3] = json.loads(token)
        else:
            yield path(), m.start(), m.end(), "string" if token[:1] == b'"' else "bool" if token in (b"true", b"false") else "null" if token == b"null" else "number"


def byte_ranges(rows: DataFrame, json_col: str) -> DataFrame:
    """rows with path, first_byte, last_byte (exclusive) and kind for each value of a JSON column, in bytes of its UTF-8; rows without JSON have none.

    A path is dotted, as ``dot_path`` reads it. Columns of those names are replaced.
    """
    kept = rows.drop("path", "first_byte", "last_byte", "kind")
    mark = "_json"
    while mark in kept.columns:
        mark = f"_{mark}"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [PLACES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, raw in enumerate(b.column(mark).to_pylist()):
                got = list(places(raw)) if raw is not None else []
                at += [i] * len(got)
                found += got
            own = b.take(pa.array(at, pa.int64())).drop_columns([mark])
            cells = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x, t) for x, t in zip(cells, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=[*own.schema.names, "path", "first_byte", "last_byte", "kind"])

    return kept.withColumn(mark, F.col(json_col).cast("binary")).mapInArrow(run, schema)


def spliced(rows: DataFrame, json_col: str, path: str, value: str) -> DataFrame:
    """rows with the value at a dotted path of a JSON column replaced by a JSON text; all other bytes stay. Rows without the path stay as they are.

    Of several values of one path the first is replaced.
    """
    number = "_number"
    while number in rows.columns:
        number = f"_{number}"
    each = rows.withColumn(number, F.xxhash64(json_col))
    distinct = each.select(number, json_col).dropDuplicates([number, json_col])
    hit = byte_ranges(distinct, json_col).filter(F.col("path") == path).groupBy(number, json_col).agg(F.min(F.struct("first_byte", "last_byte")).alias("r"))
    raw = F.col(json_col).cast("binary")
    new = F.concat(F.substring(raw, F.lit(1), F.col("r.first_byte").cast("int")), F.lit(value).cast("binary"), F.substring(raw, F.col("r.last_byte").cast("int") + 1, F.octet_length(raw))).cast("string")
    changed = hit.select(number, json_col, new.alias("__new"))
    out = each.join(changed, [number, json_col], "left").withColumn(json_col, F.coalesce("__new", json_col))
    return out.select(*rows.columns)
