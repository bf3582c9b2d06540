"""Edits of source, configuration and Markdown texts, as tables of new texts: nothing is changed in place."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import sections as C
from ..operators import symbols as S
from ..operators import tokens as T
from ..sources import files


def replaced_lines(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts(rel_path, text) with edits(rel_path, first, last, new) done: lines first to last (from 1) become ``new``, or go where it is null.

    Edits of a file are done from the end, so that places stay right; of those
    that overlap the one that begins last is done.
    """
    own = edits.groupBy("rel_path").agg(F.sort_array(F.collect_list(F.struct("first", "last", "new")), asc=False).alias("edits"))
    lines = F.split("text", "\n", -1)
    start = F.struct(lines.alias("lines"), F.lit(2**31 - 1).alias("from"))

    def step(acc: Column, e: Column) -> Column:
        n = F.size(acc["lines"])
        head, tail = F.slice(acc["lines"], F.lit(1), e["first"] - 1), F.slice(acc["lines"], e["last"] + 1, F.greatest(n - e["last"], F.lit(0)))
        new = F.when(e["new"].isNull(), F.array().cast("array<string>")).otherwise(F.split(e["new"], "\n", -1))
        fits = e["last"] < acc["from"]
        return F.struct(F.when(fits, F.concat(head, new, tail)).otherwise(acc["lines"]).alias("lines"), F.when(fits, e["first"]).otherwise(acc["from"]).cast("int").alias("from"))

    done = F.array_join(F.aggregate("edits", start, step)["lines"], "\n")
    cast = own.withColumn("edits", F.col("edits").cast("array<struct<first:int,last:int,new:string>>"))
    return texts.join(cast, "rel_path", "left").withColumn("text", F.when(F.col("edits").isNotNull(), done).otherwise(F.col("text"))).drop("edits")


def replaced_symbols(texts: DataFrame, target: str, new: str | None) -> DataFrame:
    """texts(rel_path, ext, text) with the first definition that ``name`` or ``kind:name`` means replaced, or deleted where ``new`` is null."""
    found = S.first_definition(T.definitions(texts), target)
    edits = found.select("rel_path", F.col("line_no").alias("first"), F.col("line_end").alias("last"), F.lit(new).cast("string").alias("new"))
    return replaced_lines(texts, edits)


def replaced_section(texts: DataFrame, title: str, body: str) -> DataFrame:
    """Markdown texts(rel_path, text) with what stands under the first heading of this title, its subsections too, replaced."""
    rows = files.lines(texts)
    last = rows.groupBy("rel_path").agg(F.max("line_no").alias("__last"))
    heads = C.section_ends(C.headings(rows).join(last, "rel_path"), "rel_path", "line_no", "level", F.col("__last"))
    hit = heads.filter(F.lower("title") == title.lower()).groupBy("rel_path").agg(F.min(F.struct("line_no", "end")).alias("h"))
    n = F.col("h.line_no")
    own = texts.select("rel_path", F.split("text", "\n", -1).alias("lines")).join(hit, "rel_path")
    edits = own.select("rel_path", n.alias("first"), F.col("h.end").alias("last"), F.concat(F.get("lines", n - 1), F.lit("\n\n"), F.lit(body.strip("\n")), F.lit("\n")).alias("new"))
    return replaced_lines(texts, edits)


def patched_config(texts: DataFrame, path: str, value: object = None, delete: bool = False) -> DataFrame:
    """texts(rel_path, text) of JSON, YAML and TOML with the value at a dotted path set or deleted, and error for those that cannot be read.

    JSON and YAML are written anew with two blanks of indentation; of TOML only
    the line of the key changes, in its table, and a new one is added at the
    table's end. A step that is a number is a place in a list.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for name, text in zip(b.column("rel_path").to_pylist(), b.column("text").to_pylist(), strict=True):
                try:
                    got.append((patched(name.rpartition(".")[2].lower(), text or "", path.split("."), value, delete), None))
                except Exception as e:  # the parsers raise errors of many kinds
                    got.append((text, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([b.column("rel_path"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["rel_path", "text", "error"])

    return texts.select("rel_path", "text").mapInArrow(run, "rel_path string, text string, error string")


def patched(ext: str, text: str, steps: list[str], value: object, delete: bool) -> str:
    if ext == "toml":
        return patched_toml(text, steps, value, delete)
    if ext == "json":
        tree = json.loads(text)
    else:
        import yaml

        tree = yaml.safe_load(text) or {}
    node = tree
    for step in steps[:-1]:
        node = node[int(step)] if isinstance(node, list) else node.setdefault(step, {})
    last = int(steps[-1]) if isinstance(node, list) else steps[-1]
    if delete:
        if isinstance(node, list) or last in node:
            del node[last]
    elif isinstance(node, list) and last == len(node):
        node.append(value)
    else:
        node[last] = value
    if ext == "json":
        return json.dumps(tree, indent=2, ensure_ascii=False) + "\n"
    return yaml.safe_dump(tree, sort_keys=False, allow_unicode=True)


def toml_value(value: object) -> str:
    """A scalar or list as TOML writes it; JSON's strings and numbers are TOML's too."""
    return "[" + ", ".join(map(toml_value, value)) + "]" if isinstance(value, list) else json.dumps(value, ensure_ascii=False)


def patched_toml(text: str, steps: list[str], value: object, delete: bool) -> str:
    tomllib.loads(text)
    table, key, lines = ".".join(steps[:-1]), steps[-1], text.splitlines()
    at = 0 if not table else next((i + 1 for i, x in enumerate(lines) if x.strip() == f"[{table}]"), None)
    if at is None:
        if delete:
            return text
        lines += ([""] if lines else []) + [f"[{table}]"]
        at = len(lines)
    end = next((i for i in range(at, len(lines)) if lines[i].lstrip().startswith("[")), len(lines))
    old = next((i for i in range(at, end) if re.match(rf"\s*{re.escape(key)}\s*=", lines[i])), None)
    if delete:
        lines = lines if old is None else lines[:old] + lines[old + 1 :]
    elif old is not None:
        lines[old] = f"{key} = {toml_value(value)}"
    else:
        while end > at and not lines[end - 1].strip():
            end -= 1
        lines.insert(end, f"{key} = {toml_value(value)}")
    out = "\n".join(lines) + "\n"
    tomllib.loads(out)
    return out
