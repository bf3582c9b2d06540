"""Edits of configuration texts and documents for a context, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import crunch


def set_env(text: Column, key: str, value: str) -> Column:
    """The text of an .env file with key set: the first line that sets it is replaced, else one is added at the end."""
    lines = env_lines(text)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(rf"^\s*{re.escape(key)}\s*=")), True)
    new = F.lit(f"{key}={value}")
    swapped = F.transform(lines, lambda x, i: F.when(i + 1 == at, new).otherwise(x))
    return F.concat(F.array_join(F.when(at > 0, swapped).otherwise(F.array_append(lines, new)), "\n"), F.lit("\n"))


def delete_env(text: Column, key: str) -> Column:
    """The text of an .env file without the lines that set key."""
    return F.concat(F.array_join(F.filter(env_lines(text), lambda x: ~x.rlike(rf"^\s*{re.escape(key)}\s*=")), "\n"), F.lit("\n"))


def env_lines(text: Column) -> Column:
    """Lines without their ends; an end at the text's end starts no further line, and an empty or null text has none."""
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r?\n\z", "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def file_element(path: Column, text: Column) -> Column:
    """A file of a context document: crunched text as character data, whose end mark is split, and an escaped path."""
    safe = path
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    body = F.replace(crunch(text), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit('<file path="'), safe, F.lit('"><![CDATA['), body, F.lit("]]></file>"))


def tail(text: Column, n: int) -> Column:
    """The last n lines."""
    lines = F.split(text, "\n", -1)
    return F.array_join(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n), "\n")
