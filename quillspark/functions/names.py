"""Spellings of a name."""

from __future__ import annotations

import re

WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+|[^\W\d_]+")


def casing_variants(name: str) -> list[str]:
    """The name, and it in Pascal, camel and snake case, each once; words in capitals stay so in Pascal case."""
    words = WORD.findall(name)
    pascal = "".join(w if w.isupper() and len(w) > 1 else w[:1].upper() + w[1:].lower() for w in words)
    camel = words[0].lower() + "".join(w[:1].upper() + w[1:].lower() for w in words[1:]) if words else ""
    return list(dict.fromkeys(x for x in (name, pascal, camel, "_".join(w.lower() for w in words)) if x))
