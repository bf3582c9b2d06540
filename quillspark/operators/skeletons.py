"""Skeletons: source texts reduced to what other files need to know of them (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import code as K
from ..functions import text as X
from . import symbols as S
from . import tokens as T

#: Lines that look like definitions in any language, and the texts for minified and unstructured files.
DEFINES = r"^\s*(?:function|class|def|func|struct|interface|enum)\s+[a-zA-Z0-9_]|^\s*(?:public|private|protected)?\s*(?:static\s*)?(?:fn|var|val|func)\s+[a-zA-Z0-9_]"
MINIFIED, UNSTRUCTURED, GAP = "/* MINIFIED_OR_GENERATED — skipped */\n", "/* TRUNCATED */\n", "...\n"
#: How the hint for left-out imports names them.
HINTS = {"rust": "uses", "csharp": "usings"}


def pruned(texts: DataFrame) -> DataFrame:
    """rel_path, ext, line_no, raw and kept of each line: bodies of functions that hold no other function are not kept.

    A function's first and last line stay, so that a class keeps the signatures of its methods.
    """
    lines = S.code_lines(texts)
    own = T.bodies(texts).filter(F.col("kind").isin(S.CALLABLE)).select("rel_path", "ext", F.col("head_end").alias("low"), F.col("line_end").alias("high")).filter("high > low")
    after = Window.partitionBy("rel_path").orderBy("low")
    inner = own.withColumn("next", F.lead("low").over(after)).filter("next IS NULL OR next > high")
    last = F.when(F.col("ext").isin("py", "rb"), F.col("high")).otherwise(F.col("high") - 1)
    gone = inner.filter(last > F.col("low")).select("rel_path", F.explode(F.sequence(F.col("low") + 1, last)).alias("line_no")).withColumn("gone", F.lit(True))
    return lines.join(gone, ["rel_path", "line_no"], "left").select("rel_path", "ext", "line_no", "raw", F.col("gone").isNull().alias("kept"))


def skeletons(texts: DataFrame, flat: bool = True) -> DataFrame:
    """rel_path and skeleton of texts(rel_path, ext, text) in known languages; others have null.

    In this order: bodies go, comments go (TODO and FIXME stay), imports go and
    are counted in a first line, lines lose their indentation (not in Python)
    and trailing blanks, and empty lines go. Minified texts have null.
    """
    known = texts.filter(K.language(F.col("ext")).isNotNull() & ~X.minified(F.col("text")))
    plain = known.withColumn("text", K.uncommented(F.col("text"), F.col("ext")))
    rows = pruned(plain).filter("kept")
    used = S.imports(rows.select("rel_path", "ext", "line_no", F.col("raw").alias("line"))).select("rel_path", "line_no").withColumn("import", F.lit(True))
    rows = rows.join(used, ["rel_path", "line_no"], "left")
    body = F.rtrim("raw")
    shown = F.when(F.lit(flat) & (F.col("ext") != "py"), F.ltrim(body)).otherwise(body)
    each = rows.groupBy("rel_path", "ext").agg(F.count("import").alias("n"), F.array_sort(F.collect_list(F.when(F.col("import").isNull() & (F.trim("raw") != ""), F.struct("line_no", shown.alias("x"))))).alias("rows"))
    hint = F.format_string("// ... (%d %s)\n", "n", F.coalesce(K.lookup(HINTS, K.language(F.col("ext"))), F.lit("imports")))
    text = F.concat(F.when(F.col("n") > 0, hint).otherwise(""), F.array_join(F.transform("rows", lambda r: r["x"]), "\n"))
    return texts.select("rel_path").join(each.select("rel_path", text.alias("skeleton")), "rel_path", "left")


def universal(text: Column, most: int = 600, otherwise: int = 50) -> Column:
    """Lines of a text of any language that look like definitions or hold TODO or FIXME, without the blanks around them, a gap's mark for what is left out between them.

    After ``most`` such lines the mark ends the text, if it goes on. A text
    without such lines gives its first ``otherwise``, a minified one a note.
    """
    lines = F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.slice(F.filter(numbered, lambda r: r["x"].rlike(DEFINES) | X.todo(r["x"])), 1, most)
    gap = lambda r, k: F.when((k > 0) & (r["i"] > F.coalesce(F.get(kept, k - 1)["i"], F.lit(0)) + 1), GAP).otherwise("")
    shown = F.array_join(F.transform(kept, lambda r, k: F.concat(gap(r, k), bare(r["x"]), F.lit("\n"))), "")
    cut = F.when((F.size(kept) == most) & (F.size(lines) > F.get(kept, F.lit(most - 1))["i"] + 1), GAP).otherwise("")
    head = F.concat(F.lit(UNSTRUCTURED), F.array_join(F.transform(F.slice(lines, 1, otherwise), bare), "\n"), F.lit("\n"))
    return F.when(X.minified(text), MINIFIED).when(F.size(kept) > 0, F.concat(shown, cut)).when(text.isNotNull(), head)
