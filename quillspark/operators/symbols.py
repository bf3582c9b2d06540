"""Definitions, imports, implementations and calls in source lines, found by patterns (DataFrame operations only).

Input is lines(rel_path, ext, line_no, line), or texts(rel_path, ext, text)
where comments and strings must not count; nothing is parsed, so that a
definition must start on a line of its own. Null texts and lines hold nothing.
A file is bounded (sources.files leaves large ones out), so that what belongs to
one file may meet in one row.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import code as K
from ..functions import text as X
from ..functions.names import casing_variants
from . import relational as R
from . import tokens as T

NAME = r"([\p{L}_$][\p{L}\p{N}_$]*)"
#: For each ending, kinds of symbols and the patterns of their first lines; group 1 is the name.
DEFINITIONS = {
    "py": {"function": rf"^\s*(?:async\s+)?def\s+{NAME}", "class": rf"^\s*class\s+{NAME}"},
    "rs": {kind: rf"^\s*(?:pub(?:\([^)]*\))?\s+)?{words}\s+{NAME}" for kind, words in {
        "function": r"(?:const\s+|async\s+|unsafe\s+)*fn", "struct": "struct", "enum": "enum", "trait": r"(?:unsafe\s+)?trait", "type": "type", "static": r"static(?:\s+mut)?"}.items()}
    | {"const": rf"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(?!fn\b){NAME}\s*:"},
    "ts": {
        "function": rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{NAME}",
        "class": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{NAME}",
        "const": rf"^\s*(?:export\s+)?const\s+{NAME}",
        "interface": rf"^\s*(?:export\s+)?interface\s+{NAME}",
    },
    "go": {"function": rf"^func\s+(?:\([^)]*\)\s*)?{NAME}", "type": rf"^type\s+{NAME}"},
    "java": {
        "class": rf"^\s*(?:(?:public|private|protected|abstract|final|static|sealed)\s+)*(?:class|interface|enum|record)\s+{NAME}",
        "method": rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|override|virtual|async)\s+)+[\w<>\[\],.?\s]*?\b{NAME}\s*\(",
    },
    "c": {"struct": rf"^\s*(?:typedef\s+)?(?:struct|enum|union|class)\s+{NAME}\s*\{{", "function": rf"^[A-Za-z_][\w\s*&:<>,]*?[\s*&]{NAME}\s*\([^;]*$"},
    "php": {"function": rf"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?{NAME}", "class": rf"^\s*(?:(?:abstract|final)\s+)?(?:class|interface|trait)\s+{NAME}"},
    "rb": {"function": r"^\s*def\s+(?:self\.)?([\p{L}_][\p{L}\p{N}_]*[?!=]?)", "class": rf"^\s*(?:class|module)\s+{NAME}"},
    "proto": {"message": rf"^\s*(?:message|enum|service)\s+{NAME}", "rpc": rf"^\s*rpc\s+{NAME}"},
}
DEFINITIONS["ts"] |= {
    "arrow": rf"^\s*(?:export\s+)?(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s+)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>",
    "method": rf"^\s+(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b|else\b){NAME}\s*\([^;]*\)\s*(?::[^{{;]+)?\{{\s*$",
}
DEFINITIONS["dart"] = {"class": rf"^\s*(?:abstract\s+)?class\s+{NAME}", "function": rf"^\s*[\w<>?]+\s+{NAME}\s*\([^;]*\)\s*(?:async\s*)?\{{"}
#: Kinds that hold calls.
CALLABLE = T.CALLABLE
#: What makes a symbol visible to other files, by ending.
EXPORTS = {"rs": r"^\s*pub\s+(?:async\s+|const\s+|unsafe\s+)*(?:fn|struct|enum|trait)\s+(\w+)", "ts": rf"^\s*export\s+(?:default\s+)?(?:abstract\s+|async\s+)*(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+{NAME}"}
#: Words that stand before brackets but call nothing, and calls so common that they tell nothing.
NO_CALLS = "if for while switch match return catch function fn def class new await typeof sizeof in is not and or else elif loop yield assert print println format vec panic".split()
COMMON_CALLS = "clone to_string to_owned into from default trim len push pop clear iter collect map filter fold any all find next unwrap expect ok err contains split replace get set insert remove join extend append keys values items log str int list dict range".split()
IMPORTS = {"py": r"^\s*(?:from\s+(\S+)\s+import\b|import\s+\S)", "java": r"^\s*(?:import|using)\s+([\w.*\s]+);", "c": r"^\s*#\s*include\s+[<\"]([^>\"]+)", "rs": r"^\s*(?:pub\s+)?use\s+([^;]+);", "ts": r"^\s*(?:import|export)\b.*?['\"]([^'\"]+)['\"]"}
IMPLEMENTS = {"rs": r"^\s*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?:[\w:]+::)?(\w+)(?:<.*?>)?\s+for\s+([\w:]+)", "ts": rf"\bclass\s+()?{NAME}[^{{]*?\bimplements\s+([\w\s,.]+)"}
ALIASES = {"tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "cjs": "ts", "cs": "java", "h": "c", "cpp": "c", "cc": "c", "hpp": "c"}


def _language():
    same = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(same, F.col("ext")), F.col("ext"))


def symbols(lines: DataFrame) -> DataFrame:
    """rel_path, name, kind and line_no of each definition; other endings give none."""
    found = [
        F.when((_language() == ext) & F.col("line").rlike(pattern), F.struct(F.regexp_extract("line", pattern, 1).alias("name"), F.lit(kind).alias("kind")))
        for ext, kinds in DEFINITIONS.items()
        for kind, pattern in kinds.items()
    ]
    return lines.select("rel_path", "line_no", F.explode(F.array_compact(F.array(*found))).alias("s")).select("rel_path", "s.name", "s.kind", "line_no")


def imports(lines: DataFrame) -> DataFrame:
    """rel_path, line_no and what the line imports, for the endings of IMPORTS."""
    found = F.coalesce(*[F.when((_language() == e) & F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for e, p in IMPORTS.items()])
    return lines.select("rel_path", "line_no", found.alias("imports")).filter("imports IS NOT NULL")


def implementations(lines: DataFrame, trait: str) -> DataFrame:
    """rel_path, line_no and type of each implementation of the trait or interface."""
    rs, ts = IMPLEMENTS["rs"], IMPLEMENTS["ts"]
    named = F.transform(F.split(F.regexp_extract("line", ts, 3), ","), lambda x: F.regexp_extract(x, r"(\w+)\s*$", 1))
    kind = F.when((_language() == "rs") & (F.regexp_extract("line", rs, 1) == trait), F.regexp_extract("line", rs, 2))
    kind = kind.when((_language() == "ts") & F.array_contains(named, trait), F.regexp_extract("line", ts, 2))
    return lines.select("rel_path", "line_no", kind.alias("type")).filter("type IS NOT NULL")


def skeleton(lines: DataFrame) -> DataFrame:
    """rel_path, line_no, line of definitions and imports, with the number of lines left out before each in ``gap``."""
    kept = symbols(lines).select("rel_path", "line_no").union(imports(lines).select("rel_path", "line_no")).distinct()
    before = F.lag("line_no", 1, 0).over(Window.partitionBy("rel_path").orderBy("line_no"))
    return lines.join(kept, ["rel_path", "line_no"]).select("rel_path", "line_no", "line", (F.col("line_no") - before - 1).alias("gap"))


def code_lines(texts: DataFrame) -> DataFrame:
    """rel_path, ext, line_no, raw (the line) and line (without comments and strings) of texts(rel_path, ext, text)."""
    both = texts.select("rel_path", "ext", "text", K.code_only(F.col("text"), F.col("ext")).alias("__code"))
    split = lambda c: F.split(F.coalesce(c, F.lit("")), "\n", -1)
    pairs = F.arrays_zip(split(F.col("text")).alias("raw"), split(F.col("__code")).alias("line"))
    return both.select("rel_path", "ext", F.posexplode(pairs).alias("line_no", "p")).select("rel_path", "ext", (F.col("line_no") + 1).alias("line_no"), "p.raw", "p.line")


def exports(lines: DataFrame) -> DataFrame:
    """rel_path and the sorted different names that the file shows to others."""
    found = F.coalesce(*[F.when((_language() == e) & F.col("line").rlike(p), F.regexp_extract("line", p, 1)) for e, p in EXPORTS.items()])
    return lines.select("rel_path", found.alias("e")).filter("e IS NOT NULL").groupBy("rel_path").agg(F.sort_array(F.collect_set("e")).alias("exports"))


def analysis(texts: DataFrame) -> DataFrame:
    """rel_path, imports, exports (sorted, each once) and symbols (by line and name) of each file; minified ones have none."""
    full = texts.filter(~X.minified(F.col("text")))
    lines = code_lines(full)
    used = imports(lines.withColumn("line", F.col("raw"))).groupBy("rel_path").agg(F.sort_array(F.collect_set("imports")).alias("imports"))
    cells = F.struct("line_no", "name", "kind", "line_end", "signature")
    defined = T.definitions(full).groupBy("rel_path").agg(F.sort_array(F.collect_list(cells)).alias("symbols"))
    out = texts.select("rel_path")
    for part in (used, exports(lines), defined):
        out = out.join(part, "rel_path", "left")
    nothing = F.array().cast("array<string>")
    return out.select("rel_path", F.coalesce("imports", nothing).alias("imports"), F.coalesce("exports", nothing).alias("exports"), F.coalesce("symbols", F.array().cast(defined.schema["symbols"].dataType)).alias("symbols"))


def word(names: Sequence[str]) -> str:
    return r"(?<![\w$])(?:" + "|".join(map(re.escape, names)) + r")(?![\w$])"


def usages(texts: DataFrame, name: str, around: int = 2) -> DataFrame:
    """rel_path, line_no, category and context of each line of code that uses the name, comments and strings aside; by category, file and line.

    The category is told by the syntax around the name (``tokens.uses``); of several in a line the first of CATEGORIES.
    Texts of other languages have lines of no category.

    Texts without the name are left out before anything is cut.
    """
    some = texts.filter(F.contains("text", F.lit(name)) & F.is_valid_utf8("text"))
    told = T.uses(T.tokens(some), name)
    rank = F.array_position(F.array(*[F.lit(c) for c in K.CATEGORIES]), F.col("category"))
    told = R.first_per(told, ["rel_path", "line_no"], [rank]).drop("rank")
    plain = code_lines(some.filter(~F.coalesce(K.language(F.col("ext")).isin(list(T.PATTERNS)), F.lit(False)))).filter(F.col("line").rlike(word([name])))
    used = told.unionByName(plain.select("rel_path", "line_no", F.lit(K.CATEGORIES[-1]).alias("category")))
    context = X.context_window(F.split("text", "\n", -1), F.col("line_no"), around)
    return used.join(some.select("rel_path", "text"), "rel_path").select("rel_path", "line_no", "category", context.alias("context")).orderBy(rank, "rel_path", "line_no")


def usage_counts(texts: DataFrame, name: str) -> DataFrame:
    """Uses by category."""
    return usages(texts, name).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def outgoing(texts: DataFrame, name: str) -> DataFrame:
    """rel_path, caller_line, callee and line_no of the calls within each definition of the name; of each callee the first.

    Words that call nothing, calls that are common everywhere, and the definition's own first line are left out.
    """
    some = texts.filter(F.contains("text", F.lit(name)))
    lines = code_lines(some)
    own = T.definitions(some).filter(F.col("name") == name).select("rel_path", F.col("line_no").alias("caller_line"), "line_end")
    targets = F.explode(F.regexp_extract_all("line", F.lit(r"([\p{L}_$][\p{L}\p{N}_$.:]*)\s*!?\("), 1)).alias("target")
    calls = lines.join(own, "rel_path").filter((F.col("line_no") > F.col("caller_line")) & (F.col("line_no") <= F.col("line_end")))
    calls = calls.select("rel_path", "caller_line", "line_no", targets).withColumn("callee", K.called_name(F.col("target"))).filter("callee IS NOT NULL")
    calls = calls.filter(~F.col("callee").isin(NO_CALLS + COMMON_CALLS))
    return R.first_per(calls.select("rel_path", "caller_line", "callee", "line_no"), ["rel_path", "caller_line", "callee"], [F.col("line_no")]).drop("rank")


def incoming(texts: DataFrame, name: str, most: int = 30) -> DataFrame:
    """rel_path, line_no, caller (the tightest definition around it, null outside) of the first ``most`` calls of the name by file and line."""
    some = texts.filter(F.contains("text", F.lit(name)))
    lines, found = code_lines(some), T.definitions(some)
    calls = lines.filter(F.col("line").rlike(rf"(?<![\w$]){re.escape(name)}\s*\(")).join(found.filter(F.col("name") == name), ["rel_path", "line_no"], "left_anti")
    calls = calls.select("rel_path", "line_no").orderBy("rel_path", "line_no").limit(most)
    spans = found.filter(F.col("kind").isin(CALLABLE)).select("rel_path", F.col("name").alias("caller"), F.col("line_no").alias("low"), F.col("line_end").alias("high"))
    return R.tightest_interval(calls, spans, "rel_path", "line_no", "low", "high", "caller", width=200)


def blast_radius(texts: DataFrame, name: str) -> DataFrame:
    """section (definition, outgoing, incoming), rel_path, line_no and other (kind, callee or caller) of all that a change of the name may touch."""
    own = T.definitions(texts.filter(F.contains("text", F.lit(name)))).filter(F.col("name") == name)
    part = lambda df, section, other: df.select(F.lit(section).alias("section"), "rel_path", "line_no", F.col(other).alias("other"))
    return part(own, "definition", "kind").unionByName(part(outgoing(texts, name), "outgoing", "callee")).unionByName(part(incoming(texts, name), "incoming", "caller"))


def read_symbols(texts: DataFrame, name: str, most_lines: int = 500) -> DataFrame:
    """instance (from 0, by file and line), rel_path, kind, line_no, line_end and source of each definition of the name.

    Where no name is equal, those that differ only in case count. A source longer than ``most_lines`` is cut and says so.
    """
    some = texts.filter(F.contains(F.lower("text"), F.lit(name.lower())))
    found = T.definitions(some).filter(F.lower("name") == name.lower()).withColumn("exact", F.col("name") == name)
    found = found.withColumn("any", F.max("exact").over(Window.partitionBy(F.lit(1)))).filter("exact OR NOT any")  # definitions of one name
    n = F.col("line_end") - F.col("line_no") + 1
    body = F.array_join(F.slice(F.split("text", "\n", -1), F.col("line_no"), F.least(n, F.lit(most_lines))), "\n")
    source = F.when(n > most_lines, F.concat(body, F.format_string("\n... (%d lines more)", n - most_lines))).otherwise(body)
    rank = F.row_number().over(Window.orderBy("rel_path", "line_no")) - 1
    return found.join(some.select("rel_path", "text"), "rel_path").select(rank.alias("instance"), "rel_path", "kind", "line_no", "line_end", source.alias("source"))


def first_definition(defined: DataFrame, target: str) -> DataFrame:
    """Of ``tokens.definitions`` the first row by file and line that ``name`` or ``kind:name`` means."""
    hit = (F.col("name") == target) | (F.concat_ws(":", "kind", "name") == target)
    return defined.filter(hit).orderBy("rel_path", "line_no").limit(1)


#: What a file's ending says of its part in a change.
DOMAINS = {"proto": ["proto"], "rust": ["rs"], "typescript": ["ts", "tsx", "js", "jsx", "mjs", "cjs"], "python": ["py"]}


def propagation(texts: DataFrame, name: str, aliases: Sequence[str] = (), most: int = 50) -> DataFrame:
    """domain, rel_path, uses and first_lines (five, then an ellipsis) of files that use the name or an alias in any casing; the ``most`` first by domain and path."""
    names = list(dict.fromkeys(v for n in [name, *aliases] for v in casing_variants(n)))
    some = texts.filter(reduce(or_, [F.contains("text", F.lit(n)) for n in names]))
    used = code_lines(some).filter(F.col("line").rlike(word(names)))
    domain = F.lit("other")
    for k, endings in DOMAINS.items():
        domain = F.when(F.col("ext").isin(endings), k).otherwise(domain)
    nth = F.row_number().over(Window.partitionBy("rel_path").orderBy("line_no"))
    files = used.withColumn("nth", nth).groupBy("rel_path", domain.alias("domain")).agg(
        F.count(F.lit(1)).alias("uses"), F.sort_array(F.collect_list(F.when(F.col("nth") <= 5, F.col("line_no")))).alias("lines"))
    first = F.concat(F.array_join(F.col("lines").cast("array<string>"), ", "), F.when(F.col("uses") > 5, ", …").otherwise(""))
    return files.select("domain", "rel_path", "uses", first.alias("first_lines")).orderBy("domain", "rel_path").limit(most)


def bridges(lines: DataFrame, name: str) -> DataFrame:
    """side, rel_path and line_no where the name crosses from Rust commands to scripts that invoke them."""
    names = casing_variants(name)
    with_name = lines.filter(F.col("line").rlike(word(names))).select("rel_path").distinct()
    rust = lines.filter((F.col("ext") == "rs") & F.col("line").rlike(r"#\[(?:tauri::)?command")).join(with_name, "rel_path", "left_semi")
    script = lines.filter((_language() == "ts") & F.contains("line", F.lit("invoke(")) & F.col("line").rlike(word(names)))
    side = lambda df, k: df.select(F.lit(k).alias("side"), "rel_path", "line_no")
    return side(rust, "command").unionByName(side(script, "invoke"))


def overview(texts: DataFrame, pattern: str = "", deep: int = 30, shallow: int = 150) -> DataFrame:
    """level, folder, rel_path and symbols of the files whose path meets the pattern: of up to ``deep`` files their first 20
    public symbols by line (shown by kind and name), of up to ``shallow`` their paths, of more only folders with their number of files."""
    kept = texts.filter(X.path_matches(F.col("rel_path"), pattern))
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    n = kept.count()
    if n > shallow:
        return kept.groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).cast("string").alias("symbols")).select(F.lit("folders").alias("level"), "folder", F.lit(None).cast("string").alias("rel_path"), "symbols")
    files = kept.select(F.lit("files" if n > deep else "deep").alias("level"), folder.alias("folder"), "rel_path")
    if n > deep:
        return files.withColumn("symbols", F.lit(None).cast("string"))
    public = T.definitions(kept).filter(K.is_public(F.col("name"), F.col("ext")))
    first = R.first_per(public, ["rel_path"], [F.col("line_no"), F.col("name")], 20)
    shown = first.groupBy("rel_path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "name"))), lambda x: F.concat_ws(" ", x["kind"], x["name"])), ", ").alias("symbols"))
    return files.join(shown, "rel_path", "left").select("level", "folder", "rel_path", "symbols")


def callers(lines: DataFrame, name: str) -> DataFrame:
    """rel_path, line_no and innermost definition around each line that calls name; null outside of definitions.

    A definition reaches to the line before the file's next one.
    """
    found = symbols(lines)
    spans = R.territory(found.select("rel_path", "line_no", "name"), "rel_path", "line_no", F.lit(2**31 - 1))
    call = lines.filter(F.col("line").rlike(rf"(?<![\w$]){re.escape(name)}\s*\(")).join(found.filter(F.col("name") == name), ["rel_path", "line_no"], "left_anti")
    spans = spans.select("rel_path", F.col("name").alias("caller"), F.col("line_no").alias("low"), F.col("end").alias("high"))
    return R.tightest_interval(call.select("rel_path", "line_no"), spans, "rel_path", "line_no", "low", "high", "caller")
