"""Tokens of source texts with their nesting, and what follows from it: definitions over many lines and the syntax around a name.

A scanner passes each file once and tells, for every token, its class, how deep
it lies and which bracket encloses it. Everything else is windows and joins
over rows of tokens. A file is bounded (sources.files leaves large ones out).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import code as K
from ..functions import text as X
from ..sources.scratch import Tables

#: Words that begin a definition, by language, and the kind of symbol.
KEYWORDS = {
    "python": {"def": "function", "class": "class"},
    "ruby": {"def": "function", "class": "class", "module": "class"},
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "const": "const", "static": "static", "type": "type"},
    "typescript": {"function": "function", "class": "class", "interface": "interface", "const": "const"},
    "go": {"func": "function", "type": "type"},
    "java": {"class": "class", "interface": "class", "enum": "class", "record": "class"},
    "csharp": {"class": "class", "interface": "class", "enum": "class", "record": "class", "struct": "class"},
    "c": {"struct": "struct", "enum": "struct", "union": "struct"},
    "cpp": {"struct": "struct", "enum": "struct", "union": "struct", "class": "struct"},
    "php": {"function": "function", "class": "class", "interface": "class", "trait": "class"},
    "dart": {"class": "class", "enum": "class", "mixin": "class"},
    "proto": {"message": "message", "enum": "message", "service": "message", "rpc": "rpc"},
}
#: Words between a keyword and the name that it defines.
BETWEEN = ["mut", "unsafe", "async", "class", "struct", "*", "&", "self", "."]
#: Languages in which a name before brackets and a body is a function: of a file or of what a class holds.
UNMARKED = {"typescript": "method", "java": "method", "csharp": "method", "c": "function", "cpp": "function", "dart": "function"}
#: Words that stand before brackets and a body but define nothing.
CONTROL = "if for while switch match return catch function with do else try foreach using lock synchronized when new await yield throw sizeof super this".split()
CALLABLE = ["function", "method", "arrow", "rpc"]
#: Languages whose block comments nest.
NESTED = ("rust", "dart")
WORD = r"[^\W\d][\w$]*|\$[\w$]*"
STRINGS = {
    "python": r"(?i:[rbuf]{0,2})(?:\"\"\"(?:[^\\]|\\.)*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\.)*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)",
    "rust": r"[bc]?r(?P<hash>#*)\".*?(?:\"(?P=hash)|\Z)|[bc]?\"(?:[^\"\\]|\\.)*(?:\"|\Z)|b?'(?:\\[^\n']+|[^'\\\n])'|'[^\W\d]\w*",
    "go": r"\"(?:[^\"\\\n]|\\.)*\"?|`[^`]*(?:`|\Z)|'(?:\\[^\n']+|[^'\\\n])'",
    "c": r"(?:u8|[uUL])?R\"(?P<raw>[^\s()\\]{0,16})\(.*?(?:\)(?P=raw)\"|\Z)|(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"?|(?:u8|[uUL])?'(?:\\[^\n']+|[^'\\\n])'",
    "java": r"\"\"\".*?(?:\"\"\"|\Z)|[$@]{0,2}\"(?:[^\"\\\n]|\\.)*\"?|'(?:\\[^\n']+|[^'\\\n])'",
    "dart": r"r?(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)",
    "typescript": r"\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?",
}
STRINGS |= {"cpp": STRINGS["c"], "csharp": STRINGS["java"], "php": r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\]|\\.)*(?:'|\Z)", "ruby": STRINGS["typescript"], "proto": STRINGS["typescript"]}
HASHES = {"python": "#[^\n]*", "ruby": r"(?m:^=begin\b.*?(?:^=end[^\n]*|\Z))|#[^\n]*", "php": r"#(?!\[)[^\n]*|//[^\n]*"}
PATTERNS = {
    lang: re.compile(
        rf"(?s)(?P<comment>{HASHES.get(lang, '//[^\n]*')})" + ("" if lang in ("python", "ruby") else r"|(?P<block>/\*)")
        + rf"|(?P<string>{text})|(?P<word>(?:{WORD}){'(?:[?!](?!=))?' if lang == 'ruby' else ''})|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<blank>[^\S\n]+)|(?P<mark>=>|->|::|[^\w\s])"
    )
    for lang, text in STRINGS.items()
}
PAIRS = {")": "(", "]": "[", "}": "{"}
#: Ruby's words that open what ``end`` closes: some of them only where a statement begins.
OPENERS, ENDED = ("def", "class", "module", "begin", "case", "while", "until", "for", "if", "unless"), "end"
#: After these a slash begins a pattern, not a division.
BEFORE_PATTERN = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "in", "of", "=>", ""}
SLASHED = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
TOKEN = "rel_path string, ext string, at int, line int, kind string, token string, depth int, block int, opener int"


def block_comment_end(text: str, at: int, nested: bool) -> int:
    """The place behind a comment that begins at a place; the text's end where it does not end."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" and (nested or not depth) else -1 if m[0] == "*/" else 0
        if not depth:
            return m.end()
    return len(text)


def template_end(text: str, at: int) -> int:
    """The place behind a template string that begins at a place, with what is nested in it."""
    at += 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return at + 1
        elif text.startswith("${", at):
            depth, at = 1, at + 2
            while at < len(text) and depth:
                if text[at] == "`":
                    at = template_end(text, at)
                    continue
                depth += (text[at] == "{") - (text[at] == "}")
                at += 1
        else:
            at += 1
    return at


def scan(text: str, lang: str) -> Iterator[tuple[int, str, str, int, int, int | None]]:
    """line (from 1), class, token, depth, block and opener of each token in order, blanks aside.

    Classes are word, number, mark, string, comment, and in Python and Ruby end
    for the end of a statement. block is the number of the innermost open
    bracket's token, -1 outside; a closing bracket's opener is its own. Python's
    indented lines lie between marks ``{`` and ``}`` too, as do Ruby's between
    their words and ``end``. A bracket that nothing opened closes nothing; one
    of another kind closes those within.
    """
    pattern, indented, worded = PATTERNS[lang], lang == "python", lang == "ruby"
    at, line, n, last, fresh = 0, 1, 0, "", True
    stack: list[tuple[str, int]] = []
    indents = [0]

    def put(kind: str, token: str, opener: int | None = None) -> tuple:
        nonlocal n
        n += 1
        return line, kind, token, len(stack), stack[-1][1] if stack else -1, opener

    def opened(mark: str) -> tuple:
        row = put("mark", mark)
        stack.append((mark, n - 1))
        return row

    def closed(mark: str) -> tuple:
        if not stack or stack[-1][0] != PAIRS[mark] and all(k != PAIRS[mark] for k, _ in stack):
            return put("mark", mark)
        while stack[-1][0] != PAIRS[mark]:
            stack.pop()
        opener = stack.pop()[1]
        return put("mark", mark, opener)

    while at < len(text):
        m = pattern.match(text, at)
        kind, token = m.lastgroup, m[0]
        kind = "string" if kind in ("hash", "raw") else kind
        if kind == "block":
            token = text[at : block_comment_end(text, at, lang in NESTED)]
            kind = "comment"
        elif token == "`" and lang == "typescript":
            token, kind = text[at : template_end(text, at)], "string"
        elif token == "/" and lang in ("typescript", "ruby") and last in BEFORE_PATTERN and (slashed := SLASHED.match(text, at)):
            token, kind = slashed[0], "string"
        if kind == "word" and indented and text[at + len(token) : at + len(token) + 1] in ("'", '"') and (m := re.compile(f"(?s){STRINGS['python']}").match(text, at)):
            token, kind = m[0], "string"
        at += len(token)
        if indented and fresh and kind not in ("line", "blank", "comment"):
            column = len(text[text.rfind("\n", 0, at - len(token)) + 1 : at - len(token)].expandtabs())
            while column < indents[-1] and stack and stack[-1][0] == "{":
                indents.pop()
                yield closed("}")
            if column > indents[-1]:
                indents.append(column)
                yield opened("{")
        if kind == "line":
            if (indented or worded) and not fresh and not any(k in "([" for k, _ in stack) and last != "\\":
                yield put("end", "\n")
                fresh, last = True, ""
            line += 1
            continue
        if kind == "blank":
            continue
        if kind == "comment":
            yield put("comment", token)
        elif token in "([{" and kind == "mark":
            yield opened(token)
        elif token in PAIRS and kind == "mark":
            yield closed(token)
        elif worded and kind == "word" and ((token in OPENERS and fresh) or token == "do") and last != ".":
            yield put("word", token)
            yield opened("{")
        elif worded and token == ENDED and last != ".":
            yield closed("}")
        else:
            yield put(kind, token)
        if kind != "comment":
            last, fresh = token, False
        line += token.count("\n")
    while indented and len(indents) > 1 and stack and stack[-1][0] == "{":
        indents.pop()
        yield closed("}")


def tokens(texts: DataFrame) -> DataFrame:
    """One row a token of texts(rel_path, ext, text) in known languages: at (from 0), line, kind, token, depth, block and opener (see ``scan``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, ext, lang, text in zip(*(b.column(c).to_pylist() for c in ("rel_path", "ext", "lang", "text")), strict=True):
                rows = [(path, ext, i, *row) for i, row in enumerate(scan(text, lang))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [x.split()[0] for x in TOKEN.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int32() for x in TOKEN.split(", ")]
    known = texts.select("rel_path", "ext", K.language(F.col("ext")).alias("lang"), "text").filter(F.col("lang").isin(list(PATTERNS)) & F.col("text").isNotNull())
    return known.mapInArrow(run, TOKEN)


def ahead(value: Column, by: list[str]) -> Column:
    """The next value that is not null among the rows behind this one, in the order of at."""
    behind = Window.partitionBy(*by).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(value, ignorenulls=True).over(behind)


def laid(rows: DataFrame) -> DataFrame:
    """Code tokens with lang, what stands before and behind, the bracket's end, and what comes next in the same block: body, semicolon, arrow, end of the statement."""
    code = rows.filter(~F.col("kind").isin("comment", "string")).withColumn("lang", K.language(F.col("ext")))
    order = Window.partitionBy("rel_path").orderBy("at")
    for n in (1, 2, 3):
        code = code.withColumns({f"prev{n}": F.lag("token", n).over(order), f"next{n}": F.lead("token", n).over(order)})
    code = code.withColumn("next_kind", F.lead("kind").over(order)).withColumn("next_at", F.lead("at").over(order))
    here = ["rel_path", "block"]
    where = lambda token: F.when(F.col("token") == token, F.col("at"))
    return code.withColumns({"body": ahead(where("{"), here), "semicolon": ahead(where(";"), here), "arrow": ahead(where("=>"), here), "stop": ahead(F.when(F.col("kind") == "end", F.struct("at", "next1", "next_at")), here), "equals": ahead(where("="), here)})


def brackets(rows: DataFrame) -> DataFrame:
    """rel_path, opener, last_line and after: each closed bracket, the last line within or at its end, the token behind it."""
    order = Window.partitionBy("rel_path").orderBy("at")
    code = rows.filter(~F.col("kind").isin("comment", "string")).withColumns({"after": F.lead("token").over(order), "close": F.col("at"), "before_line": F.lag(F.when(F.col("kind") != "end", F.col("line"))).over(order)})
    within = F.last(F.when(~F.col("kind").isin("end", "comment") & ~((F.col("token") == "}") & F.col("opener").isNotNull() & F.col("ext").isin("py")), F.col("line")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    all_ = rows.withColumns({"within": within}).select("rel_path", "at", "within")
    code = code.filter("opener IS NOT NULL").join(all_, ["rel_path", "at"])
    last = F.when(F.col("ext") == "py", F.when(F.col("token") == "}", F.col("within")).otherwise(F.col("line"))).otherwise(F.col("line"))
    return code.select("rel_path", "opener", "close", last.alias("last_line"), "after")


def definitions(texts: DataFrame) -> DataFrame:
    """rel_path, ext, name, kind, line_no, line_end and signature of each definition in texts(rel_path, ext, text) (see ``bodies``)."""
    return bodies(texts).drop("head_end")


def bodies(texts: DataFrame) -> DataFrame:
    """``definitions`` with head_end: the line on which the body opens (in Python the last before it), or the definition's last.

    A definition begins where its keyword stands (in languages without one, its
    name) and ends with the body that opens next in the same block, or with a
    semicolon or the end of the statement before that; how its head is broken
    into lines does not matter. Of several definitions of one name on a line
    the first is told, an arrow function before a constant.
    """
    tables = Tables(texts.sparkSession, "tokens")
    rows = tables.put(tokens(texts), "rows")  # texts are scanned once, and what is read several times is made once
    code, ends = tables.put(laid(rows), "laid"), tables.put(brackets(rows), "brackets")
    pairs = [F.when((F.col("lang") == lang) & (F.col("token") == word), F.lit(kind)) for lang, words in KEYWORDS.items() for word, kind in words.items()]
    told = F.coalesce(*pairs)
    head = (F.col("kind") == "word") & told.isNotNull() & ~F.coalesce(F.col("prev1").isin(".", "::"), F.lit(False))
    skip = lambda c: F.col(c).isin(BETWEEN) | ((F.col("lang") == "ruby") & (F.col(c) == "{"))
    name = F.when(~skip("next1"), F.col("next1")).when(~skip("next2"), F.col("next2")).otherwise(F.col("next3"))
    marked = code.filter(head).withColumns({"name": name, "told": told})
    # a receiver in brackets stands between Go's keyword and the name
    receiver = marked.filter((F.col("lang") == "go") & (F.col("next1") == "(")).join(ends.select("rel_path", F.col("opener").alias("next_at"), "after"), ["rel_path", "next_at"]).withColumn("name", F.col("after")).drop("after")
    marked = marked.filter(~((F.col("lang") == "go") & (F.col("next1") == "("))).unionByName(receiver)
    marked = marked.filter(F.col("name").rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*[?!=]?$") & ~((F.col("lang") == "rust") & (F.col("token") == "const") & F.col("name").isin("fn", "unsafe", "async", "extern")))
    by_arrow = (F.col("lang") == "typescript") & F.col("token").isin("const", "let", "var") & (F.col("next2").isin("=", ":")) & F.col("arrow").isNotNull() & (F.col("arrow") < F.coalesce("semicolon", F.lit(2**31 - 1)))
    arrows = code.filter((F.col("kind") == "word") & by_arrow)
    again = ahead(F.when(F.col("token").isin("const", "let", "var", "function", "class", "export", "return") & (F.col("lang") == "typescript"), F.col("at")), ["rel_path", "block"])
    arrows = arrows.join(code.withColumn("again", again).select("rel_path", "at", "again"), ["rel_path", "at"]).filter("again IS NULL OR arrow < again").drop("again").withColumns({"name": F.col("next1"), "told": F.lit("arrow")})
    # what a class holds
    classes = marked.filter(F.col("told").isin("class", "interface", "struct") & F.col("body").isNotNull() & (F.col("body") < F.coalesce("semicolon", F.lit(2**31 - 1)))).select("rel_path", F.col("body").alias("block"), F.lit(True).alias("held")).distinct()
    named = code.filter((F.col("kind") == "word") & (F.col("next1") == "(") & ~F.col("token").isin(CONTROL) & F.col("lang").isin(list(UNMARKED)) & ~F.coalesce(F.col("prev1").isin(".", "new", "function", "=", "return", "(", ",", "->", "::", "!"), F.lit(False)))
    named = named.join(ends.select("rel_path", F.col("opener").alias("next_at"), "close", "after"), ["rel_path", "next_at"]).join(classes, ["rel_path", "block"], "left")
    typed = F.col("prev1").rlike(r"^[\w>\]*&$]+$")
    outside = F.col("lang").isin("c", "cpp", "dart") & (F.col("block") == -1) & typed
    named = named.filter((F.col("held") | outside) & F.col("after").isin("{", ":", "throws", "const", "override", "noexcept", "async", "=>", "->") & (F.col("body") > F.col("close")))
    named = named.filter(F.col("semicolon").isNull() | (F.col("body") < F.col("semicolon"))).drop("close", "after", "held")
    unmarked = named.withColumns({"name": F.col("token"), "told": F.coalesce(*[F.when(F.col("lang") == lang, kind) for lang, kind in UNMARKED.items()])})
    found = arrows.unionByName(marked).unionByName(unmarked)
    # where it ends
    far = F.lit(2**31 - 1)
    ruby, python = F.col("lang") == "ruby", F.col("lang") == "python"
    first = F.when(python, F.when(F.col("stop.next1") == "{", F.col("stop.next_at"))).when(F.col("body") < F.coalesce("semicolon", far), F.col("body"))
    plain = F.when(F.col("told").isin("const", "static"), F.lit(None)).when((F.col("told") == "arrow") & (F.coalesce("body", far) != F.col("arrow") + 1), F.lit(None)).otherwise(first)
    found = found.withColumn("opener", F.when(ruby, F.col("at") + 1).otherwise(plain)).join(ends.select("rel_path", "opener", "last_line"), ["rel_path", "opener"], "left")
    stop = F.when(python | ruby, F.col("stop.at")).otherwise(F.col("semicolon"))
    lines = rows.select("rel_path", F.col("at").alias("stop_at"), F.col("line").alias("stop_line"))
    found = found.withColumn("stop_at", F.when(F.col("last_line").isNull(), stop)).join(lines, ["rel_path", "stop_at"], "left")
    found = found.withColumn("line_end", F.coalesce("last_line", "stop_line", "line"))
    heads = rows.select("rel_path", F.col("at").alias("head_at"), F.col("line").alias("head_line"))
    head = F.when(python | ruby, F.col("stop.at")).otherwise(F.col("opener"))
    found = found.withColumn("head_at", head).join(heads, ["rel_path", "head_at"], "left")
    best = Window.partitionBy("rel_path", "line", "name").orderBy(F.when(F.col("told") == "arrow", 0).otherwise(1), "at")
    found = found.withColumn("nth", F.row_number().over(best)).filter("nth = 1")
    found = found.join(texts.select("rel_path", "text"), "rel_path")
    text = F.array_join(F.slice(F.split("text", "\n", -1), F.col("line"), F.least(F.col("line_end") - F.col("line") + 1, F.lit(12))), " ")
    return found.select("rel_path", "ext", "name", F.col("told").alias("kind"), F.col("line").alias("line_no"), F.greatest("line_end", "line").alias("line_end"), X.signature(F.trim(text)).alias("signature"), F.coalesce("head_line", "line_end").alias("head_end"))


#: Brackets around a name that are looked at for calls.
LEVELS = 3


def uses(rows: DataFrame, name: str) -> DataFrame:
    """rel_path, line_no and category of each use of the name among ``tokens``, by the syntax that encloses it.

    In this order: a type's name, as the place says (behind a definition of a
    type, ``:``, ``->``, ``as``, ``impl``, ``extends``, within angle brackets, before
    a literal's brace); part of a call, callee or argument, of one of the LEVELS
    brackets around it; the key of a literal; part of a chain of accesses.
    """
    code = Tables(rows.sparkSession, "uses").put(laid(rows), "laid")
    some = code.filter((F.col("token") == name) & (F.col("kind") == "word"))
    parents = code.filter(F.col("token").isin("(", "[", "{")).select("rel_path", F.col("at").alias("up"), F.col("block").alias("above"), ((F.col("token") == "(") & F.col("prev1").rlike(r"^[\w$)\]>]+$") & ~F.col("prev1").isin([*CONTROL, "fn", "def", "and", "or", "not", "in"])).alias("call"), F.col("prev2").alias("told"), (F.col("token") == "{").alias("brace"))
    parents = parents.withColumn("call", F.col("call") & ~F.coalesce(F.col("told").isin("fn", "def", "function", "func", "class", "new"), F.lit(False)))
    in_call = F.lit(False)
    for n in range(LEVELS):
        level = parents.toDF("rel_path", f"up{n}", f"above{n}", f"call{n}", f"told{n}", f"brace{n}")
        some = some.join(level.withColumnRenamed(f"up{n}", "__up"), (F.col("__up") == F.col("block" if n == 0 else f"above{n - 1}")) & (level.rel_path == some.rel_path), "left").drop(level.rel_path).drop("__up")
        in_call |= F.coalesce(F.col(f"call{n}"), F.lit(False))
    inner = F.coalesce(F.col("brace0"), F.lit(False))
    typed_language = ~F.col("lang").isin("python", "ruby", "php")
    capital = F.lit(bool(re.match(r"[A-Z]", name)))
    before, behind = F.coalesce("prev1", F.lit("")), F.coalesce("next1", F.lit(""))
    defines = before.isin("struct", "enum", "trait", "interface", "type", "impl", "union", "message", "service") | (F.col("lang").isin("typescript", "java", "csharp", "cpp", "dart") & (before == "class"))
    types = typed_language & ~behind.isin("(", "::", ".") & (
        defines | before.isin("->", "as", "extends", "implements", "dyn") | ((before == "for") & capital) | ((before == "new") & F.col("lang").isin("java", "csharp"))
        | (before.isin(":", "&", "mut", "<") & capital & ~(inner & (before == ":") & ~F.col("lang").isin("rust", "typescript", "go")))
        | ((F.col("lang") == "rust") & capital & (behind == "{")) | (capital & behind.isin(">", "<") & F.col("lang").isin("rust", "typescript", "java", "csharp", "cpp", "dart")))
    callee = (behind == "(") & ~before.isin("fn", "def", "function", "func", "new")
    callee |= (behind.isin(".", "::") & (F.col("next3") == "("))
    kind = F.when(types, K.CATEGORIES[0]).when(in_call | callee, K.CATEGORIES[1])
    kind = kind.when(inner & (behind == ":") & before.isin("{", ","), K.CATEGORIES[2]).when((before == ".") | (behind == "."), K.CATEGORIES[3])
    return some.select("rel_path", F.col("line").alias("line_no"), kind.otherwise(K.CATEGORIES[4]).alias("category"))
