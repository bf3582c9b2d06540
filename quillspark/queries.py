"""The registered queries of the core operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import edits as E
from .functions import paths as P
from .functions import text as X
from .functions import trees as J
from .operators import packing as B
from .operators import relational as R
from .operators import runs as U
from .operators import sections as C
from .operators import skeletons as N
from .plans import explore as D
from .plans import graphs as G
from .plans import history as H
from .plans import index as I
from .plans import postings as O
from .plans import search as S
from .plans import slices as L
from .plans import workspace as K
from .sources import files

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
SQL: dict[str, str] = {}
VECTOR = [((7 * i) % 11 - 5) / 5 for i in range(64)]
VECTOR_SQL = "[" + ", ".join(f"{x!r}::DOUBLE" for x in VECTOR) + "]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        REGISTRY[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT * FROM customer WHERE contains(lower(c_custkey::VARCHAR), 'build') OR contains(lower(c_name), 'build')
OR contains(lower(c_nationkey::VARCHAR), 'build') OR contains(lower(c_acctbal::VARCHAR), 'build') OR contains(lower(c_mktsegment), 'build')""")
def cell_search(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.filter(X.any_cell_contains([F.col(c) for c in rows.columns], "BUILD"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no, line FROM l WHERE contains(lower(line), 'license')""")
def line_search(spark, sf_dir):
    found = files.lines(table(spark, sf_dir, "documents"), key="doc_id")
    return found.filter(X.any_cell_contains([F.col("line")], "License"))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'news') OR contains(lower(url), '/a')")
def path_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(X.path_matches(F.col("url"), "news|/A")).select("page_id", "url")


@query("""SELECT source, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(ceil(octet_length(encode(text)) / 4.0))::BIGINT AS tokens
FROM documents GROUP BY source""")
def slice_totals(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"), F.sum(X.token_estimate(size)).alias("tokens"))


@query("""SELECT CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 5000 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM documents GROUP BY 1""")
def size_classes(spark, sf_dir):
    kind = X.size_class(F.col("n_chars"), 1000, 5000).alias("size_class")
    return table(spark, sf_dir, "documents").groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH w AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: octet_length(encode(x)) >= 2))) AS word FROM conversations)
SELECT word, count(*) AS turns FROM w GROUP BY word""")
def query_words(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(X.query_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("turns"))


@query(f"""WITH s AS (SELECT vec_id, label, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), {VECTOR_SQL}) /
 (sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product({VECTOR_SQL}, {VECTOR_SQL}))) AS c FROM embeddings),
g AS (SELECT label, CASE WHEN bool_or(label = 3) THEN 2.0 ELSE max(c) END AS score FROM s GROUP BY label)
SELECT label, round(score, 6) AS score FROM g ORDER BY g.score DESC, label LIMIT 10""")
def hybrid_search(spark, sf_dir):
    chunks = table(spark, sf_dir, "embeddings")
    return S.chunk_search(chunks, VECTOR, F.col("label") == 3, key="label", embedding="embedding").select("label", F.round("score", 6).alias("score"))


@query("""SELECT conv_id, turn, ((contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT + contains(lower(text), 'der')::INT) / 3.0)::DOUBLE AS score
FROM conversations ORDER BY score DESC, conv_id * 1000 + turn LIMIT 25""")
def journal_search(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return S.journal_search(rows, F.col("text"), ["the", "tion", "der"], n=25).select("conv_id", "turn", "score")


@query("""WITH d AS (SELECT doc_id, n_chars, md5(text) AS h FROM documents), i AS (SELECT l.doc_id, n_chars - toxic AS n, CASE WHEN quality = 0 THEN 'old' ELSE md5(text) END AS h FROM labels l JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN i.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'deleted' WHEN d.n_chars <> i.n THEN 'resized' WHEN d.h <> i.h THEN 'changed' ELSE 'same' END AS status
FROM d FULL JOIN i USING (doc_id)""")
def index_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    disk = docs.select("doc_id", "n_chars", F.md5("text"))
    seen = table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("n_chars") - F.col("toxic"), F.when(F.col("quality") == 0, "old").otherwise(F.md5("text")))
    return R.changes(seen, disk, "doc_id")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("""WITH o AS (SELECT DISTINCT array_to_string(string_split(url, '/')[1:4], '/') AS owner FROM pages)
SELECT url, arg_max(owner, length(owner)) AS owner FROM (SELECT DISTINCT url FROM pages) p LEFT JOIN o ON url = owner OR starts_with(url, owner || '/') GROUP BY url""")
def owner_of_path(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select("url").distinct()
    owners = urls.select(F.array_join(F.slice(F.split("url", "/"), 1, 4), "/").alias("owner"))
    return R.longest_prefix(urls, owners, "url", "owner")


@query("""WITH s AS (SELECT user_id, event_id AS span, floor(epoch(ts))::BIGINT AS low, floor(epoch(ts))::BIGINT + 86400 AS high FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
p AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS sec FROM events)
SELECT event_id, p.user_id, sec, coalesce(arg_min(span, {'l': -low, 's': span}), -1)::BIGINT AS span FROM p LEFT JOIN s ON s.user_id = p.user_id AND sec BETWEEN low AND high GROUP BY ALL""")
def enclosing_span(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    kind = events.agg(F.min("event_type").alias("kind"))
    spans = events.join(F.broadcast(kind), F.col("event_type") == F.col("kind")).select("user_id", F.col("event_id").alias("span"), F.col("sec").alias("low"), (F.col("sec") + 86400).alias("high"))
    return R.tightest_interval(events.select("event_id", "user_id", "sec"), spans, "user_id", "sec", "low", "high", "span", width=86_400).withColumn("span", F.coalesce("span", F.lit(-1)))


@query("""SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1, 999999999)::BIGINT AS "end" FROM orders""")
def symbol_territory(spark, sf_dir):
    return R.territory(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", F.lit(999999999))


@query("""SELECT c_nationkey AS a, s_nationkey AS b, (sum(CASE WHEN l_returnflag = 'R' THEN 5 ELSE 1 END))::BIGINT AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL""")
def module_graph(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag")
    edges = (
        items.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a")), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b")), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return R.edge_weights(edges, "a", "b", F.when(F.col("l_returnflag") == "R", 5).otherwise(1))


@query("""WITH b AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT source, doc_id, n_chars FROM b WHERE before < 8000""")
def capped_output(spark, sf_dir):
    return B.within_cap(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.col("doc_id")], F.col("n_chars"), 8000)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def first_per_group(spark, sf_dir):
    return R.first_per(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 5)


@query("""SELECT lang, count(*) AS scanned, count_if(n_chars < 100)::BIGINT AS too_small, count_if(n_chars >= 20000)::BIGINT AS too_large, count_if(n_chars >= 100 AND n_chars < 20000)::BIGINT AS kept,
array_to_string(list_sort(list(doc_id) FILTER (WHERE n_chars < 100))[1:5], ',') AS samples FROM documents GROUP BY lang""")
def scan_funnel(spark, sf_dir):
    small, large = F.col("n_chars") < 100, F.col("n_chars") >= 20000
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("scanned"), F.count_if(small).alias("too_small"), F.count_if(large).alias("too_large"), F.count_if(~small & ~large).alias("kept"))
    first = R.first_per(docs.filter(small), ["lang"], [F.col("doc_id")], 5).groupBy("lang").agg(F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("samples"))
    return counts.join(first, "lang", "left")


@query("""SELECT max(least(octet_length(encode(p_name)), 40))::INT AS p_name, max(least(octet_length(encode(p_brand)), 40))::INT AS p_brand, max(least(octet_length(encode(p_type)), 40))::INT AS p_type,
max(least(octet_length(encode(p_partkey::VARCHAR)), 40))::INT AS p_partkey, max(least(octet_length(encode(p_size::VARCHAR)), 40))::INT AS p_size, max(least(octet_length(encode(p_retailprice::VARCHAR)), 40))::INT AS p_retailprice FROM part""")
def column_widths(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.agg(*[F.max(F.least(F.octet_length(F.col(c).cast("string")), F.lit(40))).alias(c) for c in rows.columns])


@query("""SELECT a.conv_id, trim(a.text, ' ') = trim(b.text, ' ') AS same FROM conversations a JOIN conversations b USING (conv_id) WHERE a.turn = 0 AND b.turn = 1""")
def compare_snapshots(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("tag", F.col("turn").cast("string"))
    return S.compare_snapshots(rows, "tag", "0", "1", ["conv_id"], "text")


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n)', '\1', 'g'), '\n+', chr(10), 'g'), '[ \t\r\n]+$', '')) AS crunched FROM documents""")
def crunched_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.crunch(F.col("text"))).alias("crunched"))


@query("""SELECT event_type, count(*) AS n, sum(json_extract_string(props, '$.k')::INT)::BIGINT AS total FROM events GROUP BY event_type""")
def dot_path_lookup(spark, sf_dir):
    value = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h([1-6])[^>]*>', 1)) AS level FROM pages) SELECT page_id, level, count(*) AS n FROM h GROUP BY ALL""")
def page_outline(spark, sf_dir):
    level = F.explode(F.regexp_extract_all("html", F.lit("<h([1-6])[^>]*>"), 1)).alias("level")
    return table(spark, sf_dir, "pages").select("page_id", level).groupBy("page_id", "level").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, (n - 1) // 20 AS chunk, min(n) AS first_line, max(n) AS last_line, sum(octet_length(encode(line)))::BIGINT AS bytes FROM l GROUP BY ALL""")
def line_chunks(spark, sf_dir):
    rows = files.lines(table(spark, sf_dir, "documents"), key="doc_id")
    chunk = F.floor((F.col("line_no") - 1) / 20).alias("chunk")
    return rows.groupBy("doc_id", chunk).agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.octet_length("line")).alias("bytes"))


@query(r"""WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, sum(len(regexp_extract_all(line, '\bthe\b')))::BIGINT AS uses, array_to_string(list_sort(list(n))[1:5], ',') AS first_lines FROM w WHERE contains(line, 'the') AND regexp_matches(line, '\bthe\b') GROUP BY doc_id""")
def usages(spark, sf_dir):
    rows = files.lines(table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("the"))), key="doc_id").filter(F.col("line").rlike(r"\bthe\b"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))
    first = F.array_join(F.sort_array(F.collect_list(F.when(F.col("rank") <= 5, F.col("line_no")))).cast("array<string>"), ",")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.regexp_count("line", F.lit(r"\bthe\b"))).alias("uses"), first.alias("first_lines"))


@query(r"""SELECT doc_id, md5('<file path="' || source || '/' || doc_id || '"><![CDATA[' || replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n)', '\1', 'g'), '\n+', chr(10), 'g'), '[ \t\r\n]+$', ''), ']]>', ']]]]><![CDATA[>') || ']]></file>') AS element FROM documents""")
def context_elements(spark, sf_dir):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(E.file_element(path, F.col("text"))).alias("element"))


@query("""SELECT doc_id, md5(array_to_string(string_split(text, chr(10))[-3:], chr(10))) AS tail FROM documents""")
def tail_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(E.tail(F.col("text"), 3)).alias("tail"))


@query("""SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 50""")
def tag_listing(spark, sf_dir):
    return R.first_per(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), ["event_type"], [F.desc("ts"), F.col("event_id")], 50).select("event_type", "event_id")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, o_totalprice::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM (SELECT o_custkey, o_orderkey, o_orderdate, trunc(o_totalprice) AS o_totalprice FROM orders) WHERE o_totalprice::BIGINT <= 500000),
p AS (SELECT o_custkey, o_orderkey, r, size AS used, true AS kept FROM o WHERE r = 1 UNION ALL
SELECT o.o_custkey, o.o_orderkey, o.r, CASE WHEN p.used + o.size <= 500000 THEN p.used + o.size ELSE p.used END, p.used + o.size <= 500000 FROM p JOIN o ON o.o_custkey = p.o_custkey AND o.r = p.r + 1)
SELECT o_custkey, (max(used) OVER (PARTITION BY o_custkey))::BIGINT AS used, (count(*) OVER (PARTITION BY o_custkey))::INT AS n_taken, o_orderkey FROM p WHERE kept""")
def budget_packing(spark, sf_dir):
    return B.pack_greedy(table(spark, sf_dir, "orders").withColumn("size", F.col("o_totalprice").cast("long")), "o_custkey", ["o_orderdate"], "size", "o_orderkey", 500_000)


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) WHERE upto <= 50000""")
def stop_on_overflow(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return B.within_budget(rows, "source", [F.col("doc_id")], F.col("n_chars"), 50_000).select("source", "doc_id")


@query("""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM pages) SELECT * FROM u""")
def address_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", P.uri_path(F.col("url")).alias("path"))


@query("""SELECT doc_id, len(string_split(text, chr(10)))::INT AS lines, len(regexp_extract_all(text, '[^ \\t\\n\\r]+'))::INT AS words FROM documents""")
def text_statistics(spark, sf_dir):
    lines, words = F.size(F.split("text", "\n", -1)), F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"), words.alias("words"))


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, (l_quantity::INT % 6 + 1) AS level FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, a.level, coalesce((SELECT min(b.l_linenumber) FROM h b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber > a.l_linenumber AND b.level <= a.level) - 1, 99)::INT AS "end" FROM h a""")
def section_ends(spark, sf_dir):
    heads = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 6 + 1).alias("level"))
    return C.section_ends(heads, "l_orderkey", "l_linenumber", "level", F.lit(99)).withColumn("end", F.col("end").cast("int"))


@query("""WITH k AS (SELECT s_suppkey AS found FROM supplier WHERE s_acctbal > 3000), c AS (SELECT p_partkey, unnest([p_partkey, p_partkey // 2, p_partkey // 7]) AS c, unnest([1, 2, 3]) AS r FROM part)
SELECT p_partkey, coalesce(arg_min(found, r), -1)::BIGINT AS found FROM c LEFT JOIN k ON c = found GROUP BY p_partkey""")
def best_candidate(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey")
    known = table(spark, sf_dir, "supplier").filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("found"))
    return C.resolve(parts, F.expr("array(p_partkey, p_partkey div 2, p_partkey div 7)"), known, "found").withColumn("found", F.coalesce("found", F.lit(-1).cast("long")))


@query("""WITH i AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'old' ELSE md5(text) END AS version FROM labels JOIN documents USING (doc_id) UNION ALL SELECT -1, 'gone'), d AS (SELECT doc_id, md5(text) AS version FROM documents)
SELECT i.* FROM i SEMI JOIN d USING (doc_id, version) UNION ALL SELECT d.* FROM d ANTI JOIN i USING (doc_id, version)""")
def index_refresh(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("version"))
    seen = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id").select("doc_id", F.when(F.col("quality") == 0, "old").otherwise(F.col("version")).alias("version"))
    gone = spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("gone").alias("version"))
    return C.refresh(seen.unionByName(gone), docs, "doc_id", "version")


@query("""SELECT doc_id, coalesce(list_bool_or(list_transform(list_filter(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13)) <> '')[1:5], lambda l: octet_length(encode(l)) > 2000)), false) AS minified FROM documents""")
def minified_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.minified(F.col("text")).alias("minified"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id % 5000 AS low, event_id % 5000 + 30 AS high, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5000, event_id) AS r FROM events),
g AS (SELECT user_id, r, low AS first, high AS last, 1::BIGINT AS run FROM s WHERE r = 1 UNION ALL
SELECT s.user_id, s.r, CASE WHEN greatest(g.last, s.high) - g.first < 80 THEN g.first ELSE s.low END, CASE WHEN greatest(g.last, s.high) - g.first < 80 THEN greatest(g.last, s.high) ELSE s.high END,
CASE WHEN greatest(g.last, s.high) - g.first < 80 THEN g.run ELSE g.run + 1 END FROM g JOIN s ON s.user_id = g.user_id AND s.r = g.r + 1)
SELECT user_id, min(first)::BIGINT AS first, max(last)::BIGINT AS last, count(*) AS n FROM g GROUP BY user_id, run""")
def line_grouping(spark, sf_dir):
    spans = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 5000).alias("low"), (F.col("event_id") % 5000 + 30).alias("high"))
    return U.line_groups(spans, "user_id", "low", "high", 80)


# Slices, maps, skeletons, chunks and data files over the tables: a document is a file of its source's folder.
PATHS = "source || '/' || doc_id || '.txt'"
ADDRESS = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
ELEMENT = r"""'<file path="' || path || '"><![CDATA[' || replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n)', '\1', 'g'), '\n+', chr(10), 'g'), '[ \t\r\n]+$', ''), ']]>', ']]]]><![CDATA[>') || ']]></file>'"""


def document_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("rel_path"), F.lit("txt").alias("ext"), F.octet_length("text").cast("long").alias("bytes"), "text", "source", "doc_id")


def page_files(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.regexp_replace("url", "^[A-Za-z][A-Za-z0-9+.-]*://", "").alias("rel_path"), F.octet_length("html").cast("long").alias("bytes"), "page_id")


@query(f"""WITH p AS (SELECT page_id, lower({ADDRESS}) AS p FROM pages), f AS (SELECT *, regexp_extract(p, '[^/]*$') AS f, len(p) - len(replace(p, '/', '')) AS d FROM p)
SELECT page_id, (CASE WHEN regexp_matches(p, '/tests?/|/test_') OR regexp_matches(f, '\\.spec\\.|[._]test\\.|^test_') THEN -1000 ELSE 0 END
+ CASE WHEN f IN ('main.rs','lib.rs','mod.rs','build.rs','index.ts','index.tsx','main.ts','main.tsx','app.tsx','app.ts','cli.ts','cli.js','main.go','main.py','__init__.py') THEN 120 ELSE 0 END
+ CASE WHEN f IN ('server.rs','handler.rs','handlers.rs','routes.rs','router.rs','api.rs','controller.rs','service.rs','app.rs','server.ts','handler.ts','routes.ts','router.ts','api.ts','controller.ts','service.ts','server.py','app.py') THEN 90 ELSE 0 END
+ 30 * (len(p) - len(replace(p, '/src/', ''))) // 5 + CASE WHEN regexp_matches(p, '/(core|lib|common|shared)/') THEN 25 ELSE 0 END
+ CASE WHEN ends_with(p, 'cargo.toml') OR ends_with(p, 'package.json') THEN 60 ELSE 0 END + CASE WHEN ends_with(f, '.md') THEN 10 ELSE 0 END
+ CASE WHEN regexp_matches(f, '\\.(json|ya?ml|toml)$') THEN 5 ELSE 0 END - CASE WHEN regexp_matches(p, '/(dist|target|generated|migrations)/') THEN 30 ELSE 0 END - 5 * greatest(d - 6, 0))::BIGINT AS score FROM f""")
def importance_scores(spark, sf_dir):
    return L.by_importance(page_files(spark, sf_dir)).select("page_id", "score")


@query(f"""WITH p AS (SELECT page_id, {ADDRESS} AS p, octet_length(encode(html)) AS b FROM pages), s AS (SELECT *, CASE WHEN contains(lower(regexp_extract(p, '[^/]*$')), 'news') THEN 30 WHEN contains(lower(p), 'news') THEN 10 ELSE 0 END
+ CASE WHEN contains(lower(regexp_extract(p, '[^/]*$')), '1') THEN 30 WHEN contains(lower(p), '1') THEN 10 ELSE 0 END AS score FROM p)
SELECT p AS rel_path, page_id, score::INT AS score FROM s ORDER BY score DESC, b, p, page_id LIMIT 80""")
def query_candidates(spark, sf_dir):
    pages = page_files(spark, sf_dir).withColumn("rel_path", F.struct("rel_path", "page_id"))  # an address may stand for several pages
    scored = pages.withColumn("score", X.path_score(F.col("rel_path.rel_path"), ["news", "1"]))
    return scored.orderBy(F.desc("score"), "bytes", "rel_path").limit(80).select("rel_path.rel_path", "page_id", "score")


def map_sql(files: str, group: str) -> str:
    """SQL for m(group, map): the map of each group's paths in a table files(group, path)."""
    return f"""q AS (SELECT {group}, path, row_number() OVER (PARTITION BY {group} ORDER BY path) AS r, 17 + sum(octet_length(encode(path)) + 1) OVER (PARTITION BY {group} ORDER BY path ROWS UNBOUNDED PRECEDING) AS b FROM {files}),
m AS (SELECT {group}, '# REPOSITORY_MAP' || chr(10) || coalesce(string_agg(path || chr(10), '' ORDER BY path) FILTER (WHERE r <= 4000 AND b <= 65536), '') || CASE WHEN count_if(r > 4000 OR b > 65536) > 0 THEN '# ... (truncated)' || chr(10) ELSE '' END AS map FROM q GROUP BY {group})"""


SLICE = f"""o AS (SELECT 0 AS g, {PATHS} AS path, text, octet_length(encode(text)) + 33 + octet_length(encode({PATHS})) AS size FROM documents), {map_sql("o", "g")},
k AS (SELECT *, row_number() OVER (ORDER BY path) AS n FROM o),
p AS (SELECT 0::BIGINT AS n, 104 + octet_length(encode(map))::BIGINT AS used, false AS kept FROM m UNION ALL SELECT k.n, CASE WHEN p.used + k.size <= 80000 THEN p.used + k.size ELSE p.used END, p.used + k.size <= 80000 FROM p JOIN k ON k.n = p.n + 1)"""


@query(f"""WITH RECURSIVE {SLICE} SELECT k.path AS rel_path, row_number() OVER (ORDER BY k.n)::INT AS position, ceil(p.used / 4.0)::BIGINT AS tokens FROM p JOIN k USING (n) WHERE p.kept""")
def budget_slice(spark, sf_dir):
    return L.sliced(L.by_importance(document_files(spark, sf_dir)), ["-score"], 20_000).select("rel_path", "position", "tokens")


@query(f"""WITH RECURSIVE {SLICE}, e AS (SELECT k.n, {ELEMENT} AS e FROM p JOIN k USING (n) WHERE p.kept)
SELECT md5('<context>' || chr(10) || string_agg(e, chr(10) ORDER BY n) || chr(10) || '</context>') AS xml FROM e""")
def context_document(spark, sf_dir):
    return L.document(L.sliced(L.by_importance(document_files(spark, sf_dir)), ["-score"], 20_000)).select(F.md5("xml").alias("xml"))


@query(f"""WITH RECURSIVE o AS (SELECT source, {PATHS} AS path, octet_length(encode(text)) + 33 + octet_length(encode({PATHS})) AS size FROM documents WHERE source IS NOT NULL), {map_sql("o", "source")},
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) AS n FROM o),
p AS (SELECT source, 0::BIGINT AS n, 104 + octet_length(encode(map))::BIGINT AS used, false AS kept FROM m UNION ALL
SELECT k.source, k.n, CASE WHEN p.used + k.size <= 80000 THEN p.used + k.size ELSE p.used END, p.used + k.size <= 80000 FROM p JOIN k ON k.source = p.source AND k.n = p.n + 1)
SELECT p.source, k.path AS rel_path, ceil(p.used / 4.0)::BIGINT AS tokens FROM p JOIN k USING (source, n) WHERE p.kept""")
def slices_by_source(spark, sf_dir):
    docs = document_files(spark, sf_dir).filter("source IS NOT NULL")
    return L.sliced(L.by_importance(docs), ["-score"], 20_000, group="source").select("source", "rel_path", "tokens")


def greedy_sql(name: str, k: str) -> str:
    """SQL for name(g, n, used, kept): greedy steps over the rows of a table k(g, n, size, room)."""
    return f"""{name} AS (SELECT DISTINCT g, 0::BIGINT AS n, 0::BIGINT AS used, false AS kept FROM {k} UNION ALL
SELECT k.g, k.n, CASE WHEN p.used + k.size <= k.room THEN p.used + k.size ELSE p.used END, p.used + k.size <= k.room FROM {name} p JOIN {k} k ON k.g = p.g AND k.n = p.n + 1)"""


@query(f"""WITH RECURSIVE o AS MATERIALIZED (SELECT {PATHS} AS path, CASE WHEN source LIKE '%7' THEN '*' ELSE source END AS member, CASE WHEN source LIKE '%7' THEN 2 ELSE 1 END AS place, octet_length(encode(text)) + 33 + octet_length(encode({PATHS})) AS size FROM documents),
l AS (SELECT DISTINCT place, member, 0 AS kind, '' AS path, CASE WHEN member = '*' THEN '# OTHER (outside of members)' ELSE '# ' || member || ' (' || member || ')' END AS line FROM o UNION ALL SELECT place, member, 1, path, path FROM o),
u AS (SELECT *, row_number() OVER w AS no, 24 + sum(octet_length(encode(line)) + 1) OVER w AS upto FROM l WINDOW w AS (ORDER BY place, member, kind, path ROWS UNBOUNDED PRECEDING)),
m AS (SELECT '# REPOSITORY_MAP' || chr(10) || '# ROOT (workspace root)' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY no) FILTER (WHERE upto <= 98304) || CASE WHEN count_if(upto > 98304) > 0 THEN chr(10) || '# ... (truncated)' || chr(10) ELSE '' END AS map FROM u),
f AS MATERIALIZED (SELECT 104 + octet_length(encode(map)) AS fixed, 800000 - 104 - octet_length(encode(map)) AS rest FROM m),
i AS MATERIALIZED (SELECT o.* FROM o, f WHERE size <= rest),
d AS MATERIALIZED (SELECT place, member, sum(size)::BIGINT AS need FROM i GROUP BY ALL),
r AS (SELECT need, sum(need) OVER w - need AS before, count(*) OVER () - row_number() OVER w + 1 AS n FROM d WINDOW w AS (ORDER BY need, member ROWS UNBOUNDED PRECEDING)),
v AS MATERIALIZED (SELECT greatest(16000, coalesce((SELECT ((rest - before) // n)::BIGINT FROM r, f WHERE need * n >= rest - before ORDER BY need, before LIMIT 1), (SELECT max(need) FROM d))) AS share),
a AS (SELECT member, least(need, share) AS s, rest - (sum(least(need, share)) OVER (ORDER BY place, member ROWS UNBOUNDED PRECEDING) - least(need, share)) AS b FROM d, v, f),
k AS MATERIALIZED (SELECT i.path, i.member AS g, i.size, greatest(0, least(s, b)) AS room, row_number() OVER (PARTITION BY i.member ORDER BY i.path) AS n FROM i JOIN a USING (member)), {greedy_sql("p", "k")},
x AS MATERIALIZED (SELECT path, size FROM p JOIN k USING (g, n) WHERE kept),
z AS MATERIALIZED (SELECT rest - coalesce((SELECT sum(size) FROM x), 0) AS room FROM f),
k2 AS MATERIALIZED (SELECT i.path, 0 AS g, i.size, room, row_number() OVER (ORDER BY place, member, i.path) AS n FROM i, z WHERE size <= room AND i.path NOT IN (SELECT path FROM x)), {greedy_sql("p2", "k2")},
t AS (SELECT path FROM x UNION ALL SELECT path FROM p2 JOIN k2 USING (g, n) WHERE kept)
SELECT member, row_number() OVER w::INT AS position, path AS rel_path, ceil((fixed + sum(size) OVER w) / 4.0)::BIGINT AS tokens FROM t JOIN o USING (path), f WINDOW w AS (ORDER BY place, member, path ROWS UNBOUNDED PRECEDING)""")
def workspace_slices(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    members = docs.select(F.col("source").alias("root")).filter("source NOT LIKE '%7'").distinct()
    return K.workspace_slice(docs.select("rel_path", "ext", "bytes", "text"), members, 200_000)[0].select("member", "position", "rel_path", "tokens")


@query(f"""WITH o AS (SELECT 0 AS g, {PATHS} AS path FROM documents), {map_sql("o", "g")} SELECT md5(map) AS repo_map FROM m""")
def repository_map(spark, sf_dir):
    return L.repository_map(document_files(spark, sf_dir)).select(F.md5("repo_map").alias("repo_map"))


@query(r"""WITH t AS (SELECT doc_id, text, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents), i AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '(?i)todo|fixme')
OR regexp_matches(l[i], '^\s*(function|class|def|func|struct|interface|enum)\s+[a-zA-Z0-9_]+') OR regexp_matches(l[i], '^\s*(public|private|protected)?\s*(static\s*)?(fn|var|val|func)\s+[a-zA-Z0-9_]+')) AS k,
coalesce(list_bool_or(list_transform(list_filter(l, lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '')[1:5], lambda x: octet_length(encode(x)) > 2000)), false) AS minified FROM t)
SELECT doc_id, md5(CASE WHEN minified THEN '/* MINIFIED_OR_GENERATED — skipped */' || chr(10)
WHEN len(k) > 0 THEN array_to_string(list_transform(range(1, least(len(k), 600) + 1), lambda n: CASE WHEN n > 1 AND k[n] > k[n - 1] + 1 THEN '...' || chr(10) ELSE '' END || regexp_replace(l[k[n]], '^\s+|\s+$', '', 'g') || chr(10)), '') || CASE WHEN len(k) >= 600 AND len(l) > k[600] THEN '...' || chr(10) ELSE '' END
ELSE '/* TRUNCATED */' || chr(10) || array_to_string(list_transform(l[1:50], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), chr(10)) || chr(10) END) AS skeleton FROM i""")
def universal_skeletons(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.universal(F.col("text"))).alias("skeleton"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT *, least(3, len(l)) AS n FROM l)
SELECT doc_id, md5(array_to_string(list_transform(range(greatest(n - 2, 1), least(n + 2, len(l)) + 1), lambda i: CASE WHEN i = n THEN '>>>' ELSE '   ' END || ' ' || lpad(i::VARCHAR, 4, ' ') || ' | ' || l[i]), chr(10))) AS shown FROM n""")
def context_windows(spark, sf_dir):
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.context_window(lines, F.least(F.lit(3), F.size(lines)))).alias("shown"))


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, rank::INT AS rank, event_id, greatest(n - 50, 0)::BIGINT AS more FROM r WHERE rank <= 50""")
def newest_by_tag(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", "ts")
    return H.listing(rows, ("event_type",), F.desc("ts"), "event_id", 50)


@query(f"""WITH f AS (SELECT {ADDRESS} AS p, octet_length(encode(html)) AS b FROM pages) SELECT split_part(p, '/', 1) AS path, CASE WHEN contains(p, '/') THEN 'folder' ELSE 'file' END AS kind, sum(b)::BIGINT AS bytes FROM f GROUP BY ALL""")
def folder_listing(spark, sf_dir):
    return G.listing(page_files(spark, sf_dir))


@query(f"""WITH f AS (SELECT {ADDRESS} AS p, octet_length(encode(html)) AS b FROM pages), m AS (SELECT split_part(p, '/', 1) AS id, count(*) AS file_count, sum(b)::BIGINT AS bytes FROM f GROUP BY 1)
SELECT id, id AS label, file_count, bytes, ceil(bytes / 4.0)::BIGINT AS est_tokens, CASE WHEN bytes < 200000 THEN 'small' WHEN bytes < 1500000 THEN 'medium' ELSE 'large' END AS size_class FROM m""")
def module_sizes(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    roots = pages.select(F.split("rel_path", "/")[0].alias("root")).distinct()
    return G.module_nodes(pages, G.owners(pages, roots))


@query("SELECT l_partkey AS target, count(*) AS in_degree FROM lineitem GROUP BY 1")
def in_degrees(spark, sf_dir):
    return G.in_degree(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")))


@query("""WITH d AS (SELECT doc_id, n_chars, md5(text) AS h FROM documents), i AS (SELECT l.doc_id, n_chars - toxic AS n, CASE WHEN quality = 0 THEN 'old' ELSE md5(text) END AS h FROM labels l JOIN documents USING (doc_id))
SELECT count_if(i.doc_id IS NULL)::BIGINT AS added, count_if(n_chars <> n OR (n_chars = n AND d.h <> i.h))::BIGINT AS updated, count_if(d.doc_id IS NULL)::BIGINT AS deleted, count_if(n_chars = n AND d.h = i.h)::BIGINT AS same FROM d FULL JOIN i USING (doc_id)""")
def refresh_counters(spark, sf_dir):
    return I.counters(index_changes(spark, sf_dir))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS b, len(string_split(text, chr(10))) AS n FROM documents), c AS (SELECT doc_id, n, b, unnest(range(0, CASE WHEN b <= 8192 THEN 1 ELSE (n - 1) // 5 + 1 END)) AS i FROM d)
SELECT doc_id, i::INT AS chunk, (CASE WHEN b <= 8192 THEN 1 ELSE i * 5 + 1 END)::INT AS first, (CASE WHEN b <= 8192 THEN n ELSE least(i * 5 + 5, n) END)::INT AS last FROM c""")
def index_chunks(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return I.chunks(docs, 5).join(docs.select("rel_path", "doc_id"), "rel_path").select("doc_id", "chunk", "first", "last")


@query("""WITH k AS (SELECT event_id, unnest(json_keys(props)) AS name, props FROM events) SELECT name, CASE json_type(props, '$.' || name) WHEN 'OBJECT' THEN '{object}' WHEN 'ARRAY' THEN '[array]' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, count(*) AS n FROM k GROUP BY ALL""")
def json_keys(spark, sf_dir):
    return D.keys_of(table(spark, sf_dir, "events"), "props", "event_id").groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n, len(string_split(text, chr(10))) AS last FROM documents)
SELECT doc_id, n::INT AS line_no, md5(line) AS line FROM l WHERE n <= 6 OR n > last - 2""")
def head_and_tail(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rel_path"), "text")
    return D.text_overview(docs, 6, 2).select(F.col("rel_path").alias("doc_id"), "line_no", F.md5("line").alias("line"))


@query("""WITH s AS (SELECT *, octet_length(encode(c_custkey || ' | ' || c_name || ' | ' || c_nationkey || ' | ' || c_acctbal || ' | ' || c_mktsegment)) + 1 AS b FROM customer WHERE contains(lower(c_mktsegment), 'build') OR contains(lower(c_name), 'build') OR contains(c_custkey::VARCHAR, 'build') OR contains(c_nationkey::VARCHAR, 'build') OR contains(c_acctbal::VARCHAR, 'build')),
c AS (SELECT *, coalesce(sum(b) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s) SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM c WHERE before < 5000""")
def data_search(spark, sf_dir):
    return D.found_rows(table(spark, sf_dir, "customer"), "BUILD", ["c_custkey"], 5000)


@query(f"""WITH e AS (SELECT vec_id, text, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang IN ('en', 'fr') AND contains(source, '1')),
s AS (SELECT vec_id AS id, 0.7 * list_dot_product(v, {VECTOR_SQL}) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product({VECTOR_SQL}, {VECTOR_SQL}))) + 0.3 * (contains(lower(text), 'the')::INT + contains(lower(text), 'ing')::INT) / 2.0 AS score FROM e)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY s.score DESC, id)::INT AS rank FROM s ORDER BY s.score DESC, id LIMIT 20""")
def journal_recall(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id"))
    entries = docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    entries = entries.select("id", F.col("text").alias("intent"), F.lit("").alias("decision"), F.array("lang").alias("tags"), F.col("source").alias("project_path"), "vector")
    return S.recall(entries, "The ING", VECTOR, 20, ["EN", "fr"], "1").select("id", F.round("score", 6).alias("score"), "rank")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS at FROM events")
def event_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.utc_time(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("at"))


@query("""SELECT conv_id, turn, lag(trim(text, ' ' || chr(9) || chr(13) || chr(10))) OVER (PARTITION BY conv_id, role ORDER BY turn) IS DISTINCT FROM trim(text, ' ' || chr(9) || chr(13) || chr(10)) AS changed FROM conversations""")
def changed_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.lit("n").alias("namespace"), F.col("conv_id").alias("path"), F.col("role").alias("symbol"), F.col("text").alias("code"), F.col("turn").alias("created_unix_ms"), F.lit("").alias("tag"))
    return H.versions(rows).select(F.col("path").alias("conv_id"), F.col("created_unix_ms").alias("turn"), "changed")


@query(f"""WITH p AS (SELECT page_id, {ADDRESS} AS p, (SELECT min(split_part({ADDRESS}, '/', 1)) FROM pages) AS s FROM pages) SELECT page_id FROM p WHERE p = s OR starts_with(p, s || '/')""")
def scope_filter(spark, sf_dir):
    pages = page_files(spark, sf_dir)
    first = pages.agg(F.min(F.split("rel_path", "/")[0]).alias("scope"))
    return pages.join(F.broadcast(first), X.in_scope_of(F.col("rel_path"), F.col("scope"))).select("page_id")  # one row


@query(r"""WITH w AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, n, unnest(regexp_extract_all(line, '[\p{L}_$][\p{L}\p{N}_$]*')) AS name FROM w),
p AS (SELECT name, doc_id, count(*) AS uses, array_to_string(list_sort(list(DISTINCT n)), ',') AS lines FROM t GROUP BY ALL), a AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\p{L}_$][\p{L}\p{N}_$]*')) AS name FROM benchmark)
SELECT name, doc_id, uses, lines FROM p SEMI JOIN a USING (name)""")
def name_postings(spark, sf_dir):
    rows = O.of_lines(files.lines(table(spark, sf_dir, "documents"), key="doc_id"), "doc_id")
    names = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(O.WORD), 0)).alias("name"))
    return O.found(rows, names, "doc_id").select("name", "doc_id", "uses", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query("""WITH k AS (SELECT event_id, props, 'k' AS path, json_extract(props, '$.k')::VARCHAR AS v FROM events), r AS (SELECT event_id, path, instr(props, ': ' || v) + 1 AS first_byte, length(v) AS n FROM k WHERE v IS NOT NULL)
SELECT event_id, path, first_byte::BIGINT AS first_byte, (first_byte + n)::BIGINT AS last_byte FROM r UNION ALL SELECT event_id, '', 0, octet_length(encode(props))::BIGINT FROM events""")
def json_byte_ranges(spark, sf_dir):
    return J.byte_ranges(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "path", "first_byte", "last_byte")


@query("SELECT event_id, regexp_replace(props, '(\"k\": )[0-9.]+', '\\1null') AS props FROM events")
def json_splices(spark, sf_dir):
    return J.spliced(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k", "null")


@query(r"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '') AS path FROM pages), s AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')) AS l FROM p)
SELECT page_id, CASE WHEN len(l) < 2 THEN CASE WHEN len(l) = 1 THEN 'x.html' END ELSE array_to_string(l[1:len(l) - 2] || ['x.html'], '/') END AS target FROM s WHERE len(l) >= 1 UNION ALL SELECT page_id, NULL FROM s WHERE len(l) = 0""")
def sibling_paths(spark, sf_dir):
    """Where the link ``../x.html``, or at the top ``x.html``, in a page's folder leads."""
    path = P.uri_path(F.col("url"))
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    folder = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    link = F.when(F.size(parts) == 1, "./x.html").otherwise("../x.html")
    return table(spark, sf_dir, "pages").select("page_id", P.joined(folder, link).alias("target"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
