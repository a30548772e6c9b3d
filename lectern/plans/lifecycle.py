"""Queries on tables that belong together: totals, replacement, deletion, threads, exports, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import evidence, joins, lifecycle, structure
from lectern.plans.retrieval import table
from lectern.sinks import markdown as sink
from lectern.sources import files


def book_char_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a book, customers' names its sections; those in BUILDING are headings."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    on = (F.col("n_nationkey") == F.col("c_nationkey")) & (F.col("c_mktsegment") != "BUILDING")
    return joins.left_total(nation, customer, on, ["n_nationkey", "n_name"], F.length("c_name"), "chars")


def low_content_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book_id"), "text", F.when(F.col("doc_id") % 10 == 0, "heading").otherwise("p").alias("kind"))
    return lifecycle.content_warning(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), sections)


def anchors_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders left-joined with the first part of their later lines, those without last."""
    from pyspark.sql import Window

    first = table(spark, sf_dir, "lineitem").where("l_shipdate >= '1995-01-01'").groupBy("l_orderkey").agg(F.min("l_partkey").alias("seq"))
    joined = table(spark, sf_dir, "orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("seq").asc_nulls_last(), "o_orderkey"))
    return joined.select("o_custkey", "o_orderkey", "seq", place.alias("place"))


def notes_with_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("title"))


def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    new = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.lit(0).cast("long").alias("o_custkey"), F.col("l_orderkey").alias("id"), F.lit("new").alias("state")).distinct()
    return joins.upsert(old, new, ["id"])


def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log as changes of a user's state; a signup deletes it."""
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "signup").alias("gone"))
    return joins.latest(log, ["user_id"], ["ts", "event_id"], "gone").select("user_id", "event_id", "event_type")


def _gone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders whose customer is not deleted, by return flag."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    left = lifecycle.without(table(spark, sf_dir, "lineitem"), _gone(spark, sf_dir), "o_custkey", orders, "l_orderkey")
    return left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def dropped_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return lifecycle.dropped_counts({"orders": orders, "open orders": orders.where("o_orderstatus = 'O'")}, _gone(spark, sf_dir), "o_custkey")


def replace_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return lifecycle.replaced(part.where("p_size < 30"), part.where("p_size > 10"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named by supplier; those of nations 0 to 9 are alive."""
    supplier = table(spark, sf_dir, "supplier")
    named = supplier.select(F.concat(F.lit("books/"), F.when(F.col("s_suppkey") % 9 == 0, F.concat(F.lit("tmp"), F.col("s_suppkey").cast("string"))).otherwise(F.col("s_suppkey").cast("string")), F.lit(".pdf")).alias("path"))
    return lifecycle.orphans(named, supplier.where("s_nationkey < 10").select(F.col("s_suppkey").cast("string").alias("id")))


def reanchor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes on benchmark texts, anchored at sections that are gone, find them again in documents."""
    notes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("all").alias("chapter_id"), F.when(F.col("item_id") % 5 == 0, F.col("item_id").cast("string")).otherwise(F.concat(F.lit("old"), F.col("item_id").cast("string"))).alias("anchor_id"), F.col("text").alias("quoted"))
    old = notes.select(F.col("anchor_id").alias("id"), F.lit("").alias("text"))
    new = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit("all").alias("chapter_id"), "text", F.col("doc_id").alias("ord"))
    return lifecycle.reanchored(notes, old, new).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def thread_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.thread_titles(table(spark, sf_dir, "conversations"), key="conv_id", order="turn")


def latest_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of a book (their id modulo 5), the longest as the newest."""
    threads = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("updated")).withColumn("book", F.col("conv_id") % 5)
    return lifecycle.recent(threads, ["book"], "updated", "conv_id").where("place <= 3").select("book", "place", "conv_id")


def answer_event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("role").alias("meta"), F.col("text").alias("answer"), F.lit("ok").alias("result"))
    return evidence.answer_events(answers)


def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which every fifth breaks off after two events."""
    failed = table(spark, sf_dir, "conversations").where("(conv_id + turn) % 5 = 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.lit(2).alias("after"), F.lit("gone").alias("message"))
    return evidence.broken_off(answer_event_rows(spark, sf_dir), failed)


def sse_frame_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("event: meta\ndata: "), "role", F.lit("\n\nevent: done\ndata: "), F.col("turn").cast("string"), F.lit("\n\n: pause\n\n"))
    return evidence.parse_frames(table(spark, sf_dir, "conversations").select("conv_id", "turn", body.alias("body")))


def normalize_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.match_form(F.col("text")).cast("binary")).alias("form"))


def format_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".PDF", ".docx", ".doc", ".md", "", ".bin")]), (F.col("page_id") % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "pages").select("page_id", files.format_of(F.concat(F.lit("f/a"), suffix), F.when(F.col("page_id") % 4 == 0, "text/html").otherwise("image/png")).alias("format"))
    return named


def html_text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n``` so far"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(X.json_text(noisy), "$.k").cast("int").alias("k"))


def noisy_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("see ["), "props", F.lit(", "), "props", F.lit("] there"))
    return table(spark, sf_dir, "events").select("event_id", F.size(F.from_json(X.json_text(noisy, "[", "]"), "array<struct<k:int>>")).alias("n"))


def _assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("pos") % 7 == 0, 1).when(F.col("pos") % 3 == 0, 2).otherwise(0)
    rows = structure.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text")).select("book", "pos", X.strip(F.col("raw")).alias("text"), level.alias("level"))
    return structure.assembled(rows)


def bundle_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.bundle(_assembled(spark, sf_dir))[1]


def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("lang").alias("note"), F.lit("").alias("content_warning"))
    return sink.assembled_markdown(books, _assembled(spark, sf_dir))


def manifest_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests, written and read back as rows."""
    level = F.when(F.col("pos") % 7 == 0, 1).otherwise(0)
    rows = structure.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text")).select("book", "pos", X.strip(F.col("raw")).alias("text"), level.alias("level"))
    found = structure.pipeline_chapters(rows).withColumn("part", (F.floor((F.col("nth") - 1) / 10) + 1).cast("int"))
    return files.manifest_rows(sink.manifest(found)).select("book", "chapter", "part", "nth", "anchor", F.length("text").alias("chars"))


def mindmap_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("ch"), F.col("n_regionkey").cast("string")).alias("chapter"), F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")).alias("chapter_title"), F.col("n_name").alias("concept"), F.array_repeat(F.lit("x"), F.col("n_nationkey") % 3).alias("prerequisites"))
    return sink.mind_map(nodes, "World")


_ASSEMBLED = r"""WITH l AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
o AS (SELECT book, pos, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, CASE WHEN pos % 7 = 0 THEN 1 WHEN pos % 3 = 0 THEN 2 ELSE 0 END AS level FROM l),
c AS (SELECT *, greatest(CAST(sum(CAST(level = 1 AS INT)) OVER (PARTITION BY book ORDER BY pos) AS BIGINT), 1) AS chapter FROM o WHERE text <> ''),
t AS (SELECT *, coalesce(max(text) FILTER (WHERE level = 1) OVER (PARTITION BY book, chapter), '') AS title FROM c),
a AS (SELECT book, title, text, CAST(dense_rank() OVER (PARTITION BY book ORDER BY chapter) AS INT) AS num, CAST(row_number() OVER (PARTITION BY book, chapter ORDER BY pos) AS INT) AS seq,
  CAST(1 + coalesce(sum(length(text)) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1200 AS INT) AS page,
  CASE WHEN level = 2 THEN 'heading' WHEN length(text) <= 80 AND regexp_matches(text, '[=∑∫→≤≥]|[a-zA-Z]\s*\(|x\^|_\{') THEN 'formula' ELSE 'p' END AS kind FROM t WHERE level <> 1)"""
_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    f.__name__: f
    for f in (
        book_char_totals, low_content_warning, anchors_ordered, notes_with_titles, upsert_replace, latest_by_key, cascade_delete, dropped_counts, replace_diff, orphans, reanchor_counts, thread_titles, latest_threads, answer_event_rows, error_events,
        sse_frame_parse, normalize_match, format_detect, html_text_clean, json_extract, noisy_json_array, bundle_sections, markdown_export, manifest_nested, mindmap_outline,
    )
}

ORACLE = {
    "book_char_totals": "SELECT n_nationkey, n_name, CAST(coalesce(sum(length(c_name)), 0) AS BIGINT) AS chars FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_mktsegment <> 'BUILDING' GROUP BY ALL",
    "low_content_warning": """WITH d AS (SELECT doc_id AS id, CAST(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE length(text) END AS BIGINT) AS chars FROM documents)
SELECT id, chars, CASE WHEN chars < 500 THEN '整本教材只解析出 ' || chars || ' 个字的正文，内容可能大部分没被读出来' ELSE '' END AS warning FROM d""",
    "anchors_ordered": """WITH f AS (SELECT l_orderkey, min(l_partkey) AS seq FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' GROUP BY l_orderkey)
SELECT o_custkey, o_orderkey, seq, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY seq NULLS LAST, o_orderkey) AS INT) AS place FROM orders LEFT JOIN f ON o_orderkey = l_orderkey""",
    "notes_with_titles": "SELECT s_suppkey, coalesce(n_name, '') AS title FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey",
    "upsert_replace": """WITH n AS (SELECT DISTINCT CAST(0 AS BIGINT) AS o_custkey, l_orderkey AS id, 'new' AS state FROM lineitem WHERE l_quantity > 40)
SELECT o_custkey, o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n""",
    "latest_by_key": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1 AND event_type <> 'signup'",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) GROUP BY ALL",
    "dropped_counts": "WITH o AS (SELECT * FROM orders WHERE o_custkey % 10 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) SELECT 'orders' AS name, count(*) AS n FROM o UNION ALL SELECT 'open orders', count(*) FROM o WHERE o_orderstatus = 'O'",
    "replace_diff": "SELECT p_partkey AS id, CASE WHEN p_size < 30 AND p_size > 10 THEN 'updated' WHEN p_size > 10 THEN 'added' ELSE 'removed' END AS state FROM part",
    "orphans": """SELECT 'books/' || CASE WHEN s_suppkey % 9 = 0 THEN 'tmp' ELSE '' END || s_suppkey || '.pdf' AS path, CASE WHEN s_suppkey % 9 = 0 THEN 'unrecognized' ELSE 'orphan' END AS state FROM supplier WHERE s_suppkey % 9 = 0 OR s_nationkey >= 10""",
    "reanchor_counts": r"""WITH n AS (SELECT item_id, item_id % 5 = 0 AND item_id IN (SELECT doc_id FROM documents) AS live, regexp_replace(text, '[\s\-\x{2010}-\x{2014}]', '', 'g') AS needle FROM benchmark),
p AS (SELECT regexp_replace(text, '[\s\-\x{2010}-\x{2014}]', '', 'g') AS form FROM documents),
f AS (SELECT live, length(needle) >= 4 AND EXISTS (SELECT 1 FROM p WHERE contains(form, needle)) AS found FROM n)
SELECT CASE WHEN live THEN 'kept' WHEN found THEN 'moved' ELSE 'unanchored' END AS state, count(*) AS n FROM f GROUP BY ALL""",
    "thread_titles": rf"""WITH t AS (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user' AND {_TRIM} <> '') AS text, count(*) AS messages FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id, messages, coalesce({_TRIM}, '新对话') AS t FROM t)
SELECT conv_id, CASE WHEN length(t) > 24 THEN substr(t, 1, 24) || '…' ELSE t END AS title, messages FROM c""",
    "latest_threads": """WITH t AS (SELECT conv_id, conv_id % 5 AS book, max(turn) AS updated FROM conversations GROUP BY conv_id)
SELECT * FROM (SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY updated DESC, conv_id DESC) AS INT) AS place, conv_id FROM t) WHERE place <= 3""",
    "answer_event_rows": """WITH a AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id + turn) % 5 = 0 AS broken, role, text, CAST(ceil(length(text) / 14.0) AS INT) AS n FROM conversations),
e AS (SELECT request_id, broken, role, text, n, unnest(range(0, n + 2)) AS seq FROM a)
SELECT request_id, CAST(seq AS INT) AS seq, CASE WHEN seq = 0 THEN 'meta' WHEN seq = n + 1 THEN 'done' ELSE 'delta' END AS event, CASE WHEN seq = 0 THEN role WHEN seq = n + 1 THEN 'ok' ELSE substr(text, (seq - 1) * 14 + 1, 14) END AS payload FROM e""",
    "error_events": """WITH a AS (SELECT conv_id * 1000 + turn AS request_id, (conv_id + turn) % 5 = 0 AS broken, role, text, CAST(ceil(length(text) / 14.0) AS INT) AS n FROM conversations),
e AS (SELECT request_id, broken, role, text, n, unnest(range(0, n + 2)) AS seq FROM a)
SELECT request_id, CAST(seq AS INT) AS seq, CASE WHEN seq = 0 THEN 'meta' WHEN seq = n + 1 THEN 'done' ELSE 'delta' END AS event, CASE WHEN seq = 0 THEN role WHEN seq = n + 1 THEN 'ok' ELSE substr(text, (seq - 1) * 14 + 1, 14) END AS payload FROM e WHERE NOT broken OR seq < 2
UNION ALL SELECT request_id, 2, 'error', 'gone' FROM a WHERE broken""",
    "bundle_sections": f"""{_ASSEMBLED} SELECT book || '-s' || num || '-' || seq AS id, CAST(book AS VARCHAR) AS book_id, book || '-ch' || num AS chapter_id, seq, text, page, kind FROM a""",
    "markdown_export": f"""{_ASSEMBLED},
s AS (SELECT book, num, title, string_agg('<!-- page: ' || page || ' -->' || chr(10) || CASE kind WHEN 'heading' THEN '### ' || text WHEN 'formula' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY seq) AS body FROM a GROUP BY ALL),
b AS (SELECT book, string_agg('## ' || CASE WHEN title = '' THEN '未命名章节' ELSE title END || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY num) AS chapters FROM s GROUP BY book)
SELECT CAST(doc_id AS VARCHAR) AS book_id, regexp_replace('# ' || source || chr(10) || chr(10) || '> ' || lang || coalesce(chr(10) || chr(10) || chapters, ''), '\\s+$', '') || chr(10) AS markdown FROM documents LEFT JOIN b ON book = doc_id""",
    "sse_frame_parse": "SELECT conv_id, turn, 0 AS seq, 'meta' AS event, role AS data FROM conversations UNION ALL SELECT conv_id, turn, 1, 'done', CAST(turn AS VARCHAR) FROM conversations",
    "normalize_match": r"SELECT doc_id, md5(regexp_replace(text, '[\s\-\x{2010}-\x{2014}]', '', 'g')) AS form FROM documents",
    "format_detect": "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'doc' WHEN 3 THEN 'text' ELSE CASE WHEN page_id % 4 = 0 THEN 'text' END END AS format FROM pages",
    "html_text_clean": r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g') AS b FROM pages)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM b""",
    "json_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "noisy_json_array": "SELECT event_id, 2 AS n FROM events",
    "manifest_nested": """WITH l AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
o AS (SELECT book, pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM l),
k AS (SELECT *, pos % 7 = 0 OR regexp_matches(text, '(?i)^\\s*(?:[0-9]+(?:\\.[0-9]+)*\\s+[^\\s，。；：]{1,30}|chapter\\s+[0-9]+(?:\\s*[:：\\-–]\\s*.*)?)\\s*$') AS starts FROM o WHERE text <> ''),
c AS (SELECT *, greatest(CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY book ORDER BY pos) AS BIGINT), 1) AS chapter FROM k),
n AS (SELECT *, row_number() OVER (PARTITION BY book, chapter ORDER BY CAST(NOT starts AS INT), pos) AS g FROM c)
SELECT book, chapter, CAST((g - 1) // 10 + 1 AS INT) AS part, CAST((g - 1) % 10 AS INT) AS nth, 'ch' || chapter || '-p' || lpad(CAST(g AS VARCHAR), 3, '0') AS anchor, CAST(length(text) AS INT) AS chars FROM n""",
    "mindmap_outline": """WITH r AS (SELECT n_regionkey, '  - Region ' || n_regionkey || chr(10) || string_agg('    - ' || n_name, chr(10) ORDER BY n_nationkey % 3, n_name) AS t FROM nation GROUP BY n_regionkey)
SELECT '- World' || chr(10) || string_agg(t, chr(10) ORDER BY n_regionkey) AS outline FROM r""",
}
