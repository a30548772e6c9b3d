"""Queries on structure and packing. A document is a book here, its lines are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import chunking, structure
from lectern.plans.retrieval import table


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text"))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with invented levels: every 7th is a chapter, every 3rd other a section, so that outlines exist."""
    level = F.when(F.col("pos") % 7 == 0, 1).when(F.col("pos") % 3 == 0, 2).otherwise(0)
    return _lines(spark, sf_dir).select("book", "pos", X.strip(F.col("raw")).alias("text"), level.alias("level"))


def virtual_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.virtual_pages(_lines(spark, sf_dir), text="raw").select("book", "pos", "page")


def fence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line whose number is 3 modulo 9 becomes a fence."""
    fenced = _lines(spark, sf_dir).withColumn("raw", F.when(F.col("pos") % 9 == 3, "```").otherwise(F.col("raw")))
    return structure.outline_rows(fenced, "b").groupBy("book").agg(F.count(F.lit(1)).alias("rows"), F.sum("pos").alias("places"))


def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.level_counts(_outline(spark, sf_dir))


def chapter_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.blocks(_outline(spark, sf_dir))
    return found.groupBy("book", "chapter").agg(F.count(F.lit(1)).alias("rows"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count_if(F.col("kind") == "heading").alias("headings"))


def assembled_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.assembled(_outline(spark, sf_dir)).select("book", "num", "seq", "page", F.length("text").alias("chars"))


def pipeline_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pipeline_chapters(_outline(spark, sf_dir)).select("book", "chapter", "nth", "pos")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = structure.virtual_pages(_lines(spark, sf_dir), text="raw").where("pos % 7 = 0").select("book", (F.col("pos") / 7 + 1).cast("int").alias("num"), F.col("page").alias("page_start"))
    return structure.page_ranges(starts, F.lit(99))


def margin_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a book here and a document one of its pages."""
    paged = structure.lines(table(spark, sf_dir, "documents").select(F.struct(F.col("source").alias("book"), F.col("doc_id").alias("page")).alias("book"), "text")).select("book.book", "book.page", F.col("raw").alias("text"))
    return structure.margin_lines(paged, ratio=0.1)


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines become page numbers, dot leaders and addresses; an address within a line is none."""
    odd = F.col("pos") % 11
    planted = F.when(odd == 3, F.concat(F.lit("- "), F.col("pos").cast("string"), F.lit(" -"))).when(odd == 5, F.concat(F.substring("raw", 1, 20), F.lit(" . . . . . . 7"))).when(odd == 7, "https://example.com/a?b=1").when(odd == 9, F.concat(F.lit("at www.example.com "), "raw"))
    return _lines(spark, sf_dir).withColumn("raw", F.coalesce(planted, "raw")).select("book", "pos", X.strip(F.col("raw")).alias("t")).where(X.is_noise_line(F.col("t"))).select("book", "pos")


def book_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first line is its only heading of level 1, chapters are of level 2."""
    odd = F.col("pos") % 7 == 3
    rows = _lines(spark, sf_dir).select("book", "pos", F.when(odd, F.concat(F.lit("Chapter "), F.col("pos").cast("string"))).otherwise(X.strip(F.col("raw"))).alias("text"), F.when(F.col("pos") == 0, 1).when(odd, 2).otherwise(0).alias("level"))
    return structure.titled(rows)


def page_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 7).alias("page"))
    return structure.page_set(pages, ["source"]).select("source", F.array_join(F.col("pages").cast("array<string>"), " ").alias("pages"))


def paragraph_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.reflow(_lines(spark, sf_dir), text="raw")


def scan_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.probe(_lines(spark, sf_dir).select("book", F.col("pos").alias("page"), F.col("raw").alias("text"))).select("book", "pages", F.round("chars_per_page", 6).alias("chars_per_page"), "scanned")


def body_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are as high as they are long."""
    return structure.body_height(_lines(spark, sf_dir).select("book", F.length("raw").alias("height")))


def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user: hours are pages, days are printed numbers."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.hour("ts").alias("page"), F.col("event_id").alias("ord"), F.dayofmonth("ts").alias("number"))
    return structure.page_offset(seen)


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(chunking.chunks(_paragraphs(spark, sf_dir), ["book"]))


def _joined(packs: DataFrame) -> DataFrame:
    return packs.withColumn("anchors", F.array_join("anchors", " "))


def part_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(chunking.parts(_paragraphs(spark, sf_dir), ["book"], limit=2000))


def summary_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(chunking.summary_chunks(_paragraphs(spark, sf_dir), ["book"]))


def page_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as boxes, one below the other, as high as a fifth of their length."""
    from pyspark.sql import Window

    before = Window.partitionBy("book").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    boxes = _lines(spark, sf_dir).withColumn("h", F.length("raw") / 5.0).withColumn("top", F.coalesce(F.sum("h").over(before), F.lit(0.0)))
    return chunking.page_packs(boxes.select("book", F.col("pos").alias("ord"), "top", (F.col("top") + F.col("h")).alias("bottom")), ["book"]).select("book", "ord", "pack")


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("book", "pos", F.concat(F.lit("p"), F.col("pos").cast("string")).alias("anchor"), F.col("raw").alias("text"))


def material_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book's first paragraphs, with their anchors in brackets, up to 1500 characters."""
    used = chunking.within_budget(_paragraphs(spark, sf_dir), ["book"], "pos", F.length("text") + F.length("anchor") + 3, 1500)
    return used.groupBy("book").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("chars"))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.text_statistics(table(spark, sf_dir, "documents"), ["lang"])


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


_LINES = "l AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_TRIM = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
_OUTLINE = f"{_LINES}, o AS (SELECT book, pos, {_TRIM} AS text, CASE WHEN pos % 7 = 0 THEN 1 WHEN pos % 3 = 0 THEN 2 ELSE 0 END AS level FROM l)"
_BLOCKS = f"""{_OUTLINE}, k AS (SELECT *, level = 1 AS starts FROM o WHERE text <> ''),
c AS (SELECT *, greatest(CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY book ORDER BY pos) AS BIGINT), 1) AS chapter FROM k),
b AS (SELECT book, pos, chapter, CASE WHEN level > 1 THEN 'heading' ELSE 'p' END AS kind, text FROM c WHERE NOT starts)"""

QUERIES = {
    f.__name__: f
    for f in (
        virtual_pages, fence_filter, heading_levels, chapter_segments, assembled_book, pipeline_chapters, page_ranges, margin_lines, noise_lines, book_titles, page_sets, paragraph_reflow, scan_probe, body_height, page_offset,
        chunk_packing, part_packing, summary_chunks, page_packing, material_budget, text_stats, token_estimate,
    )
}



def _packed(segments: str, start: str, step: str, state: str, number: str, glue: str) -> str:
    """SQL of a greedy packing: segments (book, pos, k, t) in order, the state of the first one, what each next one makes of it, and the pack's column."""
    return f"""WITH RECURSIVE {_LINES}, g AS ({segments}),
s AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos, k) AS i FROM g),
p AS (SELECT book, i, {start} FROM s WHERE i = 1 UNION ALL SELECT s.book, s.i, {step} FROM p JOIN s ON s.book = p.book AND s.i = p.i + 1),
a AS (SELECT book, {state}, pos, min(i) AS i FROM p JOIN s USING (book, i) GROUP BY ALL)
SELECT book, CAST({state} AS INT) AS {number}, string_agg(t, {glue} ORDER BY i) AS text, (SELECT string_agg('p' || a.pos, ' ' ORDER BY a.i) FROM a WHERE a.book = q.book AND a.{state} = q.{state}) AS anchors
FROM (SELECT * FROM p JOIN s USING (book, i)) q GROUP BY book, {state}"""


_SLICED = "SELECT book, pos, raw, unnest(range(0, CAST(ceil(greatest(length(raw), 1) / {size}) AS INT))) AS k FROM l"

ORACLE = {
    "chunk_packing": _packed(
        r"SELECT book, pos, k, regexp_replace(substr(raw, k * size + 1, size), '^\s+|\s+$', '', 'g') AS t FROM (SELECT *, unnest(range(0, CAST(ceil(length(raw) / CAST(size AS DOUBLE)) AS INT))) AS k FROM (SELECT *, CASE WHEN length(raw) > 1000 THEN 500 ELSE greatest(length(raw), 1) END AS size FROM l)) WHERE regexp_replace(substr(raw, k * size + 1, size), '^\s+|\s+$', '', 'g') <> ''",
        "1 AS c, length(t) AS held",
        "CASE WHEN p.held + length(s.t) > 500 THEN p.c + 1 ELSE p.c END, CASE WHEN p.held + length(s.t) > 500 THEN length(s.t) ELSE p.held + length(s.t) END",
        "c", "chunk", "''",
    ),
    "part_packing": _packed(
        "SELECT book, pos, k, substr(raw, k * 2000 + 1, 2000) AS t, k = 0 AND length(raw) > 2000 AS opens FROM (" + _SLICED.format(size="2000.0") + ")",
        "1 AS c, length(t) AS held",
        "CASE WHEN s.opens OR p.held + length(s.t) > 2000 THEN p.c + 1 ELSE p.c END, CASE WHEN NOT s.opens AND p.held + length(s.t) > 2000 THEN length(s.t) ELSE p.held + length(s.t) END",
        "c", "part", "chr(10)",
    ),
    "summary_chunks": _packed(
        "SELECT book, pos, 0 AS k, raw AS t FROM l WHERE raw <> ''",
        "1 AS c, length(t) AS held, 1 AS n",
        "CASE WHEN p.n >= 8 OR p.held + length(s.t) > 4000 THEN p.c + 1 ELSE p.c END, CASE WHEN p.n >= 8 OR p.held + length(s.t) > 4000 THEN length(s.t) ELSE p.held + length(s.t) END, CASE WHEN p.n >= 8 OR p.held + length(s.t) > 4000 THEN 1 ELSE p.n + 1 END",
        "c", "chunk", "''",
    ),
    "book_titles": f"""WITH {_LINES}, t AS (SELECT book, pos, {_TRIM} AS t FROM l)
SELECT book, CASE WHEN max(pos) >= 3 THEN max(t) FILTER (WHERE pos = 0) ELSE '' END AS title FROM t GROUP BY book""",
    "page_sets": "SELECT source, array_to_string(list_sort(list(DISTINCT doc_id % 7) FILTER (WHERE doc_id % 7 <> 0)), ' ') AS pages FROM documents GROUP BY source",
    "paragraph_reflow": rf"""WITH {_LINES}, t AS (SELECT book, pos, {_TRIM} AS t FROM l),
u AS (SELECT *, t = '' OR ((regexp_matches(t, '[。．？！；：!?;”』」…]$') OR regexp_matches(t, '(^|[^0-9])\.\s*$')) AND length(t) > 6) AS ends FROM t
      WHERE NOT ((length(t) <= 8 AND regexp_matches(t, '^[\d\s\-—.·]+$')) OR regexp_matches(t, '(?:\.\s*){{5,}}|…{{4,}}|⋯{{4,}}') OR regexp_matches(t, '^(?:https?://|www\.)\S+$')) OR t = ''),
p AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paragraph FROM u)
SELECT book, CAST(paragraph AS BIGINT) AS paragraph, regexp_replace(string_agg(t, '' ORDER BY pos), '^\s+|\s+$', '', 'g') AS text FROM p WHERE t <> '' GROUP BY ALL""",
    "page_packing": f"""WITH RECURSIVE {_LINES}, h AS (SELECT book, pos, CAST(length(raw) AS DOUBLE) / 5.0 AS h FROM l),
b AS (SELECT book, pos, coalesce(sum(h) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS top, h FROM h),
p AS (SELECT book, pos, top AS first, 0 AS pack FROM b WHERE pos = 0
      UNION ALL SELECT b.book, b.pos, CASE WHEN b.top + b.h - p.first > 660 THEN b.top ELSE p.first END, CASE WHEN b.top + b.h - p.first > 660 THEN p.pack + 1 ELSE p.pack END FROM p JOIN b ON b.book = p.book AND b.pos = p.pos + 1)
SELECT book, CAST(pos AS INT) AS ord, CAST(pack AS INT) AS pack FROM p""",
    "virtual_pages": f"WITH {_LINES} SELECT book, CAST(pos AS INT) AS pos, CAST(1 + coalesce(sum(length(raw)) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1200 AS INT) AS page FROM l",
    "fence_filter": f"""WITH {_LINES}, s AS (SELECT *, sum(CAST(pos % 9 = 3 AS INT)) OVER (PARTITION BY book ORDER BY pos) % 2 AS inside FROM l)
SELECT book, count(*) AS rows, CAST(sum(pos) AS BIGINT) AS places FROM s WHERE pos % 9 <> 3 AND inside = 0 GROUP BY book""",
    "heading_levels": f"WITH {_OUTLINE} SELECT book, level, count(*) AS n, count(*) FILTER (WHERE regexp_matches(text, '(?i)^\\s*(chapter\\s*\\d+|part\\s*\\d+)')) AS hits FROM o WHERE level >= 1 AND text <> '' GROUP BY ALL",
    "chapter_segments": f"WITH {_BLOCKS} SELECT book, CAST(chapter AS BIGINT) AS chapter, count(*) AS rows, CAST(min(pos) AS INT) AS first, CAST(max(pos) AS INT) AS last, count(*) FILTER (WHERE kind = 'heading') AS headings FROM b GROUP BY ALL",
    "assembled_book": f"""WITH {_BLOCKS} SELECT book, CAST(dense_rank() OVER (PARTITION BY book ORDER BY chapter) AS INT) AS num, CAST(row_number() OVER (PARTITION BY book, chapter ORDER BY pos) AS INT) AS seq,
CAST(1 + coalesce(sum(length(text)) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1200 AS INT) AS page, CAST(length(text) AS INT) AS chars FROM b""",
    "pipeline_chapters": rf"""WITH {_OUTLINE}, k AS (SELECT *, level = 1 OR regexp_matches(text, '(?i)^\s*(?:[0-9]+(?:\.[0-9]+)*\s+[^\s，。；：]{{1,30}}|chapter\s+[0-9]+(?:\s*[:：\-–]\s*.*)?)\s*$') AS starts FROM o WHERE text <> ''),
c AS (SELECT *, greatest(CAST(sum(CAST(starts AS INT)) OVER (PARTITION BY book ORDER BY pos) AS BIGINT), 1) AS chapter FROM k)
SELECT book, chapter, CAST(row_number() OVER (PARTITION BY book, chapter ORDER BY CAST(NOT starts AS INT), pos) AS INT) AS nth, CAST(pos AS INT) AS pos FROM c""",
    "page_ranges": f"""WITH {_LINES}, v AS (SELECT book, pos, 1 + coalesce(sum(length(raw)) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 1200 AS page FROM l)
SELECT book, CAST(pos // 7 + 1 AS INT) AS num, CAST(page AS INT) AS page_start, CAST(greatest(coalesce(lead(page) OVER (PARTITION BY book ORDER BY page, pos) - 1, 99), page) AS INT) AS page_end FROM v WHERE pos % 7 = 0""",
    "margin_lines": """WITH l AS (SELECT source AS book, doc_id AS page, regexp_replace(unnest(string_split(text, chr(10))), '\\s+', '', 'g') AS line FROM documents),
p AS (SELECT book, count(DISTINCT page) AS pages FROM l GROUP BY book HAVING count(DISTINCT page) >= 3)
SELECT book, line FROM (SELECT book, line, count(*) AS n FROM l WHERE line <> '' GROUP BY ALL) JOIN p USING (book) WHERE n >= greatest(3, floor(pages * 0.1))""",
    "noise_lines": rf"""WITH {_LINES}, m AS (SELECT book, pos, CASE pos % 11 WHEN 3 THEN '- ' || pos || ' -' WHEN 5 THEN substr(raw, 1, 20) || ' . . . . . . 7' WHEN 7 THEN 'https://example.com/a?b=1' WHEN 9 THEN 'at www.example.com ' || raw ELSE raw END AS raw FROM l), t AS (SELECT book, pos, {_TRIM} AS t FROM m)
SELECT book, CAST(pos AS INT) AS pos FROM t WHERE (length(t) <= 8 AND regexp_matches(t, '^[\d\s\-—.·]+$')) OR regexp_matches(t, '(?:\.\s*){{5,}}|…{{4,}}|⋯{{4,}}') OR regexp_matches(t, '^(?:https?://|www\.)\S+$')""",
    "scan_probe": f"""WITH {_LINES}, n AS (SELECT book, count(*) AS pages FROM l GROUP BY book),
s AS (SELECT book, pages, avg(length({_TRIM})) AS c FROM l JOIN n USING (book) WHERE pos % greatest(1, pages // 12) = 0 GROUP BY ALL)
SELECT book, pages, round(c, 6) AS chars_per_page, c < 40 AND pages >= 3 AS scanned FROM s""",
    "body_height": f"""WITH {_LINES}, r AS (SELECT book, list_sort(list(length(raw)))[count(*) // 2 + 1] AS rough FROM l GROUP BY book)
SELECT book, CAST(list_sort(list(length(raw)))[count(*) // 2 + 1] AS INT) AS height FROM l JOIN r USING (book) WHERE length(raw) <= 1.5 * rough GROUP BY book""",
    "page_offset": """WITH s AS (SELECT user_id AS book, hour(ts) AS page, arg_max(day(ts), event_id) AS number FROM events GROUP BY ALL),
m AS (SELECT book, list_sort(list(number - page))[count(*) // 2 + 1] AS o, count(*) AS n FROM s GROUP BY book)
SELECT book, CAST(CASE WHEN n >= 3 AND abs(o) <= 100 THEN o ELSE 0 END AS INT) AS page_offset FROM m""",
    "material_budget": f"""WITH {_LINES}, u AS (SELECT *, sum(length(raw) + length('p' || pos) + 3) OVER (PARTITION BY book ORDER BY pos) AS upto FROM l)
SELECT book, count(*) AS paragraphs, CAST(sum(length(raw)) AS BIGINT) AS chars FROM u WHERE upto <= 1500 GROUP BY book""",
    "text_stats": r"""SELECT lang, CAST(0 AS BIGINT) AS cjk, CAST(sum(length(regexp_replace(text, '\s+', '', 'g'))) AS BIGINT) AS chars_no_ws, CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) AS BIGINT) AS en_words,
CAST(sum(len(regexp_extract_all(text, '[A-Za-z0-9]+'))) // 4 AS BIGINT) AS tokens FROM documents GROUP BY lang""",
    "token_estimate": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) // 4 AS BIGINT) AS tokens FROM documents",
}
