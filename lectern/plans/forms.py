"""Queries on forms of text, predicates, and rows that readers and services show. Documents, their lines and the star tables stand for the inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import concepts, evidence, joins, lifecycle, pages, search, segments, structure, tools
from lectern.plans.retrieval import questions, table
from lectern.sinks import markdown
from lectern.sources import files


def _texts(spark: SparkSession, sf_dir: str, **columns: Column) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text"))


def _kinds() -> Column:
    return F.element_at(F.array(F.lit("heading"), F.lit("formula"), F.lit("p")), (F.col("doc_id") % 3 + 1).cast("int"))


def concept_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth anchor's section is gone, and texts of some anchors are short."""
    text = F.when(F.col("doc_id") % 5 == 0, F.substring("text", 1, 6)).otherwise(F.col("text"))
    anchors = _texts(spark, sf_dir, section_id=F.col("doc_id"), text=text)
    sections = table(spark, sf_dir, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), _kinds().alias("kind"))
    return concepts.concept_paragraphs(anchors, sections).select("doc_id", "kind")


def body_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _texts(spark, sf_dir, kind=_kinds(), page=F.col("doc_id") % 4, text=F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.col("text")))
    return tools.body_paragraphs(sections, 2).select("doc_id")


def formula_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as they are, but every fifth one is a formula of many rows: its text in pieces of 60 characters, all of them, and an empty one where it has none."""
    pos = F.col("pos")
    pieces = X.slices(F.col("raw"), 60)
    formula = F.transform(F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces), lambda p: F.concat(F.lit("y = "), p))
    rows = F.when(pos % 5 == 1, formula).when(pos % 5 == 3, F.array(F.concat(F.lit(" f (x) "), "raw"))).otherwise(F.array("raw"))
    return _lines(spark, sf_dir).select("book", "pos", F.posexplode(rows).alias("piece", "t")).where(X.looks_like_formula(F.col("t"))).select("book", "pos", "piece")


def clean_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in quotes, and of one to many characters."""
    name = F.concat(F.lit(' "'), F.substring("p_name", 1, (F.col("p_partkey") % 20).cast("int")), F.lit("” "))
    return table(spark, sf_dir, "part").select("p_partkey", X.clean_name(name).alias("name"))


def outline_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of one to seven signs, and fences whose inside stays as body text."""
    signs = (F.col("pos") % 8).cast("int")
    raw = F.when(F.col("pos") % 13 == 5, "~~~").when(F.col("pos") % 3 == 1, F.concat(F.repeat(F.lit("#"), signs), F.lit(" "), "raw", F.lit(" ##"))).otherwise(F.col("raw"))
    rows = structure.outline_rows(_lines(spark, sf_dir).withColumn("raw", raw), "a")
    return rows.groupBy("book", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("pos").alias("places"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as what was read on a page: the quantity is the height, the part the place."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("y0"), F.col("l_partkey").cast("double").alias("x0"), F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return structure.ocr_text(rows, ["l_orderkey"])


def tidy_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = F.concat(F.lit("  "), F.regexp_replace("text", "e ", "e \t "))
    return _texts(spark, sf_dir, tidy=F.md5(X.tidy(spaced).cast("binary")), loose=F.md5(X.loose_match_form(F.col("text")).cast("binary")), line=F.md5(X.line_form(F.col("text")).cast("binary")))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence about the middle of a text with marks planted, and the earliest one."""
    marked = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("。")), F.lit("\n"), F.lit(" "))
    middle = F.floor(F.length(marked) / 2).cast("int")
    return _texts(spark, sf_dir, around=X.sentence_at(marked, middle), first=X.earliest_sentence(F.col("text")))


def clause_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, clause=X.first_clause(F.col("text")), name=concepts.rule_name(F.col("text")))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.seed_of(F.col("p_brand"), F.col("p_name")).alias("seed"))


def small_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, waiting times, limits and places from numbers."""
    k = F.col("p_partkey")
    grid = X.grid_position(k % 17)
    return table(spark, sf_dir, "part").select("p_partkey", X.pdf_page(k / 2, F.lit(5)).alias("page"), X.ocr_wait_minutes(F.col("p_size") * 4).alias("minutes"), search.limit_of(F.nullif(k % 80, F.lit(7))).cast("long").alias("most"), grid["x"].cast("long").alias("x"), grid["y"].cast("long").alias("y"))


def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("<b>*[a & 'b'](c)*</b> `x` "), "text")
    return _texts(spark, sf_dir, short=X.short(F.col("text"), 30), escaped=F.md5(X.html_escape(odd)), plain=F.md5(X.without_markdown(odd)))


def numbered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.numbered(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], "doc_id").select("doc_id", "ordinal", F.md5(F.col("block").cast("binary")).alias("block"))


def outline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chapter level of bookmarks: levels by a line's number, titles of some levels alone look like chapters."""
    odd = F.col("pos") % 5
    marks = _lines(spark, sf_dir).where("pos > 0").select("book", (odd + 1).cast("int").alias("level"), F.when((odd == F.col("book") % 5) & (F.col("pos") % 2 == 0), F.concat(F.lit("Chapter "), F.col("pos").cast("string"))).otherwise("t").alias("text"))
    return structure.page_chapter_level(structure.level_counts(marks))


def bookmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as bookmarks, of which some repeat and some are no titles."""
    marks = table(spark, sf_dir, "events").select(F.col("user_id").alias("book"), F.hour("ts").alias("page"), F.when(F.col("event_type") == "view", "Contents").otherwise(F.col("event_type")).alias("title"), F.lit(1).alias("level"), F.col("event_id").alias("ord"))
    return pages.bookmarks(marks).select("book", "page", "title", "ord")


def notes_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are notes of their customer's chapter; their anchor is an order that may be another's, or none."""
    k = F.col("o_orderkey")
    notes = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("chapter_id"), F.when(k % 5 == 0, "").when(k % 5 == 1, (k + 1).cast("string")).otherwise(k.cast("string")).alias("anchor_id"))
    anchors = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chapter_id"), k.cast("string").alias("id"))
    accepted, rejected = lifecycle.owned_notes(notes, anchors)
    return accepted.select("id", F.lit(True).alias("accepted")).unionByName(rejected.select("id", F.lit(False).alias("accepted")))


def model_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's concepts in JSON: parts of a size; anchors are those of the size, or others."""
    k = F.col("p_partkey")
    named = F.when(k % 4 == 0, F.upper("p_type")).otherwise(F.col("p_type"))
    item = F.struct(k.alias("at"), F.struct(F.substring(named, 1, 14).alias("concept"), F.col("p_name").alias("definition"), F.array(F.lit("x"), F.lit("Brand one"), F.lit("")).alias("prerequisites"), F.lit("").alias("example"), F.array((k % 9).cast("string"), F.lit("3"), F.lit("none")).alias("anchors")).alias("c"))
    parts = table(spark, sf_dir, "part").withColumn("chapter_id", F.col("p_size"))
    replies = parts.groupBy("chapter_id").agg(F.concat(F.lit("sure: "), F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]))).alias("reply"))
    known = parts.groupBy("chapter_id").agg(F.array_distinct(F.array(F.lit("3"), *[F.lit(str(i)) for i in range(5)])).alias("anchors"))
    found = concepts.normalized_concepts(replies, known)
    return found.select("chapter_id", "ord", "concept", "definition", F.array_join("prerequisites", "|").alias("prerequisites"), F.array_join("anchors", "|").alias("anchors"))


def book_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are books and nations chapters."""
    books = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("title"), (F.col("r_regionkey") * 12.5).alias("progress_pct"))
    nations = table(spark, sf_dir, "nation").withColumn("num", F.row_number().over(structure.Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    chapters = nations.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("book_id"), "num", F.col("n_name").alias("title"))
    progress = nations.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("chapter_id"), F.lit("done").alias("status"))
    cards = markdown.book_cards(books, chapters, progress)
    return cards.select("id", "title", "progress", F.array_join(F.transform("chapters", lambda c: F.concat(c["title"], F.lit(":"), c["status"], F.lit(":"), c["is_today"].cast("string"))), "|").alias("chapters"))


def shown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _texts(spark, sf_dir, seq=F.col("doc_id") % 4, kind=_kinds(), text=F.col("text"))
    return markdown.segments(sections).select("doc_id", "type", F.size("segments").alias("n"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = table(spark, sf_dir, "nation").withColumn("title", F.concat("n_name", F.lit(" & more é")))
    return titled.select("n_nationkey", markdown.disposition().alias("header"))


def cross_chapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _texts(spark, sf_dir, chapter_id=F.col("source"))
    return evidence.source_details(found, F.lit("src3")).select("doc_id", "cross_chapter")


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ("pending", "running", "done", "failed")]), (k % 4 + 1).cast("int"))
    tasks = table(spark, sf_dir, "part").select("p_partkey", status.alias("status"), F.lit("").alias("error"), (k % 50).alias("done"), (k % 7 * 8).alias("total"))
    return lifecycle.failed_stale(lifecycle.task_view(tasks)).select("p_partkey", "status", "error", "percent")


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return _texts(spark, sf_dir, kind=X.content_kind(F.when(k % 3 == 0, F.col("source")).otherwise(""), F.when(k % 2 == 0, F.array(F.lit("row")))))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as lines, images and tables of a page."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("double").alias("y"), (F.col("l_quantity") * 200).alias("area"), F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("text"), (F.col("l_linenumber") % 3).alias("kind"))
    return files.page_items(rows.where("kind = 0"), rows.where("kind = 1"), rows.where("kind = 2"), ["l_orderkey"])


def styled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven parts in a row are a paragraph's runs; adjacent runs of one style are joined."""
    k, size = F.col("p_partkey"), F.col("p_size")
    runs = table(spark, sf_dir, "part").select(F.floor(k / 7).alias("paragraph"), (F.floor(k / 7) % 5).alias("book"), (k % 7).alias("ord"), F.when(k % 5 == 4, "").otherwise(F.concat(F.lit("r"), (k % 7).cast("string"))).alias("text"), F.floor(size / 10).cast("double").alias("size"), (k % 4 < 2).alias("bold"), (size % 5 == 0).alias("italic"), F.when(size % 7 == 0, "superscript").alias("position"))
    merged = structure.merged_runs(files.run_styles(runs), ["paragraph"])
    return merged.select("paragraph", F.array_join(F.transform("runs", lambda r: F.concat(r["text"], F.lit(":"), F.array_join(r["style"], ","))), "|").alias("runs"))


def paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of a document is two spans, of which some are bold, italic, large or raised; paragraphs keep them."""
    lines = structure.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text"))
    half, pos = F.floor(F.length("raw") / 2).cast("int"), F.col("pos")
    raised = pos % 5 == 1
    left = F.struct(F.lit(0).alias("ord"), F.substr("raw", F.lit(1), half).alias("text"), F.when(pos % 7 == 2, 20.0).otherwise(10.0).alias("size"), F.when(pos % 2 == 0, 16).otherwise(0).alias("flags"), F.lit(100.0).alias("y"))
    right = F.struct(F.lit(1).alias("ord"), F.substr("raw", half + 1).alias("text"), F.when(raised, 5.0).otherwise(10.0).alias("size"), F.when(pos % 3 == 0, 2).otherwise(0).alias("flags"), F.when(raised, 90.0).otherwise(100.0).alias("y"))
    spans = lines.select("book", "pos", F.inline(F.array(left, right)))
    styled = pages.span_styles(spans, lines.select("book", F.lit(10.0).alias("body")).distinct(), ("book", "pos")).withColumnRenamed("ord", "span")
    found = structure.reflow_runs(lines, styled, text="raw")
    shown = F.array_join(F.transform("runs", lambda r: F.concat(r["text"], F.lit(":"), F.array_join(r["style"], ","))), "|")
    same = F.array_join(F.transform("runs", lambda r: r["text"]), "") == F.col("text")
    return found.select("book", "paragraph", F.md5("text").alias("text"), F.md5(shown).alias("runs"), F.size("runs").alias("n"), same.alias("same"))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third text has a reply of a model."""
    asked = tools.translation_requests(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), "text"))
    events = tools.translation_events(asked.withColumn("reply", F.when(F.col("request_id") % 3 == 0, "a reply of the model")))
    return events.groupBy("request_id").agg(F.count(F.lit(1)).alias("events"), F.sum(F.when(F.col("event") == "delta", F.length("payload"))).alias("chars"), F.max(F.when(F.col("event") == "meta", F.get_json_object("payload", "$.language"))).alias("language"))


def quiz_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without the order of their options."""
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("chapter_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("concept"), F.concat(F.lit("A thing is "), "p_type", F.lit(" as said.")).alias("definition"), F.array(F.col("p_partkey").cast("string")).alias("anchors"))
    found = concepts.questions(rows)
    return found.select("chapter_id", "id", "prompt", "concept", "anchor", F.array_join(F.array_sort("options"), "|").alias("options"), F.try_element_at("options", F.col("answer_index") + 1).alias("answer"))


def _index(spark: SparkSession) -> segments.SegmentedIndex:
    return segments.SegmentedIndex(spark, joins.shared_folder(spark, "index"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("book"), "text")


def persisted_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question, asked of every book of an index that was written and is read again."""
    held = _index(spark)
    held.change(_books(spark, sf_dir))
    return segments.SegmentedIndex(spark, held.folder).best(questions(spark, sf_dir), 10).select("query_id", "book", "rank", "doc_id", F.round("score", 6).alias("score"))


def _grown(spark: SparkSession, sf_dir: str) -> segments.SegmentedIndex:
    """An index that gets its documents in parts, some in an older form first, and loses some; small segments are merged on the way."""
    docs, held = _books(spark, sf_dir), _index(spark)
    held.change(docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("an older form of this "), "text")).otherwise(F.col("text"))))
    held.change(docs.where("doc_id % 3 = 0 OR doc_id % 5 = 1"), docs.where("doc_id % 14 = 3"))
    held.merge()
    held.change(deleted=docs.where("doc_id % 7 = 3"))
    return held


def grown_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question, asked of every book of the index after its changes."""
    best = _grown(spark, sf_dir).best(questions(spark, sf_dir), 10, details=True)
    return best.select("query_id", "book", "rank", "doc_id", F.round("score", 6).alias("score"), "matched", F.array_join("recurring", " ").alias("recurring"), F.round("coverage", 9).alias("coverage"))


def stale_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books whose documents differ from the index after its changes: before and after it is brought up to date with documents of which one book's have changed."""
    held = _grown(spark, sf_dir)
    now = _books(spark, sf_dir).where("doc_id % 7 <> 3").withColumn("text", F.when((F.col("book") == "de") & (F.col("doc_id") % 2 == 0), F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))).where("book <> 'fr' OR doc_id % 4 <> 0")
    before = joins.cut(held.stale(now))
    held.refresh(now)
    held.merge()
    left = held.stale(now).agg(F.count(F.lit(1)).alias("left"))
    return held.books().select("book", "n", "tokens").join(before.select("book", F.col("held").alias("stale_n")), "book", "left").crossJoin(left)


QUERIES = {
    f.__name__: f
    for f in (
        concept_paragraphs, body_paragraphs, formula_lines, clean_names, outline_a, reading_order, tidy_forms, sentences, clause_names, seeds, small_numbers, short_forms, numbered_blocks, outline_levels, bookmark_rows,
        notes_owned, model_concepts, book_cards, shown_segments, dispositions, cross_chapter, task_states, content_kinds, page_entries, styled_runs, translations, quiz_prompts, persisted_search, grown_index_search, stale_books, paragraph_runs,
    )
}

_KIND = "['heading', 'formula', 'p'][doc_id % 3 + 1]"
_LINES = "l AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_NAME = r"""CASE WHEN length({0}) BETWEEN 2 AND 16 AND length({0}) >= 3 THEN {0} ELSE '' END"""
_ODD = "'<b>*[a & ''b''](c)*</b> `x` ' || text"
_CLAUSE = _trim("regexp_extract(text, '^([^，。、；：,;:!?]*)', 1)")


def _bm25_of(where: str) -> str:
    """SQL of BM25 from scratch, of one corpus a book, over the documents that satisfy where."""
    return f"""WITH d AS (SELECT doc_id, lang AS book, regexp_extract_all(lower(text), '[a-z0-9_]+') AS toks FROM documents WHERE {where}),
q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM benchmark),
qn AS (SELECT query_id, count(*) AS asked FROM q GROUP BY query_id),
n AS (SELECT book, count(*) AS n, sum(len(toks)) / count(*) AS avgdl FROM d GROUP BY book),
tf AS (SELECT doc_id, book, term, dl, count(*) AS tf FROM (SELECT doc_id, book, len(toks) AS dl, unnest(toks) AS term FROM d) GROUP BY ALL),
w AS (SELECT book, term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(avgdl) AS avgdl FROM tf JOIN n USING (book) GROUP BY ALL),
s AS (SELECT query_id, book, doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched, count(*) / any_value(asked) AS coverage, list_sort(coalesce(list(term) FILTER (WHERE df >= 2), [])) AS recurring
      FROM tf JOIN w USING (book, term) JOIN q USING (term) JOIN qn USING (query_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)"""


ORACLE = {
    "concept_paragraphs": f"SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN {_KIND} ELSE 'p' END AS kind FROM documents WHERE (doc_id % 4 = 0 OR doc_id % 3 = 2) AND length({_trim('CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 6) ELSE text END')}) >= 8",
    "body_paragraphs": f"SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 2 AND doc_id % 7 <> 0 AND {_trim('text')} <> ''",
    "formula_lines": rf"""WITH {_LINES}, k AS (SELECT book, pos, raw, unnest(range(0, CASE WHEN pos % 5 = 1 THEN greatest(CAST(ceil(length(raw) / 60.0) AS INT), 1) ELSE 1 END)) AS piece FROM l),
t AS (SELECT book, pos, piece, {_trim("CASE WHEN pos % 5 = 1 THEN 'y = ' || substr(raw, piece * 60 + 1, 60) WHEN pos % 5 = 3 THEN ' f (x) ' || raw ELSE raw END")} AS t FROM k)
SELECT book, CAST(pos AS INT) AS pos, CAST(piece AS INT) AS piece FROM t WHERE length(t) <= 80 AND regexp_matches(t, '[=∑∫→≤≥]|[a-zA-Z]\s*\(|x\^|_\{{')""",
    "clean_names": f"WITH n AS (SELECT p_partkey, trim(substr(p_name, 1, CAST(p_partkey % 20 AS INT))) AS n FROM part) SELECT p_partkey, {_NAME.format('n')} AS name FROM n",
    "outline_a": rf"""WITH {_LINES}, m AS (SELECT book, pos, {_trim("CASE WHEN pos % 13 = 5 THEN '~~~' WHEN pos % 3 = 1 THEN repeat('#', pos % 8) || ' ' || raw || ' ##' ELSE raw END")} AS t FROM l),
f AS (SELECT *, sum(CAST(starts_with(t, '~~~') AS INT)) OVER (PARTITION BY book ORDER BY pos) % 2 = 1 AS inside FROM m),
h AS (SELECT *, NOT inside AND regexp_matches(t, '^#{{1,6}}\s+(.*?)\s*#*\s*$') AS heading FROM f WHERE NOT starts_with(t, '~~~')),
o AS (SELECT book, pos, CASE WHEN heading THEN length(regexp_extract(t, '^(#{{1,6}})\s', 1)) ELSE 0 END AS level, CASE WHEN heading THEN regexp_extract(t, '^#{{1,6}}\s+(.*?)\s*#*\s*$', 1) ELSE t END AS text FROM h)
SELECT book, CAST(level AS INT) AS level, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(pos) AS BIGINT) AS places FROM o GROUP BY ALL""",
    "reading_order": "SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, chr(10) ORDER BY l_quantity, l_partkey, l_linenumber) AS text FROM lineitem GROUP BY l_orderkey",
    "tidy_forms": rf"""WITH t AS (SELECT doc_id, text, '  ' || replace(text, 'e ', 'e ' || chr(9) || ' ') AS spaced FROM documents)
SELECT doc_id, md5({_trim(r"regexp_replace(spaced, '\s{2,}', ' ', 'g')")}) AS tidy, md5(regexp_replace(regexp_replace(text, '[\s\-\x{{2010}}-\x{{2014}}]', '', 'g'), '[\p{{P}}\p{{S}}]', '', 'g')) AS loose, md5(regexp_replace(text, '\s+', '', 'g')) AS line FROM t""",
    "sentences": rf"""WITH m AS (SELECT doc_id, text, replace(replace(text, '. ', '。'), chr(10), ' ') AS t FROM documents),
p AS (SELECT *, length(t) // 2 AS mid FROM m),
s AS (SELECT *, {_trim(r"regexp_extract(substr(t, 1, mid), '([^。！？；\n]*)$', 1) || regexp_extract(substr(t, mid + 1), '^([^。！？；\n]*[。！？；\n]?)', 1)")} AS sentence, {_trim("substr(t, greatest(mid - 40, 0) + 1, mid + 120 - greatest(mid - 40, 0))")} AS window_ FROM p)
SELECT doc_id, substr(CASE WHEN length(sentence) > 120 THEN window_ ELSE sentence END, 1, 300) AS around,
  CASE WHEN regexp_extract(text, '(?s)^(.{{1,90}}?[。！？.;；])', 1) <> '' THEN regexp_extract(text, '(?s)^(.{{1,90}}?[。！？.;；])', 1) WHEN length(text) > 90 THEN substr(text, 1, 90) || '…' ELSE text END AS first FROM s""",
    "clause_names": rf"""WITH c AS (SELECT doc_id, {_CLAUSE} AS clause, {_trim(r"regexp_extract(" + _trim(r"regexp_replace(text, '\s{2,}', ' ', 'g')") + ", '^([^，。、；：,;:!?]*)', 1)")} AS tidy FROM documents) SELECT doc_id, clause, {_NAME.format('tidy')} AS name FROM c""",
    "seeds": "SELECT p_partkey, CAST('0x' || substr(sha256(p_brand || ':' || p_name), 1, 12) AS BIGINT) AS seed FROM part",
    "small_numbers": "SELECT p_partkey, CAST(greatest(1, CAST(round(p_partkey / 2.0) AS INT) - 5) AS INT) AS page, CAST(greatest(45.0, (p_size * 4 + 30) * 0.5) AS DOUBLE) AS minutes, CAST(CASE WHEN p_partkey % 80 = 7 THEN 20 ELSE least(greatest(p_partkey % 80, 1), 50) END AS BIGINT) AS most, CAST(p_partkey % 17 % 3 * 220 AS BIGINT) AS x, CAST(p_partkey % 17 // 3 * 120 AS BIGINT) AS y FROM part",
    "short_forms": rf"""WITH t AS (SELECT doc_id, {_trim(r"regexp_replace(text, '\s+', ' ', 'g')")} AS flat, {_ODD} AS odd FROM documents)
SELECT doc_id, CASE WHEN length(flat) > 30 THEN substr(flat, 1, 29) || '…' ELSE flat END AS short, md5(replace(replace(replace(replace(replace(odd, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped,
  md5({_trim(r"regexp_replace(regexp_replace(regexp_replace(odd, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '[*_`~]+|[\[\]]', '', 'g'), '\s+', ' ', 'g')")}) AS plain FROM t""",
    "numbered_blocks": "WITH n AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS ordinal FROM documents) SELECT doc_id, ordinal, md5('[' || ordinal || '] ' || substr(text, 1, 400)) AS block FROM n",
    "outline_levels": rf"""WITH {_LINES}, m AS (SELECT book, pos % 5 + 1 AS level, count(*) AS n, count(*) FILTER (WHERE pos % 5 = book % 5 AND pos % 2 = 0) AS hits FROM l WHERE pos > 0 GROUP BY ALL),
a AS (SELECT book, min(level) AS first, arg_min(n, level) AS n_first, min(level) FILTER (WHERE hits >= 3 AND hits * 2 >= n) AS hit, min(level) FILTER (WHERE n BETWEEN 3 AND 80) AS fair FROM m GROUP BY book)
SELECT book, CAST(coalesce(hit, CASE WHEN n_first < 2 THEN coalesce(fair, first) ELSE first END) AS INT) AS chapter_level FROM a""",
    "bookmark_rows": "SELECT user_id AS book, CAST(hour(ts) AS INT) AS page, event_type AS title, min(event_id) AS ord FROM events WHERE event_type <> 'view' GROUP BY ALL",
    "notes_owned": "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN (o_custkey, o_orderkey + 1) IN (SELECT (o_custkey, o_orderkey) FROM orders) ELSE true END AS accepted FROM orders",
    "model_concepts": """WITH i AS (SELECT p_size AS chapter_id, p_partkey AS k, trim(substr(CASE WHEN p_partkey % 4 = 0 THEN upper(p_type) ELSE p_type END, 1, 14)) AS concept, p_name FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY chapter_id, lower(concept) ORDER BY k) AS nth FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY chapter_id ORDER BY k) AS ord FROM f WHERE nth = 1)
SELECT chapter_id, CAST(ord AS INT) AS ord, concept, p_name AS definition, 'Brand one' AS prerequisites, CASE WHEN k % 9 < 5 THEN (k % 9) || '|3' ELSE '3' END AS anchors FROM o WHERE ord <= 12""",
    "book_cards": """WITH c AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS num FROM nation)
SELECT r_regionkey AS id, r_name AS title, '已学 ' || CAST(round_even(r_regionkey * 12.5, 0) AS INT) || '%' AS progress,
  string_agg(n_name || ':' || CASE WHEN n_nationkey % 2 = 0 THEN 'done' WHEN num = 1 THEN 'doing' ELSE 'todo' END || ':' || CASE WHEN num = 1 THEN 'true' ELSE 'false' END, '|' ORDER BY num) AS chapters FROM region JOIN c ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""",
    "shown_segments": f"SELECT doc_id, CASE WHEN {_KIND} <> 'p' THEN {_KIND} WHEN doc_id % 4 = 1 THEN 'definition' ELSE 'paragraph' END AS type, 1 AS n FROM documents",
    "dispositions": "SELECT n_nationkey, 'attachment; filename=\"' || regexp_replace(n_name || ' & more é', '[^A-Za-z0-9._-]+', '_', 'g') || '.md\"; filename*=UTF-8''''' || url_encode(n_name || ' & more é') || '.md' AS header FROM nation",
    "cross_chapter": "SELECT doc_id, source <> 'src3' AS cross_chapter FROM documents",
    "task_states": "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN 'failed' ELSE ['pending', 'running', 'done', 'failed'][p_partkey % 4 + 1] END AS status, CASE WHEN p_partkey % 4 < 2 THEN 'interrupted' ELSE '' END AS error, CAST(CASE WHEN p_partkey % 7 > 0 THEN round_even(p_partkey % 50 * 100.0 / (p_partkey % 7 * 8), 0) ELSE 0 END AS INT) AS percent FROM part",
    "content_kinds": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source <> '' THEN 'image' WHEN doc_id % 2 = 0 THEN 'table' END AS kind FROM documents",
    "page_entries": """WITH r AS (SELECT l_orderkey, CAST(l_partkey AS DOUBLE) AS y, ['line', 'image', 'table'][l_linenumber % 3 + 1] AS kind, CASE WHEN l_linenumber % 3 = 1 THEN '' ELSE 't' || l_linenumber END AS text FROM lineitem WHERE l_linenumber % 3 <> 1 OR l_quantity * 200 >= 4000)
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY y, kind, text) AS INT) AS ord, kind, text FROM r""",
    "styled_runs": """WITH r AS (SELECT p_partkey // 7 % 5 AS book, p_partkey // 7 AS paragraph, p_partkey % 7 AS ord, CASE WHEN p_partkey % 5 = 4 THEN '' ELSE 'r' || (p_partkey % 7) END AS text, CAST(p_size // 10 AS DOUBLE) AS size, p_partkey % 4 < 2 AS b, p_size % 5 = 0 AS i, p_size % 7 = 0 AS up FROM part),
c AS (SELECT book, size, count(*) AS n FROM r WHERE size > 0 GROUP BY ALL), s AS (SELECT book, arg_max(size, (n, -size)) AS body FROM c GROUP BY book),
y AS (SELECT paragraph, ord, text, array_to_string(list_filter([CASE WHEN b THEN 'b' END, CASE WHEN i THEN 'i' END, CASE WHEN up THEN 'sup' WHEN size / body >= 1.15 THEN 'lg' WHEN size / body <= 0.9 THEN 'sm' END], lambda x: x IS NOT NULL), ',') AS style FROM r LEFT JOIN s USING (book)),
l AS (SELECT *, CAST(style IS DISTINCT FROM lag(style) OVER w OR row_number() OVER w = 1 AS INT) AS new FROM y WHERE text <> '' WINDOW w AS (PARTITION BY paragraph ORDER BY ord)),
g AS (SELECT *, sum(new) OVER (PARTITION BY paragraph ORDER BY ord) AS run FROM l),
m AS (SELECT paragraph, run, string_agg(text, '' ORDER BY ord) || ':' || any_value(style) AS t FROM g GROUP BY ALL),
o AS (SELECT paragraph, string_agg(t, '|' ORDER BY run) AS runs FROM m GROUP BY paragraph)
SELECT paragraph, coalesce(runs, '') AS runs FROM (SELECT DISTINCT paragraph FROM r) LEFT JOIN o USING (paragraph)""",
    "paragraph_runs": rf"""WITH {_LINES}, t AS (SELECT book, pos, raw, {_trim('raw')} AS t FROM l),
u AS (SELECT *, t = '' OR ((regexp_matches(t, '[。．？！；：!?;”』」…]$') OR regexp_matches(t, '(^|[^0-9])\.\s*$')) AND length(t) > 6) AS ends FROM t
      WHERE NOT ((length(t) <= 8 AND regexp_matches(t, '^[\d\s\-—.·]+$')) OR regexp_matches(t, '(?:\.\s*){{5,}}|…{{4,}}|⋯{{4,}}') OR regexp_matches(t, '^(?:https?://|www\.)\S+$')) OR t = ''),
p AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY book ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paragraph FROM u),
q AS (SELECT * FROM p WHERE t <> ''),
r AS (SELECT book, paragraph, pos, 0 AS span, substr(raw, 1, length(raw) // 2) AS text, array_to_string(list_filter([CASE WHEN pos % 2 = 0 THEN 'b' END, CASE WHEN pos % 7 = 2 THEN 'lg' END], lambda x: x IS NOT NULL), ',') AS style FROM q
      UNION ALL SELECT book, paragraph, pos, 1, substr(raw, length(raw) // 2 + 1), array_to_string(list_filter([CASE WHEN pos % 3 = 0 THEN 'i' END, CASE WHEN pos % 5 = 1 THEN 'sup' END], lambda x: x IS NOT NULL), ',') FROM q),
a AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY book, paragraph ORDER BY pos, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM r),
b AS (SELECT book, paragraph, string_agg(text, '' ORDER BY pos, span) AS body FROM r GROUP BY ALL),
c AS (SELECT book, paragraph, length(body) - length(regexp_replace(body, '^\s+', '')) AS start, {_trim('body')} AS kept FROM b),
d AS (SELECT book, paragraph, pos, span, style, kept, substr(text, CAST(greatest(start - place, 0) + 1 AS BIGINT), CAST(greatest(least(start + length(kept) - place, length(text)) - greatest(start - place, 0), 0) AS BIGINT)) AS text FROM a JOIN c USING (book, paragraph) WHERE kept <> ''),
e AS (SELECT *, CAST(style IS DISTINCT FROM lag(style) OVER w OR row_number() OVER w = 1 AS INT) AS new FROM d WHERE text <> '' WINDOW w AS (PARTITION BY book, paragraph ORDER BY pos, span)),
g AS (SELECT *, sum(new) OVER (PARTITION BY book, paragraph ORDER BY pos, span) AS run FROM e),
m AS (SELECT book, paragraph, run, any_value(kept) AS kept, string_agg(text, '' ORDER BY pos, span) || ':' || any_value(style) AS t FROM g GROUP BY ALL)
SELECT book, CAST(paragraph AS BIGINT) AS paragraph, md5(any_value(kept)) AS text, md5(string_agg(t, '|' ORDER BY run)) AS runs, CAST(count(*) AS INT) AS n, true AS same FROM m GROUP BY ALL""",
    "translations": """WITH t AS (SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN length('a reply of the model') ELSE length('（未接入大模型，无法翻译。下面是原文，请自行对照阅读。）') + 1 + least(length(text), 3000) END AS chars FROM documents)
SELECT request_id, CAST(ceil(chars / 14.0) + 2 AS BIGINT) AS events, CAST(chars AS BIGINT) AS chars, 'zh' AS language FROM t""",
    "quiz_prompts": """WITH n AS (SELECT DISTINCT p_size % 5 AS chapter_id, p_type AS concept FROM part),
o AS (SELECT a.chapter_id, a.concept, b.concept AS other, row_number() OVER (PARTITION BY a.chapter_id, a.concept ORDER BY abs(length(b.concept) - length(a.concept)), b.concept) AS nth FROM n a JOIN n b ON a.chapter_id = b.chapter_id AND a.concept <> b.concept),
d AS (SELECT chapter_id, concept, list(other) AS others FROM o WHERE nth <= 3 GROUP BY ALL HAVING count(*) = 3),
q AS (SELECT p_size % 5 AS chapter_id, p_partkey, p_type AS concept, others, row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) AS nth FROM part JOIN d ON d.chapter_id = p_size % 5 AND d.concept = p_type)
SELECT chapter_id, chapter_id || '-q' || nth AS id, 'A thing is ____ as said.' AS prompt, concept, CAST(p_partkey AS VARCHAR) AS anchor, array_to_string(list_sort(list_append(others, concept)), '|') AS options, concept AS answer FROM q WHERE nth <= 5""",
    "persisted_search": f"{_bm25_of('TRUE')} SELECT query_id, book, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "grown_index_search": f"{_bm25_of('doc_id % 7 <> 3')} SELECT query_id, book, CAST(rank AS INT) AS rank, doc_id, round(score, 6) AS score, matched, array_to_string(recurring, ' ') AS recurring, round(coverage, 9) AS coverage FROM r WHERE rank <= 10",
    "stale_books": """WITH h AS (SELECT lang AS book, doc_id, text FROM documents WHERE doc_id % 7 <> 3),
n AS (SELECT book, doc_id, CASE WHEN book = 'de' AND doc_id % 2 = 0 THEN 'changed ' || text ELSE text END AS text FROM h WHERE book <> 'fr' OR doc_id % 4 <> 0),
a AS (SELECT book, count(*) AS held, string_agg(md5(text), '' ORDER BY doc_id) AS was FROM h GROUP BY book),
b AS (SELECT book, count(*) AS n, CAST(sum(len(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS BIGINT) AS tokens, string_agg(md5(text), '' ORDER BY doc_id) AS now FROM n GROUP BY book)
SELECT book, n, tokens, CASE WHEN was <> now THEN held END AS stale_n, CAST(0 AS BIGINT) AS "left" FROM b JOIN a USING (book)""",
}
