"""Queries on concepts, graphs, lessons, quizzes and plans. Parts stand for concepts: the brand is the name, the size modulo 10 the chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import concepts, joins, replies, structure
from lectern.plans.retrieval import table


def _concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands in upper case where the key divides by 3; a brand by the key as first prerequisite, and the type, which is no concept."""
    k = F.col("p_partkey")
    need = F.concat(F.lit("Brand#"), (F.col("p_size") % 5 + 1).cast("string"), (k % 5 + 1).cast("string"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("c"), (F.col("p_size") % 10).cast("string")).alias("chapter_id"),
        (F.col("p_size") % 10).alias("chapter_ord"),
        k.alias("ord"),
        F.when(k % 3 == 0, F.upper("p_brand")).otherwise(F.col("p_brand")).alias("concept"),
        F.when(k % 2 == 0, F.col("p_name")).otherwise("").alias("definition"),
        F.lit("").alias("example"),
        F.array(need, F.col("p_type")).alias("prerequisites"),
        F.array(F.concat(F.lit("a"), (k % 50).cast("string"))).alias("anchors"),
        F.when(k % 97 == 0, "llm").otherwise("rule").alias("method"),
        F.when(k % 400 == 0, "learned").otherwise("planned").alias("status"),
        (k % 90).cast("double").alias("mastery"),
    )


def concept_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = concepts.graph_nodes(_concepts(spark, sf_dir))
    return nodes.select("key", "concept", "definition", F.array_join(F.array_sort("chapters"), " ").alias("chapters"), F.array_join(F.array_sort("anchors"), " ").alias("anchors"), F.size("prerequisites").alias("needs"), "status", "mastery", "method")


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows = _concepts(spark, sf_dir)
    nodes = joins.cut(concepts.graph_nodes(rows))
    edges = joins.cut(concepts.prerequisite_edges(nodes))
    return nodes, edges, concepts.sequence_edges(rows, nodes, edges), concepts.unresolved(nodes)


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def sequence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each pair of names that follow one another."""
    return _graph(spark, sf_dir)[2].select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"))


def unresolved_prereqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[3].select("name", F.size("required_by").alias("n"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.graph_stats(*_graph(spark, sf_dir))


def graph_b_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.graph_b(_concepts(spark, sf_dir))[0].select("key", "concept", F.array_join("chapters", " ").alias("chapters"), "anchor_count")


def graph_b_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.graph_b(_concepts(spark, sf_dir))[1]


def topo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = concepts.first_rows(_concepts(spark, sf_dir), 1, ["chapter_id", "concept"], ["ord"])
    return concepts.lesson_order(first)


def lesson_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a chapter; documents whose id divides by 4 are headings, by 3 have no anchor."""
    sections = table(spark, sf_dir, "documents").select(F.col("source").alias("chapter_id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 4 == 0, "heading").otherwise("p").alias("kind"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id").cast("string")).alias("anchor"))
    return concepts.heuristic_lesson(sections).select("chapter_id", "seq", "anchor")


def lesson_contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lessons with one step each, whose anchor some nations do not have."""
    step = F.struct(F.when(F.col("s_suppkey") % 7 == 0, " ").otherwise(F.col("s_name")).alias("text"), F.when(F.col("s_suppkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("s_suppkey") % 4).cast("string"))).alias("anchors"))
    lessons = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("chapter_id"), F.when(F.col("s_suppkey") % 11 == 0, "").otherwise(F.col("s_name")).alias("title"), F.array(step).alias("steps"))
    anchors = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("chapter_id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 4), lambda i: i.cast("string"))).alias("anchor"))
    return concepts.lesson_errors(lessons, anchors)


def quiz_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("chapter_id"), F.col("p_type").alias("concept"))
    return concepts.distractors(names).select("chapter_id", "concept", F.array_join("others", "|").alias("others"))


def quiz_cloze(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.split("text", " "), 2)
    return table(spark, sf_dir, "documents").where("size(split(text, ' ')) > 2").select("doc_id", X.cloze(F.col("text"), word).alias("prompt"))


def quiz_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("chapter_id"), F.col("p_partkey").alias("ord"), F.col("p_type").alias("concept"), F.concat(F.lit("A thing is "), "p_type", F.lit(" as said.")).alias("definition"), F.array(F.col("p_partkey").cast("string")).alias("anchors"))
    return concepts.questions(rows)


def quiz_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("choice"))
    keys = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 2).cast("int").alias("answer_index"), F.col("doc_id").cast("string").alias("anchor"))
    return concepts.graded(answers, keys).select("id", "correct", "value")


def plan_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.plan_minutes(F.length("text")).alias("minutes"))


def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = table(spark, sf_dir, "documents").select("source", "doc_id", X.plan_minutes(F.length("text")).alias("minutes"), F.md5("text").alias("goal"))
    return minutes.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("minutes").alias("minutes"), F.min_by("goal", "doc_id").alias("goal"))


def language_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.target_language(F.col("text")).alias("language"))


def first_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentence(F.col("text")).alias("head"))


def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structure.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text")).withColumnRenamed("raw", "text")
    return concepts.rule_summary(rows, ["book"], "pos")


def rule_concepts_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition sentences by the words 'is the' and 'was the'."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return concepts.rule_concepts_b(rows, "is the|was the").select("doc_id", "concept", "definition")


def knowledge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books are sizes modulo 3; every third chapter is learned, every third being learned."""
    rows = _concepts(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_size") % 3).alias("book_id")), "ord")
    chapters = rows.select("book_id", "chapter_id", "chapter_ord").distinct()
    progress = chapters.select("book_id", "chapter_id", F.when(F.col("chapter_ord") % 3 == 0, "learned").when(F.col("chapter_ord") % 3 == 1, "learning").alias("status"), (F.col("chapter_ord") * 10.0).alias("mastery"))
    books = chapters.select("book_id").distinct().withColumn("title", F.concat(F.lit("Book "), F.col("book_id").cast("string")))
    return concepts.knowledge(rows, progress, books)["stats"]


def plan_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's plans in noisy JSON: regions are books and nations chapters, of which every fourth is unknown."""
    k = F.col("n_nationkey")
    item = F.struct(k.alias("at"), F.struct(F.col("n_name").alias("chapterId"), (k % 3).alias("order"), (k * 9).alias("duration_minutes"), F.when(k % 2 == 1, F.repeat("n_name", 30)).otherwise("").alias("goal"), F.lit("o").alias("overview")).alias("i"))
    nations = table(spark, sf_dir, "nation").withColumn("book_id", F.col("n_regionkey"))
    listed = nations.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("items"))
    replies = listed.select("book_id", F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct("items")), F.lit("\n```")).alias("reply"))
    return concepts.planned(replies, nations.where(k % 4 != 3).select("book_id", F.col("n_name").alias("chapter_id"), F.col("n_name").alias("title")))


def lesson_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's lessons: suppliers are points of their nation's lesson, every other one with a source that isn't there."""
    k = F.col("s_suppkey")
    item = F.struct(k.alias("at"), F.struct(F.lit("").alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("s_name")).alias("title"), F.repeat("s_name", 40).alias("body"), F.when(k % 2 == 0, k.cast("string")).otherwise("none").alias("sourceId")).alias("i"))
    suppliers = table(spark, sf_dir, "supplier").withColumn("chapter_id", F.col("s_nationkey"))
    replies = suppliers.groupBy("chapter_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["i"]).alias("points"))).alias("reply"))
    return concepts.lesson_points(replies, suppliers.select("chapter_id", k.cast("string").alias("anchor"), k.alias("seq")))


_CONCEPTS = """c AS (SELECT 'c' || (p_size % 10) AS chapter_id, p_size % 10 AS chapter_ord, p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS concept, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE '' END AS definition,
  ['Brand#' || (p_size % 5 + 1) || (p_partkey % 5 + 1), p_type] AS prerequisites, 'a' || (p_partkey % 50) AS anchor, CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END AS llm, CASE WHEN p_partkey % 400 = 0 THEN 3 ELSE 1 END AS rank, CAST(p_partkey % 90 AS DOUBLE) AS mastery FROM part),
n AS (SELECT lower(concept) AS key, arg_min(concept, (chapter_ord, ord)) AS concept, coalesce(arg_min(definition, (chapter_ord, ord)) FILTER (WHERE definition <> ''), '') AS definition, array_to_string(list_sort(list(DISTINCT chapter_id)), ' ') AS chapters,
  array_to_string(list_sort(list(DISTINCT anchor)), ' ') AS anchors, count(*) AS anchor_count, max(rank) AS rank, max(mastery) AS mastery, max(llm) AS llm FROM c GROUP BY ALL),
r AS (SELECT DISTINCT lower(concept) AS source, unnest(prerequisites) AS name FROM c),
p AS (SELECT DISTINCT source, lower(name) AS target FROM r WHERE lower(name) <> source AND lower(name) IN (SELECT key FROM n)),
g AS (SELECT lower(concept) AS target, lag(lower(concept)) OVER (PARTITION BY chapter_id ORDER BY chapter_ord, ord) AS source FROM c),
q AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM g WHERE source <> target AND (least(source, target), greatest(source, target)) NOT IN (SELECT (least(source, target), greatest(source, target)) FROM p)),
u AS (SELECT name, count(DISTINCT source) AS n FROM r WHERE lower(name) NOT IN (SELECT key FROM n) GROUP BY name)"""
_MINUTES = "CAST(least(greatest(25 + length(text) // 80, 20), 90) AS INT)"
_FIRST = "CASE " + " ".join(f"WHEN instr(t, '{m}') BETWEEN 2 AND 91 THEN substr(t, 1, instr(t, '{m}'))" for m in "。！？.;；") + " WHEN length(t) > 90 THEN substr(t, 1, 90) || '…' ELSE t END"

def _digesting():  # noqa: ANN202
    """A stand-in for a model: it answers with a digest, and fails for a batch that holds too much text."""
    import hashlib

    def ask(prompts: list[str]) -> list[str]:
        if any(len(p) > 3000 for p in prompts):
            raise RuntimeError("too long")
        return [hashlib.md5(p.encode()).hexdigest() for p in prompts]

    return ask


def kept_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions: two thirds of the documents are asked, then all, of which some have changed. With each reply the session that asked for it; documents too long for the model are asked with half of their text."""
    docs, folder = table(spark, sf_dir, "documents").select("doc_id", "text"), joins.shared_folder(spark, "replies")
    half = lambda p: F.substr(p, F.lit(1), F.floor(F.length(p) / 2).cast("int"))
    single = lambda: (lambda ask: lambda prompts: [_one(ask, p) for p in prompts])(_digesting())
    first = replies.Replies(spark, folder, "stand-in")
    first.answered(docs.where("doc_id % 3 <> 0"), "text", single, shorter=half)
    known = joins.cut(first.kept().select(F.col("key").alias("reply_key"), F.lit(1).alias("session")))
    now = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 1, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    found = replies.Replies(spark, folder, "stand-in").answered(now, "text", single, shorter=half)
    return found.join(known, "reply_key", "left").select("doc_id", "reply", F.when(F.col("reply").isNotNull(), F.coalesce("session", F.lit(2))).alias("session"))


def _one(ask, prompt: str) -> str | None:  # noqa: ANN001
    try:
        return ask([prompt])[0]
    except RuntimeError:
        return None


QUERIES = {
    f.__name__: f
    for f in (
        kept_replies, concept_merge, graph_edges, sequence_edges, unresolved_prereqs, graph_stats, graph_b_nodes, graph_b_edges, topo_order, lesson_outline, lesson_contract_errors, quiz_distractors, quiz_cloze, quiz_questions, quiz_grade,
        plan_durations, plan_totals, language_target, first_sentence, rule_summary, rule_concepts_b, knowledge_stats, plan_replies, lesson_replies,
    )
}

ORACLE = {
    "kept_replies": """WITH f AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT doc_id, CASE WHEN doc_id % 10 = 1 THEN text || ' changed' ELSE text END AS text FROM documents),
r AS (SELECT doc_id, text, CASE WHEN length(text) <= 3000 THEN md5(text) WHEN length(text) // 2 <= 3000 THEN md5(substr(text, 1, length(text) // 2)) END AS reply FROM n)
SELECT doc_id, reply, CASE WHEN reply IS NOT NULL THEN CASE WHEN text IN (SELECT text FROM f) THEN 1 ELSE 2 END END AS session FROM r""",
    "knowledge_stats": """WITH c AS (SELECT p_size % 3 AS book_id, p_size % 10 AS chapter, p_partkey AS ord, lower(p_brand) AS key, ['Brand#' || (p_size % 5 + 1) || (p_partkey % 5 + 1), p_type] AS needs, p_partkey % 97 = 0 AS llm,
  CASE p_size % 10 % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rank FROM part),
n AS (SELECT book_id, key, max(rank) AS rank, bool_or(llm) AS llm FROM c GROUP BY ALL),
r AS (SELECT DISTINCT book_id, key AS source, unnest(needs) AS name FROM c),
p AS (SELECT DISTINCT book_id, source, lower(name) AS target FROM r WHERE lower(name) <> source AND (book_id, lower(name)) IN (SELECT (book_id, key) FROM n)),
g AS (SELECT book_id, key AS target, lag(key) OVER (PARTITION BY book_id, chapter ORDER BY ord) AS source FROM c),
q AS (SELECT DISTINCT book_id, least(source, target) AS lo, greatest(source, target) AS hi FROM g WHERE source <> target),
s AS (SELECT * FROM q WHERE (book_id, lo, hi) NOT IN (SELECT (book_id, least(source, target), greatest(source, target)) FROM p)),
u AS (SELECT DISTINCT book_id, name FROM r WHERE lower(name) <> source AND (book_id, lower(name)) NOT IN (SELECT (book_id, key) FROM n))
SELECT book_id, 'Book ' || book_id AS title, count(*) AS concepts, count(*) FILTER (WHERE rank > 1) AS learned, count(*) FILTER (WHERE llm) AS by_model, (SELECT count(*) FROM p WHERE p.book_id = n.book_id) AS prerequisites,
  (SELECT count(*) FROM s WHERE s.book_id = n.book_id) AS sequences, (SELECT count(*) FROM u WHERE u.book_id = n.book_id) AS unresolved FROM n GROUP BY book_id""",
    "plan_replies": """SELECT n_regionkey AS book_id, n_name AS chapter_id, CAST(coalesce(nullif(n_nationkey % 3, 0), row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS INT) AS "order", CAST(least(120, greatest(15, CASE WHEN n_nationkey = 0 THEN 30 ELSE n_nationkey * 9 END)) AS INT) AS minutes,
  substr(CASE WHEN n_nationkey % 2 = 1 THEN repeat(n_name, 30) ELSE '理解「' || n_name || '」。' END, 1, 120) AS goal, 'o' AS overview FROM nation WHERE n_nationkey % 4 <> 3""",
    "lesson_replies": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS least FROM supplier)
SELECT s_nationkey AS chapter_id, CAST(nth AS INT) AS nth, 'kp' || nth AS id, substr(CASE WHEN s_suppkey % 3 = 0 THEN '知识点 ' || nth ELSE s_name END, 1, 40) AS title, substr(repeat(s_name, 40), 1, 500) AS body, CAST(CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE least END AS VARCHAR) AS source FROM s WHERE nth <= 3""",
    "concept_merge": f"WITH {_CONCEPTS} SELECT key, concept, definition, chapters, anchors, CAST((SELECT count(DISTINCT name) FROM r WHERE r.source = n.key) AS INT) AS needs, ['planned', 'learning', 'learned'][rank] AS status, mastery, CASE WHEN llm = 1 THEN 'llm' ELSE 'rule' END AS method FROM n",
    "graph_edges": f"WITH {_CONCEPTS} SELECT source, target FROM p",
    "sequence_edges": f"WITH {_CONCEPTS} SELECT lo, hi FROM q",
    "unresolved_prereqs": f"WITH {_CONCEPTS} SELECT name, CAST(n AS INT) AS n FROM u",
    "graph_stats": f"WITH {_CONCEPTS} SELECT (SELECT count(*) FROM n) AS concepts, (SELECT count(*) FROM n WHERE rank > 1) AS learned, (SELECT count(*) FROM p) AS prerequisites, (SELECT count(*) FROM q) AS sequences, (SELECT count(*) FROM u) AS unresolved",
    "graph_b_nodes": f"WITH {_CONCEPTS} SELECT key, concept, chapters, anchor_count FROM n",
    "graph_b_edges": f"WITH {_CONCEPTS} SELECT DISTINCT source, lower(name) AS target FROM r WHERE lower(name) IN (SELECT key FROM n)",
    "topo_order": f"""WITH RECURSIVE {_CONCEPTS},
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chapter_id, concept ORDER BY ord) AS nth FROM c) WHERE nth = 1),
e AS (SELECT f.chapter_id, f.concept AS taker, m.concept AS need, CAST(m.ord > f.ord AS INT) AS later FROM f JOIN f m ON m.chapter_id = f.chapter_id AND list_contains(f.prerequisites, m.concept) AND m.concept <> f.concept),
w(chapter_id, concept, late, steps) AS (SELECT chapter_id, concept, 0, 0 FROM f UNION SELECT w.chapter_id, e.taker, w.late + e.later, w.steps + 1 FROM w JOIN e ON e.chapter_id = w.chapter_id AND e.need = w.concept WHERE w.steps < 60),
x AS (SELECT chapter_id, concept, CASE WHEN max(steps) < 60 THEN max(late) END AS pass FROM w GROUP BY ALL)
SELECT chapter_id, concept, CAST(row_number() OVER (PARTITION BY chapter_id ORDER BY pass NULLS LAST, ord) AS INT) AS position FROM x JOIN f USING (chapter_id, concept)""",
    "lesson_outline": """WITH s AS (SELECT source AS chapter_id, doc_id AS seq, CASE WHEN doc_id % 3 <> 0 THEN CAST(doc_id AS VARCHAR) END AS anchor, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents WHERE doc_id % 4 <> 0)
SELECT chapter_id, seq, anchor FROM s WHERE nth <= 3 AND anchor IS NOT NULL""",
    "lesson_contract_errors": """WITH e AS (SELECT s_nationkey AS chapter_id, unnest([CASE WHEN s_suppkey % 11 = 0 THEN 'no title' END, CASE WHEN s_suppkey % 5 = 0 THEN 'a step without source' END,
CASE WHEN s_suppkey % 5 <> 0 AND s_suppkey % 4 > s_nationkey % 4 THEN 'an unknown anchor' END, CASE WHEN s_suppkey % 7 = 0 THEN 'an empty step' END]) AS error FROM supplier) SELECT * FROM e WHERE error IS NOT NULL""",
    "quiz_distractors": """WITH n AS (SELECT DISTINCT p_size % 5 AS chapter_id, p_type AS concept FROM part),
o AS (SELECT a.chapter_id, a.concept, b.concept AS other, row_number() OVER (PARTITION BY a.chapter_id, a.concept ORDER BY abs(length(b.concept) - length(a.concept)), b.concept) AS nth FROM n a JOIN n b ON a.chapter_id = b.chapter_id AND a.concept <> b.concept)
SELECT chapter_id, concept, string_agg(other, '|' ORDER BY nth) AS others FROM o WHERE nth <= 3 GROUP BY ALL HAVING count(*) = 3""",
    "quiz_cloze": """WITH w AS (SELECT doc_id, text AS t, string_split(text, ' ')[2] AS w FROM documents WHERE len(string_split(text, ' ')) > 2)
SELECT doc_id, CASE WHEN instr(t, w) > 0 THEN substr(t, 1, instr(t, w) - 1) || '____' || substr(t, instr(t, w) + length(w)) ELSE t END AS prompt FROM w""",
    "quiz_grade": "SELECT doc_id AS id, quality = doc_id % 2 AS correct, CAST(quality = doc_id % 2 AS DOUBLE) AS value FROM labels JOIN documents USING (doc_id)",
    "plan_durations": f"SELECT doc_id, {_MINUTES} AS minutes FROM documents",
    "plan_totals": f"SELECT source, count(*) AS items, CAST(sum({_MINUTES}) AS BIGINT) AS minutes, arg_min(md5(text), doc_id) AS goal FROM documents GROUP BY source",
    "language_target": "SELECT doc_id, CASE WHEN length(regexp_replace(substr(text, 1, 400), '[^\\x{4e00}-\\x{9fff}]', '', 'g')) >= greatest(4, length(substr(text, 1, 400)) * 0.3) THEN 'en' ELSE 'zh' END AS language FROM documents",
    "first_sentence": f"SELECT doc_id, {_FIRST} AS head FROM (SELECT doc_id, text AS t FROM documents)",
    "rule_summary": f"""WITH l AS (SELECT doc_id AS book, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t AS (SELECT book, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t, count(*) OVER (PARTITION BY book) AS n FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY pos) AS nth FROM t WHERE t <> '')
SELECT book, '本章共 ' || n || ' 段正文，以下按段落顺序列出各段首句。' || chr(10) || string_agg('- ' || {_FIRST}, chr(10) ORDER BY nth) AS summary FROM f WHERE nth <= 6 GROUP BY book, n""",
    "rule_concepts_b": r"""WITH m AS (SELECT doc_id, text, regexp_extract(text, '(?s)^(.*?)(is the|was the)', 1) AS b, regexp_extract(text, '(?s)^(.*?)(is the|was the)', 2) AS k FROM documents WHERE regexp_matches(text, 'is the|was the')),
d AS (SELECT doc_id, regexp_replace(substr(text, 1, 14), '^[，。；: ：\t#]+|[，。；: ：\t#]+$', '', 'g') AS concept, regexp_replace(substr(text, greatest(length(b) - 40, 0) + 1, length(b) + length(k) + 160 - greatest(length(b) - 40, 0)), '^\s+|\s+$', '', 'g') AS definition FROM m)
SELECT * FROM d WHERE concept <> ''""",
}
