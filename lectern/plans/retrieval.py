"""Queries on the index, ranking and evidence. documents stand for sections: lang is the book, source the chapter; benchmark texts are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import containment, evidence, index, joins, search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("book"), F.col("source").alias("chapter"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text, asked of every book from a chapter."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("preferred"))


_DOCS = "d AS (SELECT doc_id, lang AS book, source AS chapter, regexp_extract_all(lower(text), '[a-z0-9_]+') AS toks FROM documents)"
_QUESTIONS = """q AS (SELECT item_id AS query_id, text AS query, 'src' || CAST(item_id % 20 AS VARCHAR) AS preferred FROM benchmark),
qt AS (SELECT query_id, preferred, unnest(list_distinct(regexp_extract_all(lower(query), '[a-z0-9_]+'))) AS term FROM q),
qn AS (SELECT query_id, count(*) AS asked FROM qt GROUP BY query_id)"""


def _scored(scope: str = "", where: str = "TRUE", on: str = "TRUE") -> str:
    """SQL of BM25 over documents and the questions; scope: columns of documents that a corpus is told by."""
    keys = f"{scope}, " if scope else ""
    using = f"USING ({scope})" if scope else "ON TRUE"
    return f"""{_DOCS}, {_QUESTIONS},
ds AS (SELECT * FROM d WHERE {where}),
n AS (SELECT {keys}count(*) AS n, CASE WHEN sum(len(toks)) = 0 THEN count(*) ELSE sum(len(toks)) END / greatest(count(*), 1) AS avgdl FROM ds GROUP BY {scope or '()'}),
tf AS (SELECT doc_id, book, chapter, term, dl, count(*) AS tf FROM (SELECT doc_id, book, chapter, len(toks) AS dl, unnest(toks) AS term FROM ds) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT {keys}term, count(*) AS df FROM tf GROUP BY ALL),
w AS (SELECT df.*, n.avgdl, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM df JOIN n {using}),
s AS (SELECT qt.query_id, qt.preferred, tf.doc_id, tf.book, tf.chapter, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched,
        list_sort(coalesce(list(tf.term) FILTER (WHERE df >= 2), [])) AS recurring, count(*) / any_value(asked) AS coverage
      FROM tf JOIN w USING ({keys}term) JOIN qt USING (term) JOIN qn USING (query_id) WHERE {on} GROUP BY ALL)"""


def tok_term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(table(spark, sf_dir, "documents"), ["doc_id"])


def tok_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(index.postings(table(spark, sf_dir, "documents"), ["doc_id"]))


def tok_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = index.doc_stats(sections(spark, sf_dir), ["book", "chapter", "doc_id"])
    return index.corpus_stats(stats, ["book", "chapter"]).select("book", "chapter", "n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents over all questions, each by the question it answers best."""
    # A document among the ten best of all is among the ten best of every question that it answers best.
    hits = search.ahead(*index.weighed(sections(spark, sf_dir), questions(spark, sf_dir), "doc_id"), 10, "doc_id", digits=6).withColumn("score", F.round("score", 6))
    best = hits.groupBy("doc_id").agg(F.max("score").alias("score"), F.min_by("query_id", F.struct(-F.col("score"), "query_id")).alias("query_id"))
    return best.orderBy(F.col("score").desc(), "doc_id").limit(10)


def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(sections(spark, sf_dir), questions(spark, sf_dir), 10, "doc_id").select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def coverage_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.shared(sections(spark, sf_dir), questions(spark, sf_dir), "doc_id", recurring=False).select("query_id", "doc_id", "matched", F.round("coverage", 9).alias("coverage"))


def recurring_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.shared(sections(spark, sf_dir), questions(spark, sf_dir), "doc_id").select("query_id", "doc_id", F.array_join("recurring", " ").alias("recurring"))


def _ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.best(sections(spark, sf_dir), questions(spark, sf_dir), 10, "doc_id")


def evidence_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.decide(_ten(spark, sf_dir)).select("query_id", "rank", "doc_id", "evident")


def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinned section (the one whose id is the question's) goes first."""
    pinned = questions(spark, sf_dir).select("query_id", F.col("query_id").alias("doc_id"))
    return evidence.evidence(_ten(spark, sf_dir), "doc_id", pinned)


def closest_when_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of an invented word and one rare term, so that some are refused."""
    rare = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("zzyzx qwyjibo grault plugh xyzzy "), F.element_at(F.split("text", " "), 1)).alias("query"))
    return evidence.closest(search.best(sections(spark, sf_dir), rare, 10, "doc_id"), "doc_id")


def chapter_scope_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).withColumn("chapter", F.col("preferred")).drop("preferred")
    found = search.chapter_search(sections(spark, sf_dir), asked, 5, "doc_id", "chapter", "book")
    return found.select("query_id", "book", "doc_id", "chapter", "rank", F.round("score", 6).alias("score"), F.round("coverage", 4).alias("coverage"))


def book_search_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.book_search(sections(spark, sf_dir), questions(spark, sf_dir), 10, "doc_id", "chapter", "book")
    return found.select("query_id", "book", "doc_id", "chapter", "rank", F.round("score", 6).alias("score"), F.array_join("recurring", " ").alias("recurring"))


def whole_book_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.book_search(sections(spark, sf_dir), questions(spark, sf_dir), 20, "doc_id", "chapter", "book", boost=False)
    return found.select("query_id", "book", "doc_id", "rank", F.round("score", 6).alias("score"))


def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    found = search.book_search(sections(spark, sf_dir), asked, 10, "doc_id", "chapter", "book")
    return evidence.scope_of(found.join(asked.select("query_id", "preferred"), "query_id"), "chapter", "preferred", ["query_id", "book"])


def fulltext_search_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = sections(spark, sf_dir).groupBy("chapter").agg(F.concat(F.lit("Chapter "), "chapter").alias("title"))
    hits = _ten(spark, sf_dir).select("query_id", "rank", "doc_id")
    return search.full_text(joins.small(hits), sections(spark, sf_dir), chapters, "doc_id", "chapter").select("query_id", "rank", "doc_id", "title", F.substring("text", 1, 40).alias("head"))


def substring_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.substring_search(sections(spark, sf_dir), "Thing").select("doc_id", F.instr(F.lower("text"), "thing").alias("at"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return search.vector_hits(vectors, asked, 10, "vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def cosine_allowed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    allowed = vectors.where("label = 3").select("vec_id")
    return search.vector_hits(vectors.join(allowed, "vec_id", "left_semi"), asked, 10, "vec_id").select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and vector channels, 30 deep; question i has vector 20 i, and vectors without a question are searched alone."""
    vectors, asked = _vectors(spark, sf_dir)
    asked = asked.withColumn("query_id", (F.col("query_id") / 20).cast("long"))
    lexical = search.ahead(*index.weighed(sections(spark, sf_dir), questions(spark, sf_dir), "doc_id"), 30, "doc_id")
    near = search.top(search.vector_hits(vectors, asked, 30, "vec_id").drop("rank"), 30, F.round("score", 9), ["vec_id"]).withColumnRenamed("vec_id", "doc_id")
    return search.fused_top([lexical.select("query_id", "doc_id", "rank"), near.select("query_id", "doc_id", "rank")], 10, "doc_id").select("query_id", "rank", "doc_id", F.round("fused", 9).alias("score"))


def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hash_embedding(table(spark, sf_dir, "documents"), ["doc_id"])


def hybrid_search_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 3, "doc_id")


def anchor_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts in documents of all books."""
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("needle"))
    return containment.contained(needles, sections(spark, sf_dir), [], "item_id", "doc_id", ["doc_id"])


def _quoted(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Pieces of evidence with what an answer quotes, kept: texts are read once and not shuffled for the few that are quoted."""
    texts = sections(spark, sf_dir).select("doc_id", F.col("chapter").alias("chapter_title"), (F.col("doc_id") % 50 + 1).alias("page"), "text")
    return joins.cut(texts.join(joins.small(joins.cut(found)), "doc_id"))


def rule_answer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.rule_answer(_quoted(spark, sf_dir, evidence.evidence(_ten(spark, sf_dir), "doc_id")), "No model.")


def cited_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that cite what their question's id says, against the evidence."""
    answers = questions(spark, sf_dir).select("query_id", F.when(F.col("query_id") % 3 == 0, "no mark").otherwise(F.concat(F.lit("as in ["), (F.col("query_id") % 7).cast("string"), F.lit("] and [2], [99], [2]"))).alias("answer"))
    return evidence.sources(answers, evidence.evidence(_ten(spark, sf_dir), "doc_id"), "doc_id")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions, every fourth of them of invented words and one that occurs, so that some are refused."""
    odd = F.concat(F.lit("zzyzx qwyjibo grault plugh xyzzy "), F.element_at(F.split("query", " "), 1))
    return questions(spark, sf_dir).withColumn("query", F.when(F.col("query_id") % 4 == 3, odd).otherwise(F.col("query")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("query_id")
    asked = _asked(spark, sf_dir)
    hits = joins.small(search.best(sections(spark, sf_dir), asked, 10, "doc_id"))
    hits = joins.cut(sections(spark, sf_dir).select("doc_id", "chapter").join(hits, "doc_id"))
    found = _quoted(spark, sf_dir, evidence.evidence(hits, "doc_id"))
    replies = asked.select("query_id", "preferred", (k % 2 == 0).alias("connected"), F.when(k % 3 == 2, " See [2] and [1]\n").when(k % 3 == 1, "  ").alias("reply"))
    return evidence.answers(hits, found, replies, "doc_id", "chapter")


def answer_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by a model that is there, that says nothing, or that is missing, and refusals."""
    return _records(spark, sf_dir).select("query_id", "answer", F.array_join(F.col("sources").cast("array<string>"), " ").alias("sources"), "scope", "no_evidence", F.array_join(F.col("closest").cast("array<string>"), " ").alias("closest"), "hint")


def exchange_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as messages of threads; a thread is a question's chapter."""
    asked = _asked(spark, sf_dir).select("query_id", F.col("preferred").alias("thread_id"), "query")
    return evidence.exchange(asked, _records(spark, sf_dir)).select("thread_id", "query_id", "turn", "role", F.length("text").alias("chars"), F.size("sources").alias("sources"), F.get_json_object("detail", "$.no_evidence").alias("no_evidence"))


_TEN = "ten AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10)"
_EVIDENT = "best AS (SELECT query_id, len(recurring) > 0 OR coverage >= 0.22 AS evident FROM ten WHERE rank = 1)"
_EVIDENCE = f"{_TEN}, {_EVIDENT}, ev AS (SELECT query_id, doc_id, rank AS ordinal FROM ten JOIN best USING (query_id) WHERE evident)"
_BOOK = _scored("book")


def _book_search(k: int, boost: bool) -> str:
    deep = max(3 * k, 10)
    factor = "CASE WHEN chapter = preferred THEN 1.35 ELSE 1 END" if boost else "1"
    return f"""WITH {_BOOK},
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY round(score, 9) DESC, doc_id) AS place FROM s) WHERE place <= {deep}),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY round(score, 9) * {factor} DESC, place) AS rank FROM c)"""


def _vector_sql(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(qv AS DOUBLE[]), CAST(qv AS DOUBLE[])))) AS score FROM embeddings, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)"""


_RECORDS = f"""WITH {_scored()}, {_EVIDENCE},
l AS (SELECT query_id, ordinal, doc_id, '[' || ordinal || '] 《' || source || '》第 ' || (doc_id % 50 + 1) || ' 页：' || CASE WHEN length(trim(text, chr(10) || ' ')) > 120 THEN substr(trim(text, chr(10) || ' '), 1, 120) || '…' ELSE trim(text, chr(10) || ' ') END AS line FROM ev JOIN documents USING (doc_id)),
r AS (SELECT query_id, string_agg(line, chr(10) ORDER BY ordinal) AS lines, list(doc_id ORDER BY ordinal) AS ids FROM l GROUP BY query_id),
o AS (SELECT query_id, list(doc_id ORDER BY rank) FILTER (WHERE rank <= 3 AND NOT evident) AS near, CASE WHEN bool_and(chapter = preferred) THEN 'chapter' ELSE 'book' END AS scope FROM ten JOIN best USING (query_id) GROUP BY query_id),
a AS (SELECT q.query_id, q.query, q.preferred, r.lines IS NULL AS no_evidence, coalesce(o.scope, 'book') AS scope,
  CASE WHEN r.lines IS NULL THEN '教材中未找到直接依据' WHEN q.query_id % 3 = 2 THEN 'See [2] and [1]'
       ELSE CASE WHEN q.query_id % 2 = 0 THEN '（模型这次没有返回内容，先给出教材中与你的问题最相关的原文，可对照核对。）' ELSE '（未接入大模型，这里直接给出教材中与你的问题最相关的原文，可对照核对。）' END || chr(10) || r.lines END AS answer,
  CASE WHEN r.lines IS NULL THEN [] WHEN q.query_id % 3 <> 2 THEN r.ids WHEN len(r.ids) > 1 THEN [r.ids[2], r.ids[1]] ELSE r.ids END AS sources,
  CASE WHEN r.lines IS NULL THEN coalesce(o.near, []) ELSE [] END AS closest, CASE WHEN r.lines IS NULL THEN '可以换个问法：点出教材里的具体概念（例如「导数的定义」）；或者直接选中相关原文再提问——划词追问不受依据判定限制。' ELSE '' END AS hint
  FROM q LEFT JOIN r USING (query_id) LEFT JOIN o USING (query_id))""".replace("text AS query", "CASE WHEN item_id % 4 = 3 THEN 'zzyzx qwyjibo grault plugh xyzzy ' || string_split(text, ' ')[1] ELSE text END AS query")

QUERIES = {
    f.__name__: f
    for f in (
        tok_term_frequency, tok_document_frequency, tok_corpus_stats, bm25_topk, bm25_multi_query, coverage_per_doc, recurring_terms, evidence_decision, evidence_rows, closest_when_refused,
        chapter_scope_search, book_search_boosted, whole_book_search, search_scope, fulltext_search_joined, substring_search, cosine_topk, cosine_allowed_ids, rrf_fusion, hash_embedding, hybrid_search_b,
        anchor_containment, rule_answer_text, cited_anchors, answer_records, exchange_messages,
    )
}

ORACLE = {
    "answer_records": f"{_RECORDS} SELECT query_id, answer, array_to_string(sources, ' ') AS sources, scope, no_evidence, array_to_string(closest, ' ') AS closest, hint FROM a",
    "exchange_messages": f"""{_RECORDS} SELECT preferred AS thread_id, query_id, 0 AS turn, 'user' AS role, CAST(length(query) AS INT) AS chars, 0 AS sources, CAST(NULL AS VARCHAR) AS no_evidence FROM a
UNION ALL SELECT preferred, query_id, 1, 'assistant', CAST(length(answer) AS INT), CAST(len(sources) AS INT), CAST(no_evidence AS VARCHAR) FROM a""",
    "tok_term_frequency": "SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY ALL",
    "tok_document_frequency": "SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents) GROUP BY ALL",
    "tok_corpus_stats": f"WITH {_DOCS} SELECT book, chapter, count(*) AS n, round(sum(len(toks)) / count(*), 6) AS avgdl FROM d GROUP BY ALL",
    "bm25_topk": f"WITH {_scored()} SELECT doc_id, max(round(score, 6)) AS score, arg_min(query_id, (-round(score, 6), query_id)) AS query_id FROM s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10",
    "bm25_multi_query": f"WITH {_scored()}, {_TEN} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ten",
    "coverage_per_doc": f"WITH {_scored()} SELECT query_id, doc_id, matched, round(coverage, 9) AS coverage FROM s",
    "recurring_terms": f"WITH {_scored()} SELECT query_id, doc_id, array_to_string(recurring, ' ') AS recurring FROM s",
    "evidence_decision": f"WITH {_scored()}, {_TEN}, {_EVIDENT} SELECT query_id, rank, doc_id, evident FROM ten JOIN best USING (query_id)",
    "evidence_rows": f"""WITH {_scored()}, {_TEN},
u AS (SELECT query_id, query_id AS doc_id, 0 AS rank FROM q UNION ALL SELECT query_id, doc_id, rank FROM ten WHERE query_id <> doc_id)
SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS ordinal FROM u) WHERE ordinal <= 10""",
    "closest_when_refused": f"WITH {_scored()}, {_TEN}, {_EVIDENT} SELECT query_id, doc_id, rank FROM ten JOIN best USING (query_id) WHERE NOT evident AND rank <= 3".replace("text AS query", "'zzyzx qwyjibo grault plugh xyzzy ' || string_split(text, ' ')[1] AS query"),
    "chapter_scope_search": f"""WITH {_scored("book, chapter", "TRUE", "tf.chapter = qt.preferred")},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, book ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, book, doc_id, chapter, rank, round(1.0 / (60 + rank), 6) AS score, round(coverage, 4) AS coverage FROM r WHERE rank <= 5""",
    "book_search_boosted": _book_search(10, True) + " SELECT query_id, book, doc_id, chapter, rank, round(1.0 / (60 + rank), 6) AS score, array_to_string(recurring, ' ') AS recurring FROM b WHERE rank <= 10",
    "whole_book_search": _book_search(20, False) + " SELECT query_id, book, doc_id, rank, round(1.0 / (60 + rank), 6) AS score FROM b WHERE rank <= 20",
    "search_scope": _book_search(10, True) + " SELECT query_id, book, CASE WHEN bool_and(chapter = preferred) THEN 'chapter' ELSE 'book' END AS scope FROM b WHERE rank <= 10 GROUP BY query_id, book",
    "fulltext_search_joined": f"WITH {_scored()}, {_TEN} SELECT query_id, rank, doc_id, 'Chapter ' || source AS title, substr(text, 1, 40) AS head FROM ten JOIN documents USING (doc_id)",
    "substring_search": "SELECT doc_id, instr(lower(text), 'thing') AS at FROM documents WHERE contains(lower(text), 'thing')",
    "cosine_topk": _vector_sql("TRUE") + " SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "cosine_allowed_ids": _vector_sql("label = 3") + " SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "rrf_fusion": f"""WITH {_scored()},
l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s),
v AS ({_vector_sql("TRUE")} SELECT query_id // 20 AS query_id, vec_id AS doc_id, rank FROM r),
f AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS fused, min(channel * 1000 + rank) AS seen FROM (SELECT *, 0 AS channel FROM l WHERE rank <= 30 UNION ALL SELECT *, 1 FROM v WHERE rank <= 30) GROUP BY ALL)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen) AS rank, doc_id, round(fused, 9) AS score FROM f) WHERE rank <= 10""",
    "anchor_containment": r"""WITH n AS (SELECT item_id, regexp_replace(text, '[\s\-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}]', '', 'g') AS needle FROM benchmark),
p AS (SELECT doc_id, regexp_replace(text, '[\s\-\x{2010}\x{2011}\x{2012}\x{2013}\x{2014}]', '', 'g') AS form FROM documents),
m AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY length(form) DESC, doc_id) AS nth FROM n JOIN p ON contains(form, needle) WHERE length(needle) >= 4)
SELECT item_id, doc_id FROM m WHERE nth = 1""",
    "rule_answer_text": f"""WITH {_scored()}, {_EVIDENCE},
l AS (SELECT query_id, ordinal, '[' || ordinal || '] 《' || source || '》第 ' || (doc_id % 50 + 1) || ' 页：' || CASE WHEN length(trim(text, chr(10) || ' ')) > 120 THEN substr(trim(text, chr(10) || ' '), 1, 120) || '…' ELSE trim(text, chr(10) || ' ') END AS line FROM ev JOIN documents USING (doc_id))
SELECT query_id, 'No model.' || chr(10) || string_agg(line, chr(10) ORDER BY ordinal) AS answer FROM l GROUP BY query_id""",
    "cited_anchors": f"""WITH {_scored()}, {_EVIDENCE},
m AS (SELECT query_id, max(ordinal) AS available FROM ev GROUP BY query_id),
a AS (SELECT query_id, CASE WHEN query_id % 3 = 0 THEN [] ELSE list_filter([query_id % 7, 2], lambda x: x >= 1 AND x <= available) END AS raw, available FROM q JOIN m USING (query_id)),
u AS (SELECT query_id, CASE WHEN len(raw) = 0 THEN [1] WHEN len(raw) = 2 AND raw[1] = raw[2] THEN [raw[1]] ELSE raw END AS cited FROM a),
e AS (SELECT query_id, unnest(cited) AS ordinal, generate_subscripts(cited, 1) AS position FROM u)
SELECT query_id, doc_id, CAST(position AS INTEGER) AS position FROM e JOIN ev USING (query_id, ordinal)""",
}
