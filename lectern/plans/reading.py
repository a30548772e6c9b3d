"""Queries on selections, headings of page formats, and styled runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import anchors, pages
from lectern.plans.retrieval import table
from lectern.sources import files


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a paragraph on the page of its id in tens."""
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("book"), F.floor(F.col("doc_id") / 10).cast("int").alias("page"), F.col("doc_id").alias("anchor"), "text")


def selection_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections from each 20th document, one page off where its id divides by 40."""
    asked = table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select(F.col("doc_id").alias("selection_id"), F.col("lang").alias("book"), (F.floor(F.col("doc_id") / 10) + F.when(F.col("doc_id") % 40 == 0, 1).otherwise(0)).cast("int").alias("page"), F.substring("text", 30, 60).alias("needle"))
    return anchors.matched(asked, _paragraphs(spark, sf_dir))


def page_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.page_anchors(_paragraphs(spark, sf_dir)).select("book", "page", F.size("anchors").alias("n"), F.element_at("anchors", 1).alias("first"))


def current_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.dayofmonth("ts").alias("page"), F.col("value").alias("ratio"))
    return anchors.current_page(seen)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders: the quantity is the size, the part number the place."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("book"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").alias("size"), F.col("l_partkey").cast("double").alias("y"), F.concat(F.lit("Line "), F.col("l_linenumber").cast("string")).alias("text"))


def page_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.body_size(_lines(spark, sf_dir))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.headings(_lines(spark, sf_dir), pages.body_size(_lines(spark, sf_dir))).select("book", "page", "y", "text")


def run_body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.body_size(_lines(spark, sf_dir))


QUERIES = {f.__name__: f for f in (selection_match, page_anchors, current_page, page_body_size, page_headings, run_body_sizes)}

_LINES = "l AS (SELECT l_suppkey AS book, l_orderkey AS page, l_linenumber AS ord, l_quantity AS size, CAST(l_partkey AS DOUBLE) AS y, 'Line ' || l_linenumber AS text FROM lineitem), s AS (SELECT book, list_sort(list(size))[count(*) // 2 + 1] AS body FROM l GROUP BY book)"

ORACLE = {
    "page_anchors": "SELECT lang AS book, CAST(doc_id // 10 AS INT) AS page, CAST(count(*) AS INT) AS n, min(doc_id) AS first FROM documents GROUP BY ALL",
    "current_page": "SELECT user_id AS session, CAST(arg_max(day(ts), (value, -day(ts))) AS INT) AS page FROM events GROUP BY user_id",
    "page_body_size": f"WITH {_LINES} SELECT book, body FROM s",
    "page_headings": f"WITH {_LINES}, h AS (SELECT book, page, y, arg_max(text, ord) AS text FROM l JOIN s USING (book) WHERE size >= 1.18 * body GROUP BY ALL) SELECT * FROM h",
    "run_body_sizes": f"WITH {_LINES}, c AS (SELECT book, size, count(*) AS n FROM l WHERE size > 0 GROUP BY ALL) SELECT book, arg_max(size, (n, -size)) AS body FROM c GROUP BY book",
}
