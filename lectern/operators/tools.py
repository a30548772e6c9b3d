"""Reading tools: translation and summaries as event rows, with rules where there is no model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators import chunking, concepts, evidence

MOST_TRANSLATED = 3000
NO_TRANSLATION = "（未接入大模型，无法翻译。下面是原文，请自行对照阅读。）"
RULE_SUMMARY = "（未接入大模型，以下是按段落首句抽取的规则摘要，不是模型写的总结。）"


def body_paragraphs(sections: DataFrame, page: int | None = None) -> DataFrame:
    """Sections that are text, of one page if given."""
    found = sections.where((F.col("kind") != "heading") & ~X.blank(F.col("text")))
    return found if page is None else found.where(F.col("page") == page)


def translation_requests(texts: DataFrame, requested: str = "") -> DataFrame:
    """texts (request_id, text) cut off, with their target language and prompt."""
    cut = texts.withColumn("text", F.substring("text", 1, MOST_TRANSLATED))
    return cut.withColumn("language", X.target_language(F.col("text"), requested)).withColumn("prompt", F.concat(F.lit("Translate to "), "language", F.lit(":\n"), "text"))


def translation_events(translated: DataFrame) -> DataFrame:
    """Event rows of requests with a reply; without one, a notice and the original."""
    answer = F.when(X.blank(F.col("reply")), F.concat(F.lit(NO_TRANSLATION + "\n"), "text")).otherwise(F.col("reply"))
    return evidence.answer_events(translated.select("request_id", F.to_json(F.struct("language")).alias("meta"), answer.alias("answer"), F.lit("{}").alias("result")))


def numbered(paragraphs: DataFrame, keys: Sequence[str], order: str, most: int = 400) -> DataFrame:
    """keys, ordinal, block: paragraphs numbered through the whole chapter, so that citations of any chunk find theirs."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return paragraphs.withColumn("ordinal", place).withColumn("block", F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("] "), F.substring("text", 1, most)))


def summary_prompts(paragraphs: DataFrame, keys: Sequence[str], order: str, anchor: str) -> DataFrame:
    """keys, chunk, text, anchors of the first SUMMARY_CHUNKS chunks of numbered paragraphs."""
    rows = numbered(paragraphs, keys, order).withColumn("text", F.concat("block", F.lit("\n")))
    return chunking.summary_chunks(rows, keys, "ordinal", anchor, "text").where(F.col("chunk") <= K.SUMMARY_CHUNKS)


def summaries(paragraphs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """keys, summary by rules, with its notice."""
    return concepts.rule_summary(paragraphs, keys, order).withColumn("summary", F.concat(F.lit(RULE_SUMMARY + "\n"), "summary"))
