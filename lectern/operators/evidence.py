"""Evidence for questions, answers made of it, and what they cite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X


def has_evidence(coverage: Column, recurring: Column) -> Column:
    """A term of the question recurs in the corpus, or the text covers enough of the question."""
    return (F.size(recurring) > 0) | (coverage >= K.VERBATIM_COVERAGE)


def question_text(selection: Column, question: Column) -> Column:
    picked = X.strip(F.coalesce(selection, F.lit("")))
    return F.when(picked != "", X.strip(F.concat(picked, F.lit(" "), question))).otherwise(X.strip(question))


def decide(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, coverage, recurring) with evident: whether the best hit of the query is evidence."""
    best = hits.where(F.col("rank") == 1).select("query_id", has_evidence(F.col("coverage"), F.col("recurring")).alias("evident"))
    return hits.join(best, "query_id")


def evidence(hits: DataFrame, doc_id: str, pinned: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, ordinal: the pinned section first, then the hits of evident queries without it, MAX_EVIDENCE in all. pinned: query_id, doc_id."""
    usable = decide(hits)
    if pinned is None:
        chosen = usable.where("evident").select("query_id", doc_id, "rank")
    else:
        mine = pinned.select("query_id", doc_id, F.lit(0).alias("rank"))
        held = usable.join(pinned.select("query_id", F.lit(True).alias("pin")).distinct(), "query_id", "left").where(F.col("evident") | F.col("pin")).select("query_id", doc_id, "rank")
        chosen = mine.unionByName(held.join(mine.select("query_id", doc_id), ["query_id", doc_id], "left_anti"))
    order = Window.partitionBy("query_id").orderBy("rank")
    return chosen.withColumn("ordinal", F.row_number().over(order)).where(F.col("ordinal") <= K.MAX_EVIDENCE).select("query_id", doc_id, "ordinal")


def closest(hits: DataFrame, doc_id: str) -> DataFrame:
    """For queries without evidence, the hits that come closest."""
    return decide(hits).where(~F.col("evident") & (F.col("rank") <= K.CLOSEST_LIMIT)).select("query_id", doc_id, "rank")


def scope_of(found: DataFrame, chapter: str, preferred: str, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """group, scope: 'chapter' if all hits are of the asker's chapter, else 'book'."""
    return found.groupBy(*group).agg(F.when(F.bool_and(F.col(chapter) == F.col(preferred)), "chapter").otherwise("book").alias("scope"))


def rule_answer(found: DataFrame, notice: str) -> DataFrame:
    """query_id, answer: a notice and one line for each piece of evidence. found: query_id, ordinal, chapter_title, page, text."""
    title = F.when(F.coalesce("chapter_title", F.lit("")) != "", F.concat(F.lit("《"), "chapter_title", F.lit("》"))).otherwise("")
    line = F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("] "), title, F.lit("第 "), F.col("page").cast("string"), F.lit(" 页："), X.clip(X.strip(F.col("text")), K.EXCERPT_CHARS))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))), lambda s: s["line"])
    return found.groupBy("query_id").agg(F.concat_ws("\n", F.lit(notice), F.array_join(lines, "\n")).alias("answer"))


def sources(answers: DataFrame, found: DataFrame, doc_id: str, fallback: int = 1, most: int = K.MAX_EVIDENCE) -> DataFrame:
    """query_id, doc_id, position: what an answer (query_id, answer) cites as [n], in order; without citations the first fallback pieces of evidence."""
    counted = found.groupBy("query_id").agg(F.max("ordinal").alias("available"))
    used = answers.join(counted, "query_id").withColumn("cited", F.slice(X.cited(F.col("answer"), F.col("available")), 1, most))
    filled = F.when(F.size("cited") > 0, F.col("cited")).otherwise(F.sequence(F.lit(1), F.least(F.lit(fallback), F.col("available"))))
    return used.select("query_id", F.posexplode(filled).alias("position", "ordinal")).join(found, ["query_id", "ordinal"]).select("query_id", doc_id, (F.col("position") + 1).alias("position"))


def notice(connected: Column) -> Column:
    """What stands before an answer by rule: no model is there, or it gave nothing."""
    return F.when(connected, F.lit(K.EMPTY_REPLY_NOTICE)).otherwise(F.lit(K.NO_MODEL_NOTICE))


def answers(hits: DataFrame, found: DataFrame, replies: DataFrame, doc_id: str, chapter: str) -> DataFrame:
    """query_id, answer, sources, scope, no_evidence, closest, hint: one record a query, of an answer or of a refusal.

    hits: query_id, rank, doc_id, chapter, coverage, recurring; found: query_id, ordinal, doc_id, chapter_title, page, text; replies: query_id,
    preferred, connected (whether a model is there), reply. A model's reply counts if it isn't blank, else the answer is made by rule."""
    ruled = rule_answer(found, "").join(replies, "query_id")
    said = F.when(~X.blank(F.col("reply")), X.strip(F.col("reply"))).otherwise(F.concat(notice(F.col("connected")), F.col("answer")))
    answered = ruled.select("query_id", said.alias("answer"))
    cited = sources(answered, found, doc_id).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(doc_id).alias("id")))), lambda s: s["id"]).alias("sources"))
    nearest = closest(hits, doc_id).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(doc_id).alias("id")))), lambda s: s["id"]).alias("closest"))
    scope = scope_of(hits.join(replies.select("query_id", "preferred"), "query_id"), chapter, "preferred")
    every = replies.select("query_id").join(answered, "query_id", "left").join(cited, "query_id", "left").join(nearest, "query_id", "left").join(scope, "query_id", "left")
    refused, none = F.col("answer").isNull(), F.slice(F.array(F.lit(None).cast(dict(hits.dtypes)[doc_id])), 1, 0)
    return every.select(
        "query_id",
        F.coalesce("answer", F.lit(K.NO_EVIDENCE_TEXT)).alias("answer"),
        F.coalesce("sources", none).alias("sources"),
        F.coalesce("scope", F.lit("book")).alias("scope"),
        refused.alias("no_evidence"),
        F.when(refused, F.coalesce("closest", none)).otherwise(none).alias("closest"),
        F.when(refused, K.NO_EVIDENCE_HINT).otherwise("").alias("hint"),
    )


def exchange(asked: DataFrame, records: DataFrame, thread: str = "thread_id") -> DataFrame:
    """thread, turn, role, text, sources, detail: a question and its answer as messages; what else the record says, also of a refusal, stands in detail as JSON. asked: query_id, thread, query."""
    both = asked.join(records, "query_id")
    none = F.slice(F.col("sources"), 1, 0)
    question = F.struct(F.lit(0).alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text"), none.alias("sources"), F.lit("").alias("detail"))
    answer = F.struct(F.lit(1).alias("turn"), F.lit("assistant").alias("role"), F.col("answer").alias("text"), F.col("sources"), F.to_json(F.struct("scope", "no_evidence", "closest", "hint")).alias("detail"))
    return both.select(thread, "query_id", F.explode(F.array(question, answer)).alias("m")).select(thread, "query_id", "m.*")


def source_details(found: DataFrame, current_chapter: Column) -> DataFrame:
    return found.withColumn("cross_chapter", F.col("chapter_id") != current_chapter)


def answer_events(answers: DataFrame, size: int = K.STREAM_CHARS) -> DataFrame:
    """request_id, seq, event, payload: meta, the answer in slices as delta, then done. answers: request_id, meta, answer, result."""
    meta = F.array(F.struct(F.lit("meta").alias("event"), F.col("meta").alias("payload")))
    deltas = F.transform(X.slices(F.col("answer"), size), lambda s: F.struct(F.lit("delta").alias("event"), s.alias("payload")))
    done = F.array(F.struct(F.lit("done").alias("event"), F.col("result").alias("payload")))
    return answers.select("request_id", F.posexplode(F.concat(meta, deltas, done)).alias("seq", "e")).select("request_id", "seq", "e.event", "e.payload")


def broken_off(events: DataFrame, failures: DataFrame) -> DataFrame:
    """events (request_id, seq, event, payload) of which those of failed requests (request_id, after, message) stop after a number of events and end in an error."""
    kept = events.join(failures.select("request_id", "after"), "request_id", "left").where(F.col("after").isNull() | (F.col("seq") < F.col("after"))).drop("after")
    return kept.unionByName(failures.select("request_id", F.col("after").cast("int").alias("seq"), F.lit("error").alias("event"), F.col("message").alias("payload")))


def frames(events: DataFrame) -> DataFrame:
    """Events as server-sent frames."""
    return events.withColumn("frame", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), F.to_json(F.struct("payload")), F.lit("\n\n")))


def parse_frames(streams: DataFrame, body: str = "body") -> DataFrame:
    """seq, event, data of the frames in a received text; frames without data are skipped."""
    parts = streams.select("*", F.posexplode(F.split(F.col(body), "\r?\n\r?\n")).alias("seq", "frame")).drop(body)
    event = F.coalesce(F.nullif(F.regexp_extract("frame", "(?m)^event:\\s*(.*)$", 1), F.lit("")), F.lit("message"))
    data = F.regexp_extract("frame", "(?m)^data:\\s?(.*)$", 1)
    return parts.withColumn("event", event).withColumn("data", data).where(F.col("data") != "").drop("frame")
