"""Queries that run as streams over the events table and end when it is read."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.joins import shared_folder
from lectern.plans import learning as batch
from lectern.plans.retrieval import table
from lectern.streaming import events as S
from lectern.streaming import ingest


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = S.source(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    kinds = F.create_map(*[F.lit(x) for pair in batch._KINDS.items() for x in pair])
    k = F.get_json_object("props", "$.k").cast("int")
    return raw.select(F.col("event_id").alias("id"), F.col("user_id").alias("book"), (k % 4).alias("chapter"), kinds[F.col("event_type")].alias("kind"), k.cast("string").alias("anchor_id"), F.when(k % 5 != 0, F.concat(F.lit("why "), k.cast("string"))).otherwise(" ").alias("detail"), (k % 2).cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def mastery_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = S.drained(S.mastery(_stream(spark, sf_dir), 25), "complete", "mastery")
    return done.select("book", "chapter", "read", "questions", F.round("accuracy", 9).alias("accuracy"), "completed", "mastery")


def dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.first_reads(_stream(spark, sf_dir)), "append", "reads").select("book", "chapter", "anchor_id")


def windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.drained(S.windows(_stream(spark, sf_dir)), "complete", "windows")


def best_score_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _stream(spark, sf_dir).select("book", (F.col("anchor_id").cast("double")).alias("value"))
    done = S.drained(S.best_so_far(scores), "update", "best")
    return done.groupBy("book").agg(F.max("best").alias("best"), F.max("n").alias("n"))


PARTS = 6


def _files(spark: SparkSession, sf_dir: str, *parts: Column) -> tuple[DataFrame, DataFrame]:
    """The events table (raw) as a stream of PARTS batches and a heartbeat, and as it is. parts: what deals events to batches; by default every batch has events of all times."""
    events = table(spark, sf_dir, "events")
    folder, each = S.dealt(events, parts[0] if parts else F.pmod(F.col("event_id") * 7, F.lit(PARTS)), PARTS)
    return S.source(spark, f"{folder}/", events.schema, each), events


def progress_throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What progress_throttle gives, from files that are out of order."""
    stream, _ = _files(spark, sf_dir)
    done = S.drained(S.throttled(stream, "user_id", seconds=86400, quiet=400 * 86400, delay="90 days"), "append", "throttle")
    return done.select("event_id", F.col("user_id").alias("book"))


def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What debounce_sessions gives, from files that are out of order."""
    stream, _ = _files(spark, sf_dir)
    done = S.drained(S.sessions(stream, "user_id", pause="6 hours", delay="90 days"), "append", "sessions")
    return done.select(F.col("user_id").alias("book"), F.unix_timestamp("start").alias("start"), "n", "last")


def answers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each error (a question) with the views (what is read for it) of the same user within the day after it: two streams."""
    stream, events = _files(spark, sf_dir)
    beat = F.col("event_type").isNull()
    asked, read = stream.where((F.col("event_type") == "error") | beat), stream.where((F.col("event_type") == "view") | beat)
    return S.drained(S.followed(asked, read, "user_id", "1 DAY", delay="90 days"), "append", "answers")


def late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By batch and kind, rows that came in time and too late for a delay of five days. Files have events of their own time, and each seventh event two files late."""
    bounds = table(spark, sf_dir, "events").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b")).first()
    own = F.floor((F.col("event_id") - bounds["a"]) * PARTS / (bounds["b"] - bounds["a"] + 1))
    stream, _ = _files(spark, sf_dir, F.least(own + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0), F.lit(PARTS - 1)))
    on_time, late = S.split_late(stream, datetime.timedelta(days=5))
    both = on_time.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1))).where(F.col("event_type").isNotNull())
    return both.groupBy("batch", F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))


def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's documents are a text file; the files are taken in as a stream, in batches of some."""
    folder, store = shared_folder(spark, "incoming"), shared_folder(spark, "store")
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(folder)
    ingest.ingest(spark, folder, store, per_batch=7, long_texts=True)
    rows = ingest.current(spark, store, "rows").withColumn("source", F.regexp_extract("book", "source=([^/]*)/", 1))
    return rows.groupBy("source", F.col("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (mastery_stream, dedupe_stream, windows_stream, best_score_stream, progress_throttle_stream, sessions_stream, answers_stream, late_stream, ingest_stream)}

ORACLE = {
    "mastery_stream": f"WITH {batch._EVENTS}, {batch._mastery_sql('m')} SELECT book, chapter, read, questions, round(accuracy, 9) AS accuracy, completed, mastery FROM ms",
    "dedupe_stream": f"WITH {batch._EVENTS} SELECT DISTINCT book, chapter, anchor_id FROM e WHERE kind = 'read'",
    "windows_stream": f"WITH {batch._EVENTS} SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, kind, count(*) AS n FROM e GROUP BY ALL",
    "best_score_stream": f"WITH {batch._EVENTS} SELECT book, max(CAST(anchor_id AS DOUBLE)) AS best, count(*) AS n FROM e GROUP BY book",
    "progress_throttle_stream": batch.ORACLE["progress_throttle"],
    "sessions_stream": batch.ORACLE["debounce_sessions"],
    "answers_stream": "SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY",
    "late_stream": f"""WITH f AS (SELECT *, least((event_id - (SELECT min(event_id) FROM events)) * {PARTS} // (SELECT max(event_id) - min(event_id) + 1 FROM events) + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END, {PARTS - 1}) AS batch FROM events),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f GROUP BY batch)
SELECT CAST(batch AS BIGINT) AS batch, event_type AS kind, count(*) AS n, CAST(sum(CASE WHEN ts < seen - INTERVAL 5 DAYS THEN 1 ELSE 0 END) AS BIGINT) AS late FROM f JOIN m USING (batch) GROUP BY ALL""",
    "ingest_stream": r"""WITH b AS (SELECT source, string_agg(text, chr(10) ORDER BY doc_id) || chr(10) AS body FROM documents GROUP BY source),
l AS (SELECT source, regexp_replace(unnest(string_split(body, chr(10))), '^\s+|\s+$', '', 'g') AS t, unnest(range(CAST(len(string_split(body, chr(10))) AS BIGINT))) AS pos FROM b),
f AS (SELECT *, starts_with(t, '```') OR starts_with(t, '~~~') AS mark, sum(CAST(starts_with(t, '```') OR starts_with(t, '~~~') AS INT)) OVER (PARTITION BY source ORDER BY pos) % 2 = 1 AS inside FROM l),
h AS (SELECT *, NOT inside AND regexp_matches(t, '^#{1,6}\s+(.*?)\s*#*\s*$') AS heading FROM f WHERE NOT mark)
SELECT source, CAST(CASE WHEN heading THEN length(regexp_extract(t, '^(#{1,6})\s', 1)) ELSE 0 END AS INT) AS level, count(*) AS n, CAST(sum(pos) AS BIGINT) AS places,
  CAST(sum(length(CASE WHEN heading THEN regexp_extract(t, '^#{1,6}\s+(.*?)\s*#*\s*$', 1) ELSE t END)) AS BIGINT) AS chars FROM h GROUP BY ALL""",
}
