"""Queries on learning events. A user is a book's learner; props.k gives the anchor, k modulo 4 the chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import learning
from lectern.plans.retrieval import table

_KINDS = {"view": "read", "error": "ask", "purchase": "quiz", "click": "open", "signup": "complete"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("event_type")]
    return raw.select(
        F.col("event_id").alias("id"),
        "event_id",
        F.col("user_id").alias("book"),
        (F.col("k") % 4).alias("chapter"),
        kind.alias("kind"),
        F.col("k").cast("string").alias("anchor_id"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("why "), F.col("k").cast("string"))).otherwise(" ").alias("detail"),
        (F.col("k") % 2).cast("double").alias("value"),
        "ts",
    )


def event_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = learning.valid_events(events(spark, sf_dir))
    return accepted.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.lit("").alias("reason"), "n").unionByName(rejected.groupBy("kind", "reason").agg(F.count(F.lit(1)).alias("n")))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(100).select((F.col("id") % 4).cast("int").alias("chapter"), F.col("id").cast("string").alias("anchor_id")).where("id % 3 != 0")


def read_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = events(spark, sf_dir)
    known = every.select("book").distinct().crossJoin(F.broadcast(_anchors(spark, sf_dir)))
    return learning.first_reads(every, known, ["book", "chapter"]).select("id", "book", "chapter", "anchor_id")


def visible_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = events(spark, sf_dir).withColumn("ratio", F.col("anchor_id").cast("int") / 100.0)
    return learning.visible_reads(views, ["book"], "anchor_id").select("book", "anchor_id", F.unix_timestamp("at").alias("at"))


def _mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.mastery(learning.progress_parts(events(spark, sf_dir), ["book", "chapter"]), F.lit(25))


def mastery_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mastery(spark, sf_dir).select("book", "chapter", "read", "questions", F.round("accuracy", 9).alias("accuracy"), "completed", "mastery", "status")


def mastery_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first ten days gave is the old state, the rest the new."""
    every = events(spark, sf_dir)
    old, new = (learning.mastery(learning.progress_parts(every.where(cond), ["book", "chapter"]), F.lit(25)) for cond in ("dayofmonth(ts) <= 10", "dayofmonth(ts) > 10"))
    return learning.merge_progress(old, new, ["book", "chapter"]).select("book", "chapter", "mastery", "status", F.unix_timestamp("last_seen").alias("last_seen"))


def progress_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five chapters a book, of which events have four."""
    chapters = events(spark, sf_dir).select("book").distinct().select("book", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("chapter"))
    return learning.book_progress(chapters, _mastery(spark, sf_dir), "book", ["book", "chapter"]).select("book", F.round("progress_pct", 6).alias("progress_pct"))


def event_gaps_stall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.stalls(events(spark, sf_dir), "book", minutes=24 * 60).select("event_id", "gap_s")


def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.throttled(events(spark, sf_dir), "book", seconds=86400).select("event_id", "book")


def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.debounced(events(spark, sf_dir), "book", pause="6 hours").select("book", F.unix_timestamp("start").alias("start"), "n", "last")


_EVENTS = """k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
e AS (SELECT event_id AS id, event_id, user_id AS book, k % 4 AS chapter, CASE event_type WHEN 'view' THEN 'read' WHEN 'error' THEN 'ask' WHEN 'purchase' THEN 'quiz' WHEN 'click' THEN 'open' WHEN 'signup' THEN 'complete' END AS kind,
      CAST(k AS VARCHAR) AS anchor_id, CASE WHEN k % 5 <> 0 THEN 'why ' || k ELSE ' ' END AS detail, CAST(k % 2 AS DOUBLE) AS value, ts FROM k)"""


def _mastery_sql(name: str, where: str = "TRUE") -> str:
    return f"""{name}p AS (SELECT book, chapter, count(DISTINCT anchor_id) FILTER (WHERE kind = 'read') AS read, count(DISTINCT trim(detail)) FILTER (WHERE kind = 'ask' AND trim(detail) <> '') AS questions,
      avg(value) FILTER (WHERE kind = 'quiz') AS accuracy, coalesce(bool_or(kind = 'complete'), FALSE) AS completed, max(ts) AS last_seen FROM e WHERE {where} GROUP BY ALL),
{name} AS (SELECT *, round_even(round_even(round_even(read / 25 * CASE WHEN accuracy IS NULL THEN 50 * (100.0 / 75) ELSE 50 END, 1) + round_even(least(questions, 5) / 5 * CASE WHEN accuracy IS NULL THEN 25 * (100.0 / 75) ELSE 25 END, 1)
      + CASE WHEN accuracy IS NULL THEN 0 ELSE round_even(accuracy * 25, 1) END, 6), 0) AS mastery FROM {name}p),
{name}s AS (SELECT *, CASE WHEN completed OR mastery >= 80 THEN 'learned' ELSE 'learning' END AS status FROM {name})"""


def question_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are questions with a long text; other events keep none."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "ask").otherwise("open").alias("kind"), F.concat(F.lit("  "), F.repeat("props", 30)).alias("detail"))
    return learning.recorded(events)


QUERIES = {f.__name__: f for f in (question_events, event_validation, read_dedupe, visible_reads, mastery_breakdown, mastery_upsert, progress_average, event_gaps_stall, progress_throttle, debounce_sessions)}

ORACLE = {
    "question_events": "SELECT event_id AS id, CASE WHEN event_type = 'click' THEN 'ask' ELSE 'open' END AS kind, CASE WHEN event_type = 'click' THEN substr(repeat(props, 30), 1, 200) ELSE '' END AS detail FROM events",
    "event_validation": f"WITH {_EVENTS} SELECT kind, CASE WHEN kind = 'ask' AND trim(detail) = '' THEN 'question' ELSE '' END AS reason, count(*) AS n FROM e GROUP BY ALL",
    "read_dedupe": f"WITH {_EVENTS} SELECT min(id) AS id, book, chapter, anchor_id FROM e WHERE kind = 'read' AND CAST(anchor_id AS INT) % 3 <> 0 AND CAST(anchor_id AS INT) < 100 GROUP BY book, chapter, anchor_id",
    "visible_reads": f"WITH {_EVENTS} SELECT book, anchor_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS at FROM e WHERE CAST(anchor_id AS INT) / 100.0 > 0.25 GROUP BY ALL",
    "mastery_breakdown": f"WITH {_EVENTS}, {_mastery_sql('m')} SELECT book, chapter, read, questions, round(accuracy, 9) AS accuracy, completed, mastery, status FROM ms",
    "mastery_upsert": f"""WITH {_EVENTS}, {_mastery_sql('a', 'day(ts) <= 10')}, {_mastery_sql('b', 'day(ts) > 10')}
SELECT coalesce(o.book, n.book) AS book, coalesce(o.chapter, n.chapter) AS chapter, greatest(coalesce(o.mastery, 0), least(greatest(coalesce(n.mastery, 0), 0), 100)) AS mastery,
CASE WHEN o.status = 'learned' OR n.status = 'learned' THEN 'learned' ELSE coalesce(n.status, o.status) END AS status, CAST(floor(epoch(coalesce(n.last_seen, o.last_seen))) AS BIGINT) AS last_seen
FROM "as" o FULL JOIN bs n ON o.book = n.book AND o.chapter = n.chapter""".replace("\nas AS", '\n"as" AS'),
    "progress_average": f"""WITH {_EVENTS}, {_mastery_sql('m')}, c AS (SELECT DISTINCT book, unnest(range(5)) AS chapter FROM e)
SELECT c.book, round(avg(coalesce(mastery, 0)), 6) AS progress_pct FROM c LEFT JOIN m ON m.book = c.book AND m.chapter = c.chapter GROUP BY c.book""",
    "event_gaps_stall": "WITH g AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) - lag(CAST(floor(epoch(ts)) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_s FROM events) SELECT event_id, gap_s FROM g WHERE gap_s > 86400",
    "progress_throttle": """WITH s AS (SELECT event_id, user_id AS book, row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS l FROM events)
SELECT event_id, book FROM s WHERE f = 1 OR l = 1""",
    "debounce_sessions": """WITH g AS (SELECT event_id, user_id AS book, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 6 HOURS, TRUE) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY book ORDER BY ts, event_id) AS burst FROM g)
SELECT book, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n, arg_max(event_id, (ts, event_id)) AS last FROM n GROUP BY book, burst""",
}
