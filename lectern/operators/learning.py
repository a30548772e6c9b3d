"""Learning events: recording, mastery, and its state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import constants as K
from lectern.functions import text as X


def valid_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason) of events (kind, anchor_id, detail, value)."""
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*K.EVENT_KINDS), F.lit(False)), "kind")
        .when((F.col("kind") == "read") & X.blank(F.col("anchor_id")), "anchor")
        .when((F.col("kind") == "ask") & X.blank(F.col("detail")), "question")
        .when((F.col("kind") == "quiz") & (F.col("value").isNull() | ~F.col("value").between(0.0, 1.0)), "value")
    )
    checked = events.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def recorded(events: DataFrame) -> DataFrame:
    """events as they are kept: a question is stripped and cut to QUESTION_CHARS characters, other kinds have no detail."""
    return events.withColumn("detail", F.when(F.col("kind") == "ask", F.substring(X.strip(F.coalesce("detail", F.lit(""))), 1, K.QUESTION_CHARS)).otherwise(""))


def first_reads(events: DataFrame, anchors: DataFrame, keys: Sequence[str], anchor: str = "anchor_id", order: str = "id", seen: DataFrame | None = None) -> DataFrame:
    """Read events of known anchors, the first of each anchor only, none that was seen before."""
    reads = events.where(F.col("kind") == "read").join(anchors.select(*keys, anchor).distinct(), [*keys, anchor], "left_semi")
    if seen is not None:
        reads = reads.join(seen.select(*keys, anchor), [*keys, anchor], "left_anti")
    nth = F.row_number().over(Window.partitionBy(*keys, anchor).orderBy(order))
    return reads.withColumn("__nth", nth).where(F.col("__nth") == 1).drop("__nth")


def visible_reads(views: DataFrame, keys: Sequence[str], anchor: str, ratio: float = 0.25) -> DataFrame:
    """keys, anchor, at: an anchor counts as read when more than a share of it first comes into view."""
    return views.where(F.col("ratio") > ratio).groupBy(*keys, anchor).agg(F.min("ts").alias("at"))


def half_even(x: Column) -> Column:
    """Rounded to an integer, halves to the even one."""
    return F.bround(x, 0)


def progress_parts(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, read (distinct anchors), questions, accuracy, completed, events: all that mastery needs, in one aggregate."""
    kind = F.col("kind")
    return events.groupBy(*keys).agg(
        F.count_distinct(F.when(kind == "read", F.col("anchor_id"))).alias("read"),
        F.count_distinct(F.when((kind == "ask") & ~X.blank(F.col("detail")), X.strip(F.col("detail")))).alias("questions"),
        F.avg(F.when(kind == "quiz", F.col("value"))).alias("accuracy"),
        F.coalesce(F.max(kind == "complete"), F.lit(False)).alias("completed"),
        F.count(F.lit(1)).alias("events"),
        F.max("ts").alias("last_seen"),
    )


def mastery(parts: DataFrame, paragraphs: Column, half_up: bool = False) -> DataFrame:
    """parts with coverage, engagement, mastery and status. Without quizzes the other weights share all. half_up: halves are rounded up, as a reader's own device does."""
    coverage = F.when(paragraphs > 0, F.col("read") / paragraphs).otherwise(F.lit(0.0))
    engagement = F.least(F.col("questions"), F.lit(K.QUESTION_CAP)) / F.lit(float(K.QUESTION_CAP))
    quizzed = F.col("accuracy").isNotNull()
    of_rest = 100.0 / (K.COVERAGE_WEIGHT + K.ENGAGEMENT_WEIGHT)

    def share(value: Column, weight: float) -> Column:
        return (F.round if half_up else F.bround)(value * F.when(quizzed, F.lit(weight)).otherwise(F.lit(weight * of_rest)), 1)

    out = parts.withColumn("coverage", coverage).withColumn("engagement", engagement)
    points = share(F.col("coverage"), K.COVERAGE_WEIGHT) + share(F.col("engagement"), K.ENGAGEMENT_WEIGHT) + F.when(quizzed, F.bround(F.col("accuracy") * K.ACCURACY_WEIGHT, 1)).otherwise(0.0)
    out = out.withColumn("mastery", F.round(F.bround(points, 6), 0) if half_up else half_even(F.bround(points, 6)))
    return out.withColumn("status", F.when(F.col("completed") | (F.col("mastery") >= K.LEARNED_FROM), "learned").when(F.col("events") > 0, "learning").otherwise("planned"))


def merge_progress(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Monotone state: mastery within 0 to 100 and never lower, learned stays, last_seen is the new one. One full outer join on the keys."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys], "full")
    level = F.greatest(F.coalesce("o.mastery", F.lit(0.0)), F.least(F.greatest(F.coalesce("n.mastery", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)))
    status = F.when((F.col("o.status") == "learned") | (F.col("n.status") == "learned"), "learned").otherwise(F.coalesce("n.status", "o.status"))
    return joined.select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], level.alias("mastery"), status.alias("status"), F.coalesce("n.last_seen", "o.last_seen").alias("last_seen"))


def book_progress(chapters: DataFrame, progress: DataFrame, book: str, keys: Sequence[str]) -> DataFrame:
    """book, progress_pct: mean mastery over all of a book's chapters, 0 for those without."""
    return chapters.join(progress.select(*keys, "mastery"), list(keys), "left").groupBy(book).agg(F.avg(F.coalesce("mastery", F.lit(0.0))).alias("progress_pct"))


def stalls(events: DataFrame, key: str, ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Events that come more than so many minutes after the one before."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    return events.withColumn("before", before).withColumn("gap_s", F.unix_timestamp(ts) - F.unix_timestamp("before")).where(F.col("gap_s") > 60 * minutes)


def throttled(events: DataFrame, key: str, ts: str = "ts", seconds: int = 1) -> DataFrame:
    """A key's first event of each interval, and its last of all."""
    slot = F.floor(F.unix_timestamp(ts) / seconds)
    first = F.row_number().over(Window.partitionBy(key, "__slot").orderBy(ts, "event_id")) == 1
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col("event_id").desc())) == 1
    return events.withColumn("__slot", slot).withColumn("__first", first).withColumn("__last", last).where(F.col("__first") | F.col("__last")).drop("__slot", "__first", "__last")


def debounced(events: DataFrame, key: str, ts: str = "ts", pause: str = "250 milliseconds") -> DataFrame:
    """key, start, n, last: bursts of events with no pause between, and the last event of each."""
    return events.groupBy(key, F.session_window(ts, pause).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct(ts, "event_id")).alias("last")).select(key, F.col("w.start").alias("start"), "n", "last")
