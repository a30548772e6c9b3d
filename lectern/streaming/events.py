"""Learning events as streams: deduplication, mastery and windows kept up to date by Structured Streaming."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions import text as X
from lectern.operators import learning
from lectern.operators.joins import shared_folder


#: Rows of a file that dealt() writes, about; and those a part must have for each of its files if it has several.
FILE_ROWS, SURE_ROWS = 250_000, 100_000


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:  # noqa: ANN001
    """A Parquet file or folder as a stream. The path is given as a pattern, as Spark takes only patterns and folders here."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def drained(stream: DataFrame, mode: str, kind: str) -> DataFrame:
    """What a stream gives once it has read all there is now. In complete mode the last batch counts, otherwise all of them."""
    spark = stream.sparkSession
    out, check = shared_folder(spark, kind), shared_folder(spark, f"{kind}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/last" if mode == "complete" else f"{out}/batch={number}")

    with rocksdb(spark):
        _run(stream, mode, check, write)
    return spark.read.parquet(f"{out}/last" if mode == "complete" else out).drop("batch")


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start here keep their state in RocksDB: on disk, so that it may pass the memory, with what changes written to the checkpoint folder."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _run(stream: DataFrame, mode: str, check: str, write) -> None:  # noqa: ANN001
    stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def dealt(events: DataFrame, part: Column, parts: int, ts: str = "ts") -> tuple[str, int]:
    """A folder with events in so many parts, which a stream reads in their order, and the number of files that each part has; and a last file with a single heartbeat: a row of nulls
    but for a time ten years on, which ends all that waits for time to pass."""
    folder = shared_folder(events.sparkSession, "dealt")
    rows = {r["part"]: r["n"] for r in events.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n")).collect() if r["part"] in range(parts)}
    # Rows go round the files, so none stays empty where there are so many more rows than tasks.
    each = max(min(-(-sum(rows.values()) // (parts * FILE_ROWS)), min(rows.get(at, 0) for at in range(parts)) // SURE_ROWS), 1)
    for at in range(parts):
        own = events.where(part == at)
        (own.repartition(each) if each > 1 else own.coalesce(1)).write.mode("append").parquet(folder)
    end = events.agg((F.max(ts) + F.expr("INTERVAL 10 YEARS")).cast(events.schema[ts].dataType).alias(ts))
    end.select(*[F.col(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.mode("append").parquet(folder)
    return folder, each


def first_reads(events: DataFrame, delay: str = "60 days") -> DataFrame:
    """The first event of each anchor read; state older than the delay is dropped."""
    return events.where(F.col("kind") == "read").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["book", "chapter", "anchor_id"])


def mastery(events: DataFrame, paragraphs: int) -> DataFrame:
    """Mastery of each book and chapter, for complete mode. What is counted distinctly is deduplicated first: anchors read, questions asked. It counts
    over all time, so the state holds every different anchor and question for good (on disk, with a RocksDB state store); windows() and first_reads() drop theirs."""
    key = F.when(F.col("kind") == "read", F.col("anchor_id")).when(F.col("kind") == "ask", X.strip(F.col("detail"))).otherwise(F.col("id").cast("string"))
    once = events.where((F.col("kind") != "ask") | ~X.blank(F.col("detail"))).withColumn("key", key).dropDuplicates(["book", "chapter", "kind", "key"])
    kind = F.col("kind")
    parts = once.groupBy("book", "chapter").agg(
        F.count(F.when(kind == "read", 1)).alias("read"),
        F.count(F.when(kind == "ask", 1)).alias("questions"),
        F.avg(F.when(kind == "quiz", F.col("value"))).alias("accuracy"),
        F.max(kind == "complete").alias("completed"),
        F.count(F.lit(1)).alias("events"),
    )
    return learning.mastery(parts, F.lit(paragraphs))


def windows(events: DataFrame, size: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """Events by kind in windows of event time; an addition to what the library is modelled on."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.unix_timestamp("w.start").alias("start"), "kind", "n")


def best_so_far(scores: DataFrame) -> DataFrame:
    """book, best, n for update mode: state of our own that never falls. scores: book, value; null values are counted, but are no best."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, n = state.get if state.exists else (None, 0)
        for frame in frames:
            values, n = frame["value"].dropna(), n + len(frame)
            if len(values):
                best = float(values.max()) if best is None else max(best, float(values.max()))
        state.update((best, n))
        yield pd.DataFrame({"book": [key[0]], "best": [best], "n": [n]})

    return scores.groupBy("book").applyInPandasWithState(fold, "book long, best double, n long", "best double, n long", "update", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, ts: str = "ts", seconds: int = 1, quiet: int = 3600, delay: str = "1 hour") -> DataFrame:
    """key, event_id: what learning.throttled keeps, as a stream (append mode): events may come in any order within delay; a key that is silent for quiet seconds (no fewer than an
    interval) is over, so that its last event counts. Rows without a key only move time on. State is a row of each open interval, and one of each key that isn't over."""
    time = F.col(ts).cast("timestamp")
    rows = events.select(F.col(key).cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(time).alias("ts_us"), time.alias("ts")).withWatermark("ts", delay)
    event, slot = F.struct("ts_us", "event_id"), F.expr(f"ts_us div {seconds * 1_000_000} - CAST(ts_us % {seconds * 1_000_000} < 0 AS INT)")
    # By the count, not by the key: a filter on the key would stand before the watermark.
    keyed = F.count("key").alias("n")
    firsts = rows.groupBy("key", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.min(event).alias("first"), keyed).where("n > 0").select("key", "first.event_id")
    # A key's last event, unless it is the first one of its interval too.
    ends = rows.groupBy("key", F.session_window("ts", f"{max(quiet, seconds)} seconds").alias("w")).agg(F.max(event).alias("last"), F.min(F.struct((-slot).alias("slot"), "ts_us", "event_id")).alias("first"), keyed)
    lasts = ends.where((F.col("n") > 0) & (F.col("last.event_id") != F.col("first.event_id"))).select("key", "last.event_id")
    return firsts.unionByName(lasts).withColumnRenamed("key", key)


def sessions(events: DataFrame, key: str, ts: str = "ts", pause: str = "250 milliseconds", delay: str = "1 hour") -> DataFrame:
    """key, start, n, last: what learning.debounced gives, as a stream (append mode): a burst is put out, and its state dropped, once no event can join it."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    found = timed.groupBy(key, F.session_window(ts, pause).alias("w")).agg(F.count(key).alias("n"), F.max_by("event_id", F.struct(ts, "event_id")).alias("last"))
    # By the count, not by the key: a filter on the key would stand before the watermark, and rows without a key move time on.
    return found.where("n > 0").select(key, F.col("w.start").alias("start"), "n", "last")


def followed(first: DataFrame, second: DataFrame, key: str, within: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """key, first_id, second_id: each event of first with those of second that come within so long after it. Both sides' rows are kept only as long as time allows a partner."""
    a = first.select(F.col(key).alias("__a"), F.col("event_id").alias("first_id"), F.col(ts).cast("timestamp").alias("__from")).withWatermark("__from", delay)
    b = second.select(F.col(key).alias("__b"), F.col("event_id").alias("second_id"), F.col(ts).cast("timestamp").alias("__to")).withWatermark("__to", delay)
    met = a.join(b, (F.col("__a") == F.col("__b")) & (F.col("__to") >= F.col("__from")) & (F.col("__to") <= F.col("__from") + F.expr(f"INTERVAL {within}")))
    return met.select(F.col("__a").alias(key), "first_id", "second_id")


def split_late(stream: DataFrame, delay: datetime.timedelta, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows of a stream that is read to its end, both with their batch. A row is late if it is older than the latest of all earlier batches less the delay: those that a
    watermark of that delay drops without a word. Each batch's tables are written by its number, so a batch that is done twice is there once."""
    spark, folder, check = stream.sparkSession, shared_folder(stream.sparkSession, "late"), shared_folder(stream.sparkSession, "late-state")
    seen_schema = T.StructType([T.StructField("latest", T.TimestampType()), T.StructField("batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        latest = None
        if number:
            seen = spark.read.schema(seen_schema).option("basePath", f"{folder}/seen").parquet(f"{folder}/seen/batch=*")
            latest = seen.where(F.col("batch") < number).agg(F.max("latest").alias("latest")).first()["latest"]
        time = F.col(ts).cast("timestamp")
        late = F.coalesce(time < F.lit(latest - delay), F.lit(False)) if latest else F.lit(False)
        batch.agg(F.max(time).alias("latest")).write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{folder}/rows/batch={number}")

    _run(stream, "append", check, write)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("late", T.BooleanType()), T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
    return rows.where(~F.col("late")).drop("late"), rows.where("late").drop("late")
