"""Books taken in as files arrive: a stream of files, a batch of tables for each of its batches, and publishing as the last step.

    rows/batch=n, titles/batch=n, tasks/batch=n    what batch n has read; written again, whole, if the batch is done again
    published/batch=n                              written last; readers see no batch without it
    claims/task                                    who works on a task; made once, however many ask

A run that dies is started again with the same store: the stream's own log gives the unfinished batch the same files and the same number, so each
file's book is there once. A stream takes a path once, so a new version of name.txt comes as name.v2.txt and so on; readers see the highest one that is published.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import structure
from lectern.operators.joins import cut
from lectern.sources import files

RAW = "path string, modificationTime timestamp, length bigint, content binary"
TABLES = ("rows", "titles", "tasks")
#: What a file's name has before its suffix if it is a further version.
VERSION = r"\.v([0-9]{1,6})(\.[^./]+)$"


def incoming(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    """The files below a folder as a stream, so many in a batch."""
    return spark.readStream.schema(RAW).format("binaryFile").option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)


def publish(spark: SparkSession, store: str, number: int) -> None:
    spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").json(f"{store}/published/batch={number}")


def taken_in(store: str, dialect: str = "a", published: Callable[[SparkSession, str, int], None] = publish, long_texts: bool = False) -> Callable[[DataFrame, int], None]:
    """What a batch of files (path, length) does. Texts are read in splits of their files, other formats file by file."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = files.format_of(F.col("path"), F.lit(""))
        named = batch.withColumn("book", F.regexp_replace("path", VERSION, "$2")).withColumn("version", F.coalesce(F.nullif(F.regexp_extract("path", VERSION, 1), F.lit("")).cast("int"), F.lit(1)))
        last = named.groupBy("book").agg(F.max("version").alias("version"))
        found = cut(named.join(last, ["book", "version"], "left_semi").select("path", "book", "version", "length", kind.alias("format"), files.upload_status(F.col("length"), kind, long_texts).alias("status")))
        # A batch has no more files than the stream takes at once.
        there = [(r["path"], r["format"], r["status"] == "ok", r["length"] > files.MOST_UPLOAD_BYTES) for r in found.collect()]
        texts, docx = ([p for p, fmt, ok, _ in there if fmt == of and ok] for of in ("text", "docx"))
        whole, lines = [p for p, _, _, long in there if not long], f"{store}/lines/batch={number}"
        held = _contents(spark, docx).join(F.broadcast(found), "path").select(F.col("book").alias("path"), "format", "status", "content")
        renamed = F.broadcast(found.select("path", "book"))
        read = files.text_lines(spark, texts, lines).withColumnRenamed("book", "path").join(renamed, "path").select("book", "pos", "raw") if texts else spark.createDataFrame([], "book string, pos int, raw string")
        files.books(held, dialect, structure.outline_rows(read, dialect))[1].write.mode("overwrite").parquet(f"{store}/rows/batch={number}")
        rows = spark.read.parquet(f"{store}/rows/batch={number}")
        of_texts = rows.join(F.broadcast(found.where("format = 'text'").select("book")), "book", "left_semi")
        files.books(held, dialect, of_texts)[0].write.mode("overwrite").parquet(f"{store}/titles/batch={number}")
        counted = rows.groupBy("book").agg(F.count(F.lit(1)).alias("rows"))
        digests = _contents(spark, whole).select("path", F.sha2("content", 256).alias("digest"))
        tasks = found.join(F.broadcast(digests), "path", "left").join(counted, "book", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
        if len(whole) < len(there):
            # A long text is told by the sum of its lines' hashes: its bytes are in no single row.
            summed = read.groupBy("book").agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)), F.sum(F.xxhash64("pos", "raw").cast("decimal(38,0)"))), 256).alias("summed"))
            tasks = tasks.join(summed, "book", "left").withColumn("digest", F.coalesce("digest", "summed"))
        tasks = tasks.select("book", "version", "format", "status", "digest", "rows")
        # A file that should have given rows and has none couldn't be read.
        tasks = tasks.withColumn("status", F.when((F.col("status") == "ok") & (F.col("rows") == 0), "unreadable").otherwise(F.col("status")))
        tasks.write.mode("overwrite").parquet(f"{store}/tasks/batch={number}")
        published(spark, store, number)
        _removed(spark, lines)

    return write


def _contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content of files."""
    if not paths:
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").load(files.literal(paths)).select("path", "content")


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ingest(spark: SparkSession, folder: str, store: str, per_batch: int = 64, dialect: str = "a", published: Callable[[SparkSession, str, int], None] = publish, long_texts: bool = False) -> None:
    """Take in all files that are below the folder now and weren't taken in before. The store's folder also has the stream's log. long_texts: text files of over MOST_UPLOAD_BYTES too."""
    stream = incoming(spark, folder, per_batch).select("path", "length").writeStream.option("checkpointLocation", f"{store}/log").trigger(availableNow=True)
    stream.foreachBatch(taken_in(store, dialect, published, long_texts)).start().awaitTermination()


def current(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table (of TABLES) of what is published: of each book the last version."""
    shown = spark.read.option("basePath", f"{store}/published").json(f"{store}/published/batch=*").select("batch").distinct()
    tasks = spark.read.option("basePath", f"{store}/tasks").parquet(f"{store}/tasks/batch=*").join(shown, "batch", "left_semi")
    last = tasks.groupBy("book").agg(F.max_by("batch", F.struct("version", "batch")).alias("batch"))
    rows = spark.read.option("basePath", f"{store}/{name}").parquet(f"{store}/{name}/batch=*")
    return rows.join(last, ["book", "batch"], "left_semi").drop("batch")


def claim(spark: SparkSession, store: str, task: str, worker: str) -> bool:
    """Whether the task is this worker's: the first to ask has it. A task is named by letters, digits, '.', '_' and '-' alone, so that no name leads out of the folder."""
    if not task or task.strip(".") == "" or any(not (c.isalnum() or c in "._-") for c in task):
        raise ValueError(f"no task's name: {task!r}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/claims/{task}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = fs.create(path, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception.getClass()) or "already exists" in str(e.java_exception):
            return False
        raise
    out.write(bytearray(worker.encode()))
    out.close()
    return True


def release(spark: SparkSession, store: str, task: str) -> None:
    """Give a task free again: its worker is gone."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/claims/{task}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)
