"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most characters of text that one numpy step holds at once; bounds a Python worker's memory whatever the Arrow batch size.
STEP_CHARS = 2_000_000
#: Rows of a narrow table in one file of the shared folder, where their number is known beforehand. Each file costs calls to the store.
FILE_ROWS = 200_000
#: Tasks that write a table which would be fewer files by that measure.
FEW_TASKS = 12

_SPACE = re.compile("[\x20\x09-\x0d]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that is unset and all runs in one process, as in tests) a folder of our own."""
    context = spark.sparkContext
    set_by_session = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if set_by_session:
        return set_by_session.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-checkpoint-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def cut(df: DataFrame, most_rows: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """df, materialised once in the shared folder, so that it is neither computed again nor lost with an executor.
    most_rows: what df and what its last stage reads have at most, if that is known; it is then written as one file for each file_rows, but by FEW_TASKS tasks if so many can run at once."""
    shared_dir(df.sparkSession)
    tasks = min(FEW_TASKS, df.sparkSession.sparkContext.defaultParallelism)
    return (df if most_rows is None else df.coalesce(max(tasks, -(-most_rows // file_rows)))).checkpoint(eager=True)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives back what Arrow has kept for reuse once a task is done: Python workers wait for further tasks, and would hold it meanwhile."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return released


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared one, removed when the application ends."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def small(side: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """side (a cut table of narrow rows) with a broadcast hint if it has at most so many rows; beyond, the join is a shuffle."""
    return F.broadcast(side) if side.limit(most_rows + 1).count() <= most_rows else side


def fold(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def sample_rank(*columns: str) -> Column:
    """A uniform number from 0 to 1 that depends on the columns' values only, so that reruns sample alike."""
    return (F.xxhash64(*[F.col(c) for c in columns]).bitwiseAND(F.lit((1 << 52) - 1))).cast("double") / F.lit(float(1 << 52))


def slices(text: str, most_chars: int = STEP_CHARS) -> Iterator[str]:
    """The text in parts of about most_chars characters, cut before white space (so a word is never cut, however long it is)."""
    start = 0
    while len(text) - start > most_chars and (found := _SPACE.search(text, start + most_chars)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def pieces(batch: pa.RecordBatch, column: str = "text", most_chars: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """The batch in slices of at most about most_chars characters (one row at least), each with its texts."""
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if at > start and held + size > most_chars:
            yield batch.slice(start, at - start), texts.slice(start, at - start).to_pylist()
            start, held = at, 0
        held += size
    if sizes:
        yield batch.slice(start), texts.slice(start).to_pylist()
