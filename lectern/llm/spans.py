"""Spans in texts: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import bisect
import hashlib
import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import pieces

Span = tuple[str, int, int]


def joined(spans: Sequence[Span], kinds: Sequence[str]) -> str:
    """kind:start:end by start, then kind in the order of kinds, comma-joined."""
    place = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], place[x[0]], x[2])))


class Taken:
    """What some spans cover; asked in time logarithmic in their number."""

    def __init__(self, spans: Sequence[Span]) -> None:
        ordered = sorted((s, e) for _, s, e in spans)
        self.starts = [s for s, _ in ordered]
        self.ends = list(itertools.accumulate((e for _, e in ordered), max))

    def overlaps(self, start: int, end: int) -> bool:
        before = bisect.bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def scan(docs: DataFrame, id_col: str, text_col: str, counted: Sequence[str], kinds: Sequence[str], finder: Callable[[list[str]], list[tuple[list[Span], list[Span]]]]) -> DataFrame:
    """doc_id, n_<kind> of the base spans for each counted kind, base_sha256, spans, n_spans. finder gives (base, further) spans of each text."""
    names = ["doc_id", *[f"n_{k}" for k in counted], "base_sha256", "spans", "n_spans"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in names[1:-3]], *[T.StructField(n, T.StringType()) for n in names[-3:-1]], T.StructField(names[-1], T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch):
                found = finder([t or "" for t in texts])
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in counted]
                digests = [hashlib.sha256(joined(base, kinds).encode()).hexdigest() for base, _ in found]
                every = [joined([*base, *more], kinds) for base, more in found]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array(every, pa.string()), pa.array([len(base) + len(more) for base, more in found], pa.int64())], names)

    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)
