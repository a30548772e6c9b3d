"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text's paragraphs are its lines; a long paragraph counts as runs of WORDS words. Each is hashed to a wide vector, and a
fingerprint is the sum of the vectors modulo powers of two (2**64 and 2**32), lane by lane. So the order of paragraphs is of no account, and
paragraphs are inserted or deleted by adding or subtracting their vectors (add, remove).

A vector has two parts. EXACT lanes of 64 bits are uniform: equal multisets give equal sums, others differ but for
chance. LOOSE lanes of 32 bits are +1 or -1: the inner product of two sums estimates how many paragraphs are shared, and
with the lengths the likeness (cosine of the multisets, with a standard error of 1 / sqrt(LOOSE) at most). No text that Spark
can hold has 2**31 paragraphs, so these lanes do not wrap.

Defined results: rows without a doc_id come last, and where no row has one the last is followed by the empty text; null text is the empty text, whose fingerprint is the zero vector; two empty texts are wholly like (1), an
empty and another text not at all (0); texts with the same lines in another order have equal fingerprints; repeated rows have equal
fingerprints; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Lanes modulo 2**64 that tell multisets apart.
EXACT = 16
#: Lanes modulo 2**32 that estimate likeness.
LOOSE = 256
#: Words of a run into which a paragraph is cut.
WORDS = 6
#: Rows of one bucket when documents are put in order, about, and the most buckets; with more rows the buckets grow. They are read as streams.
BUCKET_ROWS = 250
MOST_BUCKETS = 20_000
_BYTES = 8 * EXACT + LOOSE // 8

Sum = tuple[np.ndarray, np.ndarray]

_RUN = re.compile(r"\S+(?:[^\S\n]+\S+){0,%d}" % (WORDS - 1))


def paragraphs(text: str) -> Counter:
    """The multiset of runs of at most WORDS words that never cross a line's end."""
    return Counter(_RUN.findall(text))


def zero() -> Sum:
    return np.zeros(EXACT, dtype=np.uint64), np.zeros(LOOSE, dtype=np.int32)


def add(total: Sum, parts: Counter, sign: int = 1) -> Sum:
    """total with the paragraphs put in (sign 1) or taken out (sign -1)."""
    if not parts:
        return total
    raw = np.frombuffer(b"".join(hashlib.shake_128(p.encode("utf-8", "surrogatepass")).digest(_BYTES) for p in parts), dtype=np.uint8).reshape(len(parts), _BYTES)
    times = np.fromiter(parts.values(), dtype=np.int64, count=len(parts)) * sign
    exact = np.ascontiguousarray(raw[:, : 8 * EXACT]).view("<u8")
    plain = bool((np.abs(times) == 1).all() and sign == times[0])
    exact = exact.sum(axis=0, dtype=np.uint64) if plain else (exact * times.astype(np.uint64)[:, None]).sum(axis=0, dtype=np.uint64)
    bits = np.unpackbits(raw[:, 8 * EXACT :], axis=1)
    ones = bits.sum(axis=0, dtype=np.int64) * sign if plain else times @ bits
    loose = 2 * ones - times.sum()
    exact = total[0] - exact if plain and sign < 0 else total[0] + exact
    return exact, (total[1].astype(np.int64) + loose).astype(np.int32)


def remove(total: Sum, parts: Counter) -> Sum:
    return add(total, parts, -1)


def likeness(a: Sum, b: Sum) -> float:
    """Estimated cosine of the multisets, from 0 to 1; 1 for equal fingerprints."""
    if np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1]):
        return 1.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    size = float(np.sqrt((x @ x) * (y @ y)))
    return min(1.0, max(0.0, float(x @ y) / size)) if size else 0.0


def written(total: Sum) -> str:
    return base64.b64encode(total[0].astype("<u8").tobytes() + total[1].astype("<i4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """The last half of text replaced by as many first code points of the following text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) dealt out by ascending doc_id to buckets: columns bucket, guest, doc_id, text. The first row of
    each bucket also is a guest at the end of the bucket before (of the last one for the first), so every row meets the one that follows it."""
    buckets = min(MOST_BUCKETS, max(1, -(-docs.where(F.col("doc_id").isNotNull()).count() // BUCKET_ROWS)))
    # Bounds are quantiles of the ids, MOST_BUCKETS at most.
    bounds = docs.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10 * buckets).alias("b")).first()["b"] if buckets > 1 else []
    bounds = np.array(sorted(set(bounds or [])), dtype=np.int64)

    @F.pandas_udf("long")
    def bucket_of(ids):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, ids.fillna(np.iinfo(np.int64).max).to_numpy(dtype=np.int64), side="right"))

    homes = docs.withColumn("bucket", bucket_of("doc_id"))
    firsts = homes.select("bucket", "doc_id").groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    if not firsts:
        return homes.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    # One row for each bucket, so MOST_BUCKETS at most: the row that follows a bucket's last row.
    before = [(firsts[k - 1]["bucket"], firsts[k]["doc_id"]) for k in range(len(firsts))]
    ends = docs.sparkSession.createDataFrame(before, "bucket long, doc_id long")
    guests = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ends), "doc_id").groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
    return homes.select("bucket", F.lit(False).alias("guest"), "doc_id", "text").unionByName(guests.select("bucket", F.lit(True).alias("guest"), "doc_id", "text"))


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Documents are shuffled once, by ranges of doc_id. The edited text's fingerprint is had from the text's by removing and inserting paragraphs."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = in_order(plain)
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, int, str]]:
        for batch in batches:
            yield from zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True)

    def one(doc_id: int, text: str, parts: Counter, total: Sum, following: tuple[str, Sum]) -> list:
        new = edited(text, following[0])
        now = paragraphs(new)
        other = remove(add(total, now - parts), parts - now)
        return [doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), written(total), written(other), likeness(total, other), likeness(total, following[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        last: tuple | None = None
        for bucket, guest, doc_id, text in rows(batches):
            parts = paragraphs(text)
            total = add(zero(), parts)
            if last:
                out.append(one(*last[1:], (text, total) if last[0] == bucket else ("", zero())))
            last = None if guest else (bucket, doc_id, text, parts, total)
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if last:  # only without any doc_id
            out.append(one(*last[1:], ("", zero())))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return ordered.mapInArrow(run, _OUT).withColumnRenamed("doc_id", id_col)
