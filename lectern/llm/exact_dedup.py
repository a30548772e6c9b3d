"""Exact deduplication by a heavy-hitter split, in DataFrame and SQL functions only.

A Misra-Gries sketch (Spark's approx_top_k family, a frequent-items sketch merged as a tree) names the
digests that may hold a large share of the rows. Their exact counts and winners are computed and broadcast, so
that copies of frequent texts are resolved on the map side; every other digest is rare and is
shuffled in the ordinary way.

Defined results: a null text counts as the empty text; a null doc_id sorts after all others; of rows with the
same doc_id and text exactly one is kept; an empty table gives an empty table; further columns are
ignored by classes() and kept by dedupe().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut, small

#: Counters of the sketch. A text held by more than about 1.4 / SKETCH_SIZE of the rows is always found.
SKETCH_SIZE = 8192
#: A digest is frequent from this share of the rows on; at most 1 / FREQUENT_SHARE digests can be, which bounds the broadcast.
FREQUENT_SHARE = 0.001
#: Groups in which partial sketches are merged before the last merge.
MERGE_WIDTH = 64

_SPACE = "[\\x20\\x09-\\x0D]+"


def normalized(text: Column) -> Column:
    """The text with every run of white space replaced by one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, " ")


def digest_of(text: Column) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def frequent_digests(rows: DataFrame) -> DataFrame:
    """(digest) of all digests that may hold FREQUENT_SHARE of the rows; at most 1 / FREQUENT_SHARE of them after verification."""
    partial = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGE_WIDTH)).alias("part")).agg(F.expr(f"approx_top_k_accumulate(digest, {SKETCH_SIZE})").alias("sketch"))
    # Grouped by a constant: without groups, a partition without rows would hand an undefined sketch to the merge.
    merged = partial.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {SKETCH_SIZE})").alias("sketch"))
    most = int(2 / FREQUENT_SHARE)
    return merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {most})")).alias("item")).select(F.col("item.item").alias("digest"))


def winners(rows: DataFrame, total: int) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of the frequent digests, verified by exact counts. rows: doc_id, row, digest."""
    counted = (
        rows.join(F.broadcast(frequent_digests(rows)), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    )
    return counted.where(F.col("group_size") >= F.lit(max(2.0, FREQUENT_SHARE * total))).select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    won = cut(winners(rows, rows.count()))
    frequent = rows.join(F.broadcast(won), "digest").withColumn("kept", F.col("row") == F.col("keep_row"))
    # A group is summed up before it is shuffled, and met by a join, whose large partitions Spark may split.
    rest = rows.join(F.broadcast(won.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    rare = rest.join(groups, "digest").select("digest", "doc_id", "row", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"))
    out = [F.col("doc_id").alias(id_col), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")]
    return frequent.select(*out).unionByName(rare.select(*out))


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without later copies, all columns kept. Of rows that share id and normalised text, the one whose text comes first in code-point order stays.

    What goes is decided on rows of id and digest alone (see classes), and met by these two, so no group of copies is brought together with its texts."""
    names, keys = docs.columns, ["__id", "__digest"]
    thin = classes(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__digest"), F.col("keep_id").alias("__keep"))
    # Of an id and a digest: gone, or the one that stays, of which there may be several rows.
    judged = thin.groupBy(*keys).agg((~F.first("__id").eqNullSafe(F.first("__keep"))).alias("__gone"), F.count(F.lit(1)).alias("__rows"))
    marked = cut(judged.where(F.col("__gone") | (F.col("__rows") > 1)).select(*[F.col(k).alias(f"{k}2") for k in keys], "__gone"))
    tagged = docs.withColumn("__id", F.col(id_col)).withColumn("__digest", digest_of(F.col(text_col)))
    met = tagged.join(small(marked), F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__digest") == F.col("__digest2")), "left")
    alone = met.where(F.col("__gone").isNull()).select(*names)
    if not marked.where(~F.col("__gone")).limit(1).count():
        return alone
    # Rows of the same id and text: summed up before they are shuffled.
    again = met.where(~F.col("__gone")).groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{n}`") for n in names]), F.coalesce(F.col(text_col), F.lit(""))).alias("row"))
    return alone.unionByName(again.select("row.*"))
