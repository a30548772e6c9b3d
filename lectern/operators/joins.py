"""Joins that the other operators are made of."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; beyond, the join is left to the optimizer.
MOST_BROADCAST = 100_000


def small(side: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """side with a broadcast hint if it has at most so many rows (which are counted, up to there)."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that is unset and all runs in one process, as in tests) one of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """The name of a fresh folder below the shared one."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that several uses read it once and no lost executor takes it away."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def attached(rows: DataFrame, side: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows with the other columns of side, which has at most one row a key; nulls of a key are equal, rows without a match get nulls."""
    named = side.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(on)], *[c for c in side.columns if c not in on])
    same = F.lit(True)
    for i, k in enumerate(on):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return rows.join(named, same, "left").drop(*[f"__key{i}" for i in range(len(on))])


def left_total(parents: DataFrame, children: DataFrame, on: Column, by: Sequence[str], amount: Column, name: str) -> DataFrame:
    """parents with the sum of amount over children that satisfy on; 0 where there is none."""
    return parents.join(children, on, "left").groupBy(*by).agg(F.coalesce(F.sum(amount), F.lit(0)).alias(name))


def latest(changes: DataFrame, key: Sequence[str], order: Sequence[str], deleted: str | None = None) -> DataFrame:
    """A change log's last row of each key; keys whose last row is a deletion are gone."""
    columns = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*key, "row.*")
    return last.where(~F.col(deleted)).drop(deleted) if deleted else last


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def first_rows(rows: DataFrame, k: int, group: Sequence[str], order: Sequence[str | Column], name: str = "nth") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)
