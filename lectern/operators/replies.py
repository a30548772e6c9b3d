"""Model replies that are kept by what they answer: a key is the digest of model, prompt and material, so nothing is asked twice, in whatever session,
and a changed paragraph asks anew by itself.

    replies/batch=n   key, model, reply: appended by each call, good replies only

A key's first reply counts. Replies are deterministic for the caller from then on. A failed request has no row and is asked again next time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.concepts import with_model
from lectern.operators.joins import cut

SCHEMA = "key string, model string, reply string, at timestamp, batch string"


def key_of(model: str, *parts: Column) -> Column:
    """Digest of the model's name and of the parts of a request, each with its length, so that no two requests run together."""
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(part, F.lit("")) for part in (F.lit(model), *parts))]
    return F.sha2(F.concat(*sized), 256)


class Replies:
    """The replies below a folder that driver and executors share. Several writers may append at once: each batch is a folder of its own."""

    def __init__(self, spark: SparkSession, folder: str, model: str) -> None:
        self.spark, self.folder, self.model = spark, folder.rstrip("/"), model

    def kept(self) -> DataFrame:
        """key, reply: of each key the first that was kept."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/replies")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], "key string, reply string")
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/replies")
        return rows.groupBy("key").agg(F.min_by("reply", F.struct("at", "batch")).alias("reply"))

    def _append(self, rows: DataFrame) -> DataFrame:
        """rows (key, reply) written and read again: what they came from is asked once, however often the result is used."""
        batch = f"{self.folder}/replies/batch={uuid.uuid4().hex}"
        rows.select("key", F.lit(self.model).alias("model"), "reply", F.current_timestamp().alias("at")).write.parquet(batch)
        return self.spark.read.schema("key string, reply string").parquet(batch)

    def answered(self, rows: DataFrame, prompt: str, make_client: Callable, material: Sequence[str] = (), shorter: Callable[[Column], Column] | None = None, good: Callable[[Column], Column] | None = None, reply: str = "reply") -> DataFrame:  # noqa: PLR0913
        """rows with reply_key and reply: kept ones, and those of the client for requests that no kept reply answers; each different request is asked once.

        prompt: the column that is asked; material: further columns that the key is made of. shorter: what is asked instead if the client fails or good (a condition on the reply,
        by default that it isn't null) doesn't hold. Its reply is kept for the whole request. What fails again has a null reply, which isn't kept; so has a null prompt, which isn't asked."""
        if "reply_key" in rows.columns or reply in rows.columns:
            raise ValueError("rows have a column of the name of what is added")
        accepted = good or (lambda r: r.isNotNull())
        keyed = rows.withColumn("reply_key", key_of(self.model, F.col(prompt), *[F.col(m).cast("string") for m in material]))
        asked = cut(keyed.select(F.col("reply_key").alias("key"), F.col(prompt).alias("__prompt")).where(F.col("__prompt").isNotNull()).dropDuplicates(["key"]).join(self.kept(), "key", "left_anti"))
        if asked.limit(1).count():
            first = self._append(self._good(with_model(asked, "__prompt", make_client, "reply"), accepted))
            left = asked.join(first, "key", "left_anti")
            if shorter and left.limit(1).count():
                self._append(self._good(with_model(left.withColumn("__prompt", shorter(F.col("__prompt"))), "__prompt", make_client, "reply"), accepted))
        return keyed.join(self.kept().select(F.col("key").alias("reply_key"), F.col("reply").alias(reply)), "reply_key", "left")

    @staticmethod
    def _good(rows: DataFrame, accepted: Callable[[Column], Column]) -> DataFrame:
        return rows.where(F.coalesce(F.col("reply").isNotNull() & accepted(F.col("reply")), F.lit(False)))

    def forget(self, keys: DataFrame) -> None:
        """Drop the replies of keys (key), for good: what stays is written as one batch, and only then the old batches go."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/replies")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return
        old = [entry.getPath() for entry in fs.listStatus(root)]
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/replies")
        rows.join(keys.select("key").distinct(), "key", "left_anti").drop("batch").write.parquet(f"{self.folder}/replies/batch={uuid.uuid4().hex}")
        for path in old:
            fs.delete(path, True)
