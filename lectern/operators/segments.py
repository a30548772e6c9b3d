"""An inverted index that grows: immutable segments, deletions by mark, merges, and published versions.

    postings/segment=s/bucket=b   term, book, doc_id, tf, dl: sorted by term in each file; a file is what one task has read, so a frequent term or a large book lies in many
    docs/segment=s                book, doc_id, dl, digest of each document
    gone/segment=s                of, book, doc_id, dl, digest: documents of the older segment `of` that this one replaces or deletes
    sums/segment=s                book, n, tokens, mark: what the segment adds to (and, below 0, takes from) each book
    versions/v=n                  the segments that count; written last, so a change that dies before is not seen

A change writes one segment, whatever the index's size, and reads of the old ones only the ids of the documents that it names. A search
reads the postings of its terms' buckets, leaves out marked documents, and has corpus statistics from `sums`, a row a book and segment.
Small segments are merged as soon as they are no longer much smaller than what came after them, so their number grows with the logarithm of the
index. One writer at a time; readers keep the version they opened.

A book is fresh if its number of documents and the sum of their digests are those of the index; only the documents of stale books are
compared one by one.

Defined results: a null text has no terms; ids must be unique in a change (else ValueError) and are compared with nulls equal; a
change without rows publishes nothing; scores are those of index.scores on the documents that are in.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators import search
from lectern.operators.index import idf, posed, term_score
from lectern.operators.joins import cut, small

#: Folders that a segment's postings are dealt to by their terms' hashes. A search opens those of its terms only.
BUCKETS = 16
#: A segment is merged with those after it once it has fewer documents than so many times theirs.
GROWTH = 3


def digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mark(digests: Column) -> Column:
    """Sum of digests: the same in any order, and new digests can be added or taken away."""
    return F.coalesce(F.sum(digests.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)")


class SegmentedIndex:
    """The index below a folder that driver and executors share. book and doc_id: columns of documents and of the results."""

    def __init__(self, spark: SparkSession, folder: str, book: str = "book", doc_id: str = "doc_id", text: str = "text", tokenize=X.tokens, buckets: int = BUCKETS) -> None:  # noqa: ANN001
        self.spark, self.folder, self.book, self.doc_id, self.text, self.tokenize, self.buckets = spark, folder.rstrip("/"), book, doc_id, text, tokenize, buckets
        self.version, self.segments = self._newest()

    # What is published

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def _newest(self) -> tuple[int, list[dict]]:
        """(number, segments from the oldest on) of the last version; a version has a row for each segment and one without."""
        if not self._exists(f"{self.folder}/versions"):
            return 0, []
        rows = self.spark.read.schema("v int, segment string, place int, docs long").option("basePath", f"{self.folder}/versions").json(f"{self.folder}/versions/v=*")
        last = rows.agg(F.max("v").alias("v")).first()["v"]
        if last is None:
            return 0, []
        held = rows.where((F.col("v") == last) & F.col("segment").isNotNull()).orderBy("place").collect()
        return last, [{"segment": r["segment"], "docs": r["docs"]} for r in held]

    def _publish(self, segments: list[dict]) -> None:
        rows = [(None, -1, 0), *[(s["segment"], i, s["docs"]) for i, s in enumerate(segments)]]
        self.spark.createDataFrame(rows, "segment string, place int, docs long").coalesce(1).write.mode("error").json(f"{self.folder}/versions/v={self.version + 1}")
        self.version, self.segments = self.version + 1, segments

    def _read(self, name: str, of: Sequence[str] | None = None) -> DataFrame | None:
        """A table of the segments named (all that count); null if there are none."""
        names = [s["segment"] for s in self.segments] if of is None else of
        if not names:
            return None
        root = f"{self.folder}/{name}"
        return self.spark.read.option("basePath", root).parquet(*[f"{root}/segment={s}" for s in names])

    def _write(self, rows: DataFrame, name: str, segment: str, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{name}/segment={segment}")

    # Documents

    def _same(self, a: str, b: str) -> Column:
        return F.col(f"{a}.{self.book}").eqNullSafe(F.col(f"{b}.{self.book}")) & F.col(f"{a}.{self.doc_id}").eqNullSafe(F.col(f"{b}.{self.doc_id}"))

    def live(self) -> DataFrame | None:
        """segment, book, doc_id, dl, digest of the documents that are in."""
        docs = self._read("docs")
        if docs is None:
            return None
        gone = self._read("gone").select(F.col("of"), self.book, self.doc_id)
        return docs.alias("d").join(gone.alias("g"), self._same("d", "g") & (F.col("d.segment") == F.col("g.of")), "left_anti")

    def books(self) -> DataFrame | None:
        """book, n, tokens, mark of the documents that are in."""
        sums = self._read("sums")
        return None if sums is None else sums.groupBy(self.book).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum("mark").cast("decimal(38,0)").alias("mark")).where("n > 0")

    def change(self, added: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Put documents in (in place of those with the same book and id) and take others (book, doc_id) out, in one version."""
        segment, keys = uuid.uuid4().hex, [self.book, self.doc_id]
        named, docs = [], None
        if added is not None:
            tokens = self.tokenize(F.col(self.text))
            rows = added.select(*keys, digest(F.col(self.text)).alias("digest"), F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens")).withColumn("dl", F.size("tokens").cast("long"))
            self._postings(self._terms(rows.select(*keys, "dl", "tokens")), segment)
            self._write(rows.select(*keys, "dl", "digest"), "docs", segment)
            docs = self._read("docs", [segment])
            if docs.groupBy(*keys).count().where("count > 1").limit(1).count():
                raise ValueError("a change names a document twice")
            named.append(docs.select(*keys))
        if deleted is not None:
            named.append(deleted.select(*keys).distinct())
        if not named:
            return
        touched = named[0] if len(named) == 1 else named[0].union(named[1]).distinct()
        live = self.live()
        schema = f"of string, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in touched.schema.fields)}, dl long, digest long"
        gone = self.spark.createDataFrame([], schema) if live is None else live.alias("d").join(touched.alias("t"), self._same("d", "t"), "left_semi").select(F.col("segment").alias("of"), *keys, "dl", "digest")
        self._seal(segment, docs, gone, [s for s in self.segments])

    def _terms(self, rows: DataFrame) -> DataFrame:
        """term, book, doc_id, dl, tf of documents (book, doc_id, dl, tokens), which a change names once each: counted where they are, without a shuffle."""
        keys = [f.name for f in rows.schema.fields if f.name != "tokens"]
        schema = T.StructType([T.StructField("term", T.StringType()), *[f for f in rows.schema.fields if f.name != "tokens"], T.StructField("tf", T.LongType())])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (whole.slice(at, 512) for whole in batches for at in range(0, len(whole), 512)):
                tokens = batch.column(batch.schema.get_field_index("tokens"))
                words = tokens.flatten().dictionary_encode()
                row = np.repeat(np.arange(len(batch)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                pairs, n = np.unique(row * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row, term = np.divmod(pairs, max(len(words.dictionary), 1))
                told = batch.select(keys).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term)), *[told.column(told.schema.get_field_index(f.name)) for f in schema.fields[1:-1]], pa.array(n, pa.int64())], names=schema.names)

        return rows.mapInArrow(count, schema)

    def _postings(self, terms: DataFrame, segment: str) -> None:
        """term, book, doc_id, dl, tf by bucket, sorted by (bucket, term, book, id) within a task. A frequent term lies in as many files as tasks have met it; nothing is shuffled."""
        dealt = terms.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        self._write(dealt.sortWithinPartitions("bucket", "term", self.book, self.doc_id), "postings", segment, "bucket")

    def _seal(self, segment: str, docs: DataFrame | None, gone: DataFrame, older: list[dict]) -> None:
        """Write what is left of a segment, and publish it behind the older ones; one without any row is dropped."""
        self._write(gone, "gone", segment)
        gone = self._read("gone", [segment])
        if docs is None:
            self._write(gone.select(self.book, self.doc_id, "dl", "digest").limit(0), "docs", segment)
            self._postings(gone.select(F.lit("").alias("term"), self.book, self.doc_id, "dl", F.lit(1).cast("long").alias("tf")).limit(0), segment)
            docs = self._read("docs", [segment])
        signed = docs.select(self.book, F.lit(1).alias("sign"), "dl", "digest").union(gone.select(self.book, F.lit(-1), "dl", "digest"))
        sums = signed.groupBy(self.book).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("tokens"), mark(F.col("sign") * F.col("digest").cast("decimal(20,0)")).alias("mark"))
        self._write(sums, "sums", segment)
        n = docs.count()
        if n or gone.limit(1).count():
            self._publish([*older, {"segment": segment, "docs": n}])

    # Upkeep

    def merge(self, growth: int = GROWTH) -> int:
        """Merge the newest segments with each older one that has fewer than growth times their documents; how many were merged."""
        at, total = len(self.segments), 0
        while at and (at == len(self.segments) or self.segments[at - 1]["docs"] < growth * max(total, 1)):
            at -= 1
            total += self.segments[at]["docs"]
        old, few = self.segments[:at], [s["segment"] for s in self.segments[at:]]
        if len(few) < 2:
            return 0
        segment, keys = uuid.uuid4().hex, [self.book, self.doc_id]
        gone = self._read("gone", few)
        inner, outer = gone.where(F.col("of").isin(few)), gone.where(~F.col("of").isin(few))
        out = small(cut(inner.select("of", *keys)))
        kept = [self._read(name, few).alias("d").join(out.alias("g"), self._same("d", "g") & (F.col("d.segment") == F.col("g.of")), "left_anti") for name in ("postings", "docs")]
        self._postings(kept[0].drop("segment", "bucket"), segment)
        self._write(kept[1].drop("segment"), "docs", segment)
        self._seal(segment, self._read("docs", [segment]), outer.drop("segment"), old)
        return len(few)

    def stale(self, docs: DataFrame) -> DataFrame:
        """book, held, now (numbers of documents; null where the book isn't there) of the books whose documents are no longer those of the index."""
        now = docs.groupBy(self.book).agg(F.count(F.lit(1)).alias("now"), mark(digest(F.col(self.text))).alias("mark_now"))
        held = self.books()
        if held is None:
            return now.select(self.book, F.lit(None).cast("long").alias("held"), "now")
        both = now.alias("a").join(held.alias("b"), F.col(f"a.{self.book}").eqNullSafe(F.col(f"b.{self.book}")), "full")
        name = F.when(F.col("now").isNotNull(), F.col(f"a.{self.book}")).otherwise(F.col(f"b.{self.book}")).alias(self.book)
        return both.where(~(F.col("n").eqNullSafe(F.col("now")) & F.col("mark").eqNullSafe(F.col("mark_now")))).select(name, F.col("n").alias("held"), "now")

    def refresh(self, docs: DataFrame) -> bool:
        """Make the index that of docs: in stale books, documents that are new or changed are put in, those that are no more taken out. Whether there was anything to do."""
        books = cut(self.stale(docs).select(self.book))
        if not books.limit(1).count():
            return False
        of_stale = lambda rows: rows.alias("d").join(small(books).alias("s"), F.col(f"d.{self.book}").eqNullSafe(F.col(f"s.{self.book}")), "left_semi")
        now = of_stale(docs)
        live = self.live()
        if live is None:
            self.change(now)
            return True
        held = of_stale(live)
        here = now.select(self.book, self.doc_id, digest(F.col(self.text)).alias("digest"))
        changed = now.withColumn("__digest", digest(F.col(self.text))).alias("n").join(held.alias("h"), self._same("n", "h") & (F.col("n.__digest") == F.col("h.digest")), "left_anti").drop("__digest")
        self.change(changed, held.alias("h").join(here.alias("n"), self._same("h", "n"), "left_anti"))
        return True

    def sweep(self) -> list[str]:
        """Remove the files of segments that the newest version doesn't name (readers of older versions must be done); their names."""
        named, jvm = {s["segment"] for s in self.segments}, self.spark.sparkContext._jvm
        removed: set[str] = set()
        for name in ("postings", "docs", "gone", "sums"):
            root = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for entry in fs.listStatus(root) if fs.exists(root) else []:
                segment = entry.getPath().getName().removeprefix("segment=")
                if segment not in named:
                    fs.delete(entry.getPath(), True)
                    removed.add(segment)
        return sorted(removed)

    # Search

    def best(self, queries: DataFrame, k: int, details: bool = False) -> DataFrame:
        """query_id, book, doc_id, rank, score, and with details matched, recurring, coverage, of each query's k best documents of each book (see scores); ties by id.

        A document's asked terms are one row, and rows and queries meet in blocks (search.ahead), so no pair of them is shuffled."""
        on = [self.book] if self.book in queries.columns else []
        held, books = self._read("postings"), self.books()
        if held is None:
            raise ValueError("nothing was ever put into this index")
        asked, numbers = posed(queries, on, tokenize=self.tokenize)
        wanted = cut(numbers.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")))
        near = held.join(small(wanted), ["bucket", "term"])
        gone = self._read("gone").select("of", self.book, self.doc_id)
        near = near.alias("d").join(small(cut(gone)).alias("g"), self._same("d", "g") & (F.col("d.segment") == F.col("g.of")), "left_anti")
        listed = F.array_sort(F.collect_list(F.struct("code", "tf"))).alias("x")
        rows = cut(near.groupBy(self.book, self.doc_id, "dl").agg(listed).select(self.book, self.doc_id, "dl", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs")))
        if not rows.where(F.col(self.book).isNull() | F.col(self.doc_id).isNull()).isEmpty():
            # Nulls are equal here and nowhere in the blocks.
            found = search.top(self.scores(queries), k, F.round("score", 9), [self.doc_id], group=["query_id", self.book])
            return found if details else found.drop("matched", "recurring", "coverage")
        sized = books.select(self.book, "n", (F.when(F.col("tokens") == 0, F.col("n")).otherwise(F.col("tokens")) / F.col("n")).alias("avgdl"))
        frequency = rows.select(self.book, F.explode("codes").alias("code")).groupBy(self.book, "code").agg(F.count(F.lit(1)).alias("df"))
        weights = cut(frequency.join(small(cut(sized)), self.book).join(small(numbers), "code").select(self.book, "code", "term", "df", "avgdl", idf(F.col("n"), F.col("df")).alias("idf")))
        first = cut(search.ahead(rows, weights, asked, k, self.doc_id, [self.book]))
        return first.join(small(search.told(rows, weights, asked, first, self.doc_id, [self.book], [self.book])), ["query_id", self.book, self.doc_id]) if details else first

    def scores(self, queries: DataFrame, query_id: str = "query_id") -> DataFrame:
        """query_id, book, doc_id, score, matched, recurring, coverage, as index.scores has them, of one corpus a book. Queries with a column of the
        book's name are asked of that book, others of every book."""
        on = [self.book] if self.book in queries.columns else []
        terms = queries.select(query_id, *on, F.array_distinct(self.tokenize(F.col("query"))).alias("terms"))
        asked = cut(terms.select(query_id, *on, F.size("terms").alias("asked"), F.explode("terms").alias("term")))
        held, books = self._read("postings"), self.books()
        if held is None:
            raise ValueError("nothing was ever put into this index")
        wanted = asked.select("term", *on).distinct().withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        near = held.alias("d").join(small(cut(wanted)), ["bucket", "term", *on], "left_semi")
        gone = self._read("gone").select("of", self.book, self.doc_id)
        found = cut(near.alias("d").join(small(cut(gone)).alias("g"), self._same("d", "g") & (F.col("d.segment") == F.col("g.of")), "left_anti").select("term", self.book, self.doc_id, "tf", "dl"))
        # Of each book a row, and one of each of its asked terms.
        sized = books.select(self.book, "n", (F.when(F.col("tokens") == 0, F.col("n")).otherwise(F.col("tokens")) / F.col("n")).alias("avgdl"))
        frequency = found.groupBy(self.book, "term").agg(F.count(F.lit(1)).alias("df"))
        weighed = frequency.alias("f").join(small(cut(sized)).alias("b"), F.col(f"f.{self.book}").eqNullSafe(F.col(f"b.{self.book}"))).select(F.col(f"f.{self.book}").alias(self.book), "term", "df", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
        matched = found.alias("f").join(small(cut(weighed)).alias("w"), F.col(f"f.{self.book}").eqNullSafe(F.col(f"w.{self.book}")) & (F.col("f.term") == F.col("w.term"))).select("f.*", "df", "avgdl", "idf")
        joined = matched.join(small(asked), ["term", *on])
        return joined.groupBy(query_id, self.book, self.doc_id).agg(
            F.sum(term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))).alias("score"),
            F.count(F.lit(1)).alias("matched"),
            F.array_sort(F.collect_list(F.when(F.col("df") >= K.RECURRING_DF, F.col("term")))).alias("recurring"),
            (F.count(F.lit(1)) / F.first("asked")).alias("coverage"),
        )
