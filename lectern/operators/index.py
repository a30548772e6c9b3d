"""Inverted index and BM25 as tables: postings, document statistics, term statistics.

scope columns name the corpus that a document belongs to (a book, or a chapter of it); document frequencies and average
lengths are those of the scope. Postings are one two-phase aggregate; a query touches the postings of its terms only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import constants as K
from lectern.functions import text as X
from lectern.operators.joins import MOST_BROADCAST, cut, small


def postings(docs: DataFrame, keys: Sequence[str], text: str = "text", tokenize=X.tokens) -> DataFrame:
    """keys, term, tf."""
    return docs.select(*keys, F.explode(tokenize(F.col(text))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(docs: DataFrame, keys: Sequence[str], text: str = "text", tokenize=X.tokens) -> DataFrame:
    """keys, dl."""
    return docs.select(*keys, F.size(tokenize(F.col(text))).cast("long").alias("dl"))


def corpus_stats(stats: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """scope, n, avgdl; avgdl is 1 where every document is empty."""
    total = F.sum("dl")
    return stats.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), (F.when(total == 0, F.count(F.lit(1))).otherwise(total) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avgdl"))


def term_stats(found: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """scope, term, df."""
    return found.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def term_score(tf: Column, dl: Column, avgdl: Column, weight: Column) -> Column:
    return weight * tf * (K.BM25_K1 + 1) / (tf + K.BM25_K1 * (1 - K.BM25_B + K.BM25_B * dl / avgdl))


#: Documents of one block of pairs with queries; documents of a block that meet the queries at once.
PAIRED, TOGETHER = 2_048, 128
#: Queries of one block.
POSED = 1_024


def counted(docs: DataFrame, numbers: DataFrame, keys: Sequence[str], text: str = "text", tokenize=X.tokens) -> DataFrame:
    """keys, dl, copies, codes, tfs: of each document (rows of equal keys and length are one) its length, its rows, and its terms that are in numbers (term, code) with their counts.

    Terms are numbered and counted where a text is read, so that a document is one short row from then on. Only where there are more terms than a broadcast may have are tokens
    joined with them."""
    tokened = docs.select(*keys, F.coalesce(tokenize(F.col(text)), F.array().cast("array<string>")).alias("__tokens")).withColumn("dl", F.size("__tokens").cast("long"))
    if numbers.count() <= MOST_BROADCAST:
        known = numbers.orderBy("code").toArrow()
        terms, codes = known.column("term").combine_chunks(), known.column("code").to_numpy()
        schema = T.StructType([*[f for f in tokened.schema.fields if f.name != "__tokens"], T.StructField("codes", T.ArrayType(T.LongType())), T.StructField("tfs", T.ArrayType(T.LongType()))])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = batch.column(batch.schema.get_field_index("__tokens"))
                words = tokens.flatten()
                place = pc.fill_null(pc.index_in(words, value_set=terms.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(batch)), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                held = place >= 0
                pairs, n = np.unique(row[held] * max(len(codes), 1) + place[held], return_counts=True)
                starts = pa.array(np.searchsorted(pairs, np.arange(len(batch) + 1) * max(len(codes), 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int64())) for x in (codes[pairs % max(len(codes), 1)], n)]
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-2]], *lists], names=schema.names)

        each = tokened.mapInArrow(count, schema)
    else:
        rows = tokened.withColumn("__row", F.monotonically_increasing_id())
        marks = rows.select(*keys, "dl", "__row", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("__tokens"))).alias("term")).join(numbers, "term", "left").where(F.col("code").isNotNull() | F.col("term").isNull())
        counts = marks.groupBy(*keys, "dl", "__row", "code").agg(F.count(F.lit(1)).alias("tf"))
        listed = F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "tf"))))
        each = counts.groupBy(*keys, "dl", "__row").agg(listed.alias("x")).select(*keys, "dl", F.col("x.code").alias("codes"), F.col("x.tf").alias("tfs"))
    merged = each.groupBy(*keys, "dl").agg(F.count(F.lit(1)).alias("copies"), F.flatten(F.collect_list("codes")).alias("__codes"), F.flatten(F.collect_list("tfs")).alias("__tfs"))
    # Only rows of one document that are several need their counts added.
    once = F.array_sort(F.array_distinct("__codes"))
    added = F.transform(once, lambda c: F.aggregate(F.zip_with("__codes", "__tfs", lambda a, b: F.when(a == c, b).otherwise(0)), F.lit(0).cast("long"), lambda n, x: n + x))
    return merged.select(*keys, "dl", "copies", F.when(F.col("copies") > 1, once).otherwise(F.col("__codes")).alias("codes"), F.when(F.col("copies") > 1, added).otherwise(F.col("__tfs")).alias("tfs"))


def numbered(asked: DataFrame) -> DataFrame:
    """term, code of the terms asked for; codes ascend with terms. It is kept, as codes must stay."""
    return cut(asked.select("term").distinct().repartitionByRange("term").sortWithinPartitions("term").withColumn("code", F.monotonically_increasing_id()))


def posed(queries: DataFrame, own: Sequence[str], query_id: str = "query_id", tokenize=X.tokens) -> tuple[DataFrame, DataFrame]:
    """(asked, numbers): query_id, own, asked (terms of the query), term, code, which is kept; term, code."""
    terms = queries.select(query_id, *own, F.array_distinct(tokenize(F.col("query"))).alias("terms"))
    rows = terms.select(query_id, *own, F.size("terms").alias("asked"), F.explode("terms").alias("term"))
    numbers = numbered(rows)
    return cut(rows.join(small(numbers), "term")), numbers


def weighed(docs: DataFrame, queries: DataFrame, doc_id: str, scope: Sequence[str] = (), query_id: str = "query_id", text: str = "text", tokenize=X.tokens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(held, weights, asked): documents as counted() gives them; scope, code, term, df, avgdl, idf of the asked terms; query_id, asked (terms of the query), term, code of the queries. All
    are tables that are kept, so that they can be read more than once. queries: query_id, query [, scope]; without a scope of their own, queries are asked in every scope.

    The corpus is read and tokenized once: of each document its length and its counts of asked terms are kept, and all statistics are made of these."""
    asked, numbers = posed(queries, [s for s in scope if s in queries.columns], query_id, tokenize)
    held = cut(counted(docs, numbers, [*scope, doc_id], text, tokenize))
    sized = corpus_stats(held.select(*scope, F.explode(F.array_repeat("dl", F.col("copies").cast("int"))).alias("dl")), scope)
    frequency = held.select(*scope, F.explode("codes").alias("code")).groupBy(*scope, "code").agg(F.count(F.lit(1)).alias("df"))
    # Of each scope one row, and one of each of its asked terms.
    weights = frequency.join(small(sized), list(scope)) if scope else frequency.crossJoin(sized)
    weights = weights.join(small(numbers), "code").select(*scope, "code", "term", "df", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    return held, cut(weights), asked


def matches(docs: DataFrame, queries: DataFrame, doc_id: str, scope: Sequence[str] = (), query_id: str = "query_id", text: str = "text", tokenize=X.tokens) -> DataFrame:
    """query_id, scope, doc_id, term, tf, dl, df, avgdl, idf, asked: a row for each term of a query in a document (see weighed)."""
    held, weights, asked = weighed(docs, queries, doc_id, scope, query_id, text, tokenize)
    found = held.select(*scope, doc_id, "dl", F.explode(F.arrays_zip("codes", "tfs")).alias("x")).select(*scope, doc_id, "dl", F.col("x.codes").alias("code"), F.col("x.tfs").alias("tf"))
    return found.join(small(weights), [*scope, "code"]).join(small(asked.drop("term")), ["code", *[s for s in scope if s in queries.columns]])


def score() -> Column:
    """A document's score, over its matches with a query."""
    return F.sum(term_score(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf"))).alias("score")


def details() -> list[Column]:
    """matched (terms of the query in the document), recurring (those in RECURRING_DF documents or more), coverage."""
    recurring = F.array_sort(F.collect_list(F.when(F.col("df") >= K.RECURRING_DF, F.col("term")))).alias("recurring")
    return [F.count(F.lit(1)).alias("matched"), recurring, (F.count(F.lit(1)) / F.first("asked")).alias("coverage")]


def scores(docs: DataFrame, queries: DataFrame, doc_id: str, scope: Sequence[str] = (), query_id: str = "query_id", text: str = "text", tokenize=X.tokens) -> DataFrame:
    """query_id, scope, doc_id, score and details() of all documents that share a term with a query (see matches); for the best ones only, search.best is cheaper. Documents without a term
    are absent, as their score is 0."""
    return matches(docs, queries, doc_id, scope, query_id, text, tokenize).groupBy(query_id, *scope, doc_id).agg(score(), *details())


def shared(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str = "query_id", text: str = "text", tokenize=X.tokens, recurring: bool = True) -> DataFrame:
    """query_id, doc_id and details() (without recurring, if it isn't wanted) of all documents that share a term with a query, of one corpus.

    Documents and queries are dealt to blocks of bounded size, and a pair of blocks meets in one task: documents are shuffled once, pairs never."""
    held, weights, asked = weighed(docs, queries, doc_id, (), query_id, text, tokenize)
    left, right = max(1, -(-held.count() // PAIRED)), max(1, -(-asked.select(query_id).distinct().count() // POSED))
    dealt = held.select(doc_id, "codes", F.pmod(F.xxhash64(doc_id), F.lit(left)).cast("int").alias("__g"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("__h"))
    again = weights.select("code", (F.col("df") >= K.RECURRING_DF).alias("__again"))
    terms = asked.join(small(again), "code").select("*", F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("__g"), F.pmod(F.xxhash64(query_id), F.lit(right)).cast("int").alias("__h"))
    more = [T.StructField("recurring", T.ArrayType(T.StringType()))] if recurring else []
    schema = T.StructType([asked.schema[query_id], held.schema[doc_id], T.StructField("matched", T.LongType()), *more, T.StructField("coverage", T.DoubleType())])

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kinds = pa.schema([(query_id, theirs.schema.field(query_id).type), (doc_id, mine.schema.field(doc_id).type), ("matched", pa.int64()), *([("recurring", pa.list_(pa.string()))] if recurring else []), ("coverage", pa.float64())])
        if not len(mine) or not len(theirs):
            return kinds.empty_table()
        ids = mine.column(doc_id).combine_chunks().dictionary_encode("encode")
        names = theirs.column(query_id).combine_chunks().dictionary_encode("encode")
        column, size = names.indices.to_numpy(), len(names.dictionary)
        number, first, place = np.unique(theirs.column("code").to_numpy(), return_index=True, return_inverse=True)
        texts, again, of = theirs.column("term").combine_chunks().take(pa.array(first)), theirs.column("__again").to_numpy()[first], np.zeros(size)
        of[column] = theirs.column("asked").to_numpy()
        # The queries of each term, and each document's different terms that a query has.
        order = np.argsort(place, kind="stable")
        begins, column = np.searchsorted(place[order], np.arange(len(number) + 1)), column[order]
        row = np.repeat(ids.indices.to_numpy(), pc.list_value_length(mine.column("codes")).to_numpy())
        code = pc.list_flatten(mine.column("codes")).to_numpy()
        at = np.minimum(np.searchsorted(number, code), len(number) - 1)
        known = number[at] == code
        pairs = np.unique(row[known] * len(number) + at[known])
        out = []
        for start in range(0, len(ids.dictionary), TOGETHER):
            part = pairs[slice(*np.searchsorted(pairs, np.array([start, start + TOGETHER]) * len(number)))]
            doc, term = part // len(number) - start, part % len(number)
            n = begins[term + 1] - begins[term]
            # One element for each query that has one of a document's terms.
            query = column[np.repeat(begins[term] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            cell, term = np.repeat(doc, n) * size + query, np.repeat(term, n)
            matched = np.bincount(cell, minlength=TOGETHER * size)
            met = np.flatnonzero(matched)
            columns = [names.dictionary.take(pa.array(met % size)), ids.dictionary.take(pa.array(met // size + start)), pa.array(matched[met])]
            if recurring:
                told = np.flatnonzero(again[term])
                told = told[np.argsort(cell[told], kind="stable")]
                ends = np.append(np.searchsorted(cell[told], met), len(told))
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.take(pa.array(term[told])).cast(pa.string())))
            out.append(pa.Table.from_arrays([*columns, pa.array(matched[met] / of[met % size])], schema=kinds))
        return pa.concat_tables(out)

    return dealt.groupBy("__g", "__h").cogroup(terms.groupBy("__g", "__h")).applyInArrow(meet, schema)
